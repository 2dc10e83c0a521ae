"""Column builders: every function takes Columns (or names) and returns a Column."""
