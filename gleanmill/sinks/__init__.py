"""Tables and files written by the jobs."""
