"""Fields of captured pages: Spark spreads the pages, a small parser reads each one."""
