"""Named queries over the given tables, each with the SQL it must agree with."""

from gleanmill.queries import harvest_queries, record_queries, rule_queries, store_queries, table_queries, text_queries, value_queries  # noqa: F401
from gleanmill.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
