"""All queries of the library."""

from quire.plans import film_queries, layout_queries, page_queries, review_queries, table_queries, text_queries, wording_queries
from quire.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "film_queries", "layout_queries", "page_queries", "review_queries", "table_queries", "text_queries", "wording_queries"]
