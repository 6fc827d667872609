"""All queries of the reference's operators and their DuckDB equivalents."""

from quillspark.plans import data_queries, document_queries, search_queries  # noqa: F401  they register themselves
from quillspark.plans.registry import ORACLES, QUERIES

FLAGSHIP = "bm25_search"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
