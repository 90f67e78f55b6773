"""The library's queries."""

from . import aspect_queries, language_queries, model_queries, page_queries, record_queries, table_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
