"""All registered queries of the engine's own operators."""

from docloom.plans import queries_context, queries_documents, queries_layout, queries_quality, queries_search, queries_stream, queries_text, queries_whole  # noqa: F401
from docloom.plans.registry import oracle_sql, queries  # noqa: F401
