"""All queries: importing the plan modules fills the registry."""

from . import claims_queries, edit_queries, findings_queries, library_queries, sequence_queries, sink_queries, stream_queries, text_queries, validate_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
