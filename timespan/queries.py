"""All queries over the given tables, each with its DuckDB twin where there is one."""

from timespan.plans import history_queries, interval_queries, segmentation_queries, signal_queries, source_queries, stream_queries, transcript_queries  # noqa: F401
from timespan.registry import ORACLE, QUERIES  # noqa: F401
