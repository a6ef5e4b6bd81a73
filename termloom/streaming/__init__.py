from .ingest import stream_upserts
from .log import stream_collapse, stream_hot_stats, stream_query_counts

__all__ = ["stream_collapse", "stream_hot_stats", "stream_query_counts", "stream_upserts"]
