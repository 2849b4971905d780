"""Structured Streaming: keyed changes, tagging, new addresses, incremental statistics."""

from .feeds import stream_buffered_commit, stream_new_urls, stream_tag, stream_tail
from .tables import ChangeTable, SeenTable, StatisticsTable, stream_term_stats, stream_upsert_delete

__all__ = ["ChangeTable", "SeenTable", "StatisticsTable", "stream_buffered_commit", "stream_new_urls", "stream_tag", "stream_tail",
           "stream_term_stats", "stream_upsert_delete"]
