from tidemark.streaming.ingest import deduplicated, event_stream, ingest_events, rejected_stream
from tidemark.streaming.metrics import (
    compact_updates, latest_versions, live_counts, live_hourly_performance, live_windows, monitored_stream,
    recent_events, refresh_monitored,
)
from tidemark.streaming.refresh import monitored_table, refresh_hours
from tidemark.streaming.rollup import (
    daily_client_bitmaps, daily_rollup, distinct_clients, engagement_from_days, fold_client_bitmaps, fold_days,
    merge_client_bitmaps, merge_days, stream_client_bitmaps, stream_daily_rollup,
)
from tidemark.streaming.unique import append_unique, ingest_unique, unique_events

__all__ = [
    "append_unique", "compact_updates", "daily_client_bitmaps", "daily_rollup", "deduplicated", "distinct_clients",
    "engagement_from_days", "event_stream", "fold_client_bitmaps", "fold_days", "ingest_events", "ingest_unique",
    "latest_versions", "live_counts", "live_hourly_performance", "live_windows", "merge_client_bitmaps", "merge_days",
    "monitored_stream", "monitored_table", "recent_events", "refresh_hours", "refresh_monitored", "rejected_stream",
    "stream_client_bitmaps", "stream_daily_rollup", "unique_events",
]
