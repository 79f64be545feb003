from tidemark.sources.batch_log import BatchLog, newest
from tidemark.sources.readers import (
    as_view, csv_client_ids, event_files, ingest_event_files, literal_rows, rejected_event_lines, scan,
    stored_view, table_columns, table_exists,
)
from tidemark.sources.writers import (
    append_absent, append_rows, copy_table, drop_days_before, materialize, replace_days,
    retained, updated, update_days, write_bucketed, write_sorted,
)

__all__ = [
    "BatchLog", "append_absent", "append_rows", "as_view", "copy_table", "csv_client_ids",
    "drop_days_before", "event_files", "ingest_event_files", "literal_rows", "materialize", "newest",
    "rejected_event_lines", "replace_days", "retained", "scan", "stored_view", "table_columns", "table_exists", "updated",
    "update_days", "write_bucketed", "write_sorted",
]
