from tidemark.operators.absence import not_exists, not_in
from tidemark.operators.latest import (
    TimedView, as_of_join, as_of_views, first_rows, latest_row, latest_rows, top_rows,
)
from tidemark.operators.numbering import append_numbered, numbered
from tidemark.operators.quantile import exact_quantile
from tidemark.operators.reshape import (
    attach_row, feature_moments, metric_rows, one_row, unpivot_doubles,
)
from tidemark.operators.sampling import hash_sample, hash_split

__all__ = [
    "TimedView", "append_numbered", "as_of_join", "as_of_views", "attach_row", "exact_quantile", "feature_moments",
    "first_rows", "hash_sample", "hash_split", "latest_row", "latest_rows", "metric_rows", "not_exists", "not_in",
    "numbered", "one_row", "top_rows", "unpivot_doubles",
]
