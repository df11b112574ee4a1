from .balanced import balanced_batches
from .compare import (
    compare_stream,
    parse_stream,
    read_last,
    stream_cells,
    stream_errors,
    stream_feature_stats,
    stream_last,
    write_batches,
)
from .late import read_late, read_windows, split_batches, watermark

__all__ = [
    "balanced_batches", "compare_stream", "parse_stream", "read_last", "read_late", "read_windows", "split_batches",
    "stream_cells", "stream_errors", "stream_feature_stats", "stream_last", "watermark", "write_batches",
]
