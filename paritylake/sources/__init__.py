from .files import (
    csv_health,
    file_order,
    header_groups,
    preview,
    read_header,
    read_responses,
    read_table,
    records_to_table,
    rejected_responses,
    split_responses,
    write_keyed,
    write_table,
)
from .reports import report_tables, write_reports

__all__ = [
    "csv_health", "file_order", "header_groups", "preview", "read_header", "read_responses", "read_table",
    "records_to_table", "rejected_responses", "report_tables", "split_responses", "write_keyed", "write_reports", "write_table",
]
