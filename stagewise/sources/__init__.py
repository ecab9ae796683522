"""Sources and sinks: the five funnel tables and the dashboard dataset."""

from .buckets import store_rides, with_stored_rides
from .days import downloaded, read_by_day, store_by_day
from .derive import derive_tables
from .handoff import publish, read_published, verify
from .schemas import SCHEMAS, TABLE_NAMES
from .sinks import write_dashboard_dataset
from .tables import FunnelTables, SchemaError, conform, load_tables, materialize_tables, read_tables, write_tables

__all__ = [
    "FunnelTables",
    "SCHEMAS",
    "SchemaError",
    "TABLE_NAMES",
    "conform",
    "derive_tables",
    "downloaded",
    "load_tables",
    "materialize_tables",
    "publish",
    "read_by_day",
    "read_published",
    "read_tables",
    "store_by_day",
    "store_rides",
    "verify",
    "with_stored_rides",
    "write_tables",
    "write_dashboard_dataset",
]
