"""stagewise: customer-funnel analytics on Spark DataFrames."""

from .operators import *  # noqa: F401,F403
from .sources import FunnelTables, load_tables, materialize_tables, read_tables, write_dashboard_dataset

__version__ = "0.1.0"
