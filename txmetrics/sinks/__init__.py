"""CSV and table writers."""

from txmetrics.sinks.csv import export_csv, write_json
from txmetrics.sinks.tables import materialise, shared_folder, write_clusters, write_partitioned

__all__ = [
    "export_csv",
    "materialise",
    "shared_folder",
    "write_clusters",
    "write_json",
    "write_partitioned",
]
