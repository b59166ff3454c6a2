"""Sources and sinks: parquet scans, delimited loads, snapshot publishing, layouts."""

from podium.sources.tables import Tables, read_tables

__all__ = ["Tables", "read_tables"]
