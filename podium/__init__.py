"""podium: race-results analytics, integrity rules and ingest on Spark DataFrames.

Subpackages:
  functions   Column -> Column helpers (names, exact percent text, nth part, TIME text)
  sources     parquet scans, delimited loads, sinks (append, publish, layouts, stored tables)
  operators   the operators: DataFrames and column names in, lazy DataFrames out
  plans       bindings onto the test tables, registered queries, DuckDB oracles, jobs
  streaming   the change-feed validator (foreachBatch)

Operators are built from Spark SQL built-ins only (no Python UDFs). They are lazy, except for
the documented steps that store an intermediate, checkpoint, or check a broadcast side's size.
See README.md for the operator map and the scale notes.
"""

from podium.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
