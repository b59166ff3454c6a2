"""The ingest job (I1-I7 + S7): a delimited result file into the stored racing tables.

Tables live as parquet folders ``{tables_dir}/{Circuit,Constructor,Driver,Season,Race,Result}``.
The job loads the file tolerantly (S3: bad numbers become NULL and are reported),
computes the new rows of every table against the current contents and appends
them (S7). Running it again on the same file appends nothing. ``run_ingest_as_one`` does the same on a
``Snapshots`` store, where the rows of all six tables become visible together or not at all.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators.ingest import ingest_race_results
from podium.sources.delimited import tolerant_load
from podium.sources.sinks import append, materialize
from podium.sources.snapshots import Snapshots

TABLES = ("Circuit", "Constructor", "Driver", "Season", "Race", "Result")


def run_ingest(spark: SparkSession, csv_path: str, tables_dir: str, *,
               race_date: dt.date | str = "1970-01-01") -> tuple[dict[str, int], DataFrame]:
    """Returns (rows appended per table, rejected lines with reasons: lines that did not
    parse, and lines that found no race or driver).

    The staged lines are stored once (S6): six steps read them, and an executor lost on the way
    does not change them. New rows are stored before any table grows, since they are
    computed from the tables' current contents.
    """
    stage, rejects = tolerant_load(spark, csv_path)
    stage = materialize(stage, "ingest_stage")
    current = {name: spark.read.parquet(f"{tables_dir.rstrip('/')}/{name}") for name in TABLES}
    new = ingest_race_results(stage, current, race_date=race_date)
    rows = {name: materialize(new[name].select(*[c for c in current[name].columns if c in new[name].columns]), "ingest_new")
            for name in TABLES}
    lost = _lost_lines(new["Unresolved"], stage)
    appended = {}
    for name in TABLES:      # dimensions first, facts last
        appended[name] = rows[name].count()
        if appended[name]:
            append(rows[name], f"{tables_dir.rstrip('/')}/{name}")
    return appended, rejects.unionByName(lost)


def run_ingest_as_one(spark: SparkSession, csv_path: str, store: Snapshots, *,
                      race_date: dt.date | str = "1970-01-01") -> tuple[dict[str, int], DataFrame]:
    """``run_ingest`` for tables kept in ``store``, with one commit for all of them.

    Each table's new rows are written once, aside, as soon as they are numbered; the later tables resolve their
    ids against those files, and the commit makes the files visible. A job that is lost before it leaves the old
    state, so running it again adds each row once; so does a job that another writer has overtaken
    (``VersionConflict``).
    """
    stage, rejects = tolerant_load(spark, csv_path)
    stage = materialize(stage, "ingest_stage")
    base = store.version()
    current = {name: store.read(name, base) for name in TABLES}
    parts = {}

    def keep(name: str, rows: DataFrame) -> DataFrame:
        parts[name] = store.put_aside(name, rows.select(*[c for c in current[name].columns if c in rows.columns]))
        return store.part(name, parts[name], current[name].schema)
    new = ingest_race_results(stage, current, race_date=race_date, keep=keep)
    lost = _lost_lines(new["Unresolved"], stage)
    appended = {name: new[name].count() for name in TABLES}
    if any(appended.values()):
        store.commit_parts(base, {name: parts[name] for name in TABLES if appended[name]})
    return appended, rejects.unionByName(lost)


def _lost_lines(unresolved: DataFrame, stage: DataFrame) -> DataFrame:
    """The lines that found no race or driver, as text, with the reason."""
    line = F.concat_ws(";", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in stage.columns]).alias("line")
    return materialize(unresolved.select(line, "reason"), "ingest_lost")
