"""T-S1: validate a change feed as it arrives (the AFTER trigger on a stream).

``readStream`` -> ``foreachBatch``: each micro-batch is the trigger's
``inserted`` set. It is checked with the create semantics of the upserts
against the base plus everything earlier batches accepted.

The accepted rows are the stream's state. They are kept as a table of claims (``Snapshots``), clustered by what the rule
groups by, season or race first, and the pointer knows each file's range of it and of the row key. A batch opens only
files whose ranges hold one of its own groups or keys, so for a feed that moves on in time the
bytes it reads follow its own size, not the feed's history; the files of ``MERGED`` batches are merged into larger
ones, so their number grows by a few for that many batches.

Each batch makes one version of the claims, also one without an accepted row. A batch replayed after a failure reads
the version that the batches before it have made and writes the same report and claims again, so the output is
idempotent; the streaming checkpoint records progress.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegralType, StructType

from podium.operators import rules as R
from podium.operators import upsert as U
from podium.sources.snapshots import LISTED, Snapshots

MERGED = 8  # the claims of so many batches are merged into one part
ROWS_A_FILE = 1_000_000
GROUP, KEY = "_group", "_key"


def _simple(column: Column, kind) -> Column:
    """A column's first simple part, as a whole number or a string: what the claims' ranges are kept of."""
    if isinstance(kind, StructType):
        return _simple(column[kind.fields[0].name], kind.fields[0].dataType)
    return column.cast("long") if isinstance(kind, IntegralType) else column.cast("string")


def _row_key(rule) -> str:
    return rule.race if isinstance(rule, R.CapRule) else "ResultId"


def _marked(rows: DataFrame, races: DataFrame, rule) -> DataFrame:
    """The rows with the leading part of their rule's group and of their key."""
    if isinstance(rule, R.OwnerRule):
        rows = rows.join(races.select("RaceId", F.col(rule.season).alias("_season")), "RaceId", "left")
        lead = "_season"
    elif isinstance(rule, R.CapRule):
        lead = next((g for g in rule.group if "Year" in g), rule.group[0])
    else:
        lead = rule.race
    kinds, key = rows.schema, _row_key(rule)
    return rows.withColumns({GROUP: _simple(F.col(lead), kinds[lead].dataType), KEY: _simple(F.col(key), kinds[key].dataType)}).drop("_season")


def _wanted(marked: DataFrame) -> dict[str, list[tuple]]:
    """The stretches of the batch's groups and keys: each value of a short batch, the whole range of a long one."""
    out = {}
    for name in (GROUP, KEY):
        values = [r[0] for r in marked.select(name).where(F.col(name).isNotNull()).distinct().limit(LISTED + 1).collect()]
        out[name] = [(v, v) for v in values] if len(values) <= LISTED else [tuple(marked.agg(F.min(name), F.max(name)).first())]
    return out


class Claims:
    """What earlier batches accepted."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.store = Snapshots(spark, folder)
        if self.store.version() == 0:
            empty = spark.createDataFrame([], schema)
            self.store.commit(0, {"Claims": {"schema": empty.schema.jsonValue(), "parts": [], "batch": -1}})

    def before(self, batch_id: int) -> int:
        """The version that the batches before this one have made."""
        version = self.store.version()
        while self.store._state(version)["Claims"]["batch"] >= batch_id:
            version -= 1
        return version

    def near(self, version: int, wanted: dict[str, list[tuple]]) -> DataFrame:
        return self.store.read_near("Claims", version, wanted)

    def add(self, version: int, batch_id: int, accepted: DataFrame) -> None:
        """The next version: the claims with this batch's rows. Nothing to do for a replayed batch that made it before."""
        if self.store.version() > version:
            return
        state = self.store._state(version)["Claims"]
        parts = [*state["parts"], self._part(accepted)]
        small = [p for p in parts if not p.get("merged")]
        if len(small) >= MERGED:
            rows = self.store._frame({**state, "parts": small})
            parts = [*[p for p in parts if p.get("merged")], {**self._part(rows), "merged": True}]
        # a part without rows has no ranges; it is not carried on
        self.store.commit(version, {"Claims": {**state, "parts": [p for p in parts if p["ranges"]], "batch": batch_id}})

    def _part(self, rows: DataFrame) -> dict:
        return self.store.put_aside("Claims", rows, cluster=[GROUP, KEY], files=max(1, -(-rows.count() // ROWS_A_FILE)), ranges=[GROUP, KEY])


def validate_feed(spark: SparkSession, feed: DataFrame, *, base: DataFrame, races: DataFrame, rule,
                  out_dir: str, checkpoint: str, seq: str = "seq",
                  available_now: bool = True) -> StreamingQuery:
    """Start the validating stream; returns the running query.

    feed: a streaming DataFrame of requested rows (the base columns plus ``seq``).
    base: the published table (results; for a cap rule, races).
    Reports land in ``{out_dir}/report/batch_id=N``.
    """
    if not isinstance(rule, (R.UniqueRule, R.OwnerRule, R.CapRule)):
        raise TypeError(f"not a rule: {rule!r}")
    report_dir, base_cols = f"{out_dir.rstrip('/')}/report", base.columns
    claims = Claims(spark, f"{out_dir.rstrip('/')}/claims", _marked(base, races, rule).schema)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # the lookup and the check read it; the source would be read twice
        version = claims.before(batch_id)
        state = base.unionByName(claims.near(version, _wanted(_marked(batch, races, rule))).select(*base_cols))
        if isinstance(rule, R.UniqueRule):
            report = U.create_unique(state, batch, races, rule, seq=seq)
        elif isinstance(rule, R.OwnerRule):
            report = U.create_owned(state, batch, races, rule, seq=seq)
        else:
            report = U.create_capped(state, batch, rule, seq=seq)
        report = report.drop(seq)
        path = f"{report_dir}/batch_id={batch_id}"
        report.write.mode("overwrite").parquet(path)
        accepted = spark.read.schema(report.schema).parquet(path).filter(F.col("Status") == U.ACCEPTED)
        claims.add(version, batch_id, _marked(accepted.select(*base_cols), races, rule))
        batch.unpersist()

    writer = (feed.writeStream.foreachBatch(handle)
              .option("checkpointLocation", checkpoint)
              .queryName(f"podium_validate_{zlib.crc32(out_dir.encode())}"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_reports(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir.rstrip('/')}/report")
