"""Sinks: append (S7), publish-or-reject snapshots (S14) and clustered layouts.

The reference's three covering indexes become table layouts:
  S11 results bucketed and sorted on (RaceId, DriverId): joins and aggregates on
      the race key read co-partitioned buckets without a shuffle;
  S12 standings bucketed on RaceId, so standings join results per race locally;
  S13 results range-clustered on RaceId and sorted by (RaceId, FastestLapTime):
      parquet min/max statistics let a race filter skip row groups.
"Include" columns need nothing: parquet is columnar and reads only what is used.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession


class ConstraintViolation(Exception):
    """Raised by ``publish`` when a check returns rows; nothing was written."""

    def __init__(self, name: str, sample: list[Row]):
        self.name = name
        self.sample = sample
        first = sample[0].asDict() if sample else {}
        super().__init__(f"{name}: {first.get('Message', first)}")


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """``INSERT INTO T SELECT ...`` as an append of new files."""
    df.write.mode("append").format(fmt).save(path)


def publish(snapshot: DataFrame, checks: dict[str, DataFrame], path: str, *,
            dry_run: bool = False, sample: int = 20) -> str | None:
    """Write ``snapshot`` to ``path`` only if every check is empty.

    The reference's statement-level rollback becomes "decide before writing":
    each check is probed with a bounded ``take`` (at most ``sample`` rows reach
    the driver); the first non-empty one raises ``ConstraintViolation`` and
    nothing is written. ``dry_run=True`` validates only (the tests' ROLLBACK).
    The target path must be new, so a published snapshot is never overwritten.
    """
    for name, check in checks.items():
        rows = check.take(sample)
        if rows:
            raise ConstraintViolation(name, rows)
    if dry_run:
        return None
    snapshot.write.mode("errorifexists").parquet(path)
    return path


def publish_draft(spark: SparkSession, draft: str, checks: dict[str, DataFrame], path: str, *,
                  dry_run: bool = False, sample: int = 20) -> str | None:
    """S14 for a snapshot that is already stored in the folder ``draft``: when every check is empty the folder
    becomes ``path`` by a rename, so the state is written once; otherwise (and after a dry run) it is deleted. The
    target path must be new."""
    fs, target = _file_system(spark, path)
    _, at = _file_system(spark, draft)
    try:
        for name, check in checks.items():
            rows = check.take(sample)
            if rows:
                raise ConstraintViolation(name, rows)
        if dry_run:
            return None
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(at, target):
            raise FileExistsError(path)
    finally:
        fs.delete(at, True)
    return path


def save_bucketed(df: DataFrame, table: str, *, bucket_by: Sequence[str], sort_by: Sequence[str],
                  buckets: int | None = None, path: str | None = None) -> None:
    """A bucketed, sorted catalog table (``bucketBy`` needs ``saveAsTable``).

    buckets: how many; ``files_for`` gives a number from bytes. The rows are dealt by
    the bucket columns first, so each task writes one bucket's file instead of a file per bucket. path: where the files go (an external table); by default a folder under the
    shared checkpoint directory, never the driver's working directory.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    location = path or shared_folder(spark, f"tables/{table}")
    (df.repartition(n, *bucket_by).write.mode("overwrite").format("parquet").option("path", location)
     .bucketBy(n, *bucket_by).sortBy(*sort_by).saveAsTable(table))


def write_range_clustered(df: DataFrame, path: str, *, cluster_by: Sequence[str],
                          sort_by: Sequence[str], partitions: int | None = None) -> None:
    """Range-partition on the cluster key and sort inside each file, so every
    file (and row group) covers a narrow key range and filters on it prune."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(n, *cluster_by).sortWithinPartitions(*sort_by)
     .write.mode("overwrite").parquet(path))


def files_for(spark: SparkSession, inputs: Sequence[str], target_bytes: int = 256 << 20) -> int:
    """How many files of about ``target_bytes`` the inputs' bytes make (they are columnar
    as the copies are), at least one."""
    total = 0
    for p in inputs:
        fs, at = _file_system(spark, p)
        total += fs.getContentSummary(at).getLength()
    return max(1, -(-total // target_bytes))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder under the cluster's checkpoint directory for materialized tables."""
    from podium.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/podium/{name}"


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = shared_folder(spark, f"{name}/{uuid.uuid4().hex}")
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to a fresh folder under the shared checkpoint directory and
    read it back: one computation, lineage cut, and the result survives executor
    loss (unlike a cache or a local checkpoint). For intermediates that later steps
    read several times, such as the standings table. The folder goes when the application ends."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def input_fingerprint(spark: SparkSession, paths: Sequence[str], extra: str = "") -> str:
    """A short hash of all files below the inputs - names, sizes and modification times, whatever
    the depth - and of ``extra``, e.g. the source of the code that derives a table."""
    h = hashlib.sha1(extra.encode())
    for p in paths:
        fs, at = _file_system(spark, p)
        files, found = fs.listFiles(at, True), []
        while files.hasNext():
            st = files.next()
            found.append(f"{st.getPath().toString()}|{st.getLen()}|{st.getModificationTime()};")
        h.update("".join(sorted(found)).encode())
    return h.hexdigest()[:16]


def stored_table(spark: SparkSession, name: str, fingerprint: str, build) -> DataFrame:
    """A derived table stored once per input fingerprint in the shared folder.

    Rebuilt when the inputs or the deriving code change (the fingerprint), read
    back otherwise - a table maintained the way the reference keeps its
    DriverStanding table, instead of being recomputed by every query that needs it.
    ``build`` is called only when the table is missing. It is written under a name of its own
    and renamed when complete, so two jobs never write into one folder; the one that is
    second keeps the first one's table.
    """
    path = shared_folder(spark, f"stored/{name}/{fingerprint}")
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        draft = f"{path}-{uuid.uuid4().hex}"
        build().write.mode("errorifexists").parquet(draft)
        _, draft_at = _file_system(spark, draft)
        if fs.exists(at) or not fs.rename(draft_at, at):
            fs.delete(draft_at, True)
    return spark.read.parquet(path)
