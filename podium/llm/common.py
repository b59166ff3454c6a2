"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.session import checkpoint_dir

REPO_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: later steps read the files, which survive the loss of an
    executor. The folder is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.parquet(path)


def prepare_workers(spark: SparkSession) -> None:
    """Settings for the Python workers of this package's jobs: batches of few rows, since a row
    is a whole text (a session that sets the size itself keeps it), and for local workers
    the package's place (a cluster ships it with ``--py-files`` or installs it)."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if spark.sparkContext.master.startswith("local"):
        spark.sparkContext.environment.setdefault("PYTHONPATH", REPO_ROOT)


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``: the label folds of the contracts."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")),
                  F.lit(folds))


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` rows (all, if there are fewer): those whose hash of ``key`` is under the share
    that ``n`` is of all rows, so the same rows whatever the partitioning, and no shuffle. ``df`` must hold
    distinct rows: a key that holds many would come whole. Only for fitting a model; ``n`` is a
    documented parameter of its caller."""
    rows = df.select(key).count()
    share = min(1.0, n / max(1, rows))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The doc_id, text and other columns of ``ids`` for the documents named there, one text an id (the smallest, where
    an id has several). ``ids`` must be a ``bounded_sample``: its bound is what makes the broadcast safe, and
    only texts named there are shuffled."""
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy(*ids.columns).agg(F.min("text").alias("text"))


def tokenizer_path(name_or_path: str) -> str:
    """A vocabulary file: a path is taken as it is, a bare name is looked up in the installed set."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name when the table already has such a column (names compare
    without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
