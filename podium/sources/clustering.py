"""One layout for filters on two columns (S11, S13): a space-filling curve over quantile ranks.

Files sorted by one column serve filters on it alone. Here the rows are laid along a Z curve: both columns are
replaced by their quantile rank (so skewed values spread evenly), the ranks' bits are interleaved,
and the files are ranges of the result. Each file then covers a small rectangle of the two columns, and a filter
on either one meets about the square root of the number of files.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CURVE = "_curve"


def along_curve(df: DataFrame, first: str, second: str, *, bits: int = 8) -> DataFrame:
    """``df`` with ``_curve``, the place of its two number columns on the curve (NULL counts as the least value).

    bits: 2**bits quantiles of each column, found in one pass (approximate quantiles, so the ranks' sizes vary by a
    fraction of a rank); 2**bits - 1 bounds a column reach the driver.
    """
    n = 1 << bits
    shares = [i / n for i in range(1, n)]
    bounds = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 20 * n).alias(c) for c in (first, second)]).first()
    out = df
    for name in (first, second):
        splits = sorted({-float("inf"), float("inf"), *(bounds[name] or [])})
        out = out.withColumn(f"_number_{name}", F.coalesce(F.col(name).cast("double"), F.lit(-1.7e308)))
        out = Bucketizer(splits=splits, inputCol=f"_number_{name}", outputCol=f"_rank_{name}").transform(out) if len(splits) > 2 else out.withColumn(f"_rank_{name}", F.lit(0))
    ranks = [F.col(f"_rank_{c}").cast("long") for c in (first, second)]
    curve = F.lit(0).cast("long")
    for i in range(bits):
        for k, rank in enumerate(ranks):
            curve = curve.bitwiseOR(F.shiftleft(F.shiftright(rank, i).bitwiseAND(F.lit(1)), 2 * i + k))
    return out.select(*df.columns, curve.alias(CURVE))
