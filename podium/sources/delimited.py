"""Delimited result files: a strict reader (S2) and the reference's tolerant load (S3).

The tolerant load splits each line on the separator, drops blank lines, takes
fields by position (NULL when the line is short, F15) and converts numbers with
``try_cast`` (bad value -> NULL, F7). Lines that lose information on the way are
returned as rejects with a reason instead of disappearing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.functions import nth_part

# Fields of the sprint-results file, in file order (its header line); types per the
# reference's staging table.
RACE_RESULT_FIELDS: list[tuple[str, str]] = [
    ("RaceNr", "int"), ("Circuit", "string"), ("POS", "int"), ("NO", "int"), ("Driver", "string"),
    ("Car", "string"), ("Laps", "int"), ("TimeRetired", "string"), ("Points", "int"),
]


def schema_of(fields: Sequence[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])


def read_delimited(spark: SparkSession, path: str, fields: Sequence[tuple[str, str]] = RACE_RESULT_FIELDS,
                   sep: str = ";", header: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """``spark.read.csv`` with an explicit schema (no inference pass over the data)."""
    return (spark.read.schema(schema_of(fields))
            .option("sep", sep).option("header", header).option("mode", mode)
            .option("enforceSchema", True).csv(path))


def literal_lines(spark: SparkSession, text: str) -> DataFrame:
    """S4 + F14 + F18: a pasted literal (``DECLARE @csv = N'...'``) as one row per line,
    ``STRING_SPLIT(@csv, CHAR(10))`` as ``explode(split(text, '\\n'))``. For fixtures;
    files go through ``spark.read.text``."""
    return (spark.createDataFrame([(text,)], "text string")
            .select(F.explode(F.split("text", "\n")).alias("line")))


def tolerant_load(spark: SparkSession, path: str, fields: Sequence[tuple[str, str]] = RACE_RESULT_FIELDS,
                  sep: str = ";", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """S3: ``tolerant_parse`` over the lines of the files at ``path``."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return tolerant_parse(lines, fields, sep=sep, header=header)


def tolerant_parse(lines: DataFrame, fields: Sequence[tuple[str, str]] = RACE_RESULT_FIELDS,
                   sep: str = ";", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """S3: returns ``(staged, rejects)`` from a DataFrame of text ``line`` rows.

    staged: one typed row per non-blank line (the reference's INSERT ... SELECT
    TRY_CAST(SplitPart(...))). A header line is recognised by its first field
    equal to the first field name. rejects: ``line``, ``reason`` for lines with
    a short field list or a number that did not convert.
    """
    lines = lines.filter(F.trim("line") != "")  # F13
    if header:
        lines = lines.filter(F.lower(F.trim(nth_part("line", sep, 1))) != fields[0][0].lower())
    raw = lines.select("line", *[nth_part("line", sep, i + 1).alias(f"_raw{i}") for i in range(len(fields))])
    typed = []
    for i, (name, dtype) in enumerate(fields):
        col = F.col(f"_raw{i}")
        typed.append((col if dtype == "string" else col.try_cast(dtype)).alias(name))
    staged = raw.select(*typed)
    problems = [F.when(F.col(f"_raw{len(fields) - 1}").isNull(), F.lit("missing fields"))]
    for i, (name, dtype) in enumerate(fields):
        if dtype != "string":
            raw_c = F.col(f"_raw{i}")
            problems.append(F.when(raw_c.isNotNull() & (F.trim(raw_c) != "") & raw_c.try_cast(dtype).isNull(),
                                   F.lit(f"{name} is not {dtype}")))
    rejects = (raw.select("line", F.concat_ws("; ", *problems).alias("reason"))
               .filter(F.col("reason") != ""))
    return staged, rejects
