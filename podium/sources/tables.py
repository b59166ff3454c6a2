"""Base table scans (S1) and the racing model's explicit schemas (section 1.2 of SURVEY)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TEST_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)


@dataclass(frozen=True)
class Tables:
    """Lazily read parquet tables of one scale-factor folder.

    Each attribute is a plain ``spark.read.parquet`` scan: Catalyst prunes columns
    and pushes filters into it, so reading a table here costs nothing until used.
    The scan object is created once per table (one footer read for the schema),
    however often a query refers to it.
    """

    spark: SparkSession
    root: str
    _scans: dict = field(default_factory=dict, compare=False, repr=False)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("spark", "root"):
            raise AttributeError(name)
        if name not in self._scans:
            self._scans[name] = self.spark.read.parquet(f"{self.root.rstrip('/')}/{name}.parquet")
        return self._scans[name]

    def register_views(self, names=TEST_TABLES) -> None:
        """Expose the tables to ``spark.sql`` under their own names."""
        for name in names:
            getattr(self, name).createOrReplaceTempView(name)


def read_tables(spark: SparkSession, root: str) -> Tables:
    return Tables(spark, root)


# Schemas of the racing tables (types per SURVEY section 1.3). Lap times are kept as
# microseconds in a long; decimals follow the printed scales.
RESULT_SCHEMA = T.StructType([
    T.StructField("ResultId", T.IntegerType(), False),
    T.StructField("RaceId", T.IntegerType(), False),
    T.StructField("DriverId", T.IntegerType(), False),
    T.StructField("ConstructorId", T.IntegerType()),
    T.StructField("ResultNumber", T.IntegerType()),
    T.StructField("Grid", T.IntegerType()),
    T.StructField("Position", T.IntegerType()),
    T.StructField("PositionText", T.StringType()),
    T.StructField("PositionOrder", T.IntegerType()),
    T.StructField("Points", T.DecimalType(18, 4)),
    T.StructField("Laps", T.IntegerType()),
    T.StructField("Time", T.StringType()),
    T.StructField("Milliseconds", T.IntegerType()),
    T.StructField("FastestLap", T.IntegerType()),
    T.StructField("Rank", T.IntegerType()),
    T.StructField("FastestLapTime", T.LongType()),
    T.StructField("FastestLapSpeed", T.DecimalType(18, 4)),
    T.StructField("ResultStatusId", T.IntegerType()),
])

RACE_SCHEMA = T.StructType([
    T.StructField("RaceId", T.IntegerType(), False),
    T.StructField("RaceYear", T.IntegerType(), False),
    T.StructField("NrOfRound", T.IntegerType(), False),
    T.StructField("CircuitId", T.IntegerType(), False),
    T.StructField("RaceName", T.StringType(), False),
    T.StructField("RaceDate", T.DateType(), False),
    T.StructField("RaceStartTime", T.LongType()),
    T.StructField("RaceUrl", T.StringType()),
    T.StructField("Practice1Date", T.DateType()),
    T.StructField("Practice1Time", T.LongType()),
    T.StructField("Practice2Date", T.DateType()),
    T.StructField("Practice2Time", T.LongType()),
    T.StructField("Practice3Date", T.DateType()),
    T.StructField("Practice3Time", T.LongType()),
    T.StructField("QualificationDate", T.DateType()),
    T.StructField("QualificationTime", T.LongType()),
    T.StructField("SprintRaceDate", T.DateType()),
    T.StructField("SprintRaceTime", T.LongType()),
])

DRIVER_SCHEMA = T.StructType([
    T.StructField("DriverId", T.IntegerType(), False),
    T.StructField("DriverRef", T.StringType()),
    T.StructField("DriverNumber", T.IntegerType()),
    T.StructField("Firstname", T.StringType()),
    T.StructField("Lastname", T.StringType()),
    T.StructField("Nationality", T.StringType()),
])

CONSTRUCTOR_SCHEMA = T.StructType([
    T.StructField("ConstructorId", T.IntegerType(), False),
    T.StructField("ConstructorRef", T.StringType()),
    T.StructField("ContstructorName", T.StringType()),
    T.StructField("Nationality", T.StringType()),
    T.StructField("ConstructorUrl", T.StringType()),
])

CIRCUIT_SCHEMA = T.StructType([
    T.StructField("CircuitId", T.IntegerType(), False),
    T.StructField("CircuitRef", T.StringType()),
    T.StructField("CircuitName", T.StringType()),
    T.StructField("CircuitLocation", T.StringType()),
    T.StructField("Country", T.StringType()),
])

SEASON_SCHEMA = T.StructType([
    T.StructField("RaceYear", T.IntegerType(), False),
    T.StructField("SeasonUrl", T.StringType()),
])

STANDING_SCHEMA = T.StructType([
    T.StructField("RaceId", T.IntegerType(), False),
    T.StructField("DriverId", T.IntegerType(), False),
    T.StructField("Position", T.IntegerType()),
    T.StructField("Points", T.DecimalType(20, 10)),
])
