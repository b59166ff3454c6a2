"""Stored tables with keyed updates of single files (S8, S9) and all-or-none commits.

Plain Parquet has neither UPDATE nor transactions. Here a set of tables is a folder of immutable Parquet files
and a pointer: ``versions/000000000007.json`` names the files that make up every table in version 7. A
writer puts new files aside, where no reader looks, and makes them visible by writing the next pointer under
a temporary name and renaming it; readers take the greatest number. So

- rows for several tables appear together or not at all, whatever is lost on the way (a lost job leaves files
  that no pointer names);
- a state can be checked before it is visible without being written twice;
- an update rewrites only the files that hold a key of its batch, and the others are carried over by name;
- older versions stay readable.

Which files hold a key is asked of the files themselves: ``_metadata.file_path`` of the rows whose keys are in the
batch. The scan reads only the key columns, and only of row groups that the batch's bounds (for a
short batch its very keys) let through by min/max and Bloom filter. On a table clustered by its key that is
a few row groups for a local batch, and one pass over the key column for one that is scattered.

Of two writers that start from one version the second fails (``VersionConflict``) and starts again from the new one.
The rename must refuse an existing target, as HDFS does; on an object store without such a
rename only one writer at a time is safe. A pointer's size follows the number of folders and replaced files,
not the number of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from podium.operators.hints import join_on_hot_key
from podium.operators.overlay import last_change, overlay_rows, update_columns
from podium.sources.sinks import ConstraintViolation, _file_system, materialize

#: batches of up to so many keys are named to the scan one by one, longer ones by their bounds; the rows found
#: are the same
LISTED = 200


class VersionConflict(Exception):
    """Another writer has made the version that this one was about to make."""


@dataclass(frozen=True)
class Update:
    """What an update did: the version it made (the old one, if no key was known), the files that it rewrote, and
    how many the table had."""

    version: int
    rewritten: list[str]
    files: int


Checks = Callable[[Mapping[str, DataFrame]], Mapping[str, DataFrame]]


class Snapshots:
    """A set of tables below ``root``, a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- reading ---------------------------------------------------------------------------

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        fs, at = _file_system(self.spark, f"{self.root}/versions")
        if not fs.exists(at):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _state(self, version: int) -> dict:
        if version == 0:
            return {}
        return json.loads(self.spark.read.text(self._pointer(version), wholetext=True).first()[0])

    def _pointer(self, version: int) -> str:
        return f"{self.root}/versions/{version:012d}.json"

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self._state(self.version() if version is None else version))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version (default: the newest)."""
        return self._frame(self._state(self.version() if version is None else version)[table])

    def read_near(self, table: str, version: int, near: Mapping[str, Sequence[tuple]]) -> DataFrame:
        """The files that may hold a row with a value in one of the given stretches (least, greatest) of one of the given
        columns, by the ranges in the pointer: no other file is opened, not even for its footer."""
        def meets(held: list, stretches: Sequence[tuple]) -> bool:
            return held[0] is not None and any(low <= held[1] and held[0] <= high for low, high in stretches)
        state = self._state(version)[table]
        names = [f"{self.root}/{part['folder']}/{name}" for part in state["parts"] for name, held in part["ranges"].items()
                 if any(meets(held[c], stretches) for c, stretches in near.items())]
        schema = StructType.fromJson(state["schema"])
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def files(self, table: str, version: int | None = None) -> list[str]:
        """The paths of a table's files."""
        state = self._state(self.version() if version is None else version)[table]
        return [f"{self.root}/{part['folder']}/{n}" for part in state["parts"] for n in self._names(part)]

    def _names(self, part: Mapping) -> list[str]:
        fs, at = _file_system(self.spark, f"{self.root}/{part['folder']}")
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(n for n in names if n.endswith(".parquet") and n not in part["gone"])

    def _frame(self, state: Mapping) -> DataFrame:
        paths = []
        for part in state["parts"]:
            folder = f"{self.root}/{part['folder']}"
            paths += [f"{folder}/{n}" for n in self._names(part)] if part["gone"] else [folder]
        schema = StructType.fromJson(state["schema"])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # -- writing ---------------------------------------------------------------------------

    def put_aside(self, table: str, df: DataFrame, *, cluster: Sequence[str] = (), files: int | None = None,
                  ranges: Sequence[str] = ()) -> dict:
        """Write rows where no reader looks; the part takes effect when a ``commit`` names it.

        cluster: range-partition (into ``files``) and sort by these columns, so that each file covers a narrow
        range of them and their filters skip files. ``files`` 0: as many as the rows' bytes ask for. ranges: columns (of whole numbers or strings) whose least and greatest
        value in each file the pointer keeps, for ``read_near``.
        """
        if cluster:
            n = [] if files == 0 else [files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))]
            df = df.repartitionByRange(*n, *cluster).sortWithinPartitions(*cluster)
        folder = f"{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        part = {"folder": folder, "gone": []}
        if ranges:
            held = self.spark.read.schema(_nullable(df.schema)).parquet(f"{self.root}/{folder}").groupBy(F.col("_metadata.file_name").alias("_file")).agg(
                F.count(F.lit(1)).alias("_rows"), *[f(c).alias(f"{f.__name__}_{c}") for c in ranges for f in (F.min, F.max)])
            part["ranges"] = {r["_file"]: {c: [r[f"min_{c}"], r[f"max_{c}"]] for c in ranges} for r in held.collect()}  # one row a file
        return part

    def part(self, table: str, part: Mapping, schema: StructType) -> DataFrame:
        """The rows of a part that ``put_aside`` has written."""
        return self._frame({"parts": [part], "schema": schema.jsonValue()})

    def commit(self, base: int, changed: Mapping[str, Mapping], checks: Checks | None = None) -> int:
        """Make ``changed`` (table -> its parts and schema) the next version after ``base``.

        checks: gets the tables as they would be, and gives named DataFrames that must be empty; the first one
        with rows raises ``ConstraintViolation``, and nothing becomes visible.
        """
        state = {**self._state(base), **changed}
        if checks is not None:
            for name, check in checks({t: self._frame(s) for t, s in state.items()}).items():
                rows = check.take(20)
                if rows:
                    raise ConstraintViolation(name, rows)
        fs, target = _file_system(self.spark, self._pointer(base + 1))
        _, draft = _file_system(self.spark, f"{self.root}/versions/draft-{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise VersionConflict(f"version {base + 1} of {self.root} exists")
        return base + 1

    def create(self, tables: Mapping[str, DataFrame], *, cluster: Mapping[str, Sequence[str]] | None = None,
               files: int | None = None) -> int:
        """The first version, or further tables."""
        base = self.version()
        changed = {t: {"schema": _nullable(df.schema).jsonValue(),
                       "parts": [self.put_aside(t, df, cluster=(cluster or {}).get(t, ()), files=files)]} for t, df in tables.items()}
        return self.commit(base, changed)

    def append(self, rows: Mapping[str, DataFrame], checks: Checks | None = None) -> int:
        """Add rows to several tables at once."""
        base = self.version()
        return self.commit_parts(base, {t: self.put_aside(t, df) for t, df in rows.items()}, checks)

    def commit_parts(self, base: int, parts: Mapping[str, Mapping], checks: Checks | None = None) -> int:
        """Make parts that lie aside visible, all of them together."""
        state = self._state(base)
        return self.commit(base, {t: {**state[t], "parts": [*state[t]["parts"], part]} for t, part in parts.items()}, checks)

    def update(self, table: str, changes: DataFrame, key: str | Sequence[str], *, columns: Sequence[str] | None = None,
               seq: str | None = None, cluster: Sequence[str] = (), checks: Checks | None = None) -> Update:
        """S8 (all columns) or S9 (only ``columns``): ``UPDATE table SET ... WHERE key = ...`` by a batch.

        Only the files that hold one of the batch's keys are read whole and written anew. Of several changes of a key the
        last by ``seq`` holds; keys that the table does not hold, and NULL keys, change nothing. A batch
        that changes no row makes no version. cluster: how the new files are laid out (as the table is).
        """
        keys = [key] if isinstance(key, str) else list(key)
        base = self.version()
        state = self._state(base)[table]
        wanted = changes if columns is None else changes.select(*keys, *columns, *([seq] if seq else []))
        last = materialize(last_change(wanted, keys, seq), "update_batch")
        held = self._holding(self._frame(state), last.select(*keys), keys)
        total = sum(len(self._names(p)) for p in state["parts"])
        if not held:
            return Update(base, [], total)
        rows = self.spark.read.schema(StructType.fromJson(state["schema"])).parquet(*[f"{self.root}/{f}" for f in held])
        new = overlay_rows(rows, last, keys) if columns is None else update_columns(rows, last, keys, columns)
        fresh = self.put_aside(table, new, cluster=cluster, files=len(held))
        parts = []
        for part in state["parts"]:
            gone = sorted({*part["gone"], *[f.rsplit("/", 1)[1] for f in held if f.rsplit("/", 1)[0] == part["folder"]]})
            left = {"folder": part["folder"], "gone": gone}
            if not gone or self._names(left):
                parts.append(left)
        version = self.commit(base, {table: {**state, "parts": [*parts, fresh]}}, checks)
        return Update(version, held, total)

    def _holding(self, rows: DataFrame, wanted: DataFrame, keys: list[str]) -> list[str]:
        """The files (folder/name) that hold one of the wanted keys: one row a file reaches the driver."""
        leaves = [leaf for k in keys for leaf in _leaves(F.col(k), rows.schema[k].dataType)]
        names = [f"_leaf{i}" for i in range(len(leaves))]
        listed = wanted.select(*[c.alias(n) for c, n in zip(leaves, names)]).limit(LISTED + 1).collect()
        if len(listed) <= LISTED:
            near = [leaf.isin(sorted({r[n] for r in listed if r[n] is not None})) for leaf, n in zip(leaves, names)]
        else:
            bounds = wanted.agg(*[f(c).alias(f"{f.__name__}{n}") for c, n in zip(leaves, names) for f in (F.min, F.max)]).first()
            near = [leaf.between(F.lit(bounds[f"min{n}"]), F.lit(bounds[f"max{n}"])) for leaf, n in zip(leaves, names)]
        found = rows.select(*keys, F.col("_metadata.file_path").alias("_file"))
        for condition in near:
            found = found.filter(condition)
        files = join_on_hot_key(found, wanted.distinct(), keys, "left_semi").select("_file").distinct().collect()
        return sorted("/".join(r[0].rsplit("/", 3)[1:]) for r in files)


def _leaves(column: Column, kind) -> list[Column]:
    """The simple columns that a key column is made of."""
    if isinstance(kind, StructType):
        return [leaf for f in kind.fields for leaf in _leaves(column[f.name], f.dataType)]
    return [column]


def _nullable(schema: StructType) -> StructType:
    """Files written by Spark hold nullable columns; so does the stored schema."""
    out = StructType()
    for f in schema.fields:
        out.add(f.name, f.dataType, True)
    return out
