"""Registered rule, overlay and upsert queries on the test tables.

Binding (SURVEY 7.2): a result is a lineitem (key ``ResultId`` = the struct
(orderkey, linenumber, partkey, suppkey, shipdate) - the first four repeat once at
sf0.001 - printed as ``orderkey:linenumber:partkey:suppkey:yyyyMMdd``), its race the order, its season the
order year, its position the line number, its driver the supplier, its car
number the part. Results shipped before ``CUT`` are the loaded base; later ones
arrive as a change batch in ``seq`` order (ship date, then the key). The year
gates are moved onto the years the data covers so that both sides of each gate
occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators import rules as R
from podium.operators import upsert as U
from podium.operators.counts import RuleCounts
from podium.operators.replay import create_replay, update_partial
from podium.operators.overlay import overlay_rows, update_columns
from podium.plans.publish_job import apply_and_publish
from podium.sources.sinks import ConstraintViolation, files_for, fresh_folder, materialize, path_exists
from podium.sources.snapshots import Snapshots
from podium.sources.tables import Tables, read_tables

CUT = "2000-01-01"
POSITION_GATE = 1998   # R1 / U1 / U2 (reference: 1962)
DRIVER_GATE = 1998     # R2 / U3 / U4 (reference: 1979)
NUMBER_GATE = 2001     # R4 / U7 / U8 (reference: 2014)
SEASON_CAP = 3         # R3 / U5 / U6 (reference: 25 races per season)


def results(t) -> DataFrame:
    return results_from_lines(t.lineitem)


def results_from_lines(li: DataFrame) -> DataFrame:
    """The result projection of lineitem rows (batch or streaming)."""
    return li.select(
        # the key is a struct: joins hash five fixed-width fields instead of a
        # formatted string; the text form is produced only for output rows
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("ResultId"),
        F.col("l_orderkey").alias("RaceId"),
        F.col("l_suppkey").alias("DriverId"),
        F.col("l_linenumber").alias("Position"),
        F.col("l_partkey").alias("ResultNumber"),
        F.col("l_linestatus").alias("LineStatus"),
        F.col("l_shipdate").alias("ShipDate"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
    )


def races(t) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("RaceId"),
                           F.year("o_orderdate").alias("RaceYear"),
                           F.col("o_custkey").alias("CustomerId"),
                           F.col("o_orderstatus").alias("Status"),
                           F.col("o_orderdate").alias("RaceDate"),
                           F.struct("o_orderdate", "o_orderkey").alias("seq"))


RESULT_COLS = ["ResultId", "RaceId", "DriverId", "Position", "ResultNumber"]


def result_id_text(key) -> F.Column:
    """``orderkey:linenumber:partkey:suppkey:yyyyMMdd`` of a ResultId struct."""
    k = F.col(key) if isinstance(key, str) else key
    return F.concat_ws(":", k["l_orderkey"], k["l_linenumber"], k["l_partkey"], k["l_suppkey"],
                       F.date_format(k["l_shipdate"], "yyyyMMdd"))


def _split(t):
    res = results(t)
    base = res.filter(F.col("ShipDate") < F.lit(CUT).cast("timestamp_ntz"))
    batch = res.filter(F.col("ShipDate") >= F.lit(CUT).cast("timestamp_ntz"))
    return base, batch


def _update_batch(t) -> DataFrame:
    """Open lines are re-submitted one place lower: a full-row update per result."""
    return (results(t).filter(F.col("LineStatus") == "O")
            .select("ResultId", "RaceId", "DriverId", (F.col("Position") + 1).alias("Position"),
                    "ResultNumber"))


def _held_once(t, *group: str) -> DataFrame:
    """Open lines whose group holds no other result, moved to a place nobody uses: updates no rule objects to."""
    rows = results(t)
    alone = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 1).select(*group)
    return (rows.filter(F.col("LineStatus") == "O").join(alone, list(group), "left_semi")
            .select("ResultId", "RaceId", "DriverId", (F.col("Position") + 100).alias("Position"), "ResultNumber"))


def _dirty_batch(t) -> DataFrame:
    """Open lines one place lower, with everything a caller can get wrong: unknown races, unknown
    results, a key given twice, and NULL positions and numbers (which are legal)."""
    key = F.col("ResultId")
    other = F.struct(key["l_orderkey"].alias("l_orderkey"), (key["l_linenumber"] + 1000).alias("l_linenumber"),
                     key["l_partkey"].alias("l_partkey"), key["l_suppkey"].alias("l_suppkey"),
                     key["l_shipdate"].alias("l_shipdate"))
    rows = results(t).filter(F.col("LineStatus") == "O").select(
        F.when(F.col("DriverId") % 41 == 0, other).otherwise(key).alias("ResultId"),
        F.when(F.col("DriverId") % 40 == 0, -F.col("RaceId")).otherwise(F.col("RaceId")).alias("RaceId"),
        "DriverId", F.nullif(F.col("Position") + 1, F.lit(7)).alias("Position"),
        F.when(F.col("ResultNumber") % 10 != 0, F.col("ResultNumber")).alias("ResultNumber"))
    return rows.unionByName(rows.filter(F.col("DriverId") % 43 == 0))


# -- R1-R4: audits of the whole state, and checks restricted to a batch --------------------

def r1_dup_position(spark: SparkSession, root: str) -> DataFrame:
    """R1 over the whole table (P5, P8, P9, G12), gated by season."""
    t = read_tables(spark, root)
    v = R.violations(R.position_rule(POSITION_GATE), results(t), races=races(t))
    return v.select("RaceId", "Position", F.col("Count").cast("long").alias("Count"), "Message")


def r1_touched(spark: SparkSession, root: str) -> DataFrame:
    """R1 as the trigger fires it: races touched by the arriving batch (J7), no gate."""
    t = read_tables(spark, root)
    _, batch = _split(t)
    v = R.violations(R.position_rule(None), results(t), batch, touch_mode="races", races=races(t))
    return v.select("RaceId", "Position", F.col("Count").cast("long").alias("Count"), "Message")


def r2_dup_driver(spark: SparkSession, root: str) -> DataFrame:
    """R2 over the whole table, gated by season."""
    t = read_tables(spark, root)
    v = R.violations(R.driver_rule(DRIVER_GATE), results(t), races=races(t))
    return v.select("RaceId", "DriverId", F.col("Count").cast("long").alias("Count"), "Message")


def r2_touched_groups(spark: SparkSession, root: str) -> DataFrame:
    """R2 with the reference's two independent IN lists (trap T16)."""
    t = read_tables(spark, root)
    _, batch = _split(t)
    v = R.violations(R.driver_rule(DRIVER_GATE), results(t), batch, touch_mode="touched_groups", races=races(t))
    return v.select("RaceId", "DriverId", F.col("Count").cast("long").alias("Count"), "Message")


def r3_season_cap(spark: SparkSession, root: str) -> DataFrame:
    """Season groups (customer, year) holding more than the cap."""
    t = read_tables(spark, root)
    rule = R.season_cap_rule(SEASON_CAP, group=("CustomerId", "RaceYear"))
    v = R.violations(rule, races(t))
    return v.select(F.col("CustomerId"), F.col("RaceYear").cast("long").alias("RaceYear"),
                    F.col("Count").cast("long").alias("Count"), "Message")


def r3_touched(spark: SparkSession, root: str) -> DataFrame:
    """R3 as the trigger fires it: only the season groups the arriving races touch."""
    t = read_tables(spark, root)
    r = races(t)
    arriving = r.filter(F.col("RaceDate") >= F.lit(CUT).cast("timestamp_ntz"))
    rule = R.season_cap_rule(SEASON_CAP, group=("CustomerId", "RaceYear"))
    v = R.violations(rule, r, arriving)
    return v.select(F.col("CustomerId"), F.col("RaceYear").cast("long").alias("RaceYear"),
                    F.col("Count").cast("long").alias("Count"), "Message")


def r4_number_owner(spark: SparkSession, root: str) -> DataFrame:
    """R4 (J11 as a grouped test): numbers held by several drivers in a season."""
    t = read_tables(spark, root)
    rows = R.with_season(results(t), races(t))
    v = R.violations(R.number_owner_rule(NUMBER_GATE), rows)
    return v.select(F.col("RaceYear").cast("long").alias("RaceYear"), "ResultNumber",
                    F.col("Drivers").cast("long").alias("Drivers"), "Message")


def r4_touched(spark: SparkSession, root: str) -> DataFrame:
    """R4 as the trigger fires it: only (season, number) pairs the batch touched."""
    t = read_tables(spark, root)
    _, batch = _split(t)
    rows = R.with_season(results(t), races(t))
    v = R.violations(R.number_owner_rule(NUMBER_GATE), rows, R.with_season(batch, races(t)))
    return v.select(F.col("RaceYear").cast("long").alias("RaceYear"), "ResultNumber",
                    F.col("Drivers").cast("long").alias("Drivers"), "Message")


# -- S8 / S9 overlays ------------------------------------------------------------------------

def s8_overlay(spark: SparkSession, root: str) -> DataFrame:
    """The state after the full-row update batch."""
    t = read_tables(spark, root)
    base = results(t).select(*RESULT_COLS)
    return overlay_rows(base, _update_batch(t), "ResultId").withColumn("ResultId", result_id_text("ResultId"))


def s9_partial_update(spark: SparkSession, root: str) -> DataFrame:
    """The same batch applied to the Position column only."""
    t = read_tables(spark, root)
    base = results(t).select(*RESULT_COLS)
    return (update_columns(base, _update_batch(t), "ResultId", ["Position"])
            .withColumn("ResultId", result_id_text("ResultId")))


def _stored_results(spark: SparkSession, root: str) -> tuple[Snapshots, DataFrame, Tables]:
    """The results in a store, clustered by their key (a file per 256 MB of lines, 16 at least); the lower and the
    upper bound of the middle tenth of their races, as scalars."""
    t = read_tables(spark, root)
    store = Snapshots(spark, fresh_folder(spark, "results"))
    n = max(16, files_for(spark, [f"{root.rstrip('/')}/lineitem.parquet"]))
    store.create({"Result": results(t).select(*RESULT_COLS)}, cluster={"Result": ["ResultId"]}, files=n)
    ends = t.orders.agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    low, high = F.col("low"), F.col("high")
    return store, ends.select((low + F.expr("(high - low) * 45 div 100")).alias("low"), (low + F.expr("(high - low) * 55 div 100")).alias("high")), t


def _middle(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """The rows of the middle tenth of the races."""
    return rows.filter(F.col("RaceId").between(ends.select("low").scalar(), ends.select("high").scalar()))


def s8_file_overlay(spark: SparkSession, root: str) -> DataFrame:
    """S8 on stored files: a full-row batch for the middle tenth of the races (and for results that do not
    exist); files without one of its keys are carried over."""
    store, ends, t = _stored_results(spark, root)
    batch = _middle(_update_batch(t), ends)
    key = F.col("ResultId")
    unknown = batch.withColumn("ResultId", F.struct(key["l_orderkey"].alias("l_orderkey"), (key["l_linenumber"] + 1000).alias("l_linenumber"),
                                                    key["l_partkey"].alias("l_partkey"), key["l_suppkey"].alias("l_suppkey"), key["l_shipdate"].alias("l_shipdate")))
    store.update("Result", batch.unionByName(unknown), "ResultId", cluster=["ResultId"])
    return store.read("Result").withColumn("ResultId", result_id_text("ResultId"))


def s9_file_update(spark: SparkSession, root: str) -> DataFrame:
    """S9 on stored files: the places of the middle tenth of the races, changed twice in one batch (the later change
    holds)."""
    store, ends, t = _stored_results(spark, root)
    batch = _middle(_update_batch(t), ends).select("ResultId", "Position")
    twice = batch.withColumn("seq", F.lit(1)).unionByName(batch.withColumn("Position", F.col("Position") + 10).withColumn("seq", F.lit(2)))
    store.update("Result", twice, "ResultId", columns=["Position"], seq="seq", cluster=["ResultId"])
    return store.read("Result").withColumn("ResultId", result_id_text("ResultId"))


# -- U1-U8 -----------------------------------------------------------------------------------

def _report(df: DataFrame, key: str = "ResultId") -> DataFrame:
    key_col = result_id_text(key).alias(key) if key == "ResultId" else F.col(key)
    return df.select(key_col, "Status", "Error")


def u1_create(spark: SparkSession, root: str) -> DataFrame:
    """Create the arriving results under the position rule."""
    t = read_tables(spark, root)
    base, batch = _split(t)
    return _report(U.create_unique(base, batch.select(*RESULT_COLS, "seq"), races(t),
                                   R.position_rule(POSITION_GATE)))


def u3_create(spark: SparkSession, root: str) -> DataFrame:
    """Create the arriving results under the driver rule."""
    t = read_tables(spark, root)
    base, batch = _split(t)
    return _report(U.create_unique(base, batch.select(*RESULT_COLS, "seq"), races(t),
                                   R.driver_rule(DRIVER_GATE)))


def u5_cap_create(spark: SparkSession, root: str) -> DataFrame:
    """Create the orders of the later period as races under the season cap."""
    t = read_tables(spark, root)
    r = races(t)
    cut = F.lit(CUT).cast("timestamp_ntz")
    base, batch = r.filter(F.col("RaceDate") < cut), r.filter(F.col("RaceDate") >= cut)
    rule = R.season_cap_rule(SEASON_CAP, group=("CustomerId", "RaceYear"))
    return _report(U.create_capped(base, batch, rule), key="RaceId")


def u7_create(spark: SparkSession, root: str) -> DataFrame:
    """Create the arriving results under the number rule."""
    t = read_tables(spark, root)
    base, batch = _split(t)
    return _report(U.create_owned(base, batch.select(*RESULT_COLS, "seq"), races(t),
                                  R.number_owner_rule(NUMBER_GATE)))


def _updated(t, batch: DataFrame, rule) -> DataFrame:
    return _report(U.update_results(results(t).select(*RESULT_COLS), batch, races(t), rule))


def u2_update(spark: SparkSession, root: str) -> DataFrame:
    """A dirty batch of full-row updates under the position rule, refused as a whole."""
    t = read_tables(spark, root)
    return _updated(t, _dirty_batch(t), R.position_rule(POSITION_GATE))


def u2_update_clean(spark: SparkSession, root: str) -> DataFrame:
    """A clean batch, accepted as a whole."""
    t = read_tables(spark, root)
    return _updated(t, _held_once(t, "RaceId", "Position"), R.position_rule(POSITION_GATE))


def u4_update(spark: SparkSession, root: str) -> DataFrame:
    """U4: the dirty batch under the driver rule."""
    t = read_tables(spark, root)
    return _updated(t, _dirty_batch(t), R.driver_rule(DRIVER_GATE))


def u4_update_clean(spark: SparkSession, root: str) -> DataFrame:
    """U4: updates of drivers with one result in the race, accepted as a whole."""
    t = read_tables(spark, root)
    return _updated(t, _held_once(t, "RaceId", "DriverId"), R.driver_rule(DRIVER_GATE))


def u8_update(spark: SparkSession, root: str) -> DataFrame:
    """U8: the dirty batch under the number rule."""
    t = read_tables(spark, root)
    return _updated(t, _dirty_batch(t), R.number_owner_rule(NUMBER_GATE))


def u8_update_clean(spark: SparkSession, root: str) -> DataFrame:
    """U8: results that change to a number nobody has, accepted as a whole."""
    t = read_tables(spark, root)
    batch = _held_once(t, "RaceId", "Position").withColumn(
        "ResultNumber", F.lit(10 ** 9) + F.col("RaceId") * 1000 + F.col("Position"))
    return _updated(t, batch, R.number_owner_rule(NUMBER_GATE))


def _season_moves(t, years: int) -> DataFrame:
    """Pending orders move ``years`` seasons on; some of them name a race that does not exist."""
    return races(t).filter(F.col("Status") == "P").select(
        F.when(F.col("CustomerId") % 20 == 0, -F.col("RaceId")).otherwise(F.col("RaceId")).alias("RaceId"),
        "CustomerId", (F.col("RaceYear") + years).alias("RaceYear"))


def u6_cap_move(spark: SparkSession, root: str) -> DataFrame:
    """Pending orders move to the next season, where some seasons are full; cap checked on
    moved races only, unknown races ignored."""
    t = read_tables(spark, root)
    base = races(t).select("RaceId", "CustomerId", "RaceYear")
    rule = R.season_cap_rule(SEASON_CAP, group=("CustomerId", "RaceYear"))
    return _report(U.update_races(base, _season_moves(t, 1), rule), key="RaceId")


def u6_cap_move_clean(spark: SparkSession, root: str) -> DataFrame:
    """The same moves into empty seasons far ahead, of as many as a season holds: accepted,
    and unknown races still ignored."""
    t = read_tables(spark, root)
    base = races(t).select("RaceId", "CustomerId", "RaceYear")
    moves = _season_moves(t, 50)
    small = (moves.groupBy("CustomerId", "RaceYear").agg(F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") <= SEASON_CAP).select("CustomerId", "RaceYear"))
    rule = R.season_cap_rule(SEASON_CAP, group=("CustomerId", "RaceYear"))
    return _report(U.update_races(base, moves.join(small, ["CustomerId", "RaceYear"], "left_semi"), rule), key="RaceId")


def u_key_checks(spark: SparkSession, root: str) -> DataFrame:
    """Key checks before the position rule: arriving results together with some that exist already,
    some that are given twice, and drivers that no longer exist."""
    t = read_tables(spark, root)
    base, batch = _split(t)
    rows = batch.select(*RESULT_COLS, "seq")
    again = base.filter(F.col("DriverId") % 9 == 0).select(*RESULT_COLS, "seq")
    twice = rows.filter(F.col("DriverId") % 7 == 0)
    drivers = t.supplier.filter(F.col("s_nationkey") % 5 != 0)
    return _report(U.create_unique(base, rows.unionByName(again).unionByName(twice), races(t), R.position_rule(POSITION_GATE),
                                   parents={"DriverId": (drivers, "s_suppkey")}))


def s8_last_change(spark: SparkSession, root: str) -> DataFrame:
    """S8 with several changes of a key in one batch: the last one holds."""
    t = read_tables(spark, root)
    one = _update_batch(t)
    changes = (one.withColumn("seq", F.lit(1))
               .unionByName(one.withColumn("Position", F.col("Position") + 2).withColumn("seq", F.lit(3)))
               .unionByName(one.withColumn("Position", F.col("Position") + 9).withColumn("seq", F.lit(2))))
    base = results(t).select(*RESULT_COLS)
    return overlay_rows(base, changes, "ResultId", seq="seq").withColumn("ResultId", result_id_text("ResultId"))


def s14_publish_clean(spark: SparkSession, root: str) -> DataFrame:
    """A clean change batch is published; the published snapshot is read back."""
    t = read_tables(spark, root)
    target = fresh_folder(spark, "s14_clean")
    apply_and_publish(results(t).select(*RESULT_COLS), _held_once(t, "RaceId", "Position"), races(t),
                      [R.position_rule(POSITION_GATE)], target)
    return spark.read.parquet(target).withColumn("ResultId", result_id_text("ResultId"))


def s14_publish_refused(spark: SparkSession, root: str) -> DataFrame:
    """A batch that breaks the position rule leaves nothing behind. The rows are the groups
    that the refused state would have held twice."""
    t = read_tables(spark, root)
    target = fresh_folder(spark, "s14_refused")
    base, batch = results(t).select(*RESULT_COLS), _update_batch(t)
    rule = R.position_rule(POSITION_GATE)
    refused = None
    try:
        apply_and_publish(base, batch, races(t), [rule], target)
    except ConstraintViolation as violation:
        refused = violation.name
    state = materialize(overlay_rows(base, batch, "ResultId"), "refused_state")  # the groups and the touched rows are read from it
    touched = state.join(batch.select("ResultId"), "ResultId", "left_semi")
    v = R.violations(rule, state, touched, races=races(t))
    return v.select("RaceId", "Position", F.col("Count").cast("long").alias("Count"), F.lit(refused).alias("Refused"),
                    F.lit(path_exists(spark, target)).alias("Published"))


def t15_combined_rules(spark: SparkSession, root: str) -> DataFrame:
    """Create the arriving results under R1, R2 and R4 together (set-wise, all or nothing)."""
    t = read_tables(spark, root)
    base, batch = _split(t)
    rules = [R.position_rule(POSITION_GATE), R.driver_rule(DRIVER_GATE), R.number_owner_rule(NUMBER_GATE)]
    return _report(U.create_with_rules(base.select(*RESULT_COLS), batch.select(*RESULT_COLS, "seq"),
                                       races(t), rules))


def x3_maintained_counts(spark: SparkSession, root: str) -> DataFrame:
    """R1, R2 and R4 after a load, an arriving batch and an update batch, from counts that the batches change: what
    the rules report for the groups that the update touches."""
    t = read_tables(spark, root)
    base, batch = _split(t)
    rules = [R.position_rule(POSITION_GATE), R.driver_rule(DRIVER_GATE), R.number_owner_rule(NUMBER_GATE)]
    counts = RuleCounts(Snapshots(spark, fresh_folder(spark, "rule_counts")), rules)
    counts.build(base.select(*RESULT_COLS), races(t))
    counts.apply(races(t), added={"results": batch.select(*RESULT_COLS)})
    new = _update_batch(t)
    old = results(t).filter(F.col("LineStatus") == "O").select(*RESULT_COLS)
    counts.apply(races(t), added={"results": new}, removed={"results": old})
    touched = materialize(R.with_season(new, races(t)).select("RaceId", "Position", "DriverId", "RaceYear", "ResultNumber"), "touched")
    out = []
    for name, one, two, n in (("R1", "RaceId", "Position", "Count"), ("R2", "RaceId", "DriverId", "Count"), ("R4", "RaceYear", "ResultNumber", "Drivers")):
        v = counts.violations(name, touched)
        out.append(v.select(F.lit(name).alias("Rule"), F.col(one).cast("long").alias("First"), F.col(two).cast("long").alias("Second"), F.col(n).cast("long").alias("Count")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def t15_combined_replay(spark: SparkSession, root: str) -> DataFrame:
    """T15 row by row: the arriving results under R1, R2 and R4, as if created one after the other."""
    t = read_tables(spark, root)
    base, batch = _split(t)
    rules = [R.position_rule(POSITION_GATE), R.driver_rule(DRIVER_GATE), R.number_owner_rule(NUMBER_GATE)]
    report, _ = create_replay(base.select(*RESULT_COLS), batch.select(*RESULT_COLS, "seq"), races(t), rules)
    return _report(report)


def _moves(t) -> DataFrame:
    """Open lines move within their race: one place down where the driver's number is even, to the place that mirrors
    theirs (a swap) where it is odd; some move before the first place, which is free, and some have no place."""
    place = F.col("Position")
    new = (F.when(F.col("DriverId") % 7 == 0, -place).when(F.col("DriverId") % 11 == 0, F.lit(None).cast("long"))
           .when(F.col("DriverId") % 2 == 0, place + 1).otherwise(8 - place))
    return results(t).filter(F.col("LineStatus") == "O").select("ResultId", "RaceId", "DriverId", new.alias("Position"), "ResultNumber", "seq")


def u2_update_partial(spark: SparkSession, root: str) -> DataFrame:
    """U2 accepting the moves that fit: chains, swaps and contested places."""
    t = read_tables(spark, root)
    return _report(update_partial(results(t).select(*RESULT_COLS), _moves(t), races(t), R.position_rule(POSITION_GATE), seq="seq")[0])


def u4_update_partial(spark: SparkSession, root: str) -> DataFrame:
    """U4 accepting the moves that fit: every open line goes to the driver with the next number, or back."""
    t = read_tables(spark, root)
    step = F.when(F.col("Position") % 2 == 1, 1).otherwise(-1)
    moves = results(t).filter(F.col("LineStatus") == "O").select(
        "ResultId", "RaceId", (F.col("DriverId") + step).alias("DriverId"), "Position", "ResultNumber", "seq")
    return _report(update_partial(results(t).select(*RESULT_COLS), moves, races(t), R.driver_rule(DRIVER_GATE), seq="seq")[0])


def t15_combined_rules_clean(spark: SparkSession, root: str) -> DataFrame:
    """One new result per race, by a new driver on a place nobody has and without a number."""
    t = read_tables(spark, root)
    base, batch = _split(t)
    first = batch.groupBy("RaceId").agg(F.min("seq").alias("seq"))
    rows = batch.join(first, ["RaceId", "seq"], "left_semi").select(
        "ResultId", "RaceId", (-F.col("DriverId")).alias("DriverId"), F.lit(1000).alias("Position"),
        F.lit(None).cast("long").alias("ResultNumber"), "seq")
    rules = [R.position_rule(POSITION_GATE), R.driver_rule(DRIVER_GATE), R.number_owner_rule(NUMBER_GATE)]
    return _report(U.create_with_rules(base.select(*RESULT_COLS), rows, races(t), rules))


QUERIES = {
    "t15_combined_rules": t15_combined_rules,
    "t15_combined_rules_clean": t15_combined_rules_clean,
    "u2_update_clean": u2_update_clean,
    "u4_update_clean": u4_update_clean,
    "u6_cap_move_clean": u6_cap_move_clean,
    "u8_update_clean": u8_update_clean,
    "u_key_checks": u_key_checks,
    "s8_last_change": s8_last_change,
    "t15_combined_replay": t15_combined_replay,
    "x3_maintained_counts": x3_maintained_counts,
    "u2_update_partial": u2_update_partial,
    "u4_update_partial": u4_update_partial,
    "s14_publish_clean": s14_publish_clean,
    "s14_publish_refused": s14_publish_refused,
    "r1_dup_position": r1_dup_position,
    "r1_touched": r1_touched,
    "r2_dup_driver": r2_dup_driver,
    "r2_touched_groups": r2_touched_groups,
    "r3_season_cap": r3_season_cap,
    "r3_touched": r3_touched,
    "r4_number_owner": r4_number_owner,
    "r4_touched": r4_touched,
    "s8_overlay": s8_overlay,
    "s9_partial_update": s9_partial_update,
    "s8_file_overlay": s8_file_overlay,
    "s9_file_update": s9_file_update,
    "u1_create": u1_create,
    "u2_update": u2_update,
    "u3_create": u3_create,
    "u4_update": u4_update,
    "u5_cap_create": u5_cap_create,
    "u6_cap_move": u6_cap_move,
    "u7_create": u7_create,
    "u8_update": u8_update,
}
