"""T-S1: the change-feed validator across micro-batches, and its idempotence."""

import os
import tempfile

from podium.operators import rules as R
from podium.streaming.validate import Claims, read_reports, validate_feed
from tests.helpers import RESULT_DDL, empty_results, races

FEED_DDL = RESULT_DDL + ", seq int"


def test_feed_sees_earlier_batches_and_is_idempotent(spark):
    src = tempfile.mkdtemp(prefix="podium-feed-")
    out = tempfile.mkdtemp(prefix="podium-out-")
    # two files -> two micro-batches (one file per trigger)
    spark.createDataFrame([(1, 900000, 7, 1, None, 1), (2, 900000, 8, 2, None, 2)], FEED_DDL) \
        .coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([(3, 900000, 9, 1, None, 3), (4, 900000, 9, 3, None, 4)], FEED_DDL) \
        .coalesce(1).write.mode("append").parquet(src)
    race = races(spark, [(900000, 2030)])

    def run():
        feed = spark.readStream.schema(FEED_DDL).option("maxFilesPerTrigger", 1).parquet(src)
        q = validate_feed(spark, feed, base=empty_results(spark), races=race, rule=R.position_rule(),
                          out_dir=out, checkpoint=f"{out}/_checkpoint")
        q.awaitTermination()
        return {r["ResultId"]: (r["Status"], r["batch_id"]) for r in read_reports(spark, out).collect()}

    first = run()
    assert {k: v[0] for k, v in first.items()} == {1: "accepted", 2: "accepted", 3: "rejected", 4: "accepted"}
    assert first[3][1] != first[1][1]          # the conflict came in a later batch
    assert run() == first                      # restart with the same checkpoint: nothing new, same output


def _deliver(spark, batches, rule=None, race_year=2030, out=None):
    """Each list of rows as a micro-batch of its own; the folder of the outcome."""
    src, out = tempfile.mkdtemp(prefix="podium-feed-"), out or tempfile.mkdtemp(prefix="podium-out-")
    race = races(spark, [(i, race_year) for i in range(1, 200)])
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, FEED_DDL).coalesce(1).write.mode("append").parquet(src)
        feed = spark.readStream.schema(FEED_DDL).parquet(src)
        validate_feed(spark, feed, base=empty_results(spark), races=race, rule=rule or R.position_rule(),
                      out_dir=out, checkpoint=f"{out}/_checkpoint").awaitTermination()
    return out


def _status(spark, out):
    return {(r.ResultId, r.batch_id): (r.Status, r.Error) for r in read_reports(spark, out).collect()}


def test_batches_without_an_accepted_row(spark):
    """A first batch that is refused as a whole (its race does not exist), an empty one, and good ones after them."""
    bad, good, clash = [(1, 777, 1, 1, None, 1)], [(2, 5, 1, 1, None, 2)], [(3, 5, 2, 1, None, 3), (2, 9, 2, 7, None, 4)]
    got = _status(spark, _deliver(spark, [bad, [], good, clash]))
    by_id = {}
    for (i, _), v in got.items():
        by_id.setdefault(i, []).append(v[0])
    assert by_id[1] == ["rejected"] and by_id[3] == ["rejected"]
    assert sorted(by_id[2]) == ["accepted", "rejected"]  # its key was taken in another race


def test_a_replayed_batch_writes_the_same(spark):
    """The claims as they were before the last batch: replaying it gives the same report and claims."""
    out = _deliver(spark, [[(1, 5, 1, 1, None, 1)], [(2, 5, 2, 2, None, 2), (3, 5, 3, 1, None, 3)]])
    claims = Claims(spark, f"{out}/claims", None)
    last = claims.store.version()
    assert claims.before(1) == last - 1 and claims.before(2) == last and claims.before(0) == 1
    rows = sorted(map(str, claims.store.read("Claims").collect()))
    claims.add(last - 1, 1, claims.store.read("Claims").filter("ResultId = 2"))  # the batch again
    assert claims.store.version() == last and sorted(map(str, claims.store.read("Claims").collect())) == rows


def test_a_batch_opens_only_claims_near_its_own(spark, monkeypatch):
    """A feed that moves on from race to race: the bytes of claims that a batch opens do not grow with the feed."""
    opened = []
    real = Claims.near

    def near(self, version, wanted):
        df = real(self, version, wanted)
        opened.append(sum(os.path.getsize(f.replace("file:", "").replace("//", "/")) for f in df.inputFiles()))
        return df
    monkeypatch.setattr(Claims, "near", near)
    batches = [[(100 * b + i, 1 + 2 * b + i % 3, i, i, None, 100 * b + i) for i in range(30)] for b in range(12)]
    out = _deliver(spark, batches)
    assert len(opened) == 12 and opened[0] == 0 and opened[1] > 0  # neighbouring batches share a race
    assert max(opened[2:]) < 4 * opened[1] and opened[-1] <= max(opened[1:5]) * 4
    accepted = [k for k, v in _status(spark, out).items() if v[0] == "accepted"]
    assert len(accepted) == Claims(spark, f"{out}/claims", None).store.read("Claims").count()
    parts = Claims(spark, f"{out}/claims", None).store._state(13)["Claims"]["parts"]
    assert len(parts) == 1 + 12 - 8  # eight batches merged


def test_owner_rule_across_batches(spark):
    """A number belongs to who claimed it in an earlier batch, whatever race that was in."""
    out = _deliver(spark, [[(1, 5, 1, 1, 44, 1)], [(2, 9, 2, 1, 44, 2), (3, 9, 1, 2, 44, 3)]], rule=R.number_owner_rule())
    assert {k[0]: v[0] for k, v in _status(spark, out).items()} == {1: "accepted", 2: "rejected", 3: "accepted"}
