"""Streams: reports of all batches, and clusters that live across runs."""

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from townhall.streaming import clusters as C
from townhall.streaming import health as H
from townhall.streaming import ingest as G

T0 = dt.datetime(2024, 1, 1)


def test_progress_of_many_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(150):
        pq.write_table(pa.table({"v": list(range(i % 3))}, pa.schema([("v", pa.int64())])), tmp_path / "in" / f"{i:03}.parquet")
    stream = G.metered(G.file_stream(spark, str(tmp_path / "in"), "v long"), "health", F.col("v") == 1)
    start = lambda: stream.writeStream.format("noop").queryName("many").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    progress = H.recorded(spark, f"file://{tmp_path}/progress", start)
    assert progress.filter("query = 'many'").count() == 150 == progress.select("batch").distinct().count()
    assert G.batch_metrics(progress, "health").agg(F.count("*"), F.sum("n_items"), F.sum("n_errors")).first()[:] == (150, 150, 50)
    assert G.batch_metrics(progress, "other").count() == 0
    assert H.ProgressTable(spark, f"file://{tmp_path}/none").rows().count() == 0


def fits(a, b):
    return bool(a[2] & b[2] or len(a[4] & b[4]) >= 2 or (a[3] & b[3] and a[4] & b[4]))


def by_force(slices, days=7, hours=72):
    """The same steps one item after the other."""
    live, of, over, latest = {}, {}, {}, None
    near = lambda x, y: abs(x[1] - y[1]) < dt.timedelta(hours=hours)
    for rows in slices:
        new = {r[0]: (r[0], r[1], set(r[2]), set(r[3]), set(r[4])) for r in rows if r[1] is not None and r[0] not in live}
        latest = max([r[1] for r in new.values()] + ([latest] if latest else []), default=None)
        if latest is None:
            continue
        since = latest - dt.timedelta(days=days)
        for i in [i for i in live if live[i][1] <= since]:
            over[i] = of.pop(i, over.get(i))
            del live[i]
        over |= {i: over.get(i) for i, r in new.items() if r[1] <= since}
        new = {i: r for i, r in new.items() if r[1] > since}
        members = {c: [live[i] for i in live if of.get(i) == c] for c in set(of.values())}
        joined = {}
        for i, r in new.items():
            tried = [c for c in sorted(members) if fits(r, (0, 0, *(set().union(*(m[k] for m in members[c])) for k in (2, 3, 4)))) and any(near(r, m) for m in members[c])]
            same = [c for c in tried[:3] if (i + c) % 3]
            joined |= {i: same[0]} if same else {}
        live |= new
        pool = sorted((live[i][1], i) for i in live if i not in of and i not in joined)
        began = {}
        for _, i in pool:
            began[i] = min((began[x] for x in began if (i + x) % 3 and fits(live[i], live[x]) and near(live[i], live[x])), default=i)
        of |= joined | {i: c for i, c in began.items() if list(began.values()).count(c) > 1}
    return over | {i: of.get(i) for i in live}


def confirm(pairs):
    return pairs.filter("(item_a + item_b) % 3 <> 0").select("item_a", "item_b")


def judge(new, members):
    asked = new.select("item_id").crossJoin(members.select("cluster_id").distinct())  # small tables of a test
    return asked.withColumn("same", (F.col("item_id") + F.col("cluster_id")) % 3 != 0)


@pytest.fixture
def slices():
    rng = random.Random(4)
    make = lambda i, h: (i, T0 + dt.timedelta(hours=h), rng.sample("pqrstuv", rng.randrange(2)), rng.sample("de", rng.randrange(2)), rng.sample("uvwxyzabc", rng.randrange(4)))
    out = [[make(100 * s + k, 72 * s + rng.randrange(80)) for k in range(16)] for s in range(5)]
    out[2] += [out[1][0], out[1][1], out[2][0]]  # sent again, while they live
    out[3].append((390, T0, ["p"], [], ["u", "v"]))  # eight days late
    out[3].append((391, None, ["p"], [], []))
    return out


def land(spark, rows, path):
    spark.createDataFrame(rows, C.STATE.replace(", cluster_id long", "")).coalesce(1).write.mode("append").parquet(path)


def test_clusters_live_on(spark, tmp_path, slices):
    """Runs that begin anew from the checkpoint, one of which fails on the way, come to what one run by force comes to."""
    source, state = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    failing = [True]

    def once(pairs):
        if failing:
            failing.pop()
            raise RuntimeError("a lost driver")
        return confirm(pairs)

    schema = C.STATE.replace(", cluster_id long", "")
    run = lambda confirmed: C.cluster_stream(G.file_stream(spark, source, schema), C.ClusterState(spark, state), judge, confirmed, f"{tmp_path}/checkpoint").awaitTermination()
    for k, rows in enumerate(slices):
        land(spark, rows, source)
        if k == 2:
            with pytest.raises(Exception, match="a lost driver"):
                run(once)
        if k != 3:  # the fourth waits for the fifth: two batches in one run
            run(confirm)
    got = C.ClusterState(spark, state)
    result = {r["item_id"]: r["cluster_id"] for r in got.clusters().collect()}
    assert result == by_force(slices)
    assert got.ended().count() > 20 and len({c for c in result.values() if c is not None}) > 5
    assert len(got.versions()) <= 2 and 391 not in result and result[390] is None


def test_no_clusters_of_nothing(spark, tmp_path):
    state = C.ClusterState(spark, f"file://{tmp_path}/state")
    state.advance(spark.createDataFrame([], C.STATE), 0, judge, confirm)
    assert state.clusters().count() == 0 == state.ended().count()


def test_slices_have_a_number_of_files(spark, tmp_path):
    """A slice has as many files as asked for, whatever partitions its rows are in; without a number one for each."""
    rows = spark.range(600).selectExpr("id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int), 0) as at").repartition(24)
    for files, most in ((4, 3 * 4), (None, 3 * 24)):
        path = tmp_path / str(files)
        G.land_slices(rows, "at", str(path), 3, files)
        there = [p for p in path.glob("part-*.parquet") if spark.read.parquet(str(p)).count()]
        assert (most == 12 and len(there) <= 12) or len(there) > 12
        assert spark.read.parquet(str(path)).count() == 600
