import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenlake.operators.ordering import global_positions, global_segments

_few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@_few
@given(st.lists(st.tuples(st.sampled_from([None, "a", "b", "hot"]), st.one_of(st.none(), st.integers(0, 4).map(float)), st.integers(0, 99)), max_size=60), st.integers(1, 7))
def test_positions_and_ranks_match_a_plain_sort(spark, rows, partitions):
    df = spark.createDataFrame(rows, "g string, v double, i long")
    got = global_positions(df, ["g"], [F.col("v").desc_nulls_last(), F.col("i")], ["v"], partitions=partitions).collect()
    want = []
    for g in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == g], key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want += [(*r, k + 1, next(j for j, q in enumerate(mine) if q[1] == r[1]) + 1) for k, r in enumerate(mine)]
    plain = lambda xs: sorted(map(repr, ((g, None if v is None else float(v), i, p, r) for g, v, i, p, r in xs)))
    assert plain(tuple(r) for r in got) == plain(want)


def test_one_group_over_many_partitions(spark):
    df = spark.range(20000).select(F.lit(1).alias("g"), (F.col("id") % 7).cast("double").alias("v"), "id")
    got = global_positions(df, ["g"], [F.desc("v"), F.col("id")], ["v"], partitions=16)
    assert got.agg(F.count_distinct("position"), F.max("position")).first()[:] == (20000, 20000)
    assert got.filter("v = 5").agg(F.min("rank"), F.max("rank")).first()[:] == (2858, 2858)
    assert got.rdd.getNumPartitions() > 4


def test_limit_and_empty(spark):
    df = spark.createDataFrame([], "g int, v double, i long")
    assert global_positions(df, ["g"], [F.col("v")], [], limit=3).count() == 0
    assert global_segments(df, [F.col("i")], ["i"], lambda a, b: a["i"] != b["i"]).count() == 0


def test_segments_cross_partitions(spark):
    rng = random.Random(4)
    at, t = [], 0
    for _ in range(3000):
        t += rng.choice([1, 1, 1, 50])
        at.append((t,))
    df = spark.createDataFrame(at, "t long")
    got = {r.t: r.segment for r in global_segments(df, [F.col("t")], ["t"], lambda a, b: b["t"] - a["t"] > 10, partitions=9).collect()}
    n, last = 0, None
    for (x,) in at:
        n += last is None or x - last > 10
        last = x
        assert got[x] == n
