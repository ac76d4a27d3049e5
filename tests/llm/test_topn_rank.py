import random

from lumenlake.llm.rank_merge import median_rank
from lumenlake.llm.topn import top_n_per_group

NAN = float("nan")


def test_top_n_ties_versions_and_nulls(spark):
    rows = [
        (1, 10, 0.5, 1), (1, 10, 0.9, 2), (1, 11, 0.9, 3), (1, 12, 0.7, 4), (1, 12, None, 5), (1, 13, NAN, 6), (1, 14, 0.1, 7), (2, 10, 0.0, 8), (2, 9, -0.0, 9), (None, 1, 1.0, 10), (2, None, 1.0, 11), (3, 1, None, 12),
    ]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "g long, i long, s double, v long, position int, _rank int")
    got = sorted(tuple(r)[:2] + (r.position,) for r in top_n_per_group(df, "g", "s", "i", 2, version="v").collect())
    assert got == [(1, 10, 1), (1, 11, 2), (2, 9, 1), (2, 10, 2)]
    assert top_n_per_group(df.limit(0), "g", "s", "i", 2).count() == 0
    assert top_n_per_group(df, "g", "s", "i", 0).count() == 0


def test_top_n_hot_group_against_sort(spark):
    rng = random.Random(2)
    rows = [(1 if k % 3 == 0 else rng.randint(2, 400), k, float(rng.randint(0, 20))) for k in range(6000)]
    df = spark.createDataFrame(rows, "g long, i long, s double")
    got = {(r.g, r.i) for r in top_n_per_group(df, "g", "s", "i", 7, partitions=13).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        want |= {(g, r[1]) for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:7]}
    assert got == want


def _plain(rows, weights):
    out = {}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        value = lambda x: float("-inf") if x is None or x != x else x
        ranks = {r[1]: [1 + sum(value(q[2 + k]) > value(r[2 + k]) for q in mine) for k in range(len(weights))] for r in mine}
        def median(rs):
            return min(r for r in rs if sum(w for x, w in zip(rs, weights, strict=True) if x <= r) >= sum(weights) / 2)
        order = sorted(ranks, key=lambda i: (median(ranks[i]), sum(x * w for x, w in zip(ranks[i], weights, strict=True)) / sum(weights), i))
        out |= {(g, i): (tuple(ranks[i]), k) for k, i in enumerate(order, 1)}
    return out


def test_median_rank_against_plain(spark):
    rng = random.Random(3)
    rows = [("hot" if k % 3 == 0 else rng.choice("ab"), k, *[rng.choice([None, NAN, 0.0, 1.0, 5.0, float(rng.randint(0, 99))]) for _ in range(3)]) for k in range(400)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g string, i long, a double, b double, c double, rank int")
    for weights in ([1.0, 1.0, 1.0], [3.0, 1.0, 1.0], [1.0, 2.0, 1.0]):
        got = {(r.g, r.i): (tuple(r.ranks), r.position) for r in median_rank(df, "g", "i", ["a", "b", "c"], weights, partitions=7).collect()}
        assert got == _plain(rows, weights)


def test_scale_does_not_matter_and_edges(spark):
    df = spark.createDataFrame([("f", 1, 1e9, 0.1), ("f", 2, 2e9, 0.2), ("f", 3, 3e9, 0.3), (None, 4, 1.0, 1.0), ("f", None, 1.0, 1.0)], "g string, i long, a double, b double")
    assert [r.i for r in median_rank(df, "g", "i", ["a", "b"]).orderBy("position").collect()] == [3, 2, 1]
    assert median_rank(df.limit(0), "g", "i", ["a", "b"]).count() == 0
    doubled = median_rank(df.unionByName(df), "g", "i", ["a", "b"])
    assert doubled.count() == 3 and doubled.filter("i = 3").first().ranks == [1, 1]
