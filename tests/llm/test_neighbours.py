import numpy as np
import pyarrow as pa

from lumenlake.llm.neighbours import face_neighbours, nearest, perturbations, similar_pairs


def _frame(spark, ids, x):
    dim = x.shape[1]
    column = pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).reshape(-1)), dim).cast(pa.list_(pa.float32()))
    return spark.createDataFrame(pa.table({"id": pa.array(ids), "embedding": column, "bucket": pa.array(np.zeros(len(x), dtype=np.int32))}))


def _people(n, per, dim=128, noise=0.045, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // per, dim))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return (np.repeat(centres, per, axis=0) + rng.standard_normal((n // per * per, dim)) * noise) * rng.choice([0.5, 1, 8], (n // per * per, 1))


def _true(ids, x, k, least, queries=None):
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    out = set()
    for i in range(len(u)) if queries is None else queries:
        s = np.round(u @ u[i], 12)
        s[i] = -2
        out |= {(int(ids[i]), int(ids[j])) for j in np.lexsort((ids, -s))[:k] if s[j] >= least}
    return out


def test_recall_on_people(spark):
    x = _people(6000, 12)
    ids = np.random.default_rng(1).permutation(len(x)).astype(np.int64)
    got = {(r.id, r.neighbour) for r in nearest(_frame(spark, ids, x), "id", "embedding", 128, 5, 0.7, bucket=200).collect()}
    want = _true(ids, x, 5, 0.7)
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9


def test_hot_person_is_split(spark):
    x = np.concatenate([_people(1500, 10, seed=2), _people(900, 900, seed=3)])
    ids = np.arange(len(x), dtype=np.int64)
    asked = list(range(1500, 2400, 9))
    for bucket in (60, 8):  # shared out by queries; in blocks
        got = {(r.id, r.neighbour) for r in nearest(_frame(spark, ids, x), "id", "embedding", 128, 5, 0.7, bucket=bucket).collect()}
        want = _true(ids, x, 5, 0.7, asked)
        recall = len(got & want) / len(want)
        precise = sum(1 for a, b in got if a in set(asked) and (a, b) in want) / max(1, sum(1 for a, b in got if a in set(asked)))
        assert recall >= 0.9 and precise >= 0.9


def test_vast_bucket_is_searched_whole(spark):
    x = np.concatenate([_people(300, 10, seed=7), _people(1500, 1500, noise=0.002, seed=8)])
    ids = np.random.default_rng(3).permutation(len(x)).astype(np.int64)
    asked = list(range(300, 1800, 30))
    df = _frame(spark, ids, x)
    got = {(r.id, r.neighbour) for r in nearest(df, "id", "embedding", 128, 5, 0.7, bucket=8, queries=df.id.isin([int(ids[i]) for i in asked])).collect()}
    want = _true(ids, x, 5, 0.7, asked)
    print(f"recall in a vast bucket {len(got & want) / len(want)}")
    assert len(got & want) / len(want) >= 0.9


def test_dense_group_is_ranked_by_full_vectors(spark):
    for dim, noise in ((64, 0.009), (64, 0.0031), (128, 0.00001)):  # all but the first far within the error of the codes
        x = np.concatenate([_people(600, 12, dim, seed=5), _people(3000, 3000, dim, noise, seed=6)])
        ids = np.random.default_rng(2).permutation(len(x)).astype(np.int64)
        asked = list(range(600, 3600, 60))
        df = _frame(spark, ids, x)
        got = {(r.id, r.neighbour) for r in nearest(df, "id", "embedding", dim, 5, 0.99, width=4.0, queries=df.id.isin([int(ids[i]) for i in asked])).collect()}
        want = _true(ids, x, 5, 0.99, asked)
        assert len(got & want) / len(want) >= 0.9 and len(got) == len(want)


def test_ten_copies_of_each_vector(spark):
    x = np.repeat(np.concatenate([_people(600, 12, seed=11), _people(300, 300, noise=0.003, seed=12)]), 10, axis=0)
    ids = np.random.default_rng(4).permutation(len(x)).astype(np.int64)
    asked = list(range(0, len(x), 70))
    df = _frame(spark, ids, x)
    want = _true(ids, x, 5, 0.7, asked)
    for keep in (None, 0):  # by codes and classes; on full vectors
        got = {(r.id, r.neighbour) for r in nearest(df, "id", "embedding", 128, 5, 0.7, bucket=300, queries=df.id.isin([int(ids[i]) for i in asked]), keep=keep).collect()}
        assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9


def test_tight_cluster_needs_no_lucky_cut(spark):
    """Cosines of 0.9966 to 0.999, all within the error of the codes."""
    for n in (1000, 3000):
        x = _people(n, n, 64, 0.005, seed=13)
        ids = np.random.default_rng(5).permutation(n).astype(np.int64)
        asked = list(range(0, n, 20))
        df = _frame(spark, ids, x)
        got = {(r.id, r.neighbour) for r in nearest(df, "id", "embedding", 64, 5, 0.9, width=4.0, queries=df.id.isin([int(ids[i]) for i in asked])).collect()}
        want = _true(ids, x, 5, 0.9, asked)
        assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9


def test_copies_ties_and_bad_vectors(spark):
    v = [float(k % 7 - 3) for k in range(128)]
    bad = [None, [], v[:127], [0.0] * 128, [float("nan"), *v[1:]], [float("inf"), *v[1:]], [None, *v[1:]]]
    rows = [(k, [2.0 * a for a in v] if k % 2 else v, 1) for k in range(1, 10)] + [(100 + k, b, 1) for k, b in enumerate(bad)] + [(None, v, 1), (3, v, 1)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, id_a int")
    got = face_neighbours(df)
    assert {(r.id, r.neighbour, r.place) for r in got.filter("id = 4").collect()} == {(4, 1, 1), (4, 2, 2), (4, 3, 3), (4, 5, 4), (4, 6, 5)}
    assert got.select("id").distinct().count() == 9 and abs(got.agg({"similarity": "min"}).first()[0] - 1) < 1e-9
    pairs = {(r.id_a, r.id_b) for r in similar_pairs(got, "id").collect()}
    assert (1, 2) in pairs and all(a < b for a, b in pairs)
    assert face_neighbours(df.limit(0)).count() == 0


def test_query_has_no_threshold(spark, tmp_path):
    from lumenlake.llm.queries import p6_neighbours

    rng = np.random.default_rng(9)
    tables = {"photo": ("photos", "visual_features", rng.random((4000, 64))), "face": ("faces", "embedding", rng.standard_normal((4000, 128)))}
    ids = np.arange(4000, dtype=np.int64)
    for name, column, x in tables.values():
        _frame(spark, ids, x).withColumnRenamed("embedding", column).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = p6_neighbours(spark, str(tmp_path)).collect()
    for kind, (_, _, x) in tables.items():
        got, want = {(r.id, r.neighbour) for r in rows if r.kind == kind}, _true(ids, x, 5, -1, range(0, 4000, 50))
        assert len(got) == len(want) == 400 and len(got & want) / len(want) >= 0.9


def test_photos_have_a_second_table(spark, monkeypatch):
    from lumenlake.llm import neighbours

    monkeypatch.setattr(neighbours, "nearest", lambda *a, **x: x)
    assert neighbours.photo_neighbours(None)["tables"] >= 2


def test_queries_only(spark):
    x = _people(400, 8, seed=4)
    ids = np.arange(len(x), dtype=np.int64)
    df = _frame(spark, ids, x)
    got = {(r.id, r.neighbour) for r in nearest(df, "id", "embedding", 128, 5, 0.7, queries=df.id % 50 == 0).collect()}
    assert {a for a, _ in got} == set(range(0, 400, 50)) and got == _true(ids, x, 5, 0.7, range(0, 400, 50))


def test_perturbations_start_at_the_nearest_borders():
    sets = perturbations(6, 8)
    assert sets[0] == (0,) and len(set(sets)) == 8
    assert all(11 - a not in s for s in sets for a in s)
