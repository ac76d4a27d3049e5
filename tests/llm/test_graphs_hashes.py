import random
import re

import numpy as np

from lumenlake.llm import near_duplicates as N
from lumenlake.llm.components import connected_components


def _groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def _components(spark, pairs):
    df = spark.createDataFrame([(*p, "x", 1) for p in pairs], "a long, b long, vertex string, component int")
    return {r.vertex: r.component for r in connected_components(df, "a", "b").collect()}


def test_components_shapes(spark):
    rng = random.Random(7)
    chain = list(range(60))
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:], strict=False)) + [(1000, k) for k in range(1001, 1200)] + [(2000, 2001), (2001, 2000), (2000, 2001), (5, None), (None, 5), (77777, 77777)]
    assert _components(spark, pairs) == _groups(pairs)


def test_components_random_and_empty(spark):
    rng = random.Random(8)
    pairs = [(rng.randint(0, 900), rng.randint(0, 900)) for _ in range(500)]
    assert _components(spark, pairs) == _groups(pairs)
    assert _components(spark, []) == {} and _components(spark, [(1, 1)]) == {}


def test_components_keep_kinds_apart(spark):
    df = spark.createDataFrame([("f", 1, 2), ("p", 2, 3), ("p", 3, 9), (None, 3, 4)], "kind string, a long, b long")
    got = {(r.kind, r.vertex): r.component for r in connected_components(df, "a", "b", ["kind"]).collect()}
    assert got == {("f", 1): 1, ("f", 2): 1, ("p", 2): 2, ("p", 3): 2, ("p", 9): 2}


def test_sketch_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for bits in (64, 256):
        for _ in range(50):
            a, b = (rng.choice(500, rng.integers(1, 90), replace=False) for _ in "ab")
            both = N.parity_sketch(np.concatenate([a, b]), np.array([0, len(a)]), bits)
            assert both.shape == (2, bits // 64)
            assert np.bitwise_count(both[0] ^ both[1]).sum() <= len(np.setxor1d(a, b))
            assert np.bitwise_count(both[0]).sum() % 2 == len(a) % 2


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def _edited(rng, words):
    """A text with a few words put in, left out or replaced, or with its parts in another order."""
    words, way = list(words), rng.random()
    if way < 0.3:
        at = rng.randint(1, len(words) - 1)
        return words[at:] + words[:at]
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(words))
        words[at : at + rng.randint(0, 1)] = [rng.choice("abcdefgh") * rng.randint(1, 9)] * rng.randint(0, 1)
    return words


def test_text_groups_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts = []
    for n in (1, 3, 5, 8, 20, 45, 80, 200, 320):
        for _ in range(6):
            base = [rng.choice(vocabulary) for _ in range(n)]
            texts += [" ".join(base)] + [" ".join(_edited(rng, base)) if n > 2 else " ".join(base) for _ in range(rng.randint(0, 4))]
    texts += [None, "", " \n ", "?!", "Same, text of five words", "same text OF five words!", "x " * 3000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = spark.createDataFrame([(i, texts[k], "", 0) for i, k in enumerate(order)], "doc_id long, text string, band string, rep int")
    shingle = {}
    for i, k in enumerate(order):
        words = [w for w in re.split(r"[\W_]+", (texts[k] or "").lower()) if w]
        if words:
            shingle[i] = frozenset(tuple(words[a : a + 5]) for a in range(max(1, len(words) - 4)))
    pairs = {(a, b) for a in shingle for b in shingle if a < b and _jaccard(shingle[a], shingle[b]) >= 0.8}
    different = {(a, b) for a, b in pairs if shingle[a] != shingle[b]}
    assert len(different) > 60
    rows = {r.doc_id: r for r in N.text_groups(df).collect()}
    assert set(rows) == set(shingle)
    linked = _groups(pairs)
    for i, r in rows.items():
        assert r.group_id == linked.get(i, i) and r.class_id == min(k for k in shingle if shingle[k] == shingle[i])
        assert r.links == len({shingle[k] for k in shingle if (min(i, k), max(i, k)) in different})
    split = df.select("doc_id", N.words_of(df.text).alias("words")).cache()
    for least, crowded in ((0.5, 20_000), (0.8, 3)):
        found, members = N.set_pairs(split, "doc_id", N.shingles(split.words), least, crowded=crowded)
        reps = {r.id: r.rep for r in members.collect()}
        want = {(min(reps[a], reps[b]), max(reps[a], reps[b])) for a in shingle for b in shingle if a < b and shingle[a] != shingle[b] and _jaccard(shingle[a], shingle[b]) >= least}
        got = [(r.rep_a, r.rep_b) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_sets_with_nulls_repeats_and_nothing(spark):
    rows = [(1, [1, 2, 3, None]), (2, [3, 2, 1, 1]), (3, None), (4, []), (5, [None]), (None, [1, 2, 3]), (6, [9])]
    df = spark.createDataFrame(rows, "id long, tokens array<long>")
    pairs, members = N.set_pairs(df, "id", df.tokens)
    assert pairs.count() == 0 and {(r.id, r.rep) for r in members.collect()} == {(1, 1), (2, 1), (6, 6)}
    pairs, members = N.set_pairs(df.limit(0), "id", df.tokens)
    assert pairs.count() == 0 and members.count() == 0


def _brute(p, d, ids, mp=7, md=12):
    out = set()
    for i in range(len(p)):
        near = np.flatnonzero((np.bitwise_count(p[i] ^ p) <= mp) & (np.bitwise_count(d[i] ^ d) <= md))
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in near if j != i}
    return out


def _near_hashes(n, seed, fixed=0):
    """Hashes in families of small edits; ``fixed`` low bits are the same in all."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n // 4, dtype=np.uint64)
    p = np.repeat(base, 4)
    for k in range(len(p)):
        for b in rng.choice(64, rng.integers(0, 8), replace=False):
            p[k] ^= np.uint64(1) << np.uint64(b)
    if fixed:
        p &= ~np.uint64((1 << fixed) - 1)
    return p


def _photos(spark, rows):
    return spark.createDataFrame([(*r, 0, "") for r in rows], "id long, perceptual_hash string, difference_hash string, rep int, bucket string")


def test_photo_pairs_against_brute_force(spark):
    p, d = _near_hashes(400, 2), _near_hashes(400, 3)
    d = np.where(np.arange(400) % 2 == 0, d, d[0])
    ids = np.random.default_rng(4).permutation(400)
    rows = [(int(i), f" {int(a):016X}", f"{int(b):016x} ") for i, a, b in zip(ids, p, d, strict=True)]
    rows += [(1000, rows[0][1], rows[0][2]), (1001, "0" * 16, "0" * 16), (1002, None, rows[0][2]), (1003, "xyz", ""), (1004, "0" * 16, "0" * 16), (1005, "12345", rows[1][2])]
    got = {(r.photo_id_a, r.photo_id_b) for r in N.photo_pairs(_photos(spark, rows)).collect()}
    want = _brute(np.append(p, p[0]), np.append(d, d[0]), np.append(ids, 1000))
    assert got == want and len(want) > 50
    groups = {r.photo_id: r.group_id for r in N.photo_groups(_photos(spark, rows)).collect()}
    linked = _groups(want)
    assert groups == {int(i): linked.get(int(i), int(i)) for i in [*ids, 1000]}


def test_crowded_buckets_lose_nothing(spark, monkeypatch):
    p, d = _near_hashes(600, 5, fixed=30), np.zeros(600, dtype=np.uint64)
    ids = np.arange(600)
    rows = [(int(i), f"{int(a):016x}", f"{int(i) % 5 + 1:016x}") for i, a in zip(ids, p, strict=True)]
    d = np.array([int(i) % 5 + 1 for i in ids], dtype=np.uint64)
    keep = [k for k in range(600) if len(set(rows[k][1])) > 1]
    want = _brute(p[keep], d[keep], ids[keep])
    df = _photos(spark, rows)
    pairs, members = N.hash_pairs(df, "id", N.hash_bits(df.perceptual_hash), N.hash_bits(df.difference_hash), crowded=5)
    reps = {}
    for r in members.collect():
        reps.setdefault(r.rep, []).append(r.id)
    got = {(min(a, b), max(a, b)) for r in pairs.collect() for a in reps[r.rep_a] for b in reps[r.rep_b]}
    got |= {(min(a, b), max(a, b)) for m in reps.values() for a in m for b in m if a != b}
    assert got == want


def test_crowded_bucket_index_against_direct():
    p = _near_hashes(800, 6, fixed=16)
    sketch = p.copy()
    rows = {"sketch": sketch, "fold": np.zeros(800, dtype=np.uint32), "rep": np.arange(800), "left": np.ones(800, dtype=bool), "home": np.ones(800, dtype=bool)}
    found = set()
    for b in range(4):
        for half in (0, 1):
            block = N._block(sketch, b)
            value = block & 0xFF if half == 0 else block >> 8
            for v in np.unique(value):
                mine = {k: x[value == v] for k, x in rows.items()}
                pairs = [(int(x), int(y)) for a, c in N._compare(mine, b, half, 7, 12, chunk=1000) for x, y in zip(a, c, strict=True)]
                assert not found & set(pairs)
                found |= set(pairs)
    assert found == _brute(sketch, np.zeros(800, dtype=np.uint64), rows["rep"])


def test_empty_photos(spark):
    assert N.photo_pairs(_photos(spark, [])).count() == 0
    assert N.photo_groups(_photos(spark, [(1, None, None)])).count() == 0


def test_components_with_hot_vertices(spark, monkeypatch):
    from lumenlake.operators import joins

    monkeypatch.setattr(joins, "HOT_LEAST", 20)
    rng = random.Random(12)
    pairs = [(rng.choice([0, 1]), k) for k in range(2, 300)] + [(0, 299)] + [(1000 + k, 1000 + rng.randint(0, k)) for k in range(1, 100)]
    assert _components(spark, pairs) == _groups(pairs)


def test_copies_are_spelled_out_in_pages(spark, monkeypatch):
    from lumenlake.operators import joins

    monkeypatch.setattr(N, "_PAGE", 7)
    monkeypatch.setattr(joins, "HOT_LEAST", 20)
    rows = [(i, "0123456789abcdef", "fedcba9876543210") for i in range(60)] + [(100 + i, "0123456789abcdee", "fedcba9876543211") for i in range(9)] + [(200, "0" * 15 + "1", "1" * 15 + "2")]
    got = [(r.photo_id_a, r.photo_id_b) for r in N.photo_pairs(_photos(spark, rows)).collect()]
    ids = [*range(60), *range(100, 109)]
    assert sorted(got) == [(a, b) for a in ids for b in ids if a < b]


def test_sizes_at_the_border_of_a_band_meet(spark):
    """Hashes with 23 to 31 one bits, across the border of bands at 24."""
    full = (1 << 23) - 1
    rows = [(k, f"{full | ((1 << k) - 1) << 23:016x}", "0123456789abcdef") for k in range(9)]
    got = {(r.photo_id_a, r.photo_id_b) for r in N.photo_pairs(_photos(spark, rows)).collect()}
    assert got == {(a, b) for a in range(9) for b in range(a + 1, 9) if b - a <= 7}
