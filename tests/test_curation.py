import random
from datetime import datetime, timedelta

import numpy as np

from lumenlake.config import Settings
from lumenlake.operators import curation as C
from lumenlake.operators import trips as R
from lumenlake.operators.density import face_clusters, place_clusters

_SCHEMA = (
    "id long, relative_path string, active boolean, analysis_status string, capture_at timestamp_ntz, capture_source string, latitude double, longitude double, place_city string, perceptual_hash string, file_hash string,"
    " quality_score double, manual_rating int, sharpness_score double, exposure_score double, color_score double, face_count int, width int, height int, key string, rank int"
)
_T0 = datetime(2024, 1, 1, 10)


def _photo(i, at=_T0, **x):
    d = {"relative_path": f"trip/photo-{i:03d}.jpg", "active": True, "analysis_status": "done", "capture_source": "exif", "quality_score": 0.7, "face_count": 0, "width": 3000, "height": 2000, "perceptual_hash": f"{i:016x}", "key": "x", "rank": 0}
    d |= {"id": i, "capture_at": at} | x
    return tuple(d.get(c.split()[0]) for c in _SCHEMA.split(", "))


def _photos(spark, rows):
    return C.eligible(spark.createDataFrame(rows, _SCHEMA.replace(",", ", ").replace("  ", " ")))


def test_events_and_bursts(spark):
    rows = [_photo(k, _T0 + timedelta(seconds=10 * k)) for k in range(5)] + [_photo(9, _T0 + timedelta(hours=12)), _photo(10, None)]
    df = _photos(spark, rows)
    sizes = sorted(r["count"] for r in C.split_events(df).groupBy("event").count().collect())
    assert sizes == [1, 5] and {r["size"] for r in C.split_bursts(df).collect()} == {5}
    edge = _photos(spark, [_photo(k, _T0 + timedelta(seconds=45 * k)) for k in range(3)] + [_photo(7, _T0 + timedelta(seconds=136))])
    assert {r.id for r in C.split_bursts(edge).collect()} == {0, 1, 2}


def test_events_split_over_midnight_and_by_distance(spark):
    night = [_photo(1, datetime(2024, 1, 1, 22)), _photo(2, datetime(2024, 1, 2, 1, 29)), _photo(3, datetime(2024, 1, 2, 5, 0))]
    assert C.split_events(_photos(spark, night)).agg({"event": "max"}).first()[0] == 1
    night[2] = _photo(3, datetime(2024, 1, 2, 9, 30))
    assert C.split_events(_photos(spark, night)).agg({"event": "max"}).first()[0] == 2
    jump = [_photo(1, _T0, latitude=43.0, longitude=-8.0), _photo(2, _T0 + timedelta(hours=2), latitude=48.0, longitude=2.0), _photo(3, _T0 + timedelta(hours=2, minutes=30), latitude=43.0, longitude=-8.0)]
    assert C.split_events(_photos(spark, jump)).agg({"event": "max"}).first()[0] == 2


def test_collections_rank_score_and_cover(spark):
    rows = [_photo(k, _T0 + timedelta(minutes=k), quality_score=q) for k, q in ((1, 0.9), (2, 0.9), (3, 0.1), (4, None))]
    collections, links = C.collections_of(C.event_members(_photos(spark, rows)))
    c = collections.first()
    assert (c.key, c.cover_photo_id, c.photos) == ("event:1", 2, 4) and abs(c.score - (0.8 * (0.9 + 0.9 + 0.1 + 0.35) / 4 + 4 / 150)) < 1e-9
    assert [r.photo_id for r in links.orderBy("rank").collect()] == [2, 1, 4, 3]


def test_folder_album(spark):
    rows = [_photo(k, relative_path=f"summer-trip/{k}.jpg") for k in range(5)] + [_photo(10 + k, relative_path=f"a/DCIM/{k}.jpg") for k in range(6)] + [_photo(30, relative_path="root.jpg")]
    assert {r.title for r in C.folder_members(_photos(spark, rows)).collect()} == {"Summer Trip"}


def test_together_becomes_a_visit(spark):
    photos = _photos(spark, [_photo(k, _T0 + timedelta(days=k)) for k in (1, 2, 3)])
    faces = spark.createDataFrame([(p, c) for c in (11, 22) for p in (1, 2, 3)] + [(1, 11), (9, 11), (1, None)], "photo_id long, cluster_id long")
    got = {(r.key, r.kind) for r in C.together_members(photos, faces).collect()}
    assert got == {("together:11:22", "visitor")}
    assert {r.kind for r in C.people_members(photos, faces).collect()} == {"visitor"}


def test_near_duplicates_across_years(spark):
    a, b = "00000000000000ff", "00000000000000fe"
    df = _photos(spark, [_photo(1, perceptual_hash=a), _photo(2, _T0 + timedelta(days=900), perceptual_hash=b), _photo(3, perceptual_hash="ffffffff00000000"), _photo(4, perceptual_hash=None), _photo(5, perceptual_hash="nohash")])
    assert {(r.photo_id, r.group_id) for r in C.near_duplicate_groups(df).collect()} == {(1, 1), (2, 1)}
    same = _photos(spark, [_photo(1, perceptual_hash=a, file_hash="h"), _photo(2, perceptual_hash=a, file_hash="h")])
    assert C.near_duplicate_edges(same).count() == 0
    assert [(r.copies, r.group_number) for r in C.exact_duplicates(same).collect()] == [(2, 1), (2, 1)]


def _travel(i, day, place, **x):
    return _photo(i, _T0 + timedelta(days=day), latitude=place[0], longitude=place[1], **x)


_HOME, _AWAY = (43.36, -8.41), (48.86, 2.35)


def _life(away_days=range(27, 32), per_day=8, back=True, away=_AWAY):
    rows = [_travel(k, 4 * k, _HOME) for k in range(7)]
    rows += [_travel(100 + 10 * d + k, d, away, place_city="Lutece") for d in away_days for k in range(per_day)]
    if back:
        rows += [_travel(5000 + k, max(away_days) + 1 + 4 * k, _HOME) for k in range(7)]
    return rows


def test_a_trip_and_no_trips(spark):
    got = R.trip_members(_photos(spark, _life())).collect()
    assert len(got) == 40 and {r.title for r in got} == {"Trip to Lutece — Jan 28 – Feb 1, 2024"} and {r.key for r in got} == {"trip:370"}
    assert R.trip_members(_photos(spark, _life(back=False))).count() == 0
    assert R.trip_members(_photos(spark, _life(away_days=range(27, 67)))).count() == 0
    assert R.trip_members(_photos(spark, _life(per_day=2))).count() == 0
    guessed = [r[:5] + ("mtime",) + r[6:] for r in _life()]
    assert R.trip_members(_photos(spark, guessed)).count() == 0
    assert R.trip_members(_photos(spark, [])).count() == 0


def test_location_day_takes_the_dense_cell(spark):
    rows = [_travel(k, 0, _HOME) for k in range(3)] + [_travel(10 + k, 0, (60.0 + k, 20.0)) for k in range(4)] + [_travel(30, 0, (float("nan"), 1.0)), _travel(31, 0, (91.0, 1.0))]
    d = R.location_days(_photos(spark, rows), 30.0).collect()
    assert [(r.latitude, r.longitude) for r in d] == [_HOME]


def test_highlights_day_cap_similarity_and_hashes(spark):
    far = lambda k: f"{(0x9E3779B97F4A7C15 * (k + 1)) % 2**64:016x}"
    rows = [_photo(k, _T0 + timedelta(minutes=15 * k), quality_score=0.9 - k / 1000, perceptual_hash=far(k)) for k in range(30)]
    rows += [_photo(100 + k, _T0 + timedelta(days=2, minutes=20 * k), quality_score=0.5, perceptual_hash=far(100 + k)) for k in range(8)]
    df = _photos(spark, rows)
    picked = [p["id"] for p in C.diverse_highlights(df, 50, chunk=7)]
    assert picked == [0, 1, 2, 3, 4, 107, 106, 105, 104, 103]
    twins = _photos(spark, [_photo(1, perceptual_hash="ff"), _photo(2, _T0 + timedelta(minutes=5), perceptual_hash="fe"), _photo(3, _T0 + timedelta(hours=1), perceptual_hash="fe"), _photo(4, None, perceptual_hash="fe", file_hash="h"), _photo(5, None, file_hash="h")])
    assert [p["id"] for p in C.diverse_highlights(twins, 9)] == [5, 3, 2]


def test_highlights_against_plain_greedy(spark):
    rng = random.Random(3)
    rows = [_photo(k, None if rng.random() < 0.1 else _T0 + timedelta(minutes=rng.randint(0, 9000)), quality_score=rng.randint(0, 20) / 20, perceptual_hash=f"{rng.randint(0, 40):016x}", file_hash=rng.choice([None, "", "a", "b", str(k)])) for k in range(300)]
    plain, hashes, days = [], set(), {}
    for r in sorted(rows, key=lambda r: (r[11], r[0]), reverse=True):
        i, at, h, f = r[0], r[4], int(r[9], 16), r[10]
        day = at.date() if at else None
        if (f and f in hashes) or days.get(day, 0) >= 5 or any(at and b and (h ^ g).bit_count() <= 5 and abs((at - b).total_seconds()) <= 600 for _, b, g in plain[-40:]):
            continue
        plain.append((i, at, h))
        hashes |= {f} if f else set()
        days[day] = days.get(day, 0) + 1
    assert [p["id"] for p in C.diverse_highlights(_photos(spark, rows), 1000, chunk=25)] == [p[0] for p in plain]


def test_place_clusters(spark):
    rows = [_travel(k, 0, (10.0, 179.99 if k % 2 else -179.99)) for k in range(6)] + [_travel(20 + k, 0, (89.9, 60.0 * k - 150)) for k in range(6)] + [_travel(40 + k, 0, (k * 5.0, 5.0)) for k in range(4)] + [_travel(60, 0, (10.0, -179.8))]
    got = {}
    for r in place_clusters(_photos(spark, rows)).collect():
        got.setdefault(r.cluster_id, set()).add(r.id)
    assert got == {0: {0, 1, 2, 3, 4, 5, 60}, 20: set(range(20, 26))}
    assert place_clusters(_photos(spark, [])).count() == 0


def test_crowded_place_with_many_positions(spark):
    rng = random.Random(9)
    rows = [_travel(k, 0, (48.0 + rng.gauss(0, 0.05), 2.0 + rng.gauss(0, 0.05))) for k in range(1500)] + [_travel(5000 + k, 0, (-20.0 + 0.4 * k, 30.0)) for k in range(9)]
    got = {r.cluster_id: r["count"] for r in place_clusters(_photos(spark, rows)).groupBy("cluster_id").count().collect()}
    assert got == {0: 1500}


def test_face_clusters(spark):
    rng = np.random.default_rng(4)
    people = rng.standard_normal((3, 128))
    rows = [(int(10 * p + k), k, [float(v) for v in people[p] + rng.standard_normal(128) * 0.2]) for p in range(3) for k in range(5 if p < 2 else 2)] + [(99, 1, None), (98, 1, [0.0] * 128), (97, 1, [1.0])]
    got = {r.face_id: r.cluster_id for r in face_clusters(spark.createDataFrame(rows, "id long, photo_id long, embedding array<float>"), block=4).collect()}
    assert got == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(10, 15), 10)}


def test_near_duplicates_meet_as_numbers(spark, monkeypatch):
    """All pairs up to seven bits apart, first bit set or not; the probes carry numbers, not text."""
    rng, tables = random.Random(3), {}
    monkeypatch.setattr(C, "materialize", lambda df, label, keep=C.materialize: tables.setdefault(label, keep(df, label)))
    hashes = [rng.getrandbits(64) for _ in range(20)]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9))) for h in hashes for _ in range(3)] + [(1 << 64) - 1, (1 << 63) - 1]
    rows = [_photo(k, perceptual_hash=f"{h:016x}") for k, h in enumerate(hashes)]
    got = {(r.photo_id, r.prior_id) for r in C.near_duplicate_edges(_photos(spark, rows)).collect()}
    assert got == {(a, b) for a in range(len(hashes)) for b in range(a) if (hashes[a] ^ hashes[b]).bit_count() <= 7} and (81, 80) in got
    assert {t for _, t in tables["near-hashes"].dtypes} == {"bigint"}


def _dbscan(ids, x, eps, least):
    """DBSCAN by brute force: the smallest face of each one's cluster."""
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 1 - eps
    core = near.sum(1) >= least
    label = {i: ids[i] for i in np.flatnonzero(core)}
    changed = True
    while changed:
        new = {i: min(label[j] for j in np.flatnonzero(near[i] & core)) for i in label}
        changed, label = new != label, new
    full = label | {i: min(label[j] for j in np.flatnonzero(near[i] & core)) for i in np.flatnonzero(~core) if (near[i] & core).any()}
    name = {c: min(ids[i] for i in full if full[i] == c) for c in set(full.values())}
    return {ids[i]: name[c] for i, c in full.items()}


def test_face_clusters_equal_brute_force_and_copy_no_block_per_block(spark):
    """Chains, border faces, lone faces and one frequent person, in many blocks; vectors are shuffled a few times at most."""
    rng = np.random.default_rng(8)
    people = rng.standard_normal((60, 128))
    who = np.concatenate([np.zeros(150, int), rng.integers(0, 60, 250)])
    # noise at which most pairs of a person lie about the limit
    x = (people[who] + rng.standard_normal((400, 128)) * rng.choice([0.3, 0.8, 1.0], 400)[:, None]).astype(np.float32)
    x[399] = x[1]
    ids = [int(i) for i in rng.permutation(1000)[:400]]
    faces = spark.createDataFrame([(i, i, v.tolist()) for i, v in zip(ids, x)], "id long, photo_id long, embedding array<float>")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = {r.face_id: r.cluster_id for r in face_clusters(faces, block=50).collect()}
    assert written() - before < 10 * x.nbytes
    want = _dbscan(ids, x.astype(np.float64), 0.38, 3)
    assert got == want and 50 < len(want) < 400 and len(set(want.values())) > 5


def test_a_failing_builder_costs_only_itself_and_is_named(spark, monkeypatch):
    monkeypatch.setattr(C, "burst_members", lambda *a: 1 / 0)
    photos = _photos(spark, [_photo(k, _T0 + timedelta(seconds=10 * k)) for k in range(6)])
    faces = spark.createDataFrame([], "photo_id long, cluster_id long")
    rows, failed = C.all_members(photos, faces, Settings())
    kinds = {r.kind for r in rows.select("kind").distinct().collect()}
    assert "event" in kinds and "series" not in kinds and "folder" in kinds and list(failed) == ["series"] and "ZeroDivisionError" in failed["series"]


def test_suggestions_are_what_a_rebuild_takes(spark):
    """Builders, suggestions, rebuild: decisions survive, new collections come, stale ones go."""
    from lumenlake.operators.persist import RETAINED, rebuild

    photos = spark.createDataFrame([_photo(k, _T0 + timedelta(minutes=10 * k), relative_path=f"summer/{k}.jpg") for k in range(1, 9)], _SCHEMA)
    rows = C.event_members(C.eligible(photos)).unionByName(C.folder_members(C.eligible(photos)))
    new, links = C.suggestions(rows, photos)
    stored = spark.createDataFrame(
        [(5, "event:1", "event", "Mine", "old", 0.1, "reviewed", False, 1, 1, None, None, None, None), (6, "event:77", "event", "Gone", "old", 0.1, "unreviewed", True, 1, 1, None, None, None, None)],
        "id long, collection_key string, kind string, title string, description string, score double, status string, automatic boolean, algorithm_version int, cover_photo_id long, starts_at timestamp_ntz, ends_at timestamp_ntz, created_at timestamp, updated_at timestamp",
    )
    old_links = spark.createDataFrame([(1, 5, 2, 9, 0.1, "old", "keep", None), (2, 5, 999, 1, 0.1, "old", "reject", None), (3, 6, 3, 1, 0.1, "old", "pending", None)], "id long, collection_id long, photo_id long, rank_no int, score double, reason string, decision string, note string")
    collections, out = rebuild(stored, old_links, new, links, photos)
    got = {r.collection_key: r for r in collections.collect()}
    assert got["event:1"].title == "Mine" and got["event:1"].description == "8 photos grouped by capture time." and "event:77" not in got
    folder = next(r for k, r in got.items() if k.startswith("folder:"))
    assert folder.description == "8 analyzed photos already grouped in source folder summer. The folder is treated as a useful human-authored album clue." and folder.id == 7
    mine = {r.photo_id: r for r in out.collect() if r.collection_id == 5}
    assert mine[2].decision == "keep" and mine[2].reason.startswith("event pick: ") and mine[999].reason == RETAINED and len(mine) == 9


def test_everything_has_duplicates_holidays_and_newly_clustered_people(spark):
    from types import SimpleNamespace

    from lumenlake.plans.curation_queries import _everything

    hashes = {1: ("b", "00000000000000ff", 0.5), 2: ("a", "00000000000000ff", 0.9), 3: ("b", "ffff000000000000", 0.5), 4: ("a", "ffff000000000001", 0.4), 5: (None, "ffff000000000003", 0.9)}
    rows = [_photo(k, _T0 + timedelta(seconds=9 * k), file_hash=h, perceptual_hash=p, quality_score=q, relative_path=f"trip/{9 - k}.jpg") for k, (h, p, q) in hashes.items()]
    photos = spark.createDataFrame([*rows, _photo(6, active=False)], _SCHEMA)
    faces = spark.createDataFrame([(10 + k, k, [1.0] * 127 + [k / 10], 77 if k == 2 else None) for k in (1, 2, 3, 6)], "id long, photo_id long, embedding array<float>, cluster_id long")
    collections, links = C.collections_of(_everything(SimpleNamespace(photos=photos, faces=faces)))
    got = {r.key: r for r in collections.collect()}
    assert got["person:11"].photos == 3 and "person:77" not in got and any(k.startswith("holiday:") for k in got)
    exact, near = got["duplicates:exact"], got["duplicates:near"]
    assert (exact.kind, exact.title, exact.photos, exact.score, exact.starts_at, exact.latitude) == ("duplicates", "Exact duplicates", 4, 1.0, None, None)
    assert (near.title, near.score) == ("Near duplicates", 0.95) and near.cover_photo_id == 2
    order = {k: [(r.photo_id, r.prefix) for r in links.filter(links.key == k).orderBy("rank").collect()] for k in ("duplicates:exact", "duplicates:near")}
    assert order["duplicates:exact"] == [(k, f"byte-identical duplicate group {n}") for k, n in ((3, 1), (1, 1), (4, 2), (2, 2))]
    assert order["duplicates:near"] == [(k, f"visually similar group {n}; best frame is ranked first") for k, n in ((2, 1), (1, 1), (5, 2), (3, 2), (4, 2))]
