from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import browse as B
from lumenlake.operators import ingest as I
from lumenlake.operators import persist as K

_T0 = datetime(2025, 1, 1)
_PHOTO = "id long, relative_path string, file_name string, extension string, size_bytes long, source_mtime double, active boolean, scan_token string, analysis_status string, analysis_version int, analysis_attempts int, analysis_error string, capture_at timestamp_ntz, file_hash string"


def _photo(i, path, **x):
    d = {"file_name": path, "extension": ".jpg", "size_bytes": 1, "source_mtime": 1.0, "active": True, "scan_token": "old", "analysis_status": "done", "analysis_version": 1, "analysis_attempts": 0} | x | {"id": i, "relative_path": path}
    return tuple(d.get(c.split()[0]) for c in _PHOTO.split(", "))


def test_scan_safety(spark):
    photos = spark.createDataFrame([_photo(1, "gone.jpg")], _PHOTO)
    listing = spark.createDataFrame([("new.PNG", "new.PNG", 5, 2.0, "t2")], "relative_path string, file_name string, size_bytes long, source_mtime double, scan_token string")
    out = I.upsert_inventory(photos, listing)
    new = out.filter("relative_path = 'new.PNG'").first()
    assert (new.analysis_status, new.extension, new.active, new.scan_token) == ("pending", ".png", True, "t2")
    for warnings, limited, active in ((1, False, True), (0, True, True), (0, False, False)):
        assert I.deactivate_unseen(out, "t2", warnings, limited).filter("relative_path = 'gone.jpg'").first().active is active


def test_changed_files_start_over(spark):
    photos = spark.createDataFrame([_photo(1, "a", analysis_attempts=2, analysis_error="x"), _photo(2, "b", analysis_attempts=2)], _PHOTO)
    listing = spark.createDataFrame([("a", "a", 1, 1.002, "t"), ("b", "b", 1, 1.0005, "t")], "relative_path string, file_name string, size_bytes long, source_mtime double, scan_token string")
    got = {r.relative_path: (r.analysis_status, r.analysis_version, r.analysis_attempts, r.analysis_error) for r in I.upsert_inventory(photos, listing).collect()}
    assert got == {"a": ("pending", 0, 0, None), "b": ("done", 1, 2, None)}


def test_queue_recovery_retry_write_back(spark):
    photos = spark.createDataFrame([
        _photo(1, "a", analysis_status="analyzing", analysis_attempts=2, capture_at=_T0), _photo(2, "b", analysis_status="pending", analysis_version=0), _photo(3, "c", analysis_status="error", analysis_attempts=3),
        _photo(4, "d", analysis_version=0, capture_at=_T0), _photo(5, "e", active=False, analysis_status="pending"), _photo(6, "f"),
    ], _PHOTO)
    assert [r.id for r in I.analysis_queue(photos).collect()] == [2, 1, 4]
    jobs = spark.createDataFrame([(1, "running"), (2, "completed")], "id long, status string")
    stuck, again = I.recover(photos, jobs)
    assert stuck.filter("id = 1").first()[8:11] == ("error", 1, 2) and [r.status for r in again.orderBy("id").collect()] == ["queued", "completed"]
    assert I.retry_errors(photos).filter("id = 3").first()[8:12] == ("pending", 1, 0, None)
    faces = spark.createDataFrame([(1, 1), (2, 6)], "id long, photo_id long")
    results = spark.createDataFrame([(1, "done", None, "h"), (2, "too_large", "big", None), (3, "error", "bad", None)], "photo_id long, outcome string, error string, file_hash string")
    after, seen = I.write_back(photos, faces, results, spark.createDataFrame([(7, 1), (8, 3)], "id long, photo_id long"))
    got = {r.id: (r.analysis_status, r.analysis_version, r.analysis_attempts) for r in after.collect()}
    assert got[1] == ("done", 1, 0) and got[2] == ("too_large", 1, 0) and got[3] == ("error", 1, 4) and got[6] == ("done", 1, 0)
    assert sorted(r.id for r in seen.collect()) == [2, 7]


def test_job_rules(spark):
    jobs = [{"id": 1, "kind": "full", "status": "running", "created_at": 1}, {"id": 2, "kind": "scan", "status": "queued", "created_at": 0}]
    assert I.enqueue(jobs, "full") == 1 and I.enqueue(jobs, "scan") == 2 and I.enqueue(jobs[1:], "full") is None and I.enqueue(jobs, "analyze") == 1
    with pytest.raises(ValueError):
        I.enqueue(jobs, "other")
    df = spark.createDataFrame([(1, "full", "failed", _T0), (2, "scan", "queued", _T0 - timedelta(days=9))], "id long, kind string, status string, created_at timestamp_ntz")
    assert I.claim(df).first().id == 2
    due = lambda d, h: I.scan_due(d, F.lit(None).cast("timestamp_ntz"), F.lit(_T0 + timedelta(hours=5)).cast("timestamp_ntz"), h).first().due
    assert not due(df, 4) and due(df.filter("id = 1"), 4) and not due(df.filter("id = 1"), 6) and due(df.limit(0), 6)


_COLLECTION = "id long, collection_key string, kind string, title string, description string, score double, status string, automatic boolean, algorithm_version int, cover_photo_id long, starts_at timestamp_ntz, ends_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
_LINK = "id long, collection_id long, photo_id long, rank_no int, score double, reason string, decision string, note string"


def _rebuild(spark, collections, links, new, new_links):
    old = spark.createDataFrame([(*c, 1, None, None, None, None, None) for c in collections], _COLLECTION)
    new = spark.createDataFrame([(k, "event", t, "d", 0.5, 1, _T0, _T0) for k, t in new], "collection_key string, kind string, title string, description string, score double, cover_photo_id long, starts_at timestamp_ntz, ends_at timestamp_ntz")
    new_links = spark.createDataFrame([(*x, 0.5, "r") for x in new_links], "collection_key string, photo_id long, rank_no int, score double, reason string")
    photos = spark.createDataFrame([(k, _T0 - timedelta(days=365 * k)) for k in range(9)], "id long, capture_at timestamp_ntz")
    c, k = K.rebuild(old, spark.createDataFrame(links, _LINK), new, new_links, photos)
    return {r.collection_key: r for r in c.collect()}, {(r.collection_id, r.photo_id): r for r in k.collect()}


def test_rebuild_keeps_what_people_decided(spark):
    collections = [(1, "a", "event", "Mine", "x", 0.1, "kept", False), (2, "b", "event", "Auto", "x", 0.1, "unreviewed", True)]
    links = [(1, 1, 1, 1, 0.1, "r", "keep", "n"), (2, 1, 2, 2, 0.1, "r", "pending", None), (3, 1, 3, 3, 0.1, "r", "reject", None), (4, 2, 5, 1, 0.1, "r", "pending", "note"), (5, 2, 5, 1, 0.1, "r", "pending", None), (6, 2, 6, 2, 0.1, "r", "keep", None)]
    c, k = _rebuild(spark, collections, links, [("a", "New a"), ("b", "New b"), ("c", "New c")], [("a", 1, 1), ("a", 4, 2), ("b", 6, 1), ("c", 7, 1)])
    assert (c["a"].title, c["a"].status, c["b"].title, c["c"].status, c["c"].id) == ("Mine", "kept", "New b", "unreviewed", 3)
    assert (k[1, 1].decision, k[1, 1].note) == ("keep", "n") and (1, 2) not in k and (k[1, 3].rank_no, k[1, 3].reason) == (3, K.RETAINED)
    assert k[1, 4].decision == "pending" and k[1, 4].id > 6 and (2, 5) not in k and (3, 7) in k
    assert c["a"].starts_at == _T0 - timedelta(days=365 * 3) and c["a"].ends_at == _T0


def test_vanished_collections(spark):
    rows = [(i, k, "event", k, "x ", 0.1, s, a) for i, k, s, a in ((1, "untouched", "unreviewed", True), (2, "kept", "unreviewed", True), (3, "noted", "unreviewed", True), (4, "renamed", "unreviewed", False), (5, "status", "hidden", True))]
    links = [(1, 1, 1, 1, 0.1, "r", "pending", None), (2, 2, 1, 1, 0.1, "r", "keep", None), (3, 3, 1, 1, 0.1, "r", "pending", "n"), (4, 4, 1, 1, 0.1, "r", "pending", None)]
    c, k = _rebuild(spark, rows, links, [], [])
    assert set(c) == {"kept", "noted", "renamed", "status"} and set(k) == {(2, 1), (3, 1), (4, 1)}
    assert c["kept"].description == f"x {K.ARCHIVED}" and c["renamed"].description == "x "


def test_review_edits(spark):
    links = spark.createDataFrame([(k, 1, k, k, 0.1, "r", d, None) for k, d in ((1, "pending"), (2, "reject"), (3, "pending"), (4, "pending"))], _LINK)
    assert [r.decision for r in K.keep_top(links, 1, 3).orderBy("rank_no").collect()] == ["keep", "reject", "keep", "pending"]
    with pytest.raises(ValueError):
        K.keep_top(links, 1, 0)
    edits = spark.createDataFrame([(1, "reject", "why"), (2, "keep", None)], "id long, decision string, note string")
    assert [(r.decision, r.note) for r in K.decide(links, edits).orderBy("id").collect()][:2] == [("reject", "why"), ("keep", None)]
    with pytest.raises(ValueError):
        K.decide(links, edits.withColumn("decision", F.lit("maybe")))
    c = spark.createDataFrame([(1, "old", True), (2, "other", True)], "id long, title string, automatic boolean")
    assert [tuple(r) for r in K.rename_collections(c, spark.createDataFrame([(1, " New ")], "id long, title string")).orderBy("id").collect()] == [(1, "New", False), (2, "other", True)]
    with pytest.raises(ValueError):
        K.rename_collections(c, spark.createDataFrame([(1, "  ")], "id long, title string"))
    p = spark.createDataFrame([(1, 3), (2, 4)], "id long, manual_rating int")
    assert [r.manual_rating for r in K.rate(p, spark.createDataFrame([(1, None)], "id long, rating int")).orderBy("id").collect()] == [None, 4]
    with pytest.raises(ValueError):
        K.rate(p, spark.createDataFrame([(1, 6)], "id long, rating int"))


def test_pages_and_sections(spark):
    rows = [(k, None if k == 0 else datetime(2024 + k % 2, 1 + k % 3, 1), True) for k in range(23)]
    photos = spark.createDataFrame(rows, "id long, capture_at timestamp_ntz, active boolean")
    ordered = B.newest_first(photos)
    first, second = B.page(ordered, 1, 20).collect(), B.page(ordered, 2, 20).collect()
    assert len(first) == 20 and len(second) == 3 and second[-1].id == 0
    s = B.date_sections(B.page(ordered, 1, 23), "year").orderBy("section_no").collect()
    assert [r.section for r in s][0] == "2025" and s[-1].section == "unknown" and s[-1].section_no == 3
    assert [r.id for r in B.page_after(photos, 5, 2).collect()] == [4, 3]
    assert B.optional_bool("TRUE") is True and B.optional_bool("") is None and B.optional_year("2024") == 2024 and B.optional_year(None) is None
    for call, text in ((B.optional_bool, "maybe"), (B.optional_year, "1"), (B.optional_year, "x")):
        with pytest.raises(ValueError):
            call(text)
    with pytest.raises(ValueError):
        B.library(photos, year=1)
    with pytest.raises(ValueError):
        B.issues(photos, "fine")


def test_manifest_is_guarded_and_ordered(spark):
    links = spark.createDataFrame([(1, 7, 1, 2, 0.1, "=bad", "keep", None), (2, 7, 2, 1, 0.1, "r", "pending", "-x"), (3, 7, 3, 3, 0.1, "r", "reject", None)], _LINK)
    photos = spark.createDataFrame([(k, f"p{k}", _T0 if k == 1 else None, 0.12345 if k == 1 else None, "", "Land" if k == 1 else None) for k in (1, 2, 3)], "id long, relative_path string, capture_at timestamp_ntz, quality_score double, place_city string, place_country string")
    got = [tuple(r) for r in B.manifest(links, photos, 7).collect()]
    assert got == [(1, "pending", "p2", "", "", "", "r", "'-x"), (2, "keep", "p1", "2025-01-01T00:00:00", "0.1235", "Land", "'=bad", "")] or got[1][4] == "0.1234"
