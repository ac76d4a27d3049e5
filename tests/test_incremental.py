from datetime import datetime, timedelta

import pytest

from lumenlake.operators.incremental import CommitConflict, CommitLog, changed_files, run_increment

_T0 = datetime(2025, 1, 1)
_ENTRY = "entry_id long, relative_path string, size_bytes long, source_mtime double, listed_at timestamp_ntz, rank int"
_PHOTO = "relative_path string, size_bytes long, source_mtime double, analysis_version int, analysis_attempts int, reason string"


def _entries(spark, rows):
    return spark.createDataFrame([(i, p, s, m, None if h is None else _T0 + timedelta(hours=h), 0) for i, p, s, m, h in rows], _ENTRY)


def _cases(df):
    return {r.relative_path: r.reason for r in df.collect()}


def test_runs_take_each_change_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    photos = spark.createDataFrame([("a", 1, 5.0, 1, 0, "x"), ("b", 2, 5.0, 1, 1, "x"), ("c", 3, 5.0, 0, 2, "x"), ("d", 4, 5.0, 0, 3, "x"), ("z", 9, 5.0, 0, 0, "x")], _PHOTO)
    first = _entries(spark, [(1, "a", 1, 5.0005, 1), (2, "b", 7, 5.0, 1), (3, "c", 3, 5.0, 1), (4, "d", 4, 5.0, 1), (5, "n", 1, 1.0, 1), (6, None, 1, 1.0, 1), (7, "b", 2, 5.0, 0)])
    assert _cases(changed_files(log, first, photos)) == {"b": "changed", "c": "undone", "n": "new"}
    # nothing new: only what was left undone comes again
    assert _cases(changed_files(log, first, photos)) == {"c": "undone"}
    # a late row of an older listing changes nothing, a newer one does; unlisted z never comes
    more = first.unionByName(_entries(spark, [(8, "a", 99, 5.0, 0), (9, "n", 1, 1.0, 2)]))
    assert _cases(changed_files(log, more, photos)) == {"c": "undone", "n": "new"}
    assert [c["watermark"] for c in log.commits()] == [7, 7, 9]


def test_upper_bound_is_fixed_and_windows_join(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    photos = spark.createDataFrame([], _PHOTO)
    rows = _entries(spark, [(i, f"p{i}", 1, 1.0, i) for i in range(1, 21)])
    seen = []
    for upper in (5, 5, 12, None):
        seen += _cases(changed_files(log, rows, photos, upper=upper))
    assert sorted(seen) == sorted(f"p{i}" for i in range(1, 21))


def test_a_failed_run_leaves_no_trace(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    rows = spark.range(10).withColumnRenamed("id", "seq")

    def broken(window, last, write):
        write("out", window)
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        run_increment(log, rows, "seq", broken)
    assert log.commits() == [] and log.outputs("out") is None
    run_increment(log, rows, "seq", lambda window, last, write: write("out", window) and None)
    run_increment(log, rows.unionByName(spark.createDataFrame([(10,), (11,)], "seq long")), "seq", lambda window, last, write: write("out", window) and None)
    assert sorted(r.seq for r in log.outputs("out").collect()) == list(range(12))


def test_two_runs_at_once_cannot_both_commit(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    rows = spark.range(3).withColumnRenamed("id", "seq")

    def overtaken(window, last, write):
        write("out", window)
        log.add(0, {"number": 0, "run": "other", "low": None, "watermark": 2, "outputs": {}, "state": None})

    with pytest.raises(CommitConflict):
        run_increment(log, rows, "seq", overtaken)
    assert len(log.commits()) == 1 and log.outputs("out") is None


def test_nulls_nan_and_empty(spark, tmp_path):
    nan = float("nan")
    photos = spark.createDataFrame([("a", None, None, 1, 0, ""), ("b", 1, nan, 1, 0, ""), ("c", 1, 1.0, None, None, ""), ("e", 1, 1.0, 1, 0, ""), (None, 1, 1.0, 0, 0, "")], _PHOTO)
    rows = _entries(spark, [(1, "a", None, None, None), (2, "b", 1, nan, 1), (3, "c", 1, 1.0, 1), (4, "e", 1, None, 1), (None, "f", 1, 1.0, 1)])
    assert _cases(changed_files(CommitLog(spark, str(tmp_path / "l1")), rows, photos)) == {"c": "undone", "e": "changed"}
    assert _cases(changed_files(CommitLog(spark, str(tmp_path / "l2")), rows.limit(0), photos)) == {}


def _folders(tmp_path):
    return sorted(p.name for p in (tmp_path / "log" / "runs").iterdir())


def test_orphans_are_removed_and_commits_not_reread(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, str(tmp_path / "log"))
    rows = spark.range(10).withColumnRenamed("id", "seq")

    def broken(window, last, write):
        write("out", window)
        raise RuntimeError("executor lost")

    for _ in range(2):
        with pytest.raises(RuntimeError):
            run_increment(log, rows, "seq", broken)
    assert len(_folders(tmp_path)) == 2
    kept = run_increment(log, rows, "seq", lambda window, last, write: write("out", window) and None)
    assert _folders(tmp_path) == [kept["run"]]
    read = []
    monkeypatch.setattr(CommitLog, "read", lambda self, n, real=CommitLog.read: read.append(n) or real(self, n))
    for _ in range(4):
        run_increment(log, rows, "seq", lambda window, last, write: write("out", window) and None)
    assert read == [0, 1, 2, 3]


def test_state_is_read_and_written_by_touched_buckets(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    photos = spark.createDataFrame([], _PHOTO)
    rows = [(i, f"p{i}", 1, 1.0, i) for i in range(1, 101)]
    got = _cases(changed_files(log, _entries(spark, rows), photos, rows_per_bucket=10))
    first = log.last()["state"]
    assert len(got) == 100 and first["buckets"] == 10 and first["rows"] == 100
    rows += [(101, "p7", 2, 1.0, 0), (102, "q", 1, 1.0, 1)]
    assert set(_cases(changed_files(log, _entries(spark, rows), photos, rows_per_bucket=10))) == {"p7", "q"}
    second = log.last()["state"]
    changed = [b for mine in list(second["runs"].values())[1:] for b in mine]
    assert second["rows"] == 101 and 1 <= len(changed) <= 2 and sorted(b for mine in second["runs"].values() for b in mine) == list(range(10))
    # outgrown: all buckets anew, nothing lost
    rows += [(i, f"r{i}", 1, 1.0, i) for i in range(200, 600)]
    assert len(_cases(changed_files(log, _entries(spark, rows), photos, rows_per_bucket=10))) == 400
    third = log.last()["state"]
    assert third["buckets"] == 51 and third["rows"] == 501 and len(third["runs"]) == 1
