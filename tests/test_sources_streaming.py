import hashlib
import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.config import Settings
from lumenlake.functions import pixels as P
from lumenlake.operators import curation as C
from lumenlake.operators.incremental import CommitLog
from lumenlake.sources import photos as S
from lumenlake.streaming.inventory import burst_windows, stream_changes


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for p in ("a.JPG", "trip/b.png", "trip/deep/er/c.heic", "trip/notes.txt", "@EADIR/x.jpg", "_hidden/.d.jpg"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(p.encode())
    os.symlink(root / "a.JPG", root / "link.jpg")
    return root


def test_listing(spark, tree):
    for depth in (0, 1, 3):
        rows = S.list_photos(spark, str(tree), depth=depth)
        assert {r.relative_path for r in rows.collect()} == {"a.JPG", "trip/b.png", "trip/deep/er/c.heic", "_hidden/.d.jpg"}
    assert rows.filter("file_name = 'a.JPG'").first()[2:4] == (".jpg", 5) and S.listing_is_clean(rows)
    assert S.list_photos(spark, str(tree), Settings(scan_max_files=2)).count() == 2
    gone = S.list_photos(spark, str(tree / "none"))
    assert not S.listing_is_clean(gone) and S.probe(str(tree)) == "ok"


def test_hashes_and_copies(spark, tree, tmp_path):
    got = {r.relative_path: r.file_hash for r in S.hashed_contents(spark, str(tree)).collect()}
    assert got["trip/b.png"] == hashlib.sha256(b"trip/b.png").hexdigest() and "trip/notes.txt" not in got
    target = str(tmp_path / "copy" / "b.png")
    assert S.copy_and_hash(str(tree), "trip/./b.png", target, 100) == (got["trip/b.png"], 10)
    with pytest.raises(ValueError):
        S.copy_and_hash(str(tree), "trip/b.png", target + "2", 5)
    assert os.listdir(os.path.dirname(target)) == ["b.png"]
    for bad in ("../x", "/etc/passwd", "a\\..\\b"):
        with pytest.raises(ValueError):
            S.safe_relative_path(bad)


class _Share:
    """Stands in for the client library; the first ``fails`` calls break off."""

    def __init__(self, root, fails=0):
        self.root, self.fails, self.log = str(root), fails, []

    def _local(self, path):
        assert path.startswith("\\\\nas\\photos")
        return self.root + path[len("\\\\nas\\photos") :].replace("\\", "/")

    def _maybe(self, what):
        self.log.append(what)
        if self.fails:
            self.fails -= 1
            raise ConnectionResetError(what)

    def register_session(self, server, username=None, password=None):
        self.log.append(f"session {server} {username}")

    def reset_connection_cache(self, fail_on_error):
        self.log.append("reset")

    def scandir(self, path):
        self._maybe("scan")
        return os.scandir(self._local(path))

    def open_file(self, path, mode):
        self._maybe("open")
        return open(self._local(path), mode)


def test_network_share_is_walked_with_retries(tree, tmp_path):
    waits, client = [], _Share(tree, fails=3)
    share = S.ShareTree("nas", "photos", "me", "secret", client=client, wait=waits.append)
    rows = list(S._Walk(share, set(Settings().skipped), set(Settings().suffixes)).all(""))
    assert {r[0] for r in rows} == {"a.JPG", "trip/b.png", "trip/deep/er/c.heic", "_hidden/.d.jpg"} and waits == [1, 2, 4]
    # each new attempt has a new, authenticated connection
    assert client.log[:5] == ["session nas me", "scan", "reset", "session nas me", "scan"] and S.probe(share) == "ok"
    client.fails = 1
    assert S.copy_and_hash(share, "trip/b.png", str(tmp_path / "b.png"), 100) == (hashlib.sha256(b"trip/b.png").hexdigest(), 10)
    client.fails = 4
    with pytest.raises(S.SourceError):
        share.scan("")
    client.log.clear()
    with pytest.raises(S.TooLarge):
        S.copy_and_hash(share, "trip/b.png", str(tmp_path / "c.png"), 5)
    assert client.log.count("open") == 1 and sorted(os.listdir(tmp_path)) == ["b.png", "root"]
    client.fails = 99
    assert [r[-1] for r in S._Walk(share, set(), set()).all("")] == ["SourceError: can't list"]


def test_source_options():
    assert isinstance(S.tree_of({"root": "/x"}), S.LocalTree) and S.tree_of({"source": "SMB", "server": "a", "share": "b", "folder": "c/d"}).root == "\\\\a\\b\\c\\d"
    for bad in ({}, {"source": "smb", "server": "a"}, {"source": "ftp", "root": "/"}):
        with pytest.raises(ValueError):
            S.tree_of(bad)


def test_path_statistics(spark, tree):
    assert tuple(S.path_statistics(spark, str(tree / "trip")).first()) == (3, len("trip/b.png") + len("trip/deep/er/c.heic") + len("trip/notes.txt"), True)
    assert tuple(S.path_statistics(spark, str(tree / "none")).first()) == (0, 0, False)


def test_faces_fall_back_to_the_next_model(spark):
    def missing():
        raise ImportError("no such model")

    def load():
        def find(image):
            if image[0, 0, 0] == 9:
                raise ValueError("odd image")
            return [{"x": 0.1, "y": 0.2, "width": 0.3, "height": 0.4, "confidence": 0.9, "embedding": [1.0, 2.0]}] * int(image[0, 0, 0])

        return find

    def decoder(content, settings):
        return np.full((2, 2, 3), content[0], dtype=np.uint8), 2, 2

    files = spark.createDataFrame([("two", bytearray([2])), ("none", bytearray([0])), ("odd", bytearray([9])), ("broken", bytearray())], "path string, content binary")
    rows = P.detect_faces(files, [("best", missing), ("plain", load)], decoder=decoder).collect()
    assert [(r.face, r.model, r.embedding) for r in rows if r.path == "two"] == [(0, "plain", [1.0, 2.0]), (1, "plain", [1.0, 2.0])]
    assert {r.path: r.error.split(":")[0] for r in rows if r.error} == {"odd": "plain", "broken": "IndexError"} and not [r for r in rows if r.path == "none"]
    assert "no such model" in P.detect_faces(files.limit(1), [("best", missing)], decoder=decoder).first().error


def test_manifest_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", "")], "rank int, path string, note string")
    out = S.export_manifest(df, str(tmp_path / "m"))
    files = [f for f in os.listdir(out) if f.endswith(".csv")]
    assert len(files) == 1 and (tmp_path / "m" / files[0]).read_text() == 'rank,path,note\n1,"a,b",\n'


def test_pixels():
    flat = np.full((50, 40, 3), 128, dtype=np.uint8)
    m = P.raw_metrics(flat)
    assert m["laplacian_variance"] == 0 and m["midpoint"] > 0.99 and m["deviation"] == 0 and m["colorfulness"] == 0
    rng = np.random.default_rng(0)
    busy = rng.integers(0, 256, (300, 400, 3), dtype=np.uint8)
    assert P.raw_metrics(busy)["laplacian_variance"] > 1000
    assert abs(np.linalg.norm(P.hue_histogram(busy)) - 1) < 1e-6 and P.hue_histogram(flat)[0] == 1
    scene = np.clip(P.shrink(rng.integers(0, 256, (12, 16, 3)).repeat(20, 0).repeat(20, 1), 200, 300), 0, 255)
    small = P.shrink(scene, 100, 150)
    apart = (int(P.perceptual_hash(scene), 16) ^ int(P.perceptual_hash(small), 16)).bit_count()
    assert len(P.perceptual_hash(scene)) == 16 and apart <= 4 and len(P.difference_hash(scene)) == 16
    assert np.allclose(P.shrink(np.arange(8.0).reshape(1, 8), 1, 4), [[0.5, 2.5, 4.5, 6.5]])


def test_images_in_batches(spark):
    def decoder(content, settings):
        if content == b"bad":
            raise ValueError("no image")
        return np.frombuffer(content, dtype=np.uint8).reshape(10, 10, 3), 20, 10

    good = bytes(range(256)) + bytes(44)
    df = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"bad"))], "path string, content binary")
    got = {r.path: r for r in P.analyse_images(df, decoder=decoder).collect()}
    small = P.derivatives(df, decoder=decoder, encoder=lambda image, n, s: bytes(f"{image.shape[0]}:{n}", "ascii")).collect()
    assert {(r.path, r.kind, bytes(r.content)) for r in small} == {("a", "thumbs", b"10:360"), ("a", "previews", b"10:1600")}
    assert got["a"].width == 20 and len(got["a"].visual_features) == 64 and "no image" in got["b"].error


def test_stream_of_listings(spark, tmp_path):
    schema = "entry_id long, relative_path string, size_bytes long, source_mtime double, listed_at timestamp_ntz"
    photos = str(tmp_path / "photos")
    spark.createDataFrame([("a", 1, 1.0, 1, 0)], "relative_path string, size_bytes long, source_mtime double, analysis_version int, analysis_attempts int").write.parquet(photos)
    source, log, check = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "check")
    for rows in ([(1, "a", 1, 1.0), (2, "n", 1, 1.0)], [(3, "a", 2, 1.0)]):
        spark.createDataFrame([(*r, datetime(2025, 1, 1)) for r in rows], schema).coalesce(1).write.mode("append").parquet(source)
        stream_changes(spark.readStream.schema(schema).parquet(source), photos, log, check).awaitTermination()
    cases = sorted((r.relative_path, r.reason) for r in CommitLog(spark, log).outputs("cases").collect())
    assert cases == [("a", "changed"), ("n", "new")] and [c["watermark"] for c in CommitLog(spark, log).commits()] == [2, 3]


def test_burst_windows_agree_with_batch(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    at = [0, 45, 90, 136, 200, 210, 220, 9000]
    df = spark.createDataFrame([(k, t0 + timedelta(seconds=s), 1_735_689_600_000_000 + s * 1_000_000) for k, s in enumerate(at)], "id long, capture_at timestamp_ntz, t_us long")
    batch = {r["count"] for r in C.split_bursts(df).groupBy("burst").count().collect()}
    got = burst_windows(df).collect()
    assert {r.photos for r in got} == batch == {3} and len(got) == 2
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    one = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withColumn("device_id", F.col("id") * 0)
    stream = burst_windows(one, key="device_id")
    q = stream.writeStream.format("memory").queryName("bursts_seen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    # the watermark stands an hour before the last photo, so both series are closed
    assert spark.table("bursts_seen").count() == 2
