from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenlake.config import Settings
from lumenlake.functions import scalars as S
from lumenlake.functions.geo import haversine_km


def _one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_distance_and_hash(spark):
    assert abs(_one(spark, haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) - 20015.115) < 0.01
    assert _one(spark, haversine_km(F.lit(0.0), F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0))) is None
    d = lambda a, b: _one(spark, S.hex_distance("a", "b"), a=a, b=b)
    assert d("ffffffffffffffff", "0") == 64 and d("8000000000000001", "0000000000000000") == 2 and d(None, "1") == 65 and d("zz", "1") == 65 and d("", "1") == 65


def test_quality_and_reason(spark):
    df = spark.createDataFrame([(None, None), (0.5, 5), (0.5, 0), (1.4, None), (float("nan"), None)], "quality_score double, manual_rating int")
    assert [round(r.q, 6) for r in df.select(S.effective_quality().alias("q")).collect()] == [0.35, 0.65, 0.5, 1.0, 0.35]
    df = spark.createDataFrame([(0.9, 0.9, 0.9, 3, 1.0), (None, None, None, None, None), (0.1, 0.8, 0.1, 1, 2.0)], "sharpness_score double, exposure_score double, color_score double, face_count int, latitude double")
    assert [r.r for r in df.select(S.reason("p").alias("r")).collect()] == ["p: sharp, balanced light, strong color", "p: representative frame", "p: balanced light, 1 face, has location"]


def test_labels_titles_paths(spark):
    a, b, c = datetime(2024, 5, 3), datetime(2024, 6, 1), datetime(2025, 1, 2)
    label = lambda s, e: _one(spark, S.time_label("s", "e"), s=s, e=e)
    assert label(a, a) == "May 3, 2024" and label(a, b) == "May 3 – Jun 1, 2024" and label(a, c) == "May 3, 2024 – Jan 2, 2025"
    assert _one(spark, S.folder_title("p"), p="x/summer-trip_o'neil 2nd") == "Summer Trip O'Neil 2Nd"
    assert _one(spark, S.folder("p"), p="a.jpg") is None and _one(spark, S.folder("p"), p="a/b/c.jpg") == "a/b"
    assert _one(spark, S.safe_path("p"), p="a\\.\\b//c") == "a/b/c" and _one(spark, S.safe_path("p"), p="/etc") is None and _one(spark, S.safe_path("p"), p="a/../b") is None
    assert _one(spark, S.safe_file_name("p"), p="--Été / 1--") == "Été---1" and _one(spark, S.safe_file_name("p"), p="***") == "collection"
    assert _one(spark, S.csv_guard("p"), p="=1+1") == "'=1+1" and _one(spark, S.csv_guard("p"), p="a=1") == "a=1"


def test_numbers_and_times(spark):
    num = lambda t: _one(spark, S.as_float("t"), t=t)
    assert num("1/4") == 0.25 and num("1/0") is None and num("x") is None and num("2.5") == 2.5 and num("1/2/3") is None
    assert _one(spark, S.exposure_text(F.lit(0.004))) == "1/250" and _one(spark, S.exposure_text(F.lit(2.5))) == "2.5s" and _one(spark, S.exposure_text(F.lit(30.0))) == "30s"
    taken = lambda exif, name: tuple(_one(spark, S.capture_time([F.col("e")], "n", F.lit(0.5)), e=exif, n=name))
    assert taken("2024:05:03 10:11:12", "x.jpg") == (datetime(2024, 5, 3, 10, 11, 12), "exif")
    assert taken(None, "IMG_20240503_101112.jpg") == (datetime(2024, 5, 3, 10, 11, 12), "filename")
    assert taken("nonsense", "IMG_20241303_101112.jpg")[1] == "mtime" and taken("", "a120240503101112.jpg")[1] == "mtime"
    assert _one(spark, S.gps_decimal(F.lit(10.0), F.lit(30.0), F.lit(36.0), F.lit("s"))) == pytest.approx(-10.51)
    assert _one(spark, S.progress_percent(F.lit(1), F.lit(3))) == 33.3 and _one(spark, S.progress_percent(F.lit(1), F.lit(0))) is None
    assert [_one(spark, S.display_bytes(F.lit(n))) for n in (0, 1023, 1536, 5 * 1024**4)] == ["0 B", "1023 B", "1.5 KB", "5.0 TB"]


def test_redaction(spark):
    clean = _one(spark, S.redacted("t", {"hunter2": "<pw>", "ab": "no"}), t="Password=abc,  x hunter2\n ab")
    assert clean == "Password=<redacted>, x <pw> ab"
    assert len(_one(spark, S.redacted("t"), t="x" * 2000)) == 800 and _one(spark, S.redacted("t"), t=None) is None


def test_settings_have_bounds():
    with pytest.raises(ValueError):
        Settings(event_gap_hours=0)
    with pytest.raises(ValueError):
        Settings(trip_max_days=91)
    assert ".jpeg" in Settings(supported_extensions=("JPEG",)).suffixes
