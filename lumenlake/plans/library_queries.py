"""Queries of the library's scalar functions, pages, reports and inventory, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.config import Settings
from lumenlake.functions import scalars as S
from lumenlake.functions.geo import haversine_km
from lumenlake.operators import browse as B
from lumenlake.operators import ingest as I
from lumenlake.operators import persist as K
from lumenlake.operators.ordering import global_positions
from lumenlake.sources.photos import hashed_contents, list_photos, path_statistics

NOW = datetime(2025, 6, 1)
_SQL_NOW = "TIMESTAMP '2025-06-01 00:00:00'"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of a directory by name."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.folder = spark, sf

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of ``Tables`` as a query, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return f(Tables(spark, sf))

        run.__name__ = f.__name__
        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_Q = "coalesce(CASE WHEN NOT isnan(quality_score) THEN quality_score END, 0.35)"
SQL_QUALITY = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN coalesce(manual_rating, 0) <> 0 THEN {_Q} * 0.7::DOUBLE + manual_rating / 5 * 0.3::DOUBLE ELSE {_Q} END))"
_NUM = "CASE WHEN isnan({0}) THEN 0 ELSE coalesce({0}, 0) END"
SQL_REASON = (
    "coalesce(nullif(array_to_string(list_filter([CASE WHEN " + _NUM.format("sharpness_score") + " >= 0.72 THEN 'sharp' END, CASE WHEN " + _NUM.format("exposure_score") + " >= 0.78 THEN 'balanced light' END, CASE WHEN "
    + _NUM.format("color_score") + " >= 0.65 THEN 'strong color' END, CASE WHEN coalesce(face_count, 0) <> 0 THEN face_count || CASE WHEN face_count = 1 THEN ' face' ELSE ' faces' END END,"
    " CASE WHEN latitude IS NOT NULL THEN 'has location' END], lambda x: x IS NOT NULL)[1:3], ', '), ''), 'representative frame')"
)


def sql_hex_distance(a: str, b: str) -> str:
    ok = f"coalesce(regexp_full_match(trim({a}), '[0-9a-fA-F]{{1,16}}') AND regexp_full_match(trim({b}), '[0-9a-fA-F]{{1,16}}'), false)"
    return f"CASE WHEN {ok} THEN bit_count(xor(('0x' || trim({a}))::UBIGINT, ('0x' || trim({b}))::UBIGINT))::INTEGER ELSE 65 END"


def sql_haversine(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians({c} - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - ({b})) / 2), 2)))))"


def sql_label(s: str, e: str) -> str:
    full = "%b %-d, %Y"
    return f"CASE WHEN {s}::DATE = {e}::DATE THEN strftime({s}, '{full}') WHEN year({s}) = year({e}) THEN strftime({s}, '%b %-d') || ' – ' || strftime({e}, '{full}') ELSE strftime({s}, '{full}') || ' – ' || strftime({e}, '{full}') END"


SQL_FOLDER = "nullif(regexp_extract(relative_path, '^(.*)/[^/]*$', 1), '')"
_SQL_SHA = "sha1(relative_path)"


# -- scalar functions ------------------------------------------------------------------


@query(f"SELECT id, round({SQL_QUALITY}, 6) AS quality FROM photos")
def scalar_quality(t: Tables) -> DataFrame:
    return t.photos.select("id", F.round(S.effective_quality(), 6).alias("quality"))


@query(f"SELECT id, 'pick: ' || {SQL_REASON} AS reason FROM photos")
def scalar_reason(t: Tables) -> DataFrame:
    return t.photos.select("id", S.reason("pick").alias("reason"))


@query(f"SELECT id, round({sql_haversine('latitude', 'longitude', '43.36', '-8.41')}, 3) AS km FROM photos WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT isnan(latitude) AND NOT isnan(longitude)")
def scalar_haversine(t: Tables) -> DataFrame:
    rows = t.photos.filter("latitude between -90 and 90 and longitude between -180 and 180 and not isnan(latitude) and not isnan(longitude)")
    return rows.select("id", F.round(haversine_km("latitude", "longitude", F.lit(43.36), F.lit(-8.41)), 3).alias("km"))


@query(f"SELECT id, {sql_hex_distance('perceptual_hash', 'difference_hash')} AS bits FROM photos")
def scalar_hamming(t: Tables) -> DataFrame:
    return t.photos.select("id", S.hex_distance("perceptual_hash", "difference_hash").alias("bits"))


@query(f"SELECT id, {sql_label('starts_at', 'ends_at')} AS label FROM collections WHERE starts_at IS NOT NULL AND ends_at IS NOT NULL")
def scalar_time_label(t: Tables) -> DataFrame:
    return t.collections.filter("starts_at is not null and ends_at is not null").select("id", S.time_label("starts_at", "ends_at").alias("label"))


@query(f"SELECT id, {SQL_FOLDER} AS folder, nullif(place_city, '') AS place FROM photos")
def scalar_folder_place(t: Tables) -> DataFrame:
    return t.photos.select("id", S.folder().alias("folder"), S.place_label().alias("place"))


@query(
    f"""WITH f AS (SELECT DISTINCT {SQL_FOLDER} AS folder FROM photos), n AS (SELECT folder, trim(regexp_replace(regexp_extract(folder, '[^/]*$'), '[_-]', ' ', 'g')) AS name FROM f WHERE folder IS NOT NULL)
SELECT folder, array_to_string(list_transform(regexp_extract_all(name, '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS title FROM n"""
)
def scalar_folder_title(t: Tables) -> DataFrame:
    folders = t.photos.select(S.folder().alias("folder")).filter("folder is not null").distinct()
    return folders.select("folder", S.folder_title("folder").alias("title"))


@query(f"SELECT id, substr({_SQL_SHA}, 1, 16) AS digest, 'thumbs/' || substr({_SQL_SHA}, 1, 2) || '/' || {_SQL_SHA} || '.jpg' AS thumb FROM photos")
def scalar_digests(t: Tables) -> DataFrame:
    return t.photos.select("id", S.key_digest("relative_path").alias("digest"), S.cache_path("relative_path").alias("thumb"))


@query(
    """WITH x AS (SELECT id, CASE WHEN exposure_time LIKE '%/%' THEN TRY_CAST(split_part(trim(exposure_time), '/', 1) AS DOUBLE) / nullif(TRY_CAST(split_part(trim(exposure_time), '/', 2) AS DOUBLE), 0) ELSE TRY_CAST(trim(exposure_time) AS DOUBLE) END AS s FROM photos)
SELECT id, round(s, 9) AS seconds, CASE WHEN s > 0 AND s < 1 THEN '1/' || round_even(1 / s, 0)::BIGINT WHEN s IS NOT NULL THEN regexp_replace(regexp_replace(printf('%.6f', s), '0+$', ''), '\\.$', '') || 's' END AS exposure FROM x"""
)
def scalar_exposure(t: Tables) -> DataFrame:
    x = t.photos.select("id", S.as_float("exposure_time").alias("s"))
    return x.select("id", F.round("s", 9).alias("seconds"), S.exposure_text("s").alias("exposure"))


@query("SELECT id, nullif(substr(regexp_replace(replace(camera_model, chr(0), ''), '^\\s+|\\s+$', '', 'g'), 1, 150), '') AS camera FROM photos")
def scalar_clean_text(t: Tables) -> DataFrame:
    return t.photos.select("id", S.clean_text("camera_model").alias("camera"))


@query("SELECT id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM (SELECT id, CASE WHEN latitude BETWEEN -90 AND 90 AND NOT isnan(latitude) THEN latitude END AS latitude, CASE WHEN longitude BETWEEN -180 AND 180 AND NOT isnan(longitude) THEN longitude END AS longitude FROM photos)")
def scalar_gps(t: Tables) -> DataFrame:
    """Coordinates written as degrees, minutes and seconds, and read again."""

    def dms(c: str, low: str, high: str):
        v = S.in_range(c, 90.0 if c == "latitude" else 180.0)
        a = F.abs(v)
        d = F.floor(a)
        m = F.floor((a - d) * 60)
        return S.gps_decimal(d.cast("double"), m.cast("double"), ((a - d) * 60 - m) * 60, F.when(v < 0, low).otherwise(high))

    return t.photos.select("id", F.round(dms("latitude", "S", "N"), 6).alias("latitude"), F.round(dms("longitude", "W", "E"), 6).alias("longitude"))


_IN_NAME = "(?:^|[^0-9])((?:19|20)[0-9]{2})[-_]?([01][0-9])[-_]?([0-3][0-9])[ T_-]?([0-2][0-9])[-_.:]?([0-5][0-9])[-_.:]?([0-5][0-9])(?:[^0-9]|$)"
_STEM = "regexp_replace(file_name, '(.)\\.[^.]*$', '\\1')"


@query(
    f"""WITH c AS (SELECT id, CASE WHEN capture_source = 'exif' THEN date_trunc('second', capture_at) END AS exif,
TRY_CAST({" || ".join(f"regexp_extract({_STEM}, '{_IN_NAME}', {k}) || '{x}'" for k, x in zip(range(1, 7), ("-", "-", " ", ":", ":", ""), strict=True))} AS TIMESTAMP) AS named,
to_timestamp(floor(source_mtime)) AT TIME ZONE 'UTC' AS file FROM photos)
SELECT id, coalesce(exif, named, file) AS capture_at, CASE WHEN exif IS NOT NULL THEN 'exif' WHEN named IS NOT NULL THEN 'filename' WHEN file IS NOT NULL THEN 'mtime' END AS capture_source FROM c"""
)
def scalar_capture_time(t: Tables) -> DataFrame:
    """All three branches; the EXIF text is written from the stored time, file times are taken in whole seconds."""
    exif = F.when(F.col("capture_source") == "exif", F.date_format("capture_at", "yyyy:MM:dd HH:mm:ss"))
    return t.photos.select("id", S.capture_time([exif], "file_name", F.floor("source_mtime")).alias("c")).select("id", "c.capture_at", "c.capture_source")


@query(
    """WITH f AS (SELECT photo_id AS id, max(width * height) AS face FROM faces GROUP BY 1)
SELECT p.id, CASE WHEN NOT isnan(sharpness_score + exposure_score + contrast_score + color_score + resolution_score) THEN round(greatest(0.0, least(1.0, sharpness_score * 0.30 + exposure_score * 0.24 + contrast_score * 0.14 + color_score * 0.12 + resolution_score * 0.20 + CASE WHEN face IS NOT NULL THEN least(0.08, 0.025 + 0.25 * face) ELSE 0 END)), 6) END AS quality
FROM photos p LEFT JOIN f ON f.id = p.id"""
)
def scalar_overall_quality(t: Tables) -> DataFrame:
    faces = t.faces.groupBy(F.col("photo_id").alias("id")).agg(F.max(F.col("width") * F.col("height")).alias("face"))
    return t.photos.join(faces, "id", "left").select("id", F.round(S.overall_quality("face"), 6).alias("quality"))


@query(
    """SELECT id, CASE WHEN coalesce(size_bytes, 0) = 0 THEN '0 B' WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024) WHEN size_bytes < 1073741824 THEN printf('%.1f MB', size_bytes / 1048576) ELSE printf('%.1f GB', size_bytes / 1073741824) END AS size,
coalesce(strftime(capture_at, '%b %-d, %Y %H:%M'), 'Unknown') AS captured, strftime(updated_at, '%Y-%m-%dT%H:%M:%S+00:00') AS updated FROM photos"""
)
def scalar_display(t: Tables) -> DataFrame:
    return t.photos.select("id", S.display_bytes("size_bytes").alias("size"), S.display_time("capture_at").alias("captured"), S.iso_time("updated_at").alias("updated"))


@query(
    """WITH r AS (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, 'Solvenna', '<place>'), '(password|token|secret)=([^\\s,;]+)', '\\1=<redacted>', 'gi'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 800 THEN substr(t, 1, 799) || '…' ELSE t END AS clean FROM r"""
)
def scalar_redact(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.redacted("text", {"Solvenna": "<place>"}).alias("clean"))


@query(
    """SELECT id, CASE WHEN regexp_matches(title, '^[=+\\-@\\t\\r]') THEN '''' || title ELSE title END AS guarded, coalesce(nullif(substr(regexp_replace(regexp_replace(title, '[^\\p{L}\\p{N}]', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'collection') AS file_name FROM collections"""
)
def scalar_export_names(t: Tables) -> DataFrame:
    return t.collections.select("id", S.csv_guard("title").alias("guarded"), S.safe_file_name("title").alias("file_name"))


@query("SELECT id, CASE WHEN iso % 400 = 0 THEN height ELSE width END AS width, CASE WHEN iso % 400 = 0 THEN width ELSE height END AS height FROM photos")
def scalar_oriented_size(t: Tables) -> DataFrame:
    """The test data has no orientation, so the ISO value stands in for it."""
    turn = F.when(F.col("iso") % 400 == 0, 6).otherwise(1)
    return t.photos.select("id", S.oriented_size("width", "height", turn).alias("s")).select("id", "s.width", "s.height")


@query(
    """SELECT id, CASE WHEN NOT isnan(sharpness_score) THEN round(greatest(0.0, least(1.0, ln(1 + sharpness_score) / ln(1201.0))), 6) END AS sharpness, CASE WHEN NOT isnan(color_score) THEN round(greatest(0.0, least(1.0, color_score / 90)), 6) END AS color,
CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN round(greatest(0.0, least(1.0, ln(1 + width * height / 1e6) / ln(13.0))), 6) END AS resolution FROM photos"""
)
def scalar_metrics(t: Tables) -> DataFrame:
    rows = t.photos
    m = S.metric_scores(F.col("sharpness_score"), F.lit(0.5), F.lit(0.0), F.lit(0.1), F.col("color_score"), F.col("width") * F.col("height") / 1e6)
    return rows.select("id", *[F.round(m[f"{c}_score"], 6).alias(c) for c in ("sharpness", "color", "resolution")])


@query("SELECT id, array_to_string(list_filter(string_split(replace(relative_path, '/', '\\'), '\\'), lambda x: x NOT IN ('', '.')), '/') AS path FROM photos")
def scalar_safe_path(t: Tables) -> DataFrame:
    return t.photos.select("id", S.safe_path(F.regexp_replace("relative_path", "/", r"\\")).alias("path"))


# -- pages and reports -----------------------------------------------------------------


@query("SELECT id, relative_path, capture_at FROM photos WHERE active AND capture_at >= '2024-01-01' AND capture_at < '2025-01-01' AND face_count > 0 AND relative_path ILIKE '%20%' ORDER BY capture_at DESC NULLS LAST, id DESC LIMIT 60 OFFSET 0")
def library_page(t: Tables) -> DataFrame:
    rows = B.library(t.photos, year=2024, faces=True, text="20")
    return B.page(B.newest_first(rows.select("id", "relative_path", "capture_at")), 1, 60)


@query("SELECT id FROM photos WHERE active AND latitude IS NOT NULL AND longitude IS NOT NULL")
def library_located(t: Tables) -> DataFrame:
    return B.library(t.photos, located=True).select("id")


@query("SELECT year(capture_at)::INTEGER AS year, count(*) AS n FROM photos WHERE active AND capture_at IS NOT NULL GROUP BY 1")
def library_years(t: Tables) -> DataFrame:
    return B.histogram(t.photos.filter("active and capture_at is not null").withColumn("year", F.year("capture_at")), "year").orderBy(F.desc("year"))


@query(
    """SELECT (SELECT count(*) FROM photos WHERE active) AS photos, (SELECT count(*) FROM photos WHERE active AND analysis_status = 'done') AS done, (SELECT count(*) FROM photos WHERE active AND face_count > 0) AS with_faces,
(SELECT count(*) FROM photos WHERE active AND latitude IS NOT NULL AND longitude IS NOT NULL) AS located, (SELECT count(*) FROM collections WHERE status <> 'hidden') AS collections, (SELECT count(*) FROM collection_photos WHERE decision = 'keep') AS kept"""
)
def library_counts(t: Tables) -> DataFrame:
    return B.dashboard(t.photos, t.collections, t.collection_photos)


@query("SELECT analysis_status, count(*) AS n FROM photos WHERE active GROUP BY 1")
def status_histogram(t: Tables) -> DataFrame:
    return B.histogram(t.photos.filter("active"), "analysis_status")


@query(
    """WITH p AS (SELECT id, capture_at, coalesce(strftime(capture_at, '%Y-%m'), 'unknown') AS section, row_number() OVER (ORDER BY capture_at DESC NULLS LAST, id DESC) AS k FROM photos WHERE active ORDER BY k LIMIT 120),
o AS (SELECT *, CASE WHEN lag(section) OVER (ORDER BY k) = section THEN 0 ELSE 1 END AS o FROM p) SELECT id, section, (sum(o) OVER (ORDER BY k))::BIGINT AS section_no FROM o"""
)
def date_sections(t: Tables) -> DataFrame:
    rows = B.page(B.newest_first(t.photos.filter("active").select("id", "capture_at")), 1, 120)
    return B.date_sections(rows).select("id", "section", "section_no")


@query("SELECT id, title, starts_at, ends_at FROM collections WHERE status <> 'hidden' ORDER BY coalesce(ends_at, starts_at) DESC NULLS LAST, starts_at DESC NULLS LAST, id DESC LIMIT 60")
def collections_page(t: Tables) -> DataFrame:
    return B.page(B.shelf(t.collections).select("id", "title", "starts_at", "ends_at").orderBy(*B.collection_order()), 1, 60)


@query("SELECT DISTINCT kind FROM collections")
def collection_kinds(t: Tables) -> DataFrame:
    return t.collections.select("kind").distinct()


@query("SELECT collection_id, count(*) AS total, count(*) FILTER (WHERE decision = 'keep') AS kept, count(*) FILTER (WHERE decision = 'reject') AS rejected FROM collection_photos GROUP BY 1")
def collection_decision_counts(t: Tables) -> DataFrame:
    return B.link_counts(t.collection_photos)


@query(
    """WITH p AS (SELECT id FROM collections WHERE status <> 'hidden' ORDER BY coalesce(ends_at, starts_at) DESC NULLS LAST, starts_at DESC NULLS LAST, id DESC LIMIT 60)
SELECT collection_id, count(*) AS total, count(*) FILTER (WHERE decision = 'keep') AS kept, count(*) FILTER (WHERE decision = 'reject') AS rejected FROM collection_photos WHERE collection_id IN (SELECT id FROM p) GROUP BY 1"""
)
def collection_page_counts(t: Tables) -> DataFrame:
    page = B.page(B.shelf(t.collections).orderBy(*B.collection_order()), 1, 60).select(F.col("id").alias("collection_id"))
    return B.link_counts(t.collection_photos.join(page, "collection_id", "left_semi"))


@query("SELECT collection_id, decision, count(*) AS n FROM collection_photos WHERE decision IS NOT NULL GROUP BY 1, 2")
def collection_decision_map(t: Tables) -> DataFrame:
    return B.decision_map(t.collection_photos).select("collection_id", F.explode("decisions").alias("decision", "n"))


@query("SELECT c.id AS link_id, c.photo_id, rank_no, decision, relative_path, capture_at FROM collection_photos c JOIN photos p ON p.id = c.photo_id WHERE collection_id = 1 AND decision = 'keep'")
def collection_timeline(t: Tables) -> DataFrame:
    return B.timeline(t.collection_photos, t.photos, 1, "keep")


@query(
    """WITH g AS (SELECT c.rank_no AS rank, decision, relative_path, strftime(capture_at, '%Y-%m-%dT%H:%M:%S') AS ct, quality_score AS q, place_city, reason, note FROM collection_photos c JOIN photos p ON p.id = c.photo_id WHERE collection_id = 1 AND coalesce(decision, 'pending') <> 'reject')
SELECT rank, decision, relative_path, coalesce(ct, '') AS capture_time, CASE WHEN q IS NULL OR isnan(q) THEN '' ELSE printf('%.4f', q) END AS quality_score, coalesce(place_city, '') AS place,
CASE WHEN regexp_matches(reason, '^[=+\\-@\\t\\r]') THEN '''' || reason ELSE coalesce(reason, '') END AS reason, CASE WHEN regexp_matches(note, '^[=+\\-@\\t\\r]') THEN '''' || note ELSE coalesce(note, '') END AS note FROM g"""
)
def manifest(t: Tables) -> DataFrame:
    return B.manifest(t.collection_photos, t.photos, 1)


@query(
    """WITH n AS (SELECT * FROM collection_photos WHERE collection_id = 1 AND photo_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY id DESC) = 1),
k AS (SELECT *, row_number() OVER (ORDER BY rank_no NULLS FIRST, id) AS k FROM n) SELECT id, collection_id, photo_id, rank_no, CASE WHEN k <= 30 AND decision = 'pending' THEN 'keep' ELSE decision END AS decision FROM k"""
)
def keep_top(t: Tables) -> DataFrame:
    return K.keep_top(t.collection_photos, 1, 30)


@query("SELECT p.id, f.id AS face_id, c.collection_id FROM photos p LEFT JOIN faces f ON f.photo_id = p.id LEFT JOIN collection_photos c ON c.photo_id = p.id")
def photo_detail(t: Tables) -> DataFrame:
    p = t.photos.select("id")
    faces = t.faces.select(F.col("photo_id").alias("id"), F.col("id").alias("face_id"))
    return p.join(faces, "id", "left").join(t.collection_photos.select(F.col("photo_id").alias("id"), "collection_id"), "id", "left")


@query("SELECT id, analysis_status, analysis_attempts, CASE WHEN length(e) > 800 THEN substr(e, 1, 799) || '…' ELSE e END AS error FROM (SELECT *, trim(regexp_replace(analysis_error, '\\s+', ' ', 'g')) AS e FROM photos WHERE active AND analysis_status IN ('error', 'unsupported', 'too_large', 'pending', 'analyzing') ORDER BY id DESC LIMIT 50)")
def issues_page(t: Tables) -> DataFrame:
    return B.issues(t.photos)


@query("SELECT id, CASE WHEN file_hash IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY file_hash) - 1 END AS copies FROM photos")
def duplicate_count(t: Tables) -> DataFrame:
    return B.copies(t.photos)


@query(
    """SELECT p.id, CASE WHEN file_hash IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY file_hash) - 1 END AS copies, coalesce(f.n, 0) AS faces, coalesce(f.c, 0) AS clusters, coalesce(k.n, 0) AS links
FROM photos p LEFT JOIN (SELECT photo_id, count(*) AS n, count(DISTINCT cluster_id) AS c FROM faces GROUP BY 1) f ON f.photo_id = p.id LEFT JOIN (SELECT photo_id, count(*) AS n FROM collection_photos GROUP BY 1) k ON k.photo_id = p.id"""
)
def photo_diagnostics(t: Tables) -> DataFrame:
    return B.diagnostics(t.photos, t.faces, t.collection_photos)


@query(
    f"""SELECT id, kind, status, phase, CASE WHEN progress_total > 0 THEN round_even(progress_current * 100.0::DOUBLE / progress_total, 1) END AS percent, strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') AS created,
greatest(0, (epoch({_SQL_NOW}) - epoch(coalesce(heartbeat_at, started_at, created_at)))::BIGINT) AS silent_s, error FROM jobs"""
)
def job_report(t: Tables) -> DataFrame:
    return B.job_report(t.jobs, F.lit(NOW))


@query("SELECT max(created_at) AS latest FROM jobs WHERE kind IN ('full', 'scan')")
def latest_attempt(t: Tables) -> DataFrame:
    return t.jobs.filter("kind in ('full', 'scan')").agg(F.max("created_at").alias("latest"))


@query(f"SELECT (SELECT count(*) FROM jobs WHERE status IN ('queued', 'running')) = 0 AND (SELECT max(created_at) FROM jobs WHERE kind IN ('full', 'scan')) <= {_SQL_NOW} - INTERVAL 24 HOUR AS due")
def scan_due(t: Tables) -> DataFrame:
    return I.scan_due(t.jobs, F.lit(None).cast("timestamp_ntz"), F.lit(NOW).cast("timestamp_ntz"), 24)


@query(
    f"""WITH a AS (SELECT 'face_without_photo' AS code, 'error' AS severity, count(*) AS n FROM faces WHERE photo_id IS NOT NULL AND photo_id NOT IN (SELECT id FROM photos)
UNION ALL SELECT 'link_without_photo', 'error', count(*) FROM collection_photos WHERE photo_id IS NOT NULL AND photo_id NOT IN (SELECT id FROM photos)
UNION ALL SELECT 'link_without_collection', 'error', count(*) FROM collection_photos WHERE collection_id IS NOT NULL AND collection_id NOT IN (SELECT id FROM collections)
UNION ALL SELECT 'cover_without_photo', 'error', count(*) FROM collections WHERE cover_photo_id IS NOT NULL AND cover_photo_id NOT IN (SELECT id FROM photos)
UNION ALL SELECT 'stale_job', 'warning', count(*) FROM jobs WHERE status IN ('queued', 'running') AND coalesce(heartbeat_at, started_at, created_at) < {_SQL_NOW} - INTERVAL 300 SECOND
UNION ALL SELECT 'photo_errors', 'warning', count(*) FROM photos WHERE active AND analysis_status IN ('error', 'unsupported', 'too_large'))
SELECT * FROM a WHERE n > 0 UNION ALL SELECT 'healthy', 'ok', 0 WHERE (SELECT sum(n) FROM a) = 0"""
)
def audit(t: Tables) -> DataFrame:
    return B.audit(t.photos, t.faces, t.collections, t.collection_photos, t.jobs, F.lit(NOW).cast("timestamp_ntz"))


@query(
    """WITH f AS (SELECT 'thumbs/' || substr(sha1(relative_path), 1, 2) || '/' || sha1(relative_path) || '.jpg' AS path FROM photos)
SELECT id, 'previews/' || substr(sha1(relative_path), 1, 2) || '/' || sha1(relative_path) || '.jpg' AS path FROM photos WHERE active AND analysis_status = 'done'"""
)
def missing_derivatives(t: Tables) -> DataFrame:
    """All thumbnails are there, no previews."""
    return B.missing_derivatives(t.photos, t.photos.select(S.cache_path("relative_path").alias("path")))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line FROM documents WHERE source = 'job_log')
SELECT doc_id, TRY_CAST(regexp_extract(line, '^(\\S+)Z ', 1) AS TIMESTAMP) AS logged_at, regexp_extract(line, '^\\S+ ([A-Z]+) ', 1) AS level, regexp_extract(line, '^\\S+ [A-Z]+ (.*)$', 1) AS message FROM l
WHERE regexp_matches(line, '^\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ (WARN|ERROR) .*$')"""
)
def diagnostic_logs(t: Tables) -> DataFrame:
    return B.log_lines(t.documents.filter("source = 'job_log'").select("doc_id", "text"), least="WARN").orderBy(F.desc("logged_at"))


_SQL_CITIES = "cities AS (SELECT place_city AS city, round(avg(latitude), 3) AS ca, round(avg(longitude), 3) AS co FROM photos WHERE place_city IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT isnan(latitude) AND NOT isnan(longitude) GROUP BY 1)"


@query(
    f"""WITH {_SQL_CITIES}, p AS (SELECT id, latitude, longitude, round_even(latitude, 2) AS x, round_even(longitude, 2) AS y FROM photos WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT isnan(latitude) AND NOT isnan(longitude)),
first AS (SELECT x, y, arg_min(latitude, id) AS la, arg_min(longitude, id) AS lo FROM p GROUP BY 1, 2),
best AS (SELECT x, y, city FROM first, cities QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY {sql_haversine('la', 'lo', 'ca', 'co')}, city) = 1)
SELECT id, city FROM p JOIN best USING (x, y)"""
)
def reverse_geocode(t: Tables) -> DataFrame:
    """The gazetteer is made of the photos' own cities, at their mean position."""
    ok = t.photos.filter("latitude between -90 and 90 and longitude between -180 and 180 and not isnan(latitude) and not isnan(longitude)")
    cities = ok.filter("place_city is not null").groupBy(F.col("place_city").alias("city")).agg(F.round(F.avg("latitude"), 3).alias("latitude"), F.round(F.avg("longitude"), 3).alias("longitude"))
    return B.nearest_city(t.photos, cities)


@query(
    """SELECT 'photos' AS what, analysis_status AS value, count(*) AS n FROM photos WHERE active GROUP BY 2 UNION ALL SELECT 'collections', status, count(*) FROM collections GROUP BY 2
UNION ALL SELECT 'links', decision, count(*) FROM collection_photos GROUP BY 2 UNION ALL SELECT 'jobs', status, count(*) FROM jobs GROUP BY 2"""
)
def overview(t: Tables) -> DataFrame:
    return B.overview(t.photos, t.collections, t.collection_photos, t.jobs)


@query("SELECT id, to_json({'id': id, 'relative_path': relative_path, 'width': width, 'height': height, 'place': nullif(place_city, ''), 'capture_at': strftime(capture_at, '%Y-%m-%dT%H:%M:%S')})::VARCHAR AS json FROM photos")
def photo_json(t: Tables) -> DataFrame:
    return B.photo_json(t.photos)


@query("SELECT id, kind, status FROM jobs WHERE status IN ('completed', 'failed') AND id < 15 ORDER BY id DESC LIMIT 5")
def jobs_page(t: Tables) -> DataFrame:
    return B.page_after(t.jobs.filter("status in ('completed', 'failed')").select("id", "kind", "status"), 15, 5)


@query("SELECT id, kind FROM jobs WHERE status IN ('running', 'queued') ORDER BY created_at, id LIMIT 1")
def job_claim(t: Tables) -> DataFrame:
    """After a restart: the running job is queued again and claimed."""
    return I.claim(I.recover(t.photos, t.jobs)[1]).select("id", "kind")


@query("SELECT id, CASE WHEN face_count > 2 THEN 5 ELSE manual_rating END AS manual_rating FROM photos")
def rate_photos(t: Tables) -> DataFrame:
    return K.rate(t.photos, t.photos.filter("face_count > 2").select("id", F.lit(5).alias("rating"))).select("id", "manual_rating")


@query("SELECT id, CASE WHEN score > 0.8 THEN 'keep' ELSE decision END AS decision, CASE WHEN score > 0.8 THEN 'best' ELSE note END AS note FROM collection_photos")
def decide_links(t: Tables) -> DataFrame:
    changes = t.collection_photos.filter("score > 0.8").select("id", F.lit("keep").alias("decision"), F.lit("best").alias("note"))
    return K.decide(t.collection_photos, changes).select("id", "decision", "note")


@query("SELECT id, CASE WHEN kind = 'event' THEN trim('My ' || coalesce(title, 'own')) ELSE title END AS title, CASE WHEN kind = 'event' THEN false ELSE automatic END AS automatic FROM collections")
def rename_collections(t: Tables) -> DataFrame:
    changes = t.collections.filter("kind = 'event'").select("id", F.concat(F.lit("My "), F.coalesce("title", F.lit("own"))).alias("title"))
    return K.rename_collections(t.collections, changes).select("id", "title", "automatic")


# -- inventory -------------------------------------------------------------------------


@query("SELECT id, capture_at FROM photos WHERE active AND (analysis_status IN ('pending', 'error', 'analyzing') OR analysis_version < 1) AND analysis_attempts < 3")
def analysis_queue(t: Tables) -> DataFrame:
    return I.analysis_queue(t.photos).select("id", "capture_at")


_TOKEN = "(SELECT scan_token FROM jobs WHERE status = 'completed' AND scan_token IS NOT NULL ORDER BY finished_at DESC LIMIT 1)"
_LISTED = f"l AS (SELECT * FROM scan_entries WHERE relative_path IS NOT NULL AND scan_token = {_TOKEN} QUALIFY row_number() OVER (PARTITION BY relative_path ORDER BY listed_at DESC NULLS LAST, entry_id DESC) = 1)"


def _last_token(t: Tables) -> str | None:
    row = t.jobs.filter("status = 'completed' and scan_token is not null").orderBy(F.desc("finished_at")).select("scan_token").first()
    return row[0] if row else None


@query(
    f"""WITH {_LISTED}, b AS (SELECT coalesce(l.relative_path, p.relative_path) AS relative_path, l.relative_path IS NOT NULL AS seen, p.relative_path IS NOT NULL AS known, l.size_bytes AS ls, l.source_mtime AS lm, l.scan_token AS lt, p.* EXCLUDE (relative_path) FROM photos p FULL JOIN l ON l.relative_path = p.relative_path),
c AS (SELECT *, seen AND (NOT known OR ls IS DISTINCT FROM size_bytes OR coalesce(abs(lm - source_mtime) > 0.001, lm IS DISTINCT FROM source_mtime)) AS again FROM b)
SELECT relative_path, CASE WHEN seen THEN ls ELSE size_bytes END AS size_bytes, seen OR active AS active, CASE WHEN seen THEN lt ELSE scan_token END AS scan_token, CASE WHEN again THEN 'pending' ELSE analysis_status END AS analysis_status,
CASE WHEN again THEN 0 ELSE analysis_version END AS analysis_version, CASE WHEN again THEN 0 ELSE analysis_attempts END AS analysis_attempts FROM c"""
)
def scan_upsert(t: Tables) -> DataFrame:
    out = I.upsert_inventory(t.photos, I.latest_listing(t.scan_entries, _last_token(t)))
    return out.select("relative_path", "size_bytes", "active", "scan_token", "analysis_status", "analysis_version", "analysis_attempts")


@query(f"SELECT id, active AND coalesce(scan_token = {_TOKEN}, false) AS active FROM photos")
def deactivate_unseen(t: Tables) -> DataFrame:
    return I.deactivate_unseen(t.photos, _last_token(t)).select("id", "active")


@query("SELECT id, CASE WHEN active AND analysis_status = 'error' THEN 'pending' ELSE analysis_status END AS analysis_status, CASE WHEN active AND analysis_status = 'error' THEN 0 ELSE analysis_attempts END AS analysis_attempts FROM photos")
def retry_errors(t: Tables) -> DataFrame:
    return I.retry_errors(t.photos).select("id", "analysis_status", "analysis_attempts")


@query("SELECT id, CASE WHEN status = 'running' THEN 'queued' ELSE status END AS status FROM jobs")
def recover_jobs(t: Tables) -> DataFrame:
    return I.recover(t.photos, t.jobs)[1].select("id", "status")


_WANTED = """e AS (SELECT id, capture_at FROM photos WHERE active AND analysis_status = 'done'),
ol AS (SELECT * FROM collection_photos WHERE collection_id IS NOT NULL AND photo_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY collection_id, photo_id ORDER BY id DESC) = 1),
nl AS (SELECT c.collection_key, c.id AS collection_id, l.photo_id, row_number() OVER (PARTITION BY c.id ORDER BY l.photo_id) AS rank_no FROM ol l JOIN collections c ON c.id = l.collection_id JOIN e ON e.id = l.photo_id WHERE c.algorithm_version = 2),
nc AS (SELECT c.collection_key, c.id, upper(c.title) AS title, min(e.capture_at) AS s, max(e.capture_at) AS z FROM nl JOIN collections c ON c.id = nl.collection_id JOIN e ON e.id = nl.photo_id GROUP BY 1, 2, 3),
d AS (SELECT * FROM ol WHERE coalesce(decision, 'pending') <> 'pending' OR coalesce(note, '') <> ''),
kept AS (SELECT d.id, d.collection_id, d.photo_id, coalesce(n.size, 0) + row_number() OVER (PARTITION BY d.collection_id ORDER BY d.id) AS rank_no, d.decision FROM d JOIN nc ON nc.id = d.collection_id
  LEFT JOIN (SELECT collection_id, count(*) AS size FROM nl GROUP BY 1) n ON n.collection_id = d.collection_id WHERE NOT EXISTS (SELECT 1 FROM nl WHERE nl.collection_id = d.collection_id AND nl.photo_id = d.photo_id)),
gone AS (SELECT * FROM collections c WHERE id NOT IN (SELECT id FROM nc) AND (NOT automatic OR status <> 'unreviewed' OR id IN (SELECT collection_id FROM d)))"""


def _suggested(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A rebuild as after photos have gone: version 2 collections with what is left of them."""
    left = t.photos.filter("active and analysis_status = 'done'").select(F.col("id").alias("photo_id"), "capture_at")
    c = t.collections.filter("algorithm_version = 2").select(F.col("id").alias("collection_id"), "collection_key", "kind", "title", "cover_photo_id")
    links = K.newest_links(t.collection_photos).select("collection_id", "photo_id").join(left, "photo_id").join(c, "collection_id")
    new = links.groupBy("collection_key", "kind", F.upper("title").alias("title"), "cover_photo_id").agg(F.min("capture_at").alias("starts_at"), F.max("capture_at").alias("ends_at"))
    new = new.withColumns({"description": F.lit("Rebuilt."), "score": F.lit(0.5)})
    placed = global_positions(links.select("collection_key", "photo_id"), ["collection_key"], [F.col("photo_id")], [], "rank_no", "_tie")
    return new, placed.select("collection_key", "photo_id", F.col("rank_no").cast("int").alias("rank_no"), F.lit(0.5).alias("score"), F.lit("left").alias("reason"))


@query(
    f"""WITH {_WANTED}, span AS (SELECT k.collection_id, min(p.capture_at) AS s, max(p.capture_at) AS z FROM kept k JOIN photos p ON p.id = k.photo_id GROUP BY 1)
SELECT c.id, CASE WHEN c.automatic THEN nc.title ELSE c.title END AS title, c.status, least(nc.s, span.s) AS starts_at, greatest(nc.z, span.z) AS ends_at, 2 AS algorithm_version FROM nc JOIN collections c ON c.id = nc.id LEFT JOIN span ON span.collection_id = c.id
UNION ALL SELECT id, title, status, starts_at, ends_at, algorithm_version FROM gone"""
)
def rebuild_collections(t: Tables) -> DataFrame:
    return K.rebuild(t.collections, t.collection_photos, *_suggested(t), t.photos)[0].select("id", "title", "status", "starts_at", "ends_at", "algorithm_version")


@query(
    f"""WITH {_WANTED} SELECT ol.id, nl.collection_id, nl.photo_id, nl.rank_no::INTEGER AS rank_no, ol.decision FROM nl JOIN ol ON ol.collection_id = nl.collection_id AND ol.photo_id = nl.photo_id
UNION ALL SELECT id, collection_id, photo_id, rank_no::INTEGER, decision FROM kept UNION ALL SELECT id, collection_id, photo_id, rank_no, decision FROM ol WHERE collection_id IN (SELECT id FROM gone)"""
)
def rebuild_links(t: Tables) -> DataFrame:
    return K.rebuild(t.collections, t.collection_photos, *_suggested(t), t.photos)[1].select("id", "collection_id", "photo_id", "rank_no", "decision")


def _here(t: Tables) -> tuple[str, Settings]:
    """The folder of the tables as a source, whose supported files are the tables'."""
    return t.folder, Settings(supported_extensions=(".parquet",))


@query()
def source_listing(t: Tables) -> DataFrame:
    return list_photos(t.spark, *_here(t)).select("relative_path", "file_name", "extension", "size_bytes", "warning")


@query()
def source_hashes(t: Tables) -> DataFrame:
    return hashed_contents(t.spark, *_here(t))


@query()
def source_statistics(t: Tables) -> DataFrame:
    return path_statistics(t.spark, t.folder)
