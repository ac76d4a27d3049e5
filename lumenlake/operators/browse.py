"""Pages, counts and reports over the library."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions import scalars as S

#: States that need attention, and what a collection can be.
ISSUES = ["error", "unsupported", "too_large", "pending", "analyzing"]


def optional_bool(text: str | None) -> bool | None:
    """No filter for nothing, else true or false in any case."""
    if text in (None, ""):
        return None
    if text.casefold() not in ("true", "false"):
        raise ValueError("true or false is expected")
    return text.casefold() == "true"


def optional_year(text: str | None) -> int | None:
    if text in (None, ""):
        return None
    year = int(text)
    if not 1900 <= year <= 9998:
        raise ValueError("year is outside the supported range")
    return year


def library(photos: DataFrame, year: int | None = None, faces: bool | None = None, located: bool | None = None, text: str | None = None) -> DataFrame:
    """Active photos, filtered; ``text`` is looked for in path, city and camera without case, with LIKE's wildcards."""
    out = photos.filter("active")
    if year is not None:
        if not 1900 <= year <= 9998:
            raise ValueError("year is outside the supported range")
        out = out.filter((F.col("capture_at") >= F.make_timestamp_ntz(F.lit(year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))) & (F.col("capture_at") < F.make_timestamp_ntz(F.lit(year + 1), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))))
    if faces is not None:
        out = out.filter(F.col("face_count") > 0 if faces else F.col("face_count") == 0)
    if located is not None:
        both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        out = out.filter(both if located else ~both)
    if text:
        hit = F.lit(False)
        for c in ("relative_path", "place_city", "place_country", "camera_model"):
            if c in photos.columns:
                hit |= F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
        out = out.filter(hit)
    return out


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("capture_at").desc_nulls_last(), F.desc("id"))


def page(ordered: DataFrame, number: int, size: int) -> DataFrame:
    """One page of an ordered table, counted from 1."""
    return ordered.offset((max(1, number) - 1) * size).limit(size)


def page_after(rows: DataFrame, before_id: int | None, size: int) -> DataFrame:
    """The next rows in falling order of id."""
    return (rows if before_id is None else rows.filter(F.col("id") < before_id)).orderBy(F.desc("id")).limit(size)


def collection_order() -> list[Column]:
    return [F.coalesce("ends_at", "starts_at").desc_nulls_last(), F.col("starts_at").desc_nulls_last(), F.desc("id")]


def shelf(collections: DataFrame, kind: str | None = None, status: str | None = None) -> DataFrame:
    """Collections of a kind and status; all but hidden ones without a status."""
    out = collections if kind is None else collections.filter(F.col("kind") == kind)
    return out.filter(F.col("status") == status) if status else out.filter("status != 'hidden'")


def dashboard(photos: DataFrame, collections: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts, each table read once."""
    places = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    p = photos.filter("active").agg(F.count("*").alias("photos"), F.count_if(F.col("analysis_status") == "done").alias("done"), F.count_if(F.col("face_count") > 0).alias("with_faces"), F.count_if(places).alias("located"))
    c = collections.filter("status != 'hidden'").agg(F.count("*").alias("collections"))
    k = links.filter("decision = 'keep'").agg(F.count("*").alias("kept"))
    rows = p.unionByName(c, allowMissingColumns=True).unionByName(k, allowMissingColumns=True)  # one row each
    return rows.agg(*[F.max(x).alias(x) for x in ("photos", "done", "with_faces", "located", "collections", "kept")])


def histogram(rows: DataFrame, column: str, count: str = "n") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias(count))


def overview(photos: DataFrame, collections: DataFrame, links: DataFrame, jobs: DataFrame) -> DataFrame:
    """``what, value, n``: states of photos, collections, links and jobs."""
    parts = [("photos", photos.filter("active"), "analysis_status"), ("collections", collections, "status"), ("links", links, "decision"), ("jobs", jobs, "status")]
    out = None
    for what, rows, column in parts:
        h = histogram(rows, column).select(F.lit(what).alias("what"), F.col(column).alias("value"), "n")
        out = h if out is None else out.unionByName(h)
    return out


def photo_json(photos: DataFrame) -> DataFrame:
    """``id, json``: what is shown of a photo, with nulls written."""
    shown = F.struct("id", "relative_path", "width", "height", S.place_label().alias("place"), F.date_format("capture_at", "yyyy-MM-dd'T'HH:mm:ss").alias("capture_at"))
    return photos.select("id", F.to_json(shown, {"ignoreNullFields": "false"}).alias("json"))


def link_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("collection_id").agg(F.count("*").alias("total"), F.count_if(F.col("decision") == "keep").alias("kept"), F.count_if(F.col("decision") == "reject").alias("rejected"))


def decision_map(links: DataFrame) -> DataFrame:
    """``collection_id, decisions``: counts by decision as a map."""
    counts = links.filter("decision is not null").groupBy("collection_id", "decision").agg(F.count("*").alias("n"))
    return counts.groupBy("collection_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("decision", "n")))).alias("decisions"))


def date_sections(ordered_page: DataFrame, by: str = "month") -> DataFrame:
    """A page's rows with the label of their month or year and the number of the run they are in.

    Runs, not groups: a label that comes again later opens a new section. A page is small,
    so its window has one partition.
    """
    label = F.coalesce(F.date_format("capture_at", "yyyy-MM" if by == "month" else "yyyy"), F.lit("unknown"))
    order = Window.orderBy(F.col("capture_at").desc_nulls_last(), F.desc("id"))
    rows = ordered_page.withColumn("section", label)
    opens = F.coalesce((F.lag("section").over(order) != F.col("section")).cast("int"), F.lit(1))
    return rows.withColumn("_o", opens).withColumn("section_no", F.sum("_o").over(order)).drop("_o")


def manifest(links: DataFrame, photos: DataFrame, collection: int) -> DataFrame:
    """What is handed out of a collection: links not rejected, by rank, guarded for spreadsheets."""
    mine = links.filter((F.col("collection_id") == collection) & (F.coalesce("decision", F.lit("pending")) != "reject"))
    country = "place_country" if "place_country" in photos.columns else None
    rows = mine.select("photo_id", "rank_no", "decision", "reason", "note").join(photos.select(F.col("id").alias("photo_id"), "relative_path", "capture_at", "quality_score", "place_city", *([country] if country else [])), "photo_id")
    quality = F.when(F.col("quality_score").isNotNull() & ~F.isnan("quality_score"), F.format_string("%.4f", "quality_score")).otherwise("")
    return rows.orderBy("rank_no", "photo_id").select(
        F.col("rank_no").alias("rank"), "decision", S.csv_guard("relative_path").alias("relative_path"), F.coalesce(F.date_format("capture_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("capture_time"),
        quality.alias("quality_score"), S.csv_guard(F.coalesce(S.place_label("place_city", country), F.lit(""))).alias("place"), S.csv_guard(F.coalesce("reason", F.lit(""))).alias("reason"), S.csv_guard(F.coalesce("note", F.lit(""))).alias("note"),
    )


def timeline(links: DataFrame, photos: DataFrame, collection: int, decision: str | None = None) -> DataFrame:
    """A collection's photos, newest first, with their links."""
    mine = links.filter(F.col("collection_id") == collection)
    if decision:
        mine = mine.filter(F.col("decision") == decision)
    rows = mine.select(F.col("id").alias("link_id"), "photo_id", "rank_no", "decision").join(photos.select(F.col("id").alias("photo_id"), "relative_path", "capture_at"), "photo_id")
    return rows.orderBy(F.col("capture_at").desc_nulls_last(), F.desc("photo_id"), F.desc("link_id"))


def issues(photos: DataFrame, status: str | None = None, before_id: int | None = None, size: int = 50) -> DataFrame:
    """A page of active photos that need attention."""
    if status is not None and status not in ISSUES:
        raise ValueError(f"unknown state: {status}")
    rows = photos.filter(F.col("active") & F.col("analysis_status").isin([status] if status else ISSUES))
    return page_after(rows, before_id, size).select("id", "analysis_status", "analysis_attempts", S.redacted("analysis_error").alias("error"))


def copies(photos: DataFrame) -> DataFrame:
    """``id, copies``: how many other photos have the same file hash; counted once, then joined."""
    n = photos.filter("file_hash is not null").groupBy("file_hash").agg((F.count("*") - 1).alias("copies"))
    return photos.select("id", "file_hash").join(n, "file_hash", "left").select("id", F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))


def diagnostics(photos: DataFrame, faces: DataFrame, links: DataFrame) -> DataFrame:
    """Per photo: copies, faces, distinct clusters and links."""
    f = faces.groupBy(F.col("photo_id").alias("id")).agg(F.count("*").alias("faces"), F.count_distinct("cluster_id").alias("clusters"))
    k = links.groupBy(F.col("photo_id").alias("id")).agg(F.count("*").alias("links"))
    return copies(photos).join(f, "id", "left").join(k, "id", "left").fillna(0, ["faces", "clusters", "links"])


def job_report(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs with percent and age of their last sign of life."""
    return jobs.select(
        "id", "kind", "status", "phase", S.progress_percent("progress_current", "progress_total").alias("percent"), S.iso_time("created_at").alias("created"),
        S.age_seconds(F.coalesce("heartbeat_at", "started_at", "created_at"), now).alias("silent_s"), S.redacted("error").alias("error"),
    )


def audit(photos: DataFrame, faces: DataFrame, collections: DataFrame, links: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Findings ``code, severity, n``: dangling references, silent jobs, photos with errors; healthy if none."""
    ids = photos.select(F.col("id").alias("photo_id"))
    found = [
        faces.filter("photo_id is not null").join(ids, "photo_id", "left_anti").agg(F.lit("face_without_photo").alias("code"), F.lit("error").alias("severity"), F.count("*").alias("n")),
        links.filter("photo_id is not null").join(ids, "photo_id", "left_anti").agg(F.lit("link_without_photo").alias("code"), F.lit("error").alias("severity"), F.count("*").alias("n")),
        links.filter("collection_id is not null").join(collections.select(F.col("id").alias("collection_id")), "collection_id", "left_anti").agg(F.lit("link_without_collection").alias("code"), F.lit("error").alias("severity"), F.count("*").alias("n")),
        collections.filter("cover_photo_id is not null").join(ids.withColumnRenamed("photo_id", "cover_photo_id"), "cover_photo_id", "left_anti").agg(F.lit("cover_without_photo").alias("code"), F.lit("error").alias("severity"), F.count("*").alias("n")),
        jobs.filter(F.col("status").isin("queued", "running") & (S.age_seconds(F.coalesce("heartbeat_at", "started_at", "created_at"), now) > 300)).agg(F.lit("stale_job").alias("code"), F.lit("warning").alias("severity"), F.count("*").alias("n")),
        photos.filter(F.col("active") & F.col("analysis_status").isin("error", "unsupported", "too_large")).agg(F.lit("photo_errors").alias("code"), F.lit("warning").alias("severity"), F.count("*").alias("n")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    healthy = out.agg(F.sum("n").alias("n")).filter("n = 0").select(F.lit("healthy").alias("code"), F.lit("ok").alias("severity"), F.lit(0).cast("long").alias("n"))
    return out.filter("n > 0").unionByName(healthy)


def missing_derivatives(photos: DataFrame, files: DataFrame) -> DataFrame:
    """``id, path`` of active analysed photos' thumbnails and previews that aren't among ``files`` (``path``)."""
    p = photos.filter("active and analysis_status = 'done'")
    due = p.select("id", F.explode(F.array(S.cache_path("relative_path", "thumbs"), S.cache_path("relative_path", "previews"))).alias("path"))
    return due.join(files.select("path"), "path", "left_anti").select("id", "path")


LEVELS = {"DEBUG": 10, "INFO": 20, "WARN": 30, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


def log_lines(texts: DataFrame, text: str = "text", least: str = "INFO") -> DataFrame:
    """Lines ``logged_at, level, message`` of log texts at or above a level; other lines are left out."""
    line = F.explode(F.split(text, "\r?\n")).alias("line")
    form = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)Z ([A-Z]+) (.*)$"
    rows = texts.select(*[c for c in texts.columns if c != text], line).filter(F.col("line").rlike(form))
    rows = rows.select(*[c for c in texts.columns if c != text], F.try_to_timestamp(F.regexp_extract("line", form, 1), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("logged_at"), F.regexp_extract("line", form, 2).alias("level"), F.regexp_extract("line", form, 3).alias("message"))
    wanted = [k for k, v in LEVELS.items() if v >= LEVELS[least]]
    return rows.filter(F.col("logged_at").isNotNull() & F.col("level").isin(wanted))


def nearest_city(photos: DataFrame, cities: DataFrame, places: int = 2) -> DataFrame:
    """``id, city``: each photo's nearest city, looked up once per cell of rounded coordinates.

    The first photo of a cell (by id) decides for the cell. ``cities`` (``city, latitude, longitude``) is a
    gazetteer of bounded size (checked: at most 100,000 rows) and goes to every executor.
    """
    known = cities.filter("city is not null").select("city", "latitude", "longitude").orderBy("city").limit(100_001).collect()
    if len(known) > 100_000:
        raise ValueError("the gazetteer is too large to look through for every cell")
    names = [c.city for c in known]
    at = np.radians(np.array([(c.latitude, c.longitude) for c in known], dtype=np.float64).reshape(-1, 2))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            la, lo = (np.radians(b.column(c).to_numpy()) for c in ("latitude", "longitude"))
            found = []
            for y, x in zip(la, lo, strict=True):
                h = np.sin((at[:, 0] - y) / 2) ** 2 + np.cos(y) * np.cos(at[:, 0]) * np.sin((at[:, 1] - x) / 2) ** 2
                found.append(names[int(np.argmin(h))] if names else None)
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(found, pa.string())], names=["x", "y", "city"])

    rows = photos.filter("latitude between -90 and 90 and longitude between -180 and 180 and not isnan(latitude) and not isnan(longitude)")
    cell = [F.bround("latitude", places).alias("x"), F.bround("longitude", places).alias("y")]
    cells = rows.groupBy(*cell).agg(F.min(F.struct("id", "latitude", "longitude")).alias("f"))
    best = cells.select("x", "y", "f.latitude", "f.longitude").mapInArrow(look_up, "x double, y double, city string")
    return rows.select("id", *cell).join(best, ["x", "y"]).select("id", "city")
