"""The inventory: scans, the analysis queue, and what analysis writes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.config import Settings

UNFINISHED = ["pending", "error", "analyzing"]


def changed(size: Column, mtime: Column, new_size: Column, new_mtime: Column, tolerance: float = 0.001) -> Column:
    """Whether size or modification time differ; null differs from any value."""
    apart = F.abs(mtime - new_mtime) > tolerance
    return ~size.eqNullSafe(new_size) | F.coalesce(apart, ~mtime.eqNullSafe(new_mtime))


def latest_listing(entries: DataFrame, token: str | None = None) -> DataFrame:
    """Of each path the row listed last (then the highest entry), of one scan or of all."""
    rows = entries.filter("relative_path is not null")
    if token is not None:
        rows = rows.filter(F.col("scan_token") == token)
    last = F.max(F.struct("listed_at", "entry_id", "file_name", "size_bytes", "source_mtime", "scan_token")).alias("e")
    return rows.groupBy("relative_path").agg(last).select("relative_path", "e.file_name", "e.size_bytes", "e.source_mtime", "e.scan_token")


def extension_of(name: Column) -> Column:
    """Lower-cased suffix with its dot; empty without one."""
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def upsert_inventory(photos: DataFrame, listing: DataFrame) -> DataFrame:
    """``relative_path, file_name, extension, size_bytes, source_mtime, active, scan_token,
    analysis_status, analysis_version, analysis_attempts, analysis_error`` after a scan.

    New paths are pending; changed files are to be analysed again; seen ones are active and
    carry the scan's token; others stay as they are. ``listing`` has a path once.
    """
    old = photos.filter("relative_path is not null").select(
        "relative_path", *[F.col(c).alias(f"_{c}") for c in ("file_name", "extension", "size_bytes", "source_mtime", "active", "scan_token", "analysis_status", "analysis_version", "analysis_attempts", "analysis_error")],
        F.lit(True).alias("_known"),
    )
    new = listing.withColumn("_seen", F.lit(True))
    both = old.join(new, "relative_path", "full")
    seen, known = F.col("_seen").isNotNull(), F.col("_known").isNotNull()
    again = seen & (~known | changed(F.col("_size_bytes"), F.col("_source_mtime"), F.col("size_bytes"), F.col("source_mtime")))
    pick = lambda c: F.when(seen, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    reset = lambda c, v: F.when(again, F.lit(v)).otherwise(F.col(f"_{c}")).alias(c)
    return both.select(
        "relative_path", pick("file_name"), F.when(seen, extension_of(F.col("file_name"))).otherwise(F.col("_extension")).alias("extension"), pick("size_bytes"), pick("source_mtime"),
        F.when(seen, True).otherwise(F.col("_active")).alias("active"), pick("scan_token"), reset("analysis_status", "pending"), reset("analysis_version", 0), reset("analysis_attempts", 0), reset("analysis_error", None),
    )


def deactivate_unseen(photos: DataFrame, token: str, warnings: int = 0, limited: bool = False) -> DataFrame:
    """Photos not seen by a scan become inactive, but only if it was clean and complete."""
    if warnings or limited:
        return photos
    return photos.withColumn("active", F.col("active") & F.coalesce(F.col("scan_token") == token, F.lit(False)))


def analysis_queue(photos: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Active photos that are unfinished or of an older version and have attempts left; undated first, then by id."""
    due = F.col("active") & (F.col("analysis_status").isin(UNFINISHED) | (F.col("analysis_version") < settings.analysis_version)) & (F.col("analysis_attempts") < settings.max_analysis_attempts)
    return photos.filter(due).orderBy(F.col("capture_at").isNull().desc(), "id")


def recover(photos: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a crash: photos being analysed are errors, running jobs are queued again."""
    stuck = F.col("analysis_status") == "analyzing"
    photos = photos.withColumns({"analysis_error": F.when(stuck, "Interrupted").otherwise(F.col("analysis_error")), "analysis_status": F.when(stuck, "error").otherwise(F.col("analysis_status"))})
    return photos, jobs.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def retry_errors(photos: DataFrame) -> DataFrame:
    """Active photos in error are pending again, without attempts and error."""
    hit = F.coalesce(F.col("active") & (F.col("analysis_status") == "error"), F.lit(False))
    return photos.withColumns({
        "analysis_attempts": F.when(hit, 0).otherwise(F.col("analysis_attempts")), "analysis_error": F.when(~hit, F.col("analysis_error")),
        "analysis_status": F.when(hit, "pending").otherwise(F.col("analysis_status")),
    })


def write_back(photos: DataFrame, faces: DataFrame, results: DataFrame, new_faces: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Photos and faces after analysis.

    ``results`` has ``photo_id, outcome`` (done, error, unsupported, too_large), ``error`` and ``file_hash``. A
    photo done has no attempts; unsupported and too large ones carry the version so that they aren't tried
    again; too large ones cost no attempt. All faces of a photo done are replaced by ``new_faces``.
    """
    r = results.dropDuplicates(["photo_id"]).select(F.col("photo_id").alias("id"), "outcome", F.col("error").alias("_error"), F.col("file_hash").alias("_hash"))
    done, final = F.col("outcome") == "done", F.col("outcome").isin("done", "unsupported", "too_large")
    has = F.col("outcome").isNotNull()
    out = photos.join(r, "id", "left").withColumns({
        "analysis_status": F.coalesce("outcome", "analysis_status"), "analysis_version": F.when(final, settings.analysis_version).otherwise(F.col("analysis_version")),
        "analysis_attempts": F.when(done, 0).when(F.col("outcome").isin("error", "unsupported"), F.col("analysis_attempts") + 1).otherwise(F.col("analysis_attempts")),
        "analysis_error": F.when(has, F.col("_error")).otherwise(F.col("analysis_error")), "file_hash": F.when(done, F.col("_hash")).otherwise(F.col("file_hash")),
    }).select(photos.columns)
    finished = r.filter(done).select(F.col("id").alias("photo_id"))
    kept = faces.join(finished, "photo_id", "left_anti")
    return out, kept.unionByName(new_faces.join(finished, "photo_id", "left_semi"), allowMissingColumns=True).select(faces.columns)


def enqueue(jobs: list[dict], kind: str) -> int | None:
    """Id of the active job that absorbs a request of ``kind``, or None if a new one is due.

    A full request is absorbed by a full job only, others by their own kind or a full job.
    """
    if kind not in {"full", "scan", "analyze", "collections"}:
        raise ValueError(f"unknown job kind: {kind}")
    takers = {"full"} if kind == "full" else {kind, "full"}
    active = [j for j in jobs if j["status"] in ("queued", "running") and j["kind"] in takers]
    return min(active, key=lambda j: (j["created_at"], j["id"]))["id"] if active else None


def claim(jobs: DataFrame) -> DataFrame:
    """The queued job that was created first."""
    return jobs.filter("status = 'queued'").orderBy("created_at", "id").limit(1)


def scan_due(jobs: DataFrame, last_success: Column, now: Column, hours: float) -> DataFrame:
    """``due``: whether a periodic scan is: none active, and the last success or attempt long enough ago."""
    attempt = F.max(F.when(F.col("kind").isin("full", "scan"), F.col("created_at")))
    active = F.count_if(F.col("status").isin("queued", "running"))
    latest = F.greatest(attempt, last_success)
    old = F.coalesce(F.timestamp_diff("SECOND", latest, now) >= int(hours * 3600), F.lit(True))
    return jobs.agg(((active == 0) & F.lit(hours > 0) & old).alias("due"))
