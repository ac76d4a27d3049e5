"""Queries of the general training-data problems: incremental processing and trips."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.operators.incremental import CommitLog, changed_files, run_increment
from lumenlake.operators.mobility import stops_and_trips
from lumenlake.shared import scratch


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    log = CommitLog(spark, scratch(spark, "log"))
    return changed_files(log, spark.read.parquet(f"{sf}/scan_entries.parquet"), spark.read.parquet(f"{sf}/photos.parquet"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf).select("relative_path")


def p1_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf).select("relative_path", "reason")


def p1_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Three windows of the listing with one log; a run that fails after writing lies between the first two."""
    log = CommitLog(spark, scratch(spark, "log"))
    entries, photos = spark.read.parquet(f"{sf}/scan_entries.parquet"), spark.read.parquet(f"{sf}/photos.parquet")
    top = entries.agg(F.max("entry_id")).first()[0] or 0

    def lost(rows: DataFrame, last: dict | None, write: Callable[..., DataFrame]) -> None:
        write("cases", rows.select("relative_path"))
        raise InterruptedError

    out = []
    for number, upper in enumerate((top // 3, top // 3 * 2, None), 1):
        out.append(changed_files(log, entries, photos, upper=upper).select(F.lit(number).alias("run"), "relative_path", "reason"))
        if number == 1:
            try:
                run_increment(log, entries, "entry_id", lost)
            except InterruptedError:
                pass
    return out[0].unionByName(out[1]).unionByName(out[2])


def p3_checks(spark: SparkSession, sf: str) -> DataFrame:
    """How many stops and trips break a rule that every one must keep."""
    rows = p3_stops_and_trips(spark, sf)
    stop, trip = F.col("kind") == "stop", F.col("kind") == "trip"
    rules = {
        "stop has three pings": stop & ~(F.col("pings") >= 3), "stop lasts half an hour": stop & ~(F.col("duration_s") >= 1800),
        "path of a stop within what its pings allow": stop & ~(F.col("path_m").between(0, (F.col("pings") - 1) * 600.0 + 0.001)),
        "trip has a direction in time": trip & ~(F.col("duration_s") > 0), "no silence before a trip ends": trip & ~(F.col("duration_s").isNotNull() & F.col("path_m").isNotNull()),
        "path of a trip no shorter than its line": trip & ~(F.col("path_m") >= F.col("distance_m")), "path of a trip no faster than 300 m/s": trip & ~((F.col("path_m") <= F.col("distance_m")) | (F.col("path_m") <= F.col("duration_s") * 300.0 + 0.001)),
    }
    counted = rows.agg(*[F.count_if(broken).alias(f"r{i}") for i, broken in enumerate(rules.values())])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("broken")) for i, name in enumerate(rules)])).alias("x")).select("x.rule", "x.broken")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_stops_and_trips(spark, sf).select("kind", "device_id", "first_photo_id", "last_photo_id")


def p3_stops_and_trips(spark: SparkSession, sf: str) -> DataFrame:
    return stops_and_trips(spark.read.parquet(f"{sf}/photos.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_changes, p1_windows, p3_found, p3_stops_and_trips, p3_checks)}


_DUE = """WITH newest AS (SELECT relative_path, size_bytes, source_mtime FROM scan_entries WHERE relative_path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY relative_path ORDER BY listed_at DESC NULLS LAST, entry_id DESC) = 1),
due AS (SELECT n.relative_path, CASE WHEN p.relative_path IS NULL THEN 'new'
  WHEN n.size_bytes IS DISTINCT FROM p.size_bytes OR abs(n.source_mtime - p.source_mtime) > 0.001 THEN 'changed'
  WHEN p.analysis_version < 1 AND p.analysis_attempts < 3 THEN 'undone' END AS reason
  FROM newest n LEFT JOIN photos p ON p.relative_path = n.relative_path)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_DUE} SELECT relative_path FROM due WHERE reason IS NOT NULL",
        "p1_windows": """WITH top AS (SELECT coalesce(max(entry_id), 0) AS top FROM scan_entries),
bounds AS (SELECT 1 AS run, -9223372036854775808 AS low, top // 3 AS high FROM top UNION ALL SELECT 2, top // 3, top // 3 * 2 FROM top UNION ALL SELECT 3, top // 3 * 2, top FROM top),
seen AS (SELECT run, low, e.* FROM bounds JOIN scan_entries e ON e.entry_id <= high WHERE relative_path IS NOT NULL),
newest AS (SELECT run, relative_path, size_bytes, source_mtime, max(entry_id) OVER (PARTITION BY run, relative_path) > low AS fresh FROM seen
  QUALIFY row_number() OVER (PARTITION BY run, relative_path ORDER BY listed_at DESC NULLS LAST, entry_id DESC) = 1),
due AS (SELECT run, n.relative_path, fresh, p.analysis_version < 1 AND p.analysis_attempts < 3 AS undone, CASE WHEN p.relative_path IS NULL THEN 'new'
  WHEN n.size_bytes IS DISTINCT FROM p.size_bytes OR abs(n.source_mtime - p.source_mtime) > 0.001 THEN 'changed'
  WHEN p.analysis_version < 1 AND p.analysis_attempts < 3 THEN 'undone' END AS reason
  FROM newest n LEFT JOIN photos p ON p.relative_path = n.relative_path)
SELECT run, relative_path, reason FROM due WHERE reason IS NOT NULL AND (fresh OR undone)""",
        "p3_checks": "SELECT * FROM (VALUES ('stop has three pings', 0), ('stop lasts half an hour', 0), ('path of a stop within what its pings allow', 0), ('trip has a direction in time', 0), ('no silence before a trip ends', 0), ('path of a trip no shorter than its line', 0), ('path of a trip no faster than 300 m/s', 0)) t(rule, broken)",
        "p1_changes": f"{_DUE} SELECT relative_path, reason FROM due WHERE reason IS NOT NULL",
    }
