"""Curation: groups of photos that are suggested as collections, and their ranking.

A builder returns members ``key, kind, title, prefix, id, quality, capture_at, latitude,
longitude, description`` (a row per photo and collection); ``collections_of`` ranks and sums them up,
``suggestions`` brings them into the form that a rebuild takes. Titles and descriptions are fixed values.
Scan order is the order of ids; ties follow it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.config import Settings
from lumenlake.functions import scalars as S
from lumenlake.operators.joins import skew_join
from lumenlake.operators.ordering import global_positions, global_segments
from lumenlake.shared import materialize

MEMBER = ["key", "kind", "title", "prefix", "id", "quality", "capture_at", "latitude", "longitude"]
_DATE = "MMM d, yyyy"
#: Folder names that say nothing.
GENERIC_FOLDERS = ["camera", "dcim", "images", "photos", "pictures", "uploads"]


def eligible(photos: DataFrame) -> DataFrame:
    """Photos for curation: active and analysed, with effective ``quality`` and ``place``.

    NaN coordinates and scores count as missing. The vector column isn't read.
    """
    number = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c)
    country = "place_country" if "place_country" in photos.columns else None
    return photos.filter("active and analysis_status = 'done' and id is not null").select(
        "id", "relative_path", "file_hash", "perceptual_hash", "capture_at", "capture_source", "width", "height", F.coalesce("face_count", F.lit(0)).alias("face_count"),
        number("latitude"), number("longitude"), number("sharpness_score"), number("exposure_score"), number("color_score"),
        S.place_label("place_city", country).alias("place"), S.effective_quality().alias("quality"), S.wall_micros("capture_at").alias("t_us"),
    )


def members(rows: DataFrame, key: Column, kind: Column | str, title: Column | str, prefix: str, description: Column | str) -> DataFrame:
    kind, title, description = (F.lit(x) if isinstance(x, str) else x for x in (kind, title, description))
    return rows.select(key.alias("key"), kind.alias("kind"), title.alias("title"), F.lit(prefix).alias("prefix"), *MEMBER[4:], description.alias("description"))


def _text(*parts: Column | str) -> Column:
    """Columns and literal text (what isn't a column) in one string."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def collections_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collections and links of members.

    Photos are ranked by quality, then higher id; the score is 0.8 times the mean quality of the best
    ten plus up to 0.2 for the size; the cover is the first. Duplicates keep the order of ``position``
    and have a fixed score; their cover is the first best. Returns the collections ``key, kind, title,
    photos, score, starts_at, ends_at, latitude, longitude, cover_photo_id, description`` and links
    ``key, photo_id, rank, score, prefix``.
    """
    order = [F.asc("position")] * ("position" in rows.columns) + [F.desc("quality"), F.desc("id")]
    ranked = materialize(global_positions(rows.dropDuplicates(["key", "id"]), ["key"], order, [], "rank", "_tie").drop("_tie"), "ranked")
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    n = F.count("*")
    fixed = F.when(F.col("key") == "duplicates:exact", 1.0).when(F.col("key") == "duplicates:near", 0.95)
    best = F.min_by("id", F.struct(-F.col("quality"), "rank"))
    collections = ranked.groupBy("key").agg(
        F.min("kind").alias("kind"), F.min("title").alias("title"), n.alias("photos"),
        F.coalesce(fixed, F.least(F.lit(1.0), F.avg(F.when(F.col("rank") <= 10, F.col("quality"))) * 0.8 + F.least(n, F.lit(30)) / 150)).alias("score"),
        F.min("capture_at").alias("starts_at"), F.max("capture_at").alias("ends_at"),
        F.avg(F.when(located, F.col("latitude"))).alias("latitude"), F.avg(F.when(located, F.col("longitude"))).alias("longitude"),
        F.when(fixed.isNotNull(), best).otherwise(F.max(F.when(F.col("rank") == 1, F.col("id")))).alias("cover_photo_id"), F.min("description").alias("description"),
    )
    links = ranked.select("key", F.col("id").alias("photo_id"), "rank", F.col("quality").alias("score"), "prefix")
    return collections, links


def suggestions(rows: DataFrame, photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members as ``persist.rebuild`` takes them: collections and links with reasons.

    A link's reason is its prefix and up to three traits of the photo; duplicates have only the prefix.
    """
    collections, links = collections_of(rows)
    new = collections.select(F.col("key").alias("collection_key"), "kind", "title", "description", "score", "cover_photo_id", "starts_at", "ends_at")
    traits = photos.select(F.col("id").alias("photo_id"), S.reason().alias("_traits"))
    reason = F.when(F.col("key").startswith("duplicates:"), F.col("prefix")).otherwise(F.concat_ws(": ", F.nullif("prefix", F.lit("")), "_traits"))
    linked = links.join(traits, "photo_id").select(F.col("key").alias("collection_key"), "photo_id", F.col("rank").cast("int").alias("rank_no"), "score", reason.alias("reason"))
    return new, linked


def dominant_place(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``group, place``: the most frequent place of each group, of equals the one seen first in ``order``."""
    counted = rows.filter("place is not null").groupBy(group, "place").agg((-F.count("*")).alias("_n"), F.min(F.struct(*order)).alias("_first"))
    return counted.groupBy(group).agg(F.min_by("place", F.struct("_n", "_first")).alias("place"))


# -- time ------------------------------------------------------------------------------


def _km(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    a, b, c, d = (np.radians(x.astype(np.float64)) for x in (a, b, c, d))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def split_events(photos: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Dated photos with their event number: a new event begins after a long gap, a shorter
    one over midnight, or an hour's gap with a jump of more than 180 km from the photo before."""
    hour, gap_us = 3_600_000_000, settings.event_gap_hours * 3_600_000_000

    def cut(before: dict, now: dict) -> np.ndarray:
        gap = now["t_us"] - before["t_us"]
        other_day = now["t_us"] // (24 * hour) != before["t_us"] // (24 * hour)
        with np.errstate(invalid="ignore"):
            jump = _km(before["latitude"], before["longitude"], now["latitude"], now["longitude"]) > 180
        return (gap > gap_us) | (other_day & (gap > 3.5 * hour)) | ((gap > hour) & jump)

    return global_segments(photos.filter("capture_at is not null"), [F.col("t_us"), F.col("id")], ["t_us", "latitude", "longitude"], cut, "event")


def split_bursts(photos: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Dated photos with the number of their series; series of fewer than three are left out."""
    gap_us = settings.burst_gap_seconds * 1_000_000
    rows = global_segments(photos.filter("capture_at is not null"), [F.col("t_us"), F.col("id")], ["t_us"], lambda a, b: b["t_us"] - a["t_us"] > gap_us, "burst")
    rows = materialize(rows, "bursts")
    sizes = rows.groupBy("burst").agg(F.count("*").alias("size")).filter("size >= 3")
    return rows.join(sizes, "burst")


def _chosen(rows: DataFrame, group: str, best: DataFrame) -> DataFrame:
    """Rows of the best groups; ``best`` is cut to a fixed number, so it is broadcast."""
    return rows.join(F.broadcast(best), group)


def event_members(photos: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The 250 largest events of at least four photos (then best photo, then earlier)."""
    rows = materialize(split_events(photos, settings), "events")
    groups = rows.groupBy("event").agg(
        F.count("*").alias("n"), F.max("quality").alias("q"), F.min("capture_at").alias("s"), F.max("capture_at").alias("e"), F.min_by("id", F.struct("t_us", "id")).alias("first"),
        F.bool_or(F.col("latitude").isNotNull()).alias("located"),
    )
    best = groups.filter("n >= 4").orderBy(F.desc("n"), F.desc("q"), "event").limit(250)
    best = best.join(dominant_place(_chosen(rows, "event", best.select("event")), "event", ["t_us", "id"]), "event", "left")
    title = F.concat(F.coalesce("_place", F.lit("Notable day")), F.lit(" — "), S.time_label("s", "e"))
    return members(_chosen(rows, "event", best.withColumnRenamed("place", "_place")), F.concat(F.lit("event:"), "first"), "event", title, "event pick", _text(F.col("n"), " photos grouped by capture time", F.when(F.col("located"), " and location.").otherwise(".")))


def burst_members(photos: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The 100 longest series (then earlier)."""
    rows = split_bursts(photos, settings)
    best = rows.groupBy("burst").agg(F.max("size").alias("n"), F.min("capture_at").alias("s"), F.min_by("id", F.struct("t_us", "id")).alias("first")).orderBy(F.desc("n"), "burst").limit(100)
    title = F.concat(F.lit("Series of "), "n", F.lit(" — "), F.date_format("s", "MMM d, yyyy HH:mm"))
    return members(_chosen(rows, "burst", best), F.concat(F.lit("series:"), "first"), "series", title, "series frame", "Photos captured seconds apart. Highest-quality and most distinct frames are ranked first.")


def burst_covers(photos: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``key, cover_photo_id``: of a series the first best photo in order of time."""
    rows = split_bursts(photos, settings)
    first = F.min_by("id", F.struct("t_us", "id"))
    return rows.groupBy("burst").agg(F.concat(F.lit("series:"), first).alias("key"), F.min_by("id", F.struct(-F.col("quality"), "t_us", "id")).alias("cover_photo_id")).drop("burst")


def recurring_members(photos: DataFrame) -> DataFrame:
    """The 40 largest calendar dates with eight photos in two years or more (then seen first)."""
    rows = photos.filter("capture_at is not null").withColumn("md", F.date_format("capture_at", "MM-dd"))
    best = rows.groupBy("md").agg(F.count("*").alias("n"), F.count_distinct(F.year("capture_at")).alias("years"), F.min("id").alias("seen"), F.min("capture_at").alias("s"), F.max("capture_at").alias("e")).filter("n >= 8 and years >= 2")
    best = best.orderBy(F.desc("n"), "seen").limit(40)
    title = F.concat(F.lit("Recurring date — "), F.date_format("s", "MMMM d"))
    return members(_chosen(rows, "md", best), F.concat(F.lit("recurring:"), "md"), "notable-date", title, "recurring memory", _text("Photos on this calendar date across ", F.col("years"), " years (", F.year("s"), "–", F.year("e"), "). This may reveal an anniversary or tradition."))


def holiday_members(photos: DataFrame, calendar: DataFrame) -> DataFrame:
    """Photos of the days in ``calendar`` (``day, name``), by name, three or more.

    A calendar has a few days a year, so it is broadcast.
    """
    rows = photos.withColumn("day", F.to_date("capture_at")).join(F.broadcast(calendar.dropDuplicates(["day"])), "day")
    best = rows.groupBy("name").agg(F.count("*").alias("n")).filter("n >= 3").select("name")
    return members(rows.join(best, "name"), F.concat(F.lit("holiday:"), S.key_digest("name", 10)), "notable-date", F.col("name"), "holiday memory", _text("Photos captured on ", F.col("name"), ", grouped across the library."))


def notable_day_members(photos: DataFrame) -> DataFrame:
    """Each year's eight days with most photos, at least six (then seen first)."""
    rows = photos.filter("capture_at is not null").withColumn("day", F.to_date("capture_at"))
    days = rows.groupBy("day").agg(F.count("*").alias("n"), F.min("id").alias("seen")).filter("n >= 6")
    order = Window.partitionBy(F.year("day")).orderBy(F.desc("n"), "seen")  # at most 366 rows
    best = days.withColumn("k", F.row_number().over(order)).filter("k <= 8").select("day", F.col("n").alias("day_photos"))
    chosen = materialize(rows.join(best, "day"), "days")
    named = chosen.join(dominant_place(chosen, "day", ["id"]).withColumnRenamed("place", "_place"), "day", "left")
    title = F.concat(F.coalesce(F.concat(F.lit("Big day in "), "_place"), F.lit("A day worth remembering")), F.lit(" — "), F.date_format("day", _DATE))
    return members(named, F.concat(F.lit("notable-day:"), F.col("day").cast("string")), "notable-date", title, "day highlight", _text("One of ", F.year("day"), "'s most photographed days, with ", F.col("day_photos"), " images."))


def folder_members(photos: DataFrame) -> DataFrame:
    """The 80 largest folders of 5 to 1000 photos whose name isn't generic (then seen first)."""
    rows = photos.withColumn("folder", S.folder()).filter("folder is not null")
    name = F.lower(F.element_at(F.split("folder", "/"), -1))
    best = rows.groupBy("folder").agg(F.count("*").alias("n"), F.min("id").alias("seen")).filter(F.col("n").between(5, 1000) & ~name.isin(GENERIC_FOLDERS))
    best = best.orderBy(F.desc("n"), "seen").limit(80)
    return members(_chosen(rows, "folder", best), F.concat(F.lit("folder:"), S.key_digest("folder")), "folder", S.folder_title("folder"), "folder highlight", _text(F.col("n"), " analyzed photos already grouped in source folder ", F.col("folder"), ". The folder is treated as a useful human-authored album clue."))


# -- people ----------------------------------------------------------------------------


def people_members(photos: DataFrame, clusters: DataFrame, limit: int = 100) -> DataFrame:
    """Photos of each face cluster (``cluster_id, photo_id``): three or more, one dated; the largest first.

    Up to 14 days and 40 photos make a visitor.
    """
    seen = clusters.filter("cluster_id is not null").select("cluster_id", F.col("photo_id").alias("id")).distinct()
    rows = materialize(photos.join(seen, "id"), "people")
    every = seen.groupBy("cluster_id").agg(F.count("*").alias("all"))
    groups = rows.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("capture_at").alias("s"), F.max("capture_at").alias("e")).filter("n >= 3 and s is not null")
    best = groups.join(every, "cluster_id").orderBy(F.desc("all"), "cluster_id").limit(limit)
    short = (F.date_diff(F.to_date("e"), F.to_date("s")) <= 14) & (F.col("n") <= 40)
    title = F.when(short, F.concat(F.lit("Possible visitor — "), F.date_format("s", "MMM yyyy"))).otherwise(F.concat(F.lit("Person "), F.col("cluster_id").cast("string")))
    return members(_chosen(rows, "cluster_id", best), F.concat(F.lit("person:"), "cluster_id"), F.when(short, "visitor").otherwise("people"), title, "face match", F.when(short, "This face appears only in a short period, suggesting a visitor or someone newly met.").otherwise(_text("A locally clustered face appearing in ", F.col("n"), " photos. Rename during review when person labels are added.")))


def together_members(photos: DataFrame, clusters: DataFrame) -> DataFrame:
    """The 40 pairs of clusters most often seen in photos of two to eight people, three photos or more.

    A photo gives at most 28 pairs.
    """
    seen = clusters.filter("cluster_id is not null").select(F.col("photo_id").alias("id"), "cluster_id").distinct().join(photos.select("id"), "id")
    by_photo = seen.groupBy("id").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("cluster_id")), 1, 9).alias("people")).filter(F.col("n").between(2, 8))
    pair = F.explode(F.flatten(F.transform("people", lambda a: F.transform(F.filter("people", lambda b: b > a), lambda b: F.struct(a.alias("l"), b.alias("r"))))))
    pairs = materialize(by_photo.select("id", pair.alias("p")).select("id", "p.l", "p.r"), "together")
    best = pairs.groupBy("l", "r").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l", "r").limit(40).filter("n >= 3")
    rows = photos.join(pairs.join(F.broadcast(best.drop("n")), ["l", "r"]), "id")
    spans = rows.groupBy("l", "r").agg(F.min("capture_at").alias("s"), F.max("capture_at").alias("e"), F.count("*").alias("n"))
    rows = rows.join(F.broadcast(spans), ["l", "r"])  # at most 40 rows
    short = F.coalesce(F.date_diff(F.to_date("e"), F.to_date("s")) <= 14, F.lit(False))
    title = F.when(short, F.concat(F.lit("Possible visit together — "), F.date_format("s", "MMM yyyy"))).otherwise(F.concat(F.lit("People "), "l", F.lit(" & "), "r", F.lit(" together")))
    return members(rows, F.concat(F.lit("together:"), "l", F.lit(":"), "r"), F.when(short, "visitor").otherwise("people"), title, "people together", F.when(short, _text("These two faces appear together in ", F.col("n"), " photos over a short period, suggesting a visit or shared occasion.")).otherwise(_text("Two locally recognized faces appear together in ", F.col("n"), " photos—a useful relationship, family, or shared-selfie thread.")))


# -- duplicates ------------------------------------------------------------------------


def exact_duplicates(photos: DataFrame) -> DataFrame:
    """``id, file_hash, copies, group_number``: groups of equal file hashes, numbered as first seen."""
    hashed = photos.filter("file_hash is not null and file_hash != ''")
    groups = hashed.groupBy("file_hash").agg(F.count("*").alias("copies"), F.min("id").alias("seen")).filter("copies > 1")
    numbered = global_positions(groups, [], [F.col("seen")], [], "group_number", "_tie").drop("_tie", "seen")
    return hashed.select("id", "relative_path", "quality", "file_hash").join(numbered, "file_hash")


def near_duplicate_edges(photos: DataFrame, most: int = 7) -> DataFrame:
    """``photo_id, prior_id``: from each photo to the first photo of every earlier hash within ``most`` bits.

    Of each distinct perceptual hash the photo seen first stands for all. Photos with the same
    non-empty file hash aren't linked. Four 16-bit chunks, probed at one bit or less, meet every pair up to
    seven bits apart; chunk values that very many hashes share are spread by AQE's skew join.
    """
    if most > 7:
        raise ValueError("the chunk probes are complete up to 7 bits")
    value = F.lower(F.lpad(F.trim("perceptual_hash"), 16, "0"))
    rows = photos.filter(F.trim("perceptual_hash").rlike("^[0-9a-fA-F]{1,16}$")).select("id", "file_hash", value.alias("h"))
    # hashes as numbers: a string for each probe would be most of what is shuffled, and slow to compare
    part = [F.conv(F.substring("h", 1 + 4 * c, 4), 16, 10).cast("long") for c in range(4)]
    rows = rows.select("id", "file_hash", F.shiftleft(part[0], 48).bitwiseOR(F.shiftleft(part[1], 32)).bitwiseOR(F.shiftleft(part[2], 16)).bitwiseOR(part[3]).alias("h"))
    firsts = materialize(rows.groupBy("h").agg(F.min(F.struct("id", "file_hash")).alias("f")), "first-hashes")
    value = lambda c: F.shiftrightunsigned("h", 48 - 16 * c).bitwiseAND(F.lit(0xFFFF)).cast("int")
    chunk = lambda probe: F.explode(F.array(*[value(c).bitwiseXOR(F.lit(m | c << 16)) for c in range(4) for m in probe]))
    kept = firsts.select("h", chunk([0]).alias("k"))
    probes = firsts.select(F.col("h").alias("g"), chunk([0, *[1 << b for b in range(16)]]).alias("k"))
    close = F.bit_count(F.col("g").bitwiseXOR(F.col("h")))
    near = materialize(probes.join(kept, "k").filter(close <= most).select("g", "h").distinct(), "near-hashes")
    prior = near.join(firsts.select("h", F.col("f.id").alias("prior_id"), F.col("f.file_hash").alias("prior_hash")), "h").select("g", "prior_id", "prior_hash")
    linked = rows.select("id", "file_hash", F.col("h").alias("g")).join(prior, "g").filter("prior_id < id and not (coalesce(file_hash, '') != '' and coalesce(prior_hash, '') = file_hash)")
    return linked.select(F.col("id").alias("photo_id"), "prior_id")


def union_find(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``vertex, root``: the smallest vertex of each linked set, by hooking and pointer jumping.

    Each round every vertex takes the smallest root next to it and roots are shortened by
    one jump; the number of rounds grows with the logarithm of the longest chain. Tables are
    written to the shared folder in between.
    """
    both = edges.filter(F.col(left) != F.col(right)).select(F.explode(F.array(F.struct(F.col(left).alias("u"), F.col(right).alias("v")), F.struct(F.col(right).alias("u"), F.col(left).alias("v")))).alias("e")).select("e.u", "e.v").distinct()
    links = materialize(both, "uf-links")
    roots = materialize(links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("r")).select(F.col("u").alias("vertex"), F.col("r").alias("root")), "uf-roots")
    edges_n, n = links.count(), roots.count()
    while True:
        above = roots.select(F.col("vertex").alias("root"), F.col("root").alias("up"))
        jumped = materialize(skew_join(roots, above, ["root"], n).select("vertex", F.col("up").alias("root")), "uf-jump")
        near = skew_join(links, jumped.withColumnsRenamed({"vertex": "v", "root": "rv"}), ["v"], edges_n).groupBy("u").agg(F.min("rv").alias("rv"))
        hooked = jumped.join(near.withColumnRenamed("u", "vertex"), "vertex", "left").select("vertex", "root", F.least("root", F.coalesce("rv", "root")).alias("low"))
        hooked = materialize(hooked, "uf-hook")
        pull = hooked.groupBy("root").agg(F.min("low").alias("to"))
        new = materialize(skew_join(hooked.select("vertex", "root"), pull, ["root"], n).select("vertex", F.least("root", "to").alias("root")), "uf-roots")
        changed = new.join(roots.withColumnRenamed("root", "old"), "vertex").filter("root != old").limit(1).count()
        roots = new
        if not changed:
            return roots


def near_duplicate_groups(photos: DataFrame) -> DataFrame:
    """``photo_id, group_id``: linked near duplicates, named by their smallest photo."""
    return union_find(near_duplicate_edges(photos), "photo_id", "prior_id").select(F.col("vertex").alias("photo_id"), F.col("root").alias("group_id"))


def duplicate_members(photos: DataFrame) -> DataFrame:
    """All exact and all near duplicates, each one collection; ``position`` is by group, then path or best.

    They have neither time nor place.
    """
    exact = exact_duplicates(photos).select("id", "quality", F.col("group_number").alias("n"), "relative_path")
    exact = global_positions(exact, [], [F.col("n"), F.col("relative_path"), F.col("id")], [], "position", "_tie").drop("_tie")
    groups = materialize(near_duplicate_groups(photos), "near-groups")
    numbered = global_positions(groups.select("group_id").distinct(), [], [F.col("group_id")], [], "n", "_tie").drop("_tie")
    near = groups.join(numbered, "group_id").join(photos.select(F.col("id").alias("photo_id"), "quality"), "photo_id").select(F.col("photo_id").alias("id"), "quality", "n")
    near = global_positions(near, [], [F.col("n"), F.desc("quality"), F.col("id")], [], "position", "_tie").drop("_tie")
    prefix = {"exact": F.concat(F.lit("byte-identical duplicate group "), "n"), "near": F.concat(F.lit("visually similar group "), "n", F.lit("; best frame is ranked first"))}
    groups = {"exact": exact.agg(F.max("n")).first()[0] or 0, "near": near.agg(F.max("n")).first()[0] or 0}
    about = {"exact": f"{groups['exact']} byte-identical groups. Nothing is deleted; use this as a review list.", "near": f"{groups['near']} visually similar groups detected library-wide with perceptual hashes."}
    nothing = [F.lit(None).cast(photos.schema[c].dataType).alias(c) for c in MEMBER[6:]]
    parts = [rows.select(F.lit(f"duplicates:{x}").alias("key"), F.lit("duplicates").alias("kind"), F.lit(f"{x.title()} duplicates").alias("title"), prefix[x].alias("prefix"), "id", "quality", *nothing, F.lit(about[x]).alias("description"), "position") for x, rows in (("exact", exact), ("near", near))]
    return parts[0].unionByName(parts[1])


# -- highlights ------------------------------------------------------------------------


class _Choice:
    """The greedy choice of one collection so far."""

    def __init__(self, limit: int):
        self.limit, self.picked, self.last, self.over = limit, [], None, False
        self.hashes: set[str] = set()
        self.days: dict[str, int] = {}

    @staticmethod
    def _bits(h: str | None) -> int | None:
        try:
            return int(h or "", 16)
        except ValueError:
            return None

    def look(self, rows: list, chunk: int) -> None:
        for r in rows:
            self.last = (r.quality, r.id)
            if (r.file_hash and r.file_hash in self.hashes) or self.days.get(r.day, 0) >= 5:
                continue
            mine = self._bits(r.perceptual_hash)
            if mine is not None and r.t_us is not None and any(c["bits"] is not None and c["t_us"] is not None and (mine ^ c["bits"]).bit_count() <= 5 and abs(r.t_us - c["t_us"]) <= 600_000_000 for c in self.picked[-40:]):
                continue
            self.picked.append({"id": r.id, "bits": mine, "t_us": r.t_us})
            if r.file_hash:
                self.hashes.add(r.file_hash)
            self.days[r.day] = self.days.get(r.day, 0) + 1
            if len(self.picked) >= self.limit:
                break
        self.over = len(self.picked) >= self.limit or len(rows) < chunk


def diverse_choices(rows: DataFrame, limits: dict[str, int], chunk: int = 500) -> dict[str, list[dict]]:
    """Greedy choice of photos by quality, then higher id, for several collections at once.

    ``rows`` has ``keys`` (the collections a photo may be in), ``id, quality, file_hash, perceptual_hash,
    t_us, capture_at``; ``limits`` the size of each collection. A photo is passed over if its file hash was chosen, its
    day (undated photos share one) has five, or one of the last 40 chosen was taken within ten minutes and
    differs in at most five bits. A round takes the next ``chunk`` rows of all open collections in one job,
    after the last one looked at and without full days and chosen hashes, until all choices are
    complete or no row is left. The driver holds a chunk per collection and the choices, whatever the size of the table.
    """
    spark = rows.sparkSession
    choices = {k: _Choice(n) for k, n in limits.items()}
    day = F.coalesce(F.to_date("capture_at").cast("string"), F.lit(""))
    long = rows.select(F.explode("keys").alias("key"), "id", "quality", "file_hash", "perceptual_hash", "t_us", day.alias("day"))
    order = Window.partitionBy("key").orderBy(F.desc("quality"), F.desc("id"))
    while still := {k: c for k, c in choices.items() if not c.over}:
        # bounded by the collections and their limits
        bounds = spark.createDataFrame([(k, *map(float, c.last[:1]), int(c.last[1])) if c.last else (k, None, None) for k, c in still.items()], "key string, _q double, _id long")
        left = long.join(F.broadcast(bounds), "key").filter("_q is null or quality < _q or (quality = _q and id < _id)").drop("_q", "_id")
        if full := [(k, d) for k, c in still.items() for d, n in c.days.items() if n >= 5]:
            left = left.join(F.broadcast(spark.createDataFrame(full, "key string, day string")), ["key", "day"], "left_anti")
        if seen := [(k, h) for k, c in still.items() for h in c.hashes]:
            left = left.join(F.broadcast(spark.createDataFrame(seen, "key string, file_hash string")), ["key", "file_hash"], "left_anti")
        batch: dict[str, list] = {k: [] for k in still}
        for r in left.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= chunk).orderBy("key", "_n").collect():
            batch[r.key].append(r)
        for k, c in still.items():
            c.look(batch[k], chunk)
    return {k: c.picked for k, c in choices.items()}


def diverse_highlights(photos: DataFrame, limit: int, chunk: int = 500) -> list[dict]:
    """The choice of ``diverse_choices`` for one collection of all photos."""
    return diverse_choices(photos.withColumn("keys", F.array(F.lit("all"))), {"all": limit}, chunk)["all"]


def highlight_members(photos: DataFrame) -> DataFrame:
    """Diverse highlights of all photos, of each year, of people and of landscapes."""
    photos = materialize(photos, "photos")
    spark = photos.sparkSession
    years = photos.filter("capture_at is not null").groupBy(F.year("capture_at").alias("y")).count().filter("count >= 5").collect()  # one row a calendar year
    limits = {"highlights:all": 150} | {f"highlights:year:{r.y}": min(60, max(15, r["count"] // 8)) for r in years} | {"highlights:portraits": 100, "highlights:scenic": 100}
    year = F.concat(F.lit("highlights:year:"), F.year("capture_at"))
    keys = F.array(F.lit("highlights:all"), F.when(year.isin(list(limits)), year), F.when(F.col("face_count") > 0, "highlights:portraits"), F.when((F.col("face_count") == 0) & (F.col("width") > F.col("height")), "highlights:scenic"))
    choices = diverse_choices(photos.withColumn("keys", F.filter(keys, lambda k: k.isNotNull())), limits)
    texts = {
        "highlights:all": ("highlights", "Print-worthy highlights", "quality pick", "A quality-ranked, de-duplicated selection with limits on near-identical frames and over-represented days."),
        "highlights:portraits": ("people", "Favorite people photos", "portrait pick", "High-quality photos containing faces, with bursts and duplicates reduced."),
        "highlights:scenic": ("highlights", "Scenery and establishing shots", "scenic pick", "Strong landscape-orientation photos without detected faces—useful for opening and transition pages."),
    }
    for r in years:
        about = (
            f"{len(choices[f'highlights:year:{r.y}'])} picks from {r['count']} analyzed photos captured in {r.y}. Selection favors sharpness, exposure, contrast, color and print resolution; "
            "your star ratings contribute too. Exact duplicates and similar burst frames are reduced, with at most five picks per day. Displayed newest first; "
            "quality badges retain the selection rank, not an aesthetic verdict."
        )
        texts[f"highlights:year:{r.y}"] = ("highlights", f"Best of {r.y}", "year highlight", about)
    found = []
    for key, picked in choices.items():
        if len(picked) >= (5 if key in ("highlights:portraits", "highlights:scenic") else 1):
            kind, title, prefix, about = texts[key]
            found += [(key, kind, title, prefix, about, p["id"]) for p in picked]
    kinds = photos.schema["id"].dataType.simpleString()
    few = spark.createDataFrame(found, f"key string, kind string, title string, prefix string, description string, id {kinds}")
    return photos.join(F.broadcast(few), "id").select(*MEMBER, "description")


class BuilderFailure(RuntimeError):
    """Builders of collections failed; ``failed`` has the error of each by name."""

    def __init__(self, failed: dict[str, str]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in failed.items()))
        self.failed = failed


def all_members(
    photos: DataFrame, faces: DataFrame, settings: Settings = Settings(), calendar: DataFrame | None = None, trips: Callable[[], DataFrame] | None = None, places: Callable[[], DataFrame] | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """Members of all builders, and the errors of those that failed by name.

    ``faces`` has the cluster of each face; ``trips`` and ``places`` are builders of the caller's. A builder that
    fails costs the others nothing; who needs a complete result raises ``BuilderFailure`` if any did.
    """
    builders: dict[str, Callable[[], DataFrame]] = {
        "highlights": lambda: highlight_members(photos), "events": lambda: event_members(photos, settings), "series": lambda: burst_members(photos, settings), "folders": lambda: folder_members(photos),
        "recurring": lambda: recurring_members(photos), "days": lambda: notable_day_members(photos), "people": lambda: people_members(photos, faces), "together": lambda: together_members(photos, faces),
        "duplicates": lambda: duplicate_members(photos),
    }
    if calendar is not None:
        builders["holidays"] = lambda: holiday_members(photos, calendar)
    builders |= {name: build for name, build in (("trips", trips), ("places", places)) if build is not None}
    parts, failed = [], {}
    for name, build in builders.items():
        try:
            parts.append(materialize(build(), "builder"))
        except Exception as e:  # one builder must not cost the others
            failed[name] = f"{type(e).__name__}: {e}"
    if not parts:
        raise BuilderFailure(failed)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out, failed
