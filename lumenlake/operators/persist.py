"""Rebuilding collections without losing what people decided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.config import Settings
from lumenlake.operators.ordering import global_positions
from lumenlake.shared import materialize

#: What links and collections say that are kept.
RETAINED = "Retained from an earlier suggestion after manual review"
ARCHIVED = "Archived automatic suggestion; kept because it contains review decisions."


def newest_links(links: DataFrame) -> DataFrame:
    """Of several rows of a collection and photo the one with the highest id."""
    rest = [c for c in links.columns if c not in ("id", "collection_id", "photo_id")]
    last = F.max(F.struct("id", *rest)).alias("_l")
    return links.filter("collection_id is not null and photo_id is not null").groupBy("collection_id", "photo_id").agg(last).select("_l.id", "collection_id", "photo_id", *[f"_l.{c}" for c in rest])


def rebuild(old: DataFrame, old_links: DataFrame, new: DataFrame, new_links: DataFrame, photos: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Merge suggested collections into the stored ones; both results are full tables.

    ``new`` has ``collection_key, kind, title, description, score, cover_photo_id, starts_at,
    ends_at``, ``new_links`` ``collection_key, photo_id, rank_no, score, reason``. Collections match by
    key. Suggested ones are overwritten but for status and, if a person named them, title; dates
    widen over retained photos. Links no longer suggested stay, behind the others, if decided
    or noted. Automatic collections whose key is gone are dropped if unreviewed and
    without decisions, else marked as archived once. New rows get ids above the old ones, in order of
    key and photo. Null keys match nothing.
    """
    old_links = materialize(newest_links(old_links), "links")
    new_links = materialize(new_links.filter("collection_key is not null and photo_id is not null").dropDuplicates(["collection_key", "photo_id"]), "new-links")
    keys = old.select(F.col("id").alias("collection_id"), "collection_key")
    decided = (F.coalesce("decision", F.lit("pending")) != "pending") | (F.coalesce("note", F.lit("")) != "")

    top = F.lit(old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    fresh_keys = new.join(keys, "collection_key", "left_anti").select("collection_key")
    fresh = global_positions(fresh_keys, [], [F.col("collection_key")], [], "n", "_t").select("collection_key", (F.col("n") + top).alias("collection_id"))
    ids = materialize(new.select("collection_key").join(keys.unionByName(fresh.select("collection_id", "collection_key")), "collection_key"), "keys")

    wanted = new_links.join(ids, "collection_key")
    known = old_links.select(F.col("id").alias("_id"), "collection_id", "photo_id", F.col("decision").alias("_decision"), F.col("note").alias("_note"))
    wanted = wanted.join(known, ["collection_id", "photo_id"], "left")
    kept = old_links.join(ids.select("collection_id"), "collection_id", "left_semi").join(wanted.select("collection_id", "photo_id"), ["collection_id", "photo_id"], "left_anti").filter(decided)
    sizes = new_links.groupBy("collection_key").agg(F.count("*").alias("size")).join(ids, "collection_key").select("collection_id", "size")
    kept = global_positions(kept, ["collection_id"], [F.col("id")], [], "n", "_t").drop("_t").join(sizes, "collection_id", "left")
    kept = materialize(kept.withColumns({"rank_no": (F.coalesce("size", F.lit(0)) + F.col("n")).cast("int"), "reason": F.lit(RETAINED)}).drop("size", "n"), "kept-links")

    reviewed = old_links.filter(decided).select("collection_id").distinct()
    gone = old.join(new.select("collection_key"), "collection_key", "left_anti").join(reviewed.select(F.col("collection_id").alias("id"), F.lit(True).alias("_reviewed")), "id", "left")
    stays = ~F.col("automatic") | (F.col("status") != "unreviewed") | F.coalesce("_reviewed", F.lit(False))
    archived = F.when(F.col("automatic") & ~F.coalesce(F.col("description").contains("Archived automatic suggestion"), F.lit(False)), F.trim(F.concat(F.rtrim(F.coalesce("description", F.lit(""))), F.lit(f" {ARCHIVED}")))).otherwise(F.col("description"))
    gone = gone.filter(stays).withColumn("description", archived).drop("_reviewed")

    span = kept.join(photos.select(F.col("id").alias("photo_id"), "capture_at"), "photo_id").groupBy("collection_id").agg(F.min("capture_at").alias("_s"), F.max("capture_at").alias("_e"))
    before = old.select("collection_key", "status", "automatic", F.col("title").alias("_title"), "created_at", "updated_at")
    made = new.join(ids, "collection_key").join(before, "collection_key", "left").join(span, "collection_id", "left")
    made = made.select(
        F.col("collection_id").alias("id"), "collection_key", "kind", F.when(F.coalesce("automatic", F.lit(True)), F.col("title")).otherwise(F.col("_title")).alias("title"), "description", "score",
        F.coalesce("status", F.lit("unreviewed")).alias("status"), F.coalesce("automatic", F.lit(True)).alias("automatic"), F.lit(settings.collection_version).cast("int").alias("algorithm_version"), "cover_photo_id",
        F.least("starts_at", "_s").alias("starts_at"), F.greatest("ends_at", "_e").alias("ends_at"), "created_at", "updated_at",
    )
    collections = made.unionByName(gone.select(made.columns))

    columns = ["id", "collection_id", "photo_id", "rank_no", "score", "reason", "decision", "note"]
    known_links = wanted.filter("_id is not null").select(F.col("_id").alias("id"), "collection_id", "photo_id", "rank_no", "score", "reason", F.col("_decision").alias("decision"), F.col("_note").alias("note"))
    most = F.lit(old_links.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    added = global_positions(wanted.filter("_id is null").select("collection_id", "photo_id", "rank_no", "score", "reason"), [], [F.col("collection_id"), F.col("photo_id")], [], "n", "_t")
    added = added.select((F.col("n") + most).alias("id"), "collection_id", "photo_id", "rank_no", "score", "reason", F.lit("pending").alias("decision"), F.lit(None).cast("string").alias("note"))
    untouched = old_links.join(gone.select(F.col("id").alias("collection_id")), "collection_id", "left_semi")
    links = known_links.unionByName(kept.select(columns)).unionByName(added).unionByName(untouched.select(columns))
    return collections, links


def keep_top(links: DataFrame, collection: int, count: int = 30) -> DataFrame:
    """The collection's links after keeping its first ``count`` by rank: only pending ones change."""
    if not 1 <= count <= 500:
        raise ValueError("count must be within 1 and 500")
    mine = newest_links(links.filter(F.col("collection_id") == collection))
    placed = global_positions(mine, [], [F.col("rank_no"), F.col("id")], [], "place", "_t").drop("_t")
    decision = F.when((F.col("place") <= count) & (F.col("decision") == "pending"), "keep").otherwise(F.col("decision"))
    return placed.select("id", "collection_id", "photo_id", "rank_no", decision.alias("decision"))


def decide(links: DataFrame, changes: DataFrame) -> DataFrame:
    """Links with reviewers' ``changes`` (``id, decision``, and ``note`` where not null) applied; of several the last decision by name counts."""
    bad = changes.filter(~F.col("decision").isin("pending", "keep", "reject")).limit(1).count()
    if bad:
        raise ValueError("a decision is pending, keep or reject")
    latest = changes.groupBy("id").agg(F.max("decision").alias("_d"), F.max("note").alias("_n"))
    out = links.join(latest, "id", "left")
    return out.withColumns({"decision": F.coalesce("_d", "decision"), "note": F.coalesce("_n", "note")}).select(links.columns)


def rename_collections(collections: DataFrame, changes: DataFrame) -> DataFrame:
    """Collections with new titles (``id, title``); they are no longer automatic. Blank titles are refused."""
    if changes.filter(F.coalesce(F.trim("title"), F.lit("")) == "").limit(1).count():
        raise ValueError("a title can't be blank")
    latest = changes.groupBy("id").agg(F.max(F.trim("title")).alias("_t"))
    out = collections.join(latest, "id", "left")
    return out.withColumns({"title": F.coalesce("_t", "title"), "automatic": F.when(F.col("_t").isNotNull(), False).otherwise(F.col("automatic"))}).select(collections.columns)


def rate(photos: DataFrame, ratings: DataFrame) -> DataFrame:
    """Photos with ratings (``id, rating``, 1 to 5 or null) set."""
    if ratings.filter("rating is not null and rating not between 1 and 5").limit(1).count():
        raise ValueError("a rating is 1 to 5 or null")
    latest = ratings.groupBy("id").agg(F.max("rating").alias("_r"), F.lit(True).alias("_set"))
    out = photos.join(latest, "id", "left")
    return out.withColumn("manual_rating", F.when(F.coalesce("_set", F.lit(False)), F.col("_r").cast("int")).otherwise(F.col("manual_rating"))).select(photos.columns)


