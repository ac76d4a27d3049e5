"""Queries of the training-data problems tagged llm, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm.components import connected_components
from lumenlake.llm.mixing import mix
from lumenlake.llm.near_duplicates import photo_groups, photo_pairs
from lumenlake.llm.neighbours import face_nearest, face_neighbours, photo_nearest, photo_neighbours, similar_pairs
from lumenlake.llm.rank_merge import median_rank
from lumenlake.llm.tokenizer import decode_ids, encode_texts
from lumenlake.llm.topn import top_n_per_group
from lumenlake.llm.truncation import score_truncation, truncation_rates
from lumenlake.operators.joins import skew_join
from lumenlake.shared import materialize

SCORES = ["sharpness_score", "exposure_score", "color_score", "resolution_score"]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_top(spark: SparkSession, sf: str) -> DataFrame:
    return top_n_per_group(_read(spark, sf, "collection_photos"), "collection_id", "score", "photo_id", 5, version="id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_top(spark, sf).select("collection_id", "photo_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return photo_pairs(_read(spark, sf, "photos"))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    return photo_groups(_read(spark, sf, "photos"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose ends both exist, each kind for itself."""
    known = _read(spark, sf, "photos").select(F.lit("photo").alias("kind"), "id").unionByName(_read(spark, sf, "faces").select(F.lit("face").alias("kind"), "id"))
    pairs = _read(spark, sf, "match_pairs").filter("left_id != right_id").select("kind", F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).distinct()
    known, pairs = known.distinct(), materialize(pairs, "pairs")
    total = pairs.count()
    for end in ("a", "b"):  # one record may have very many matches
        pairs = skew_join(pairs, known.withColumnRenamed("id", end), ["kind", end], total)
    return connected_components(pairs, "a", "b", ["kind"]).select("kind", F.col("vertex").alias("record_id"), F.col("component").alias("group_id"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    faces = similar_pairs(face_neighbours(_read(spark, sf, "faces")), "id")
    photos = similar_pairs(photo_neighbours(_read(spark, sf, "photos")), "id")
    return faces.select(F.lit("face").alias("kind"), "id_a", "id_b").unionByName(photos.select(F.lit("photo").alias("kind"), "id_a", "id_b"))


def p6_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Every 50th record asks, all answer; however far the nearest are."""
    asks = F.col("id") % 50 == 0
    faces = face_nearest(_read(spark, sf, "faces"), queries=asks)
    photos = photo_nearest(_read(spark, sf, "photos"), queries=asks)
    return faces.withColumn("kind", F.lit("face")).unionByName(photos.withColumn("kind", F.lit("photo")))


def p7_order(spark: SparkSession, sf: str) -> DataFrame:
    photos = _read(spark, sf, "photos").filter("file_hash is not null")
    folder = F.regexp_extract("relative_path", "^(.*)/[^/]*$", 1)
    ranked = median_rank(photos.select("id", folder.alias("folder"), *SCORES), "folder", "id", SCORES)
    return ranked.select("folder", F.col("id").alias("photo_id"), "median_rank", "mean_rank", "position")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """First in every score means a mean rank of 1; it must be so alone in its folder."""
    first = F.count_if(F.col("mean_rank") == 1)
    folders = p7_order(spark, sf).groupBy("folder").agg(F.count("*").alias("n"), first.alias("firsts"), F.min(F.when((F.col("position") == 1) & (F.col("mean_rank") == 1), F.col("photo_id"))).alias("photo_id"))
    return folders.filter("n >= 5 and firsts = 1").select("photo_id")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(_read(spark, sf, "documents").select("doc_id", "text"))


def p8_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that decoding gives back; SQL has them from the texts themselves."""
    return decode_ids(p8_ids(spark, sf)).select("doc_id", F.sha2("text", 256).alias("digest"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))[1]


def p9_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's texts, and how many rules its mix breaks: uses within repeats, share within half a text, no text twice."""
    chosen, report = mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))
    got = chosen.groupBy("source").agg(F.max("n_tokens").alias("largest"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"), F.max("uses").alias("uses"), F.min("uses").alias("least"))
    rows = report.join(got, "source", "left").fillna(0, ["largest", "tokens", "rows", "ids", "uses"])
    broken = [F.col("uses") > F.col("max_repeats"), F.col("rows") != F.col("ids"), F.col("tokens") != F.col("chosen_tokens"), F.abs("shortfall_tokens") > F.col("available_tokens"), F.coalesce(F.col("uses") - F.col("least") > 1, F.lit(False)), (F.col("texts") > 0) & (F.col("chosen_tokens") <= 0) & (F.col("budget_tokens") > F.col("available_tokens"))]
    return rows.select("source", "target_share", "max_repeats", "texts", sum((x.cast("int") for x in broken[1:]), broken[0].cast("int")).alias("broken"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return score_truncation(_read(spark, sf, "documents")).filter("score >= 0.5").select("doc_id")


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation_rates(score_truncation(_read(spark, sf, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_top, p4_found, p4_groups, p5_found, p6_found, p6_neighbours, p7_found, p7_order, p8_ids, p8_round_trip, p9_mix, p9_shares, p9_checks, p10_found, p10_rates)}


_NEWEST = """WITH newest AS (SELECT collection_id, photo_id, score FROM collection_photos WHERE collection_id IS NOT NULL AND photo_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY collection_id, photo_id ORDER BY id DESC) = 1),
placed AS (SELECT collection_id, photo_id, score, row_number() OVER (PARTITION BY collection_id ORDER BY score DESC, photo_id) AS position
  FROM newest WHERE score IS NOT NULL AND NOT isnan(score))"""

_HASHES = """WITH h AS (SELECT id, lower(trim(perceptual_hash)) AS p, lower(trim(difference_hash)) AS d FROM photos),
v AS (SELECT id, ('0x' || p)::UBIGINT AS p, ('0x' || d)::UBIGINT AS d FROM h
  WHERE regexp_full_match(p, '[0-9a-f]{16}') AND regexp_full_match(d, '[0-9a-f]{16}') AND p <> repeat(p[1], 16) AND d <> repeat(d[1], 16)),
pairs AS (SELECT a.id AS photo_id_a, b.id AS photo_id_b, a.p = b.p AND a.d = b.d AS same FROM v a JOIN v b ON a.id < b.id
  AND bit_count(xor(a.p, b.p)) <= 7 AND bit_count(xor(a.d, b.d)) <= 12)"""

_RANKS = """WITH analysed AS (SELECT id, regexp_extract(relative_path, '^(.*)/[^/]*$', 1) AS folder, sharpness_score, exposure_score, color_score, resolution_score
  FROM photos WHERE file_hash IS NOT NULL),
long AS (UNPIVOT (SELECT id, folder, coalesce(CASE WHEN NOT isnan(sharpness_score) THEN sharpness_score END, -1e300) AS s1, coalesce(CASE WHEN NOT isnan(exposure_score) THEN exposure_score END, -1e300) AS s2,
  coalesce(CASE WHEN NOT isnan(color_score) THEN color_score END, -1e300) AS s3, coalesce(CASE WHEN NOT isnan(resolution_score) THEN resolution_score END, -1e300) AS s4 FROM analysed)
  ON s1, s2, s3, s4 INTO NAME score VALUE v),
ranks AS (SELECT id, folder, rank() OVER (PARTITION BY folder, score ORDER BY v DESC) AS r FROM long),
items AS (SELECT folder, id AS photo_id, list_sort(list(r))[2] AS median_rank, sum(r)::DOUBLE / 4 AS mean_rank FROM ranks GROUP BY folder, id),
placed AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY median_rank, mean_rank, photo_id) AS position FROM items)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"{_NEWEST} SELECT collection_id, photo_id FROM placed WHERE position <= 5",
        "p2_top": f"{_NEWEST} SELECT collection_id, photo_id, score, position FROM placed WHERE position <= 5",
        "p4_found": f"{_HASHES} SELECT photo_id_a, photo_id_b FROM pairs",
        "p4_groups": _HASHES.replace("WITH h", "WITH RECURSIVE h") + """, classes AS (SELECT p, d, min(id) AS rep FROM v GROUP BY p, d),
near AS (SELECT a.rep AS a, b.rep AS b FROM classes a JOIN classes b ON a.rep <> b.rep AND bit_count(xor(a.p, b.p)) <= 7 AND bit_count(xor(a.d, b.d)) <= 12),
reach AS (SELECT rep, rep AS other FROM classes UNION SELECT r.rep, n.b FROM reach r JOIN near n ON n.a = r.other),
groups AS (SELECT rep, min(other) AS group_id FROM reach GROUP BY rep)
SELECT v.id AS photo_id, c.rep AS class_id, (SELECT count(*) FROM near WHERE near.a = c.rep) AS links, group_id FROM v JOIN classes c USING (p, d) JOIN groups g ON g.rep = c.rep""",
        "p5_found": """WITH RECURSIVE known AS (SELECT 'photo' AS kind, id FROM photos UNION ALL SELECT 'face', id FROM faces),
pairs AS (SELECT kind, left_id AS a, right_id AS b FROM match_pairs m WHERE left_id <> right_id AND EXISTS (SELECT 1 FROM known k WHERE k.kind = m.kind AND k.id = m.left_id)
  AND EXISTS (SELECT 1 FROM known k WHERE k.kind = m.kind AND k.id = m.right_id)),
both_ways AS (SELECT kind, a, b FROM pairs UNION SELECT kind, b, a FROM pairs),
reach AS (SELECT kind, a AS record_id, a AS other FROM both_ways UNION SELECT r.kind, r.record_id, e.b FROM reach r JOIN both_ways e ON e.kind = r.kind AND e.a = r.other)
SELECT kind, record_id, min(other) AS group_id FROM reach GROUP BY kind, record_id""",
        "p7_found": f"""{_RANKS} SELECT min(CASE WHEN mean_rank = 1 THEN photo_id END) AS photo_id FROM placed GROUP BY folder HAVING count(*) >= 5 AND count(*) FILTER (WHERE mean_rank = 1) = 1""",
        "p7_order": f"{_RANKS} SELECT folder, photo_id, median_rank, mean_rank, position FROM placed",
        "p9_checks": """SELECT t.source, t.target_share, t.max_repeats, count(DISTINCT d.text) AS texts, 0 AS broken FROM mix_targets t
LEFT JOIN documents d ON d.source = t.source AND d.doc_id IS NOT NULL AND length(trim(d.text, chr(32) || chr(9) || chr(10) || chr(13))) > 0 GROUP BY t.source, t.target_share, t.max_repeats""",
        "p8_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents",
    }
