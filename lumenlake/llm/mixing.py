"""Mixing sources to target weights with hash-threshold histograms.

Every text has a fixed hash. A source's budget is some whole uses of all its texts plus
a rest, and the rest goes to the texts below a hash threshold. The threshold is found
from the token sums of hash buckets: running sums tell which bucket the budget ends in,
and only that bucket is split further, level by level. Texts are then filtered by the
threshold; nothing is sorted, and a larger budget always takes a superset.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.tokenizer import TOKENIZER, count_tokens
from lumenlake.operators.joins import skew_join
from lumenlake.shared import materialize

#: Hash bits by level: 5 x 12 bits, so at most 4,096 buckets a source at once.
_LEVEL_BITS, _LEVELS = 12, 5
_HASH_BITS = _LEVEL_BITS * _LEVELS
#: Tables with a row per source are broadcast up to so many sources.
_FEW = 100_000


def _bucket(level: int) -> Column:
    """The first ``level`` x 12 bits of the hash."""
    return F.shiftright("h", _HASH_BITS - _LEVEL_BITS * level)


def sized_texts(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """One row per text of a source in ``targets``: ``source, doc_id, copies, n_tokens, h``.

    Equal texts of a source are one text, kept under the smallest doc_id, so that its uses
    can be counted. Null, empty and blank texts, and rows without doc_id, are no texts.
    """
    known = materialize(targets.filter("source is not null").select("source").distinct(), "sources")
    rows = documents.filter("doc_id is not null and source is not null and text is not null and length(trim(both ' \t\n\r' from text)) > 0")
    rows = rows.join(F.broadcast(known), "source", "left_semi") if known.count() <= _FEW else rows.join(known, "source", "left_semi")
    sized = count_tokens(rows.select("source", "doc_id", F.sha2("text", 256).alias("_key"), "text"), path=path)
    one = sized.groupBy("source", "_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("n_tokens").alias("n_tokens"))
    h = F.shiftrightunsigned(F.xxhash64("_key", "source"), 64 - _HASH_BITS)
    return materialize(one.filter("n_tokens > 0").select("source", "doc_id", "copies", "n_tokens", h.alias("h")), "sized")


def budgets(texts: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row per source of ``targets``: ``source, target_share, max_repeats, available, share, budget``.

    ``share`` is the target share among the sources that have texts and may be used, so that
    the shares sum to 1. Without ``total`` the budget is the largest with which all of
    these reach their share; with it, a source that can't is cut off at its texts times
    repeats. Repeated targets of a source are summed, the smallest max_repeats counting; null or
    negative shares and repeats count as 0.
    """
    clean = targets.filter("source is not null").groupBy("source").agg(
        F.sum(F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0)).alias("target_share"),
        F.min(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"),
    )
    have = texts.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("texts"))
    every = Window.partitionBy()  # as many rows as targets has sources
    usable = (F.col("available") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    capacity = F.col("available") * F.col("max_repeats")
    out = clean.join(have, "source", "left").fillna(0, ["available", "texts"])
    out = out.withColumn("share", F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(every)).otherwise(0.0))
    most = F.min(F.when(usable, capacity / F.col("share"))).over(every) if total is None else F.lit(float(total))
    wanted = F.floor(F.col("share") * most + 1e-6)
    return out.withColumn("budget", F.when(usable, F.least(wanted, capacity)).otherwise(0).cast("long"))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """Choose texts so that every source gives its share of all tokens.

    Result: the chosen texts ``doc_id, source, n_tokens, uses`` (uses up to the source's
    max_repeats) and the report ``source, target_share, max_repeats, available_tokens, texts,
    budget_tokens, chosen_tokens, chosen_texts, most_uses, actual_share, shortfall_tokens``, a row per
    source of ``targets``. Each source ends as near to its budget as whole texts in the order of their hash allow: off by at most
    half the text at the threshold (``shortfall_tokens`` is negative where that text was taken).
    """
    texts = sized_texts(documents, targets, path)
    plan = materialize(budgets(texts, targets, total), "budgets")
    few = plan.count() <= _FEW
    with_source = lambda rows, table: rows.join(F.broadcast(table), "source") if few else skew_join(rows, table, ["source"], rows.count())
    whole = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("long")
    opened = plan.select("source", (F.col("budget") - whole * F.col("available")).alias("rest"), F.lit(0).cast("long").alias("prefix"))
    below = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most 4,096 buckets
    closed = []
    for level in range(1, _LEVELS + 1):
        # Only texts in the bucket that the budget ends in; at first that is the whole source.
        inside = with_source(texts, opened)
        if level > 1:
            inside = inside.filter(_bucket(level - 1) == F.col("prefix"))
        sums = inside.groupBy("source", "rest", _bucket(level).alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("texts"), F.max("h").alias("h"))
        run = sums.withColumn("upto", F.sum("n").over(below))
        # the first bucket that doesn't fit whole; its predecessors do
        over = run.filter("upto > rest").groupBy("source").agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"), "n", "texts", "h")).alias("x"))
        ends = materialize(over.select("source", "x.*"), "thresholds")
        # A single text is taken if that lands nearer to the budget; so is the last level, where texts share a hash.
        alone = (F.col("texts") == 1) | F.lit(level == _LEVELS)
        closed.append(ends.filter(alone).select("source", F.when(F.col("n") < 2 * F.col("left"), F.col("h") + 1).otherwise(F.col("h")).alias("threshold")))
        opened = ends.filter(~alone).select("source", F.col("left").alias("rest"), F.col("bucket").alias("prefix"))
        if opened.isEmpty():
            break
    limits = plan.select("source", "max_repeats", whole.alias("base")).join(functools.reduce(DataFrame.unionByName, closed), "source", "left")
    # A source without threshold fits whole times only: nothing is left to give.
    extra = F.when(F.col("threshold").isNotNull() & (F.col("h") < F.col("threshold")), 1).otherwise(0)
    chosen = with_source(texts, limits).withColumn("uses", (F.col("base") + extra).cast("long")).filter("uses > 0")
    chosen = chosen.select("doc_id", "source", "n_tokens", "uses")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("chosen_tokens"), F.count("*").alias("chosen_texts"), F.max("uses").alias("most_uses"))
    every = Window.partitionBy()
    report = plan.join(got, "source", "left").fillna(0, ["chosen_tokens", "chosen_texts", "most_uses"])
    all_tokens = F.sum("chosen_tokens").over(every)
    report = report.select(
        "source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), "texts", F.col("budget").alias("budget_tokens"),
        "chosen_tokens", "chosen_texts", "most_uses", F.when(all_tokens > 0, F.col("chosen_tokens") / all_tokens).otherwise(0.0).alias("actual_share"),
        (F.col("budget") - F.col("chosen_tokens")).alias("shortfall_tokens"),
    )
    return chosen, report
