"""One ranking from several differently scaled scores by median rank aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.ordering import global_positions


def median_rank(df: DataFrame, group: str, identifier: str, scores: list[str], weights: list[float] | None = None, partitions: int | None = None) -> DataFrame:
    """Order the items of each group by their weighted median rank.

    Every item's rank is taken in each score (higher is better; equal values share the
    best rank of the tie; null and NaN tie below all values), so that only order counts,
    never scale. The weighted median rank is the smallest rank at which at least half of
    the weight is reached. Items are ordered by it, then by weighted mean rank, then by
    identifier. Ranks and the final positions come from a global range-partitioned sort,
    so a group may have any size.

    Rows of one identifier in a group stand for one item with its best rank in each score.
    Null groups or identifiers are left out. Weights must be positive (equal if not given).
    Result: ``group, identifier, ranks (array), median_rank, mean_rank, position``.
    """
    if not scores:
        raise ValueError("at least one score is needed")
    weights = [float(w) for w in (weights or [1.0] * len(scores))]
    if len(weights) != len(scores) or any(not w > 0 for w in weights):
        raise ValueError("one positive weight per score is needed")
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + 0.0)
    long = df.filter(F.col(group).isNotNull() & F.col(identifier).isNotNull()).select(
        F.col(group).alias("_group"), F.col(identifier).alias("_item"),
        F.posexplode(F.array(*[value(s) for s in scores])).alias("_score", "_value"),
    )
    ranked = global_positions(long, ["_group", "_score"], [F.col("_value").desc_nulls_last(), F.col("_item")], ["_value"], "_p", "_rank", partitions=partitions)
    each = [F.min(F.when(F.col("_score") == k, F.col("_rank"))).alias(f"_r{k}") for k in range(len(scores))]
    wide = ranked.groupBy("_group", "_item").agg(*each)
    ranks = F.array(*[F.col(f"_r{k}") for k in range(len(scores))])
    half = sum(weights) / 2
    reached = [reduce(lambda a, b: a + b, [F.when(F.col(f"_r{j}") <= F.col(f"_r{k}"), w).otherwise(0.0) for j, w in enumerate(weights)]) for k in range(len(scores))]
    medians = [F.when(r >= half, F.col(f"_r{k}")) for k, r in enumerate(reached)]
    median = F.least(*medians) if len(medians) > 1 else medians[0]
    mean = reduce(lambda a, b: a + b, [F.col(f"_r{k}") * w for k, w in enumerate(weights)]) / sum(weights)
    items = wide.select("_group", "_item", ranks.alias("ranks"), median.alias("median_rank"), mean.alias("mean_rank"))
    placed = global_positions(items, ["_group"], [F.col("median_rank"), F.col("mean_rank"), F.col("_item")], [], "position", "_tie", partitions=partitions)
    return placed.select(F.col("_group").alias(group), F.col("_item").alias(identifier), "ranks", "median_rank", "mean_rank", "position")
