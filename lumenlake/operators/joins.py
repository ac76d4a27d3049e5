"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.shared import materialize

#: A key is hot with more than this share of the rows: at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1e-3
#: Below so many rows a key is never hot, as one task takes them easily.
HOT_LEAST = 50_000


def skew_join(rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` (``total`` of them, any skew) with ``table``, which has a key once.

    Hot keys are counted with partial aggregation first. Their rows stay where they are
    and get the few rows of the table by broadcast (at most 1 / HOT_SHARE of them); all
    others are shuffled. ``how``: inner or left. Null keys match nothing.
    """
    least = max(HOT_LEAST, int(total * HOT_SHARE))
    if total <= least:
        return rows.join(table, keys, how)
    hot = materialize(rows.groupBy(*keys).count().filter(F.col("count") > least).select(*keys), "hot")
    if hot.isEmpty():
        return rows.join(table, keys, how)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    cold = marked.filter("_hot is null").drop("_hot").join(table, keys, how)
    few = F.broadcast(table.join(F.broadcast(hot), keys, "left_semi"))
    return marked.filter("_hot").drop("_hot").join(few, keys, how).unionByName(cold)
