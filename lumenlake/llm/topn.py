"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.ordering import global_positions


def top_n_per_group(df: DataFrame, group: str, score: str, identifier: str, n: int, version: str | None = None, partitions: int | None = None) -> DataFrame:
    """The ``n`` items with the highest ``score`` of every group, with their position.

    Rows are sorted globally by group, falling score and rising identifier with range
    partitioning; the counts that groups reach at the end of each partition are carried
    into the next one, which gives every row its exact position in its group, however
    many partitions the group fills. Positions up to ``n`` stay.

    With ``version``, of several rows of a (group, identifier) pair only the one with the
    highest version counts; without it each row counts. Rows with a null or NaN score
    never come out, nor do null groups or identifiers. -0.0 ties with 0.0. ``n`` below 1
    gives no rows. Result: ``group, identifier, score, position``.
    """
    rows = df.filter(F.col(group).isNotNull() & F.col(identifier).isNotNull())
    if version is not None:
        # Only the newest row counts, even if its score is null; rows without a version are oldest.
        newest = F.max(F.struct(F.col(version).alias("v"), F.col(score).alias("s")))
        rows = rows.groupBy(group, identifier).agg(newest.alias("_n")).select(group, identifier, F.col("_n.s").alias("_s"))
    else:
        rows = rows.select(group, identifier, F.col(score).alias("_s"))
    value = F.col("_s").cast("double")
    rows = rows.filter(value.isNotNull() & ~F.isnan(value)).select(group, identifier, (value + 0.0).alias("score"))
    ranked = global_positions(rows, [group], [F.col("score").desc(), F.col(identifier)], [], position="position", rank="_rank", limit=max(n, 0), partitions=partitions)
    return ranked.select(group, identifier, "score", "position")
