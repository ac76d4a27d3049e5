"""Consolidating pairwise matches into groups by seed-tree pruning.

In each round every vertex tells its neighbours and itself the smallest vertex of
its neighbourhood. A vertex that nobody names as smallest drops out and hangs below
the smallest one it heard of, in a propagation forest; the others stay, linked by
what their neighbours heard of together. What is left without neighbours is a seed.
At the end the seeds' identifiers flow down the forest, level by level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.joins import skew_join
from lumenlake.shared import drop, materialize, scratch


def _both_ways(pairs: DataFrame, by: list[str]) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    return pairs.select(*by, ends.alias("e")).select(*by, "e.u", "e.v")


def _flow_down(levels: list[DataFrame], by: list[str]) -> DataFrame:
    """A level's parents dropped out later or never: later levels are labelled first."""
    spark, paths, labelled = levels[0].sparkSession, [], None
    for level in reversed(levels):
        if labelled is None:
            labels = level.select(*by, "vertex", F.col("parent").alias("component"))
        else:
            above = labelled.select(*by, F.col("vertex").alias("parent"), F.col("component").alias("_c"))
            joined = skew_join(level, above, [*by, "parent"], level.count(), "left")
            labels = joined.select(*by, "vertex", F.coalesce("_c", "parent").alias("component"))
        paths.append(path := scratch(spark, "labels"))
        materialize(labels, "labels", path)
        labelled = spark.read.schema(labels.schema).parquet(*paths)
    return labelled


def connected_components(pairs: DataFrame, left: str, right: str, by: list[str] | None = None) -> DataFrame:
    """Group identifier of every vertex that is linked to another one.

    ``pairs`` holds undirected links; ``by`` names columns (such as a kind) that keep
    graphs apart. Pairs with a null end or null ``by``, or with equal ends, link nothing;
    repeated and turned pairs count once. Result: ``*by, vertex, component``, the component
    being the smallest vertex of the group. Without links the result is empty.
    """
    by = by or []
    spark = pairs.sparkSession
    ok = F.col(left) != F.col(right)
    for c in by:
        ok &= F.col(c).isNotNull()
    clean = pairs.filter(ok).select(*by, F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct()
    old = scratch(spark, "links")
    links, levels = materialize(_both_ways(clean, by), "links", old), []
    while total := links.count():
        smallest = links.groupBy(*by, "u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        told = skew_join(links, smallest, [*by, "u"], total)
        heard = told.select(*by, F.col("v").alias("x"), "m").unionByName(smallest.select(*by, F.col("u").alias("x"), "m")).distinct()
        heard = materialize(heard, "heard", heard_path := scratch(spark, "heard"))
        best = heard.groupBy(*by, "x").agg(F.min("m").alias("p"), F.max(F.col("x") == F.col("m")).alias("named"))
        levels.append(materialize(best.filter("not named").select(*by, F.col("x").alias("vertex"), F.col("p").alias("parent")), "level"))
        spread = skew_join(heard, best.select(*by, "x", "p"), [*by, "x"], heard.count()).filter("m != p")
        linked = spread.select(*by, F.least("p", "m").alias("a"), F.greatest("p", "m").alias("b")).distinct()
        links = materialize(_both_ways(linked, by), "links", new := scratch(spark, "links"))
        drop(spark, old)
        drop(spark, heard_path)
        old = new
    if not levels:
        return clean.select(*by, F.col("a").alias("vertex"), F.col("b").alias("component")).filter(F.lit(False))
    below = _flow_down(levels, by)
    # A seed is its own group's smallest vertex, so it is the component of what hangs below it.
    roots = below.select(*by, "component").distinct().select(*by, F.col("component").alias("vertex"), "component")
    return below.unionByName(roots)
