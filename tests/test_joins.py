from pyspark.sql import functions as F

from lumenlake.operators import curation, joins
from lumenlake.operators.joins import skew_join


def test_hot_keys_stay_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_LEAST", 50)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.when(F.col("id") % 100 == 1, None).otherwise(F.col("id"))).alias("k"), "id")
    table = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        want = sorted(map(repr, rows.join(table, "k", how).select("k", "id", "v").collect()))
        assert sorted(map(repr, skew_join(rows, table, ["k"], 3000, how).select("k", "id", "v").collect())) == want
    plan = skew_join(rows, table, ["k"], 3000)._jdf.queryExecution().toString()
    assert "Union" in plan


def test_union_find_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_LEAST", 20)
    pairs = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(300, 340)] + [(500, 500), (None, 1)]
    got = {r.vertex: r.root for r in curation.union_find(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {k: 0 for k in range(200)} | {k: 300 for k in range(300, 341)}
    assert curation.union_find(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
