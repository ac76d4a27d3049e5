import gc
import time
from types import SimpleNamespace

import pytest

from lumenlake import shared


def test_needs_a_shared_folder_on_a_cluster():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def _tables(spark):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared.shared_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(root)}


def _collect_garbage(spark):
    spark.range(1).count()  # Spark keeps what ran last
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def test_tables_go_with_their_last_reader(spark):
    _collect_garbage(spark)
    shared.sweep(spark)
    before = _tables(spark)
    table = shared.materialize(spark.range(100), "kept")
    doubled = table.selectExpr("id * 2 AS twice").filter("twice > 10")
    del table
    _collect_garbage(spark)
    shared.sweep(spark)
    assert doubled.count() == 94 and len(_tables(spark) - before) == 1
    del doubled
    for _ in range(20):  # Spark's own threads let go of it in their time
        _collect_garbage(spark)
        shared.sweep(spark)
        if not _tables(spark) - before:
            break
        time.sleep(0.5)
    assert not _tables(spark) - before


def test_what_is_left_does_not_grow(spark):
    import __spark_entry__ as entry

    known = entry.queries()
    left = []
    for _ in range(3):
        for name in ("p3_found", "near_duplicate_groups"):
            known[name](spark, "/root/testdata/sf0.001").count()
        _collect_garbage(spark)
        shared.sweep(spark)
        left.append(len([x for x in _tables(spark) if x.startswith("lumenlake-")]))
    assert left[2] <= left[0] + 2
