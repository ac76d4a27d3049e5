"""The shared folder: where intermediate tables and checkpoints live.

On a cluster the folder is the one named by ``spark.checkpoint.dir``; every
executor can read it, so what is kept there survives the loss of an executor.
Only with a local master may the setting be missing; then a local folder is made.
Tables go once nothing reads them any more, checkpoints by Spark's own cleaner.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of the shared folder that are this program's to remove.
_made: dict[str, SparkSession] = {}
#: Of tables that were read back, a weak reference to what every plan that reads them holds.
_readers: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, set up for ``checkpoint()`` too.

    Raises RuntimeError where it is unset and the master isn't local: a folder of one
    machine would lose rows there.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lumenlake-")
        _made[path] = spark
        atexit.register(_drop_all)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    if not sc.getConf().contains("spark.cleaner.referenceTracking.cleanCheckpoints"):
        sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return path.rstrip("/")


def _drop_all() -> None:
    for path, spark in list(_made.items()):
        try:
            drop(spark, path)
        except Exception:  # the JVM may be gone already
            return


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; removed with its last reader, or when the program ends."""
    root = shared_dir(spark)
    sweep(spark)
    if not _made:
        atexit.register(_drop_all)
    path = f"{root}/lumenlake-{label}-{uuid.uuid4().hex[:12]}"
    _made[path] = spark
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(path, None)
    _readers.pop(path, None)


def sweep(spark: SparkSession) -> int:
    """Delete the tables that no plan in the JVM reads any more; returns how many."""
    gone = [path for path, ref in list(_readers.items()) if _made.get(path) is spark and ref.get() is None]
    for path in gone:
        drop(spark, path)
    return len(gone)


def _watch(df: DataFrame, path: str) -> None:
    """Remember the file index of a table just read: all plans made from it share that object."""
    spark = df.sparkSession
    index = df._jdf.queryExecution().analyzed().relation().location()
    _readers[path] = spark.sparkContext._jvm.java.lang.ref.WeakReference(index)


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, runs the plan once, and leaves nothing on an executor. With a
    ``path`` of the caller the caller removes it, else it goes with its last reader.
    """
    spark = df.sparkSession
    own = path is None
    path = path or scratch(spark, label)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if own:
        _watch(out, path)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint that keeps partitions and the order of their rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
