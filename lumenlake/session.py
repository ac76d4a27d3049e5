"""Making the library known to a session's executors."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from lumenlake.shared import shared_dir

_shipped: set[str] = set()


def ship_library(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session; they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = f"{shared_dir(spark)}/lumenlake-{uuid.uuid4().hex[:12]}.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
