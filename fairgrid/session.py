"""Session helpers: the package on the executors, Arrow batches of bounded size."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in ``spark.checkpoint.dir``, removed when the driver's JVM ends; only a local master may lack that setting."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), f"fairgrid-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/fairgrid/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


#: Bytes of an Arrow batch; Spark's own bound of 10 000 rows lets long texts fill a Python worker.
BATCH_BYTES = 4 << 20


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once an application, by ``addPyFile``, and bound Arrow batches by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    work = Path(tempfile.mkdtemp(prefix="fairgrid-"))
    shutil.copytree(top, work / "tree" / top.name, ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(os.fspath(work / top.name), "zip", work / "tree")
    spark.sparkContext.addPyFile(archive)
    shutil.rmtree(work / "tree")
    _shipped.add(app)
