"""Where tables that one run needs for itself are kept: a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def new_place(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, removed when the JVM ends; where that is unset, in a cluster's warehouse or a local session's temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    if not base:
        _own[:] = _own or ["file://" + tempfile.mkdtemp(prefix="shelfmark-")]
        base = _own[0]
    place = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return place


def kept(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to a new place and read again."""
    place = new_place(frame.sparkSession, name)
    frame.write.parquet(place)
    return frame.sparkSession.read.schema(frame.schema).parquet(place)
