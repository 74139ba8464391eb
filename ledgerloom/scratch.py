"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders made for local sessions that name none (tests), by application.
_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder of a local session. A cluster's executors have no folder in common, so there it has to be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return _OWN[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the scratch folder; what is written there goes when the application ends."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df and read it back, which cuts its lineage; the files go when the application ends."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote, once nothing reads them any more: what was made of them has been written itself. Other files are never touched."""
    for table in tables:
        jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for path in {found.group(1) for found in (re.match(r"(.*-[0-9a-f]{32})/[^/]+$", f) for f in table.inputFiles()) if found}:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
