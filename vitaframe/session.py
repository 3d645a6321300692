"""Session settings that the jobs in this package are written for."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# AQE coalesces small shuffle partitions, splits skewed join partitions and
# turns a shuffled join into a broadcast one when the measured side is small.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "vitaframe", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session; extra settings win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The location comes from ``spark.checkpoint.dir``. A session on one machine may do without it and gets a
    temporary folder; on a cluster that would be another folder on every machine, so it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="vitaframe-")
    unique = spark.sparkContext.applicationId + "-" + os.urandom(6).hex()
    return f"{root.rstrip('/')}/{name}-{unique}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in a folder of its own: a cut in the lineage that outlives executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
