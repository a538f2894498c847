"""Tables that several branches of a plan read, written once into the folder that all executors share.

``spark.checkpoint.dir`` of the session is used, or else the folder given to ``setCheckpointDir``; only where
everything runs on one machine, a temporary folder takes its place. A written table survives lost executors,
cuts the lineage, and keeps plans short.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK = "fitlake.keep.dir"


def shared_folder(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = given.get() if given.isDefined() else spark.conf.get(_FALLBACK, None)
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="fitlake-")
        spark.conf.set(_FALLBACK, configured)
    return configured.rstrip("/")


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fitlake-kept/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
