"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` of the session is used as it is, or else the folder that was given to the
context with ``setCheckpointDir``. Only where both are unset, and only if everything runs on one
machine, as in tests, a temporary folder takes their place. A written table survives lost executors
and cuts the lineage.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK = "fitlake.scratch.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, as a URI without a slash at its end."""
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


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host that Hadoop gives it, in the spelling that pyarrow opens."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    scheme = hadoop.toUri().getScheme()
    if scheme is None:
        store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        path = hadoop.makeQualified(store.getUri(), store.getWorkingDirectory()).toString()
        scheme = path.split(":", 1)[0]
    if scheme == "file":
        return "file://" + path.split(":", 1)[1].replace("///", "/", 1)
    return re.sub(r"^s3[an]:", "s3:", path)


def new_path(spark: SparkSession, label: str) -> str:
    """A path that nothing has used yet, below a folder of this application."""
    return f"{shared_dir(spark)}/fitlake/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete the tables of this application. Call it once no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(
        f"{shared_dir(spark)}/fitlake/{spark.sparkContext.applicationId}"
    )
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
