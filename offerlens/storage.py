"""Tables that jobs keep between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the cluster's checkpoint folder.

    A temporary folder serves only in local mode, where one machine does all the work; elsewhere a missing
    ``spark.checkpoint.dir`` is an error, as every executor would write to a disk of its own.
    """
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if given:
        return f"{given.rstrip('/')}/offerlens-{context.applicationId}"
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="offerlens-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Compute a table once, write it to the shared folder (or ``path``) and go on from there."""
    path = path or new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application stored; call it once its results are written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _OWN.pop(spark.sparkContext.applicationId, None)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch under its own number; a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
