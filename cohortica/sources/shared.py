"""Tables in the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset: a temporary folder if all runs on this machine (tests), an error on a cluster, whose machines would each write to their own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortica-"))
        known = context._jsc.sc().getCheckpointDir().get()
    return known.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it again: lineage ends here, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def session(name: str = "cohortica", **settings: str) -> SparkSession:
    """A session with adaptive plans, UTC, and settings as given (spill folders: spark.local.dir; memory: spark.executor.memory)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
