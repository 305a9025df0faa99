"""Session helpers. The library never changes a user's session except where documented here."""

from __future__ import annotations

import os
import uuid
from typing import Optional

from pyspark.sql import SparkSession


def build_session(master: Optional[str] = None, app: str = "duocount", shuffle_partitions: int = 8,
                  extra: Optional[dict] = None) -> SparkSession:
    """A session with the settings the library relies on (AQE on, ANSI at its default, UI off)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: Optional[str] = None) -> str:
    """The shared folder for lineage cuts, read from ``spark.checkpoint.dir``.

    A fallback is applied only when the session names none (local tests); on a cluster the setting
    must point at shared storage.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if fallback is None:
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder in the session config")
    os.makedirs(fallback, exist_ok=True)
    sc.setCheckpointDir(fallback)
    return fallback


def cut_lineage(df, name: str = "t"):
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    One pass (``Dataset.checkpoint`` would compute the plan twice unless persisted), survives
    executor loss, and later reads get column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/duocount-tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


def drop_table(df) -> None:
    """Delete the files of a table made by :func:`cut_lineage` that nothing reads any more."""
    files = df.inputFiles()
    if files:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(conf).delete(folder, True)
