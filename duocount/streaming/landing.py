"""Landing-folder ingest of dropped score and coordinate files (S05) with Structured Streaming.

Each new file under ``landing`` is read once (the checkpoint records which files were seen) and its rows are
appended to a Parquet table with the source file name. A name is stored once: a file whose name an earlier
one already has, from whatever folder, is refused and logged; of one micro-batch the file modified first is
stored, then the one with the least path. Score rows without a locus tag are dropped; coordinate lines
without nine fields keep their text.

Every micro-batch writes its rows and its names to folders of its own id (``batch_id=N``), replacing what an
attempt that failed has left there, so a batch run again after a lost driver or executor stores nothing twice. The names of
earlier batches are joined, not collected, and no state is kept: no watermark is needed. Run it with
``available_now=True`` as a batch job that processes everything new and stops. A table has one ingest
at a time, and a file without rows has no name to store.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duocount.functions.scalar import nan_to_null
from duocount.schemas import FEATURE_KEY_SCHEMA
from duocount.sources.coordinates import parse_coordinates

NAMES_SCHEMA = "file_path string, source_file string, modified timestamp, stored boolean, batch_id long"
REFUSED = "File Already Exists"
_FILE = ["file_path", "source_file", "modified"]


def landing_schema(score_columns) -> T.StructType:
    """Stream sources need a fixed schema: the keys plus the named score columns as DOUBLE."""
    return T.StructType(list(FEATURE_KEY_SCHEMA.fields) + [T.StructField(c, T.DoubleType()) for c in score_columns])


def _file_columns():
    path = F.col("_metadata.file_path")
    return [path.alias("file_path"), F.element_at(F.split(path, "/"), -1).alias("source_file"),
            F.col("_metadata.file_modification_time").alias("modified")]


def dropped_scores(spark: SparkSession, landing: str, schema: T.StructType, pattern: str = "*.csv") -> DataFrame:
    """Stream of the rows of dropped score files, with the columns of their file."""
    src = (spark.readStream.schema(schema).option("header", True).option("pathGlobFilter", pattern)
           .option("nullValue", "").option("enforceSchema", False).csv(landing))
    doubles = [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)]
    return src.select(*[nan_to_null(F.col(c)).alias(c) if c in doubles else F.col(c) for c in src.columns], *_file_columns())


def dropped_coordinates(spark: SparkSession, landing: str, comment: str = "inline", pattern: str = "*.gff*") -> DataFrame:
    """Stream of the rows of dropped coordinate files, with the columns of their file."""
    src = spark.readStream.option("pathGlobFilter", pattern).text(landing)
    return parse_coordinates(src.select(F.col("value").alias("line"), *_file_columns()), comment, _FILE)


def names_folder(table: str) -> str:
    return table.rstrip("/") + "-names"


def _names(spark: SparkSession, table: str) -> Optional[DataFrame]:
    """Every name seen so far, or None before the first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(names_folder(table))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(NAMES_SCHEMA).parquet(names_folder(table))


def _store(table: str, keep=None):
    """foreachBatch function: rows of files with new names to ``table``, all names to the registry."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files = batch.groupBy("source_file", "file_path").agg(F.min("modified").alias("modified"))
        first = F.min(F.struct("modified", "file_path"))
        names = files.join(files.groupBy("source_file").agg(first.alias("_first")), "source_file")
        stored = F.col("file_path") == F.col("_first.file_path")
        before = _names(spark, table)
        if before is not None:
            # a batch that is run again does not meet its own names
            taken = before.where((F.col("batch_id") < batch_id) & F.col("stored")).select("source_file", F.lit(True).alias("_taken"))
            names = names.join(taken, "source_file", "left")
            stored = stored & F.col("_taken").isNull()
        here = f"{names_folder(table)}/batch_id={batch_id}"
        names.select(*_FILE, stored.alias("stored")).write.mode("overwrite").parquet(here)
        new = spark.read.parquet(here).where("stored").select("file_path")
        rows = batch.join(new, "file_path", "left_semi")
        rows = rows.where(keep) if keep is not None else rows
        rows.select(*[c for c in batch.columns if c not in _FILE], "source_file").write.mode("overwrite").parquet(
            f"{table.rstrip('/')}/batch_id={batch_id}")

    return run


def _start(rows: DataFrame, table: str, checkpoint: str, keep, available_now: bool, processing_time: Optional[str]):
    w = rows.writeStream.foreachBatch(_store(table, keep)).option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def start_ingest(spark: SparkSession, landing: str, table: str, checkpoint: str, schema: T.StructType,
                 available_now: bool = True, processing_time: Optional[str] = None, pattern: str = "*.csv"):
    """Start the ingest of score files; returns the ``StreamingQuery``."""
    return _start(dropped_scores(spark, landing, schema, pattern), table, checkpoint, F.col("locus_tag").isNotNull(),
                  available_now, processing_time)


def start_coordinate_ingest(spark: SparkSession, landing: str, table: str, checkpoint: str, comment: str = "inline",
                            available_now: bool = True, processing_time: Optional[str] = None, pattern: str = "*.gff*"):
    """Start the ingest of coordinate files; returns the ``StreamingQuery``."""
    return _start(dropped_coordinates(spark, landing, comment, pattern), table, checkpoint, None, available_now, processing_time)


def ingest_available(spark: SparkSession, landing: str, table: str, checkpoint: str, schema: T.StructType) -> None:
    """Process every score file not yet seen and wait for it."""
    start_ingest(spark, landing, table, checkpoint, schema, available_now=True).awaitTermination()


def ingest_coordinates_available(spark: SparkSession, landing: str, table: str, checkpoint: str, comment: str = "inline") -> None:
    """Process every coordinate file not yet seen and wait for it."""
    start_coordinate_ingest(spark, landing, table, checkpoint, comment, available_now=True).awaitTermination()


def landed(spark: SparkSession, table: str) -> DataFrame:
    """The rows stored so far, with ``source_file``."""
    return spark.read.parquet(table).drop("batch_id")


def landing_log(spark: SparkSession, table: str) -> DataFrame:
    """One row per file seen: ``source_file, file_path, batch_id, stored, reason`` (null where it was stored)."""
    names = _names(spark, table)
    names = spark.createDataFrame([], NAMES_SCHEMA) if names is None else names
    return names.select("source_file", "file_path", "batch_id", "stored",
                        F.when(~F.col("stored"), F.lit(REFUSED)).alias("reason"))
