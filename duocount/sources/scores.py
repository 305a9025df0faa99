"""Per-gene score tables."""

from __future__ import annotations

from typing import Optional, Sequence, Union

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duocount.functions.scalar import nan_to_null
from duocount.operators.compare import drop_empty_rows, require_columns
from duocount.schemas import FEATURE_KEY_SCHEMA

Paths = Union[str, Sequence[str]]


def read_scores(spark: SparkSession, paths: Paths, key_schema=FEATURE_KEY_SCHEMA, text_cols: Sequence[str] = (),
                keep_file: bool = False) -> DataFrame:
    """CSV with a header row (S03). Keys get their declared types, every other column ``try_cast`` to
    DOUBLE (columns in ``text_cols`` stay text); ``NaN`` becomes null, so it never enters a comparison
    (rule Q6). All-null rows are dropped (F01, also for control-only loads: rule Q14).

    The header is read once; no type inference pass runs over the data. Columns are read by position,
    so every file's header is held against it: a file with another order of columns is an error.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("nullValue", "").option("enforceSchema", False)
    raw = reader.csv(paths if isinstance(paths, str) else list(paths))
    require_columns(raw, [f.name for f in key_schema.fields], "score table")
    cols = []
    for c in raw.columns:
        key = next((f for f in key_schema.fields if f.name == c), None)
        if key is not None:
            cols.append(F.expr(f"try_cast(`{c}` as {key.dataType.simpleString()})").alias(c))
        elif c in text_cols:
            cols.append(F.col(f"`{c}`"))
        else:
            cols.append(nan_to_null(F.expr(f"try_cast(`{c}` as double)")).alias(c))
    if keep_file:
        cols.append(F.col("_metadata.file_path").alias("file_path"))
    return drop_empty_rows(raw.select(*cols))


def drop_missing_locus(df: DataFrame, key: str = "locus_tag") -> DataFrame:
    """Rows without a locus tag are not features."""
    return df.na.drop(subset=[key])


def discover(spark: SparkSession, root: str, pattern: str = "*.csv",
             run_regex: Optional[str] = r"([^/]+)/[^/]+$", condition_regex: Optional[str] = r"_(control|test)[^/]*$") -> DataFrame:
    """Input files under ``root`` matching ``pattern`` (S04): ``path, length, modified, run_id, condition``.

    Uses the binary-file source with the content column pruned, so files are listed, not read.
    Run and condition come from the path by regular expression.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(root)
             .select("path", "length", F.col("modificationTime").alias("modified")))
    if run_regex:
        files = files.withColumn("run_id", F.regexp_extract("path", run_regex, 1))
    if condition_regex:
        files = files.withColumn("condition", F.nullif(F.regexp_extract("path", condition_regex, 1), F.lit("")))
    return files


def export_table(df: DataFrame, out: str, fmt: str = "csv", readable_headers: bool = False, mode: str = "overwrite") -> None:
    """Write the shown table (S08): CSV with a header row, or Parquet. ``readable_headers`` turns
    underscores into spaces (P13)."""
    if readable_headers:
        df = df.withColumnsRenamed({c: c.replace("_", " ") for c in df.columns})
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(out)
    elif fmt == "parquet":
        w.parquet(out)
    else:
        raise ValueError("fmt must be 'csv' or 'parquet'")
