"""Coordinate (GFF3) files: scan, header, write.

Lines are read with the text source (splittable, one row per line); parsing is column expressions. Headers alone
are read from the start of each file.
"""

from __future__ import annotations

from typing import Sequence, Union

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duocount.schemas import GFF_COLUMNS

Paths = Union[str, Sequence[str]]


def _lines(spark: SparkSession, paths: Paths, path_glob: str = None) -> DataFrame:
    r = spark.read.format("text")
    if path_glob:
        r = r.option("pathGlobFilter", path_glob)
    df = r.load(paths if isinstance(paths, str) else list(paths))
    return df.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_path"))


def read_coordinates(spark: SparkSession, paths: Paths, comment: str = "inline", path_glob: str = None,
                     keep_file: bool = True) -> DataFrame:
    """Tab-separated coordinate rows with the nine fixed columns.

    ``comment='inline'`` drops everything after any ``#`` (what a pandas ``comment='#'`` reader does,
    rule Q7); ``'line'`` only skips lines that start with ``#``. Empty lines are skipped. Lines
    without exactly nine fields keep their text in ``_corrupt`` with null fields. ``start``/``end``
    are BIGINT by ``try_cast``; ``score`` stays text (``.`` means empty; see ``score_value``).
    """
    out = parse_coordinates(_lines(spark, paths, path_glob), comment, ["file_path"])
    return out if keep_file else out.drop("file_path")


def parse_coordinates(lines: DataFrame, comment: str = "inline", keep: Sequence[str] = ()) -> DataFrame:
    """The rows of :func:`read_coordinates` from a table (or stream) of lines ``line``, then the columns ``keep``."""
    line = F.col("line")
    if comment == "inline":
        text = F.when(line.contains("#"), F.regexp_replace(line, "#.*$", "")).otherwise(line)
    elif comment == "line":
        text = F.when(line.startswith("#"), F.lit("")).otherwise(line)
    else:
        raise ValueError("comment must be 'inline' or 'line'")
    df = lines.select(*keep, text.alias("_text")).where(F.length(F.trim(F.col("_text"))) > 0)
    df = df.select("*", F.split(F.col("_text"), "\t").alias("_parts"))   # a column of its own: each line is split once
    parts = F.col("_parts")
    ok = F.size(parts) == len(GFF_COLUMNS)
    fields = []
    for i, name in enumerate(GFF_COLUMNS):
        v = F.when(ok, parts.getItem(i))
        if name in ("start", "end"):
            v = F.when(ok, F.expr(f"try_cast(_parts[{i}] as bigint)"))
        fields.append(v.alias(name))
    return df.select(*fields, F.when(~ok, F.col("_text")).alias("_corrupt"), *keep)


def score_value(col: str = "score"):
    """Numeric score: ``.`` and unreadable text become null (rule Q12; plain CAST raises under ANSI)."""
    return F.expr(f"try_cast({col} as double)")


def unreadable_scores(coords: DataFrame, by: Sequence[str] = ("file_path",)) -> DataFrame:
    """Per file: scores that are neither ``.`` nor a number (reported, not silently lost)."""
    bad = (F.col("score") != ".") & score_value().isNull() & F.col("score").isNotNull()
    return coords.groupBy(*by).agg(F.count_if(bad).alias("unreadable_scores"))


HEADER_SCHEMA = "file_path string, line_no long, text string"
HEADER_PIECE = 65_536      # bytes asked of a file at a time, and characters of a line


def _header_lines(path: str):
    """(number, text) of the leading ``#`` lines of one file; reads on only while they last."""
    import io

    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_stream(name, compression="detect", buffer_size=HEADER_PIECE) as raw:
        lines = io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline=None)
        at, first = 0, None
        while piece := lines.readline(HEADER_PIECE):
            at += 1
            text = piece
            if text.startswith("#"):
                while piece and not piece.endswith("\n"):   # the rest of a long comment
                    piece = lines.readline(HEADER_PIECE)
                    text += piece
                first = at if first is None else first
                yield at - first + 1, text.rstrip("\n")
            elif text.strip(" \n"):
                return


def read_header(spark: SparkSession, paths: Paths, path_glob: str = None) -> DataFrame:
    """Leading ``#`` lines of each file, before its first data line (S02): ``file_path, line_no, text``.

    Files are listed without their content, dealt over the tasks and opened there; reading ends at the first
    data line, so the bytes read do not grow with the files. ``line_no`` counts from the first comment; empty lines
    count but are not returned, nor are comments below the first data line. Paths must be ones that
    ``pyarrow.fs`` opens (local, hdfs, s3, gs); files compressed by their suffix are unpacked.
    """
    r = spark.read.format("binaryFile")
    if path_glob:
        r = r.option("pathGlobFilter", path_glob)
    listed = r.load(paths if isinstance(paths, str) else list(paths))
    files = listed.where(F.col("length") > 0).select(F.col("_metadata.file_path").alias("file_path"))

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for path in pdf["file_path"]:
                rows = [(path, n, text) for n, text in _header_lines(path)]
                yield pd.DataFrame(rows, columns=["file_path", "line_no", "text"])

    parts = spark.sparkContext.defaultParallelism
    return files.repartition(parts, "file_path").mapInPandas(read, HEADER_SCHEMA)


def to_lines(coords: DataFrame) -> DataFrame:
    """Coordinate rows as tab-separated lines."""
    return coords.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in GFF_COLUMNS])
                         .alias("value"))


def write_coordinates(coords: DataFrame, out: str, header: DataFrame = None, mode: str = "overwrite") -> None:
    """Write a coordinate file set: header lines first, then rows ordered by (seq_id, start).

    A global sort range-partitions the rows, so part files concatenated in name order are one valid
    file; no task holds more than its range.
    """
    data = coords.select(F.lit(1).alias("_sec"), F.col("seq_id").alias("_k1"), F.col("start").alias("_k2"),
                         F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in GFF_COLUMNS])
                         .alias("value"))
    if header is not None:
        h = header.select(F.lit(0).alias("_sec"), F.lit("").alias("_k1"), F.col("line_no").cast("bigint").alias("_k2"),
                          F.col("text").alias("value"))
        data = h.unionByName(data)
    data.orderBy("_sec", "_k1", "_k2").select("value").write.mode(mode).text(out)
