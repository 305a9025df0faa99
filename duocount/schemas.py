"""Explicit schemas: nothing on the hot path re-infers types."""

from pyspark.sql import types as T

# The nine column names of a coordinate (GFF3) line, in file order.
GFF_COLUMNS = ("seq_id", "source", "type", "start", "end", "score", "strand", "phase", "attributes")

GFF_SCHEMA = T.StructType([
    T.StructField("seq_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("score", T.StringType()),
    T.StructField("strand", T.StringType()),
    T.StructField("phase", T.StringType()),
    T.StructField("attributes", T.StringType()),
])

FEATURE_KEY_SCHEMA = T.StructType([
    T.StructField("seq_id", T.StringType()),
    T.StructField("locus_tag", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("gene", T.StringType()),
    T.StructField("start_pos", T.LongType()),
    T.StructField("end_pos", T.LongType()),
    T.StructField("feat_length", T.LongType()),
    T.StructField("product", T.StringType()),
])

COUNTS_LONG_SCHEMA = T.StructType([
    T.StructField("entity_id", T.StringType()),
    T.StructField("sample", T.StringType()),
    T.StructField("condition", T.StringType()),
    T.StructField("cnt", T.LongType()),
])

DE_RESULT_COLUMNS = ("baseMean", "log2FoldChange", "lfcSE", "stat", "pvalue", "padj")
