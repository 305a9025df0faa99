"""duocount: two-condition comparison of counted events on entities and intervals, on Spark.

Every public function takes and returns a ``pyspark.sql.DataFrame``; column names are arguments.
Data-dependent work runs as Spark jobs (joins, aggregates, windows, Arrow batches); the driver only
ever sees values whose size is bounded by a parameter (bin edges, thresholds, samples, cut points).
"""

from duocount.spec import ComparisonSpec, DuocountError, SchemaError, NotAComparisonError

__all__ = ["ComparisonSpec", "DuocountError", "SchemaError", "NotAComparisonError"]
__version__ = "0.1.0"
