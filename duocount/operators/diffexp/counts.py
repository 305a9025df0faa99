"""Count matrix, size factors, normalised counts.

The matrix is one row per entity with an ARRAY<BIGINT> of counts in a fixed sample order. The
sample list is small (bounded by the number of replicates) and is the only thing the driver holds.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import List, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duocount.functions.scalar import group_label
from duocount.operators.ordered import FEW_GROUPS, exact_quantiles
from duocount.spec import CountDataError


@dataclass(frozen=True)
class Design:
    """Samples in matrix order and their condition index (0 = control, 1 = test)."""

    samples: tuple
    conditions: tuple
    levels: tuple = ("control", "test")

    @property
    def groups(self) -> List[int]:
        return [self.levels.index(c) for c in self.conditions]


def pool_columns(df: DataFrame, marker: str = "_MP") -> list:
    """Replicate columns of a wide table: names containing ``marker``."""
    return [c for c in df.columns if marker in c]


def long_counts_from_wide(df: DataFrame, entity: str, marker: str = "_MP", order: Sequence[str] = ()) -> DataFrame:
    """Wide replicate columns to the long table (D01): of rows sharing an entity id the first in ``order``
    stays (then the least counts, nulls first), and only then rows with any null go (F03), so an entity
    whose first row is incomplete is dropped; condition = text after the last underscore (P10)."""
    cols = pool_columns(df, marker)
    if not cols:
        raise CountDataError(f"no replicate columns containing {marker!r}")
    rank = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    first = df.groupBy(F.col(entity).cast("string").alias("entity_id")).agg(F.min(F.struct(*rank, *cols)).alias("_r"))
    w = first.select("entity_id", *[F.col("_r").getField(c).alias(c) for c in cols]).na.drop(how="any")
    long = w.unpivot(["entity_id"], cols, "sample", "cnt")
    return long.withColumn("condition", group_label("sample"))


def sample_table(long: DataFrame) -> DataFrame:
    """Distinct (sample, condition) pairs; J06 attaches it to samples (broadcast: one row per replicate)."""
    return long.select("sample", "condition").distinct()


def read_design(long: DataFrame, levels=("control", "test")) -> tuple[Design, int]:
    """Samples and conditions (one row per sample reaches the driver), and how many counts are negative or fractional."""
    agg = long.groupBy("sample", "condition").agg(
        F.count_if((F.col("cnt") != F.floor("cnt")) | (F.col("cnt") < 0)).alias("_bad")).collect()
    rows = sorted((r["condition"], r["sample"]) for r in agg)
    return Design(tuple(s for _, s in rows), tuple(c for c, _ in rows), tuple(levels)), sum(r["_bad"] for r in agg)


def check_design(design: Design, bad_counts: int = 0) -> None:
    """Raise on unusable counts or conditions."""
    if bad_counts:
        raise CountDataError(f"{bad_counts} counts are negative or not integers")
    bad = sorted({c for c in design.conditions if c not in design.levels})
    if bad:
        raise CountDataError(f"conditions {bad} are not in {design.levels}")


def design_of(long: DataFrame, levels=("control", "test"), check_integers: bool = True) -> Design:
    """The checked design of a table of counts."""
    design, bad_counts = read_design(long, levels)
    check_design(design, bad_counts if check_integers else 0)
    return design


def count_matrix(long: DataFrame, design: Design, partitions: int = None) -> DataFrame:
    """``entity_id, counts ARRAY<BIGINT>`` in design order; a missing (entity, sample) pair is 0 and
    repeated rows of one pair add up.

    Sums per (entity, sample), so a hot entity collapses map-side, then the entity's few sums as a map: the
    expressions do not grow with the number of samples. ``partitions``: of the entities, by hash.
    """
    order = long.sparkSession.createDataFrame([(s, i) for i, s in enumerate(design.samples)], "sample string, _j int")
    placed = long.join(F.broadcast(order), "sample")   # one row a replicate
    sums = placed.groupBy("entity_id", "_j").agg(F.sum(F.col("cnt").cast("bigint")).alias("_n"))
    if partitions:
        sums = sums.repartition(partitions, "entity_id")
    cells = sums.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("_j", "_n"))).alias("_m"))
    return cells.select("entity_id", F.expr(
        f"transform(sequence(0, {len(design.samples) - 1}), j -> coalesce(_m[j], 0L))").alias("counts"))


def nonzero_per_sample(long: DataFrame) -> DataFrame:
    """Per sample, entities with a non-zero count."""
    return long.groupBy("sample").agg(F.count_if(F.col("cnt") != 0).alias("nonzero"))


def size_factors(matrix: DataFrame, design: Design) -> List[float]:
    """Median-of-ratios size factor per sample.

    Over entities with every count > 0: s_j = exp(median_i(ln k_ij - mean_j ln k_ij)). The median is
    exact and distributed (no group is collected into one buffer); S numbers reach the driver.
    """
    S = len(design.samples)
    pos = matrix.where(F.forall("counts", lambda c: c > 0))
    logs = pos.select(F.transform("counts", lambda c: F.log(c.cast("double"))).alias("_l"))
    logs = logs.select("_l", F.aggregate("_l", F.lit(0.0), lambda a, x: a + x).alias("_s"))
    ratios = logs.select(F.posexplode(F.transform("_l", lambda x: x - F.col("_s") / F.lit(float(S)))).alias("j", "r"))
    med = exact_quantiles(ratios, "r", {"med": 0.5}, by=["j"], few=S <= FEW_GROUPS).collect()
    found = {r["j"]: r["med"] for r in med}
    if len(found) < S:
        raise CountDataError("no entity has a positive count in every sample; size factors undefined")
    import math
    return [math.exp(found[j]) for j in range(S)]


def normalised(matrix: DataFrame, sf: Sequence[float]) -> DataFrame:
    """Normalised counts, baseMean, row variance (sample variance of normalised counts)."""
    sfa = F.array(*[F.lit(float(s)) for s in sf])
    S = len(sf)
    q = F.zip_with("counts", sfa, lambda c, s: c.cast("double") / s)
    out = matrix.withColumn("norm", q)
    mean = F.aggregate("norm", F.lit(0.0), lambda a, x: a + x) / F.lit(float(S))
    out = out.withColumn("baseMean", mean)
    var = F.aggregate("norm", F.lit(0.0), lambda a, x: a + (x - F.col("baseMean")) * (x - F.col("baseMean"))) / F.lit(float(max(S - 1, 1)))
    return out.withColumn("rowVar", var)
