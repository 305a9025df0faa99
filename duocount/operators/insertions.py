"""Insertion profiles and per-feature insertion statistics.

Insertion tables are long: ``run..., seq_id, condition, position, cnt``. A coordinate table read by
``sources.coordinates`` is turned into that form by :func:`profile_from_coordinates`.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duocount.operators import intervals as iv
from duocount.operators.ordered import FEW_GROUPS, next_in_order
from duocount.session import cut_lineage

# Condition labels of a two-condition comparison, in the order they are reported.
CONDITIONS = ("control", "test")


def value_counts(df: DataFrame, cols: Sequence[str], out: str = "count") -> DataFrame:
    """Occurrences per value (A01): partial hash aggregate map-side, final after one shuffle."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(out))


def top_counts(df: DataFrame, cols: Sequence[str], k: int, out: str = "count") -> DataFrame:
    """Most frequent values first, ties by value (O02); ``limit`` plans as TakeOrderedAndProject."""
    return value_counts(df, cols, out).orderBy(F.col(out).desc(), *cols).limit(int(k))


def score_is_empty(coords: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: is every score ``.``? (A02; a null score is not). One aggregate, one row per group."""
    return coords.groupBy(*by).agg(F.bool_and(F.coalesce(F.col("score") == ".", F.lit(False))).alias("empty_score"))


def profile_from_coordinates(coords: DataFrame, by: Sequence[str] = ("condition",),
                             ignore_seq: bool = False, dedupe: str = "keep") -> DataFrame:
    """Insertion profile ``(by..., seq_id, position, count)`` of a coordinate table.

    Per group: if every score is ``.``, count rows per start (count mode); otherwise each row is
    ``(start, score)`` (score mode). Score mode keeps repeated positions as separate rows unless
    ``dedupe='sum'`` (rule Q11). ``ignore_seq=True`` drops ``seq_id`` from the keys (rule Q10).
    Both branches are one plan: the mode flag is a per-group aggregate, written once and joined back,
    by broadcast where it has at most FEW_GROUPS rows, so the rows are not shuffled by a key of few values.
    The columns needed are written once: flag and branches read them, so files are parsed once.
    """
    by = list(by)
    seq = [] if ignore_seq else ["seq_id"]
    coords = cut_lineage(coords.select(*dict.fromkeys([*by, *seq, "start", "score"])), "coordinates")
    if by:
        flag = cut_lineage(score_is_empty(coords, by).select(*[F.col(c).alias(f"_by_{c}") for c in by], "empty_score"),
                           "modes")
        flag = F.broadcast(flag) if flag.count() <= FEW_GROUPS else flag
        same = [coords[c].eqNullSafe(flag[f"_by_{c}"]) for c in by]
        flagged = coords.join(flag, same, "left").drop(*[f"_by_{c}" for c in by])
    else:
        empty = bool(score_is_empty(coords, by).first()["empty_score"])
        flagged = coords.withColumn("empty_score", F.lit(empty))
    count_mode = (flagged.where(F.col("empty_score"))
                  .groupBy(*by, *seq, F.col("start").alias("position"))
                  .agg(F.count(F.lit(1)).cast("double").alias("count")))
    score_mode = flagged.where(~F.col("empty_score")).select(
        *by, *seq, F.col("start").alias("position"), F.expr("try_cast(score as double)").alias("count"))
    if dedupe == "sum":
        score_mode = score_mode.groupBy(*by, *seq, "position").agg(F.sum("count").alias("count"))
    elif dedupe != "keep":
        raise ValueError("dedupe must be 'keep' or 'sum'")
    return count_mode.unionByName(score_mode)


def _total(df: DataFrame, column: str, value=None):
    """Sum of a column: BIGINT for whole counts, DOUBLE for fractional ones (never truncated)."""
    total = F.sum(F.col(column) if value is None else value)
    whole = df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")
    return total.cast("bigint" if whole else "double")


def insertion_sites(ins: DataFrame, by: Sequence[str] = (), position: str = "position",
                    count: str = "cnt") -> DataFrame:
    """Pre-aggregate insertions to one row per site before any shuffle join.

    ``by..., seq_id, condition, position, reads, rows``. Hot positions collapse map-side, so the
    later interval join moves at most one row per (condition, site).
    """
    return (ins.groupBy(*by, "seq_id", "condition", position)
            .agg(_total(ins, count).alias("reads"), F.count(F.lit(1)).alias("rows")))


def condition_totals(sites: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per run and condition: distinct sites, reads and rows over the whole genome (denominators of C04).

    """
    return sites.groupBy(*by, "condition").agg(
        F.count(F.lit(1)).alias("total_sites"), _total(sites, "reads").alias("total_reads"),
        F.sum("rows").cast("bigint").alias("total_rows"))


def _window_bounds(features: DataFrame, buffer_frac: float) -> DataFrame:
    buf = F.lit(float(buffer_frac)) * (F.col("end_pos") - F.col("start_pos"))
    if buffer_frac == 0:
        buf = F.lit(0)
    return (features.withColumn("_lo", (F.col("start_pos") - buf))
            .withColumn("_hi", (F.col("end_pos") + buf)))


def feature_hits(features: DataFrame, sites: DataFrame, by: Sequence[str] = (),
                 conditions: Sequence[str] = CONDITIONS, bounds: str = "open", buffer_frac: float = 0.0,
                 bin_width=None, keep_empty: bool = False) -> DataFrame:
    """Every (feature, condition, site) with the site inside the feature window.

    Window: ``(start - b, end + b)`` open by default (rule Q9), ``b = buffer_frac * (end - start)``.
    ``within_cds`` marks sites in the closed ``[start, end]``. With ``keep_empty`` every feature and
    condition appears at least once (null site) so later aggregates report zeros.
    """
    by = list(by)
    fx = _window_bounds(features, buffer_frac).withColumn(
        "condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
    hits = iv.interval_join(sites, fx, pos="position", lo="_lo", hi="_hi",
                            on=by + ["seq_id", "condition"], bounds=bounds, bin_width=bin_width,
                            how="left" if keep_empty else "inner")
    return (hits.withColumn("within_cds", F.col("position").between(F.col("start_pos"), F.col("end_pos")))
            .drop("_lo", "_hi"))


def feature_totals(features: DataFrame, sites: DataFrame, keys: Sequence[str], by: Sequence[str] = (),
                   conditions: Sequence[str] = CONDITIONS, bounds: str = "open", buffer_frac: float = 0.0,
                   bin_width=None) -> DataFrame:
    """Per feature and condition (A04): reads and rows within the CDS, distinct sites, first/last site.

    Features with no insertion get 0 counts and null first/last.
    """
    by = list(by)
    keys = [k for k in keys if k not in by]
    hits = feature_hits(features, sites, by, conditions, bounds, buffer_frac, bin_width, keep_empty=True)
    inside = F.col("within_cds") & F.col("position").isNotNull()
    return hits.groupBy(*by, *keys, "condition").agg(
        F.coalesce(_total(sites, "reads", F.when(inside, F.col("reads"))), F.lit(0)).alias("total_reads"),
        F.coalesce(F.sum(F.when(inside, F.col("rows"))), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count(F.when(inside, F.lit(1))).alias("unique_sites"),
        F.min(F.when(inside, F.col("position"))).alias("first_pos"),
        F.max(F.when(inside, F.col("position"))).alias("last_pos"),
    )


def gene_scores(features: DataFrame, ins: DataFrame, keys: Sequence[str], by: Sequence[str] = (),
                conditions: Sequence[str] = CONDITIONS, bounds: str = "open", buffer_frac: float = 0.0,
                bin_width=None, strand_col: str = None, materialise_sites: bool = False) -> DataFrame:
    """Per-gene score table in long form, one row per feature and condition.

    nim_score = (distinct sites in gene / gene kb) / (distinct sites in condition / 10^6)
    nrm_score = (reads in gene / gene kb) / (reads in condition / 10^6)
    first/last_insert_pct = 100 * (first/last site - start) / feat_length; 0 when the gene has none,
    so that an essential gene (score 0) sits inside every percentile window.
    ``strand_col`` (off by default): for features on the ``-`` strand the percentages are measured
    from the end, first = 100 * (end - last site) / feat_length, last = 100 * (end - first site) / feat_length.
    ``materialise_sites``: write the per-site table once to the checkpoint folder, so the gene totals
    and the genome totals read it instead of each scanning and aggregating the insertion table.
    """
    by = list(by)
    if strand_col and strand_col not in keys:
        keys = list(keys) + [strand_col]
    sites = insertion_sites(ins, by)
    if materialise_sites:
        sites = cut_lineage(sites, "sites")
    tot = feature_totals(features, sites, keys, by, conditions, bounds, buffer_frac, bin_width)
    den = condition_totals(sites, by).withColumnsRenamed(
        {"total_sites": "cond_sites", "total_reads": "cond_reads"}).drop("total_rows")
    kb = F.col("feat_length") / F.lit(1000.0)
    t = tot.join(den, by + ["condition"], "left")
    length = F.col("feat_length").cast("double")
    first_off = F.col("first_pos") - F.col("start_pos")
    last_off = F.col("last_pos") - F.col("start_pos")
    if strand_col:
        minus = F.col(strand_col) == F.lit("-")
        first_off, last_off = (F.when(minus, F.col("end_pos") - F.col("last_pos")).otherwise(first_off),
                               F.when(minus, F.col("end_pos") - F.col("first_pos")).otherwise(last_off))
    return t.select(
        *[c for c in tot.columns if c not in ("first_pos", "last_pos")],
        F.try_divide(F.try_divide(F.col("unique_sites").cast("double"), kb),
                     F.col("cond_sites") / F.lit(1e6)).alias("nim_score"),
        F.try_divide(F.try_divide(F.col("total_reads").cast("double"), kb),
                     F.col("cond_reads") / F.lit(1e6)).alias("nrm_score"),
        F.coalesce(F.try_divide(F.lit(100.0) * first_off, length), F.lit(0.0)).alias("first_insert_pct"),
        F.coalesce(F.try_divide(F.lit(100.0) * last_off, length), F.lit(0.0)).alias("last_insert_pct"),
    )


def gene_window_table(features: DataFrame, sites: DataFrame, keys: Sequence[str], by: Sequence[str] = (),
                      bounds: str = "open", buffer_frac: float = 0.0, bin_width=None,
                      count: str = "reads") -> DataFrame:
    """Control and test side by side for every site inside every gene window.

    ``by..., keys..., position, control_count, test_count, within_cds``; a site missing on one side
    counts 0. The reference does this for one clicked gene; here all genes in one job.
    """
    by = list(by)
    keys = [k for k in keys if k not in by]
    hits = feature_hits(features, sites, by, CONDITIONS, bounds, buffer_frac, bin_width)
    return (hits.groupBy(*by, *keys, "position")
            .agg(F.coalesce(F.sum(F.when(F.col("condition") == "control", F.col(count))), F.lit(0))
                 .cast("double").alias("control_count"),
                 F.coalesce(F.sum(F.when(F.col("condition") == "test", F.col(count))), F.lit(0))
                 .cast("double").alias("test_count"),
                 F.bool_or("within_cds").alias("within_cds")))


def align_profiles(control: DataFrame, test: DataFrame, keys: Sequence[str] = ("seq_id", "position"),
                   count: str = "count") -> DataFrame:
    """Full outer join of two profiles on position; a missing side counts 0 (J02 as written)."""
    keys = list(keys)
    c = control.select(*keys, F.col(count).alias("control_count"))
    t = test.select(*keys, F.col(count).alias("test_count"))
    return c.join(t, keys, "full").na.fill(0.0, ["control_count", "test_count"])


def stack_conditions(control: DataFrame, test: DataFrame, group: str = "group") -> DataFrame:
    """Append control and test rows with a group column."""
    return (test.withColumn(group, F.lit("Test"))
            .unionByName(control.withColumn(group, F.lit("Control"))))


def score_track(genes: DataFrame, score: str, by: Sequence[str] = (), seq: str = "seq_id",
                start: str = "start_pos", end: str = "end_pos", tiebreak: str = "locus_tag") -> DataFrame:
    """Score along the genome with gaps.

    For genes in order within a sequence: ``[start, end)`` with the score, then ``[end, next start)``
    with 0; the last gene has no trailing gap. Output ``by..., seq, seg_start, seg_end, value, label``.
    """
    by = list(by)
    g = genes.select(*by, seq, start, end, tiebreak, F.col(score).alias("_score"))
    g = next_in_order(g, by + [seq], [start, end, tiebreak], start, "_next_start")
    segs = F.array(
        F.struct(F.col(start).alias("seg_start"), F.col(end).alias("seg_end"),
                 F.col("_score").cast("double").alias("value"), F.col(tiebreak).alias("label")),
        F.struct(F.col(end).alias("seg_start"), F.col("_next_start").alias("seg_end"),
                 F.lit(0.0).alias("value"), F.lit("").alias("label")))
    return (g.select(*by, seq, F.explode(segs).alias("s"))
            .where(F.col("s.seg_end").isNotNull())
            .select(*by, seq, "s.seg_start", "s.seg_end", "s.value", "s.label"))


def distinct_sequences(coords: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct sequence names."""
    return coords.select(*by, "seq_id").distinct()
