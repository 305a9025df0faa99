"""Differential abundance of many two-condition runs in the same Spark jobs (D01-D16 by ``run_id``).

The steps are those of :mod:`duocount.operators.diffexp.run`, each over all runs at once: one matrix, one grouped median
of ratios, one aggregate for a trend step of every run whose fit has not settled, one for a step of every undecided
rejection count, grouped order statistics for the rest. The number of jobs follows the slowest run, not the number of runs.

Runs are numbered 0, 1, ... and go through in blocks of about RUNS_AT_ONCE. The driver holds what a block's runs are
described by (samples, size factors, trend, prior, cut-offs: a few hundred numbers a run) and broadcasts it; rows of genes
are dealt by range over (run, entity), so one run of any size spreads over tasks and a batch holds few runs.

Defined results: a null ``run_id`` is a run; a run that cannot be fitted has no rows but its row of the log, and the
others are not touched by it; no rows give no runs.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from typing import Optional

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duocount.operators.diffexp import counts as C
from duocount.operators.diffexp import dispersion as D
from duocount.operators.diffexp import fit as FT
from duocount.operators.diffexp import nbmath as M
from duocount.operators.diffexp import pca as P
from duocount.operators.diffexp import select as SEL
from duocount.operators.diffexp.run import run_log, run_log_row
from duocount.operators.diffexp.trend import Parametric, Trend, local_bins, local_trend
from duocount.operators.ordered import FEW_GROUPS, bh_adjust, exact_quantiles, ordered_distinct
from duocount.operators.ranges import number_rows
from duocount.session import checkpoint_dir, cut_lineage
from duocount.spec import CountDataError

RUNS_AT_ONCE = 1000
NO_TREND = "all gene-wise dispersions are at the lower bound; no trend can be fitted"


@dataclass
class Run:
    """What the driver knows of one run."""

    run_id: Optional[str]
    design: C.Design
    log: dict
    sf: list = field(default_factory=list)
    trend: Optional[Trend] = None
    smooth: Optional[Trend] = None     # of the transform
    prior_var: float = 0.0
    sd: float = 0.0

    @property
    def size(self) -> int:
        return len(self.design.samples)


@dataclass
class DERuns:
    results: Optional[DataFrame]    # run_id, entity_id and the result columns of a single run
    pca: Optional[DataFrame]        # run_id, sample, condition, pc1, pc2
    log: DataFrame                  # run_id, replicates, run, success, reason


class _Block:
    """The runs of one block that have not failed, by number."""

    def __init__(self, spark, runs: list):
        self.spark, self.all = spark, runs
        self.live = {no: r for no, r in enumerate(runs) if not r.log["reason"]}

    def fail(self, no: int, reason: str) -> None:
        self.live.pop(no).log["reason"] = reason

    def table(self, rows: list, schema: str) -> DataFrame:
        """A broadcast table of ``run_no`` and what ``schema`` names; rows of a block's runs alone."""
        return F.broadcast(self.spark.createDataFrame(rows, "run_no int, " + schema))

    def only_live(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.spark.createDataFrame([(no,) for no in self.live], "run_no int")), "run_no", "left_semi")


def _by_run(make, schema_columns: list):
    """A mapInPandas function over rows with ``run_no``: ``make(run_no)`` gives the function of one run's batches."""

    def run(batches):
        known = {}
        for pdf in batches:
            for no, part in pdf.groupby("run_no", sort=False):
                if no not in known:
                    known[no] = make(no)
                for out in known[no](iter([part.reset_index(drop=True)])):
                    yield out.assign(run_no=np.int32(no))[schema_columns]

    return run


def _names(schema: str) -> list:
    return [c.split()[0] for c in schema.split(", ")]


def read_runs(long: DataFrame, levels) -> list:
    """The runs of ``run_id, entity_id, sample, condition, cnt`` with their designs, unusable ones with a reason."""
    rows = long.groupBy("run_id", "sample", "condition").agg(
        F.count_if((F.col("cnt") != F.floor("cnt")) | (F.col("cnt") < 0)).alias("bad")).collect()
    by_run: dict = {}
    for r in rows:
        by_run.setdefault(r["run_id"], []).append((r["condition"], r["sample"], r["bad"]))
    runs = []
    for run_id in sorted(by_run, key=lambda x: (x is not None, x or "")):
        found = sorted(by_run[run_id], key=lambda x: x[:2])
        design = C.Design(tuple(s for _, s, _ in found), tuple(c for c, _, _ in found), tuple(levels))
        log = {"replicates": len(found), "run": True, "success": False, "reason": None}
        try:
            C.check_design(design, sum(b for _, _, b in found))
            if len(set(design.conditions)) < 2:
                raise CountDataError("both conditions need replicates")
        except CountDataError as e:
            log["reason"] = str(e)
        runs.append(Run(run_id, design, log))
    return runs


def count_matrices(long: DataFrame, block: _Block) -> DataFrame:
    """``run_no, entity_id, counts`` in the order of the run's design, dealt by range over (run, entity)."""
    places = [(no, r.run_id, s, j, r.size) for no, r in block.live.items() for j, s in enumerate(r.design.samples)]
    order = block.table(places, "_run string, _sample string, _j int, _size int")
    placed = long.join(order, F.col("run_id").eqNullSafe(F.col("_run")) & F.col("sample").eqNullSafe(F.col("_sample")))
    sums = placed.groupBy("run_no", "entity_id", "_j", "_size").agg(F.sum(F.col("cnt").cast("bigint")).alias("_n"))
    spark = block.spark
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cells = (sums.repartitionByRange(parts, "run_no", "entity_id").groupBy("run_no", "entity_id", "_size")
             .agg(F.map_from_entries(F.collect_list(F.struct("_j", "_n"))).alias("_m")))
    return cells.select("run_no", "entity_id", F.expr("transform(sequence(0, _size - 1), j -> coalesce(_m[j], 0L))").alias("counts"))


def size_factors(matrix: DataFrame, block: _Block) -> None:
    """Median-of-ratios factors of every run (D02), one grouped exact median."""
    logs = (matrix.where(F.forall("counts", lambda c: c > 0))
            .select("run_no", F.transform("counts", lambda c: F.log(c.cast("double"))).alias("_l"))
            .withColumn("_mean", F.aggregate("_l", F.lit(0.0), lambda a, x: a + x) / F.size("_l").cast("double")))
    ratios = logs.select("run_no", F.posexplode(F.transform("_l", lambda x: x - F.col("_mean"))).alias("j", "r"))
    few = sum(r.size for r in block.live.values()) <= FEW_GROUPS
    found = {(r["run_no"], r["j"]): r["med"] for r in exact_quantiles(ratios, "r", {"med": 0.5}, by=["run_no", "j"], few=few).collect()}
    for no, r in list(block.live.items()):
        if (no, 0) in found:
            r.sf = [math.exp(found[no, j]) for j in range(r.size)]
        else:
            block.fail(no, "no entity has a positive count in every sample; size factors undefined")


def normalised(matrix: DataFrame, block: _Block) -> DataFrame:
    """Normalised counts, baseMean and rowVar of the runs left."""
    factors = block.table([(no, r.sf) for no, r in block.live.items()], "_sf array<double>")
    total = lambda c, f: F.aggregate(c, F.lit(0.0), f)
    n = F.size("counts").cast("double")
    return (matrix.join(factors, "run_no").withColumn("norm", F.zip_with("counts", "_sf", lambda c, s: c.cast("double") / s))
            .withColumn("baseMean", total("norm", lambda a, x: a + x) / n)
            .withColumn("rowVar", total("norm", lambda a, x: a + (x - F.col("baseMean")) * (x - F.col("baseMean"))) / F.greatest(n - 1, F.lit(1.0)))
            .drop("_sf"))


GENE_SCHEMA = ("run_no int, entity_id string, counts array<bigint>, norm array<double>, baseMean double, "
               "rowVar double, allZero boolean, dispGeneEst double")


def trends(genes: DataFrame, numbers) -> dict:
    """The trend of each of the runs ``numbers`` (D05), None where no gene is usable: IRLS of all unsettled runs by one
    aggregate a step, then one aggregate of bins for the runs whose parametric fit fails."""
    spark = genes.sparkSession
    of_block = F.broadcast(spark.createDataFrame([(no,) for no in numbers], "run_no int"))
    usable = cut_lineage(D.usable(genes).join(of_block, "run_no", "left_semi")
                         .select("run_no", F.col("baseMean").alias("mean"), F.col("dispGeneEst").alias("disp")), "usable")
    base = usable.select("run_no", (F.lit(1.0) / F.col("mean")).alias("x"), F.col("disp").alias("y"))
    fits = {no: D.TrendFit() for no in numbers}
    while True:
        active = [(no, *map(float, (*f.a, *f.b))) for no, f in fits.items() if not f.done]
        if not active:
            break
        at = F.broadcast(spark.createDataFrame(active, "run_no int, a0 double, a1 double, b0 double, b1 double"))
        sums = base.join(at, "run_no").groupBy("run_no").agg(*D.trend_sums(*map(F.col, ("a0", "a1", "b0", "b1"))))
        found = {r[0]: tuple(r)[1:] for r in sums.collect()}
        for no, *_ in active:
            fits[no].advance(*found.get(no, (None,) * 5))
    out = {no: Parametric(*f.coef) if f.coef else None for no, f in fits.items()}
    failed = [(no,) for no, t in out.items() if t is None]
    if failed:
        bins: dict = {}
        rows = local_bins(usable.join(F.broadcast(spark.createDataFrame(failed, "run_no int")), "run_no", "left_semi"), ["run_no"])
        for r in rows:
            bins.setdefault(r["run_no"], []).append(tuple(r)[1:])
        out.update({no: local_trend(bins.get(no, [])) for no, in failed})
    return out


def prior_variances(genes: DataFrame, block: _Block, n_coef: int = 2) -> None:
    """Prior variance and residual SD of every run (D06), two grouped exact medians."""
    trend = {no: r.trend for no, r in block.live.items()}

    def residuals(no):
        def run(batches):
            for pdf in batches:
                yield pd.DataFrame({"r": np.log(pdf["dispGeneEst"].to_numpy()) - np.log(trend[no].at(pdf["baseMean"].to_numpy()))})
        return run

    r = cut_lineage(block.only_live(D.usable(genes)).select("run_no", "baseMean", "dispGeneEst")
                    .mapInPandas(_by_run(residuals, ["run_no", "r"]), "run_no int, r double"), "residuals")
    few = len(trend) <= FEW_GROUPS
    middle = {x["run_no"]: x["m"] for x in exact_quantiles(r, "r", {"m": 0.5}, by=["run_no"], few=few).collect()}
    dev = r.join(block.table(list(middle.items()), "_m double"), "run_no").select("run_no", F.abs(F.col("r") - F.col("_m")).alias("d"))
    spread = {x["run_no"]: x["m"] for x in exact_quantiles(dev, "d", {"m": 0.5}, by=["run_no"], few=few).collect()}
    for no, run in block.live.items():
        run.sd = D.MAD_SCALE * spread[no]
        df = run.size - n_coef
        run.prior_var = max(run.sd ** 2 - (M.trigamma(df / 2.0) if df > 0 else 0.0), D.PRIOR_VAR_FLOOR)


def quantiles_at(df: DataFrame, value: str, probs: DataFrame, few: bool = False) -> DataFrame:
    """Exact linear quantiles of ``value`` per ``run_no`` at the run's own probabilities. ``probs``: broadcast table of
    ``run_no`` and ascending ``_probs``, of one length. Returns ``run_no, i, q`` (i from 0)."""
    od = ordered_distinct(df, value, ["run_no"], few=few).join(probs, "run_no")
    place = F.transform("_probs", lambda p: p * (F.col("_tot") - 1).cast("double"))
    holds = lambda rank: (F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_m"))
    ends = F.transform(place, lambda p, i: F.struct(
        i.alias("i"), p.alias("at"), F.when(holds(F.floor(p)), F.col(value)).alias("a"), F.when(holds(F.ceil(p)), F.col(value)).alias("b")))
    hit = od.select("run_no", F.explode(F.filter(ends, lambda e: e["a"].isNotNull() | e["b"].isNotNull())).alias("e")).select("run_no", "e.*")
    g = hit.groupBy("run_no", "i").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.first("at").alias("at"))
    t, d = F.col("at") - F.floor("at"), F.col("b") - F.col("a")
    return g.select("run_no", "i", F.when(t >= 0.5, F.col("b") - d * (F.lit(1.0) - t)).otherwise(F.col("a") + d * t).alias("q"))


def rejections(res: DataFrame, cutoffs: dict, block: _Block, alpha: float = SEL.ALPHA) -> dict:
    """BH rejections of every run at each of its ascending cut-offs (D10), genes not multiplied by cut-offs.

    The step-up count is the largest R with R = #{p <= R alpha / n}. From R = n down, R <- #{p <= R alpha / n} falls
    to it and never below; one aggregate takes that step for every cut-off of every run still falling."""
    T = SEL.N_THETA
    cuts = block.table(list(cutoffs.items()), "_cuts array<double>")
    x = (res.where("pvalue is not null and baseMean is not null").join(cuts, "run_no")
         .select("run_no", F.col("pvalue").alias("p"), F.size(F.filter("_cuts", lambda c: c <= F.col("baseMean"))).alias("k"))
         .where("k > 0"))
    x = cut_lineage(x, "tested")
    kept = [F.count_if(F.col("k") > t).alias(f"n{t}") for t in range(T)]
    total = {r["run_no"]: np.array(tuple(r)[1:], np.int64) for r in x.groupBy("run_no").agg(*kept).collect()}
    now = {no: total.get(no, np.zeros(T, np.int64)) for no in cutoffs}
    falling = [no for no in now if now[no].any()]
    while falling:
        limit = block.table([(no, (now[no] * alpha / np.maximum(total[no], 1)).tolist()) for no in falling], "_limit array<double>")
        step = [F.count_if((F.col("k") > t) & (F.col("p") <= F.col("_limit")[t])).alias(f"n{t}") for t in range(T)]
        found = {r["run_no"]: np.array(tuple(r)[1:], np.int64) for r in x.join(limit, "run_no").groupBy("run_no").agg(*step).collect()}
        still = [no for no in falling if (found[no] < now[no]).any()]
        now.update(found)
        falling = still
    return now


def independent_filtering(res: DataFrame, block: _Block) -> DataFrame:
    """``padj`` of every run, at the cut-off that maximises its rejections."""
    zero = {r["run_no"]: r["z"] for r in res.groupBy("run_no").agg(F.avg((F.col("baseMean") == 0).cast("double")).alias("z")).collect()}
    theta = {}
    for no in block.live:
        lower = zero.get(no) or 0.0
        theta[no] = np.linspace(lower, SEL.UPPER_THETA if lower < SEL.UPPER_THETA else 1.0, SEL.N_THETA)
    grid = block.table([(no, t.tolist()) for no, t in theta.items()], "_probs array<double>")
    cutoffs = {no: [0.0] * SEL.N_THETA for no in theta}
    for r in quantiles_at(res, "baseMean", grid, few=len(theta) <= FEW_GROUPS).collect():
        cutoffs[r["run_no"]][r["i"]] = r["q"]
    cut = {}
    for no, num in rejections(res, cutoffs, block).items():
        j = SEL.chosen_cutoff(theta[no], num.astype(float))
        cut[no] = float(cutoffs[no][j])
        block.live[no].log["filter"] = {"theta": float(theta[no][j]), "baseMean_cutoff": cut[no], "rejections": num.tolist()}
    kept = res.join(block.table(list(cut.items()), "_cut double"), "run_no")
    kept = kept.withColumn("_p_f", F.when(F.col("baseMean") >= F.col("_cut"), F.col("pvalue"))).drop("_cut")
    return bh_adjust(kept, "_p_f", "padj", ["run_no"]).drop("_p_f")


def wald(genes: DataFrame, block: _Block, filtering: bool) -> DataFrame:
    """MAP dispersion, Wald test, Cook's distance and adjusted p of every run."""
    told = {no: (r.sf, r.design.groups, r.trend, r.prior_var, r.sd) for no, r in block.live.items()}
    schema = "run_no int, " + FT.RESULT_SCHEMA
    res = block.only_live(genes).select("run_no", "entity_id", "counts", "baseMean", "allZero", "dispGeneEst").mapInPandas(
        _by_run(lambda no: FT.wald_mapper(*told[no], replace=filtering), _names(schema)), schema)
    res = cut_lineage(res, "wald")
    if not filtering:
        return bh_adjust(res, "pvalue", "padj", ["run_no"])
    limits = [(no, M.f_quantile_df1_2(SEL.COOKS_QUANTILE, float(r.size - 2)) if r.size > 2 else None) for no, r in block.live.items()]
    res = res.join(block.table(limits, "_limit double"), "run_no")
    cut = (F.col("maxCooks") > F.col("_limit")) & (F.col("nAbove") < SEL.EXEMPT_ABOVE)   # null limit: none is cut
    res = res.withColumn("pvalue", F.when(F.coalesce(cut, F.lit(False)), F.lit(None).cast("double")).otherwise(F.col("pvalue")))
    return independent_filtering(res.drop("_limit"), block)


def smooth_trends(genes: DataFrame, block: _Block) -> None:
    """The trend of every run's transform by the rule that picks its variant."""
    enough = {r["run_no"] for r in genes.groupBy("run_no").agg(F.count_if(F.col("baseMean") > P.FAST_MEAN).alias("n"))
              .where(F.col("n") >= P.FAST_GENES).collect()}
    nonzero = genes.select("run_no", F.posexplode("counts").alias("j", "c")).groupBy("run_no", "j").agg(F.count_if(F.col("c") != 0).alias("n"))
    poor = {r["run_no"] for r in nonzero.where(F.col("n") < P.FAST_GENES).select("run_no").distinct().collect()}
    fast = [no for no in block.live if no in enough and no not in poor]
    for no, r in block.live.items():
        r.smooth, r.log["transform"] = r.trend, "full"
    if fast:
        chosen = genes.join(block.table([(no, True) for no in fast], "_f boolean"), "run_no").drop("_f")
        for no, t in trends(P.spread_over_means(chosen, by=["run_no"]), fast).items():
            if t is None:
                block.fail(no, NO_TREND)
            else:
                block.live[no].smooth, block.live[no].log["transform"] = t, "fast"


def pca_rows(genes: DataFrame, block: _Block) -> list:
    """(run_id, sample, condition, pc1, pc2) of every run (D12, O04, D13): one grouped Gram matrix."""
    top = {r["run_no"]: r["t"] for r in genes.groupBy("run_no").agg(F.max(F.array_max("norm")).alias("t")).collect()}
    smooth = {no: (r.smooth, top.get(no) or 1.0) for no, r in block.live.items()}

    def transform(no):
        trend, high = smooth[no]

        def run(batches):
            for pdf in batches:
                v = trend.transform_at(np.stack(pdf["norm"].to_numpy()).astype(float), high)
                yield pd.DataFrame({"entity_id": pdf["entity_id"], "vst": list(v - v.mean(axis=1, keepdims=True)),
                                    "vstVar": v.var(axis=1, ddof=1)})
        return run

    columns = ["run_no", "entity_id", "vst", "vstVar"]
    tr = block.only_live(genes).select("run_no", "entity_id", "norm").mapInPandas(
        _by_run(transform, columns), "run_no int, entity_id string, vst array<double>, vstVar double")
    placed = number_rows(tr, ["run_no"], [F.col("vstVar").desc(), F.col("entity_id").asc()], "_at", "_n")
    c = placed.where(F.col("_at") < P.NTOP).select("run_no", F.col("vst").alias("c"))
    pairs = c.select("run_no", F.posexplode("c").alias("i", "xi"), "c").select("run_no", "i", "xi", F.posexplode("c").alias("j", "xj"))
    gram = {no: np.zeros((r.size, r.size)) for no, r in block.live.items()}
    for r in pairs.groupBy("run_no", "i", "j").agg(F.sum(F.col("xi") * F.col("xj")).alias("v")).collect():
        gram[r["run_no"]][r["i"], r["j"]] = r["v"]
    rows = []
    for no, r in block.live.items():
        found, explained = P.components(gram[no], r.design.samples, r.design.conditions)
        r.log["explained"] = explained
        rows += [(r.run_id, *row) for row in found]
    return rows


def _one_block(long: DataFrame, levels, filtering: bool, with_pca: bool):
    """(results or None, PCA rows, log rows) of the runs of one block."""
    spark = long.sparkSession
    block = _Block(spark, read_runs(long, levels))
    results, axes = None, []
    if block.live:
        matrix = cut_lineage(count_matrices(long, block), "counts")
        size_factors(matrix, block)
    if block.live:
        told = {no: (r.sf, r.design.groups) for no, r in block.live.items()}
        genes = normalised(matrix, block).mapInPandas(_by_run(lambda no: D.genewise_mapper(*told[no]), _names(GENE_SCHEMA)), GENE_SCHEMA)
        genes = cut_lineage(genes, "genewise")
        for no, trend in trends(genes, list(block.live)).items():
            block.live[no].trend = trend
            if trend is None:
                block.fail(no, NO_TREND)
    if block.live and with_pca:
        smooth_trends(block.only_live(genes), block)
    if block.live:
        if with_pca:
            axes = pca_rows(block.only_live(genes), block)
        prior_variances(genes, block)
        ids = block.table([(no, r.run_id) for no, r in block.live.items()], "run_id string")
        res = wald(genes, block, filtering).join(ids, "run_no").drop("run_no")
        results = res.select("run_id", *[c for c in res.columns if c != "run_id"])
    for r in block.live.values():
        r.log["success"] = True
    return results, axes, [run_log_row(r.run_id, r.log) for r in block.all]


def differential_abundance_runs(long_counts: DataFrame, run: str = "run_id", filtering: bool = True, levels=("control", "test"),
                                with_pca: bool = False, runs_at_once: int = RUNS_AT_ONCE) -> DERuns:
    """Negative-binomial two-group test of every run of ``run, entity_id, sample, condition, cnt``, each as
    ``differential_abundance`` would give it alone (``results`` with ``run_id`` first, null if no run could be fitted).

    The counts are written once, for the steps that read them. Up to ``runs_at_once`` runs (on average, by hash) share their
    jobs; beyond that the counts are written once more by block."""
    spark = long_counts.sparkSession
    long = long_counts.select(F.col(run).cast("string").alias("run_id"), F.col("entity_id").cast("string").alias("entity_id"),
                              F.col("sample").cast("string").alias("sample"), "condition", "cnt")
    long = cut_lineage(long, "run-counts")
    blocks = max(1, math.ceil(long.select("run_id").distinct().count() / runs_at_once))
    parts = [long]
    if blocks > 1:
        path = f"{checkpoint_dir(spark).rstrip('/')}/duocount-tables/runs-{uuid.uuid4().hex}"
        long.withColumn("_block", F.pmod(F.xxhash64("run_id"), F.lit(blocks))).write.partitionBy("_block").parquet(path)
        stored = spark.read.parquet(path)
        parts = [stored.where(F.col("_block") == b).drop("_block") for b in range(blocks)]
    results, axes, logs = None, [], []
    for part in parts:
        found, rows, log = _one_block(part, levels, filtering, with_pca)
        if found is not None:
            found = cut_lineage(found, "de-runs") if blocks > 1 else found
            results = found if results is None else results.unionByName(found)
        axes += rows
        logs += log
    pca = spark.createDataFrame(axes, "run_id string, sample string, condition string, pc1 double, pc2 double") if with_pca else None
    return DERuns(results, pca, run_log(spark, logs))
