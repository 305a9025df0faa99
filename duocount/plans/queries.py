"""The registered queries (one per operator group of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from duocount.operators import compare as cmp
from duocount.plans import adapters, flagship
from duocount.plans.catalog import R6, finish, register, with_views

SCORE_COLS = ["seq_id", "locus_tag", "type", "gene", "start_pos", "end_pos", "feat_length", "product"]


@register("gene_scores", "J04 A04 C04 C05 F04 F05", with_views(f"""
select seq_id, locus_tag, type, gene, start_pos, end_pos, feat_length, product, condition,
       total_reads, n_rows, unique_sites, {R6('nim_score')} as nim_score, {R6('nrm_score')} as nrm_score,
       {R6('first_insert_pct')} as first_insert_pct, {R6('last_insert_pct')} as last_insert_pct
from scores"""))
def q_gene_scores(spark, sf_dir):
    return finish(flagship.score_tables(spark, sf_dir))


MERGED_SELECT = ", ".join(
    SCORE_COLS
    + [f"{c}_{s}" for s in ("control", "test") for c in ("total_reads", "n_rows", "unique_sites")]
    + [f"{R6(c + '_' + s)} as {c}_{s}" for s in ("control", "test")
       for c in ("nim_score", "nrm_score", "first_insert_pct", "last_insert_pct")])


@register("merged_comparison", "P01 P02 P03 J01 C01 W01 W02 X01", with_views(f"""
select {MERGED_SELECT}, {R6('fold_change')} as fold_change, {R6('pctl_rank')} as pctl_rank
from cmp"""))
def q_merged(spark, sf_dir):
    df, _ = flagship.comparison(spark, sf_dir)
    return finish(df)


@register("top_changes", "P04 P05 O02 (flagship, top-k report)", with_views(f"""
select locus_tag, type, gene, start_pos, end_pos, feat_length, product,
       {R6('round_even(nrm_score_test * 100000.0::DOUBLE, 0) / 100000.0::DOUBLE')} as nrm_score_test,
       {R6('round_even(nrm_score_control * 100000.0::DOUBLE, 0) / 100000.0::DOUBLE')} as nrm_score_control,
       {R6('round_even(nim_score_test * 100000.0::DOUBLE, 0) / 100000.0::DOUBLE')} as nim_score_test,
       {R6('round_even(nim_score_control * 100000.0::DOUBLE, 0) / 100000.0::DOUBLE')} as nim_score_control,
       {R6('round_even(fold_change * 100000.0::DOUBLE, 0) / 100000.0::DOUBLE')} as fold_change,
       {R6('round_even(pctl_rank * 100000.0::DOUBLE, 0) / 100000.0::DOUBLE')} as pctl_rank
from cmp
order by abs(round_even(fold_change * 100000.0::DOUBLE, 0) / 100000.0::DOUBLE) desc, locus_tag
limit 50"""))
def q_top_changes(spark, sf_dir):
    return finish(flagship.top_changes(spark, sf_dir, 50))


# --- insertion profiles and per-gene insertion tables --------------------------------------------

from duocount.operators import insertions as I  # noqa: E402
from duocount.operators import profile as PR  # noqa: E402
from duocount.operators import sets as S  # noqa: E402
from duocount.spec import FEATURE_KEYS  # noqa: E402

KEYS_SQL = "seq_id, locus_tag, type, gene, start_pos, end_pos, feat_length, product"


@register("insertion_profile", "A01 A02 A03 (count mode for control, score mode for test)", with_views(f"""
select c.condition, c.seq_id, c."start" as position, {R6('count(*)')} as count
from coords c join mode m using (condition) where m.empty_score group by 1, 2, 3
union all
select c.condition, c.seq_id, c."start" as position, {R6('try_cast(c.score as double)')} as count
from coords c join mode m using (condition) where not m.empty_score""",
    ("mode", "select condition, bool_and(score = '.') as empty_score from coords group by 1")))
def q_profile(spark, sf_dir):
    return finish(I.profile_from_coordinates(adapters.coordinates(spark, sf_dir), by=["condition"]))


@register("top_positions", "A01 O02 (top-k report)", with_views("""
select condition, position, count(*) as count from ins group by 1, 2
order by count desc, condition, position limit 100"""))
def q_top_positions(spark, sf_dir):
    return finish(I.top_counts(adapters.insertions(spark, sf_dir), ["condition", "position"], 100))


@register("gene_totals", "J04 A04 F04 F05", with_views(f"""
select {KEYS_SQL}, condition, total_reads, n_rows, unique_sites, first_pos, last_pos from tot"""))
def q_gene_totals(spark, sf_dir):
    sites = I.insertion_sites(adapters.insertions(spark, sf_dir))
    return finish(I.feature_totals(adapters.features(spark, sf_dir), sites, FEATURE_KEYS))


@register("gene_insertions_wide", "J02 J04 F04 F05", with_views(f"""
select {KEYS_SQL}, position,
       {R6("coalesce(sum(case when condition = 'control' then reads end), 0)")} as control_count,
       {R6("coalesce(sum(case when condition = 'test' then reads end), 0)")} as test_count,
       bool_or(within_cds) as within_cds
from hits where position is not null group by all"""))
def q_gene_wide(spark, sf_dir):
    sites = I.insertion_sites(adapters.insertions(spark, sf_dir))
    return finish(I.gene_window_table(adapters.features(spark, sf_dir), sites, FEATURE_KEYS))


@register("score_track", "W03", with_views(f"""
select seq_id, start_pos as seg_start, end_pos as seg_end, {R6('nim_score')} as value, locus_tag as label from g
union all
select seq_id, end_pos as seg_start, nxt as seg_end, 0.0 as value, '' as label from g where nxt is not null""",
    ("g", """select seq_id, start_pos, end_pos, locus_tag, nim_score,
               lead(start_pos) over (partition by seq_id order by start_pos, end_pos, locus_tag) as nxt
        from scores where condition = 'control'""")))
def q_score_track(spark, sf_dir):
    scores = flagship.score_tables(spark, sf_dir)
    return finish(I.score_track(flagship.condition_table(scores, "control"), "nim_score"))


# --- sets and Venn regions ----------------------------------------------------------------------

def _merged(spark, sf_dir):
    return flagship.comparison(spark, sf_dir)


def RND5(x: str) -> str:
    return f"(round_even(({x})::DOUBLE * 100000.0::DOUBLE, 0) / 100000.0::DOUBLE)"


def MEMBER(side: str, t: float, lo: float, hi: float) -> str:
    return (f"coalesce({RND5('nim_score_' + side)} <= {t} and {RND5('first_insert_pct_' + side)} >= {lo}"
            f" and {RND5('last_insert_pct_' + side)} <= {hi}, false)")


SET_T, SET_LO, SET_HI = 500.0, 5.0, 95.0
SETS_VIEW = ("sets", f"""select *, {MEMBER('control', SET_T, SET_LO, SET_HI)} as in_control_set,
        {MEMBER('test', SET_T, SET_LO, SET_HI)} as in_test_set from cmp""")
SETS0_VIEW = ("sets0", f"""select *, {MEMBER('control', 0.0, 0.0, 100.0)} as in_control_set,
        {MEMBER('test', 0.0, 0.0, 100.0)} as in_test_set from cmp""")
LABEL_SQL = ("case when in_control_set and in_test_set then 'AB' when in_control_set then 'Ab' "
             "when in_test_set then 'aB' end")


@register("venn_sets", "F08 U02 F11 P05", with_views(f"""
select locus_tag, in_control_set, in_test_set, {LABEL_SQL} as set_label,
       coalesce(last_insert_pct_control < 10 and last_insert_pct_control > 0, false) as control_last_lt10,
       coalesce(last_insert_pct_test < 10 and last_insert_pct_test > 0, false) as test_last_lt10,
       coalesce(first_insert_pct_control > 90, false) as control_first_gt90,
       coalesce(first_insert_pct_test > 90, false) as test_first_gt90
from sets""", SETS_VIEW))
def q_venn_sets(spark, sf_dir):
    df, spec = _merged(spark, sf_dir)
    df = S.add_truncation_flags(S.add_set_membership(df, spec, SET_T, (SET_LO, SET_HI)), spec)
    return finish(df.select("locus_tag", "in_control_set", "in_test_set", "set_label", "control_last_lt10",
                            "test_last_lt10", "control_first_gt90", "test_first_gt90"))


@register("venn_counts", "A07 (default thresholds: score 0, percentiles 0-100)", with_views("""
select count(*) filter (where in_control_set and not in_test_set) as only_control,
       count(*) filter (where in_test_set and not in_control_set) as only_test,
       count(*) filter (where in_control_set and in_test_set) as both
from sets0""", SETS0_VIEW))
def q_venn_counts(spark, sf_dir):
    df, spec = _merged(spark, sf_dir)
    return finish(S.venn_counts(S.add_set_membership(df, spec)))


@register("venn_region", "F09", with_views(f"""
select locus_tag, gene, {R6('nim_score_control')} as nim_score_control, {R6('nim_score_test')} as nim_score_test,
       {LABEL_SQL} as set_label
from sets where ({LABEL_SQL}) = 'Ab'""", SETS_VIEW))
def q_venn_region(spark, sf_dir):
    df, spec = _merged(spark, sf_dir)
    df = S.filter_region(S.add_set_membership(df, spec, SET_T, (SET_LO, SET_HI)), "Ab")
    return finish(df.select("locus_tag", "gene", "nim_score_control", "nim_score_test", "set_label"))


SWEEP = [float(t) for t in range(0, 2001, 100)]


@register("venn_sweep", "A07 over a threshold sweep (F08 per threshold)", with_views(f"""
select t.threshold,
       count(*) filter (where {MEMBER('control', 't.threshold', 0.0, 100.0)} and not {MEMBER('test', 't.threshold', 0.0, 100.0)}) as only_control,
       count(*) filter (where {MEMBER('test', 't.threshold', 0.0, 100.0)} and not {MEMBER('control', 't.threshold', 0.0, 100.0)}) as only_test,
       count(*) filter (where {MEMBER('control', 't.threshold', 0.0, 100.0)} and {MEMBER('test', 't.threshold', 0.0, 100.0)}) as both
from cmp cross join (select unnest({[t for t in SWEEP]})::DOUBLE as threshold) t
group by t.threshold"""))
def q_venn_sweep(spark, sf_dir):
    df, spec = _merged(spark, sf_dir)
    return finish(S.threshold_sweep(df, spec, SWEEP))


@register("set_ops", "U01 (difference and intersection of two independent id sets)", with_views("""
select 'control_only' as op, locus_tag from
  (select locus_tag from scores where condition = 'control' and unique_sites = 0
   except select locus_tag from scores where condition = 'test' and unique_sites = 0)
union all
select 'both' as op, locus_tag from
  (select locus_tag from scores where condition = 'control' and unique_sites = 0
   intersect select locus_tag from scores where condition = 'test' and unique_sites = 0)"""))
def q_set_ops(spark, sf_dir):
    scores = flagship.score_tables(spark, sf_dir)
    a = scores.where((F.col("condition") == "control") & (F.col("unique_sites") == 0)).select("locus_tag")
    b = scores.where((F.col("condition") == "test") & (F.col("unique_sites") == 0)).select("locus_tag")
    return (S.set_difference(a, b).select(F.lit("control_only").alias("op"), "locus_tag")
            .unionByName(S.set_intersection(a, b).select(F.lit("both").alias("op"), "locus_tag")))


@register("zero_in_one", "F10", with_views("""
select locus_tag, coalesce((nim_score_control = 0 and nim_score_test > 0) or
                           (nim_score_control > 0 and nim_score_test = 0), false) as zero_in_one
from cmp"""))
def q_zero_in_one(spark, sf_dir):
    df, spec = _merged(spark, sf_dir)
    return cmp.flag_zero_in_one(df, spec).select("locus_tag", "zero_in_one")


@register("table_page", "F13 O03 (filter, sort, one page: the limit is the feature)", with_views(f"""
select locus_tag, {R6('nim_score_test')} as nim_score_test, {R6('fold_change')} as fold_change
from cmp where fold_change > 0 order by nim_score_test desc, locus_tag limit 50 offset 100"""))
def q_table_page(spark, sf_dir):
    df, _ = _merged(spark, sf_dir)
    p = cmp.page(df, [F.col("nim_score_test").desc()], ["locus_tag"], 2, 50, F.col("fold_change") > 0)
    return finish(p.select("locus_tag", "nim_score_test", "fold_change"))


# --- histograms, ranges, rings --------------------------------------------------------------------

HIST_W = 250.0
HIST_BINS_SQL = f"""
select condition, bin, {R6(f'bin * {HIST_W}')} as bin_lo, {R6(f'(bin + 1) * {HIST_W}')} as bin_hi,
       coalesce(cnt, 0) as count
from (select b.condition, b.bin, c.cnt from
        (select cond.condition, r.range as bin from (select unnest(['control','test']) as condition) cond
         cross join range(0, (select nb from hs)) r) b
      left join (select condition, bin, count(*) as cnt from binned group by 1, 2) c
        on c.condition = b.condition and c.bin = b.bin)"""


@register("histogram_fixed", "A08 (paired histogram, fixed width, empty bins included)", with_views(
    HIST_BINS_SQL,
    ("hv", "select condition, nim_score::DOUBLE as x from scores where nim_score is not null and not isnan(nim_score)"),
    ("hs", f"select cast(ceil((max(x) + {HIST_W}) / {HIST_W}) as bigint) - 1 as nb from hv"),
    ("b0", f"select condition, x, cast(floor(x / {HIST_W}) as bigint) as b from hv"),
    ("b1", f"select condition, x, case when x < b * {HIST_W} then b - 1 else b end as b from b0"),
    ("b2", f"select condition, x, case when x >= (b + 1) * {HIST_W} then b + 1 else b end as b from b1"),
    ("binned", f"""select condition, case when x >= ((select nb from hs) - 1) * {HIST_W} then (select nb from hs) - 1
                   else b end as bin from b2 where x >= 0 and x <= (select nb from hs) * {HIST_W}""")))
def q_hist_fixed(spark, sf_dir):
    scores = flagship.score_tables(spark, sf_dir)
    return finish(PR.paired_histogram(flagship.condition_table(scores, "control"),
                                      flagship.condition_table(scores, "test"), "nim_score", HIST_W))


@register("histogram_auto", "A09 A10 (numpy 'auto' edges from the test side)", with_views("""
select h.condition, h.bin, round_even(h.bin_lo * 1000000.0, 0) / 1000000.0 as bin_lo,
       round_even(h.bin_hi * 1000000.0, 0) / 1000000.0 as bin_hi, h.count,
       (select max(count) from h) as y_max, (select min(count) from h) as y_min
from h""",
    ("hv", "select condition, nim_score::DOUBLE as x from scores where nim_score is not null and not isnan(nim_score)"),
    ("tv", "select x, row_number() over (order by x) - 1 as r from hv where condition = 'test'"),
    ("st", "select count(*) as n, min(x) as lo, max(x) as hi from tv"),
    ("qi", """select p, p * (n - 1) as idx, floor(p * (n - 1)) as rlo, ceil(p * (n - 1)) as rhi
             from st cross join (select unnest([0.25, 0.75]) as p)"""),
    ("qv", """select qi.p, qi.idx - qi.rlo as t, a.x as a, b.x as b from qi
             join tv a on a.r = qi.rlo join tv b on b.r = qi.rhi"""),
    ("qq", """select p, case when t >= 0.5 then b - (b - a) * (1.0 - t) else a + (b - a) * t end as q from qv"""),
    ("wd", """select n, lo, hi, hi - lo as ptp, (hi - lo) / (log2(n) + 1.0) as sturges,
             2.0 * ((select q from qq where p = 0.75) - (select q from qq where p = 0.25)) * pow(n, -1.0 / 3.0) as fd
             from st"""),
    ("ed", """select lo as first_e, hi as last_e, greatest(1, cast(ceil(ptp / (case when fd > 0 then least(fd, sturges) else sturges end)) as bigint)) as nb
             from wd"""),
    ("es", "select first_e, last_e, nb, (last_e - first_e) / nb as step from ed"),
    ("b0", """select hv.condition, hv.x, cast(floor((hv.x - es.first_e) / es.step) as bigint) as b, es.*
             from hv cross join es"""),
    ("b1", "select *, case when x < first_e + b * step then b - 1 else b end as b1 from b0"),
    ("b2", "select *, case when x >= first_e + (b1 + 1) * step then b1 + 1 else b1 end as b2 from b1"),
    ("binned", """select condition, case when x >= first_e + (nb - 1) * step then nb - 1 else b2 end as bin
                 from b2 where x >= first_e and x <= last_e"""),
    ("h", """select g.condition, g.bin, es.first_e + g.bin * es.step as bin_lo, es.first_e + (g.bin + 1) * es.step as bin_hi,
                   coalesce(c.cnt, 0) as count
            from (select cond.condition, r.range as bin from (select unnest(['control','test']) as condition) cond
                  cross join range(0, (select nb from es)) r) g
            cross join es
            left join (select condition, bin, count(*) as cnt from binned group by 1, 2) c
              on c.condition = g.condition and c.bin = g.bin""")))
def q_hist_auto(spark, sf_dir):
    scores = flagship.score_tables(spark, sf_dir)
    h = PR.paired_histogram(flagship.condition_table(scores, "control"),
                            flagship.condition_table(scores, "test"), "nim_score", None, "test")
    yr = PR.histogram_y_range(h).first()
    return finish(h.withColumn("y_max", F.lit(yr["y_max"])).withColumn("y_min", F.lit(yr["y_min"])))


@register("histogram_grouped", "A11", with_views(f"""
select condition, cast(floor(nim_score / {HIST_W}) as bigint) as bin,
       {R6(f'floor(nim_score / {HIST_W}) * {HIST_W}')} as bin_lo, count(*) as count
from scores where nim_score >= 0 group by 1, 2, 3"""))
def q_hist_grouped(spark, sf_dir):
    return finish(PR.grouped_histogram(flagship.score_tables(spark, sf_dir), "nim_score", HIST_W))


@register("genome_range", "A06", with_views("""
select seq_id, max(end_pos) - min(start_pos) as genome_range, max(start_pos) - min(start_pos) as ring_length
from feat group by seq_id"""))
def q_genome_range(spark, sf_dir):
    return finish(PR.genome_range(adapters.features(spark, sf_dir), ["seq_id"]))


RING_F = (0.1, 0.9)


@register("circos_rings", "P07 P15 F06 F07 C06 (window from fractions, hide both-zero)", with_views(f"""
select cast(seq_id as varchar) as block_id, start_pos, end_pos, locus_tag,
       {R6('nim_score_control')} as inner, {R6('nim_score_test')} as outer, {R6('fold_change')} as hist
from cmp
where start_pos >= cast({RING_F[0]} * (select max(end_pos) - min(start_pos) from cmp) as bigint)
  and end_pos <= cast({RING_F[1]} * (select max(end_pos) - min(start_pos) from cmp) as bigint)
  and not coalesce(nim_score_control = 0 and nim_score_test = 0, false)"""))
def q_circos(spark, sf_dir):
    df, spec = _merged(spark, sf_dir)
    metric = spec.metrics[0]  # first comparison column when none is chosen (P15)
    return finish(PR.ring_tables(df, "nim_score_control", "nim_score_test", metric, RING_F, hide_zeros=True))


# --- differential abundance ---------------------------------------------------------------------

from duocount.operators import ordered as OR  # noqa: E402
from duocount.operators.diffexp import select as SEL  # noqa: E402
from duocount.plans import diffexp_sql as DQ  # noqa: E402
from duocount.operators.diffexp import counts as DC  # noqa: E402
from duocount.operators.diffexp import pca as PCA  # noqa: E402
from duocount.operators.diffexp.run import attach_results, differential_abundance  # noqa: E402
from duocount.operators.diffexp.runs import differential_abundance_runs  # noqa: E402

POOL_VIEWS = (
    ("ents", "select distinct entity_id from pool"),
    ("smps", "select distinct sample, condition from pool"),
    ("pm", """select e.entity_id, s.sample, s.condition, coalesce(p.cnt, 0) as cnt
             from ents e cross join smps s left join pool p on p.entity_id = e.entity_id and p.sample = s.sample"""),
    ("lg", "select entity_id, avg(ln(cnt::DOUBLE)) as lgm from pm group by 1 having min(cnt) > 0"),
    ("sfac", "select sample, exp(median(ln(cnt::DOUBLE) - lgm)) as size_factor from pm join lg using (entity_id) group by 1"),
    ("nrm", "select pm.entity_id, pm.sample, pm.cnt::DOUBLE / sfac.size_factor as q from pm join sfac using (sample)"),
)


def _pool_design(spark, sf_dir):
    long = adapters.pools(spark, sf_dir)
    return long, DC.design_of(long)


@register("pool_matrix", "D01 J06 (count matrix, missing pairs 0)", with_views("""
select entity_id, sample, condition, cnt from pm""", *POOL_VIEWS))
def q_pool_matrix(spark, sf_dir):
    long, design = _pool_design(spark, sf_dir)
    m = DC.count_matrix(long, design)
    samples = spark.createDataFrame(list(enumerate(zip(design.samples, design.conditions))),
                                    "pos int, sc struct<sample:string, condition:string>").select("pos", "sc.*")
    x = m.select("entity_id", F.posexplode("counts").alias("pos", "cnt"))
    return finish(x.join(F.broadcast(samples), "pos").select("entity_id", "sample", "condition", "cnt"))


@register("size_factors", "D02 (median of ratios)", with_views(f"""
select sample, {R6('size_factor')} as size_factor from sfac""", *POOL_VIEWS))
def q_size_factors(spark, sf_dir):
    long, design = _pool_design(spark, sf_dir)
    sf = DC.size_factors(DC.count_matrix(long, design), design)
    return finish(spark.createDataFrame(list(zip(design.samples, sf)), "sample string, size_factor double"))


@register("normalized_counts", "D03 (baseMean, row variance)", with_views(f"""
select entity_id, {R6('avg(q)')} as baseMean, {R6('var_samp(q)')} as rowVar from nrm group by 1""", *POOL_VIEWS))
def q_normalized(spark, sf_dir):
    long, design = _pool_design(spark, sf_dir)
    m = DC.count_matrix(long, design)
    sf = DC.size_factors(m, design)
    return finish(DC.normalised(m, sf).select("entity_id", "baseMean", "rowVar"))


@register("nonzero_per_sample", "A13", with_views("""
select sample, count(*) filter (where cnt <> 0) as nonzero from pool group by 1"""))
def q_nonzero(spark, sf_dir):
    return finish(DC.nonzero_per_sample(adapters.pools(spark, sf_dir)))


@register("bh_adjust", "D11 (BH over the control percentile rank used as a p-value; ties exercised)", with_views(f"""
select locus_tag, {R6('p')} as p,
       {R6('least(1.0, min(q) over (order by p desc range between unbounded preceding and current row))')} as padj
from rr""",
    ("pr", """select locus_tag, case when nim_score_control is null then null
               else rank() over (order by nim_score_control)::DOUBLE / count(nim_score_control) over () end as p from cmp"""),
    ("rr", """select locus_tag, p, p * (count(p) over ()) /
                     (count(p) over (order by p range between unbounded preceding and current row)) as q from pr""")))
def q_bh(spark, sf_dir):
    df, spec = flagship.comparison(spark, sf_dir, materialise=True)
    base = OR.min_rank_pct(df.select("locus_tag", "nim_score_control"), "nim_score_control", "p")
    return finish(OR.bh_adjust(base, "p", "padj").select("locus_tag", "p", "padj"))


def _chain(body: str, views) -> str:
    return with_views(body, *POOL_VIEWS, *views, materialized=True)


def _unfiltered(spark, sf_dir):
    return differential_abundance(adapters.pools(spark, sf_dir), filtering=False, with_pca=False).results


@register("gene_dispersions", "D04 (gene-wise dispersion of the adjusted likelihood)", _chain(f"""
select entity_id, {R6('disp')} as "dispGeneEst" from disp""", DQ.DISPERSION_VIEWS[:DQ.DISPERSION_VIEWS.index(DQ.USABLE)]))
def q_gene_dispersions(spark, sf_dir):
    return finish(_unfiltered(spark, sf_dir).select("entity_id", "dispGeneEst"))


@register("dispersion_trend", "D05 (parametric, or local lines where that fails)", _chain(f"""
select entity_id, {R6('fit')} as "dispFit" from fitted""", DQ.DISPERSION_VIEWS))
def q_dispersion_trend(spark, sf_dir):
    return finish(_unfiltered(spark, sf_dir).select("entity_id", "dispFit"))


@register("map_dispersions", "D06 (prior width, MAP estimate, outliers kept)", _chain(f"""
select entity_id, {R6('a')} as dispersion from alpha""", DQ.DISPERSION_VIEWS))
def q_map_dispersions(spark, sf_dir):
    return finish(_unfiltered(spark, sf_dir).select("entity_id", "dispersion"))


@register("cooks_distances", "D09 (largest Cook's distance and its cut-off)", _chain(f"""
select entity_id, {R6('cooks')} as "maxCooks", {DQ.CUT_OFF} as cut from tests""", DQ.TEST_VIEWS))
def q_cooks(spark, sf_dir):
    r = _unfiltered(spark, sf_dir)
    out = SEL.apply_cooks_cutoff(r.withColumn("_p", F.col("pvalue")), len(_pool_design(spark, sf_dir)[1].samples))
    return finish(out.select("entity_id", "maxCooks", (F.col("pvalue").isNull() & F.col("_p").isNotNull()).alias("cut")))


@register("filter_rejections", "D10 (rejections at 50 cut-offs, small p-values made from the percentile rank)", with_views(f"""
select i, {R6('cut')} as cutoff, y::bigint as rejections from rejected""",
    ("filterable", """select locus_tag as entity_id, total_reads_control::DOUBLE as basemean, pow(rank() over (order by nim_score_control)::DOUBLE / count(nim_score_control) over (), 2)
     * (case when total_reads_control % 3 = 0 then 1.0 else 0.3 end) as p from cmp"""), *DQ.REJECTION_VIEWS, materialized=True))
def q_filter_rejections(spark, sf_dir):
    df, _ = flagship.comparison(spark, sf_dir, materialise=True)
    ranked = OR.min_rank_pct(df.select("locus_tag", "nim_score_control", "total_reads_control"), "nim_score_control", "r")
    x = ranked.select(F.col("total_reads_control").cast("double").alias("baseMean"), (F.col("r") * F.col("r") * F.when(
        F.col("total_reads_control") % 3 == 0, 1.0).otherwise(0.3)).alias("pvalue"))
    theta, cutoffs = SEL.filter_grid(x)
    rows = zip(range(len(cutoffs)), cutoffs, SEL.rejections_per_cutoff(x, cutoffs))
    return finish(spark.createDataFrame(list(rows), "i int, cutoff double, rejections long"))


@register("de_results", "D04-D10 D14 D16 (filtered mode, all result columns attached)", _chain(f"""
select f.locus_tag, {R6('t.basemean')} as "de_baseMean", {R6('lfc')} as "de_log2FoldChange", {R6('se')} as "de_lfcSE",
       {R6('stat')} as de_stat, {R6('x.p')} as de_pvalue, {R6('padj')} as de_padj
from feat f left join tests t on f.locus_tag = concat('LT', t.entity_id) left join filterable x using (entity_id) left join padj using (entity_id)""", DQ.FILTER_VIEWS))
def q_de(spark, sf_dir):
    r = differential_abundance(adapters.pools(spark, sf_dir), filtering=True, with_pca=False)
    feat = adapters.features(spark, sf_dir).select(
        "locus_tag", F.regexp_replace("locus_tag", "^LT", "").alias("entity_id"))
    return finish(attach_results(feat, r.results, "entity_id")[0].drop("entity_id"))


@register("de_results_unfiltered", "D04-D08 D11 D16 (no Cook's cut-off, no independent filtering)", _chain(f"""
select entity_id, {R6('basemean')} as "baseMean", {R6('lfc')} as "log2FoldChange", {R6('se')} as "lfcSE", {R6('stat')} as stat,
       {R6('p')} as pvalue, {R6('padj')} as padj from tests left join padj using (entity_id)""", [*DQ.TEST_VIEWS, *DQ.adjusted("p", "tests")]))
def q_de_unf(spark, sf_dir):
    r = differential_abundance(adapters.pools(spark, sf_dir), filtering=False, with_pca=False)
    return finish(r.results.select("entity_id", "baseMean", "log2FoldChange", "lfcSE", "stat", "pvalue", "padj"))


RUN_VIEWS = [("both_runs", """select 'pools' as run_id, 1 as side union all select 'swapped', -1""")]


@register("de_runs", "D02-D11 D16 by run_id (the pools, and the pools with conditions swapped, in the same jobs)", _chain(f"""
select b.run_id, t.entity_id, {R6('t.basemean')} as "baseMean", {R6('b.side * lfc')} as "log2FoldChange", {R6('se')} as "lfcSE",
       {R6('b.side * stat')} as stat, {R6('x.p')} as pvalue, {R6('padj')} as padj
from both_runs b, tests t left join filterable x using (entity_id) left join padj using (entity_id)""", [*DQ.FILTER_VIEWS, *RUN_VIEWS]))
def q_de_runs(spark, sf_dir):
    r = differential_abundance_runs(_two_runs(adapters.pools(spark, sf_dir)))
    return finish(r.results.select("run_id", "entity_id", "baseMean", "log2FoldChange", "lfcSE", "stat", "pvalue", "padj"))


def _two_runs(pools):
    """``pools``, and ``swapped`` with the conditions of all replicates exchanged."""
    other = F.when(F.col("condition") == "test", "control").otherwise("test")
    return pools.withColumn("run_id", F.lit("pools")).unionByName(
        pools.withColumn("condition", other).withColumn("run_id", F.lit("swapped")))


@register("pca_runs", "D12 D13 O04 by run_id", _chain(f"""
select b.run_id, p.sample, case when b.side = 1 then p.condition when p.condition = 'test' then 'control' else 'test' end as condition,
       p.pc1, p.pc2 from both_runs b, (SELECTED) p""".replace("SELECTED", f"select s.sample, s.condition, {R6('a.score')} as pc1, {R6('b.score')} as pc2 from smps s join axis1 a using (sample) join axis2 b using (sample)"),
    [*DQ.AXIS_VIEWS, *RUN_VIEWS]))
def q_pca_runs(spark, sf_dir):
    return finish(differential_abundance_runs(_two_runs(adapters.pools(spark, sf_dir)), filtering=False, with_pca=True).pca)


@register("runs_log", "D15 of many runs in the same jobs (two usable runs, one with fractional counts, one of one condition)", with_views("""
select run_id, (select count(*) from smps) as replicates, true as run, true as success, cast(null as varchar) as reason
from (values ('pools'), ('swapped')) r(run_id)
union all
select 'bad', (select count(*) from smps), true, false, concat(cast(count(*) as varchar), ' counts are negative or not integers') from pool
union all
select 'lone', (select count(*) from smps where condition = 'test'), true, false, 'both conditions need replicates'""", *POOL_VIEWS))
def q_runs_log(spark, sf_dir):
    pools = adapters.pools(spark, sf_dir)
    bad = pools.withColumn("cnt", F.col("cnt") + F.lit(0.5)).withColumn("run_id", F.lit("bad"))
    lone = pools.where("condition = 'test'").withColumn("run_id", F.lit("lone"))
    runs = _two_runs(pools).withColumn("cnt", F.col("cnt").cast("double"))
    return differential_abundance_runs(runs.unionByName(bad).unionByName(lone.withColumn("cnt", F.col("cnt").cast("double"))), filtering=False).log


PCA_SELECT = f"select s.sample, s.condition, {R6('a.score')} as pc1, {R6('b.score')} as pc2 from smps s join axis1 a using (sample) join axis2 b using (sample)"


@register("sample_pca", "D12 D13 O04 (transform by the rule that picks its variant, most variable genes, principal axes)", _chain(PCA_SELECT, DQ.AXIS_VIEWS))
def q_pca(spark, sf_dir):
    r = differential_abundance(adapters.pools(spark, sf_dir), with_pca=True, results=False)
    return finish(r.pca)


@register("sample_pca_full", "D12 D13 O04 (transform on the trend of all genes)", _chain(PCA_SELECT, DQ.FULL_AXIS_VIEWS))
def q_pca_full(spark, sf_dir):
    r = differential_abundance(adapters.pools(spark, sf_dir), with_pca=True, results=False, transform="full")
    return finish(r.pca)


@register("transform_genes", "D12 (genes the fast transform fits its trend on)", _chain(
    "select entity_id from spaced where (select enough from ruled)", DQ.PCA_VIEWS))
def q_transform_genes(spark, sf_dir):
    long, design = _pool_design(spark, sf_dir)
    matrix = DC.count_matrix(long, design)
    genes = DC.normalised(matrix, DC.size_factors(matrix, design))
    return PCA.spread_over_means(genes).select("entity_id")


# --- attributes and coordinate files ------------------------------------------------------------

import uuid  # noqa: E402

from duocount.functions.attributes import parse_attributes, widen_attributes  # noqa: E402
from duocount.session import checkpoint_dir  # noqa: E402
from duocount.sources import coordinates as CO  # noqa: E402


def ATTR(key: str) -> str:
    return (f"split_part(list_filter(list_filter(string_split(attributes, ';'), lambda p: p like '%=%'), "
            f"lambda p: split_part(p, '=', 1) = '{key}')[-1], '=', 2)")


@register("attributes", "C02 C03 (last duplicate wins, a=b=c gives b, bare words skipped)", with_views(f"""
select event_id, {ATTR('ID')} as "ID", {ATTR('k')} as k, {ATTR('type')} as type from attr"""))
def q_attributes(spark, sf_dir):
    a = adapters.attributes(spark, sf_dir).select("event_id", parse_attributes("attributes").alias("attr_map"))
    return widen_attributes(a, "attr_map")


@register("coordinates_ring", "P08 (ring track of coordinate rows, start - 1)", with_views("""
select cast(seq_id as varchar) as block_id, "start" - 1 as "start", "end", try_cast(score as double) as value from coords"""))
def q_coords_ring(spark, sf_dir):
    return finish(PR.coordinates_ring(adapters.coordinates(spark, sf_dir)))


@register("coordinates_roundtrip", "S01 S06 (write coordinate files with a header, scan them back)", with_views("""
select seq_id, source, type, "start", "end", score, strand, phase, attributes, condition from coords"""))
def q_coords_roundtrip(spark, sf_dir):
    out = f"{checkpoint_dir(spark)}/coords-{uuid.uuid4().hex}"
    coords = adapters.coordinates(spark, sf_dir)
    for cond in ("control", "test"):
        header = spark.createDataFrame([(1, "##gff-version 3"), (2, f"#condition {cond}")], "line_no long, text string")
        CO.write_coordinates(coords.where(F.col("condition") == cond), f"{out}/{cond}", header)
    back = CO.read_coordinates(spark, f"{out}/*/part-*")
    return back.select(*[c for c in back.columns if c not in ("file_path", "_corrupt")],
                       F.regexp_extract("file_path", r"/(control|test)/part-", 1).alias("condition"))
