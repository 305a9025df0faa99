"""Registered queries over files the library writes and reads back, wide replicate pools, run logs and
the smaller view helpers. Files go under the session's checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from duocount.functions.scalar import bar_centre, bar_width, gene_label
from duocount.operators import compare as cmp
from duocount.operators import insertions as I
from duocount.operators import ordered as OR
from duocount.operators import sets as S
from duocount.operators.diffexp import counts as DC
from duocount.operators.diffexp.pca import split_by_condition
from duocount.operators.diffexp.run import attach_results, differential_abundance, logged_run, run_log
from duocount.plans import diffexp_sql as DQ
from duocount.plans import adapters, flagship, views
from duocount.plans.catalog import R6, finish, register, with_views
from duocount.plans.queries import KEYS_SQL, MERGED_SELECT, POOL_VIEWS
from duocount.session import checkpoint_dir
from duocount.sources import coordinates as CO
from duocount.sources import scores as SC
from duocount.sources import store
from duocount.spec import FEATURE_KEYS, ComparisonSpec
from duocount.streaming import landing


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/duocount-files/{name}-{uuid.uuid4().hex}"


# --- coordinate files ---------------------------------------------------------------------------

def _halved(spark, sf_dir):
    """Coordinate rows whose test scores are half counts, so sums are fractional."""
    half = F.expr("try_cast(score as double)") / F.lit(2.0)
    return adapters.coordinates(spark, sf_dir).withColumn(
        "score", F.when(F.col("condition") == "test", half.cast("string")).otherwise(F.col("score")))


def _written(spark, coords):
    """Both conditions written as coordinate files with a two-line header."""
    out = _folder(spark, "coordinates")
    for cond in I.CONDITIONS:
        rows = coords.where(F.col("condition") == cond)
        header = rows.agg(F.count(F.lit(1)).alias("n")).select(F.posexplode(F.array(
            F.lit("##gff-version 3"), F.concat(F.lit("#rows "), F.col("n").cast("string")))).alias("i", "text")).select(
            (F.col("i") + 1).cast("long").alias("line_no"), "text")
        CO.write_coordinates(rows, f"{out}/{cond}", header)
    return f"{out}/*/part-*"


def _file_condition():
    return F.regexp_extract("file_path", r"/(control|test)/part-", 1).alias("condition")


@register("coordinate_gene_totals", "S06 S01 A02 A03 J04 A04 (files to gene totals, fractional scores)", with_views(f"""
select t.*, {R6('total_raw')} as total_reads from (
select seq_id, locus_tag, type, gene, start_pos, end_pos, feat_length, product, condition,
       coalesce(sum(case when within_cds then reads end), 0) as total_raw,
       cast(coalesce(sum(case when within_cds then "rows" end), 0) as bigint) as n_rows,
       count(case when within_cds then 1 end) as unique_sites,
       min(case when within_cds then position end) as first_pos, max(case when within_cds then position end) as last_pos
from fh group by all) t""".replace("select t.*,", f"select {KEYS_SQL}, condition, n_rows, unique_sites, first_pos, last_pos,"),
    ("prof", """select condition, seq_id, position, count(*)::DOUBLE as c from ins where condition = 'control' group by 1, 2, 3
                union all select condition, seq_id, position, cnt / 2.0::DOUBLE as c from ins where condition = 'test'"""),
    ("psites", """select seq_id, condition, position, sum(c) as reads, count(*) as "rows" from prof group by 1, 2, 3"""),
    ("fh", """select f.*, c.condition, s.position, s.reads, s."rows", (s.position between f.start_pos and f.end_pos) as within_cds
              from feat f cross join conds c left join psites s on s.seq_id = f.seq_id and s.condition = c.condition
              and s.position > f.start_pos and s.position < f.end_pos""")))
def q_coordinate_totals(spark, sf_dir):
    back = CO.read_coordinates(spark, _written(spark, _halved(spark, sf_dir)))
    profile = I.profile_from_coordinates(back.withColumn("condition", _file_condition()), by=["condition"])
    sites = I.insertion_sites(profile, count="count")
    return finish(I.feature_totals(adapters.features(spark, sf_dir), sites, FEATURE_KEYS))


@register("header_lines", "S06 S02 (header of every written coordinate file)", with_views("""
select condition, cast(1 as bigint) as line_no, '##gff-version 3' as text from coords group by 1
union all
select condition, cast(2 as bigint), concat('#rows ', cast(count(*) as varchar)) from coords group by 1"""))
def q_header(spark, sf_dir):
    head = CO.read_header(spark, _written(spark, adapters.coordinates(spark, sf_dir)))
    return finish(head.select(_file_condition(), "line_no", "text"))


@register("unreadable_scores", "S01 (scores that are neither '.' nor a number, by condition)", with_views("""
select condition, cast(count(*) filter (where condition = 'test' and cnt % 10 = 0) as bigint) as unreadable_scores
from ins group by 1"""))
def q_unreadable(spark, sf_dir):
    c = adapters.coordinates(spark, sf_dir)
    spoilt = c.withColumn("score", F.when(F.col("score").endswith("0"), F.concat("score", F.lit("?"))).otherwise(F.col("score")))
    return finish(CO.unreadable_scores(spoilt, ["condition"]))


@register("sequence_rows", "A05 A12 (distinct sequences and rows by condition)", with_views("""
select condition, seq_id, count(*) as n_rows from coords group by 1, 2"""))
def q_sequences(spark, sf_dir):
    c = adapters.coordinates(spark, sf_dir)
    rows = I.value_counts(c, ["condition", "seq_id"], "n_rows")
    return I.distinct_sequences(c, ["condition"]).join(rows, ["condition", "seq_id"])


@register("aligned_profiles", "A03 J02 (outer join of both profiles, repeated positions summed)", with_views(f"""
select seq_id, position, {R6('coalesce(c.n, 0)')} as control_count, {R6('coalesce(t.n, 0)')} as test_count
from (select seq_id, position, count(*) as n from ins where condition = 'control' group by 1, 2) c
full join (select seq_id, position, sum(cnt) as n from ins where condition = 'test' group by 1, 2) t using (seq_id, position)"""))
def q_aligned(spark, sf_dir):
    p = I.profile_from_coordinates(adapters.coordinates(spark, sf_dir), by=["condition"], dedupe="sum")
    control, test = (p.where(F.col("condition") == c).drop("condition") for c in I.CONDITIONS)
    return finish(I.align_profiles(control, test))


# --- score files --------------------------------------------------------------------------------

SCORES = ("nim_score", "nrm_score")


def _dropped_files(spark, sf_dir):
    """Score tables as CSV by condition, with rows that lack a locus tag and rows of nulls alone."""
    out = _folder(spark, "scores")
    scores = flagship.score_tables(spark, sf_dir).select("condition", *FEATURE_KEYS, *SCORES)
    spoilt = scores.select("condition", *[F.lit(None).cast("string").alias(c) if c == "locus_tag" else F.col(c)
                                          for c in (*FEATURE_KEYS, *SCORES)])
    blank = scores.select("condition", *[F.lit(None).cast(scores.schema[c].dataType).alias(c) for c in (*FEATURE_KEYS, *SCORES)])
    for cond in I.CONDITIONS:
        rows = scores.unionByName(spoilt).unionByName(blank).where(F.col("condition") == cond).drop("condition")
        SC.export_table(rows, f"{out}/run1/scores_{cond}")
    return out


SCORES_SQL = f"select {KEYS_SQL}, {R6('nim_score')} as nim_score, {R6('nrm_score')} as nrm_score from scores"


@register("score_files", "S08 S03 F01 F02 S09 (control table written, read back, control-only comparison)",
          with_views(SCORES_SQL + " where condition = 'control'"))
def q_score_files(spark, sf_dir):
    read = SC.read_scores(spark, f"{_dropped_files(spark, sf_dir)}/run1/scores_control")
    df, _ = cmp.compare(SC.drop_missing_locus(read), None, ComparisonSpec(test_suffix=None))
    return finish(df)


@register("empty_rows", "S08 S03 F01 (rows left once rows of nulls alone are dropped)", with_views("""
select condition, cast(2 * count(*) as bigint) as n_rows from scores group by 1"""))
def q_empty_rows(spark, sf_dir):
    out = _dropped_files(spark, sf_dir)
    parts = [SC.read_scores(spark, f"{out}/run1/scores_{c}").agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(c).alias("condition"), "n_rows") for c in I.CONDITIONS]
    return parts[0].unionByName(parts[1])


@register("discovered_files", "S08 S04 (run and condition of every written file)", with_views("""
select 'run1' as run_id, condition from scores group by 1, 2"""))
def q_discovered(spark, sf_dir):
    files = SC.discover(spark, _dropped_files(spark, sf_dir), run_regex=r"([^/]+)/[^/]+/[^/]+$",
                        condition_regex=r"_(control|test)/[^/]*$")
    return files.where("length > 0").select("run_id", "condition").distinct()


@register("landed_scores", "S05 F02 (dropped files ingested by a stream, each once)", with_views(SCORES_SQL))
def q_landed(spark, sf_dir):
    out = _dropped_files(spark, sf_dir)
    where = (f"{out}/run1/*", f"{out}/table", f"{out}/progress")
    for _ in range(2):  # the second pass finds nothing new
        landing.ingest_available(spark, *where, landing.landing_schema(SCORES))
    return finish(landing.landed(spark, f"{out}/table").drop("source_file"))


@register("landed_names", "S05 (a name already stored is refused and logged, rows kept once)", with_views("""
select condition, folder, folder = 'run1' as stored, case when folder = 'run2' then 'File Already Exists' end as reason, n_rows
from (select condition, count(*) as n_rows from scores group by 1) join (values ('run1'), ('run2')) as f(folder) on true"""))
def q_landed_names(spark, sf_dir):
    out = _dropped_files(spark, sf_dir)
    where = (f"{out}/*/*", f"{out}-table", f"{out}-progress")
    landing.ingest_available(spark, *where, landing.landing_schema(SCORES))
    # the same files come again from another folder
    again = [spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{folder}") for folder in ("run1", "run2")]
    again[0].getFileSystem(spark._jsc.hadoopConfiguration()).rename(*again)
    landing.ingest_available(spark, *where, landing.landing_schema(SCORES))
    rows = landing.landed(spark, f"{out}-table").groupBy("source_file").agg(F.count("*").alias("n_rows"))
    seen = landing.landing_log(spark, f"{out}-table").join(rows, "source_file")
    return finish(seen.groupBy(F.regexp_extract("file_path", "_(control|test)/[^/]*$", 1).alias("condition"),
                               F.regexp_extract("file_path", "/(run[12])/", 1).alias("folder"), "stored", "reason").agg(
        F.sum("n_rows").alias("n_rows")))


@register("landed_coordinates", "S05 S06 S01 (dropped coordinate files ingested by a stream)", with_views("""
select condition, seq_id, count(*) as n_rows, cast(min("start") as bigint) as first_start, cast(max("end") as bigint) as last_end
from coords group by 1, 2"""))
def q_landed_coordinates(spark, sf_dir):
    out = _folder(spark, "landed-coordinates")
    for cond in I.CONDITIONS:
        rows = adapters.coordinates(spark, sf_dir).where(F.col("condition") == cond)
        CO.write_coordinates(rows.withColumn("source", F.lit(cond)), f"{out}/drop/{cond}")
    where = (f"{out}/drop/*", f"{out}/table", f"{out}/progress")
    for _ in range(2):  # the second pass finds nothing new
        landing.start_coordinate_ingest(spark, *where, pattern="part-*").awaitTermination()
    return finish(landing.landed(spark, f"{out}/table").groupBy(F.col("source").alias("condition"), "seq_id").agg(
        F.count("*").alias("n_rows"), F.min("start").alias("first_start"), F.max("end").alias("last_end")))


@register("saved_comparison", "S07 (comparison saved, loaded, its spec deciding the columns)", with_views(f"""
select {MERGED_SELECT}, {R6('fold_change')} as fold_change from cmp""".replace("seq_id, locus_tag", "locus_tag", 1)))
def q_saved(spark, sf_dir):
    out = _folder(spark, "comparison")
    df, spec = flagship.comparison(spark, sf_dir)
    store.save_comparison(df, spec, out)
    back, spec = store.load_comparison(spark, out)
    return finish(back.select(*cmp.visible_columns(back, spec, metric="fold_change")))


# --- replicate pools ----------------------------------------------------------------------------

def _wide(spark, sf_dir):
    """One column per replicate, null where an entity has no reads in it; every row twice, the second
    with all counts 1, as a later duplicate."""
    long = adapters.pools(spark, sf_dir)
    names = DC.design_of(long).samples
    wide = long.groupBy("entity_id").agg(*[F.sum(F.when(F.col("sample") == s, F.col("cnt"))).alias(s) for s in names])
    again = wide.select("entity_id", *[F.lit(1).cast("long").alias(s) for s in names])
    return wide.withColumn("line", F.lit(1)).unionByName(again.withColumn("line", F.lit(2)))


WIDE_SQL = """select p.* from pool p join (select entity_id from pool group by 1
    having count(*) = (select count(*) from smps)) k using (entity_id)"""


@register("wide_pools", "F14 F03 P10 D01 (replicate columns to counts; first duplicate, then nulls)", with_views(
    "select entity_id, sample, condition, cnt from wp", *POOL_VIEWS, ("wp", WIDE_SQL)))
def q_wide(spark, sf_dir):
    return finish(DC.long_counts_from_wide(_wide(spark, sf_dir), "entity_id", order=["line"]).select(
        "entity_id", "sample", "condition", "cnt"))


@register("wide_size_factors", "F14 F03 D01 D02 (size factors of replicate columns)", with_views(f"""
select sample, {R6('exp(median(ln(cnt::DOUBLE) - lgm))')} as size_factor
from wp join wl using (entity_id) group by 1""", *POOL_VIEWS, ("wp", WIDE_SQL),
    ("wl", "select entity_id, avg(ln(cnt::DOUBLE)) as lgm from wp group by 1 having min(cnt) > 0")))
def q_wide_factors(spark, sf_dir):
    long = DC.long_counts_from_wide(_wide(spark, sf_dir), "entity_id", order=["line"])
    design = DC.design_of(long)
    sf = DC.size_factors(DC.count_matrix(long, design), design)
    return finish(spark.createDataFrame(list(zip(design.samples, sf)), "sample string, size_factor double"))


@register("de_metric", "P12 J03 P04 (result column attached, chosen as the one metric shown)", with_views(f"""
select locus_tag, type, gene, start_pos, end_pos, feat_length, product, {R6('bm')} as "de_baseMean"
from feat left join (select concat('LT', entity_id) as locus_tag, avg(q) as bm from nrm group by 1) using (locus_tag)""",
    *POOL_VIEWS))
def q_de_metric(spark, sf_dir):
    long = adapters.pools(spark, sf_dir)
    design = DC.design_of(long)
    m = DC.count_matrix(long, design)
    res = DC.normalised(m, DC.size_factors(m, design)).withColumn("entity_id", F.concat(F.lit("LT"), "entity_id"))
    df, spec = attach_results(adapters.features(spark, sf_dir), res, "locus_tag", columns=["baseMean"])
    return finish(df.select(*cmp.visible_columns(df, spec, metric="de_baseMean")))


@register("run_log", "D15 (one usable run and one with fractional counts)", with_views("""
select 'good' as run_id, (select count(*) from smps) as replicates, true as run, true as success, cast(null as varchar) as reason
union all
select 'bad', (select count(*) from smps), true, false, concat(cast(count(*) as varchar), ' counts are negative or not integers') from pool""",
    *POOL_VIEWS))
def q_run_log(spark, sf_dir):
    pools = adapters.pools(spark, sf_dir)
    bad = pools.withColumn("cnt", F.col("cnt") + F.lit(0.5))
    only = dict(with_pca=False, results=False)
    return run_log(spark, [logged_run(name, counts, **only)[1] for name, counts in (("good", pools), ("bad", bad))])


# --- views --------------------------------------------------------------------------------------

@register("gene_viewer_totals", "A04 P11 (gene viewer: labelled totals)", with_views("""
select locus_tag, condition, total_reads, unique_sites,
       case when gene is null then locus_tag else concat(locus_tag, ' - ', gene) end as label from tot"""))
def q_viewer(spark, sf_dir):
    _, totals = views.gene_viewer(adapters.features(spark, sf_dir), adapters.insertions(spark, sf_dir), FEATURE_KEYS)
    return finish(totals.select("locus_tag", "condition", "total_reads", "unique_sites", "label"))


@register("gene_rows", "O01 P06 (genes by position with dense row numbers, whole and within type)", with_views("""
select locus_tag, seq_id, start_pos, type, row_number() over (order by seq_id, start_pos, locus_tag) - 1 as row_number,
       row_number() over (partition by type order by seq_id, start_pos, locus_tag) - 1 as row_in_type from feat"""))
def q_gene_rows(spark, sf_dir):
    f = adapters.features(spark, sf_dir).select("locus_tag", "seq_id", "start_pos", "type")
    order = ["seq_id", "start_pos", "locus_tag"]
    return finish(cmp.add_row_number(cmp.add_row_number(f, order), order, ["type"], "row_in_type"))


@register("gene_lookup", "F12 (the gene of a selected row: the last one by position)", with_views("""
select locus_tag, gene, start_pos, end_pos, product from feat where locus_tag = (select locus_tag from feat order by seq_id desc, start_pos desc, locus_tag desc limit 1)"""))
def q_gene_lookup(spark, sf_dir):
    f = adapters.features(spark, sf_dir)
    selected = cmp.page(f, [F.col("seq_id").desc(), F.col("start_pos").desc()], [F.col("locus_tag").desc()], 0, 1).first()
    return finish(cmp.lookup(f, selected["locus_tag"]).select("locus_tag", "gene", "start_pos", "end_pos", "product"))


@register("readable_export", "P13 S08 (exported with readable headings and read back)", with_views("""
select locus_tag as "locus tag", start_pos as "start pos", end_pos as "end pos", feat_length as "feat length" from feat"""))
def q_readable_export(spark, sf_dir):
    out = _folder(spark, "export")
    shown = adapters.features(spark, sf_dir).select("locus_tag", "start_pos", "end_pos", "feat_length")
    SC.export_table(shown, out, readable_headers=True)
    back = spark.read.option("header", True).csv(out)
    return finish(back.select("locus tag", *[F.col(f"`{c}`").cast("bigint").alias(c) for c in ("start pos", "end pos", "feat length")]))


@register("pca_by_condition", "F15 (replicates of the test condition on the principal axes)", with_views(f"""
select s.sample, {R6('a.score')} as pc1, {R6('b.score')} as pc2 from smps s join axis1 a using (sample) join axis2 b using (sample)
where s.condition = 'test'""", *POOL_VIEWS, *DQ.AXIS_VIEWS, materialized=True))
def q_pca_by_condition(spark, sf_dir):
    r = differential_abundance(adapters.pools(spark, sf_dir), with_pca=True, results=False)
    return finish(split_by_condition(r.pca, "test").select("sample", "pc1", "pc2"))


@register("gene_bars", "P06 P09 P11 (bar centre and width, row id)", with_views(f"""
select concat(seq_id, '|', locus_tag) as row_id, {R6('(end_pos - start_pos) / 2.0 + start_pos')} as centre,
       end_pos - start_pos as width, case when gene is null then locus_tag else concat(locus_tag, ' - ', gene) end as label
from feat"""))
def q_bars(spark, sf_dir):
    f = cmp.add_row_id(adapters.features(spark, sf_dir), keys=["seq_id", "locus_tag"])
    f = cmp.insert_column(cmp.insert_column(f, "centre", bar_centre()), "width", bar_width())
    return finish(f.select("row_id", "centre", "width", gene_label().alias("label")))


@register("stacked_scores", "U03 (control and test rows under one group column)", with_views(f"""
select locus_tag, case when condition = 'control' then 'Control' else 'Test' end as "group", {R6('nim_score')} as nim_score
from scores"""))
def q_stacked(spark, sf_dir):
    s = flagship.score_tables(spark, sf_dir)
    stacked = I.stack_conditions(*(flagship.condition_table(s, c) for c in I.CONDITIONS))
    return finish(stacked.select("locus_tag", "group", "nim_score"))


@register("stacked_groups", "U03 U04 (groups present)", with_views("""
select case when condition = 'control' then 'Control' else 'Test' end as "group" from scores group by 1"""))
def q_groups(spark, sf_dir):
    s = flagship.score_tables(spark, sf_dir)
    return S.distinct_groups(I.stack_conditions(*(flagship.condition_table(s, c) for c in I.CONDITIONS)))


def _track_sql(score):
    return f"""
select '{score}' as metric, condition, seq_id, start_pos as seg_start, end_pos as seg_end, {R6(score)} as value, locus_tag as label from g
union all
select '{score}', condition, seq_id, end_pos, nxt, 0.0, '' from g where nxt is not null"""


@register("score_track_both", "W03 P14 (both conditions, both scores)", with_views(
    " union all ".join(_track_sql(s) for s in SCORES),
    ("g", """select *, lead(start_pos) over (partition by condition, seq_id order by start_pos, end_pos, locus_tag) as nxt
             from scores""")))
def q_track_both(spark, sf_dir):
    s = flagship.score_tables(spark, sf_dir)
    a, b = (I.score_track(s, m, by=["condition"]).withColumn("metric", F.lit(m)) for m in SCORES)
    return finish(a.unionByName(b))


@register("lead_extremes", "W03 (null ends, intervals beyond 2^32, shared starts)", """
select l_linestatus, start_pos, end_pos, id,
       lead(start_pos) over (partition by l_linestatus order by start_pos nulls first, end_pos nulls first, id) as next_start
from (select l_linestatus, cast(l_partkey % 50 as bigint) * 86400000 as start_pos,
             case when l_orderkey % 7 <> 0 then cast(l_partkey % 50 as bigint) * 86400000 + l_suppkey * 6000000000 end as end_pos,
             l_orderkey * 10 + l_linenumber as id from lineitem)""")
def q_lead_extremes(spark, sf_dir):
    start = (F.col("l_partkey") % 50).cast("long") * F.lit(86400000)
    x = adapters.table(spark, sf_dir, "lineitem").select(
        "l_linestatus", start.alias("start_pos"),
        F.when(F.col("l_orderkey") % 7 != 0, start + F.col("l_suppkey").cast("long") * F.lit(6000000000)).alias("end_pos"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"))
    return finish(OR.next_in_order(x, ["l_linestatus"], ["start_pos", "end_pos", "id"], "start_pos", "next_start"))
