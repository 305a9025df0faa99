import numpy as np
import pytest
from pyspark.sql import functions as F

from duocount.operators.diffexp.run import differential_abundance
from duocount.operators.diffexp.runs import differential_abundance_runs
from tests.test_diffexp import simulate

NUMBERS = ["baseMean", "log2FoldChange", "lfcSE", "stat", "pvalue", "padj", "dispGeneEst", "dispFit", "dispersion", "maxCooks"]


@pytest.fixture(scope="module")
def singles(spark):
    """Three runs that can be fitted, of different sizes; the one without an id has another number of replicates."""
    small = simulate(spark, n_genes=80, planted=8, seed=4)
    return {"one": simulate(spark, n_genes=150, planted=30, seed=3),
            "two": small, None: simulate(spark, n_genes=100, reps=8, planted=10, seed=5, sf=[1.0, 1.2] * 8)}


def stacked(singles):
    out = None
    for run, df in singles.items():
        df = df.withColumn("run_id", F.lit(run).cast("string")).withColumn("cnt", F.col("cnt").cast("double"))
        out = df if out is None else out.unionByName(df)
    return out


def compare(spark, singles, found, filtering, axes=True):
    got = found.results.toPandas()
    got_axes = found.pca.toPandas() if axes else None
    for run, df in singles.items():
        alone = differential_abundance(df, filtering=filtering, with_pca=axes)
        want = alone.results.toPandas().set_index("entity_id").sort_index()
        mine = got[got.run_id.isna() if run is None else got.run_id == run].set_index("entity_id").sort_index()
        assert list(mine.index) == list(want.index)
        for c in NUMBERS:
            assert np.allclose(mine[c].astype(float), want[c].astype(float), rtol=1e-6, atol=1e-9, equal_nan=True), (run, c)
        assert (mine.replaced == want.replaced).all() and (mine.nAbove == want.nAbove).all()
        if axes:
            a = got_axes[got_axes.run_id.isna() if run is None else got_axes.run_id == run].set_index("sample").sort_index()
            b = alone.pca.toPandas().set_index("sample").sort_index()
            assert np.allclose(a[["pc1", "pc2"]], b[["pc1", "pc2"]], atol=1e-6)


@pytest.mark.parametrize("filtering", [True, False])
def test_each_run_as_it_would_be_alone(spark, singles, filtering):
    bad = singles["two"].withColumn("cnt", F.col("cnt") + 0.5).withColumn("run_id", F.lit("bad"))
    lone = singles["two"].where("condition = 'test'").withColumn("run_id", F.lit("lone"))
    zero = singles["two"].withColumn("cnt", F.lit(0)).withColumn("run_id", F.lit("zero"))
    found = differential_abundance_runs(stacked(singles).unionByName(bad).unionByName(lone).unionByName(zero),
                                        filtering=filtering, with_pca=filtering)
    compare(spark, singles, found, filtering, axes=filtering)
    log = {r["run_id"]: r for r in found.log.collect()}
    assert {k for k, r in log.items() if r["success"]} == {"one", "two", None}
    assert all(r["run"] for r in log.values()) and log[None]["replicates"] == 16
    assert "negative or not integers" in log["bad"]["reason"]
    assert log["lone"]["reason"] == "both conditions need replicates"
    assert "size factors undefined" in log["zero"]["reason"]


def test_blocks_change_nothing(spark, singles):
    two = stacked({k: singles["two"] for k in ("a", "b")})
    want = differential_abundance_runs(two, filtering=False).results.toPandas()
    found = differential_abundance_runs(two, filtering=False, runs_at_once=1)
    key = ["run_id", "entity_id"]
    got = found.results.toPandas().sort_values(key)
    want = want.sort_values(key)
    assert (got[key].values == want[key].values).all() and found.log.count() == 2
    assert np.allclose(got[NUMBERS].astype(float), want[NUMBERS].astype(float), equal_nan=True)


def test_no_rows_no_runs(spark, singles):
    found = differential_abundance_runs(stacked(singles).limit(0), with_pca=True)
    assert found.results is None and found.pca.count() == 0 and found.log.count() == 0


def test_jobs_do_not_follow_the_number_of_runs(spark, singles):
    def jobs(df):
        sc, group = spark.sparkContext, f"runs-{df.columns}-{np.random.rand()}"
        sc.setJobGroup(group, group)
        differential_abundance_runs(df, filtering=False)
        sc.setLocalProperty("spark.jobGroup.id", None)
        return len(sc.statusTracker().getJobIdsForGroup(group))

    one = singles["two"].withColumn("run_id", F.lit("r0"))
    many = one.withColumn("run_id", F.explode(F.array([F.lit(f"r{i}") for i in range(12)])))
    assert jobs(many) <= jobs(one) + 4


def test_counts_of_runs_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    rows = [(f"g{g}", f"{c}{k}", c, 20 + (g * 7 + k * 13 + (c == "test") * g) % 90) for g in range(40) for c in ("control", "test") for k in range(3)]
    counts = spark.createDataFrame([(r, *x) for r in ("a", None) for x in rows], "run_id string, entity_id string, sample string, condition string, cnt long")
    counts.count()
    out = differential_abundance_runs(counts.mapInPandas(make, counts.schema), filtering=False, with_pca=True)
    assert {(r.run_id, r.success) for r in out.log.collect()} == {("a", True), (None, True)}
    assert out.pca.count() == 12 and out.results.count() == 80
    assert made.value == 2 * len(rows)
