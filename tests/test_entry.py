import importlib
import importlib.util

import pytest

from tests.conftest import SF_SMALL


def test_entry_and_registry(spark):
    E = importlib.import_module("__spark_entry__")
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 50 and "fold_change" in df.columns
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    # the training-data queries are there just when their subpackage is
    found = importlib.util.find_spec("duocount.llm") is not None and importlib.util.find_spec("corpus_pipeline") is not None
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in q if k.startswith("op")} if found else "pipeline" not in q


@pytest.mark.parametrize("name", ["merged_comparison", "gene_scores", "score_track", "venn_sweep"])
def test_plans_have_no_nested_loops(spark, name):
    E = importlib.import_module("__spark_entry__")
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert df.count() >= 0
