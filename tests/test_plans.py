"""Scale guard: neither the derivation, the registered queries nor model scoring plans an operator that does not scale."""

import os
import re

import pytest
from pyspark.sql import functions as F

from churnlens.operators import model
from churnlens.plans.behavior import behavior_from_tables
from churnlens.plans.queries import QUERIES
from churnlens.sources.adapter import churn_tables
from churnlens.sources.intake import customer_intake

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "SortAggregate", "BatchEvalPython", "ArrowEvalPython"]
# building these runs model fits; their inputs and scoring plans are audited below
FITS = {"tree_scores", "logistic_scores", "kmeans_segments", "kmeans_cluster_summary"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def assert_scales(name, plan):
    found = [op for op in FORBIDDEN if re.search(r"(?<![A-Za-z])" + op + r"\b", plan)]
    assert not found, f"{name}: {found}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITS))
def test_plan_has_no_unscalable_operator(spark, name):
    assert_scales(name, plan_of(QUERIES[name](spark, SF)))


def test_derivation_plans(spark):
    tables = churn_tables(spark, SF)
    for name, df in tables.as_dict().items():
        assert_scales(name, plan_of(df))
    assert_scales("view", plan_of(behavior_from_tables(tables)))
    assert_scales("intake", plan_of(customer_intake(spark, SF)))


def test_scoring_plan(spark):
    view = QUERIES["behavior_view"](spark, SF)
    trained = model.train(view)
    for fitted in (trained.tree, trained.logistic):
        assert_scales("scores", plan_of(model.score(fitted, view)))


def aggregate_fallbacks(plan):
    """Sort-fallback tasks of all aggregates of an executed plan."""
    total, stack = 0, [plan]
    while stack:
        node = stack.pop()
        metric = node.metrics().get("numTasksFallBacked")
        if metric.isDefined():
            total += metric.get().value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize("name", ["behavior_view", "quality_report", "check_violations", "kpis"])
def test_aggregates_do_not_fall_back_to_sorting(spark, name):
    """Measured, not read off the plan: adaptive execution and broadcasts off, so that the plan is what ran."""
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        df = QUERIES[name](spark, SF)
        execution = df._jdf.queryExecution()
        execution.toRdd().count()
        assert aggregate_fallbacks(execution.executedPlan()) == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_counters_and_key_checks_do_not_share_a_shuffle(spark):
    plan = plan_of(QUERIES["check_violations"](spark, SF))
    assert "Expand" not in plan
    # the widest shuffled aggregate buffer of the quality report is the map-side combined single row
    report = plan_of(QUERIES["quality_report"](spark, SF))
    assert not re.search(r"partial_count_if.*hashpartitioning", report)


def test_money_scale_is_counted(spark):
    from churnlens.plans.behavior import money_sum, out_of_scale

    df = spark.createDataFrame([(1.25,), (0.0000001,), (None,), (1e33,)], "x double")
    assert df.select(out_of_scale(F.col("x"))).first()[0] == 2
    assert df.where("x < 10").select(money_sum(F.col("x"), 8)).first()[0] == 1.2500001


def test_store_is_the_only_intermediate_storage(spark):
    view = QUERIES["behavior_view"](spark, SF)
    folder = spark.conf.get("spark.checkpoint.dir")
    inputs = {f.removeprefix("file://") for f in view.inputFiles()}
    assert inputs and all(f.startswith(folder) or f.startswith(os.path.dirname(SF)) for f in inputs)
