"""Tasks whose rows don't grow with the tables."""

from barloom.operators import bars as B
from barloom.operators import metrics as M
from barloom.operators import rule_index as RI
from barloom.operators import toplists as K
from barloom.plans import queries as Q

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_values_are_not_dealt_by_metric(spark, monkeypatch):
    page = lambda: K.ranked(Q.traded_values(spark, SF), K.spec_table(spark, Q._TRADED), 25)
    assert "hashpartitioning(metric" not in plan(page())
    want = sorted(page().collect())
    monkeypatch.setattr(K, "FEW_LISTS", 0)
    assert "hashpartitioning(metric" in plan(page()) and sorted(page().collect()) == want


def test_day_bars_are_dealt_by_symbol_alone(spark, monkeypatch):
    want = sorted(Q.QUERIES["avg_volume_nd"](spark, SF).collect(), key=repr)
    monkeypatch.setattr(B, "PART_ROWS", 500)
    assert Q.day_bars(spark, SF).rdd.getNumPartitions() == 12
    assert "hashpartitioning(symbol#" in plan(Q.day_bars(spark, SF)) and plan(Q.day_bars(spark, SF)).count("Exchange") == 1
    assert sorted(Q.QUERIES["avg_volume_nd"](spark, SF).collect(), key=repr) == want


def test_metrics_are_computed_once_for_all_blocks_of_rules(spark):
    rules = Q.order_rules(spark, SF)
    metrics = M.with_metrics(Q.user_bars(spark, SF), RI.required(rules))
    whole, parts = RI.scan_table(metrics, rules, metadata=False), RI.scan_table(metrics, rules, 200)
    assert "metadata" not in whole.columns and "FileScan" in plan(whole) and "FileScan" not in plan(parts)
    assert sorted(whole.collect()) == sorted(parts.drop("metadata").collect())
