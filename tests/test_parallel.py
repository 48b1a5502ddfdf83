"""Operators that spread one hot key over many tasks, against their plain forms; and the index of rules."""

import math
import random

import pytest
from barloom.operators import alerts as A
from barloom.operators import indicators as I
from barloom.operators import metrics as M
from barloom.operators import prefix as PX
from barloom.operators import rule_index as RI
from barloom.operators import rules as R
from barloom.operators import toplists as K
from barloom.plans import queries as Q
from barloom.sources import normalize as N
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def whole_partitions(spark):
    """Small partitions are left as they are, so that tests see what is spread."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


MATCH = "rule_id string, rule_name string, symbol string, t double, price double, metadata map<string, double>"


def matches(spark, rows):
    df = spark.createDataFrame([("r", "n", s, float(t), float(p), {"close": float(p)}) for s, t, p in rows], MATCH)
    return df.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))).drop("t").repartition(5)


def greedy(rows, seconds):
    """What fires, by a plain loop: the lowest price of those at one instant."""
    out, last = [], {}
    for s, t, p in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if s not in last or t >= last[s] + seconds:
            last[s] = t
            out.append((s, t, p))
    return sorted(out)


def fired(df):
    return sorted((r.symbol, r.at / 1e6, r.price) for r in df.select("symbol", F.unix_micros("ts").alias("at"), "price").collect())


@pytest.mark.parametrize("kind", ["dense", "sparse", "even", "ties"])
def test_cooldown_of_one_hot_key(spark, kind):
    rng = random.Random(kind)
    if kind == "dense":
        times = [rng.randint(0, 3_000_000) / 1000 for _ in range(4000)]
    elif kind == "sparse":
        times = [t + rng.randint(0, 400) / 10 for t in range(0, 60_000, 900) for _ in range(rng.randint(0, 12)) if t % 7]
    elif kind == "even":  # ten chains that never merge
        times = list(range(0, 2500))
    else:
        times = [rng.randint(0, 200) * 10 for _ in range(900)]
    rows = [("hot", 1_700_000_000 + t, rng.randint(1, 50)) for t in times] + [(f"s{i}", 1_700_000_000 + 11 * i + 7 * j, 1) for i in range(5) for j in range(4)]
    found, want = matches(spark, rows), greedy(rows, 10)
    assert fired(A.cooldown(found, 10)) == want
    assert fired(A.cooldown_parallel(found, 10, 4)) == want


def test_cooldown_is_spread_over_tasks(spark):
    found = matches(spark, [("hot", 1_700_000_000 + 3 * i, 1) for i in range(6000)])
    out = A.cooldown_parallel(found, 10, 8)
    assert out.groupBy(F.spark_partition_id()).count().count() > 3 and out.columns == found.columns
    assert A.cooldown_parallel(found.limit(0), 10).count() == A.cooldown(found.limit(0)).count() == 0
    late = found.withColumn("ts", F.lit(None).cast("timestamp"))
    assert A.cooldown(late).count() == A.cooldown_parallel(late).count() == 0
    with pytest.raises(ValueError, match="chunk"):
        A.cooldown_parallel(found, 10, 1)


def test_cooldown_goes_on_from_before(spark):
    rows = [("a", 1_700_000_000 + t, 1) for t in (0, 4, 9, 12, 30)]
    last = matches(spark, [("a", 1_699_999_998, 1), ("b", 5, 1)]).select("rule_id", "symbol", "ts")
    assert [t - 1_700_000_000 for _, t, _ in fired(A.cooldown(matches(spark, rows), 10, last))] == [9, 30]


def one_symbol(spark, n, seconds=60):
    rng, close, rows = random.Random(7), 100.0, []
    for i in range(n):
        close = max(1.0, close + rng.uniform(-1, 1))
        if rng.random() < 0.9:
            rows.append(("one", 1_700_000_000 + i * seconds, close))
    return spark.createDataFrame(rows, "symbol string, s long, close double").select("symbol", F.timestamp_seconds("s").alias("ts"), "close", F.lit(1).alias("other")).repartition(6)


@pytest.mark.parametrize(("n", "chunk"), [(20_000, 60_000), (300, 600), (300, 60), (40, 100_000)])
def test_recursive_indicators_of_one_symbol(spark, n, chunk):
    """Chunks of many sizes, also far below the bars that seed an average."""
    names = ["ema_9", "ema_200", "mma_20", "rsi_14", "macd_12_26_9", "macd_signal", "macd_hist"]
    bars = one_symbol(spark, n)
    want = {r.ts: r for r in I.with_recursive(bars, names).collect()}
    got = PX.with_recursive_chunked(bars, names, chunk)
    assert got.columns == [*bars.columns, *names]
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == len(want) and (n < 20_000 or len({r.task for r in rows}) > 4)
    for r in rows:
        for name in names:
            a, b = r[name], want[r.ts][name]
            assert (a is None) == (b is None) and (b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (name, r.ts)


def test_chunked_edges(spark):
    bars = one_symbol(spark, 50)
    assert PX.with_recursive_chunked(bars.limit(0), ["ema_9"]).count() == 0
    assert PX.with_recursive_chunked(bars, []).columns == bars.columns
    with pytest.raises(ValueError, match="unknown"):
        PX.with_recursive_chunked(bars, ["sma_9"])


# Index of rules -------------------------------------------------------------------------------------------------------


def rule_rows(rng, n, metrics):
    during = ["all", "all", "", "market", "premarket", "postmarket", "night"]
    out = []
    for i in range(n):
        conditions = [(rng.choice(metrics), rng.choice(R.OPERATORS), str(rng.choice([0, 1, 2, 2.00005, 3, -1, "NaN", "x"])), rng.choice([0, 0, 5, 500]), rng.choice(during), "", "$") for _ in range(rng.randint(1, 3))]
        conditions = [(m, "==" if v == "x" else o, v, *rest) for m, o, v, *rest in conditions]
        out.append((f"r{i % (n - 2)}", f"name {i}", "", conditions, 0, rng.random() < 0.9, "", ""))
    return out


def test_index_equals_the_compiled_scan(spark):
    """All operators, nulls, NaN, near equal values, sessions, thresholds, repeated ids, in one block and in many."""
    rng = random.Random(3)
    value = lambda: rng.choice([None, float("nan"), 0.0, 1.0, 2.0, 2.00005, 2.0001, 3.0, float("inf"), -5.0])
    rows = [(f"s{i}", i, value() or 0.5, rng.choice(["market", "premarket", "postmarket", "closed", None]), value(), value(), value(), rng.choice([None, 1, 100]), rng.choice([None, 0, 2]), None, None, None, None, 1, None) for i in range(400)]
    metrics = spark.createDataFrame(rows, "symbol string, s long, close double, session string, a double, b double, c double, volume_daily long, premarket_volume long, postmarket_volume long, volume_60m long, volume_15m long, volume_5m long, volume_1m long, volume_live long").withColumn("ts", F.timestamp_seconds("s"))
    made = rule_rows(rng, 120, ["a", "b", "c", "close"])
    table = spark.createDataFrame(made, f"id string, name string, description string, conditions array<{R.CONDITION}>, cooldown bigint, enabled boolean, created_at string, updated_at string")
    key = lambda r: (r.symbol, r.rule_id, r.rule_name, sorted((k, str(v)) for k, v in r.metadata.items()))
    during = ("", "all", "market", "premarket", "postmarket")
    valid = [r for r in made if all(c[4] in during and (c[2] != "x" or c[1] == "==") for c in r[3])]
    rules = [{"id": r[0], "name": r[1], "enabled": r[5], "conditions": [dict(zip(("metric", "operator", "value", "volume_threshold", "calculated_during"), c, strict=False)) for c in r[3]]} for r in valid]
    want = sorted(key(r) for r in R.scan(metrics, rules).collect())
    assert len(want) > 500
    for block in (RI.BLOCK, 17):
        assert sorted(key(r) for r in RI.scan_table(metrics, table, block).collect()) == want


def test_large_rule_table(spark):
    """100,000 rules: the index finds what brute force finds, and rows leave the tasks unshuffled."""
    rules = spark.range(100_000).select(
        F.col("id").cast("string"), F.lit("n").alias("name"), F.lit("").alias("description"),
        F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(o).alias("operator"), v.cast("string").alias("value"), F.lit(0).cast("long").alias("volume_threshold"), F.lit("all").alias("calculated_during"), F.lit("").alias("timeframe"), F.lit("$").alias("value_type")) for m, o, v in (("a", ">", F.col("id") / 1000), ("b", "<=", F.col("id") % 97))]).alias("conditions"),
        F.lit(0).cast("long").alias("cooldown"), F.lit(True).alias("enabled"), F.lit("").alias("created_at"), F.lit("").alias("updated_at"),
    )
    rng = random.Random(1)
    rows = [(f"s{i}", i, 1.0, "market", rng.random() * 3, float(rng.randint(90, 110))) for i in range(500)]
    metrics = spark.createDataFrame(rows, "symbol string, s long, close double, session string, a double, b double").withColumn("ts", F.timestamp_seconds("s"))
    found = RI.scan_table(metrics, rules)
    want = {(s, str(i)) for s, _, _, _, a, b in rows for i in range(min(100_000, math.ceil(a * 1000))) if a > i / 1000 and b <= i % 97}
    assert {(r.symbol, r.rule_id) for r in found.collect()} == want and want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_faulty_rule_beside_a_good_one_of_its_id(spark):
    good, bad = Q._rule("same", ("close", ">", "0")), Q._rule("same", ("x-y", ">", "0"))
    table = Q._rule_table(spark, [good, bad])
    assert [c["metric"] for r in R.collect_rules(table) for c in r["conditions"]] == ["close"]
    assert RI.required(table) == ["close"] and RI.required(Q._rule_table(spark, [Q._rule("t", ("close", ">", "0", 5, "all"))]))[1:] == [*R.SESSION_VOLUMES, *R.SCALES]


def test_rules_are_evaluated_once(spark):
    metrics = M.with_metrics(Q.user_bars(spark, SF), R.required_metrics(Q.RULES))
    plan = R.scan(metrics, Q.RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("20000") == 1


# As-of and instants ---------------------------------------------------------------------------------------------------


def test_as_of_carries_events_over_stretches(spark):
    bars = spark.createDataFrame([("x", 10), ("x", 95), ("x", 130), ("x", 500), ("y", 5)], "symbol string, s long").withColumn("ts", F.timestamp_seconds("s"))
    events = spark.createDataFrame([("x", 20, "news"), ("x", 95, "news"), ("x", 300, "earnings"), ("z", 1, "news"), (None, 1, "news"), ("x", None, "news")], "symbol string, s long, kind string").withColumn("event_ts", F.timestamp_seconds("s"))
    for seconds in (10, 100, 86400):
        got = {(r.symbol, r.s): (r.minutes_since_news, r.days_until_earnings) for r in M.with_event_metrics(bars, events, seconds=seconds).collect()}
        assert got == {("x", 10): (None, 290 / 86400), ("x", 95): (0.0, 205 / 86400), ("x", 130): (35 / 60, 170 / 86400), ("x", 500): (405 / 60, None), ("y", 5): (None, None)}


def test_nanosecond_instants(spark):
    nanos = [1_704_067_200_000_000_000 + 1000 * random.Random(5).randrange(10**12) + i for i in range(2000)]
    raw = spark.createDataFrame([(f'{{"ev":"T","sym":"X","p":3,"s":{i},"t":{n}}}',) for i, n in enumerate(nanos)], "raw string")
    assert {r["size"]: r.us for r in N.normalize(raw).select("size", F.unix_micros("ts").alias("us")).collect()} == {i: n // 1000 for i, n in enumerate(nanos)}


def test_day_metrics_over_a_ring(spark):
    bars = one_symbol(spark, 500).select("symbol", "ts", F.col("close").alias("open"), F.col("close").alias("high"), (F.col("close") - 1).alias("low"), "close", F.lit(2).cast("long").alias("volume"), "close", F.lit(1).cast("long").alias("trade_count")).toDF("symbol", "ts", "open", "high", "low", "close", "volume", "vwap", "trade_count")
    rows = M.with_metrics(bars, ["volume_daily", "range_today", "premarket_volume"], ring=200).orderBy("ts").collect()
    assert [r.volume_daily for r in rows] == [2 * min(i + 1, 200) for i in range(len(rows))]
    for i in (0, 150, len(rows) - 1):
        last = rows[max(0, i - 199) : i + 1]
        assert math.isclose(rows[i].range_today, max(r.high for r in last) - min(r.low for r in last))


def test_own_frames(spark):
    """Metrics at the timeframe their name tells, from its last whole interval."""
    bars = Q.user_bars(spark, SF)
    names = ["ma_dist_ema9_15m_pct", "ma_dist_ema9_1m_pct", "relative_range_pct", "close"]
    own, plain = ({(r.symbol, r.ts): r for r in M.with_metrics(bars, names, own_frames=o).collect()} for o in (True, False))
    held = {(r.symbol, r.ts): r for r in M.with_metrics(bars, ["ema_9_15m", "atr_14_daily", "range_today"]).collect()}
    assert own.keys() == plain.keys() and [r.close for r in own.values()] == [plain[k].close for k in own]
    for k, r in own.items():
        ema, atr = held[k].ema_9_15m, held[k].atr_14_daily
        assert r.ma_dist_ema9_15m_pct == (None if ema is None else pytest.approx((r.close - ema) / ema * 100))
        assert r.ma_dist_ema9_1m_pct == (None if plain[k].ma_dist_ema9_1m_pct is None else pytest.approx(plain[k].ma_dist_ema9_1m_pct))
        assert r.relative_range_pct == (None if not atr else pytest.approx(held[k].range_today / atr * 100))
    assert any(r.ma_dist_ema9_15m_pct is not None for r in own.values())


def test_lists_of_a_user_and_changes_by_window(spark):
    specs = [("a", "a", "volume", "5m", "desc", "u", True), ("b", "b", "volume", "5m", "desc", "u", False), ("c", "c", "volume", "5m", "desc", "w", True)]
    made = [(*s, *[None] * 7, f"2024-01-0{i + 1} 00:00:00") for i, s in enumerate(specs)]
    table = spark.createDataFrame(made, K.SPEC.replace("created_at timestamp", "created_at string")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert [r.list_id for r in K.for_user(table, "u").collect()] == ["b", "a"] and [r.list_id for r in K.enabled(table).collect()] == ["c", "a"]
    latest = spark.createDataFrame([("x", 1.0, 10, 1.0, 9.0, 5.0), ("y", 1.0, 10, 9.0, 1.0, 6.0)], "symbol string, close double, volume_daily long, price_change_1m_pct double, price_change_5m_pct double, volume_5m double")
    asked = [("five", "n", "volume", "5m", "desc", None, True, None, 5.0), ("one", "n", "volume", "1m", "desc", None, True, None, 5.0)]
    values = K.long_values(latest.withColumn("volume_1m", F.col("volume_5m")), ["volume_5m", "volume_1m"])
    assert {(r.list_id, r.symbol) for r in K.ranked(values, K.spec_table(spark, asked)).collect()} == {("five", "x"), ("one", "y")}
    assert K.filter_columns(asked) == ["price_change_1m_pct", "price_change_5m_pct", "volume_daily"] and K._column_of("relative_volume", "1h") == "relative_volume_60m"


def test_indicator_metadata_and_short_ratio(spark):
    I.register_indicator("twice_close", F.col("close") * 2, "twice the close", "price", {"times": 2})
    rows = {r.name: r for r in I.catalogue(spark).collect()}
    assert (rows["rsi_14"].category, rows["rsi_14"].parameters) == ("momentum", '{"periods": [14]}') and rows["vwap_5m"].parameters == '{"window": "5m"}'
    assert rows["macd_12_26_9"].parameters == '{"periods": [12, 26, 9]}' and rows["bb_20_2.0"].parameters == '{"periods": [20, 2.0]}'
    assert (rows["twice_close"].description, rows["twice_close"].kind) == ("twice the close", "registered")
    table = spark.createDataFrame([("A", 100.0), ("B", 5.0)], "symbol string, shares_short double")
    bars = spark.createDataFrame([("A", 50.0), ("B", 0.0), ("C", 1.0)], "symbol string, avg_volume_20d double")
    assert {r.symbol: r.short_ratio for r in M.with_fundamentals(bars, table).collect()} == {"A": 2.0, "B": None, "C": None}
