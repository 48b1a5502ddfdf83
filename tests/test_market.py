"""The market engine: every query against its SQL, streaming against batch, and examples by hand."""

import math
import os
import time

import duckdb
import pytest
from barloom.functions import sessions as S
from barloom.operators import alerts as A
from barloom.operators import bars as B
from barloom.operators import metrics as M
from barloom.operators import rule_index as RI
from barloom.operators import rules as R
from barloom.operators import toplists as K
from barloom.plans import queries as Q
from barloom.sources import normalize as N
from barloom.sources import ticks as T
from barloom.streaming import pipeline as stream
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(None if v is None or isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cur = duck.execute(Q.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.select(*names).collect()) == plain(cur.fetchall())


def test_every_query_has_sql():
    assert not set(Q.QUERIES) - set(Q.ORACLES)


def test_bar_example(spark):
    rows = [("A", f"2024-01-02 15:30:{s:02d}", i, p, v) for i, (s, p, v) in enumerate([(1, 150.0, 100), (20, 151.0, 200), (59, 149.0, 300)])] + [("A", "2024-01-02 15:31:00", 9, 1.0, 0), ("", "2024-01-02 15:31:00", 9, 1.0, 1), ("A", None, 9, 1.0, 1), ("A", "2024-01-02 15:31:00", 9, 0.0, 1)]
    ticks = spark.createDataFrame(rows, "symbol string, t string, seq long, price double, size long").withColumn("ts", F.col("t").cast("timestamp"))
    bars = B.ticks_to_bars(ticks).orderBy("ts").collect()
    assert [(b.open, b.high, b.low, b.close, b.volume, round(b.vwap, 4), b.trade_count) for b in bars] == [(150, 151, 149, 149, 600, 149.8333, 3), (1, 1, 1, 1, 0, 0, 1)]
    assert T.split_valid(ticks)[1].count() == 3


def test_sessions(spark):
    cases = [("2024-01-15 09:00", "premarket"), ("2024-01-15 14:29", "premarket"), ("2024-01-15 14:30", "market"), ("2024-01-15 20:59", "market"), ("2024-01-15 21:00", "postmarket"), ("2024-01-16 00:59", "postmarket"), ("2024-01-16 01:00", "closed"), ("2024-01-13 15:00", "closed"), ("2024-07-15 13:30", "market"), ("2024-07-15 13:29", "premarket")]
    df = spark.createDataFrame(cases, "t string, want string").withColumn("ts", F.col("t").cast("timestamp"))
    for r in df.select("want", S.market_session(F.col("ts")).alias("got"), S.market_open(F.col("ts")).cast("string").alias("open"), "t").collect():
        assert r.got == r.want
        assert r.open.endswith("13:30:00" if "-07-" in r.t else "14:30:00")


def test_rules(spark):
    texts = ['{"id":"a","name":"n","conditions":[{"metric":"price_change_5m_pct","operator":">","value":5}]}', '[{"id":"b","name":"n","conditions":[]},{"id":"c","name":"n","conditions":[{"metric":"x-y","operator":">","value":1}]},{"id":"d","name":"n","conditions":[{"metric":"x","operator":"~","value":1}]},{"id":"e","name":"n","conditions":[{"metric":"x","operator":">","value":"q"}]}]']
    rules = R.parse_rules(spark.createDataFrame([(t,) for t in texts], "json string"))
    told = {r.rule_id: r.error for r in R.report(rules).collect()}
    assert told == {"a": None, "b": "no conditions", "c": "bad metric name", "d": "bad operator", "e": "value not numeric"}
    first = R.collect_rules(rules)[0]["conditions"][0]
    assert (first["timeframe"], first["value_type"], first["calculated_during"], first["volume_threshold"]) == ("5m", "%", "all", 0)
    assert spark.range(1).select(R.base_name(F.lit("change_5m_pct"))).first()[0] == "change"
    values = spark.createDataFrame([(1.0, 1.00005), (1.0, 1.01), (None, 1.0)], "a double, b double")
    assert [r[0] for r in values.select(R.compare(F.col("a"), "==", F.col("b"))).collect()] == [True, False, False]


def test_cooldown_and_history(spark):
    rows = [("r", "n", "A", f"2024-01-01 00:00:{s:02d}", 1.0) for s in (0, 5, 10, 14, 20, 31)]
    found = spark.createDataFrame(rows, "rule_id string, rule_name string, symbol string, t string, price double").withColumn("ts", F.col("t").cast("timestamp"))
    kept = A.cooldown(found, 10)
    assert sorted(r.t[-2:] for r in kept.collect()) == ["00", "10", "20", "31"]
    alerts = A.make_alerts(kept)
    assert A.deliver(alerts.union(alerts), alerts.limit(0)).count() == 4 and A.deliver(alerts, alerts).count() == 0
    assert [r.ts.second for r in A.history(alerts, symbol="A", limit=2, offset=1).collect()] == [20, 10]


def test_registered_metric_and_lists(spark):
    bars = Q.hour_bars(spark, SF)
    M.register_metric("double_range", F.col("range_2m") * 2, ["range_2m"])
    row = M.with_metrics(bars, ["double_range"]).filter("range_2m is not null").first()
    assert row.double_range == row.range_2m * 2
    with pytest.raises(ValueError):
        M.with_metrics(bars, ["nothing"])
    assert K.validate(K.spec_table(spark)).filter("not valid").count() == 0 and K.routed(K.spec_table(spark)).count() == 20
    ticks = T.ticks_from_events(spark, SF)
    snap = M.snapshot(ticks, "2024-01-20 12:00:30", ["price_change_1m_pct", "volume_daily"])
    assert snap.count() == snap.select("symbol").distinct().count() > 0


def test_every_metric_builds(spark):
    names = [n for n in M.catalogue() if "news" not in n and "earnings" not in n]
    assert len(names) > 105
    assert M.with_metrics(Q.hour_bars(spark, SF), names).count() > 0


def test_normalize_shapes(spark):
    raw = ['{"T":"q","S":"abc","ap":"2.5","t":"2024-01-02T00:00:01Z"}', '{"ev":"T","sym":"X","p":3,"s":7,"t":1704067200000000000}', '{"ticker":"Y","last":4,"volume":2,"time":"2024-01-02T00:00:01Z"}', "nonsense", '{"symbol":"Z","price":-1,"size":1,"timestamp":"2024-01-02T00:00:01Z"}', '{"symbol":"Z","price":1,"size":1,"timestamp":"soon"}']
    rows = N.normalize(spark.createDataFrame([(t,) for t in raw], "raw string")).collect()
    assert [(r.symbol, r.price, r.size, r.type, r.reason) for r in rows[:3]] == [("ABC", 2.5, 0, "quote", None), ("X", 3.0, 7, "trade", None), ("Y", 4.0, 2, "trade", None)]
    assert [r.reason for r in rows[3:]] == ["not JSON", "price not positive", "no timestamp"]


def test_messages_are_parsed_once(spark):
    good, _ = N.split_normalized(Q.raw_messages(spark, SF))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_rule_sets(spark):
    metrics = M.with_metrics(Q.user_bars(spark, SF), R.required_metrics(Q.RULES))
    off = Q._rule("off", ("close", ">", "0"), enabled=False)
    assert R.scan(metrics, []).count() == 0 and R.scan(metrics, [off]).count() == 0
    table = Q._rule_table(spark, [off])
    assert RI.scan_table(metrics, table).count() == 0
    never = Q._rule("never", ("close", ">", "0", 10**12, "premarket"))
    assert R.scan(metrics, [never]).count() == RI.scan_table(metrics, Q._rule_table(spark, [never])).count() == 0
    from pyspark.sql import Observation

    seen = Observation()
    n = R.scan(metrics, Q.RULES, seen).count()
    assert seen.get["rules_matched"] == n and seen.get["rules_evaluated"] == seen.get["rows"] * len(Q.RULES)


def test_both_scans_agree_on_metadata(spark):
    metrics = M.with_metrics(Q.user_bars(spark, SF), R.required_metrics(Q.RULES)).cache()
    told = [{(r.symbol, r.ts, r.rule_id): (r.price, r.metadata) for r in df.collect()} for df in (R.scan(metrics, Q.RULES), RI.scan_table(metrics, Q._rule_table(spark, Q.RULES)))]
    assert told[0] == told[1] and all(m for _, m in told[0].values())


def test_users_who_follow(spark):
    alerts = spark.createDataFrame([("1", "r", "A"), ("2", "r", "B"), ("3", "q", "A")], "id string, rule_id string, symbol string")
    follow = lambda *rows: sorted(r.id for r in A.user_filter(alerts, spark.createDataFrame(list(rows), "rule_id string, symbols array<string>")).collect())
    assert follow((None, ["A"])) == ["1", "3"] and follow(("r", [])) == ["1", "2"] and follow(("r", ["A"]), ("q", ["B"])) == ["1"] and follow((None, [])) == ["1", "2", "3"]
    users = spark.createDataFrame([("u", ["A"]), ("all", []), ("every", [])], "user_id string, symbols array<string>")
    sent = lambda block: sorted((r.id, r.user_id) for r in A.subscribed(alerts, users, block).collect())
    assert sent(10_000) == sent(1) and len(sent(1)) == 2 + 2 * 3


def test_custom_metrics_in_order(spark):
    M.register_metric("chain_b", F.col("chain_a") + 1, ["chain_a"])
    M.register_metric("chain_a", F.col("range_2m") * 3, ["range_2m"])
    row = M.with_metrics(Q.hour_bars(spark, SF), ["chain_b"]).filter("range_2m is not null").first()
    assert row.chain_b == row.range_2m * 3 + 1
    M.register_metric("loop_a", F.col("loop_b"), ["loop_b"])
    M.register_metric("loop_b", F.col("loop_a"), ["loop_a"])
    with pytest.raises(ValueError, match="depend on each other"):
        M.with_metrics(Q.hour_bars(spark, SF), ["loop_a"])


def test_volume_falls_back_to_the_live_one(spark):
    last = spark.createDataFrame([("A", 1.0, 5, None, None, 7), ("B", 1.0, 5, None, 3, 8)], "symbol string, close double, volume_daily long, price_change_1m_pct double, volume_1m long, volume_live long")
    assert {r.symbol: r.value for r in K.long_values(last, ["volume_1m"]).collect()} == {"A": 7.0, "B": 3.0}


def test_recursive_fold_is_the_same_in_pieces():
    import numpy as np
    from barloom.operators import indicators as I

    close = np.random.default_rng(1).normal(100, 5, 300)
    names = ["ema_9", "mma_14", "rsi_14", "macd_12_26_9", "macd_signal", "macd_hist"]
    whole, fold, parts, at = I._Fold(names).feed(close), I._Fold(names), [], 0
    for n in (1, 3, 5, 20, 1, 70, 200):
        parts.append(fold.feed(close[at : at + n]))
        at += n
    for name in names:
        assert np.allclose(np.concatenate([p[name] for p in parts]), whole[name], equal_nan=True)


def test_queries_without_the_text_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "barloom", tmp_path / "barloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert told.stdout.split() == [str(len(Q.QUERIES)), str(len(Q.ORACLES))], told.stderr


def in_three_files(df, folder):
    """df written as three files, the earlier rows in the older ones."""
    cuts = [None, "2024-01-10", "2024-01-20", None]
    for low, high in zip(cuts, cuts[1:]):
        part = df.filter(F.lit(True) if low is None else F.col("ts") >= low).filter(F.lit(True) if high is None else F.col("ts") < high)
        part.coalesce(1).write.mode("append").parquet(folder)


def test_stream_indicators_go_on_from_history(spark, tmp_path):
    from barloom.operators import indicators as I

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    names = ["ema_9", "mma_14", "rsi_14", "macd_signal"]
    bars = Q.hour_bars(spark, SF).select("symbol", "ts", "close")
    want = {(r.symbol, r.ts): r for r in I.with_recursive(bars, names).collect()}
    bars.write.parquet(str(tmp_path / "all"))
    in_three_files(spark.read.parquet(str(tmp_path / "all")), str(tmp_path / "bars"))
    source = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "bars"))
    for name, history in (("cold", None), ("seeded", bars.filter("ts < '2024-01-15'")), ("none", bars.limit(0))):
        stream.append(stream.stream_indicators(source, names, history), str(tmp_path / name), str(tmp_path / f"{name}-ck")).awaitTermination()
        got = spark.read.parquet(str(tmp_path / name)).collect()
        ends = {}
        if name == "seeded":
            for s, ts in want:
                if str(ts) < "2024-01-15":
                    ends[s] = max(ends.get(s, ts), ts)
        assert {(r.symbol, r.ts) for r in got} == {k for k in want if k[0] not in ends or k[1] > ends[k[0]]} and len(got) > 100
        for r in got:
            for n in names:
                a, b = r[n], want[r.symbol, r.ts][n]
                assert (a is None or math.isnan(a)) == (b is None) and (b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_stream_cooldown_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = Q.hour_bars(spark, SF).select(F.lit("r").alias("rule_id"), "symbol", "ts", "close")
    found.write.parquet(str(tmp_path / "all"))
    in_three_files(spark.read.parquet(str(tmp_path / "all")), str(tmp_path / "in"))
    source = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, ttl in (("kept", None), ("ttl", 100_000)):
        query = stream.append(stream.stream_cooldown(source, 7200, ttl), str(tmp_path / name), str(tmp_path / f"{name}-ck"), drain=ttl is None)
        if ttl is None:
            query.awaitTermination()
        else:
            ends = time.time() + 90
            while time.time() < ends and not (tmp_path / f"{name}-ck" / "commits" / "3").exists():
                time.sleep(0.2)
            query.stop()
        assert {(r.symbol, r.ts) for r in spark.read.parquet(str(tmp_path / name)).collect()} == {(r.symbol, r.ts) for r in A.cooldown(found, 7200).collect()}
    with pytest.raises(ValueError, match="as long as"):
        stream.stream_cooldown(source, 7200, 60)


def test_late_ticks_are_counted(spark, tmp_path):
    ticks = T.ticks_from_events(spark, SF, "event_type")
    late = 0
    for part in (ticks.filter("ts >= '2024-01-20'"), ticks.filter("ts < '2024-01-02'")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream.append(stream.stream_bars(T.stream_ticks(spark, str(tmp_path / "in")), 3600, "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck"))
        query.awaitTermination()
        late += stream.late_rows(query)
    assert late == B.ticks_to_bars(ticks.filter("ts < '2024-01-02'"), 3600).count() > 0
