"""Streams against batch: bars, metrics from keyed state, rules, lists and sinks, over restarts and rebuilds."""

import math
from pathlib import Path

import pytest
from barloom.operators import alerts as A
from barloom.operators import bars as B
from barloom.operators import metrics as M
from barloom.operators import rules as R
from barloom.operators import toplists as K
from barloom.plans import queries as Q
from barloom.sources import sinks
from barloom.sources import ticks as T
from barloom.streaming import metrics as SM
from barloom.streaming import pipeline as P
from barloom.streaming import scan as SC
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture
def streamed(spark):
    return [n for n in M.catalogue() if not any(x in n for x in ("news", "earnings")) and n not in M.TF.NAMES]


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def split(df, path, *cuts):
    """df as files of one folder, cut by time, the latest written last."""
    for low, high in zip((None, *cuts), (*cuts, None), strict=True):
        part = df.filter(F.lit(True) if low is None else F.col("ts") >= low).filter(F.lit(True) if high is None else F.col("ts") < high)
        part.coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def hours(spark):
    """Hourly bars of five symbols, kept as a table."""
    return Q.hour_bars(spark, SF)


def test_bars_are_drained_whole(spark, tmp_path):
    """With the marker every bar comes out, the last ones too, and each is the batch's."""
    ticks = T.ticks_from_events(spark, SF, "event_type")
    split(ticks, str(tmp_path / "in"), "2024-01-10", "2024-01-20")
    source = T.stream_ticks(spark, str(tmp_path / "in"), files_per_trigger=1)
    go = lambda: P.append(P.stream_bars(source, 3600, "2 hours"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    go()
    batch = {(r.symbol, r.ts): tuple(r) for r in B.ticks_to_bars(ticks, 3600).collect()}
    before = spark.read.parquet(str(tmp_path / "out")).count()
    assert before < len(batch)
    P.drain_marker(spark, ticks.agg(F.max("ts")).first()[0], 7200, 3600).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    rows = spark.read.parquet(str(tmp_path / "out")).select(*B.ticks_to_bars(ticks, 3600).columns).collect()
    assert len(rows) == len(batch) and {(r.symbol, r.ts): tuple(r) for r in rows} == batch


def close_to(a, b):
    return (a is None) == (b is None) and (a is None or a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)))


def test_every_metric_streams(spark, tmp_path, streamed):
    """The whole catalogue over a bar's own frames, bar by bar equal to batch: cold, from history, and after a lost checkpoint."""
    assert len(streamed) > 110
    bars = hours(spark)
    bars.write.parquet(str(tmp_path / "all"))
    bars = spark.read.parquet(str(tmp_path / "all"))
    want = {(r.symbol, r.ts): r for r in M.with_metrics(bars, streamed).collect()}
    split(bars, str(tmp_path / "in"), "2024-01-09 10:00:00", "2024-01-16 15:00:00", "2024-01-16 16:00:00")
    split(bars.filter("ts >= '2024-01-16 15:00:00'"), str(tmp_path / "rest"), "2024-01-22")
    for name, folder, history in (("cold", "in", None), ("rebuilt", "rest", bars.filter("ts < '2024-01-16 15:00:00'"))):
        made = SM.stream_metrics(stream_of(spark, bars.schema, str(tmp_path / folder)), streamed, history)
        P.append(made, str(tmp_path / name), str(tmp_path / f"{name}-ck")).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / name)).collect()
        keys = {k for k in want if history is None or str(k[1]) >= "2024-01-16 15:00:00"}
        assert {(r.symbol, r.ts) for r in rows} == keys and len(rows) == len(keys)
        wrong = {(n, r.symbol, r.ts, r[n], want[r.symbol, r.ts][n]) for r in rows for n in streamed if not close_to(r[n], want[r.symbol, r.ts][n])}
        assert not wrong, sorted(wrong, key=str)[:5]
        assert made.schema["volume_5m"].dataType == M.with_metrics(bars, ["volume_5m"]).schema["volume_5m"].dataType


def test_state_is_what_the_frames_need(spark):
    from barloom.operators.frames import StateFrames

    frames = StateFrames()
    made = M.catalogue(frames)
    made["price_change_5m_pct"](), made["volume_5m"]()
    state = SM.SymbolState(frames.asked)
    rows = SM._inputs(Q.user_bars(spark, SF)).filter("symbol = '1'").toPandas()
    state.feed(rows)
    assert state.ringed == ["close", "volume"] and len(state.at) == min(5, len(rows)) and not state.minutes
    with pytest.raises(ValueError, match="news"):
        SM.stream_metrics(Q.hour_bars(spark, SF), ["minutes_since_news"])
    with pytest.raises(ValueError, match="unknown"):
        SM.stream_metrics(Q.hour_bars(spark, SF), ["nothing"])


def test_late_bars_are_skipped_and_told(spark, tmp_path):
    bars = hours(spark).filter("symbol = 'click'")
    bars.filter("ts >= '2024-01-10'").coalesce(1).write.parquet(str(tmp_path / "in"))
    late = bars.filter("ts < '2024-01-10'")
    for part in (late, bars.orderBy(F.col("ts").desc()).limit(1).withColumn("ts", F.lit("2024-03-01").cast("timestamp"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    P.append(SM.stream_metrics(stream_of(spark, bars.schema, str(tmp_path / "in")), ["volume_5m"], skipped=True), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert rows[0].skipped == 0 and rows[-1].skipped == late.count() > 0 and len(rows) == bars.count() - late.count() + 1


RULE = [Q._rule("high", ("close", ">", "60"), ("volume_5m", ">", "0")), Q._rule("low", ("close", "<=", "30"))]
LATER = Q._rule("later", ("close", ">", "0"))


def test_scan_with_rules_that_change(spark, tmp_path):
    """A rule added mid-stream fires from the next batch on, once; a restart repeats nothing; and so with a lost checkpoint."""
    names = ["close", "volume_5m"]
    bars = hours(spark)
    bars.write.parquet(str(tmp_path / "all"))
    bars = spark.read.parquet(str(tmp_path / "all"))
    cuts = ["2024-01-08", "2024-01-15", "2024-01-22"]
    parts = list(zip((None, *cuts), (*cuts, None), strict=True))
    part = lambda low, high: bars.filter(F.lit(True) if low is None else F.col("ts") >= low).filter(F.lit(True) if high is None else F.col("ts") < high)
    table = [list(RULE)]
    out, source = str(tmp_path / "out"), str(tmp_path / "in")

    def go(checkpoint, run="0", history=None, since=None, fail=None):
        metrics = SM.stream_metrics(stream_of(spark, bars.schema, source), names, since)
        calls = []

        def rules(session):
            calls.append(1)
            if fail == len(calls):
                raise RuntimeError("lost")
            return Q._rule_table(session, table[0])

        SC.scan_stream(metrics, rules, out, str(tmp_path / checkpoint), 7200, run, history).awaitTermination()

    part(*parts[0]).coalesce(1).write.parquet(source)
    go("ck")
    table[0] = [*RULE, LATER]
    part(*parts[1]).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost"):
        go("ck", fail=1)
    go("ck")
    go("ck")  # nothing new: nothing fires
    part(*parts[2]).coalesce(1).write.mode("append").parquet(source)
    go("ck")
    # The checkpoint is lost: what is left of the stream goes on from the tables.
    source = str(tmp_path / "in2")
    part(*parts[3]).coalesce(1).write.parquet(source)
    go("ck2", "1", SC.read_all(spark, out, "alerts"), bars.filter("ts < '2024-01-22'"))
    metrics = M.with_metrics(bars, names)
    found = R.scan(metrics, RULE).unionByName(R.scan(metrics.filter("ts >= '2024-01-08'"), [LATER]))
    want = sorted((r.rule_id, r.symbol, str(r.ts)) for r in A.cooldown(found, 7200).collect())
    got = sorted((r.rule_id, r.symbol, str(r.ts)) for r in SC.read_all(spark, out, "alerts").collect())
    assert got == want and {r[0] for r in want} == {"high", "low", "later"}


def test_rank_feed_replayed_gives_the_page(spark, tmp_path):
    specs = K.system_specs()
    columns = [c for c in K.columns_of(specs) if not c.startswith("vwap_dist_signed") and c != "rsi_14"]
    specs = [s for s in specs if K._column_of(s[2], s[3]) in columns]
    names = list(dict.fromkeys([*columns, "volume_daily", "price_change_1m_pct"]))
    bars = Q.user_bars(spark, SF)
    bars.write.parquet(str(tmp_path / "all"))
    bars = spark.read.parquet(str(tmp_path / "all"))
    split(bars, str(tmp_path / "in"), "2024-01-08", "2024-01-15", "2024-01-15 00:30:00", "2024-01-24")
    metrics = SM.stream_metrics(stream_of(spark, bars.schema, str(tmp_path / "in")), names)
    SC.rank_stream(metrics, lambda s: K.spec_table(s, specs), columns, str(tmp_path / "out"), str(tmp_path / "ck"), 5).awaitTermination()
    latest = B.latest_bars(M.with_metrics(bars, names), 1)
    want = {(r.list_id, r.symbol, r.rank) for r in K.ranked(K.long_values(latest, columns), K.spec_table(spark, specs), 5).collect()}
    changes = SC.read_all(spark, str(tmp_path / "out"), "changes")
    assert {(r.list_id, r.symbol, r.rank) for r in SC.page_of(changes).collect()} == want and want
    assert changes.filter("kind = 'left'").count() > 0 and changes.filter("old_rank = new_rank").count() == 0


def test_merge_of_touched_parts(spark, tmp_path):
    """A late tick changes one bar; other parts keep their files; the same bars again change nothing."""
    path, ticks = str(tmp_path / "bars"), T.ticks_from_events(spark, SF, "event_type")
    bars = B.ticks_to_bars(ticks, 3600)
    sinks.merge_bars(bars, path)
    files = lambda: {str(f.relative_to(path)) for f in Path(path).rglob("*.parquet")}
    rows = lambda: {(r.symbol, r.ts): (r.close, r.volume, r.trade_count) for r in spark.read.parquet(path).collect()}
    first, held = files(), rows()
    assert held == {(r.symbol, r.ts): (r.close, r.volume, r.trade_count) for r in bars.collect()}
    assert max(len(list(d.glob("bucket=*"))) for d in Path(path).glob("date=*")) > 1
    one = bars.orderBy("symbol", "ts").limit(1)
    late = one.withColumns({"close": F.lit(9.5), "volume": F.col("volume") + 5, "trade_count": F.col("trade_count") + 1})
    for _ in range(2):
        sinks.merge_bars(one.unionByName(late), path)
        key = one.first().symbol, one.first().ts
        assert rows() == held | {key: (9.5, held[key][1] + 5, held[key][2] + 1)}
        assert len(first - files()) == len({f for f in first if f.rsplit("/", 1)[0] in {g.rsplit("/", 1)[0] for g in first - files()}}) and len(files()) == len(first)
    # As a stream's sink in update mode, each bar being written whenever it changes.
    split(ticks, str(tmp_path / "in"), "2024-01-10")
    source = T.stream_ticks(spark, str(tmp_path / "in"), files_per_trigger=1)
    live = str(tmp_path / "live")
    P.each_batch(P.stream_bars(source, 3600, "40 days"), lambda df, _: sinks.merge_bars(df, live), str(tmp_path / "ck"), mode="update").awaitTermination()
    assert {(r.symbol, r.ts): (r.close, r.volume, r.trade_count) for r in spark.read.parquet(live).collect()} == held


def test_snapshot_equals_panel(spark, streamed):
    """Day values, references to earlier days and recursive indicators are the panel's, for a symbol of over 200 bars a day."""
    ticks = T.ticks_from_events(spark, "/root/testdata/sf0.01").filter("ts >= '2024-01-20'").withColumn("symbol", F.lit("all"))
    bars = B.ticks_to_bars(ticks)
    assert bars.groupBy(F.to_date("ts")).count().agg(F.max("count")).first()[0] > 200
    at = bars.filter("ts < '2024-01-24 22:00:00'").agg(F.max("ts")).first()[0]
    names = [n for n in streamed if n not in bars.columns]
    panel = M.with_metrics(bars, names).filter(F.col("ts") == F.lit(at)).first()
    snap = M.snapshot(ticks.filter(F.col("ts") < F.lit(at) + F.expr("interval 1 minute")), at.replace(second=59, microsecond=999999), names).first()
    assert not [(n, snap[n], panel[n]) for n in names if not close_to(snap[n], panel[n])]


def test_alert_streams_and_latest_values(spark, tmp_path):
    """Two sinks of one alert stream; and the table of newest values, with its time to live."""
    alerts = spark.createDataFrame([(f"i{i}", "r", "n", f"s{i % 3}", 1_700_000_000_000 + 250 * i, 1.0) for i in range(12)] + [("", "r", "n", "s0", 1_700_000_100_000, 1.0)], "id string, rule_id string, rule_name string, symbol string, ms long, price double")
    alerts = alerts.withColumn("ts", F.timestamp_millis("ms"))
    split(alerts, str(tmp_path / "in"), "2023-11-14 22:13:21")
    source = stream_of(spark, alerts.schema, str(tmp_path / "in"))
    users = spark.createDataFrame([("u", "r", ["s0", "s1"])], "user_id string, rule_id string, symbols array<string>")
    for q in SC.alert_streams(source, str(tmp_path / "out"), str(tmp_path / "ck"), users):
        q.awaitTermination()
    raw, kept = (sorted(r.id for r in spark.read.parquet(str(tmp_path / "out" / n)).collect()) for n in ("alerts", "alerts.filtered"))
    want = A.user_filter(A.dedup(A.valid_alerts(alerts)), users)
    assert raw == sorted(f"i{i}" for i in range(12)) and len(kept) == want.count() and 0 < len(kept) < 8
    SC.latest_stream(source.select("symbol", "ts", "price", "id"), str(tmp_path / "latest"), str(tmp_path / "ck3")).awaitTermination()
    newest = {r.symbol: r.ts for r in alerts.groupBy("symbol").agg(F.max("ts").alias("ts")).collect()}
    assert {r.symbol: r.ts for r in SC.read_latest(spark, str(tmp_path / "latest"), "2023-11-14 22:15:00").collect()} == newest
    assert {r.symbol for r in SC.read_latest(spark, str(tmp_path / "latest"), "2023-11-14 22:23:25").collect()} == {"s0"}
    assert len(list((tmp_path / "latest" / "latest" / "run=0").iterdir())) == 2
