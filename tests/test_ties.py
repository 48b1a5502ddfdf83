"""Results that don't depend on the order in which rows come."""

from barloom.operators import patterns as P


def test_running_60s_takes_the_earliest_tick_of_a_second(spark):
    rows = [("a", "2024-01-02 15:00:00.5", 2, 20.0), ("a", "2024-01-02 15:00:00.5", 1, 10.0), ("a", "2024-01-02 15:00:00.7", 0, 5.0), ("a", "2024-01-02 15:01:00", 3, 30.0), ("a", "2024-01-02 15:02:01", 4, 7.0)]
    for order in (rows, rows[::-1]):
        ticks = spark.createDataFrame(order, "symbol string, ts string, seq bigint, price double").selectExpr("symbol", "cast(ts as timestamp) as ts", "seq", "price").coalesce(1)
        assert {r.seq: r.running_60s for r in P.running_60s(ticks).collect()} == {0: -5.0, 1: 0.0, 2: 10.0, 3: 20.0, 4: 0.0}
