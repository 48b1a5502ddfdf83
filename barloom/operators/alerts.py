"""Alerts: construction, cooldown, de-duplication, subscriptions, history."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.cooldown import cooldown, cooldown_parallel  # noqa: F401
from barloom.sources.sinks import insert_ignore


def make_alerts(matches: DataFrame, metadata: Column | None = None) -> DataFrame:
    """Alerts of matches, with deterministic ids; metadata, unless given, is the values that matched."""
    key = F.concat_ws("|", "rule_id", "symbol", F.unix_micros("ts").cast("string"))
    none = F.col("metadata") if "metadata" in matches.columns else F.lit(None).cast("map<string,double>")
    return matches.select(
        F.sha2(key, 256).alias("id"), "rule_id", "rule_name", "symbol", "ts", F.col("price").cast("decimal(20,8)").alias("price"),
        F.concat(F.lit("Rule '"), F.col("rule_name"), F.lit("' matched for "), F.col("symbol")).alias("message"), (none if metadata is None else metadata).alias("metadata"), F.sha2(key, 224).alias("trace_id"),
    )


def fill_in(alerts: DataFrame, now) -> DataFrame:
    """Missing ids, timestamps and trace ids filled."""
    stamp = F.coalesce("ts", F.lit(now).cast("timestamp"))
    key = F.sha2(F.concat_ws("|", "rule_id", "symbol", F.unix_micros(stamp).cast("string")), 256)
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    return alerts.withColumns({"ts": stamp, "id": F.coalesce(given("id"), key), "trace_id": F.coalesce(given("trace_id"), key)})


def valid_alerts(alerts: DataFrame) -> DataFrame:
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return alerts.filter(given("id") & given("rule_id") & given("symbol") & F.col("ts").isNotNull())


def dedup(alerts: DataFrame) -> DataFrame:
    """The first per rule, symbol and second."""
    w = Window.partitionBy("rule_id", "symbol", F.unix_seconds("ts")).orderBy("ts", "id")
    return alerts.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _everyone(subscriptions: DataFrame, block: int) -> Iterator[list]:
    """The users who list nothing, in blocks of about `block` users, each collected by itself."""
    users = subscriptions.filter(F.size("symbols") == 0).select("user_id").distinct()
    parts = math.ceil(users.count() / block)
    for part in range(parts):
        yield [r.user_id for r in users.filter(F.pmod(F.xxhash64("user_id"), F.lit(parts)) == part).collect()]


def subscribed(alerts: DataFrame, subscriptions: DataFrame, block: int = 10_000) -> DataFrame:
    """alerts with the user_id of each subscriber(user_id, symbols) that lists their symbol or has an empty list.

    Users with an empty list are sent everything, so the result has a row for each alert and such user; they are exploded
    where the alert is, a block of users after the other, without a shuffle. A null list subscribes to nothing."""
    listed = subscriptions.select("user_id", F.explode("symbols").alias("symbol")).distinct()
    out = alerts.join(listed, "symbol").select(*alerts.columns, "user_id")
    kind = f"array<{subscriptions.schema['user_id'].dataType.simpleString()}>"
    for users in _everyone(subscriptions, block):
        if users:
            out = out.unionByName(alerts.withColumn("user_id", F.explode(F.array(*map(F.lit, users)).cast(kind))))
    return out


def user_filter(alerts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Alerts that some user follows: by rule where rule_id is given, and by symbol where symbols are listed."""
    one = subscriptions.select(F.col("rule_id").alias("_r"), F.explode_outer("symbols").alias("_s")).distinct()
    rule, symbol = F.col("_r").isNotNull(), F.col("_s").isNotNull()
    if one.filter(~rule & ~symbol).limit(1).count():
        return alerts  # somebody follows everything
    out = alerts
    for mark, rows, keys in (("_by1", one.filter(rule & ~symbol), {"rule_id": "_r"}), ("_by2", one.filter(rule & symbol), {"rule_id": "_r", "symbol": "_s"}), ("_by3", one.filter(~rule & symbol), {"symbol": "_s"})):
        out = out.join(rows.select(*[F.col(k).alias(c) for c, k in keys.items()], F.lit(True).alias(mark)), list(keys), "left")
    return out.filter("_by1 or _by2 or _by3").select(*alerts.columns)


def deliver(alerts: DataFrame, history: DataFrame, subscriptions: DataFrame | None = None) -> DataFrame:
    """De-duplicated, filtered and not yet in the history: the rows to append and route."""
    out = dedup(valid_alerts(alerts))
    if subscriptions is not None:
        out = user_filter(out, subscriptions)
    return insert_ignore(history, out, ["id", "ts"])


def history(alerts: DataFrame, symbol=None, rule_id=None, start=None, end=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of alerts, newest first."""
    for col, value in (("symbol", symbol), ("rule_id", rule_id)):
        if value is not None:
            alerts = alerts.filter(F.col(col) == value)
    if start is not None:
        alerts = alerts.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        alerts = alerts.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return alerts.orderBy(F.col("ts").desc(), "id").offset(offset).limit(limit)


def by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.filter(F.col("id") == alert_id)
