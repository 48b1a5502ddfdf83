"""Rules: JSON ingest, validation, prefilters and evaluation over metric columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

CONDITION = "struct<metric: string, operator: string, value: string, volume_threshold: bigint, calculated_during: string, timeframe: string, value_type: string>"
RULE = f"struct<id: string, name: string, description: string, conditions: array<{CONDITION}>, cooldown: bigint, enabled: boolean, created_at: string, updated_at: string>"
OPERATORS, SESSIONS = (">", "<", ">=", "<=", "==", "!="), ("", "all", "premarket", "market", "postmarket")
EQUAL = 1e-4
# How a window's volume is scaled to a day's, when no session volume reaches a threshold.
SCALES = {"volume_60m": 6.5, "volume_15m": 26, "volume_5m": 78, "volume_1m": 390, "volume_live": 390}
SESSION_VOLUMES = ("volume_daily", "premarket_volume", "postmarket_volume")


def parse_rules(texts: DataFrame, col: str = "json", now: str | None = None) -> DataFrame:
    """Rules of JSON texts, each an object or an array; default timestamps; conditions enriched."""
    text = F.trim(F.col(col))
    many = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    rules = texts.select(F.explode(F.from_json(many, f"array<{RULE}>")).alias("r")).select("r.*")
    stamp = F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rules = rules.withColumns({c: F.coalesce(F.col(c), stamp) for c in ("created_at", "updated_at")}).withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    return rules.withColumn("conditions", enrich(F.col("conditions")))


def timeframe(metric: Column) -> Column:
    found = F.regexp_extract(metric, r"_(\d+[mhd])(_(pct|percent))?$", 1)
    known = F.when(F.contains(metric, F.lit("_daily")), "daily").when(F.contains(metric, F.lit("_today")), "today").when(F.contains(metric, F.lit("_1y")), "1y").otherwise("")
    return F.when(found != "", found).otherwise(known)


def value_type(metric: Column) -> Column:
    return F.when(F.rlike(metric, F.lit("_(pct|percent)")), "%").otherwise("$")


def base_name(metric: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(metric, r"_(pct|percent)$", ""), r"_(\d+[mhd]|daily|today|1y)$", "")


def enrich(conditions: Column) -> Column:
    """Defaults of each condition: timeframe and value type from the name, session all, threshold 0."""
    either = lambda a, b: F.when(F.coalesce(a, F.lit("")) == "", b).otherwise(a)
    return F.transform(conditions, lambda c: F.struct(
        c["metric"].alias("metric"), c["operator"].alias("operator"), c["value"].alias("value"), F.coalesce(c["volume_threshold"], F.lit(0)).alias("volume_threshold"),
        either(c["calculated_during"], F.lit("all")).alias("calculated_during"), either(c["timeframe"], timeframe(c["metric"])).alias("timeframe"), either(c["value_type"], value_type(c["metric"])).alias("value_type"),
    ))


def _condition_fault(c: Column) -> Column:
    number = c["value"].try_cast("double")
    return (
        F.when(~F.rlike(F.coalesce(c["metric"], F.lit("")), F.lit("^[A-Za-z0-9_]+$")), "bad metric name")
        .when(~F.coalesce(c["operator"].isin(*OPERATORS), F.lit(False)), "bad operator")
        .when(c["value"].isNull(), "no value").when(number.isNull() & ~c["operator"].isin("==", "!="), "value not numeric")
        .when(~c["calculated_during"].isin(*SESSIONS), "bad session").when(~c["value_type"].isin("$", "%"), "bad value type").when(c["volume_threshold"] < 0, "negative threshold")
    )


def rule_fault() -> Column:
    """The first fault of a rule, or null."""
    faults = F.filter(F.transform("conditions", _condition_fault), lambda x: x.isNotNull())
    return (
        F.when(F.coalesce("id", F.lit("")) == "", "no id").when(F.coalesce("name", F.lit("")) == "", "no name").when(F.coalesce(F.size("conditions"), F.lit(0)) < 1, "no conditions")
        .when(F.coalesce("cooldown", F.lit(0)) < 0, "negative cooldown").otherwise(F.get(faults, F.lit(0)))
    )


def report(rules: DataFrame) -> DataFrame:
    """(rule_id, valid, error) of each rule."""
    return rules.select(F.col("id").alias("rule_id"), rule_fault().alias("error")).select("rule_id", F.col("error").isNull().alias("valid"), "error")


def valid_rules(rules: DataFrame) -> DataFrame:
    """The rules without a fault, each row judged for itself, whatever others share its id."""
    return rules.filter(rule_fault().isNull())


def collect_rules(rules: DataFrame, most: int = 5000) -> list[dict]:
    """The enabled valid rules as dicts; refuses a table beyond `most`: `rule_index.scan_table` finds the same matches for it."""
    found = [r.asDict(recursive=True) for r in valid_rules(rules.filter("enabled")).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} rules: use rule_index.scan_table")
    return found


def required_metrics(rules: list[dict]) -> list[str]:
    """Metrics that the rules read, with all volumes that a threshold may consult."""
    conditions = [c for r in rules if r.get("enabled", True) for c in r["conditions"]]
    extra = [*SESSION_VOLUMES, *SCALES] if any((c.get("volume_threshold") or 0) > 0 for c in conditions) else []
    return list(dict.fromkeys([c["metric"] for c in conditions] + extra))


def compare(value: Column, operator: str, other: Column) -> Column:
    near = F.abs(value - other) < EQUAL
    made = {">": value > other, "<": value < other, ">=": value >= other, "<=": value <= other, "==": near, "!=": ~near}[operator]
    return F.coalesce(made, F.lit(False))


def _number(text) -> Column | None:  # noqa: ANN001
    try:
        return F.lit(float(text))
    except (TypeError, ValueError):
        return None


def condition_column(c: dict) -> Column:
    other = _number(c["value"])
    return F.lit(False) if other is None else compare(F.col(c["metric"]).cast("double"), c["operator"], other)


def reach(columns: list[str]) -> Column:
    """The highest volume that a threshold may consult, of the volumes among the columns; null if there is none."""
    held = set(columns)
    volumes = [F.col(v).cast("long") for v in SESSION_VOLUMES if v in held] + [(F.col(v) * scale).cast("long") for v, scale in SCALES.items() if v in held]
    return F.greatest(*volumes) if len(volumes) > 1 else volumes[0] if volumes else F.lit(None).cast("long")


def threshold_column(threshold: int | None, reached: Column | None = None) -> Column:
    """True if a session's volume reaches the threshold, or a window's does when scaled to a day; reached: `reach`."""
    if not threshold or threshold <= 0:
        return F.lit(True)
    return F.coalesce((reach([*SESSION_VOLUMES, *SCALES]) if reached is None else reached) >= threshold, F.lit(False))


def session_column(during: str | None) -> Column:
    return F.lit(True) if during not in ("premarket", "market", "postmarket") else F.coalesce(F.col("session") == during, F.lit(False))


def rule_column(rule: dict, reached: Column | None = None) -> Column:
    """Prefilters first, then the conjunction of the conditions."""
    sessions = {c.get("calculated_during") for c in rule["conditions"]}
    most = max((c.get("volume_threshold") or 0 for c in rule["conditions"]), default=0)
    parts = [*map(session_column, sorted(sessions, key=str)), threshold_column(most, reached), *map(condition_column, rule["conditions"])]
    return reduce(lambda a, b: a & b, parts)


def scan(metrics: DataFrame, rules: list[dict], observed: Observation | None = None) -> DataFrame:
    """Matches (symbol, ts, price, rule_id, rule_name, metadata) of every row against every enabled rule; non-matches are
    never exploded. metadata holds the values of the rule's metrics. `observed` gets the counters rows, rules_evaluated
    and rules_matched when the result is computed.

    A row's hits are the numbers of its rules, one generator's row, so that the filter which the optimizer infers for the
    second generator reads them instead of evaluating all rules again.
    """
    rules = [r for r in rules if r.get("enabled", True)]
    if not rules:
        return metrics.select("symbol", "ts", F.col("close").alias("price"), F.lit("").alias("rule_id"), F.lit("").alias("rule_name"), F.create_map().cast("map<string,double>").alias("metadata")).filter(F.lit(False))
    names = list(dict.fromkeys(c["metric"] for r in rules for c in r["conditions"]))
    thresholds = any((c.get("volume_threshold") or 0) > 0 for r in rules for c in r["conditions"])
    rows = metrics.withColumn("_reach", reach(metrics.columns)) if thresholds else metrics
    tried = F.array_compact(F.array(*[F.when(rule_column(r, F.col("_reach")), F.lit(i)) for i, r in enumerate(rules)]))
    values = [F.col(n).cast("double").alias(f"_m{i}") for i, n in enumerate(names)]
    rows = rows.select("symbol", "ts", F.col("close").alias("price"), *values, F.explode(F.array(tried)).alias("_hits"))
    if observed is not None:
        rows = rows.observe(observed, F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) * len(rules)).alias("rules_evaluated"), F.sum(F.size("_hits")).alias("rules_matched"))
    hits = rows.select("*", F.explode("_hits").alias("_rule"))
    of = lambda made: F.get(F.array(*map(made, rules)), F.col("_rule"))
    shown = of(lambda r: F.array(*[F.lit(c["metric"]) for c in r["conditions"]]))
    held = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.col(f"_m{i}"))])
    return hits.select("symbol", "ts", "price", of(lambda r: F.lit(r["id"])).alias("rule_id"), of(lambda r: F.lit(r["name"])).alias("rule_name"), F.map_filter(held, lambda k, _: F.array_contains(shown, k)).alias("metadata"))


def counters(metrics: DataFrame, rules: list[dict]) -> DataFrame:
    """One row: symbols and rows scanned, rules evaluated, rules matched."""
    rules = [r for r in rules if r.get("enabled", True)]
    hits = sum((F.when(rule_column(r), 1).otherwise(0) for r in rules), F.lit(0))
    n = F.count(F.lit(1))
    return metrics.agg(F.countDistinct("symbol").alias("symbols"), n.alias("rows"), (n * len(rules)).alias("rules_evaluated"), F.coalesce(F.sum(hits), F.lit(0)).cast("long").alias("rules_matched"))
