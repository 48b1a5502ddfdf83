"""Rule tables of any size against metrics: a predicate index instead of a join.

Conditions are kept sorted by metric and threshold. In a batch of rows each metric's values are sorted once; then each
condition is met by a stretch of that order, whose ends a binary search finds for all conditions of the metric at once. A
rule is entered through its condition with the shortest stretch, and only the rows of that stretch are compared with its
other conditions, again as stretches. So a batch costs the rules' thresholds once and then the candidates, and the rows
that leave the task are the matches alone: nothing is shuffled, and no key gathers the values of one metric.

Rules come to the tasks in blocks of at most `block` conditions, each counted before it is collected and broadcast; a
larger table is matched block after block against the same metrics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import rules as R
from barloom.tables import cut

#: Conditions of one broadcast block, some 40 bytes each.
BLOCK = 500_000
#: Candidates expanded and matches returned at once.
CANDIDATES, MATCHES = 2_000_000, 100_000
_SESSIONS = ("premarket", "market", "postmarket")


def _flat(rules: DataFrame) -> DataFrame:
    """One row a rule: its conditions as arrays, the sessions all of them allow as bits, the highest volume threshold."""
    of = lambda field: F.transform("conditions", lambda c: c[field])
    allowed = F.lit(15)
    for bit, session in enumerate(_SESSIONS):
        allowed = F.when(F.array_contains(of("calculated_during"), F.lit(session)), allowed.bitwiseAND(1 << bit)).otherwise(allowed)
    return rules.select(
        F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), of("metric").alias("metric"), of("operator").alias("operator"),
        F.transform("conditions", lambda c: c["value"].try_cast("double")).alias("other"), allowed.cast("int").alias("allowed"),
        F.coalesce(F.array_max(F.transform("conditions", lambda c: c["volume_threshold"])), F.lit(0)).cast("long").alias("threshold"),
    )


def required(rules: DataFrame) -> list[str]:
    """The metrics that enabled, valid rules of a table read, with all volumes that a threshold may consult: their number
    is that of the catalogue, whatever the rules'."""
    flat = _flat(R.valid_rules(rules.filter("enabled")))
    names = sorted(r.metric for r in flat.select(F.explode("metric").alias("metric")).distinct().collect())
    return names + [v for v in (*R.SESSION_VOLUMES, *R.SCALES) if v not in names] if flat.filter("threshold > 0").limit(1).count() else names


class RuleIndex:
    """The index over one block of rules; metrics: the names that rows will hold, in the order of their columns."""

    def __init__(self, flat: pa.Table, metrics: list[str]):
        flat = flat.combine_chunks()
        number = {m: i for i, m in enumerate(metrics)}
        lists = {c: flat.column(c).combine_chunks() for c in ("metric", "operator", "other")}
        lists = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in lists.items()}
        sizes = lists["metric"].value_lengths().to_numpy().astype(np.int64)
        rule = np.repeat(np.arange(len(sizes)), sizes)
        metric = np.fromiter((number.get(m, -1) for m in lists["metric"].flatten().to_pylist()), np.int64, len(rule))
        operator = np.fromiter(map(R.OPERATORS.index, lists["operator"].flatten().to_pylist()), np.int64, len(rule))
        other = lists["other"].flatten()
        # A value that is no number, or a metric that the rows don't hold, is never met, so neither is its rule.
        hopeless = (metric < 0) | other.is_null().to_numpy(zero_copy_only=False)
        alive = np.bincount(rule, hopeless, len(sizes)) == 0
        kept = alive[rule]
        self.metric, self.operator, self.other = metric[kept], operator[kept], other.to_numpy(zero_copy_only=False)[kept].astype(np.float64)
        self.sizes = sizes[alive]
        self.starts = np.cumsum(self.sizes) - self.sizes
        take = pa.array(np.flatnonzero(alive))
        self.ids, self.names = (flat.column(c).take(take).combine_chunks() for c in ("rule_id", "rule_name"))
        self.allowed, self.threshold = (flat.column(c).take(take).to_numpy() for c in ("allowed", "threshold"))
        self.metrics = metrics
        # Conditions of one metric and operator, by threshold.
        order = np.lexsort((self.other, self.operator, self.metric))
        cuts = np.flatnonzero(np.diff(self.metric[order] * len(R.OPERATORS) + self.operator[order])) + 1
        self.groups = [(int(self.metric[g[0]]), R.OPERATORS[self.operator[g[0]]], g) for g in np.split(order, cuts) if len(g)]
        # The metrics of each rule, once each, for the metadata.
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        pairs = np.unique(owner * max(len(metrics), 1) + self.metric)
        self.shown, self.shown_sizes = pairs % max(len(metrics), 1), np.bincount(pairs // max(len(metrics), 1), minlength=len(self.sizes))
        self.shown_starts = np.cumsum(self.shown_sizes) - self.shown_sizes

    def stretches(self, orders: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(from, to) of each condition in its metric's order of rows; for == a little wide, for != all."""
        low, high = np.zeros(len(self.metric), np.int64), np.zeros(len(self.metric), np.int64)
        for m, operator, which in self.groups:
            held, other = values[m][orders[m]], self.other[which]
            first = last = None
            if operator in (">", "<="):
                last = np.searchsorted(held, other, "right")
            elif operator in (">=", "<"):
                last = np.searchsorted(held, other, "left")
            elif operator == "==":
                first, last = np.searchsorted(held, other - 2 * R.EQUAL, "left"), np.searchsorted(held, other + 2 * R.EQUAL, "right")
            low[which] = last if operator in (">", ">=") else first if operator == "==" else 0
            high[which] = last if operator in ("<", "<=", "==") else len(held)
        return low, high

    def matches(self, values: np.ndarray, given: np.ndarray, session: np.ndarray, reached: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, rule) pairs. values, given: metrics x rows, the values and whether they are there; session: 0 to 2 as in
        the catalogue of sessions, else 3; reached: the volume for thresholds, below 0 if there is none."""
        if not len(self.sizes) or not values.shape[1]:
            return
        orders = [np.flatnonzero(g)[np.argsort(v[g], kind="stable")] for v, g in zip(values, given, strict=True)]
        place = np.full(values.shape, -1, np.int64)
        for m, order in enumerate(orders):
            place[m, order] = np.arange(len(order))
        low, high = self.stretches(orders, values)
        width = np.maximum(high - low, 0)
        least = np.minimum.reduceat(width, self.starts)
        # The first condition of each rule that is as short as its shortest.
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        short = np.flatnonzero(width == least[owner])
        door = np.full(len(self.sizes), -1, np.int64)
        door[owner[short][::-1]] = short[::-1]
        order_of, order_start = np.concatenate(orders), np.cumsum([0, *map(len, orders)])
        todo = np.flatnonzero(least > 0)
        for part in np.split(todo, np.flatnonzero(np.diff(np.cumsum(least[todo]) // CANDIDATES)) + 1):
            if not len(part):
                continue
            rule = np.repeat(part, least[part])
            step = np.arange(len(rule)) - np.repeat(np.cumsum(least[part]) - least[part], least[part])
            c = door[rule]
            row = order_of[order_start[self.metric[c]] + low[c] + step]
            ok = ((self.allowed[rule] >> session[row]) & 1).astype(bool) & ((self.threshold[rule] <= 0) | (reached[row] >= np.maximum(self.threshold[rule], 0)))
            row, rule = row[ok], rule[ok]
            for nth in range(int(self.sizes[part].max())):
                asked = self.sizes[rule] > nth
                c = np.where(asked, self.starts[rule] + nth, self.starts[rule])
                at = place[self.metric[c], row]
                met = (at >= low[c]) & (at < high[c]) & (at >= 0)
                near = np.abs(values[self.metric[c], row] - self.other[c]) < R.EQUAL
                met &= np.where(self.operator[c] == R.OPERATORS.index("=="), near, np.where(self.operator[c] == R.OPERATORS.index("!="), ~near, True))
                row, rule = row[met | ~asked], rule[met | ~asked]
            yield row, rule

    def scan(self, batch: pa.RecordBatch, metadata: bool = True) -> Iterator[pa.RecordBatch]:
        """The matches of a batch with the columns symbol, ts, price, _session, _reach and the metrics."""
        held = [batch.column(f"_m{i}") for i in range(len(self.metrics))]
        n = batch.num_rows
        given = np.array([h.is_valid().to_numpy(zero_copy_only=False) for h in held], bool).reshape(len(held), n)
        values = np.array([h.to_numpy(zero_copy_only=False) for h in held], np.float64).reshape(len(held), n)
        session = batch.column("_session").to_numpy(zero_copy_only=False)
        reached = batch.column("_reach").fill_null(-1).to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore"):
            for rows, rules in self.matches(values, given, session, reached):
                for at in range(0, len(rows), MATCHES):
                    row, rule = rows[at : at + MATCHES], rules[at : at + MATCHES]
                    told = [*[batch.column(c).take(pa.array(row)) for c in ("symbol", "ts", "price")], *[x.take(pa.array(rule)) for x in (self.ids, self.names)]]
                    if not metadata:
                        yield pa.RecordBatch.from_arrays(told, names=["symbol", "ts", "price", "rule_id", "rule_name"])
                        continue
                    sizes = self.shown_sizes[rule]
                    first = np.repeat(self.shown_starts[rule] - np.cumsum(sizes) + sizes, sizes)
                    shown = self.shown[first + np.arange(len(first))]
                    keys = pa.DictionaryArray.from_arrays(pa.array(shown, pa.int32()), pa.array(self.metrics, pa.string())).dictionary_decode()
                    shown_values = pa.MapArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), keys, pa.array(values[shown, np.repeat(row, sizes)]))
                    yield pa.RecordBatch.from_arrays([*told, shown_values], names=["symbol", "ts", "price", "rule_id", "rule_name", "metadata"])


def _blocks(rules: DataFrame, block: int) -> Iterator[tuple[int, pa.Table]]:
    """How many blocks there are, with each: the enabled, valid rules in blocks of about `block` conditions (rules are spread by hash); one rule is never cut."""
    flat = _flat(R.valid_rules(rules.filter("enabled")))
    total = flat.agg(F.sum(F.size("metric"))).first()[0] or 0
    parts = math.ceil(total / block)
    for part in range(parts):
        yield parts, (flat if parts == 1 else flat.filter(F.pmod(F.xxhash64("rule_id", "rule_name"), F.lit(parts)) == part)).toArrow()


def scan_table(metrics: DataFrame, rules: DataFrame, block: int = BLOCK, metadata: bool = True) -> DataFrame:
    """`rules.scan`'s matches (symbol, ts, price, rule_id, rule_name, metadata) for a table of rules.

    metrics: symbol, ts, close, session and the metrics that rules read (`required`); a rule over a metric that is not
    there never matches. Only enabled, valid rules count, each row of the table for itself. A null value meets no
    condition; NaN is above every number, as in Spark's comparisons. No rules give no matches. Where rules are more than one
    block, the metrics are computed once and kept. metadata: whether matches carry the values that their rules read.
    """
    spark, schema = metrics.sparkSession, "symbol string, ts timestamp, price double, rule_id string, rule_name string" + (", metadata map<string, double>" if metadata else "")
    named = set(metrics.columns)
    out = None
    for parts, flat in _blocks(rules, block):
        if out is None and parts > 1:
            metrics = cut(metrics)
        names = sorted(set(pc.list_flatten(flat.column("metric")).to_pylist()) & named)
        index = spark.sparkContext.broadcast(RuleIndex(flat, names))
        told = F.coalesce(*[F.when(F.col("session") == s, i) for i, s in enumerate(_SESSIONS)], F.lit(3)).alias("_session")
        rows = metrics.select("symbol", "ts", F.col("close").cast("double").alias("price"), told, R.reach(metrics.columns).alias("_reach"), *[F.col(m).cast("double").alias(f"_m{i}") for i, m in enumerate(names)])

        def run(batches, index=index):
            for batch in batches:
                yield from index.value.scan(batch, metadata)

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out
