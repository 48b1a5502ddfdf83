"""Rules and toplists over a stream of metric rows, one micro-batch at a time.

What a batch writes lies in a folder of its own number, and what it goes on from in the folder of the batch before it. A
batch that is run again, after a failure or a restart, reads the same and writes in place of what it wrote, so each match
fires once; what no batch goes on from any more is deleted. Rules are taken anew by each batch: a rule that is added counts from the next batch on. A query that begins
again without its checkpoint gets a `run` of another name, and the alerts so far as its history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import alerts as A
from barloom.operators import toplists as K
from barloom.operators.rule_index import scan_table
from barloom.sources.sinks import latest_values
from barloom.streaming.pipeline import append, each_batch, last_fired, stream_dedup
from barloom.tables import drop


class _Steps:
    """Tables by run and batch number below one folder."""

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run = spark, path, run

    def at(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/run={self.run}/batch={batch}"

    def write(self, name: str, batch: int, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.at(name, batch))
        return self.spark.read.schema(df.schema).parquet(self.at(name, batch))

    def state(self, name: str, batch: int, df: DataFrame) -> DataFrame:
        """Writes what the next batch goes on from. The one before stays, for this batch may be run again."""
        out = self.write(name, batch, df)
        drop(self.spark, self.at(name, batch - 2))
        return out

    def before(self, name: str, batch: int) -> DataFrame | None:
        return None if batch == 0 else self.spark.read.parquet(self.at(name, batch - 1))


def read_all(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """All that the batches of all runs wrote under a name, with run and batch; None before the first."""
    try:
        return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}/run=*/batch=*")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def _newest(rows: DataFrame, before: DataFrame | None) -> DataFrame:
    """Each symbol's row of the latest time, of rows and those before; combined before the shuffle. Of rows at one time the
    one that is greater as text stays."""
    rows = rows if before is None else before.unionByName(rows)
    order = F.struct("ts", *[F.col(c).cast("string") for c in rows.columns if c not in ("symbol", "ts")])
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), order).alias("r")).select("r.*")


def latest_stream(rows: DataFrame, path: str, checkpoint: str, run: str = "0", drain: bool = True):  # noqa: ANN201
    """Starts the sink of latest values: below `path`, each symbol's newest row (symbol, ts and any values)."""
    steps = _Steps(rows.sparkSession, path, run)
    return each_batch(rows, lambda batch, number: steps.state("latest", number, _newest(batch, steps.before("latest", number))) and None, checkpoint, drain)


def read_latest(spark: SparkSession, path: str, now, ttl_seconds: int = 600) -> DataFrame:
    """The rows that `latest_stream` keeps, unless older than the time to live at `now`."""
    held = read_all(spark, path, "latest")
    last = held.agg(F.max(F.struct("run", "batch")).alias("m")).first().m
    rows = held.filter((F.col("run") == last.run) & (F.col("batch") == last.batch)).drop("run", "batch")
    return latest_values(rows, now, ttl_seconds)


def alert_streams(alerts: DataFrame, path: str, checkpoint: str, subscriptions: DataFrame | None = None, drain: bool = True) -> tuple:
    """Starts two sinks of an alert stream: below `path`, `alerts` has every valid one, `alerts.filtered` the first of each
    rule, symbol and second that a subscription asks for."""
    valid = A.valid_alerts(alerts)
    kept = stream_dedup(valid)
    kept = kept if subscriptions is None else A.user_filter(kept, subscriptions)
    return tuple(append(df, f"{path}/{name}", f"{checkpoint}/{name}", drain) for name, df in (("alerts", valid), ("alerts.filtered", kept)))


def scan_stream(metrics: DataFrame, rules: Callable[[SparkSession], DataFrame], path: str, checkpoint: str, seconds: int = 10, run: str = "0", history: DataFrame | None = None, drain: bool = True):  # noqa: ANN201
    """Starts the scan of a stream of metric rows (symbol, ts, close, session and the metrics that rules read).

    rules: gives the rule table, each time it is called as it then is. Alerts are written below `path`/alerts. The cooldown
    is told by event time; what is kept of it is one row for each rule and symbol that still cools down at the batch's last
    time. history: alerts of before the first batch.
    """
    spark = metrics.sparkSession
    steps = _Steps(spark, path, run)
    begun = None if history is None else last_fired(history)

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read for the scan, once a block of rules, and for its last time
        last = steps.before("cooling", number)
        last = begun if last is None else last
        found = steps.state("matches", number, scan_table(batch, rules(spark)))
        fired = steps.write("alerts", number, A.make_alerts(A.cooldown(found, seconds, last)))
        newest = last_fired(fired) if last is None else last_fired(last.unionByName(last_fired(fired)))
        now = batch.agg(F.max("ts")).first()[0]
        cooling = newest if now is None else newest.filter(F.unix_micros("ts") + seconds * 1_000_000 > F.unix_micros(F.lit(now)))
        steps.state("cooling", number, cooling)
        batch.unpersist()

    return each_batch(metrics, one, checkpoint, drain)


def rank_stream(metrics: DataFrame, specs: Callable[[SparkSession], DataFrame], columns: list[str], path: str, checkpoint: str, n: int = 50, run: str = "0", seconds: int = 1, drain: bool = True):  # noqa: ANN201
    """Starts the rank feed of a stream of metric rows: below `path`/changes, what entered, left or moved on each list's
    page of n with each batch (list_id, symbol, old_rank, new_rank, kind).

    The state is each symbol's latest row and the page last told. A page is told when `seconds` of event time have gone by
    since the last one; until then changes gather. Applied in order of batch, the changes give the page.
    """
    spark = metrics.sparkSession
    steps = _Steps(spark, path, run)
    kept = list(dict.fromkeys(["symbol", "ts", "close", "volume_daily", *(c for c in (*K.CHANGES.values(), "exchange", "market_cap", "volume_live") if c in metrics.columns), *columns]))

    def one(batch: DataFrame, number: int) -> None:
        latest = steps.state("latest", number, _newest(batch.select(*kept), steps.before("latest", number)))
        now = latest.agg(F.max("ts")).first()[0]
        page, told = steps.before("page", number), steps.before("told", number)
        since = None if told is None else told.first()[0]
        empty = spark.createDataFrame([], "list_id string, rank int, symbol string, value double")
        page = empty if page is None else page
        due = now is not None and (since is None or (now - since).total_seconds() >= seconds)
        new = page
        if due:
            extra = tuple(c for c in ("exchange", "market_cap") if c in kept)
            new = K.ranked(K.long_values(latest, columns, extra), specs(spark), n)
        new = steps.state("page", number, new)
        steps.write("changes", number, K.changes(page, new))
        steps.state("told", number, spark.createDataFrame([(now if due else since,)], "at timestamp"))

    return each_batch(metrics, one, checkpoint, drain)


def page_of(changes: DataFrame) -> DataFrame:
    """(list_id, symbol, rank): the page that a feed's changes, with their batch, come to."""
    last = changes.groupBy("list_id", "symbol").agg(F.max_by("new_rank", "batch").alias("rank"))
    return last.filter("rank is not null")
