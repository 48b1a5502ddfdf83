"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit place: the head of the MD5 of its id. A source's budget is met by taking all its
documents some whole number of times, and once more those whose place lies below a threshold. The threshold is found
without a sort: sum words by source and the place's first 12 bits, find the bucket in which the running sum passes the
budget, and refine that bucket alone by the next 12 bits, five times. Histograms have at most 4,096 rows a source and
level, whatever the input.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents with the same
place (repeated ids) are taken or left together; a place that crosses the budget is taken when that comes nearer; an
empty table, or one without words, takes nothing; other columns are ignored (`mix_rows` passes them through).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BITS, LEVELS = 12, 5


def _place(id_col):
    head = F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, BITS * LEVELS // 4)
    return F.conv(head, 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), _place(F.col(id_col)).alias("place"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target: water is filled by weight up to each source's cap.

    One row per source from here on; a source is capped when filling all sources to its own level stays under the
    budget, which running sums over the sources by level tell.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), nth + 1))
    per = per.withColumn("top", F.lit(cap) * F.col("source_size")).withColumn("level", F.col("top") / F.col("w"))
    everything = Window.partitionBy()
    below = Window.orderBy("level").rangeBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
    filled = F.sum("top").over(below) + F.col("level") * (F.sum("w").over(everything) - F.sum("w").over(below))
    per = per.withColumn("capped", filled < F.col("budget"))
    left = F.col("budget") - F.sum(F.when(F.col("capped"), F.col("top")).otherwise(0)).over(everything)
    rest = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(everything)
    per = per.withColumn("left", left).withColumn("rest", rest)
    filled_to = F.least(F.col("top").cast("double"), F.col("left") * F.col("w") / F.col("rest"))
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("top").cast("double")).otherwise(filled_to).alias("target"))


def thresholds(sizes: DataFrame, wanted: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """wanted's columns, with `times` (whole takes) and `under`: places below it are taken once more."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = wanted.withColumn("times", times.cast("long"))
    wanted = wanted.withColumn("need", F.col("target") - F.col("times") * F.col("source_size"))
    edge = materialize(wanted.withColumn("prefix", F.lit(0).cast("long")).withColumn("mass", F.col("source_size")), "mix-edge")
    keep = ["source", "source_size", "target", "times", "need", "prefix", "mass"]
    for level in range(1, levels + 1):
        shift = bits * (levels - level)
        b, e = sizes.alias("b"), edge.alias("e")
        inside = F.col("b.source").eqNullSafe(F.col("e.source")) & (F.shiftright("b.place", shift + bits) == F.col("e.prefix"))
        hist = (
            b.join(e.filter("need > 0"), inside).groupBy("e.source", F.shiftright("b.place", shift).alias("bucket"))
            .agg(F.sum("b.size").alias("words"))
        )
        running = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("words").over(running)).alias("h")
        crossing = (
            hist.join(edge.alias("e"), F.col("h.source").eqNullSafe(F.col("e.source")))
            .filter((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("words") <= F.col("need")))
            .select(F.col("h.source").alias("source"), F.col("bucket"), (F.col("need") - F.col("upto") + F.col("words")).alias("still"), "words")
        )
        edge = (
            edge.alias("e").join(crossing.alias("c"), F.col("e.source").eqNullSafe(F.col("c.source")), "left")
            .select(
                F.col("e.source").alias("source"), "source_size", "target", "times",
                # A budget met exactly at an earlier level crosses nothing more: its threshold stays, at this level's depth.
                F.coalesce("still", F.lit(0.0)).alias("need"), F.coalesce("bucket", F.shiftleft("prefix", bits)).alias("prefix"), F.coalesce("words", F.lit(0)).alias("mass"),
            )
        )
        edge = materialize(edge.select(*keep), "mix-edge")
    nearer = (F.col("mass") > 0) & (2 * F.col("need") >= F.col("mass"))
    under = F.col("prefix") + F.when(nearer, 1).otherwise(0)
    return edge.select("source", "source_size", "target", "times", under.alias("under"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken (a whole number of times the size) and copies."""
    sizes = materialize(sized(docs, id_col, text_col, source_col), "mix-sizes")
    cut = thresholds(sizes, targets(sizes))
    s, c = sizes.alias("s"), cut.alias("c")
    copies = (F.col("c.times") + F.when(F.col("s.place") < F.col("c.under"), 1).otherwise(0)).cast("long")
    return s.join(c, F.col("s.source").eqNullSafe(F.col("c.source"))).select(
        F.col("s.doc_id").alias("doc_id"), F.col("s.size").alias("size"), F.col("c.source_size").alias("source_size"),
        F.col("c.target").alias("target"), (F.col("s.size") * copies).alias("taken"), copies.alias("copies"),
    )


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    sizes = materialize(sized(docs, id_col, text_col, source_col), "mix-sizes")
    cut = thresholds(sizes, targets(sizes)).select(F.col("source").alias("_source"), "times", "under")
    own = [docs[c].alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*own, docs[source_col].alias("_s"), _place(docs[id_col]).alias("_p"))
    rows = rows.join(cut, F.col("_s").eqNullSafe(F.col("_source")))
    copies = (F.col("times") + F.when(F.col("_p") < F.col("under"), 1).otherwise(0)).cast("int")
    rows = rows.withColumn("_copies", copies).filter("_copies > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2 * source_size AS top FROM p),
l AS (SELECT *, top / w AS level, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w),
f AS (SELECT *, sum(top) OVER (ORDER BY level) + level * (sum(w) OVER () - sum(w) OVER (ORDER BY level)) < budget AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN top::DOUBLE ELSE least(top::DOUBLE,
    (budget - sum(CASE WHEN capped THEN top ELSE 0 END) OVER ()) * w / sum(CASE WHEN capped THEN 0 ELSE w END) OVER ()) END AS target FROM f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
r AS (SELECT d.*, q.source_size, q.target, q.times, q.target - q.times * q.source_size AS need,
    sum(size) OVER (PARTITION BY d.source ORDER BY place) AS upto,
    sum(size) OVER (PARTITION BY d.source, place) AS mass
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
  (size * (times + CASE WHEN need > 0 AND (upto <= need OR (upto - mass <= need AND 2 * (need - upto + mass) >= mass)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
