"""Exact de-duplication with skew-safe combining.

Two texts are equal when they are identical after lower-casing A-Z. Each map task first combines its own rows (the
partial aggregation, keyed by digest and whole text), then salted digest groups are merged, so a text that a third of
all rows carry arrives at `salts` reducers and not one, and last the salt winners are combined. The whole text is part
of the key of both merges, so content and never only its digest decides.

Defined results: a null text counts as empty; of equal texts the largest doc_id stays (null ids lose to any id, and
keep_id is null only where every id of the group is null); rows repeated with the same id and text count each in
group_size, are all marked kept, and `keep_rows` returns one of them; an empty table gives an empty table; other
columns, whatever their names, are passed through by `keep_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower

SALTS = 32


def _identity(text: Column) -> list[Column]:
    """What names a content: SHA-256, length and a second 64-bit hash of the normalised text."""
    norm = ascii_lower(text)
    return [F.sha2(norm, 256).alias("_sha"), F.length(norm).alias("_len"), F.xxhash64(norm).alias("_xx")]


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: its identity, keep_id and group_size."""
    norm = ascii_lower(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"), F.sha2(norm, 256).alias("_sha"))
    salted = (
        rows.groupBy("_sha", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"), "_norm")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    )
    whole = salted.groupBy("_sha", "_norm").agg(F.max("_keep").alias("keep_id"), F.sum("_n").alias("group_size"))
    return whole.select("_sha", F.length("_norm").alias("_len"), F.xxhash64("_norm").alias("_xx"), "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    The join back is on the content's identity; a hot text's rows are split by AQE's skew join, as both sides are plain
    shuffles.
    """
    members = docs.select(F.col(id_col).alias("_id"), *_identity(F.col(text_col)))
    kept = members.join(winners(docs, id_col, text_col, salts), ["_sha", "_len", "_xx"])
    return kept.select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The surviving rows of docs with all their columns, one for each distinct text."""
    own = docs.columns
    tagged = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(own)], *_identity(docs[text_col]))
    tagged = tagged.withColumn("_key", F.coalesce(F.col(f"_c{own.index(id_col)}").cast("string"), F.lit("")))
    best = winners(docs, id_col, text_col, salts).select(
        F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias("_key"), "_sha", "_len", "_xx"
    )
    one = Window.partitionBy("_key", "_sha", "_len", "_xx").orderBy(F.lit(1))
    return (
        tagged.join(best, ["_key", "_sha", "_len", "_xx"], "left_semi")
        .withColumn("_row", F.row_number().over(one)).filter("_row = 1")
        .select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)])
    )


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
