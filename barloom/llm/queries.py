"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import align, exact, html_crf, jaccard, licenses, mixing, mpeg, packing, pieces, quality, secrets, squares, substrings
from barloom.llm.common import documents


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("copies")


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.stored_text(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir), as_text=False).withColumnRenamed("kept", "kept_sha256")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return squares.digests(squares.find_runs(docs.select("doc_id", squares.planted(docs["doc_id"], docs["text"]).alias("text"))))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    told = pieces.decode(pieces.encode(documents(spark, sf_dir), model), model)
    return told.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, model = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
    return align.with_counts(align.digest(align.align(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, model)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_licenses, op3_substring_dedup, op4_jaccard_join, op5_exact_dedup, op6_html_text, op7_mixing, op8_secrets, op9_mpeg_audio, op10_packing,
        op11_periodic_runs, op12_sentencepiece, op13_alignment,
    )
}
ORACLES = {"op2_licenses": licenses.oracle(), "op5_exact_dedup": exact.ORACLE, "op7_mixing": mixing.ORACLE}
