"""Quality classifier: Bradley-Terry ranking of documents.

Labelled documents give preference pairs (a good one beats a poor one). The chance that a beats b is the logistic
function of s(a) - s(b) with s linear in the features, so the weights are those of a logistic loss on feature
differences, fitted by Newton steps. The cut is a quantile of the fitted documents' scores, the one with the best
balanced accuracy there; the reported score is the logistic function of s minus the cut, so 0.5 is the cut.

Features come from the whole text alone: shares of byte classes and marks, word lengths, repetition of words, adjacent
words and lines, and how far the text compresses. Features are computed for every document; only the fit uses a sample
of the labelled rows, of at most about `max_labelled` (the documented bound; a hash of the id decides).

Defined results: a null text counts as empty and is scored like any other; labelled rows with a null label or id are not
used; without both classes among the labelled rows the weights are 0 and every score is 0.5; repeated rows get equal
scores; an empty table gives an empty table; other columns are ignored by `score` and passed through by `keep_good`.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import materialize

MAX_LABELLED = 20_000
PAIRS_EACH = 32
RIDGE = 1e-3
MARKS = b"!?.,;:|#$%&*_-=/\\<>()[]{}\"'@+~^`"


def _classes() -> np.ndarray:
    kind = np.zeros((256, 8), np.float64)
    for b in range(256):
        c = bytes([b])
        kind[b] = [c.isupper(), c.islower(), c.isdigit(), b == 32, b in (9, 10, 11, 12, 13), b >= 128, b in MARKS, b < 9 or 13 < b < 32 or b == 127]
    return kind


_CLASSES = _classes()
_OWN_MARKS = np.frombuffer(MARKS, np.uint8)


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    n = max(1, len(raw))
    words = raw.split()
    n_words = max(1, len(words))
    distinct = len(set(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marked = sum(map(_ENDS.__contains__, [w[-1] for w in words])) / n_words
    again = sum(map(bytes.__eq__, words[1:], words)) / n_words
    shares = counts @ _CLASSES / n
    return np.concatenate([
        shares, np.sqrt(shares), np.sqrt(counts[_OWN_MARKS] / n),
        [
            np.log1p(len(words)), np.log1p(len(raw)), len(raw) / n_words / 10, distinct / n_words, np.log1p(distinct) / np.log1p(n_words),
            np.log1p(n_words) - np.log1p(distinct), marked, again, np.sqrt(again), len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)),
            min(2.0, len(zlib.compress(raw, 1)) / (n + 16)), float(len(words) < 5), float(not words),
        ],
    ])


_ENDS = frozenset(MARKS)
N_FEATURES = len(features(""))


def _feature_batches(batches):
    for batch in batches:
        rows = [features(t) for t in batch.column(1).to_pylist()]
        flat = np.concatenate(rows) if rows else np.zeros(0)
        made = pa.ListArray.from_arrays(np.arange(0, N_FEATURES * len(rows) + 1, N_FEATURES, np.int32), pa.array(flat.astype(np.float32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["_id", "_x"])


def featurize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_feature_batches, f"_id {kind}, _x array<float>")


def fit(x: np.ndarray, label: np.ndarray, pairs_each: int = PAIRS_EACH, ridge: float = RIDGE) -> dict:
    """Weights, scale and cut from features and 0/1 labels of a bounded sample."""
    good, poor = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    mean, sd = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    w, cut = np.zeros(x.shape[1]), 0.0
    if len(good) and len(poor):
        z, rng = np.clip((x - mean) / sd, -8, 8), np.random.default_rng(7)
        few, many = (good, poor) if len(good) < len(poor) else (poor, good)
        a = np.r_[np.repeat(few, pairs_each), np.repeat(many, max(1, pairs_each // 8))]
        b = np.r_[rng.choice(many, len(few) * pairs_each), rng.choice(few, len(many) * max(1, pairs_each // 8))]
        won, lost = np.where(label[a] == 1, a, b), np.where(label[a] == 1, b, a)
        d = z[won] - z[lost]
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -35, 35)))
            grad = d.T @ (p - 1) / len(d) + ridge * w
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w)), grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        s = z @ w
        quantiles = np.quantile(s, np.linspace(0, 1, 2001))
        cuts = (quantiles[1:] + quantiles[:-1]) / 2
        up, down = np.sort(s[good]), np.sort(s[poor])
        passed = 1 - np.searchsorted(up, cuts) / len(up) + np.searchsorted(down, cuts) / len(down)
        cut = float(np.median(cuts[passed >= passed.max() - 1e-12]))
    return {"w": w, "mean": mean, "sd": sd, "cut": cut}


def learn(scored: DataFrame, labels: DataFrame, usable: Column, id_col: str, label_col: str, max_labelled: int) -> dict:
    """Fits on at most about max_labelled of the labelled rows that `usable` (over _id) admits."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(usable)
    n = known.count()
    if n > max_labelled:
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))
    rows = scored.join(known, "_id").select("_x", "_y").toPandas()
    x = np.stack(rows["_x"].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, N_FEATURES))
    return fit(x, rows["_y"].to_numpy(dtype=np.int64))


def _score_udf(model: dict):
    @F.pandas_udf("double")
    def scored(xs):  # noqa: ANN001, ANN202
        import pandas as pd

        z = np.clip((np.stack(xs.to_numpy()).astype(np.float64) - model["mean"]) / model["sd"], -8, 8) if len(xs) else np.zeros((0, N_FEATURES))
        return pd.Series(1 / (1 + np.exp(-np.clip(z @ model["w"] - model["cut"], -35, 35))))

    return scored


def trainable(id_col: Column) -> Column:
    """Rows to learn from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """id, held_out, score, predicted for every row of docs."""
    x = materialize(featurize(docs, id_col, text_col), "quality-features")
    model = learn(x, labels, trainable(F.col("_id")), id_col, label_col, max_labelled)
    out = x.select(F.col("_id").alias(id_col), (~trainable(F.col("_id"))).alias("held_out"), _score_udf(model)("_x").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that score 0.5 or more, with all their columns.

    The labelled sample is featurized for the fit; the others are scored as they stream by, so no text is shuffled.
    """
    known = labels.filter(F.col(label_col).isNotNull() & trainable(F.col(id_col)))
    n = known.count()
    share = int((1 << 30) * min(1.0, max_labelled / max(1, n)))
    picked = docs.filter(trainable(F.col(id_col)) & (F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < share))
    model = learn(featurize(picked, id_col, text_col), known, trainable(F.col("_id")), id_col, label_col, max_labelled)

    @F.pandas_udf("double")
    def scored(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        x = np.stack([features(t) for t in texts]) if len(texts) else np.zeros((0, N_FEATURES))
        z = np.clip((x.astype(np.float32) - model["mean"]) / model["sd"], -8, 8)
        return pd.Series(1 / (1 + np.exp(-np.clip(z @ model["w"] - model["cut"], -35, 35))))

    return docs.filter(scored(docs[text_col]) >= 0.5)
