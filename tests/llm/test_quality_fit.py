"""The fit and the features of the quality ranking against plain versions."""

import itertools
import math

import numpy as np
from barloom.llm import quality


def test_weights_and_cut_against_all_pairs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4)) * [1, 5, 0.2, 1]
    label = (x @ [1.0, 0.1, 3.0, 0.0] + rng.normal(size=120) > 0.3).astype(int)
    model = quality.fit(x, label, pairs_each=2000)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)
    pairs = [(i, j) for i, j in itertools.product(range(120), range(120)) if label[i] > label[j]]
    d = np.array([z[i] - z[j] for i, j in pairs])
    w = np.zeros(4)
    for _ in range(4000):
        w += 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - quality.RIDGE * w)
    assert np.abs(w - model["w"]).max() < 0.05 * np.abs(w).max()
    s = z @ model["w"]
    balanced = lambda t: np.mean(s[label == 1] > t) + np.mean(s[label == 0] <= t)
    assert balanced(model["cut"]) >= max(balanced(t) for t in np.concatenate([s - 1e-9, s + 1e-9])) - 0.02


def test_features_by_hand():
    for text in ("", "A b, b b!\n\nA b, b b!\nÉ 12", "word " * 100_000, None):
        x, raw = quality.features(text), (text or "").encode()
        words, n = raw.split(), max(1, len(raw))
        upper = sum(65 <= b <= 90 for b in raw) / n
        again = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))
        assert len(x) == quality.N_FEATURES and np.isfinite(x).all() and math.isclose(x[0], upper) and math.isclose(x[8], math.sqrt(upper))
        tail = x[16 + len(quality.MARKS) :]
        assert math.isclose(tail[0], math.log1p(len(words))) and math.isclose(tail[7], again) and tail[-1] == (not words)
        lines = [line for line in raw.split(b"\n") if line.strip()]
        assert math.isclose(tail[9], len(set(lines)) / max(1, len(lines)))
