"""Quality scores from pairwise preferences (Bradley-Terry), cut at a quantile.

A document's score is linear in figures of its text.  The weights come from
preference pairs, a document marked good over one marked bad: the logistic loss
of the score difference is minimised.  The cut between the classes is the
quantile of the training scores at which the share of bad labels lies.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold, hash_sample, sample_rate

#: Labelled rows that the weights are learned from, about (by hash of the id).
TRAIN_ROWS = 20_000
#: Preference pairs for each bad document, which is set against good ones in turn; every good document is in one at least.
PAIRS = 10
FIGURES = [
    "words", "word_length", "symbols", "upper", "digits", "exclaims", "bars", "variety", "top_word", "repeats",
    "line_repeats", "ends", "ends_many", "long_words", "short_text", "runs", "spaces", "all_caps", "marks_inside", "lines",
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = re.compile(r"(.)\1{3,}", re.S)


def figures(text: str | None) -> list[float]:
    """Figures of one text, each between about 0 and 5; all 0 but ``short_text`` for a text without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 14 + [5.0] + [0.0] * 5
    chars = len(text)
    letters = chars - text.count(" ") - text.count("\n")
    seen = Counter(words)
    trigrams = list(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, text))
    digits = sum(map(str.isdigit, text))
    symbols = sum(map(text.count, "#*$%&<>@~^=+{}[]\\/_"))
    ends = sum(map(text.count, ".!?"))
    soft = lambda x, k: math.log1p(k * x)
    return [
        min(5.0, math.log10(n)),
        min(5.0, abs(letters / n - 5.5) / 2),
        soft(symbols / n, 10),
        soft(upper / max(1, letters), 10),
        soft(digits / max(1, letters), 10),
        soft(text.count("!") / n, 10),
        soft(text.count("|") / n, 10),
        len(seen) / n * min(1.0, n / 400) + (1 - min(1.0, n / 400)) * 0.6,
        soft(max(seen.values()) / n - 1 / n, 10),
        1 - len(set(trigrams)) / max(1, len(trigrams)),
        1 - len(set(lines)) / max(1, len(lines)),
        soft(max(0.0, 0.04 - ends / n), 50),
        soft(max(0.0, ends / n - 0.4), 10),
        soft(sum(len(w) > 20 for w in words) / n, 10),
        max(0.0, 5 - n / 10),
        soft(sum(len(m) for m in RUN.findall(text)) / n, 10),
        soft(text.count("  ") / n, 10),
        soft(sum(w.isupper() and len(w) > 1 for w in words) / n, 10),
        soft(sum(not w[:-1].isalpha() and len(w) > 2 for w in words) / n, 10),
        soft(len(lines) / n, 10),
    ]


@dataclass(frozen=True)
class Ranking:
    """Weights of the standardised figures, and the score at the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Scores as 0 to 1: ``threshold`` at the cut, and log-odds as far apart as the scores."""
        z = np.clip(self.score(x) - self.cut + math.log(self.threshold / (1 - self.threshold)), -40, 40)
        return 1 / (1 + np.exp(-z))


def fit_pairs(x: np.ndarray, y: np.ndarray, threshold: float, ridge: float = 1e-3, rounds: int = 60, seed: int = 5) -> Ranking:
    """Bradley-Terry weights by Newton's method on the pairs' logistic loss.

    Without labels of both classes there is no pair: all weights are 0 and every
    document scores the same, on the side of the class that was seen.
    """
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(len(FIGURES)), np.ones(len(FIGURES)))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1] if len(x) else len(FIGURES))
    if not len(good) or not len(bad):
        return Ranking(mean, scale, w, 1e-9 if len(bad) else 0.0, threshold)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    n = PAIRS * len(bad) + len(good)
    d = z[rng.permutation(np.resize(good, n))] - z[np.resize(bad, n)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # of losing
        gradient = -(d.T @ p) / n + ridge * w
        hessian = (d.T * (p * (1 - p))) @ d / n + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    scores = np.sort(z @ w)
    # the quantile at the share of bad labels, in the widest gap near it, so that no document sits on the cut
    k = min(max(1, len(bad)), len(scores) - 1)
    near = np.arange(max(1, k - max(1, len(bad) // 50)), min(len(scores), k + max(1, len(bad) // 50) + 1))
    best = near[np.argmax(scores[near] - scores[near - 1])]
    return Ranking(mean, scale, w, float((scores[best] + scores[best - 1]) / 2), threshold)


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(text, label) of about ``rows`` labelled documents, chosen by hash of the id.

    Rows without a label are left out; an id with several labels counts with the
    largest.  The chosen ids are at most about ``rows``, so they are broadcast
    and the texts are not shuffled.
    """
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    chosen = hash_sample(one, key, sample_rate(one.count(), rows))
    return docs.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, rows: int = TRAIN_ROWS, text: str = "text", key: str = "doc_id") -> Ranking:
    """The ranking learned from about ``rows`` of ``labels`` (key, label); their figures come to the driver, texts don't."""

    def step(batches):
        for b in batches:
            x = np.array([figures(t) for t in b.column(0).to_pylist()], np.float64).reshape(-1, len(FIGURES))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], ["x", "label"])

    got = labelled(docs, labels, label, rows, text, key).mapInArrow(step, "x array<double>, label int").collect()
    got.sort(key=lambda r: (r.label, r.x))  # the same model whatever the order of rows
    return fit_pairs(np.array([r.x for r in got], np.float64).reshape(-1, len(FIGURES)), np.array([r.label for r in got]), threshold)


def score(df: DataFrame, model: Ranking, text: str = "text", key: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, extra columns, score, predicted) of each row, null texts as empty ones; no shuffle, one row at a time."""
    columns = [key, *extra]

    def step(batches):
        for b in batches:
            x = np.array([figures(t) for t in b.column(0).to_pylist()], np.float64).reshape(-1, len(FIGURES))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(model.probability(x))], [*columns, "score"])

    named = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in columns)
    scored = df.select(F.col(text).alias("__text"), *columns).mapInArrow(step, f"{named}, score double")
    return scored.withColumn("predicted", (F.col("score") >= model.threshold).cast("int"))


def training_labels(labels: DataFrame, folds: int, held_out: int, key: str = "doc_id") -> DataFrame:
    """The labels outside the held-out fold."""
    return labels.where(fold(key, folds) != held_out)
