"""Toxicity by a linear classifier on character n-grams with naive Bayes features.

Each n-gram's log-count ratio between toxic and other texts scales its feature
before a logistic regression is fitted (presence of the n-gram times the ratio).
N-grams are hashed into a fixed number of buckets; only buckets whose ratio is
not near chance enter the model, so common n-grams add no noise to long texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.quality_ranking import labelled

#: Labelled rows that the model is learned from, about (by hash of the id): the driver gets the buckets of so many texts.
TRAIN_ROWS = 8_000
LENGTHS = (4, 5, 6)
BITS = 22
#: How many standard errors a bucket's ratio must be from 0: an n-gram of three toxic texts out of a tenth, and of no other, is.
ERRORS = 3.0
#: Characters that are looked at together.
BLOCK = 2_000_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def hashed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of all n-grams of each length; other characters than letters count as one space each."""
    joined = "\0".join(t.replace("\0", " ") for t in texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = codes == 0
    doc = np.cumsum(gap, dtype=np.int32)
    codes = np.where(letters()[codes], codes, np.uint32(32))
    h = codes.copy()
    for n in range(2, max(LENGTHS) + 1):
        if len(codes) < n:
            return
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in LENGTHS:
            inside = doc[: len(h)] == doc[n - 1 :]
            inside &= ~gap[: len(h)]
            mixed = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
            yield doc[: len(h)][inside], (mixed[inside] >> np.uint32(32 - BITS)).astype(np.int64)


def present(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) once for each bucket that a text has, of those with a true ``wanted``."""
    found = [np.zeros(0, np.int64)]
    for doc, bucket in hashed(texts):
        if wanted is not None:
            hit = np.flatnonzero(wanted[bucket])
            doc, bucket = doc[hit], bucket[hit]
        found.append(doc.astype(np.int64) << BITS | bucket)
    keys = np.sort(np.concatenate(found))
    keys = keys[np.diff(keys, prepend=-1) > 0]
    return keys >> BITS, keys & ((1 << BITS) - 1)


def ranges(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


@dataclass(frozen=True)
class Classifier:
    buckets: np.ndarray
    weights: np.ndarray  # coefficient times ratio
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.buckets] = self.weights
        return out

    def score(self, texts: list[str], table: np.ndarray | None = None) -> np.ndarray:
        table = self.table() if table is None else table
        doc, bucket = present(texts, table != 0)
        z = self.bias + np.bincount(doc, weights=table[bucket], minlength=len(texts))[: len(texts)]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(sizes: np.ndarray, column: np.ndarray, scale: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Coefficients and bias of a ridge logistic regression, by Adam on the whole set.

    A row has the next ``sizes`` of ``column``; a column that it has counts as
    ``scale`` there.  Beside ``column`` one array of its length is held at a time.
    """
    n = len(scale)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[-1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    for t in range(1, rounds + 1):
        z = np.full(len(y), w[-1])
        if len(some):
            z[some] += np.add.reduceat((w[:-1] * scale)[column], starts)
        e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.append(np.bincount(column, weights=np.repeat(e, sizes), minlength=n) * scale + ridge * w[:-1], e.sum()) / max(1, len(y))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, text: str = "text", key: str = "doc_id") -> Classifier:
    """The classifier learned from about ``rows`` of ``labels`` (key, label).

    Counts by bucket are aggregated on the executors.  The driver gets the buckets
    of the model, at most all 2 ** ``BITS``, and of each training text those that
    it has; both are bounded by ``rows``, not by the table.
    Without labels of both classes the model says the share of toxic labels for
    every text.
    """
    train = labelled(docs, labels, label, rows, text, key)

    def count(batches):
        for b in batches:
            texts, y = [t or "" for t in b.column(0).to_pylist()], b.column(1).to_numpy()
            for i, j in ranges(texts):
                doc, bucket = present(texts[i:j])
                toxic = y[i:j][doc] == 1
                order = np.argsort(bucket, kind="stable")
                first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                ones = np.add.reduceat(toxic[order].astype(np.int64), first) if len(first) else first
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order][first]), pa.array(ones), pa.array(np.diff(first, append=len(order)))], ["bucket", "ones", "all"])

    totals = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    n1, n = totals.get(1, 0), sum(totals.values())
    if not n1 or n1 == n:
        return Classifier(np.zeros(0, np.int64), np.zeros(0), math.log((n1 + 1) / (n - n1 + 1)))
    ones, rest = F.col("ones"), F.col("all") - F.col("ones")
    ratio = F.log((1 + ones) / F.lit(n1 + 2)) - F.log((1 + rest) / F.lit(n - n1 + 2))
    chosen = (
        train.mapInArrow(count, "bucket long, ones long, all long")
        .groupBy("bucket")
        .agg(F.sum("ones").alias("ones"), F.sum("all").alias("all"))
        .select("bucket", ratio.alias("ratio"), (F.abs(ratio) / F.sqrt(1 / (1 + ones) + 1 / (1 + rest))).alias("errors"))
        .where(F.col("errors") > ERRORS)
        .collect()
    )
    chosen.sort(key=lambda r: r.bucket)
    buckets, ratios = np.array([r.bucket for r in chosen], np.int64), np.array([r.ratio for r in chosen])
    if not len(buckets):
        return Classifier(buckets, ratios, math.log((n1 + 1) / (n - n1 + 1)))

    def pick(batches):
        wanted = np.zeros(1 << BITS, bool)
        wanted[buckets] = True
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            for i, j in ranges(texts):
                doc, bucket = present(texts[i:j], wanted)
                parts = np.split(np.searchsorted(buckets, bucket).astype("<i4"), np.cumsum(np.bincount(doc, minlength=j - i)[: j - i])[:-1])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in parts], pa.binary()), b.column(1).slice(i, j - i)], ["found", "label"])

    got = sorted((r.label, bytes(r.found)) for r in train.mapInArrow(pick, "found binary, label int").collect())
    y = np.array([label for label, _ in got], float)
    sizes = np.array([len(x) // 4 for _, x in got], np.int64)
    column = np.frombuffer(b"".join(x for _, x in got), "<i4")
    del got
    w, bias = logistic(sizes, column, ratios, y)
    return Classifier(buckets, w * ratios, bias)


def score(df: DataFrame, model: Classifier, threshold: float = 0.3, text: str = "text", key: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, extra columns, score, predicted) of each row, a null text as empty; no shuffle, blocks of bounded size."""
    columns = [key, *extra]

    def step(batches):
        table = model.table()
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            for i, j in ranges(texts):
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in b.columns[1:]], pa.array(model.score(texts[i:j], table))], [*columns, "score"])

    named = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in columns)
    scored = df.select(F.col(text).alias("__text"), *columns).mapInArrow(step, f"{named}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
