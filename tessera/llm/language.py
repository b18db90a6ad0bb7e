"""Language by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter n-gram's vector is the
product of its letters' vectors, each rotated by its place; a document's is the
sum of its n-grams', a language's the sum of its documents'.  A document gets the
language whose vector has the largest cosine with its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_sample, sample_rate
from tessera.llm.toxicity import letters

DIMENSIONS, N = 1024, 3
#: Documents that the language vectors are learned from, about (by hash of the id).
TRAIN_ROWS = 40_000
#: Texts, and characters, that are looked at together.
TEXTS, CHARS = 256, 2_000_000
UNKNOWN = "und"


@lru_cache(maxsize=4096)
def letter_vector(code: int) -> np.ndarray:
    """The vector of a code point; it depends on the code point only."""
    return np.random.Generator(np.random.PCG64(code + 1)).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    return np.array([letter_vector(c) for c in codes.tolist()], np.int8).reshape(-1, DIMENSIONS)


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(vector of each text, whether it has a letter).  Runs of other characters count as one space."""
    joined = "\0".join(" " + t.replace("\0", " ") + " " for t in texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    gap = codes == 0
    doc = np.cumsum(gap)
    letter = letters()[codes]
    codes[~letter] = 32
    keep = ~gap & (letter | np.r_[True, letter[:-1]] | np.r_[True, gap[:-1]])
    codes, doc, letter = codes[keep], doc[keep], letter[keep]
    has = np.bincount(doc[letter], minlength=len(texts))[: len(texts)] > 0
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if len(codes) < N:
        return out, has
    m = len(codes) - N + 1
    whole = doc[:m] == doc[N - 1 :]
    alphabet, index = np.unique(codes, return_inverse=True)
    key = np.zeros(m, np.int64)
    for k in range(N):
        key = key * len(alphabet) + index[k : k + m]
    key, of = key[whole], doc[:m][whole]
    grams, gram = np.unique(key, return_inverse=True)
    base = letter_vectors(alphabet)
    turned = [np.roll(base, N - 1 - k, axis=1) for k in range(N)]
    step = 4096
    counts = np.bincount(of * len(grams) + gram, minlength=len(texts) * len(grams)).astype(np.float32).reshape(len(texts), len(grams)) if len(grams) * len(texts) <= 1 << 24 else None
    for i in range(0, len(grams), step):
        part = grams[i : i + step]
        bound = np.ones((len(part), DIMENSIONS), np.int8)
        for k in range(N):
            bound *= turned[k][part // len(alphabet) ** (N - 1 - k) % len(alphabet)]
        if counts is not None:
            c = counts[:, i : i + step]
        else:
            hit = (gram >= i) & (gram < i + step)
            c = np.bincount(of[hit] * len(part) + gram[hit] - i, minlength=len(texts) * len(part)).astype(np.float32).reshape(len(texts), len(part))
        out += c @ bound.astype(np.float32)
    return out, has


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i - start == TEXTS or size and size + len(t) > CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    vectors: np.ndarray  # of length 1

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, cosine) of each text; unknown and 0 without a letter or without any profile."""
        v, has = vectors(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        length = np.linalg.norm(v, axis=1)
        cosine = v @ self.vectors.T / np.maximum(length, 1e-9)[:, None]
        best = cosine.argmax(1)
        value = np.where(has, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)
        return [self.languages[k] if h else UNKNOWN for k, h in zip(best, has, strict=True)], value.astype(float)


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Profiles:
    """Language vectors of about ``rows`` documents with a known language.

    Each task sums its texts; the sums are aggregated by language and dimension,
    so what reaches the driver is one vector a language.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, F.col(text).alias("text"), F.col(lang).alias("lang"))
    sample = hash_sample(known, key, sample_rate(known.select(key).count(), rows))

    def step(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, names = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in blocks(texts):
                v, _ = vectors(texts[i:j])
                v /= np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
                for name in set(names[i:j]):
                    part = v[[k for k, x in enumerate(names[i:j]) if x == name]].sum(0, dtype=np.float64)
                    sums[name] = sums.get(name, 0) + part
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(np.rint(v * 1e6).astype(np.int64))], ["lang", "d", "v"])

    got = sample.select("text", "lang").mapInArrow(step, "lang string, d int, v long").groupBy("lang", "d").agg(F.sum("v").alias("v")).collect()
    names = sorted({r.lang for r in got})
    table = np.zeros((len(names), DIMENSIONS), np.float32)
    for r in got:
        table[names.index(r.lang), r.d] = r.v
    return Profiles(names, table / np.maximum(np.linalg.norm(table, axis=1), 1e-9)[:, None])


def predict(df: DataFrame, model: Profiles, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of each row; ``und`` and 0 for a text that is null or has no letter."""

    def step(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in blocks(texts):
                names, cosine = model.predict(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(cosine)], [key, "lang_pred", "score"])

    return df.select(key, text).mapInArrow(step, f"`{key}` {dict(df.dtypes)[key]}, lang_pred string, score double")
