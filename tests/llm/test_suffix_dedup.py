import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from tessera.llm import suffix_dedup as sd
from tessera.llm.queries import op10_suffix_dedup


def brute(rows, length=200):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[k : k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        mask = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                mask[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(r)) if mask[k] and not (k and mask[k - 1]))
        out.append((i, len(r), sum(mask), spans, sha256(bytes(c for c, m in zip(r, mask, strict=True) if not m)).hexdigest()))
    return out


def planted(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("etaoinshrdlué") for _ in range(rnd.randint(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(rnd.randint(20, 70)) for _ in range(4)]
    docs = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.2 and docs:
            t = rnd.choice(docs)
            k = rnd.randrange(len(t) + 1)
            t = rnd.choice([t, t[:k] + word() + t[k:], t[k:], t[:k]])
        elif kind < 0.6:
            t = prose(rnd.randint(0, 50)) + " " + rnd.choice(shared)[rnd.randint(0, 40) :] + " " + prose(rnd.randint(0, 60))
        elif kind < 0.7:
            t = rnd.choice(["The ", "ab", "x"]) * rnd.randint(1, 200)
        else:
            t = prose(rnd.randint(0, 120))
        docs.append(t)
    return list(enumerate(docs))


def rows_of(df):
    return sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), sha256(r.kept).hexdigest()) for r in df.collect())


@pytest.mark.parametrize(("seed", "sizes"), [(0, sd.Sizes()), (1, sd.Sizes(50, 200, 300)), (2, sd.Sizes(7, 10, 64)), (3, sd.Sizes(1000, 100_000, 200))])
def test_equals_brute_force(spark, seed, sizes):
    """Small sizes: many batches and levels, families that are passed on within a task, texts of several segments."""
    rows = planted(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, doc int").repartition(3)
    assert rows_of(sd.remove_repeats(df, extra=("doc",), sizes=sizes)) == sorted(brute(rows))


def test_a_passage_in_most_documents(spark):
    """One frequent passage with different surroundings, and documents that are one long repetition."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    prose = lambda k: " ".join(word() for _ in range(k))
    passage = prose(60)
    rows = [(i, f"{prose(rnd.randint(5, 40))} {passage[rnd.randint(0, 60) :]} {prose(rnd.randint(5, 40))}") for i in range(120)]
    rows += [(200 + i, "ab " * (100 + i)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(sd.remove_repeats(df, sizes=sd.Sizes(500, 2000))) == sorted(brute(rows))


def test_op10_on_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in op10_suffix_dedup(spark, sf_dir).collect())
    assert got == sorted(brute(rows))


def test_nulls_repeats_and_empty_tables(spark):
    a, b = "".join(chr(97 + k * k % 23) + str(k) for k in range(120)), "é" * 99
    rows = [(1, a), (1, a), (1, b), (2, None), (3, ""), (4, b + b), (5, b + b), (None, "z" + a[:210]), (9, a[5:204])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: tuple(map(str, x))
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), sha256(r.kept).hexdigest()) for r in sd.remove_repeats(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_family_is_a_suffix_array_of_levels():
    rng, family, seen, settled = np.random.default_rng(1), sd.Family(3), Counter(), 0
    for _ in range(40):
        x = rng.integers(97, 101, (50, 3)).astype(np.uint8).view("S3").ravel()
        settled += len(family.add(x, np.arange(50)))
        seen.update(x.tolist())
        sizes = [len(k) for k, _, _ in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
        assert all((k[1:] > k[:-1]).all() for k, _, _ in family.levels)
    keys, n, _ = family.whole()
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == seen and keys.tolist() == sorted(seen)
    assert settled + len(keys) == 2000
    lone = np.array([b"aaa", b"aab", b"abc", b"bbb", b"bbc"])
    assert sd.sharing(lone, 2).tolist() == [True, True, False, True, True] and sd.sharing(lone[:0], 2).tolist() == []
