import random
import re
from hashlib import sha256

import pytest

from tessera.llm import spotsigs
from tessera.llm.queries import op6_spotsigs


def spots(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    content = [w for w in words if w not in spotsigs.ANCHORS]
    out, k = set(), 0
    for w in words:
        if w not in spotsigs.ANCHORS:
            k += 1
        elif k < len(content):
            out.add((w, *content[k : k + spotsigs.CHAIN]))
    return out or {("", *words[i : i + 2]) for i in range(len(words))} or ({text} if text else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        out[i] = (len(text), sha256(new.encode()).hexdigest(), jaccard(spots(text), spots(new)), jaccard(spots(text), spots(after)))
    return out


def test_op6_on_the_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 7)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op6_spotsigs(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, pytest.approx(r.near_edited), pytest.approx(r.near_next)) for r in got} == brute(rows)
    same = {}
    for r in got:
        same.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in same.values())


@pytest.mark.parametrize("size", [1, 2, 3, 40])
def test_next_rows_over_many_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 3)
    rnd = random.Random(size)
    ids = rnd.sample(range(-500, 500), size)
    rows = [(i, rnd.choice([None, "", "!!", "é", "the cat and a dog", f"the house of {i} is red " * rnd.randint(1, 3)])) for i in ids]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, signatures string, __range int")
    got = spotsigs.compare_with_edits(df).collect()
    want = brute(rows)
    assert len(got) == size
    for r in got:
        assert (len(r.text), sha256(r.edited.encode()).hexdigest()) == want[r.doc_id][:2]
        assert (r.near_edited, r.near_next) == (pytest.approx(want[r.doc_id][2]), pytest.approx(want[r.doc_id][3]))


def test_empty_table_and_repeated_or_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "c"), (3, None)], "doc_id long, text string")
    assert len(spotsigs.compare_with_edits(df).collect()) == 5
    assert spotsigs.compare_with_edits(df.limit(0)).count() == 0


def test_length_partitions_hold_similar_sets(spark):
    df = spark.range(1, 300).selectExpr("sequence(1, id) as a", "sequence(1, cast(ceil(id * 0.8) as bigint)) as b")
    r = df.select(spotsigs.length_partition("a").alias("x"), spotsigs.length_partition("b").alias("y")).collect()
    assert all(0 <= t.x - t.y <= 1 for t in r)


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("bcdfgh") for _ in range(4))
    docs = [" ".join(f"{rnd.choice(['the', 'of', 'and'])} {word()} {word()}" for _ in range(rnd.randint(3, 25))) for _ in range(60)]
    for _ in range(120):
        t = rnd.choice(docs).split(" ")
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = rnd.choice([word(), "the"])
        docs.append(" ".join(t))
    rows = [(i, t, 0) for i, t in enumerate([*docs, None, "", docs[0]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, found int")
    for threshold in (0.8, 0.6):
        member, links = spotsigs.near_duplicates(df, threshold=threshold)
        of = {r.doc_id: r.class_id for r in member.collect()}
        linked = {(r.a, r.b) for r in links.collect()}
        assert all(a < b for a, b in linked)
        sets = {i: spots(t) for i, t, _ in rows if t}
        assert set(of) == set(sets)
        for i in sets:
            for j in sets:
                if i < j:
                    a, b = sorted((of[i], of[j]))
                    assert ((a, b) in linked or a == b) == (jaccard(sets[i], sets[j]) >= threshold - 1e-12)
    assert spotsigs.near_duplicates(df.limit(0))[1].count() == 0


def test_equal_fingerprints_are_wholly_alike(spark, sf_dir):
    for r in op6_spotsigs(spark, sf_dir).collect():
        x, y = set(r.fingerprint.split()), set(r.edited_fingerprint.split())
        assert r.near_edited == pytest.approx(jaccard(x, y))
