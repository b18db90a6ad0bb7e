import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash_dedup as md
from tessera.llm.components import components
from tessera.llm.queries import op2_minhash_dedup


def sets(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k=4, percent=80):
    s = [sets(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    by = {}
    for i, x in enumerate(s):
        for g in x:
            by.setdefault(g, []).append(i)
    for i, x in enumerate(s):
        for j in {j for g in x for j in by[g] if j < i}:
            both = len(x & s[j])
            if 100 * both >= percent * (len(x) + len(s[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def rows_of(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def planted(seed, n=150, copies=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    docs = [[word() for _ in range(rnd.randint(0, 120))] for _ in range(n)]
    base = [word() for _ in range(100)]
    for _ in range(copies):
        t = list(base)
        for _ in range(rnd.randint(0, 5)):
            t[rnd.randrange(len(t))] = word()
        docs.append(t)
    for _ in range(n):
        t = list(rnd.choice(docs))
        for _ in range(rnd.randint(0, 3)):
            if t:
                t[rnd.randrange(len(t))] = word()
        docs.append(t)
    rnd.shuffle(docs)
    return [(7 * i - 300, rnd.choice([" ", "\n", "  "]).join(t)) for i, t in enumerate(docs)]


@pytest.mark.parametrize("small", [256, 24])
def test_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(md, "SMALL", small)
    rows = planted(small)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string")
    assert rows_of(md.near_duplicates(df, words=4)) == brute(rows)


def test_recall_in_large_nodes(spark, monkeypatch):
    """Each passage (a word here) is in about 100 of the documents, so the roots of all trees are large nodes: at least 0.99 of the links' components."""
    monkeypatch.setattr(md, "SMALL", 16)
    rnd, docs = random.Random(5), []
    for _ in range(1000):
        held = rnd.sample(range(600), 30)
        docs += [held, held[:27] + rnd.sample(range(600), 3)]
    rows = [(i, " ".join(f"p{p}" for p in d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, wanted = rows_of(md.near_duplicates(df, words=1)), brute(rows, 1)
    linked = [w for w in wanted if not w[3]]
    assert len(set(got) & set(linked)) >= 0.99 * len(linked) > 900
    assert {g[0] for g in got if not g[3]} <= {w[0] for w in linked}


def test_edits_of_one_text_that_are_not_alike_themselves(spark, monkeypatch):
    """A star: every edit is alike the original only, in a node far beyond the small ones."""
    monkeypatch.setattr(md, "SMALL", 16)
    rnd = random.Random(7)
    base = [f"w{i}" for i in range(400)]
    docs = [base]
    for k in range(300):
        at = set(rnd.sample(range(400), 40))
        docs.append([f"e{k}x{i}" if i in at else w for i, w in enumerate(base)])
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = rows_of(md.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1))
    assert got == brute(rows, 1) and sum(g[2] == 0 for g in got) > 295


def test_links_with_one_member_of_a_large_group(spark, monkeypatch):
    """Every third document is alike one member of the group only, not its centre: the member has to meet it in the children."""
    monkeypatch.setattr(md, "SMALL", 32)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(400)]

    def edit(words, count, name):
        at = set(rnd.sample(range(400), count))
        return [f"{name}x{i}" if i in at else w for i, w in enumerate(words)]

    docs = [edit(base, 2, f"o{k}") for k in range(150)]
    for k in range(75):
        member = edit(base, 20, f"m{k}")
        docs += [member, edit(member, 40, f"l{k}")]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    assert rows_of(md.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1)) == brute(rows, 1)


def test_two_large_groups_that_are_nearly_alike(spark, monkeypatch):
    """Their classes meet in all children, so nodes end in cells; one pair links them."""
    monkeypatch.setattr(md, "SMALL", 16)
    rnd = random.Random(10)
    base = [f"w{i}" for i in range(400)]
    other = [f"v{i}" if i < 47 else w for i, w in enumerate(base)]
    docs = [[f"e{k}x{i}" if i == at else w for i, w in enumerate(words)] for words in (base, other) for k in range(90) for at in [rnd.randrange(400)]]
    apart = [(i, " ".join(d)) for i, d in enumerate(docs)]
    bridge = [(900, " ".join(base[:20] + other[20:]))]
    for rows, groups in ((apart, 2), (apart + bridge, 1)):
        got = rows_of(md.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1))
        assert got == brute(rows, 1) and len({g[2] for g in got}) == groups


@pytest.mark.parametrize(("mains", "rest"), [(0, 9), (30, 3), (5, 25), (40, 23), (1, 8)])
def test_cells_hold_each_pair_once(spark, monkeypatch, mains, rest):
    monkeypatch.setattr(md, "SMALL", 8)
    rows = [(1, i, -1 if i < mains else None, i < mains, mains + rest, rest) for i in range(mains + rest)]
    df = spark.createDataFrame(rows, "node long, doc long, label long, main boolean, n long, rest long")
    cells = {}
    for r in md.dealt(df).collect():
        cells.setdefault(r.cell, []).append(r)
    met = []
    for cell in cells.values():
        left, right = [r.doc for r in cell if not r.right], [r.doc for r in cell if r.right]
        met += [tuple(sorted((a, b))) for a in left for b in right]
        if cell[0].own:
            met += [(a, b) for a in left for b in left if a < b]
    assert sorted(met) == [(a, b) for a in range(mains + rest) for b in range(a + 1, mains + rest) if b >= mains]


def test_a_common_template_makes_no_candidates(spark):
    """Documents that are 0.3 alike, with no link: nothing is left to confirm."""
    rnd = random.Random(6)
    template = [f"t{i}" for i in range(46)]
    rows = [(i, " ".join(template + [f"u{i}x{k}" for k in range(54)])) for i in range(1500)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "key long, text string")
    base = md.written(md.sketches(df.select("text", F.col("key").alias("row")), 1))
    classes = base.select(F.col("row").alias("doc"), "n", "tokens", "sketch")
    tried = []
    whole = md.confirm
    try:
        md.confirm = lambda pairs, *rest: tried.append(pairs.count()) or whole(pairs, *rest)
        assert md.linked_classes(base, classes, 1, 80).count() == 0
    finally:
        md.confirm = whole
    assert sum(tried) <= len(rows)


@pytest.mark.parametrize(("small", "room"), [(1024, 1_000_000), (32, 1_000_000), (1024, 20_000)])
def test_a_group_that_is_nearly_alike_makes_no_row_for_each_pair(spark, monkeypatch, small, room):
    """Its members are candidates in all their pairs and none are linked, but every twentieth has a partner in it."""
    monkeypatch.setattr(md, "SMALL", small)
    monkeypatch.setattr(md, "ROOM", room)
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(400)]

    def edit(words, count, name):
        at = set(rnd.sample(range(400), count))
        return [f"{name}x{i}" if i in at else w for i, w in enumerate(words)]

    docs = [edit(base, 28, f"o{k}") for k in range(300)]
    docs += [edit(docs[k], 36, f"p{k}") for k in range(0, 300, 20)]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    tried, whole = [], md.confirm
    monkeypatch.setattr(md, "confirm", lambda pairs, *rest: tried.append(pairs.count()) or whole(pairs, *rest))
    got = rows_of(md.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1))
    assert got == brute(rows, 1) and sum(not g[3] for g in got) == 15
    assert sum(tried) <= 10 * len(rows)


def test_intersections_of_a_cell(monkeypatch):
    rng = np.random.default_rng(13)
    sets_ = [np.unique(rng.integers(0, 90, rng.integers(1, 80))) for _ in range(40)]
    start = np.r_[0, np.cumsum([len(x) for x in sets_])]
    to = rng.permutation(40)[:33]
    for room in (1, 50, 1_000_000):
        monkeypatch.setattr(md, "ROOM", room)
        assert md.in_both(np.concatenate(sets_), start, 90, 7, to).tolist() == [len(np.intersect1d(sets_[7], sets_[j])) for j in to]


def test_strongest_candidates_connect_what_agrees():
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 256, (6, md.SLOTS))
    sketch = np.array([np.where(rng.random(md.SLOTS) < rng.choice([0.5, 0.8, 0.97]), c, rng.integers(0, 256, md.SLOTS)) for c in centres for _ in range(30)], np.uint8)
    sure, size = md.enough(80), np.full(len(sketch), 9)
    label = np.arange(len(sketch))
    for i, j in md.strongest(sketch, size, 80, sure):
        label[label == label[j]] = label[i]
    agree = (sketch[:, None] == sketch[None]).sum(2)
    assert all(label[i] == label[j] for i, j in np.argwhere(agree >= sure))
    assert len(np.unique(label)) > 6


def test_long_texts_are_hashed_in_parts(monkeypatch):
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 40))) for _ in range(500))
    whole = md.shingles(text, 5)
    for size in (1, 7, 100, 3000):
        monkeypatch.setattr(md, "SEGMENT", size)
        assert np.array_equal(md.shingles(text, 5), whole)
    assert len(whole) == 496


def test_recall_over_the_levels():
    assert md.lost(0.8, 0) == pytest.approx(0.2**12, rel=1e-6)
    assert md.lost(0.8, 3) < 5e-5 and md.lost(0.8, 20) < 3e-3 and md.lost(0.9, 20) < 1e-5


def test_null_and_repeated_ids_and_clashing_columns(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(None, " ".join(words), 1, "a"), (None, near, 2, "b"), (7, " ".join(reversed(words)), 3, "c"), (7, near, 4, "d"), (7, near, 4, "d"), (None, None, 5, "e"), (None, "", 6, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, n string")
    got = md.near_duplicates(df, extra=("row", "n")).collect()
    assert sorted((r.doc_id or -1, r.row, r.n, r.component_id or -1, r.kept) for r in got) == [
        (-1, 1, "a", 7, False), (-1, 2, "b", 7, False), (-1, 5, "e", -1, True), (-1, 6, "f", -1, True), (7, 3, "c", 7, True), (7, 4, "d", 7, True), (7, 4, "d", 7, True),
    ]
    assert sorted(r.row for r in got if r.representative) == [3, 4, 5, 6]


def test_op2_on_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(op2_minhash_dedup(spark, sf_dir)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, "A b"), (2, "a  b"), (3, ""), (4, None), (5, " \n"), (1, "A b"), (6, "É x"), (7, "é x"), (8, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(md.near_duplicates(df)) == brute(rows, 5)
    assert md.near_duplicates(df.limit(0)).count() == 0
    lone = spark.createDataFrame([(None, "q r s"), (9, "t u v")], "doc_id long, text string")
    assert sorted(r.kept for r in md.near_duplicates(lone).collect()) == [True, True]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (129, 90)]
    got = {r.id: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in [90, *range(100, 130)]} == {90} and 200 not in got


def test_labels_of_few_links_take_few_tasks(spark):
    """Where many shuffle partitions are not coalesced, rounds over small labels don't run and write all of them again and again."""
    many = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    links = md.written(spark.createDataFrame([(500, i) for i in range(2, 900)] + [(1000, 1001)], "a long, b long").coalesce(2))
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("labels of few links", "")
        got = {(r.id, r.label) for r in components(links).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {(i, 2) for i in range(2, 900)} | {(1000, 1000), (1001, 1000)}
    tracker = spark.sparkContext.statusTracker()
    stages = {i for job in tracker.getJobIdsForGroup("labels of few links") for i in tracker.getJobInfo(job).stageIds}
    assert sum(tracker.getStageInfo(i).numCompletedTasks for i in stages) < 600
