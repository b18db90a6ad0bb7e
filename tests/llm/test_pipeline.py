import numpy as np
import pytest

import corpus_pipeline as cp
from tessera.llm import minhash_dedup
from tests.llm.test_bpe_packing import check_packing
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_suffix_dedup import brute as repeat_brute

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, f in cp.STAGES:
        f(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(stages):
    assert [s[0] for s in stages] == ["quality_classifier", "toxicity", "minhash_dedup", "suffix_dedup", "packing"]
    for _, _, after in stages[:-1]:
        assert after.columns == cp.COLUMNS and after.count() > 0


def test_filters_follow_the_labels(spark):
    larger = "/root/testdata/sf0.01"  # the smallest tables have too few toxic labels to learn from
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    for (_, f), wrong in zip(cp.STAGES[:2], (lambda r: r.quality == 0, lambda r: r.toxic == 1), strict=True):
        before, after = set(ids(docs)), set(ids(f(spark, docs, larger)))
        assert after <= before
        known = [i for i in before if i in labels]
        assert np.mean([(i not in after) == wrong(labels[i]) for i in known]) >= 0.9


def test_one_of_each_group_stays(stages):
    _, before, after = stages[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert ids(after) == sorted(i for i, _, _, kept in near_brute(rows, 5) if kept)


def test_near_duplicates_of_one_member_of_a_large_group_go(spark, sf_dir, monkeypatch):
    """Every third document is alike one member of the group only, which has to meet it in the children of large nodes."""
    monkeypatch.setattr(minhash_dedup, "SMALL", 32)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(400)]

    def edit(words, count, name):
        at = rng.integers(0, 400 - count)
        return [*words[:at], *(f"{name}x{i}" for i in range(count)), *words[at + count :]]

    texts = [edit(base, 1, f"o{k}") for k in range(120)]
    for k in range(60):
        member = edit(base, 16, f"m{k}")
        texts += [member, edit(member, 36, f"l{k}")]
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert ids(cp.drop_near_duplicates(spark, docs, sf_dir)) == sorted(i for i, _, _, kept in near_brute([r[:2] for r in rows], 5) if kept)


def test_repeated_passages_go(stages):
    _, before, after = stages[3]
    want = {i: n - gone for i, n, gone, _, _ in repeat_brute([(r.doc_id, r.text) for r in before.collect()])}
    got = {r.doc_id: r for r in after.collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert want[i] - 8 <= len(r.text.encode()) <= want[i] and r.n_chars == len(r.text)


def test_packing_and_the_whole_run(spark, sf_dir, stages):
    from tessera.llm.queries import tokenizer_path

    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    _, before, after = stages[4]
    docs = {r.doc_id: np.array([*t.encode(r.text, add_special_tokens=False).ids, 1]) for r in before.collect()}
    assert check_packing(after.collect(), docs) == 0
    parts = ["doc_id", "start", "length", "ids_crc32"]
    totals = lambda df: df.groupBy("doc_id").agg({"length": "sum"}).collect()
    assert sorted(map(tuple, totals(cp.run(spark, sf_dir).select(parts)))) == sorted(map(tuple, totals(after)))


def test_stages_take_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b", None, "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for _, f in cp.STAGES:
            assert f(spark, d, sf_dir).count() >= 0
