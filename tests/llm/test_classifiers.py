import numpy as np
import pytest

from tessera.llm import language, quality_ranking, toxicity
from tessera.llm.queries import op4_quality_classifier, op5_language_id, op7_toxicity

LARGER = "/root/testdata/sf0.01"


def held_out(spark, query, label):
    got = {r.doc_id: r for r in query(spark, LARGER).collect()}
    assert len(got) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").collect()
    return [(got[r.doc_id].predicted, r[label]) for r in labels if got[r.doc_id].held_out]


def test_op4_on_held_out_labels(spark):
    pairs = held_out(spark, op4_quality_classifier, "quality")
    assert np.mean([p == y for p, y in pairs]) >= 0.95


def test_op7_on_held_out_labels(spark):
    pairs = held_out(spark, op7_toxicity, "toxic")
    assert np.mean([p == y for p, y in pairs]) >= 0.9


def test_op5_on_held_out_languages(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    got = op5_language_id(spark, LARGER).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) >= 0.98


def odd(spark):
    return spark.createDataFrame(
        [(1, None, "en", 1), (2, "", None, 0), (3, "12 .. !?", "en", None), (None, "the cat and the dog", "en", 1), (5, "der hund und die katze", "de", 0), (5, "der hund und die katze", "de", 0), (7, "x" * 200_000, "en", 1)],
        "doc_id long, text string, lang string, score int",
    )


def test_odd_rows_of_the_classifiers(spark):
    df = odd(spark)
    labels = spark.createDataFrame([(5, 0), (5, 1), (1, 1), (2, 0), (7, 0), (None, 1), (3, None)], "doc_id long, y int")
    ranking = quality_ranking.fit(df, labels, "y")
    assert len([r for r in quality_ranking.score(df, ranking).collect() if 0 <= r.score <= 1]) == 7
    tox = toxicity.fit(df, labels, "y")
    assert len([r for r in toxicity.score(df, tox).collect() if 0 <= r.score <= 1]) == 7
    none = labels.limit(0)
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, none, "y")).collect()} == {0.5}
    assert quality_ranking.score(df.limit(0), quality_ranking.fit(df, none, "y")).count() == 0


def test_odd_rows_of_the_languages(spark):
    df = odd(spark)
    got = sorted((r.lang_pred, r.score > 0) for r in language.predict(df, language.fit(df)).collect())
    assert got[-3:] == [("und", False)] * 3 and got[:2] == [("de", True)] * 2
    assert {r.lang_pred for r in language.predict(df, language.fit(df.limit(0))).collect()} == {"und"}


def test_vectors_are_the_sums_of_bound_letters():
    text = "ab cab"
    v, has = language.vectors([text, "!!", ""])
    base = {c: language.letter_vectors(np.array([ord(c)]))[0].astype(int) for c in "abc "}
    s, want = f" {text} ", np.zeros(language.DIMENSIONS)
    for i in range(len(s) - 2):
        want += np.roll(base[s[i]], 2) * np.roll(base[s[i + 1]], 1) * base[s[i + 2]]
    assert np.array_equal(v[0], want) and has.tolist() == [True, False, False]


def test_pairs_order_the_scores():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(quality_ranking.FIGURES)))
    y = (x[:, 3] - x[:, 7] + 0.1 * rng.normal(size=500) > -1).astype(int)
    m = quality_ranking.fit_pairs(x, y, 0.3)
    assert np.mean((m.probability(x) >= 0.3) == y) > 0.97


@pytest.mark.parametrize("wanted", [None, True])
def test_present_counts_each_bucket_once(wanted):
    mask = np.ones(1 << toxicity.BITS, bool) if wanted else None
    doc, bucket = toxicity.present(["abcabcabc", "", "abca"], mask)
    assert len(set(zip(doc.tolist(), bucket.tolist(), strict=True))) == len(doc)
    assert set(bucket[doc == 2]) <= set(bucket[doc == 0]) and not (doc == 1).any()


def test_texts_without_letters_at_any_code_point(spark):
    """Symbols and emoji beyond the first plane are no letters; letters there are."""
    df = spark.createDataFrame([(1, "the cat", "en", 1), (2, "\U0001f600\U0001f680 \U0001f4a9", None, 2), (3, "\U00020000\U00020001", None, 3), (4, "\u2603 \u20ac 12", None, 4)], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(df, language.fit(df)).collect()}
    assert got[2] == got[4] == ("und", 0.0) and got[1][0] == got[3][0] == "en"
    assert language.predict(df.limit(0), language.fit(df)).count() == 0
    assert toxicity.score(df.limit(0), toxicity.fit(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, y int"), "y")).count() == 0


def test_a_batch_of_long_texts(spark):
    """Twelve texts of half a million characters beside short ones."""
    rows = [(i, "the cat and the dog " * 25_000, "en") for i in range(12)] + [(50, "der hund", "de"), (51, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, y int")
    assert {r.lang_pred for r in language.predict(df, language.fit(df)).collect() if r.doc_id < 12} == {"en"}
    assert toxicity.score(df, toxicity.fit(df, labels, "y")).count() == quality_ranking.score(df, quality_ranking.fit(df, labels, "y")).count() == 14


def test_rare_toxic_wording_has_weight(spark):
    """A word in four toxic texts of a tenth, and in no other."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("aeioutnrs"), 5))
    clean = [" ".join(word() for _ in range(30)) for _ in range(400)]
    rows = [(i, t, int(i % 10 == 0)) for i, t in enumerate(clean)]
    rows = [(i, t + (" zwqxk" if y and i < 40 else " vbhjp" if y else ""), y) for i, t, y in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.fit(df, df.select("doc_id", "y"), "y")
    seen = toxicity.score(spark.createDataFrame([(1, clean[1] + " zwqxk zwqxk"), (2, clean[1])], "doc_id long, text string"), model).collect()
    assert seen[0].score > 2 * seen[1].score
