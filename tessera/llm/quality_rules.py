"""Quality by weak supervision, in DataFrame operations only.

Rules look at counts of a text and vote good (1), bad (-1) or abstain (0) between
the two.  How far each rule is to be trusted is not set but estimated:
expectation-maximisation over the counts of vote patterns (at most three to the
power of the rules, so a bounded table) gives each rule's accuracy on good and on
bad documents and the share of good ones.  No estimate is bounded: as the rules
overlap, the patterns in which they agree and differ tell which to trust.  The
posterior probability of good quality then decides, instead of every rule having
to pass: a stray bad vote of a rule that is often wrong is overruled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÈÉÊËÎÏÔÙÛÁÍÓÚÑ"
ENDS = ".!?"
#: What the estimate starts from: the share of good documents, and every rule's accuracy in both classes.
SHARE, ACCURACY = 0.8, 0.8
#: Column names of the counts that ``counts`` adds.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, letters: str) -> Column:
    return F.char_length(F.translate(text, letters, ""))


def counts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, counts) of each row; a null text has no words, lines or characters.

    Words are runs of characters other than ASCII white space.  Words in windows
    of three that occur twice or more are found by sorting the windows' 64-bit
    hashes within the row, and only in rows where two hashes agree; nothing
    leaves the row, so a text costs n log n whatever it repeats.
    """
    t = F.coalesce(F.col("__text"), F.lit(""))
    full = F.char_length(t)
    first = df.select(F.col(key), F.col(text).alias("__text")).select(
        key,
        F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(t, "\n"), lambda s: F.translate(s, WHITE, "") != "").alias("lines"),
        _without(t, WHITE).cast("long").alias("word_chars"),
        (full - _without(t, SYMBOLS)).cast("long").alias("n_symbols"),
        (full - _without(t, UPPER)).cast("long").alias("n_upper"),
        (full - _without(t, ENDS)).cast("long").alias("n_ends"),
    )
    n = F.size("words")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    second = first.select(
        key,
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        "n_upper",
        "n_ends",
        F.when(n >= 3, windows).alias("windows"),
    )
    third = second.withColumn(
        "found",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("windows")
    same = lambda p, k: F.coalesce(F.get("found", k)["h"] == p["h"], F.lit(False))
    fourth = third.withColumn("starts", F.sort_array(F.transform(F.filter("found", lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"]))).drop("found")
    covered = F.aggregate(
        F.transform("starts", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - s, F.lit(3)))),
        F.lit(0),
        lambda a, b: a + b,
    )
    return fourth.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def _vote(bad: Column, good: Column) -> Column:
    """-1, 1 or 0; null shares (no words) abstain."""
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """The votes, by name: each rule calls what is far from running prose bad, what is like it good, and abstains between.

    Shares are of the number of words, which may be 0: then null.
    """
    words = F.nullif(F.col("n_words"), F.lit(0))
    share = lambda c: F.col(c) / words
    length, case = share("word_chars"), F.col("n_upper") / F.nullif(F.col("word_chars"), F.lit(0))
    lines = F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0))
    return {
        "symbols": _vote(share("n_symbols") > 0.1, share("n_symbols") < 0.02),
        "length": _vote((length < 4.2) | (length > 6.8), (length > 4.5) & (length < 6.2)),
        "variety": _vote((share("n_distinct") < 0.55) & (F.col("n_words") < 2000), share("n_distinct") > 0.68),
        "case": _vote((case < 0.012) | (case > 0.35), (case > 0.013) & (case < 0.15)),
        "repeats": _vote(share("n_repeat_words") > 0.2, share("n_repeat_words") < 0.03),
        "lines": _vote((F.col("n_dup_lines") >= 2) & (lines > 0.15), F.col("n_dup_lines") == 0),
        "ends": _vote((share("n_ends") < 0.03) | (share("n_ends") > 0.3), (share("n_ends") > 0.05) & (share("n_ends") < 0.15)),
    }


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 500) -> tuple[float, list[tuple[float, float]]]:
    """(share of good documents, accuracy of each rule on (bad, good)) by expectation-maximisation.

    Abstentions carry no evidence.  All counts are smoothed by one vote each way.
    The start, where every rule is more often right than wrong, fixes which of the
    two classes is the good one.
    """
    k = len(next(iter(patterns), ()))
    total = sum(patterns.values())
    prior, accuracy = SHARE, [(ACCURACY, ACCURACY)] * k
    for _ in range(rounds if total else 0):
        right = [[1.0, 1.0] for _ in range(k)]
        votes = [[2.0, 2.0] for _ in range(k)]
        good = 1.0
        for votes_of, n in sorted(patterns.items()):
            p = posterior(votes_of, prior, accuracy)
            good += n * p
            for j, v in enumerate(votes_of):
                if v:
                    votes[j][0] += n * (1 - p)
                    votes[j][1] += n * p
                    right[j][v > 0] += n * (p if v > 0 else 1 - p)
        new = [tuple(r / m for r, m in zip(right[j], votes[j], strict=True)) for j in range(k)]
        moved = max((abs(a - b) for x, y in zip(new, accuracy, strict=True) for a, b in zip(x, y, strict=True)), default=0.0)
        prior, accuracy = good / (total + 2), new
        if moved < 1e-9:
            break
    return prior, accuracy


def weights(prior: float, accuracy: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """(log-odds before any vote, log-odds that each rule's (bad, good) vote adds)."""
    return math.log(prior / (1 - prior)), [(math.log((1 - g) / b), math.log(g / (1 - b))) for b, g in accuracy]


def posterior(votes: tuple[int, ...], prior: float, accuracy: list[tuple[float, float]]) -> float:
    odds, each = weights(prior, accuracy)
    odds += sum(w[v > 0] for v, w in zip(votes, each, strict=True) if v)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def score(df: DataFrame, text: str = "text", key: str = "doc_id", keep_from: float = 0.5) -> DataFrame:
    """(key, counts, base_failed, good_probability, kept) of each row.

    ``base_failed``: fewer than 50 words, or more than half of the words in
    repeated windows.  Such rows are not kept, nor are rows whose posterior is
    under ``keep_from``.  The estimate rests on all rows that pass the base.  An empty table gives no rows; repeated rows are counted
    and returned as often as they occur.  The counts are written to the
    checkpoint folder once, as both the estimate and the result need them.
    """
    named = rules()
    voted = checkpointed(counts(df, text, key).select(key, *COUNTS, *[v.alias(f"vote_{k}") for k, v in named.items()]))
    columns = [f"vote_{k}" for k in named]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    patterns = {tuple(r[:-1]): r[-1] for r in voted.where(~failed).groupBy(*columns).count().collect()}  # at most 3 ** len(rules) rows
    before, each = weights(*estimate(patterns)) if patterns else (0.0, [(0.0, 0.0)] * len(columns))
    odds = F.lit(before)
    for c, (bad, good) in zip(columns, each, strict=True):
        odds = odds + F.when(F.col(c) < 0, bad).when(F.col(c) > 0, good).otherwise(0.0)
    probability = 1 / (1 + F.exp(-odds))
    return voted.select(
        key,
        *COUNTS,
        failed.alias("base_failed"),
        (~failed & (probability >= keep_from)).alias("kept"),
        probability.alias("good_probability"),
        *columns,
    )
