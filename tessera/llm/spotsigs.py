"""Document fingerprints from chains of content words after common words, in DataFrame operations only.

A common word (an anchor) and the content words that follow it, anchors left
out, make a signature.  A document's fingerprint is the set of its signatures:
boilerplate without running prose has few anchors and so weighs little.  Sets
are compared by Jaccard similarity; in the join of a whole table only sets in the
same or neighbouring partitions by length that share a rare signature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Common words of English, German, French and Spanish: the anchors.
ANCHORS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were "
    "der die und das ist nicht ein eine zu den mit sich des auf für im dem von als auch "
    "le la les de et un une est que qui dans pour du pas sur au par avec ce se "
    "el los las y en por con para es su al del lo como más o"
).split()
#: Content words in a chain.
CHAIN = 2
#: Rows in a range of ids that is ordered together, about, and the most ranges: their bounds are part of the plan, so beyond
#: ten million rows the ranges grow, and Spark's sort, which spills, orders more rows in each.
RANGE_ROWS, RANGES = 1_000, 10_000


def signatures(words: Column, anchors: Column, content: Column, text: Column) -> Column:
    """The sorted distinct signatures of a text, from columns that hold its words: 32-bit hashes, as the fingerprint shows them.

    The content words before the anchor number j, which is word number i, are
    i - j; so its chain is read off ``content`` by position.  A text without any
    such chain gets chains that start at each word, a text without words the
    hash of itself, an empty or null text nothing.
    """
    chain = lambda k: [F.get(content, k + n) for n in range(CHAIN)]
    spots = F.filter(
        F.transform(anchors, lambda a, j: F.when(F.get(content, a["i"] - j).isNotNull(), F.xxhash64(a["w"], *chain(a["i"] - j)))),
        lambda h: h.isNotNull(),
    )
    plain = F.transform(words, lambda w, i: F.xxhash64(F.lit(""), w, F.get(words, i + 1)))
    whole = F.when(text != "", F.array(F.xxhash64(F.lit("\n"), text))).otherwise(F.array().cast("array<bigint>"))
    found = F.when(F.size(spots) > 0, spots).when(F.size(words) > 0, plain).otherwise(whole)
    return F.sort_array(F.array_distinct(F.transform(found, lambda h: F.shiftrightunsigned(h, 32))))


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the signatures of one of its text columns as ``out``."""
    t = F.coalesce(F.col(text), F.lit(""))
    w, a, c = f"__{out}_words", f"__{out}_anchors", f"__{out}_content"
    cut = df.withColumn(w, F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    marked = cut.withColumns(
        {
            a: F.filter(F.transform(w, lambda x, i: F.when(x.isin(ANCHORS), F.struct(x.alias("w"), i.alias("i")))), lambda s: s.isNotNull()),
            c: F.filter(w, lambda x: ~x.isin(ANCHORS)),
        }
    )
    return marked.withColumn(out, signatures(F.col(w), F.col(a), F.col(c), t)).drop(w, a, c)


def fingerprint(found: Column | str) -> Column:
    """The set as text: each signature in hexadecimal."""
    return F.array_join(F.transform(found, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), " ")


def length_partition(found: Column | str, threshold: float = 0.8) -> Column:
    """Sets whose similarity reaches ``threshold`` lie in the same partition or in neighbouring ones."""
    return F.floor(F.log(F.greatest(F.size(found), F.lit(1)).cast("double")) / F.lit(-1.0) / F.log(F.lit(threshold))).cast("int")


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 1 for two empty ones.

    The sizes bound it: where the smaller set over the larger is under ``least``,
    or a set is empty, the sets are not intersected and the result is 0.
    """
    x, y = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    return (
        F.when((x == 0) & (y == 0), 1.0)
        .when((F.least(x, y) == 0) | (F.least(x, y) < least * F.greatest(x, y)), 0.0)
        .otherwise(both / (x + y - both))
    )


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(membership (key, class_id), links (a, b, likeness)) of texts whose fingerprints are at least ``threshold`` alike.

    Rows with equal fingerprints are one class, named by a hash of the fingerprint;
    links are between classes, a < b.  Classes are compared if they share one of
    the signatures that a set must share with any set so like it: its rarest ones,
    as many as it may lack and one more.  They are dealt out by signature and
    length partition, each class to its own and the next partition, so only sets
    of sizes that allow the threshold meet; the sizes themselves and the Jaccard
    similarity decide.  All links between classes are given, so a large group of
    texts that are all alike gives as many; ``minhash_dedup`` finds the groups
    alone.  Null and empty texts have no signature and no class; an
    empty table gives no rows.
    """
    marked = with_signatures(df.select(F.col(key), F.col(text).alias("__text")), "__text", "found").where(F.size("found") > 0)
    rows = marked.select(F.col(key), F.xxhash64("found").alias("class_id"), "found")
    classes = rows.groupBy("class_id").agg(F.first("found").alias("found"))
    single = classes.select("class_id", F.explode("found").alias("s"))
    ranked = single.join(single.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "s").groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("ranked"))
    size = F.size("ranked")
    must = (size - F.ceil(F.lit(threshold) * size - 1e-9) + 1).cast("int")
    held = ranked.select("class_id", size.alias("size"), F.explode(F.slice("ranked", F.lit(1), must)["s"]).alias("s"), length_partition("ranked", threshold).alias("part"))
    own = held.select("class_id", "size", "s", "part")
    both = held.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    a, b = own.alias("a"), both.alias("b")
    larger = (F.col("a.size") > F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.class_id") > F.col("b.class_id")))
    meet = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.part") == F.col("b.part")) & larger & (F.col("b.size") >= threshold * F.col("a.size") - 1e-9))
    pairs = meet.select(F.least("a.class_id", "b.class_id").alias("a"), F.greatest("a.class_id", "b.class_id").alias("b")).distinct()
    sets = lambda name, to: classes.select(F.col("class_id").alias(name), F.col("found").alias(to))
    near = pairs.join(sets("a", "x"), "a").join(sets("b", "y"), "b").select("a", "b", likeness("x", "y", threshold).alias("likeness"))
    return rows.select(key, "class_id"), near.where(F.col("likeness") >= threshold - 1e-12)


def id_ranges(df: DataFrame, key: str) -> tuple[Column, list]:
    """(number of the range of ids that a row lies in, largest id of each range).

    The bounds are quantiles, so ranges hold about equally many rows; a row
    finds its range in two steps of about the square root of their number.  Null
    ids lie in the lowest range.
    """
    n = df.count()
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    bounds = []
    if ranges > 1:
        cuts = [k / ranges for k in range(1, ranges)]
        bounds = sorted(set(df.agg(F.percentile_approx(key, cuts, 4 * ranges).alias("b")).first().b or []))
    step = max(1, int(len(bounds) ** 0.5))
    outer = bounds[::step][1:]
    inner = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    longs = lambda x: F.array(*map(F.lit, x)).cast("array<bigint>")
    below = lambda x: F.coalesce(F.size(F.filter(x, lambda b: b <= F.col(key))), F.lit(0))
    group = below(longs(outer))
    number = F.when(F.col(key).isNull(), 0).otherwise(group * step + below(F.get(F.array(*map(longs, inner)), group))).cast("int")
    largest = {r.r: r.m for r in df.groupBy(number.alias("r")).agg(F.max(key).alias("m")).collect()}  # a row for each range
    return number, [largest.get(i, False) for i in range(max(largest, default=0) + 1)]


def with_next(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text, signatures, next_text, next_signatures): beside each row the next one by descending key, after the last the first.

    The rows are shuffled once, by ranges of ids.  The first row of each range
    also goes to the range before it, so no range needs another.  Rows with the
    same key follow one another by the hash of their texts.
    """
    ids = df.select(F.col(key).cast("long").alias("__id"))
    number, largest = id_ranges(ids, "__id")
    used = [i for i, m in enumerate(largest) if m is not False]
    above = {r: used[(k + 1) % len(used)] for k, r in enumerate(used)}
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(key).cast("long").alias("__id")).withColumn("__range", number)
    tops = F.array(*[F.lit(m if m is not False else None) for m in largest] or [F.lit(None)]).cast("array<bigint>")
    ups = F.array(*[F.lit(above.get(i, i)) for i in range(len(largest))] or [F.lit(0)]).cast("array<int>")
    at = lambda r, copy: F.struct(r.alias("range"), F.lit(copy).alias("copy"))
    first = F.col("__id").eqNullSafe(F.get(tops, F.col("__range")))
    own = at(F.col("__range"), False)
    placed = rows.withColumn("__at", F.explode(F.when(first, F.array(own, at(F.get(ups, F.col("__range")), True))).otherwise(F.array(own))))
    dealt = placed.select(F.col(key), "text", "__id", F.col("__at.range").alias("__range"), F.col("__at.copy").alias("__copy")).repartition("__range")
    marked = with_signatures(dealt, "text", "signatures")
    order = Window.partitionBy("__range").orderBy("__copy", F.col("__id").desc_nulls_last(), F.xxhash64("text"))
    out = marked.withColumns({"next_text": F.lead("text").over(order), "next_signatures": F.lead("signatures").over(order)})
    return out.where(~F.col("__copy")).select(key, "text", "signatures", "next_text", "next_signatures")


def edited(text: str, following: str) -> Column:
    """The text with its last half, in code points and rounded down, replaced by as many of the following text's first."""
    n = F.char_length(text)
    half = (n / 2).cast("int")
    return F.concat(F.col(text).substr(F.lit(1), n - half), F.col(following).substr(F.lit(1), half))


def compare_with_edits(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text, edited, signatures, edited_signatures, near_edited, near_next) of each row.

    A null text counts as empty.  A table of one row has itself as the next; an
    empty table gives no rows.
    """
    beside = with_next(df, text, key).withColumn("edited", edited("text", "next_text"))
    both = with_signatures(beside.drop("next_text"), "edited", "edited_signatures")
    return both.withColumns(
        {"near_edited": likeness("signatures", "edited_signatures"), "near_next": likeness("signatures", "next_signatures")}
    ).drop("next_signatures")
