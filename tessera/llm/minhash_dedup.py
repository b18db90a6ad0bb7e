"""Near-duplicates by a chosen-path similarity join on MinHash tokens.

Documents with the same shingle set are one class from the start, so copies are
never compared.  Independent trees branch the classes by selected minwise
tokens: a node holds the classes that agree on all tokens of its path.  Small
nodes are compared exhaustively by sketches of 128 slots; pairs that agree in
enough slots are candidates, and every link rests on the full shingle sets.

What is linked already is not compared again: the links of each level give labels,
and classes of one label are connected.  All other pairs of a node are compared in
it or go on to its children together; no class is left out.

* In a node of one cell the strongest candidates that connect it are confirmed first.
  Only where one of them fails, or in nodes of more cells, are all candidates compared,
  as far as they would connect what is still apart, each pair once for all nodes.
  Edits of one text that are not alike themselves are candidates in all their pairs,
  so these make no rows: the full sets of the classes that have candidates go
  to the cells, and a cell gives its links only, one less than its classes at most.
* A node is small by the classes outside its commonest label.  Those are compared
  with all of that label, however many they are, dealt into cells of a bounded size.
* In a large node a central class, that which agrees best with the usual tokens
  outside the commonest label, is compared with the strongest candidate of each
  other label.  If the node is still large by the new labels, it branches, with all
  its classes.  A child that keeps almost all of its parent (``KEPT``) is not
  branched any more, as that would save nothing, but compared in cells.

Classes that share a template, but not enough to be alike, are candidates of
nothing; they part by the tokens that they don't share.

A large node branches by one slot of the sketch that its name draws, and for one
half of the tokens also by a second one: 1.5 children for each class, of which a
pair at similarity 0.8 shares 1.2.  Trees and nodes draw independently.
``lost`` gives the probability that such a pair shares no node that is compared,
in any tree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.anchors import Hasher
from tessera.llm.common import whole_groups, written
from tessera.llm.components import components

TREES, SLOTS = 12, 128
#: Classes outside a node's commonest label up to which it is compared exhaustively, and classes of either side of a cell.
SMALL = 1024
#: Share of its parent's classes outside the commonest label from which on a child is compared exhaustively: two children of more than sqrt(2/3) make more pairs, not fewer.
KEPT = 0.8
#: Classes of a large node that its usual tokens are read off.
SEEN = 64
#: Shingles of full sets on either side of a cell, about.
ROOM = 1_000_000
#: Probability that a pair at the wanted similarity agrees in too few slots to be a candidate, at most.
MISSED = 1e-5
#: Bytes of a text whose words are hashed together.
SEGMENT = 1_000_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MULTIPLY = np.random.Generator(np.random.PCG64(3)).integers(1, 1 << 63, SLOTS, dtype=np.uint64) | np.uint64(1)
ADD = np.random.Generator(np.random.PCG64(4)).integers(0, 1 << 63, SLOTS, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words, of the whole sequence; of none, nothing."""
    raw = (text or "").encode().translate(LOWER)
    flat = np.frombuffer(raw, np.uint8)
    word = ~((flat == 32) | ((flat >= 9) & (flat <= 13)))
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    part = np.flatnonzero(np.diff(start // SEGMENT, prepend=-1))  # words are hashed in parts, so that tables stay small
    h = np.concatenate([Hasher(flat[start[i] : end[j - 1]]).slices(start[i:j] - start[i], end[i:j] - start[i]) for i, j in zip(part, [*part[1:], len(start)], strict=True)])
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def least(found: np.ndarray) -> np.ndarray:
    """The minwise token of each slot."""
    out = np.full(SLOTS, np.uint64(2**64 - 1))
    for i in range(0, len(found), 1024):
        part = found[None, i : i + 1024] * MULTIPLY[:, None] + ADD[:, None]
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(out, part.min(1), out=out)
    return out


def enough(percent: int) -> int:
    """The agreeing slots from which on a pair is a candidate: at this similarity fewer agree with a probability of ``MISSED`` at most."""
    s, below = percent / 100, 0.0
    for k in range(SLOTS + 1):
        below += comb(SLOTS, k) * s**k * (1 - s) ** (SLOTS - k)
        if below > MISSED:
            return k
    return SLOTS


def lost(similarity: float, levels: int) -> float:
    """The probability that a pair of this similarity shares no node after so many levels of large nodes, in any tree."""
    weigh = lambda n, k: comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
    total, rest = 0.0, SLOTS - TREES
    for c in range(rest + 1):
        q, ends = c / rest, 0.0
        for _ in range(levels):
            ends = (1 - q + q * ends) * (1 - q / 2 + q / 2 * ends)
        total += weigh(rest, c) * sum(weigh(TREES, a) * ends**a for a in range(TREES + 1))
    return total


def sketches(df: DataFrame, words: int) -> DataFrame:
    """Rows (text, ...) with n, d1, d2, tokens and sketch of their texts; equal sets have equal digests (d1, d2)."""

    def step(batches):
        for b in batches:
            n, d1, d2, tokens, sketch = [], [], [], [], []
            for t in b.column(0):
                s = shingles(t.as_py(), words)
                low = least(s)
                n.append(len(s))
                d1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                d2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                tokens.append(low[:TREES].view(np.int64))
                sketch.append(mix(low).astype(np.uint8).tobytes())
            new = [pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "n", "d1", "d2", "tokens", "sketch"])

    new = T.StructType.fromDDL("n long, d1 long, d2 long, tokens array<long>, sketch binary")
    return df.mapInArrow(step, T.StructType([*df.schema.fields, *new.fields]))


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """(doc, found) of texts (doc, text): their whole shingle sets."""

    def step(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), words).tobytes() for t in b.column(1)], pa.binary())], ["doc", "found"])

    return texts.select("doc", "text").mapInArrow(step, "doc long, found binary")


def bytes_of(column: pa.Array) -> np.ndarray:
    """Sketches of a column as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SLOTS)


def near_size(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be alike at all."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


# -- exact confirmation ---------------------------------------------------------


def texts_for(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts (doc, text) of ``ids`` (doc), columns of a written table: Spark knows its size and broadcasts them where they are few."""
    return texts.join(ids.distinct(), "doc", "left_semi")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, linked) of pairs (a, b): whether the full sets of their texts (doc, text) are alike.

    Two joins bring the texts to the pairs, of ``texts`` only those that are in
    pairs; a pivot that is in many pairs is a skewed key that adaptive execution splits.  Pairs are compared one by one as
    they arrive, and the set of the last pivot is kept.
    """

    def step(batches):
        last, mine = None, None
        for b in batches:
            found = []
            for x, t, u in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if x != last:
                    last, mine = x, shingles(t.as_py(), words)
                other = shingles(u.as_py(), words)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                found.append(100 * both >= percent * (len(mine) + len(other) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.bool_())], ["a", "b", "linked"])

    pairs = written(pairs)
    texts = texts_for(pairs.select(F.explode(F.array("a", "b")).alias("doc")), texts)
    second = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("u")), "b")
    both = second.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("t")), "a")
    return both.select("a", "b", "t", "u").mapInArrow(step, "a long, b long, linked boolean")


# -- nodes ------------------------------------------------------------------------


def sized(rows: DataFrame, labels: DataFrame | None, *columns: str) -> DataFrame:
    """Rows (node, doc, of, columns) with label (null: none but itself), main (whether that is the node's commonest) and the numbers n, of the node's rows, and rest, of those that are not main.

    Nodes of one label are left out.  ``labels`` (id, label) are of what is linked.
    """
    if labels is None:
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return rows.join(sizes, "node").select("node", "doc", "of", F.lit(None).cast("long").alias("label"), F.lit(False).alias("main"), "n", F.col("n").alias("rest"), *columns)
    marked = rows.join(labels.withColumnRenamed("id", "doc"), "doc", "left")
    each = marked.groupBy("node", F.coalesce("label", "doc").alias("label")).agg(F.count(F.lit(1)).alias("m"))
    sizes = each.groupBy("node").agg(F.sum("m").alias("n"), F.max(F.struct("m", "label")).alias("most"))
    sizes = sizes.select("node", "n", (F.col("n") - F.col("most.m")).alias("rest"), F.col("most.label").alias("commonest")).where("rest > 0")
    return marked.join(sizes, "node").select("node", "doc", "of", "label", (F.coalesce("label", "doc") == F.col("commonest")).alias("main"), "n", "rest", *columns)


def dealt(nodes: DataFrame, *columns: str, fits: Column | None = None) -> DataFrame:
    """Rows of ``sized`` nodes to rows (cell, node, doc, label, main, right, own, columns) of cells; each pair that is not main on both sides meets in one cell.

    In a cell the left rows are compared with the right ones, and with each other
    if the cell is their ``own``.  Most nodes are one cell.  In others the main rows and the rest
    are dealt into parts of about ``SMALL``, or what ``fits``; a cell has a part of the rest on its
    left and one of either on its right.
    """
    label, fits = F.coalesce("label", "doc").alias("label"), F.lit(SMALL) if fits is None else fits
    one = (F.col("rest") <= fits) & (F.col("n") - F.col("rest") <= fits)
    parts = lambda count: F.greatest(F.ceil(count / fits), F.lit(1)).cast("int")
    many = nodes.withColumn("mains", parts(F.col("n") - F.col("rest"))).withColumn("others", parts(F.col("rest")))
    many = many.withColumn("part", F.pmod(F.xxhash64("doc", "node"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    place = lambda left, right, side: F.struct(left.cast("int").alias("left"), right.cast("int").alias("place"), side.alias("right"))
    up_to = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    mine, shift = F.col("part"), F.col("mains")
    of_main = F.transform(up_to("others"), lambda i: place(i, mine, F.lit(True)))
    with_main = F.transform(up_to("mains"), lambda i: place(mine, i, F.lit(False)))
    with_rest = F.transform(F.filter(up_to("others"), lambda i: i > mine), lambda i: place(mine, shift + i, F.lit(False)))
    from_rest = F.transform(F.filter(up_to("others"), lambda i: i < mine), lambda i: place(i, shift + mine, F.lit(True)))
    whole = F.array(place(F.lit(0), F.lit(0), F.col("main")))
    at = F.when(one, whole).when(F.col("main"), of_main).otherwise(F.concat(with_main, with_rest, from_rest))
    cell = F.when(one, F.col("node")).otherwise(F.xxhash64("node", "at.left", "at.place")).alias("cell")
    return many.withColumn("at", F.explode(at)).select(cell, "node", "doc", label, "main", F.col("at.right").alias("right"), (F.col("at.place") == 0).alias("own"), *columns)


def strongest(sketch: np.ndarray, size: np.ndarray, percent: int, sure: int, label: np.ndarray | None = None, main: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The candidates that connect a node, each class with the one that it agrees best with: a maximum spanning forest of its labels.

    The ``main`` rows are all of one label.
    """
    m = len(sketch)
    label = np.arange(m) if label is None else label
    best, other, free, out, at = np.full(m, -1), np.zeros(m, np.int64), np.ones(m, bool), [], 0
    if hub := main is not None and bool(main.any()):
        centre, free, at = np.flatnonzero(main), ~main, -1
        for k in np.flatnonzero(free):
            same = np.where(near_size(size[centre], size[k], percent), (sketch[centre] == sketch[k]).sum(1), -1)
            best[k], other[k] = same.max(), centre[same.argmax()]
    for _ in range(int(free.sum()) - (not hub)):
        if at >= 0:
            free[at] = False
            same = np.where(near_size(size, size[at], percent), (sketch == sketch[at]).sum(1), -1)
            same[label == label[at]] = SLOTS + 1
            better = free & (same > best)
            best[better], other[better] = same[better], at
        k = int(np.where(free, best, -2).argmax())
        if sure <= best[k] <= SLOTS:
            out.append((int(other[k]), k))
        at = k
    return out


def _first(percent: int):
    """Rows (node, doc, label, main, size, sketch), sorted by node, to the strongest candidates (node, a, b), a < b."""
    sure = enough(percent)

    def step(batches):
        for (node, doc, label, main, size, sketch), starts in whole_groups(batches):
            node, doc, label, main, size = (c.to_numpy(zero_copy_only=False) for c in (node, doc, label, main, size))
            sketch = bytes_of(sketch)
            ends = np.r_[starts[1:], len(node)]
            two = starts[ends - starts == 2]
            two = two[((sketch[two] == sketch[two + 1]).sum(1) >= sure) & near_size(size[two], size[two + 1], percent) & (label[two] != label[two + 1])]
            found = [(int(i), int(i) + 1) for i in two]
            for s, e in zip(starts, ends, strict=True):
                if e - s > 2:
                    found += [(int(s) + i, int(s) + j) for i, j in strongest(sketch[s:e], size[s:e], percent, sure, label[s:e], main[s:e])]
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (node[i], np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j]))], ["node", "a", "b"])

    return step


def candidates(cell: list[pa.Array], s: int, e: int, percent: int, sure: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each left row of a cell, rows s to e of (cell, node, doc, label, main, right, own, size, sketch, nodes): its place, those of its candidates, and the labels of all.

    A pair is given once, in the least of the ``nodes`` that it shares.  Labels may be changed between the rows.
    """
    node, label, size = (cell[k].slice(s, e - s).to_numpy(zero_copy_only=False) for k in (1, 3, 7))
    right, own = (cell[k].slice(s, e - s).to_numpy(zero_copy_only=False) for k in (5, 6))
    label, look, each = label.copy(), bytes_of(cell[8].slice(s, e - s)), cell[9].slice(s, e - s)
    length = each.value_lengths().to_numpy()
    lies = np.full((e - s, length.max()), node[0])
    lies[np.arange(lies.shape[1]) < length[:, None]] = each.flatten().to_numpy()
    lefts = int((~right).sum())
    rows = np.r_[np.flatnonzero(~right), np.flatnonzero(right)]
    for k, i in enumerate(rows[:lefts]):
        to = rows[k + 1 if own[0] else lefts :]
        to = to[(label[to] != label[i]) & near_size(size[to], size[i], percent)]
        to = to[(look[to] == look[i]).sum(1) >= sure]
        before = lies[i][lies[i] < node[0]]
        if len(before):
            to = to[~np.isin(lies[to], before).any(1)]
        if len(to):
            yield i, to, label


def _meeting(percent: int):
    """Rows (cell, node, doc, label, main, right, own, size, sketch, nodes), sorted by cell, to those (node, doc) that have candidates."""
    sure = enough(percent)

    def step(batches):
        for cell, starts in whole_groups(batches):
            has = np.zeros(len(cell[0]), bool)
            for s, e in zip(starts, [*starts[1:], len(has)], strict=True):
                for i, to, _ in candidates(cell, s, e, percent, sure):
                    has[s + i] = has[s + to] = True
            if has.any():
                at = pa.array(np.flatnonzero(has))
                yield pa.RecordBatch.from_arrays([cell[1].take(at), cell[2].take(at)], ["node", "doc"])

    return step


def in_both(code: np.ndarray, start: np.ndarray, values: int, i: int, to: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of set i with the sets ``to``; set k has code[start[k] : start[k + 1]], of so many values."""
    mine, out = np.zeros(values, bool), []
    mine[code[start[i] : start[i + 1]]] = True
    length = start[to + 1] - start[to]
    for part in np.split(np.arange(len(to)), np.flatnonzero(np.diff(length.cumsum() // ROOM)) + 1):
        ends = length[part].cumsum()
        begin = ends - length[part]
        at = np.repeat(start[to[part]] - begin, length[part]) + np.arange(ends[-1])
        out.append(np.add.reduceat(mine[code[at]], begin, dtype=np.int64))
    return np.concatenate(out)


def _alike(percent: int):
    """Rows (cell, node, doc, label, main, right, own, size, sketch, nodes, found), sorted by cell, to links (a, b) by their full sets, enough to connect each cell."""
    sure = enough(percent)

    def step(batches):
        for cell, starts in whole_groups(batches):
            doc, size = cell[2].to_numpy(), cell[7].to_numpy()
            for s, e in zip(starts, [*starts[1:], len(doc)], strict=True):
                values, code = np.unique(np.frombuffer(b"".join(cell[10].slice(s, e - s).to_pylist()), np.uint64), return_inverse=True)
                start, n, links = np.r_[0, size[s:e].cumsum()], size[s:e], []
                for i, to, label in candidates(cell, s, e, percent, sure):
                    both = in_both(code, start, len(values), i, to)
                    for j in to[100 * both >= percent * (n[i] + n[to] - both)]:
                        if label[i] != label[j]:
                            label[label == label[j]] = label[i]
                            links.append((doc[s + i], doc[s + j]))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in np.array(links).T], ["a", "b"])

    return step


# -- large nodes ------------------------------------------------------------------


def _usual(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, some sketches) to the most frequent token of each slot."""
    for b in batches:
        out = []
        for some in b.column(1).to_pylist():
            at = np.frombuffer(b"".join(sorted(some)), np.uint8).reshape(-1, SLOTS).astype(np.int64) + 256 * np.arange(SLOTS)
            out.append(np.bincount(at.ravel(), minlength=256 * SLOTS).reshape(SLOTS, 256).argmax(1).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["node", "usual"])


def _agreeing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (..., sketch, other) with ``same``, the number of slots that agree, for ``other``."""
    for b in batches:
        same = (bytes_of(b.column(b.num_columns - 2)) == bytes_of(b.column(b.num_columns - 1))).sum(1)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(same, pa.int32())], [*b.schema.names[:-1], "same"])


def drawn(node: np.ndarray) -> np.ndarray:
    """Two different slots for each node, none by which trees begin."""
    rest = np.uint64(SLOTS - TREES)
    lot = mix(node.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    first = lot % rest
    second = (first + np.uint64(1) + (lot >> np.uint64(32)) % (rest - np.uint64(1))) % rest
    return np.stack([first, second], 1).astype(np.int64) + TREES


def _branch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, doc, rest, size, sketch) to (node, doc, of, size, sketch) of the children that they lie in."""
    for b in batches:
        node, sketch = b.column(0).to_numpy(), bytes_of(b.column(4))
        for way, slot in enumerate(drawn(node).T):
            value = sketch[np.arange(len(sketch)), slot].astype(np.uint64)
            child = mix(mix(node.view(np.uint64)) + (slot.astype(np.uint64) << np.uint64(8) | value))
            into = np.ones(len(child), bool) if way == 0 else (child >> np.uint64(17) & np.uint64(1)) == 1
            at = pa.array(np.flatnonzero(into))
            yield pa.RecordBatch.from_arrays([pa.array(child[into].view(np.int64)), *(c.take(at) for c in b.columns[1:])], ["node", "doc", "of", "size", "sketch"])


def around_centres(large: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of a central class of each large node (node, doc, label, main, rest, size, sketch) with one class of each other label."""
    large = large.withColumn("label", F.coalesce("label", "doc"))
    rest = large.where("not main")
    files = large.sparkSession.sparkContext.defaultParallelism  # of a row for each large node
    picked = rest.where(F.pmod(F.xxhash64("node", "doc"), "rest") < SEEN)
    usual = picked.groupBy("node").agg(F.collect_list("sketch").alias("some")).mapInArrow(_usual, "node long, usual binary")  # about SEEN in a list
    usual = written(usual, files)
    schema = "node long, doc long, label long, size long, sketch binary, same int"
    ranked = rest.join(usual, "node").select("node", "doc", "label", "size", "sketch", "usual").mapInArrow(_agreeing, schema)
    centre = ranked.groupBy("node").agg(F.max(F.struct("same", (-F.col("doc")).alias("least"), "label", "size", "sketch")).alias("c"))
    centre = centre.select("node", (-F.col("c.least")).alias("centre"), F.col("c.label").alias("centre_label"), F.col("c.size").alias("centre_size"), F.col("c.sketch").alias("other"))
    centre = written(centre, files)
    near = 100 * F.least("size", "centre_size") >= percent * F.greatest("size", "centre_size")
    met = large.join(centre, "node").where((F.col("label") != F.col("centre_label")) & near)
    seen = met.select("node", "doc", "label", "centre", "sketch", "other").mapInArrow(_agreeing, "node long, doc long, label long, centre long, sketch binary, same int")
    best = seen.where(F.col("same") >= enough(percent)).groupBy("node", "centre", "label").agg(F.max(F.struct("same", "doc")).alias("s"))
    pairs = best.select(F.col("centre").alias("a"), F.col("s.doc").alias("b")).distinct()
    return written(confirm(pairs, texts, words, percent).where("linked").select("a", "b"))


# -- the join ---------------------------------------------------------------------


def linked_classes(base: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between classes (doc, n, tokens, sketch), enough of them to connect all that is linked.

    ``base`` (row, text) has the text of each class, in the row that has its name.
    """
    rows = classes.select(F.posexplode("tokens").alias("tree", "token"), "doc").select(F.xxhash64("tree", "token").alias("node"), "doc", F.lit(None).cast("long").alias("of"))
    look = classes.select("doc", F.col("n").alias("size"), "sketch")
    whole = base.select(F.col("row").alias("doc"), "text")
    small, links, texts = [], [], None
    full = written(sized(rows, None).join(look, "doc"))
    while True:
        few = (F.col("rest") <= SMALL) | F.coalesce(F.col("rest") > KEPT * F.col("of"), F.lit(False))
        small.append(full.where(few))
        large = full.where(~few)
        if large.isEmpty():
            break
        texts = texts or written(texts_for(written(large.select("doc").distinct()), whole))  # children hold no other classes
        links.append(around_centres(large, texts, words, percent))
        labels = components(reduce(DataFrame.unionByName, links))
        still = written(sized(large.select("node", "doc", "of", "size", "sketch"), labels, "size", "sketch"))
        small.append(still.where(F.col("rest") <= SMALL))
        rows = written(still.where(F.col("rest") > SMALL).select("node", "doc", "rest", "size", "sketch").mapInArrow(_branch, "node long, doc long, of long, size long, sketch binary"))
        full = written(sized(rows, labels, "size", "sketch"))
    nodes = reduce(DataFrame.unionByName, small)
    one = (F.col("rest") <= SMALL) & (F.col("n") - F.col("rest") <= SMALL)
    single = nodes.where(one).select("node", "doc", F.coalesce("label", "doc").alias("label"), "main", "size", "sketch")
    first = written(single.repartition("node").sortWithinPartitions("node").mapInArrow(_first(percent), "node long, a long, b long"))
    pairs = first.select("a", "b").distinct()
    verdicts = written(confirm(pairs, whole, words, percent))
    links.append(verdicts.where("linked").select("a", "b"))
    failing = first.join(verdicts.where("not linked"), ["a", "b"], "left_semi").select("node")
    failing = nodes.where(one & (F.col("n") > 2)).join(failing, "node", "left_semi")
    failing = failing.unionByName(nodes.where(~one))  # of many cells: a forest of each would be many pairs
    labels = components(reduce(DataFrame.unionByName, links))
    again = sized(failing.select("node", "doc", "of", "size", "sketch"), labels, "size", "sketch")
    again = written(again.withColumn("nodes", F.collect_list("node").over(Window.partitionBy("doc"))))  # a few for each tree
    # dealt by an expression: by the bare column, adaptive execution may keep the joins' own, differently coalesced partitions
    by_cell = lambda cells: cells.repartition(F.xxhash64("cell")).sortWithinPartitions("cell")
    cells = dealt(again, "size", "sketch", "nodes")
    meeting = written(by_cell(cells).mapInArrow(_meeting(percent), "node long, doc long"))  # a row for each cell
    sets = written(full_sets(texts_for(meeting.select("doc"), whole), words))
    again = again.drop("n", "rest").join(meeting, ["node", "doc"], "left_semi")
    fits = F.least(F.greatest(F.floor(ROOM / F.avg("size")), F.lit(1)), F.lit(SMALL)).alias("fits")
    counts = again.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("main")).alias("rest"), fits)
    cells = dealt(again.join(counts, "node").join(sets, "doc"), "size", "sketch", "nodes", "found", fits=F.col("fits"))
    links.append(written(by_cell(cells).mapInArrow(_alike(percent), "a long, b long")))
    return reduce(DataFrame.unionByName, links)


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, extra columns, n_shingles, component_id, kept, representative) of each row.

    Rows are linked if their sets of ``words``-word shingles have a Jaccard
    similarity of at least ``percent`` / 100; ``component_id`` is the least key
    reachable.  Words are lower-cased in A-Z only.  A null or empty text has no
    shingles and is linked with nothing.  Repeated rows are linked with each
    other, and all rows with the component's key are ``kept``.  Rows with the same
    key and different texts are separate rows.  A row with a null key takes part
    in links and gets the least key that is not null; where there is none, the
    component is null and the row kept.  ``representative`` is true for exactly
    one row of each component and for each row without shingles.  An empty table
    gives no rows.
    """
    carried = F.struct(*[F.col(c) for c in extra]) if extra else F.lit(None).cast("boolean")
    rows = df.select(F.col(text).alias("text"), F.col(key).cast("long").alias("key"), carried.alias("carried"))
    base = written(sketches(rows, words).withColumn("row", F.monotonically_increasing_id()))  # numbers are fixed by the write
    lowest = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("lowest")
    classes = written(base.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("row").alias("doc"), F.count(F.lit(1)).alias("copies"), lowest, F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")))
    labels = components(linked_classes(base, classes, words, percent))
    of_label = classes.select("doc", "lowest").join(labels.withColumnRenamed("id", "doc"), "doc").groupBy("label").agg(F.min("lowest").alias("of_all"))
    member = labels.join(of_label, "label").select(F.col("id").alias("doc"), "of_all")
    of_class = classes.select("d1", "d2", "n", "doc", "copies", "lowest").join(member, "doc", "left").where("copies > 1 or of_all is not null")
    of_class = of_class.select("d1", "d2", "n", F.coalesce("of_all", "lowest").alias("of_all"))
    out = base.select("key", "n", "d1", "d2", "row", *(["carried"] if extra else [])).join(of_class, ["d1", "d2", "n"], "left")
    component = F.when(F.col("of_all").isNull(), F.col("key")).otherwise(F.col("of_all.key"))
    return out.select(
        F.col("key").alias(key),
        *[F.col("carried").getField(c).alias(c) for c in extra],
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, component.isNull()).alias("kept"),
        F.coalesce(F.col("row") == F.col("of_all.row"), F.lit(True)).alias("representative"),
    )
