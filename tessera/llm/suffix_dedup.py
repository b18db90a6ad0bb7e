"""Removal of byte strings that occur more than once, through a family of suffix arrays.

Suffixes are sampled (see ``anchors``): any 200 bytes contain a sampled place
that only those bytes decide, so equal strings meet at equal places.  A sampled
suffix is taken with its *context*, the text around it as far as a repeated
string through the place's gram can reach: 200 bytes from the place on and 100
before it.

Each task keeps a logarithmic index family.  A new batch of suffixes is sorted
into a suffix array, in the order of their bytes, and merge-scanned against the
levels that exist.  Suffixes whose whole context is there already are settled;
the others form a new level, and levels of about equal size merge.  In the merged
array neighbours with a common prefix of a gram show which grams occur in several
contexts.  What a task has left, one suffix of each context, meets the other
tasks' in one shuffle, sorted by gram and context, so a passage that a third of
all documents share sends one suffix from each task, not one from each document.

Where the context is found again, all strings through the gram are repeated.
Where only the gram is (at the edges of a passage), the strings are compared one
by one: contexts of the same gram are brought together and a family of suffix
arrays of all their strings finds the common prefixes of 200 bytes.  Grams that
have several contexts within one task may be very frequent; their strings go into
that task's own family first, and only one of each goes on.

Within tasks bytes are compared.  Between tasks a context, or a single string of a
frequent gram, is known by its 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.anchors import Hasher, owners
from tessera.llm.common import shared_dir, whole_groups

#: Bytes of a string that counts as repeated, and of the gram that is sampled.
LENGTH, GRAM = 200, 100
WINDOW = LENGTH - GRAM + 1
REACH = LENGTH - GRAM


class Sizes(NamedTuple):
    """What a task holds: suffixes of a batch, of its family before it is passed on, and bytes of a text that are looked at together."""

    batch: int = 50_000
    family: int = 300_000
    segment: int = 1_000_000


#: Kinds of marks on a place: the context is repeated; its strings are to be compared, with few or with many others.
FULL, EDGE, FREQUENT = 0, 1, 2
#: Kinds of rows between tasks: a suffix, a gram with several contexts in a task, marks of a document.
ENTRY, BEACON, MARKS = 3, 4, 5
CHECK_BITS = 29


def packed(pos, check, kind) -> np.ndarray:
    """A place, the check bits of its document and a kind in 64 bits."""
    return np.asarray(pos, np.int64) << 32 | np.asarray(check, np.int64) << 3 | np.asarray(kind, np.int64)


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 32, at >> 3 & ((1 << CHECK_BITS) - 1), at & 7


# -- suffix arrays ----------------------------------------------------------------


class Family:
    """Levels of sorted suffixes, as byte strings of one width; each has a count and the number of its first row."""

    def __init__(self, width: int):
        self.kind = f"S{width}"
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def __len__(self) -> int:
        return sum(len(k) for k, _, _ in self.levels)

    def add(self, suffixes: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Takes a batch in; returns the rows that are settled: the family has their suffix, or the batch has it before."""
        order = np.argsort(suffixes, kind="stable")
        suffixes, row = suffixes[order], row[order]
        first = np.r_[True, suffixes[1:] != suffixes[:-1]][: len(suffixes)]
        settled = [row[~first]]
        starts = np.flatnonzero(first)
        count = np.diff(starts, append=len(suffixes))
        suffixes, row = suffixes[starts], row[starts]
        for level, counts, _ in self.levels:
            at = np.minimum(np.searchsorted(level, suffixes), len(level) - 1)
            found = level[at] == suffixes
            counts[at[found]] += count[found]
            settled.append(row[found])
            suffixes, count, row = suffixes[~found], count[~found], row[~found]
        if len(suffixes):
            self.levels.append((suffixes, count, row))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            self._merge()
        return np.concatenate(settled)

    def _merge(self) -> None:
        (a, m, i), (b, n, j) = self.levels.pop(), self.levels.pop()
        at = np.searchsorted(a, b) + np.arange(len(b))  # the levels share no suffix
        into = np.ones(len(a) + len(b), bool)
        into[at] = False
        out = []
        for x, y in ((a, b), (m, n), (i, j)):
            z = np.empty(len(into), x.dtype)
            z[into], z[at] = x, y
            out.append(z)
        self.levels.append(tuple(out))

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffixes, counts, first rows) of all levels in one suffix array."""
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0] if self.levels else (np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64))


def sharing(suffixes: np.ndarray, prefix: int) -> np.ndarray:
    """Which suffixes of a sorted array have so long a common prefix with a neighbour."""
    head = np.ascontiguousarray(suffixes).view(np.uint8).reshape(len(suffixes), suffixes.dtype.itemsize)[:, :prefix]
    same = (head[1:] == head[:-1]).all(1)
    return np.r_[False, same][: len(suffixes)] | np.r_[same, False][: len(suffixes)]


CONTEXT = LENGTH + REACH + 2


def contexts_at(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The suffixes at ``at`` with what stands before them; beyond the text's ends zeros, and last how much text there is on both sides."""
    out = np.zeros((len(at), CONTEXT), np.uint8)
    padded = np.concatenate([np.zeros(REACH, np.uint8), raw, np.zeros(LENGTH, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, REACH + LENGTH)[at]
    out[:, :LENGTH], out[:, LENGTH:-2] = view[:, REACH:], view[:, :REACH]
    out[:, -2], out[:, -1] = np.minimum(at, REACH) + 1, np.minimum(len(raw) - at, LENGTH) + 1
    return out.view(f"S{CONTEXT}").ravel()


def strings_at(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The strings of ``LENGTH`` bytes at ``at``."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[at]).view(f"S{LENGTH}").ravel()


def digests(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes as two numbers."""
    width = suffixes.dtype.itemsize
    raw = suffixes.tobytes()
    both = b"".join(xxhash.xxh3_128_digest(raw[i : i + width]) for i in range(0, len(raw), width))
    two = np.frombuffer(both, np.int64).reshape(-1, 2)
    return two[:, 0], two[:, 1]


def segments(raw: np.ndarray, size: int) -> Iterator[tuple[int, Hasher, np.ndarray]]:
    """(offset, hasher, sampled place of each string that starts there) of bounded parts of a text, which overlap by a string."""
    for k in range(0, max(0, len(raw) - LENGTH + 1), size):
        part = raw[k : k + size + LENGTH - 1]
        h = Hasher(part)
        yield k, h, owners(h, len(part), GRAM, WINDOW)


# -- sampled suffixes -----------------------------------------------------------

SUFFIXES = "gram long, c1 long, c2 long, doc long, at long, places binary"
PLACES = "doc long, at long, places binary"


def _rows(names: list[str], columns: list, places: pa.Array | None = None) -> pa.RecordBatch:
    arrays = [pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in columns]
    return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(arrays[0]), pa.binary()) if places is None else places], [*names, "places"])


SUFFIX_NAMES, PLACE_NAMES = ["gram", "c1", "c2", "doc", "at"], ["doc", "at"]


def by_document(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Marks to one row for each document: (doc, check with ``MARKS``, its places and kinds)."""
    order = np.lexsort((at, at >> 3 & ((1 << CHECK_BITS) - 1), doc))
    doc, at = doc[order], at[order]
    pos, check, kind = unpacked(at)
    starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (check[1:] != check[:-1])][: len(doc)])
    offsets = np.r_[starts, len(doc)].astype(np.int32) * 8
    values = (pos << 3 | kind).astype("<i8").tobytes()
    return doc[starts], packed(0, check[starts], MARKS), pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _sample(sizes: Sizes):
    """Map side: (doc, check, text) to suffixes, one of each context in this task, and marks where that settles places."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, settled = Family(CONTEXT), []
        rows = [np.zeros(0, np.int64)] * 3  # doc, at, gram of the rows since the family began
        held: list[tuple] = []
        size = 0

        def take() -> None:
            nonlocal rows, held, size
            if held:
                suffixes, *new = (np.concatenate(c) for c in zip(*held, strict=True))
                before = len(rows[0])
                rows = [np.concatenate(x) for x in zip(rows, new, strict=True)]
                settled.append(family.add(suffixes, np.arange(before, before + len(suffixes))))
                held, size = [], 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            nonlocal family, settled, rows
            suffixes, n, row = family.whole()
            doc, at, gram = rows
            several = sharing(suffixes, GRAM)
            full = np.concatenate([*settled, row[n > 1]]).astype(np.int64)
            many = row[several]
            if len(full) + len(many):
                d, a, places = by_document(np.r_[doc[full], doc[many]], np.r_[at[full] | FULL, at[many] | FREQUENT])
                zero = np.zeros(len(d), np.int64)
                yield _rows(SUFFIX_NAMES, [d, zero, zero, d, a], places)
            one = np.flatnonzero(~several)
            for k in range(0, len(one), sizes.batch):
                part = one[k : k + sizes.batch]
                r = row[part]
                c1, c2 = digests(suffixes[part])
                yield _rows(SUFFIX_NAMES, [gram[r], c1, c2, doc[r], at[r] | ENTRY])
            lights = np.unique(gram[many])
            zero = np.zeros(len(lights), np.int64)
            yield _rows(SUFFIX_NAMES, [lights, zero, zero, zero, zero | BEACON])
            family, settled, rows = Family(CONTEXT), [], [np.zeros(0, np.int64)] * 3

        for b in batches:
            for doc, check, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                before = np.zeros(0, np.int64)
                for k, h, own in segments(raw, sizes.segment):
                    places = np.unique(own) + k
                    at, before = np.setdiff1d(places, before, assume_unique=True) - k, places  # strings of two segments may have one place
                    grams = h.slices(at, at + GRAM).view(np.int64)
                    for i in range(0, len(at), sizes.batch):
                        part = at[i : i + sizes.batch]
                        held.append((contexts_at(raw, part + k), np.full(len(part), doc), packed(part + k, check, 0), grams[i : i + sizes.batch]))
                        size += len(part)
                        if size >= sizes.batch:
                            take()
                            if len(rows[0]) >= sizes.family:
                                yield from passed_on()
        take()
        yield from passed_on()

    return step


def _match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes sorted by gram and context to marks (doc, at, places)."""
    for columns, _ in whole_groups(batches):
        gram, c1, c2, doc, at = (c.to_numpy() for c in columns[:5])
        done = (at & 7) == MARKS
        if done.any():
            where = pa.array(np.flatnonzero(done))
            yield pa.RecordBatch.from_arrays([c.take(where) for c in columns[3:]], [*PLACE_NAMES, "places"])
        gram, c1, c2, doc, at = (x[~done] for x in (gram, c1, c2, doc, at))
        if not len(gram):
            continue
        entry = (at & 7) == ENTRY
        starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(gram)))
        new = np.r_[True, (gram[1:] != gram[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]) | (entry[1:] != entry[:-1])]
        kind = np.cumsum(new) - 1
        contexts = np.bincount(group[new & entry], minlength=len(starts))
        frequent = np.bincount(group[~entry], minlength=len(starts)) > 0
        full = entry & (np.bincount(kind)[kind] > 1)
        shown = entry & new & ((contexts > 1) | frequent)[group]  # one row stands for each context
        at = at & ~np.int64(7)
        out_doc = np.r_[doc[full], doc[shown]]
        out_at = np.r_[at[full] | FULL, at[shown] | np.where(frequent[group[shown]], FREQUENT, EDGE)]
        if len(out_doc):
            yield _rows(PLACE_NAMES, [out_doc, out_at])


def marks_of(marks: list[dict] | None, check: int) -> dict[int, np.ndarray]:
    """Places by kind of a document's marks; those of another document with the same 64-bit name are left out."""
    pos, kind = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in marks or []:
        p, c, k = (int(x) for x in unpacked(np.int64(m["at"])))
        if c != check:
            continue
        if m["places"] is None:
            pos.append(np.array([p]))
            kind.append(np.array([k]))
        else:
            both = np.frombuffer(m["places"], "<i8")
            pos.append(both >> 3)
            kind.append(both & 7)
    pos, kind = np.concatenate(pos), np.concatenate(kind)
    return {k: np.unique(pos[kind == k]) for k in (FULL, EDGE, FREQUENT)}


# -- single strings ----------------------------------------------------------------

#: Kinds of rows: the strings of an edge as bytes, the hash of a string, a run of strings that are known to be repeated.
BYTES, STRING, RUN = 0, 1, 2
STRINGS = "kind long, shard long, code long, doc long, at long, length long, bytes binary"
STRING_NAMES = ["kind", "shard", "code", "doc", "at", "length"]
REPEATED = "doc long, at long, length long"


def _strings_row(columns: list, data: pa.Array | None = None) -> pa.RecordBatch:
    n = len(columns[3])
    arrays = [pa.array(np.ascontiguousarray(np.broadcast_to(np.asarray(c, np.int64), n))) for c in columns]
    return pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, pa.binary()) if data is None else data], [*STRING_NAMES, "bytes"])


def runs_of(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, at, length) of runs of neighbouring strings; ``at`` of the first."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    pos, check, _ = unpacked(at)
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (check[1:] != check[:-1]) | (np.diff(pos) > 1)][: len(doc)])
    last = np.r_[new[1:], len(doc)][: len(new)] - 1
    return doc[new], at[new], pos[last] - pos[new] + 1


def _compare(sizes: Sizes):
    """Text side: waiting texts (doc, check, text, marks, ...) to the strings of their places."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, rows = Family(LENGTH), [np.zeros(0, np.int64)] * 2
        held: list[tuple] = []
        edges: list[tuple] = []
        size = 0

        def take() -> Iterator[pa.RecordBatch]:
            nonlocal rows, held, size
            if held:
                strings, *new = (np.concatenate(c) for c in zip(*held, strict=True))
                before = len(rows[0])
                rows = [np.concatenate(x) for x in zip(rows, new, strict=True)]
                found = family.add(strings, np.arange(before, before + len(strings)))
                held, size = [], 0
                doc, at, n = runs_of(rows[0][found], rows[1][found])
                if len(doc):
                    yield _strings_row([RUN, doc, 0, doc, at, n])

        def passed_on() -> Iterator[pa.RecordBatch]:
            nonlocal family, rows
            strings, n, row = family.whole()
            doc, at, length = runs_of(rows[0][row[n > 1]], rows[1][row[n > 1]])
            if len(doc):
                yield _strings_row([RUN, doc, 0, doc, at, length])
            for k in range(0, len(strings), sizes.batch):
                c1, c2 = digests(strings[k : k + sizes.batch])
                r = row[k : k + sizes.batch]
                yield _strings_row([STRING, c1, c2, rows[0][r], rows[1][r], 1])
            family, rows = Family(LENGTH), [np.zeros(0, np.int64)] * 2

        def edge_rows() -> pa.RecordBatch:
            shard, doc, at, data = zip(*edges, strict=True)
            edges.clear()
            return _strings_row([BYTES, np.array(shard), 0, np.array(doc), np.array(at), 0], pa.array(data, pa.binary()))

        for b in batches:
            for doc, check, text, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                places = marks_of(marks.as_py(), check)
                if not len(places[EDGE]) and not len(places[FREQUENT]):
                    continue
                raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                for k, h, own in segments(raw, sizes.segment):
                    start = np.flatnonzero(np.isin(own + k, places[EDGE]))
                    of = own[start]
                    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
                    last = np.r_[first[1:], len(of)][: len(first)] - 1
                    shard = h.slices(of[first], of[first] + GRAM).view(np.int64).tolist()
                    for g, i, j in zip(shard, start[first].tolist(), start[last].tolist(), strict=True):
                        edges.append((g, doc, int(packed(i + k, check, 0)), raw[i + k : j + k + LENGTH].tobytes()))
                        if len(edges) >= 5_000:
                            yield edge_rows()
                    start = np.flatnonzero(np.isin(own + k, places[FREQUENT])) + k
                    for i in range(0, len(start), sizes.batch):
                        part = start[i : i + sizes.batch]
                        held.append((strings_at(raw, part), np.full(len(part), doc), packed(part, check, 0)))
                        size += len(part)
                        if size >= sizes.batch:
                            yield from take()
                            if len(rows[0]) >= sizes.family:
                                yield from passed_on()
        yield from take()
        yield from passed_on()
        if edges:
            yield edge_rows()

    return step


def _resolve(sizes: Sizes):
    """Strings sorted by kind, shard and code to runs (doc, at, length) of those that are repeated."""

    def out(doc, at, length) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).astype(np.int64)) for x in (doc, at, length)], ["doc", "at", "length"])

    def compared(doc: np.ndarray, at: np.ndarray, data: pa.Array) -> Iterator[pa.RecordBatch]:
        """Edges of whole groups: a family of suffix arrays of their strings, a batch at a time."""
        offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        raw = np.frombuffer(data.buffers()[2], np.uint8)
        n = np.diff(offsets) - LENGTH + 1
        of = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        family, found = Family(LENGTH), []
        for k in range(0, len(of), sizes.batch):
            s = slice(k, k + sizes.batch)
            found.append(family.add(strings_at(raw, offsets[of[s]] + step[s]), np.arange(k, k + len(of[s]))))
        _, count, row = family.whole()
        hit = np.concatenate([*found, row[count > 1]]).astype(np.int64)
        if len(hit):
            yield out(*runs_of(doc[of[hit]], at[of[hit]] + (step[hit] << 32)))

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.Array]] = []
        strings = 0
        for columns, starts in whole_groups((b.select(["shard", "kind", "code", "doc", "at", "length", "bytes"]) for b in batches)):
            kind, code, doc, at, length = (c.to_numpy() for c in columns[1:6])
            shard = columns[0].to_numpy()
            known = kind == RUN
            if known.any():
                yield out(doc[known], at[known], length[known])
            text = np.flatnonzero(kind == STRING)
            if len(text):
                s, c = shard[text], code[text]
                same = (s[1:] == s[:-1]) & (c[1:] == c[:-1])
                twice = text[np.r_[False, same] | np.r_[same, False]]
                yield out(*runs_of(doc[twice], at[twice]))
            edge = kind == BYTES
            ends = np.r_[starts[1:], len(shard)]
            for s, e in zip(starts, ends, strict=True):
                if edge[s] and e - s > 1:
                    held.append([columns[i].slice(s, e - s) for i in (3, 4, 6)])
                    strings += int(pa.compute.sum(pa.compute.binary_length(held[-1][2])).as_py()) - (LENGTH - 1) * (e - s)
                    if strings >= sizes.batch:
                        d, a, data = (pa.concat_arrays(x) for x in zip(*held, strict=True))
                        yield from compared(d.to_numpy(), a.to_numpy(), data)
                        held, strings = [], 0
        if held:
            d, a, data = (pa.concat_arrays(x) for x in zip(*held, strict=True))
            yield from compared(d.to_numpy(), a.to_numpy(), data)

    return step


# -- removal ------------------------------------------------------------------------


def _covered(n: int, places: np.ndarray) -> np.ndarray:
    """Starts of all strings through the grams at ``places``, as a mask over the text's strings."""
    step = np.zeros(max(0, n - LENGTH + 1) + 1, np.int32)
    if len(step) > 1:
        np.add.at(step, np.clip(places - REACH, 0, len(step) - 1), 1)
        np.add.at(step, np.clip(places + 1, 0, len(step) - 1), -1)
    return np.cumsum(step)[:-1] > 0


def spans_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes in strings that begin where the mask is true."""
    at = np.flatnonzero(starts)
    if not len(at):
        return []
    new = np.r_[True, np.diff(at) > LENGTH]  # a string that begins right after another's end still touches it
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(at) - 1]
    return list(zip(at[first].tolist(), (at[last] + LENGTH).tolist(), strict=True))


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *[e for _, e in spans]]
    return b"".join(raw[i:j] for i, j in zip(ends, [*[s for s, _ in spans], len(raw)], strict=True))


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", extra: tuple[str, ...] = (), as_text: bool = False, sizes: Sizes = Sizes()) -> DataFrame:
    """(key, extra columns, n_bytes, spans, kept) of each row: its text without the bytes of repeated strings.

    ``spans`` are the removed runs [start, end) of bytes, ``kept`` the rest as
    binary, since a cut may fall inside a character; ``as_text`` gives it as text
    without such halves of characters.  Strings are compared over
    all rows and within each; a row that occurs twice is its own copy.  A null
    text counts as empty; texts under 200 bytes stay as they are; an empty table
    gives no rows.

    A row is known by 93 bits of hashes of its key and text, so rows with the same
    key and different texts stay apart.  Only places are shuffled and written, and
    the texts once, by row; texts without marks take no part in the comparison.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    check = F.xxhash64(F.lit(1), body, F.col(key)).bitwiseAND(F.lit((1 << CHECK_BITS) - 1))
    carried = F.struct(F.col(key).alias("key"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(extra)])
    docs = df.select(F.xxhash64(F.col(key), body).alias("doc"), check.alias("check"), body.alias("text"), carried.alias("carried"))
    suffixes = docs.select("doc", "check", "text").mapInArrow(_sample(sizes), SUFFIXES)
    found = suffixes.repartition("gram").sortWithinPartitions("gram", "c1", "c2").mapInArrow(_match, PLACES)
    single = F.col("at").bitwiseAND(7)
    waits = F.max((single == EDGE) | (single == FREQUENT) | (single == MARKS))
    by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("at", "places")).alias("marks"), waits.alias("waits"))
    folder = f"{shared_dir(spark)}/repeats-{uuid4().hex}"
    by_doc.write.option("compression", "zstd").parquet(folder)
    marks = spark.read.schema(by_doc.schema).parquet(folder)
    # both joins deal the same columns by row, so the texts' exchange is one
    pending = docs.join(marks.where("waits"), "doc").select("doc", "check", "text", "marks", "carried")
    strings = pending.mapInArrow(_compare(sizes), STRINGS).repartition("shard").sortWithinPartitions("kind", "shard", "code")
    runs = strings.mapInArrow(_resolve(sizes), REPEATED).groupBy("doc").agg(F.collect_list(F.struct("at", "length")).alias("runs"))
    last = docs.join(marks.select("doc", "marks"), "doc", "left").join(runs, "doc", "left")
    columns = [key, *extra]
    kinds = dict(df.dtypes)
    chosen = last.select("check", "text", "marks", "runs", F.col("carried.key").alias(key), *[F.col(f"carried.x{i}").alias(c) for i, c in enumerate(extra)])

    def finish(batches):
        for b in batches:
            spans, kept, lengths = [], [], []
            for check, t, marks, runs in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                raw = (t.as_py() or "").encode()
                marks, runs = marks.as_py(), runs.as_py()
                if marks or runs:
                    mask = _covered(len(raw), marks_of(marks, check)[FULL])
                    for r in runs or []:
                        pos, c, _ = unpacked(np.int64(r["at"]))
                        if c == check:
                            mask[pos : pos + r["length"]] = True
                    spans.append(spans_of(mask))
                else:
                    spans.append([])
                lengths.append(len(raw))
                kept.append(cut(raw, spans[-1]))
            rest = pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            runs_removed = pa.array([[{"start": s, "end": e} for s, e in y] for y in spans], SPANS)
            yield pa.RecordBatch.from_arrays([*b.columns[4:], pa.array(lengths, pa.int64()), runs_removed, rest], [*columns, "n_bytes", "spans", "kept"])

    named = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return chosen.mapInArrow(finish, f"{named}, n_bytes long, spans array<struct<start:int,end:int>>, kept {'string' if as_text else 'binary'}")
