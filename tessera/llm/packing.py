"""Packing of token sequences into windows: best-fit decreasing over a segment tree.

Overlong documents are first cut into full windows.  The remainders go, longest
first, into the open window whose remaining capacity is the tightest that fits;
a segment tree over capacities finds it.  What best fit leaves open is closed by
cutting: pieces of the emptiest windows fill the gaps of the fullest, until less
than one window is left over.  That rest moves on to the next block, and at the
end of a partition it is cut into windows whose lengths are powers of two.

Documents are packed in blocks of a bounded number of tokens within each
partition, so memory does not grow with the input and nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import blocks, transducer

#: Tokens that are packed together.
TOKENS = 4_000_000
#: Sequence ids are the partition's number times this, and the number in the partition.
PER_PARTITION = 1 << 36


class CapacityTree:
    """Open windows by remaining capacity: a segment tree of counts, and a stack of windows for each capacity."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, window) of the smallest capacity of at least ``least``."""
        count, i = self.count, least + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until a right sibling has some
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.windows[capacity].pop()


Piece = tuple[int, int, int]  # document (index in the block), start, length


def best_fit_decreasing(pieces: list[Piece], size: int) -> list[list[Piece]]:
    """Windows of at most ``size`` tokens; pieces are not cut here."""
    tree, windows = CapacityTree(size), []
    for p in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        found = tree.take(p[2])
        if found is None:
            capacity, w = size, len(windows)
            windows.append([])
        else:
            capacity, w = found
        windows[w].append(p)
        if capacity > p[2]:
            tree.add(capacity - p[2], w)
    return windows


def close_gaps(windows: list[list[Piece]], size: int) -> tuple[list[list[Piece]], list[Piece]]:
    """(full windows, pieces left over, of less than ``size`` tokens together)."""
    fill = [sum(p[2] for p in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda i: (-fill[i], i))
    full, spare, last = [], [], len(order) - 1
    for k, i in enumerate(order):
        if k > last:
            break
        w, gap = list(windows[i]), size - fill[i]
        while gap:
            while not spare and last > k:
                spare = list(windows[order[last]])
                last -= 1
            if not spare:
                break
            d, start, n = spare.pop()
            cut = min(n, gap)
            w.append((d, start, cut))
            gap -= cut
            if n > cut:
                spare.append((d, start + cut, n - cut))
        if gap:
            return full, w + spare
        full.append(w)
    return full, spare


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """Windows that hold the pieces and whose lengths are powers of two."""
    pieces, out = list(pieces), []
    left = sum(p[2] for p in pieces)
    while left:
        room = 1 << left.bit_length() - 1
        left -= room
        out.append([])
        while room:
            d, start, n = pieces.pop(0)
            cut = min(n, room)
            out[-1].append((d, start, cut))
            room -= cut
            if n > cut:
                pieces.insert(0, (d, start + cut, n - cut))
    return out


class Packer:
    """Packs the documents of one partition, block by block."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.sequence = size, first_sequence
        self.docs: list[tuple[object, np.ndarray]] = []
        self.pieces: list[Piece] = []
        self.held = 0

    def add(self, key: object, ids: np.ndarray) -> Iterator[tuple]:
        self.pieces.append((len(self.docs), 0, len(ids)))
        self.docs.append((key, ids))
        self.held += len(ids)
        if self.held >= TOKENS:
            yield from self.flush(False)

    def flush(self, end: bool) -> Iterator[tuple]:
        size, full, rest = self.size, [], []
        for d, start, n in self.pieces:
            whole = n - n % size
            full += [[(d, start + i, size)] for i in range(0, whole, size)]
            if n > whole:
                rest.append((d, start + whole, n - whole))
        closed, over = close_gaps(best_fit_decreasing(rest, size), size)
        for w in [*full, *closed, *(powers_of_two(over) if end else [])]:
            offset = 0
            for d, start, n in w:
                key, ids = self.docs[d]
                yield key, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), self.sequence, offset
                offset += n
            self.sequence += 1
        keep = sorted({p[0] for p in over}) if not end else []
        index = {d: i for i, d in enumerate(keep)}
        self.docs = [self.docs[d] for d in keep]
        self.pieces = [(index[d], start, n) for d, start, n in over] if not end else []
        self.held = sum(p[2] for p in self.pieces)


COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _packed(batches: Iterable[tuple[int, pa.Array, pa.ListArray]], size: int, last: int | None, key: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Batches (number of the partition, keys, ids).  The number comes with the rows, as one task may run several partitions."""
    packer: Packer | None = None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        keys, *rest = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), *[pa.array(c, pa.int64()) for c in rest]], [key, *COLUMNS])

    for number, keys, lists in batches:
        packer = packer or Packer(size, number * PER_PARTITION)
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        end = np.array([last] if last is not None else [], "<u4")
        for k, i, j in zip(keys.to_pylist(), at[:-1], at[1:], strict=True):
            if rows := list(packer.add(k, np.concatenate([flat[i:j], end]))):
                yield out(rows)
    if packer and (rows := list(packer.flush(True))):
        yield out(rows)


def _schema(df: DataFrame, key: str) -> str:
    return f"`{key}` {dict(df.dtypes)[key]}, " + ", ".join(f"{c} long" for c in COLUMNS)


def pack(df: DataFrame, ids: str = "ids", key: str = "doc_id", size: int = 2048, last: int | None = 1) -> DataFrame:
    """Pieces of all rows' ids, each followed by ``last``: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Null ids count as none.  Each row is packed on its own, so repeated rows give
    repeated pieces.  A row without a token (``last`` None, no ids) gives no piece.
    Sequence ids are unique, also where ``coalesce`` joins partitions in a task; which rows share a sequence follows the partitions.
    """

    def step(batches):
        yield from _packed(((b.column(2)[0].as_py(), b.column(0), _whole(b.column(1))) for b in batches if b.num_rows), size, last, key, kind)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(df.schema[key].dataType)
    return df.select(key, ids, F.spark_partition_id()).mapInArrow(step, _schema(df, key))


def pack_texts(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", size: int = 2048, last: int | None = 1) -> DataFrame:
    """``pack`` of the texts' BPE ids, encoded in the same pass; a null text counts as empty."""

    def encoded(batches):
        t = transducer(path)
        for b in batches:
            for i, n in blocks(b.column(1)):
                yield b.column(2)[i].as_py(), b.column(0).slice(i, n), t.encode_arrow(b.column(1).slice(i, n))

    def step(batches):
        yield from _packed(encoded(batches), size, last, key, kind)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(df.schema[key].dataType)
    return df.select(key, text, F.spark_partition_id()).mapInArrow(step, _schema(df, key))


def _whole(lists: pa.Array) -> pa.ListArray:
    """The lists from offset 0 on, null as empty."""
    rows = [x or [] for x in lists.to_pylist()]
    return pa.array(rows, pa.list_(pa.int32()))
