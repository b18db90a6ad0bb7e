"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

Encoding works on an unbounded stream of text in constant memory.  Three facts
make that exact:

* The pre-tokenizer's pattern can always cut before a space whose neighbours
  are not both white space, so a piece never depends on text beyond the next
  such place.
* No merge crosses a boundary of the final tokens.  So a piece may be cut at
  any boundary that is known to be final, and the rest encoded on its own.
* A merge list has a *sufficient lookahead*: a number of bytes after a token's
  end beyond which no text can change that token.  ``sufficient_lookahead``
  computes it from the merges alone (see there).  Tokens that end so far before
  the end of the window are stable and leave the transducer at once.

A batch of texts is one such stream.  It goes through windows of a fixed size; a
text that reaches beyond its window is cut where tokens are stable, its tokens so
far leave, and the rest goes on into the next window.  Within a window the merges
run over all pieces together, as array operations: each round applies, in every
piece, its merge of lowest rank.

Decoding maps ids to bytes and bytes to text with an incremental UTF-8 machine,
a bounded number of ids at a time; it holds at most three bytes in between.
"""

from __future__ import annotations

import codecs
import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-tokenizer's pattern of byte-level BPE with 50,257 ids (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode White_Space, which is narrower than Python's ``\s``.
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NONE = np.int32(2**31 - 1)
#: Bytes of a window that is encoded together, and ids that are decoded together.
WINDOW, IDS = 4_000_000, 100_000

#: Classes of bytes within a word; 0: left to the pattern.
LETTER, DIGIT, MARK, SPACE, FEED = 1, 2, 3, 4, 5
KINDS = np.zeros(256, np.uint8)
KINDS[33:127] = MARK
KINDS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = LETTER
KINDS[48:58], KINDS[32], KINDS[10], KINDS[39] = DIGIT, SPACE, FEED, 0
#: Bytes that may end, or begin, a white space character.
TAILS, HEADS = np.zeros(256, bool), np.zeros(256, bool)
TAILS[[*range(9, 14), 32, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
HEADS[[*range(9, 14), 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Bytes after a token's end beyond which nothing changes the token.

    ``merges`` are (left, right, merged) in rank order.  Whether a merge (u, v)
    happens can depend on text after v only if some token x on the right edge of
    v's derivation is taken first by another merge (x, w), of lower rank than
    the merge that consumes x inside (u, v).  That merge may in turn depend on
    text after w in the same way, with a lower rank again, so the reach is a
    longest path over ranks:

        reach(u, v) = |v| + max(0, reach(x, w) for such x and w)

    Ranks fall along the path, so one pass in rank order computes it.
    """
    made = {m: (i, v) for i, (_, v, m) in reversed(list(enumerate(merges)))}
    ranks: dict[int, list[int]] = {}  # by left token: ranks seen so far, and the largest reach up to each
    tops: dict[int, list[int]] = {}
    most = 0
    for rank, (u, v, _) in enumerate(merges):
        further, x, limit = 0, v, rank
        while True:
            if x in ranks and (k := bisect_left(ranks[x], limit)):
                further = max(further, tops[x][k - 1])
            if x not in made:
                break
            limit, x = made[x]
        reach = length[v] + further
        ranks.setdefault(u, []).append(rank)
        so_far = tops.setdefault(u, [])
        so_far.append(max(reach, so_far[-1] if so_far else 0))
        most = max(most, reach)
    return most


class Transducer:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.token_bytes = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.byte_id = np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int32)
        m = np.array(self.merges, np.int64)
        keys = m[:, 0] << 32 | m[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order], order.astype(np.int32)
        # One probe finds nearly all pairs; slots that several pairs share are left to the sorted keys.
        self.slot_key, self.slot_rank = np.full(1 << 20, -1, np.int64), np.full(1 << 20, NONE)
        slot = self._slot(m[:, 0], m[:, 1])
        self.slot_key[slot], self.slot_rank[slot] = keys, np.arange(len(keys), dtype=np.int32)
        self.shared = np.bincount(slot, minlength=1 << 20) > 1
        self.merged = m[:, 2].astype(np.int32)
        self.lookahead = sufficient_lookahead(self.merges, {i: len(b) for i, b in self.bytes_of.items()})
        #: A piece longer than this is cut at stable tokens.
        self.window = max(4096, 4 * self.lookahead)
        self.pattern = regex.compile(PATTERN.replace(r"\S", WHITE.replace("[", "[^", 1)).replace(r"\s+", WHITE + "+").replace(r"[^\s", "[^" + WHITE[1:-1]))
        self.mark = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    # -- merging -----------------------------------------------------------

    @staticmethod
    def _slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left.astype(np.uint32) * np.uint32(0x9E3779B1) ^ right.astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(12)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key, slot = left.astype(np.int64) << 32 | right, self._slot(left, right)
        out = np.where(self.slot_key[slot] == key, self.slot_rank[slot], NONE)
        more = np.flatnonzero(self.shared[slot])
        at = np.minimum(np.searchsorted(self.keys, key[more]), len(self.keys) - 1)
        out[more] = np.where(self.keys[at] == key[more], self.key_rank[at], NONE)
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each piece has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return self._merge(np.frombuffer(b"".join(pieces), np.uint8), np.repeat(np.arange(len(pieces), dtype=np.int32), sizes), len(pieces))

    def _merge(self, raw: np.ndarray, piece: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Merges bytes within each of ``n`` pieces.

        In each round every piece applies its merge of lowest rank; finished
        pieces leave.
        """
        tok = self.byte_id[raw]
        done_ids, done_piece = [], []
        rank = np.full(len(tok), NONE)
        inner = np.flatnonzero(piece[:-1] == piece[1:])
        rank[inner] = self._ranks(tok[inner], tok[inner + 1])
        while len(tok):
            first = np.empty(len(tok), bool)
            first[0] = True
            np.not_equal(piece[1:], piece[:-1], out=first[1:])
            starts = np.flatnonzero(first)
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(starts, append=len(tok))
            done = best == NONE
            if done.any():
                ended = np.repeat(done, sizes)
                done_ids.append(tok[ended])
                done_piece.append(piece[ended])
                alive = ~ended
                tok, piece, rank = tok[alive], piece[alive], rank[alive]
                best, sizes = best[~done], sizes[~done]
                if not len(tok):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            new_run = np.diff(at, prepend=-2) > 1  # of "aaa" the first two merge, the third is left over
            if not new_run.all():
                run_start = np.maximum.accumulate(np.where(new_run, at, 0))
                at = at[(at - run_start) % 2 == 0]
            tok[at] = self.merged[rank[at]]
            keep = np.ones(len(tok), bool)
            keep[at + 1] = False
            changed = np.zeros(len(tok), bool)
            changed[at] = True
            changed[np.maximum(at - 1, 0)] = True
            tok, piece, rank, changed = tok[keep], piece[keep], rank[keep], np.flatnonzero(changed[keep])
            after = np.minimum(changed + 1, len(tok) - 1)
            new = self._ranks(tok[changed], tok[after])
            new[(changed == len(tok) - 1) | (piece[changed] != piece[after])] = NONE
            rank[changed] = new
        if not done_ids:
            return tok, np.zeros(n, np.int64)
        ids, of = np.concatenate(done_ids), np.concatenate(done_piece)
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=n)

    def piece_stream(self, chunks: Iterable[bytes]) -> Iterator[np.ndarray]:
        """Ids of one piece that arrives in chunks, each given out once it is stable."""
        held = b""
        for chunk in chunks:
            held += chunk
            while len(held) > self.window:
                part = held[: self.window]
                ids, _ = self.merge([part])
                ends = np.cumsum([len(self.token_bytes[i]) for i in ids])
                n = int(np.searchsorted(ends, len(part) - self.lookahead, "right"))
                yield ids[:n]
                held = held[int(ends[n - 1]) :]
        if held:
            yield self.merge([held])[0]

    def _pieces(self, pieces: list[str]) -> list[np.ndarray]:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        long = {i for i, b in enumerate(raw) if len(b) > self.window}
        ids, counts = self.merge([b"" if i in long else b for i, b in enumerate(raw)])
        out = np.split(ids, np.cumsum(counts)[:-1])
        for i in long:
            out[i] = np.concatenate(list(self.piece_stream([raw[i]])))
        return out

    # -- texts -------------------------------------------------------------

    def _slow(self, text: str) -> np.ndarray:
        """Ids of any text, through the pattern itself."""
        parts = self.mark.split(text) if self.mark else [text]
        out = [np.array([self.special[p]], np.int32) if p in self.special else x for p in parts if p for x in ([None] if p in self.special else self._pieces(self.pattern.findall(p)))]
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def _words(self, raw: np.ndarray, starts: np.ndarray, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that lie one after another, and how many each has.

        A word begins at a free cut.  Where it holds only letters up to U+017F,
        ASCII digits and marks, single line feeds and a space in front, its
        pieces are the runs of one class; for the others the pattern decides.
        """
        n = len(starts) - 1
        word = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
        kind = KINDS[raw]
        begin = np.zeros(len(raw), bool)
        begin[starts[:-1][np.diff(starts) > 0]] = True
        bad = kind == 0
        bad |= (kind == SPACE) & ~begin
        after = np.flatnonzero((raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC5) & ~bad[:-1])
        lead = raw >= 0xC3
        trail = (raw >= 0x80) & ~lead
        bad[:-1] |= lead[:-1] & ~trail[1:]
        bad[-1:] |= lead[-1:]
        bad[1:] |= trail[1:] & ~lead[:-1]
        bad[after] |= (raw[after] == 0xC3) & ((raw[after + 1] == 0x97) | (raw[after + 1] == 0xB7))
        white = (kind == SPACE) | (kind == FEED)
        bad[1:] |= white[1:] & white[:-1] & ~begin[1:]
        slow = slow.copy()
        slow[word[bad]] = True
        sizes = np.diff(starts)
        slow |= sizes > self.window
        edge = begin.copy()
        edge[1:] |= (kind[1:] != kind[:-1]) & ~((kind[:-1] == SPACE) & (kind[1:] != FEED))
        fast = ~slow[word]
        edge, word_of_edge = edge[fast], word[fast]
        piece = np.cumsum(edge, dtype=np.int32) - 1
        ids, counts = self._merge(raw[fast], piece, int(piece[-1]) + 1 if len(piece) else 0)
        per_word = np.bincount(word_of_edge[edge], weights=counts, minlength=n).astype(np.int64)
        if slow.any():
            at = np.cumsum(per_word)
            which = np.flatnonzero(slow)
            found = [self._slow(raw[starts[w] : starts[w + 1]].tobytes().decode("utf-8", "surrogatepass")) for w in which]
            ids = np.insert(ids, np.repeat(at[which], [len(x) for x in found]), np.concatenate(found)) if found else ids
            per_word[which] = [len(x) for x in found]
        return ids, per_word

    def windows(self, texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array | Iterator[np.ndarray]]]:
        """(first text, texts) of windows of at most ``size`` bytes; for a longer text (its number, its stable tokens as they leave)."""
        start = held = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            if held + n > size:
                if i > start:
                    yield start, texts.slice(start, i - start)
                start, held = i, 0
            if n > size:
                text = texts[i].as_py()
                yield i, self.stream(text[k : k + size] for k in range(0, len(text), size))
                start, held = i + 1, 0
            else:
                held += n
        if start < len(texts):
            yield start, texts.slice(start)

    def encode_arrow(self, texts: pa.Array, window: int | None = None) -> pa.ListArray:
        """Ids of each text, through windows of a fixed size; beside the ids that have left, one window is held."""
        ids, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for i, part in self.windows(texts, window or WINDOW):
            if isinstance(part, pa.Array):
                found = self._window(part)
                ids.append(found.values.to_numpy())
                counts[i : i + len(part)] = np.diff(found.offsets.to_numpy())
            else:
                for stable in part:
                    ids.append(stable)
                    counts[i] += len(stable)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(np.concatenate(ids).astype(np.int32, copy=False)))

    def _window(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text of one window.  Words that recur in it are merged once."""
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets - offsets[0]
        # words: from each text's start, and from each space that is a free cut
        space = np.flatnonzero(raw == 32)
        if not len(raw):
            return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), pa.array([], pa.int32()))
        cut = np.zeros(len(raw) + 1, bool)
        cut[ends] = True
        held = TAILS[raw[np.maximum(space - 1, 0)]] & (HEADS[raw[np.minimum(space + 1, len(raw) - 1)]] | cut[space + 1])
        cut[space[~held]] = True
        starts = np.flatnonzero(cut)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        names = words.dictionary
        index = np.asarray(words.indices)
        at = np.frombuffer(names.buffers()[1], np.int64)[: len(names) + 1]
        slow = np.zeros(len(names), bool)
        odd = []
        for mark in self.special:
            if mark.encode() in raw.tobytes():
                odd = [i for i in range(n) if mark.encode() in raw[ends[i] : ends[i + 1]].tobytes()]
        ids, counts = self._words(np.frombuffer(names.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0], slow)
        begins = np.cumsum(counts) - counts
        size = counts[index]
        upto = np.cumsum(size)
        flat = ids[np.repeat(begins[index] - (upto - size), size) + np.arange(upto[-1])]
        at = np.r_[0, upto][np.searchsorted(starts, ends)]
        if odd:
            per_text = np.split(flat, at[1:-1])
            for i in odd:
                per_text[i] = self._slow(raw[ends[i] : ends[i + 1]].tobytes().decode("utf-8", "surrogatepass"))
            flat, at = np.concatenate(per_text), np.cumsum([0, *map(len, per_text)])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))

    def encode(self, text: str) -> list[int]:
        return self._whole(text).tolist()

    def _whole(self, text: str) -> np.ndarray:
        return self._window(pa.array([text], pa.large_string())).values.to_numpy()

    def stream(self, chunks: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of a text that arrives in chunks, in memory that does not grow with it.

        The transducer holds back the text after the last free cut.  Where there
        is none within a window (one endless word), the open piece streams on
        through ``piece_stream`` with the sufficient lookahead.
        """
        held, hold = "", max(map(len, self.special), default=1) - 1 or 1
        for chunk in chunks:
            held += chunk
            if self.mark:
                *parts, held = self.mark.split(held)
                for s in parts:
                    yield self._whole(s)
            end = len(held) - hold
            cut = next((i for i in range(end - 1, 0, -1) if held[i] == " " and not re.match(WHITE, held[i + 1]) and not re.match(WHITE, held[i - 1])), 0)
            if cut:
                yield self._whole(held[:cut])
                held = held[cut:]
            elif end > self.window:
                yield from self._spaceless(held[:end])
                held = self._left + held[end:]
        if held:
            yield self._whole(held)

    def _spaceless(self, text: str) -> Iterator[np.ndarray]:
        """All of a text without free cuts but its last two pieces; of a single long piece all stable tokens."""
        found = self.pattern.findall(text)
        if len(found) > 2:
            yield np.concatenate(self._pieces(found[:-2]))
            self._left = "".join(found[-2:])
            text = self._left
            found = found[-2:]
        self._left = text
        if len(found[0]) > self.window and len(found) == 1:
            raw = found[0][:-1].encode("utf-8", "surrogatepass")
            ids, _ = self.merge([raw])
            ends = np.cumsum([len(self.token_bytes[i]) for i in ids])
            n = int(np.searchsorted(ends, len(raw) - self.lookahead, "right"))
            while n and (raw[ends[n - 1] : ends[n - 1] + 1] or b"a")[0] & 0xC0 == 0x80:
                n -= 1  # the rest must be text, so the cut is between characters
            if n and not re.match(WHITE, found[0][0]) or n and re.fullmatch(WHITE + "+", found[0]):
                yield ids[:n]
                self._left = raw[ends[n - 1] :].decode("utf-8", "surrogatepass") + found[0][-1]

    def decode_stream(self, ids: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of ids that arrive in chunks; unfinished characters wait, wrong bytes become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        look = self.token_bytes.__getitem__
        for chunk in ids:
            if text := machine.decode(b"".join(map(look, chunk))):
                yield text
        if text := machine.decode(b"", final=True):
            yield text

    def decode(self, ids: np.ndarray | list[int]) -> str:
        ids = np.asarray(ids, np.int64)
        return "".join(self.decode_stream(ids[k : k + IDS].tolist() for k in range(0, len(ids), IDS)))


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """One transducer for each file and process."""
    return Transducer(path)


#: Bytes of texts whose ids leave as one batch of rows.
BLOCK = 16_000_000


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges (start, length) of rows of about ``limit`` bytes; a longer text is a range of its own."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if size and size + n > limit:
            yield start, i - start
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts) - start


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of each row.  Null texts count as empty: no ids.

    Row by row and without a shuffle; repeated rows give repeated results, other
    columns are left out.
    """

    def step(batches):
        t = transducer(path)
        for b in batches:
            for i, n in blocks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), t.encode_arrow(b.column(1).slice(i, n))], [key, "ids"])

    return df.select(key, text).mapInArrow(step, f"`{key}` {dict(df.dtypes)[key]}, ids array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) of each row's ids; null ids give the empty text, ids without a token nothing."""

    def step(batches):
        t = transducer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(step, f"`{key}` {dict(df.dtypes)[key]}, text string")


def round_trip(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded) of each row: ``encode`` and ``decode`` in one pass over the rows."""

    def step(batches):
        t = transducer(path)
        for b in batches:
            for i, n in blocks(b.column(1)):
                ids = t.encode_arrow(b.column(1).slice(i, n))
                at, flat = ids.offsets.to_pylist(), ids.values.to_numpy()
                back = [t.decode(flat[j:k]) for j, k in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), ids, pa.array(back, pa.string())], [key, "ids", "decoded"])

    return df.select(key, text).mapInArrow(step, f"`{key}` {dict(df.dtypes)[key]}, ids array<int>, decoded string")


def ids_digest(ids: str = "ids"):
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.transform(F.col(ids), lambda x: x.cast("string")), ","), 256)
