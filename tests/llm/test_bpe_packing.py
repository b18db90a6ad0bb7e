import random
import tracemalloc
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, packing
from tessera.llm.queries import op1_bpe, op9_packing, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def ours():
    return bpe.Transducer(tokenizer_path())


@pytest.fixture(scope="module")
def theirs():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


ALPHABETS = ["a b\n\t' s", "ab", "the in on", "  \n\r\xa0x'll", "é ü<|endoftext|>", ".!?-#", "0123 9a", "　 \x1c\x1dz", "日本 ñ"]


def texts(n: int, seed: int = 1) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(rnd.choice(ALPHABETS)) if rnd.random() < 0.9 else rnd.choice(["<|endoftext|>", "'ll", " the"]) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_ids_equal_the_library(ours, theirs):
    some = ["", " ", "  ", "\n", *texts(1500), *[f"a{chr(c)}b {chr(c)}{chr(c)} x{chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000]]
    want = [e.ids for e in theirs.encode_batch(some, add_special_tokens=False)]
    assert ours.encode_arrow(pa.array(some)).to_pylist() == want
    assert [ours.decode(x) for x in want] == [theirs.decode(x, skip_special_tokens=False) for x in want]


def test_stream_gives_the_same_ids_from_any_chunks(ours, theirs):
    rnd = random.Random(2)
    for s in texts(200, 3):
        cuts = sorted(rnd.sample(range(len(s) + 1), min(len(s) + 1, 5)))
        chunks = [s[i:j] for i, j in zip([0, *cuts], [*cuts, len(s)], strict=True)]
        assert [i for x in ours.stream(chunks) for i in x] == theirs.encode(s, add_special_tokens=False).ids


def test_windows_give_the_same_ids(ours, theirs):
    rnd = random.Random(6)
    some = [None, "", *texts(60, 5), " ".join(texts(300, 7)), "", "x" * 9000, " ".join(rnd.choice(["the", "onset", "of", "é日本"]) for _ in range(3000))]
    want = [e.ids for e in theirs.encode_batch([t or "" for t in some], add_special_tokens=False)]
    for window in (150, 1000, 20_000):
        assert ours.encode_arrow(pa.array(some), window).to_pylist() == want


def test_memory_does_not_grow_with_the_text(ours):
    """Peak of encoding and decoding a text that comes in chunks, at 3 MB and at 24 MB."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(5000)]

    def chunks(megabytes):
        for _ in range(4 * megabytes):
            yield "".join(" " + rnd.choice(words) for _ in range(38_000))

    def peak(megabytes):
        tracemalloc.start()
        n = sum(len(x) for x in ours.decode_stream(ids.tolist() for ids in ours.stream(chunks(megabytes))))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n, top

    (small, first), (large, second) = peak(3), peak(24)
    assert large > 7 * small and second < 1.2 * first < 200_000_000


def test_endless_words_stream_through_a_small_window(ours, theirs):
    rnd, window = random.Random(4), ours.window
    ours.window = 2 * ours.lookahead + 10
    try:
        for letters in ["etaoinsh", "ab", "a", "th", "é", "inging", ".-", "\n", " "]:
            s = "".join(rnd.choice(letters) for _ in range(5 * ours.window))
            want = theirs.encode(s, add_special_tokens=False).ids
            assert ours.encode(s) == want
            assert [i for x in ours.stream([s[i : i + 301] for i in range(0, len(s), 301)]) for i in x] == want
    finally:
        ours.window = window


def test_decoder_waits_for_whole_characters(ours):
    ids = ours.encode("é日本😀")
    assert "".join(ours.decode_stream([[i] for i in ids])) == "é日本😀"
    assert ours.decode([ours.byte_id[0xE2].item(), ours.byte_id[0x41].item()]) == "�A"


def test_lookahead_of_a_small_merge_list():
    # a+b, b+c before it: whether "ab" forms depends on a c after it
    length = {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}
    assert bpe.sufficient_lookahead([(1, 2, 3), (0, 1, 4)], length) == 2
    assert bpe.sufficient_lookahead([(0, 1, 4), (1, 2, 3)], length) == 1


def rows(spark):
    return spark.createDataFrame(
        [(1, "hello world", "x"), (2, None, "x"), (3, "", None), (1, "hello world", "y"), (None, "a " * 9000, "z")],
        "doc_id long, text string, ids string",
    )


def test_operator_on_nulls_repeats_and_clashing_columns(spark):
    got = bpe.round_trip(rows(spark), tokenizer_path()).collect()
    assert sorted(len(r.ids) for r in got)[:2] == [0, 0] and len(got) == 5
    assert {r.decoded for r in got} == {"hello world", "", "a " * 9000}
    enc = bpe.encode(rows(spark), tokenizer_path())
    assert sorted(r.text for r in bpe.decode(enc, tokenizer_path()).collect()) == sorted(["hello world", "hello world", "", "", "a " * 9000])
    assert bpe.encode(rows(spark).limit(0), tokenizer_path()).count() == 0


def test_op1_on_the_table(spark, sf_dir, theirs):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op1_bpe(spark, sf_dir).collect():
        ids = theirs.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == sha256(docs[r.doc_id].encode()).hexdigest()


def check_packing(pieces, docs, size=2048):
    at = {}
    for p in pieces:
        assert p.length > 0
        assert p.ids_crc32 == zlib.crc32(docs[p.doc_id][p.start : p.start + p.length].astype("<u4").tobytes())
        assert p.doc_tokens == len(docs[p.doc_id])
        at.setdefault(p.sequence_id, []).append((p.offset, p.length))
    padding = 0
    for s in at.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= size
        padding += 0 if end & (end - 1) == 0 else size - end
    spans = {}
    for p in pieces:
        spans.setdefault(p.doc_id, []).append((p.start, p.start + p.length))
    for d, ids in docs.items():
        s = sorted(spans[d])
        assert s[0][0] == 0 and s[-1][1] == len(ids) and all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False))
    return padding


def test_op9_on_the_table(spark, sf_dir, theirs):
    docs = {r.doc_id: np.array([*theirs.encode(r.text, add_special_tokens=False).ids, 1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check_packing(op9_packing(spark, sf_dir).collect(), docs) == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_in_small_blocks(spark, monkeypatch, seed):
    rnd = np.random.default_rng(seed)
    data = [(i, rnd.integers(0, 9, int(rnd.choice([0, 1, 7, 31, 32, 33, 64, 200]))).tolist()) for i in range(120)]
    monkeypatch.setattr(packing, "TOKENS", 300)
    packer, out = packing.Packer(32, 0), []
    for k, ids in data:
        out += packer.add(k, np.array([*ids, 1], "<u4"))
    out += packer.flush(True)
    from collections import namedtuple

    piece = namedtuple("piece", ["doc_id", *packing.COLUMNS])
    assert check_packing([piece(*r) for r in out], {k: np.array([*ids, 1]) for k, ids in data}, 32) == 0


def test_sequences_stay_apart_when_partitions_are_joined(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.integers(0, 9, 500).tolist()) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, ids array<int>").repartition(4)
    pieces = packing.pack(df).coalesce(1).collect()
    assert check_packing(pieces, {k: np.array([*ids, 1]) for k, ids in data}) == 0
    clash = spark.createDataFrame([(1, "a b", 2, 3)], "doc_id long, text string, start int, length int")
    assert [r.length for r in packing.pack_texts(clash, tokenizer_path()).collect()] == [2, 1]


def test_capacity_tree_finds_the_tightest():
    rnd, tree, have = random.Random(5), packing.CapacityTree(64), []
    for w in range(500):
        if rnd.random() < 0.6:
            c = rnd.randint(1, 64)
            tree.add(c, w)
            have.append(c)
        else:
            least = rnd.randint(1, 64)
            want = min((c for c in have if c >= least), default=None)
            got = tree.take(least)
            assert (got and got[0]) == want
            if want:
                have.remove(want)


def test_packing_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [(r.length, r.doc_tokens) for r in packing.pack(df).collect()] == [(1, 1), (1, 1)]
    assert packing.pack(df, last=None).count() == 0
    assert packing.pack_texts(rows(spark).select("doc_id", "text").limit(0), tokenizer_path()).count() == 0
    assert packing.pack_texts(rows(spark), tokenizer_path()).agg(F.countDistinct("sequence_id")).first()[0] > 0
