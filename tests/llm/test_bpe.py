"""Byte-level BPE against the library, and the blocks of texts against plain Python."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tablesmith.llm import blocks, byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = [*"aZbé1٣Ⅷ²'’!?#_-中́\U0001f600\n\t\r\x0b\x1c\x85  　", "  ", " ", " ", " '", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "don't", " the", "\r\n", "<|endoftext|>", "\x00", "՘", "Ᲊ"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def awkward(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]


def buffer(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def test_cutter(library):
    """Cut one by one, the pieces give the ids of the whole text, and none of them is cut further by the library."""
    probe = {bytes([x]): x for x in range(256)}
    joined = {a + b for a in probe for b in probe}
    pairs = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=probe | {p: 256 + i for i, p in enumerate(sorted(joined))}, special_tokens={})
    texts = awkward(5000)
    raw, at = buffer(texts)
    start, stop = byte_bpe.Cutter(public_tokenizers.PATTERN).cut(raw, at)
    first = np.searchsorted(start, at)
    for i, t in enumerate(texts):
        cut = [bytes(raw[a:b]).decode() for a, b in zip(start[first[i] : first[i + 1]], stop[first[i] : first[i + 1]], strict=True)]
        assert "".join(cut) == t
        assert [x for c in cut for x in pairs.encode_ordinary(c)] == pairs.encode_ordinary(t), t
        for a, b in zip(cut, cut[1:], strict=False):  # no two of them are one match
            assert not re.fullmatch(r" ?[a-z]+", a + b), t


def test_encode_and_decode(spark, library):
    texts = [*awkward(400, 2), None, "", " ", "x" * 3000, "the " * 5000, "ÉTÉ été", "the", "the"]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("block", "docs", "numbers", "symbols", "known", "word", "ids", "place")})
    got = byte_bpe.decode(byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    key = lambda i, ids: (-1 if i is None else i, ids)
    assert sorted(key(r.doc_id, r.ids) for r in got) == sorted(key(i, library.encode_ordinary(t or "")) for i, t in rows)
    assert all(bytes(r.decoded) == library.decode_bytes(r.ids) for r in got)
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_string_ids_and_many_blocks(spark, library):
    texts = awkward(300, 3)
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(7)
    got = {r.doc_id: r.ids for r in byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert got == {f"d{i}": library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_blocks_are_cut_at_their_size(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} " * 50) for i in range(40)], "doc_id long, text string").repartition(2)
    byte_bpe.ship(spark)
    got = byte_bpe.cut_blocks(docs, public_tokenizers.PATTERN, 5, size=900).collect()
    assert len(got) == len({r.block for r in got}) > 10
    told = {d.doc_id: d.n for r in got for d in r.docs}
    assert told == {i: 101 for i in range(40)}  # word, number, ..., space
    for r in got:
        words = [(1 + i * 5 + b, bytes(w)) for b, bucket in enumerate(r.symbols) for i, w in enumerate(bucket)]
        assert len(r.symbols) == 5 and len({w for _, w in words}) == len(words)
        assert set(blocks.unpack(r.numbers).tolist()) == {n for n, _ in words}


def test_joined_sequences_stay_where_they_are(spark):
    """What is known of the words is shuffled to the blocks; the blocks are read as they are bucketed."""
    docs = spark.createDataFrame([(i, f"word{i} the") for i in range(20)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 2  # words to words, ids to blocks
    assert "Bucketed: true" in plan


@pytest.mark.parametrize("small", [byte_bpe.SMALL_VOCABULARY, 0])
def test_decoding_of_what_is_not_there(spark, library, small):
    rows = [(1, [5, 6, 7]), (2, None), (3, []), (4, [5, 60000]), (5, [-1]), (6, [None, 5]), (7, library.encode_ordinary("été \U0001f600"))]
    tokens = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("decoded", F.lit("old")).withColumn("__id", F.lit(0))
    got = {r.doc_id: None if r.decoded is None else bytes(r.decoded) for r in byte_bpe.decode(tokens, PATH, small=small).collect()}
    assert got == {1: library.decode_bytes([5, 6, 7]), 2: None, 3: b"", 4: None, 5: None, 6: None, 7: "été \U0001f600".encode()}


def test_numbers_of_words_that_share_a_hash(monkeypatch):
    words = [b"a", b"b", b"a", b"longer-than-eight", b"longer-than-eighT", b"x" * 70, b"x" * 69 + b"y", b"b"]
    raw = np.frombuffer(b"".join(words), np.uint8)
    stop = np.cumsum([len(w) for w in words])
    start = np.concatenate(([0], stop[:-1]))
    for bits in (64, 1, 0):
        real = blocks.hash_words
        monkeypatch.setattr(blocks, "hash_words", lambda *a, real=real, bits=bits: real(*a) % np.uint64(2) if bits == 1 else real(*a) * np.uint64(bits > 0))
        codes, first = blocks.number(raw, start, stop)
        assert [words[first[c]] for c in codes] == words
        assert len(first) == 6
        monkeypatch.undo()


@pytest.mark.parametrize("numbers", [[], [0], [1, 2**32 - 1, 70000, 0]])
def test_packing(numbers):
    assert blocks.unpack(blocks.pack(np.array(numbers, np.int64))).tolist() == numbers


def test_token_files_keep_the_type_of_ids(spark, tmp_path):
    from tablesmith.llm import token_table

    path = str(tmp_path / "t")
    docs = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, "")], "doc_id string, text string")
    token_table.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), path)
    got = [r.doc_id for r in token_table.summary(token_table.read_tokens(spark, path)).orderBy("start").collect()]
    assert got == [None, "a", "b"]
    assert token_table.find_tokens(spark, path, ["b"]).count() == 1
