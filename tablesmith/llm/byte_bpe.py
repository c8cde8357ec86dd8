"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens, numbered within blocks of texts. A block sends each of its distinct pre-tokens once;
sorted by pre-token, all blocks' copies of one lie side by side, so each distinct one of the corpus is encoded once,
and its ids go back to the blocks that hold it. There the texts are put together again by position. Decoding joins
the ids with the table of the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.blocks import BLOCK, PIECE, Block, block_id, bucketed, buckets_for, by_bucket, exploded, gather, pack, pieces, unpack
from tablesmith.llm.common import materialise, ship, table
from tablesmith.llm.wordscan import buffers

#: Bytes of a vocabulary that is sent to every task; the tokens of a larger one are joined.
SMALL_VOCABULARY = 64 << 20
#: Pre-tokens that are put together, and ids that are decoded, at a time.
AT_A_TIME = 1 << 18

SPACE, LETTER, NUMERAL, OTHER, UNKNOWN = 0, 1, 2, 3, 255
_cutters: dict[str, Cutter] = {}
#: By digest of the vocabulary: what a worker has made of it.
_coders: dict[tuple, object] = {}


class Cutter:
    """Cuts texts into matches of the pattern of byte-level BPE, many texts at once.

    The pattern: a contraction ('s 't 're 've 'm 'll 'd), or a run of letters, of numerals or of anything else but
    white space, each with one space before it, or white space up to the last before a run, or white space. What is a
    letter, numeral or space is asked of the library's own pattern engine, once for each character that occurs.
    """

    def __init__(self, pattern: str):
        import tiktoken

        ranks = {bytes([x]): x for x in range(256)}
        self.leads = ((LETTER, "a"), (NUMERAL, "1"), (OTHER, "!"))
        for _, lead in self.leads:
            for x in range(256):
                ranks[lead.encode() + bytes([x])] = len(ranks)
        self.ranks, self.probe = ranks, tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self._learn(range(128))

    def _learn(self, points: Iterator[int]) -> None:
        for p in points:
            byte = chr(p).encode()[:1]
            fits = [k for k, lead in self.leads if self.probe.encode_ordinary(lead + chr(p))[0] == self.ranks[lead.encode() + byte]]
            self.kind[p] = fits[0] if fits else SPACE

    def cut(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pre-tokens of the texts in a buffer (offsets at) begin and end; they cover it."""
        point = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
        place = np.flatnonzero((raw & 0xC0) != 0x80)
        n = len(point)
        if not n:
            return place, place
        kind = self.kind[point]
        if (kind == UNKNOWN).any():
            self._learn(np.unique(point[kind == UNKNOWN]).tolist())
            kind = self.kind[point]
        first = np.zeros(n + 3, bool)  # of a text; beyond the end, all are
        first[n:] = True
        begins = np.searchsorted(place, at[:-1][np.diff(at) > 0])
        first[begins] = True
        new = first[:n].copy()
        new[1:] |= kind[1:] != kind[:-1]
        starts = np.concatenate((new, [True] * 3))
        after = np.flatnonzero(new & (kind != SPACE) & ~first[:n])
        after = after[kind[after - 1] == SPACE]
        starts[after - 1] = True
        starts[after[point[after - 1] == 0x20]] = False
        ahead = np.concatenate((point, np.zeros(3, point.dtype)))
        quote = np.flatnonzero(starts[:n] & (point == 0x27))
        quote = quote[~first[quote + 1]]
        a, b = ahead[quote + 1], ahead[quote + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ~first[quote + 2] & (((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l"))))
        starts[quote[one | two] + 1] = False
        starts[quote[one] + 2] = True
        starts[quote[two] + 3] = True
        begin = place[starts[:n]]
        return begin, np.concatenate((begin[1:], [len(raw)]))


def cutter(pattern: str) -> Cutter:
    if pattern not in _cutters:
        _cutters[pattern] = Cutter(pattern)
    return _cutters[pattern]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ids of tokens by their bytes, from a file of lines `base64 id`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.blake2b(f.read()).hexdigest()


def cut_blocks(docs: DataFrame, pattern: str, buckets: int, size: int = BLOCK) -> DataFrame:
    """Blocks of docs (doc_id, text): block, docs (doc_id and the number of pre-tokens of each), numbers (of all pre-tokens), symbols (the distinct ones by bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cut, partition, nth = cutter(pattern).cut, TaskContext.get().partitionId(), 0
        ids, many, block = [], [], Block()

        def flush() -> pa.RecordBatch:
            symbols, ends, _, numbers = block.finish(buckets)
            docs = pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.array(np.concatenate(many), pa.int64())], ["doc_id", "n"])
            return pa.RecordBatch.from_arrays(
                [pa.array([block_id(partition, nth)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.array([pack(numbers)], pa.binary()),
                 by_bucket(symbols, ends)], ["block", "docs", "numbers", "symbols"]
            )

        for rows, raw, at in pieces(batches, 1, min(PIECE, size)):
            if ids and block.bytes + len(raw) > size:
                yield flush()
                ids, many, block, nth = [], [], Block(), nth + 1
            start, stop = cut(raw, at)
            block.add(raw, start, stop)
            ids.append(rows.column(0))
            many.append(np.diff(np.searchsorted(start, at)))
        if ids:
            yield flush()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"block long, docs array<struct<doc_id {kind}, n long>>, numbers binary, symbols array<array<binary>>")


def encode_words(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """(block, number, symbol), equal symbols side by side, with the ids of each: block, number, ids. Each run of equal symbols is encoded once."""
    spark = words.sparkSession
    ranks, key = spark.sparkContext.broadcast(read_ranks(path)), digest(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        if (key, pattern) not in _coders:
            _coders[key, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        coder, last = _coders[key, pattern], (None, b"")
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            ids = []
            for word in coded.dictionary.to_pylist():
                if word != last[0]:
                    last = word, np.array(coder.encode_ordinary(word.decode()), "<u4").tobytes()
                ids.append(last[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()).take(coded.indices)], ["block", "number", "ids"])

    return words.select("block", "number", "symbol").mapInArrow(run, "block long, number int, ids binary")


def pack_ids(coded: DataFrame) -> DataFrame:
    """(block, number, ids), in the order of block and number, as rows (block, known): the numbers and ids of many symbols in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, at = batch.column(0).to_numpy(), buffers(batch.column(2))[0] // 4
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)] if len(block) else [0]
            flat = np.frombuffer(batch.column(2).buffers()[2] or b"", "<u4")
            known = [
                pack(np.concatenate(([b - a], np.diff(batch.column(1).to_numpy()[a:b], prepend=0), np.diff(at[a : b + 1]), flat[at[a] : at[b]]))) for a, b in zip(cuts, cuts[1:], strict=False)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]], pa.int64()), pa.array(known, pa.binary())], ["block", "known"])

    return coded.mapInArrow(run, "block long, known binary")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of the text for each row of docs, as the vocabulary's library would encode it, without special tokens.

    path: a file of ranks; pattern: what pre-tokens are (see Cutter). Null and empty texts have no ids, bytes that
    aren't UTF-8 count as U+FFFD, null and repeated ids are ordinary rows, an empty table gives an empty result, and
    other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias("text"))
    buckets = buckets_for(docs)
    texts = bucketed(cut_blocks(rows, pattern, buckets), "bpe_blocks", buckets)
    coded = encode_words(exploded(texts, buckets).sortWithinPartitions("symbol"), path, pattern)
    back = pack_ids(coded.sortWithinPartitions("block", "number")).repartition(buckets, "block")
    known = back.groupBy("block").agg(F.collect_list("known").alias("known"))  # the symbols of a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _assemble(batch.column(0)[k].values, batch.column(1)[k].as_py(), batch.column(2)[k].as_py() or [])

    kind = dict(docs.dtypes)["doc_id"]
    return texts.select("block", "docs", "numbers").join(known, "block", "left").select("docs", "numbers", "known").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def _unpacked(known: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each number where its ids begin and how many there are, and all ids."""
    number, many, flat = [], [], []
    for packed in known:
        x = unpack(packed).view(np.int32)
        n = x[0]
        number.append(np.cumsum(x[1 : n + 1]))
        many.append(x[n + 1 : 2 * n + 1])
        flat.append(x[2 * n + 1 :])
    if not number:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    at, size = np.concatenate(number), np.concatenate(many).astype(np.int64)
    first, count = np.zeros(int(at.max()) + 1, np.int64), np.zeros(int(at.max()) + 1, np.int64)
    first[at], count[at] = np.cumsum(size) - size, size
    return first, count, np.concatenate(flat)


def _assemble(docs: pa.Array, packed: bytes, known: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The texts of a block from the numbers of their pre-tokens and the ids of each of these."""
    numbers = unpack(packed)
    first, many, flat = _unpacked(known)
    upto = np.concatenate(([0], np.cumsum(docs.field("n").to_numpy())))
    lo = 0
    while lo < len(docs):
        hi = max(lo + 1, min(len(docs), int(np.searchsorted(upto, upto[lo] + AT_A_TIME, "right")) - 1))
        part = numbers[upto[lo] : upto[hi]]
        ids = flat[gather(first[part], many[part])]
        ends = np.concatenate(([0], np.cumsum(many[part])))[upto[lo : hi + 1] - upto[lo]]
        yield pa.RecordBatch.from_arrays([docs.field("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])
        lo = hi


def decode(tokens: DataFrame, path: str, into: str = "decoded", small: int = SMALL_VOCABULARY) -> DataFrame:
    """tokens (ids: array of int; other columns pass through) with the bytes that the ids stand for.

    Null ids give null, as does an id that the table lacks; no ids give no bytes. The table of tokens goes to each
    task if it has at most `small` bytes; else ids and tokens are joined, and the rows come together again by position.
    """
    spark = tokens.sparkSession
    ranks = read_ranks(path)
    tokens = tokens.drop(into)
    if sum(len(t) + 8 for t in ranks) > small:
        return _decode_by_join(tokens, ranks, into)
    ship(spark)
    names: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        names[i] = token
    shared, key = spark.sparkContext.broadcast(names), (digest(path),)

    @F.arrow_udf("binary")
    def bytes_of(ids: pa.Array) -> pa.Array:
        if key not in _coders:
            _coders[key] = pa.array([x or b"" for x in shared.value], pa.large_binary()), np.array([x is None for x in shared.value])
        return pa.array([x for part in _joined(ids, *_coders[key]) for x in part], pa.binary())

    return tokens.withColumn(into, bytes_of("ids"))


def _joined(lists: pa.Array, known: pa.Array, lacking: np.ndarray) -> Iterator[list[bytes | None]]:
    """The bytes of some of the lists at a time; null for a null list and one with an id that isn't known."""
    ends, lo = lists.offsets.to_numpy().astype(np.int64), 0
    while lo < len(lists):
        hi = max(lo + 1, min(len(lists), int(np.searchsorted(ends, ends[lo] + AT_A_TIME, "right")) - 1))
        ids = lists.values.slice(ends[lo], ends[hi] - ends[lo]).fill_null(-1).to_numpy()
        bad = (ids < 0) | (ids >= len(known))
        bad[~bad] = lacking[ids[~bad]]
        named = known.take(pa.array(ids[~bad]))
        at = np.frombuffer(named.buffers()[1], np.int64)[: len(named) + 1] if len(named) else np.zeros(1, np.int64)
        good = np.concatenate(([0], np.cumsum(~bad)))[ends[lo : hi + 1] - ends[lo]]
        spot, data = at[good], memoryview(named.buffers()[2] or b"")
        null = (np.diff(good) < np.diff(ends[lo : hi + 1])) | lists.slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False)
        yield [None if x else bytes(data[a:b]) for x, a, b in zip(null.tolist(), spot[:-1].tolist(), spot[1:].tolist(), strict=True)]
        lo = hi


def _decode_by_join(tokens: DataFrame, ranks: dict[bytes, int], into: str) -> DataFrame:
    spark = tokens.sparkSession
    names = spark.createDataFrame(((i, bytearray(t)) for t, i in ranks.items()), "__id int, __bytes binary")
    rows = materialise(tokens.select(F.struct("*").alias("__row"), F.col("ids").alias("__ids"), F.monotonically_increasing_id().alias("__nth")), "bpe-ids")
    each = rows.select("__nth", F.posexplode("__ids").alias("__at", "__id")).join(names, "__id", "left")
    made = each.groupBy("__nth").agg(F.array_sort(F.collect_list(F.struct("__at", F.hex("__bytes").alias("h")))).alias("parts"))
    joined = F.when(~F.exists("parts", lambda x: x["h"].isNull()), F.unhex(F.array_join(F.col("parts")["h"], "")))
    made = made.select("__nth", joined.alias(into), F.lit(True).alias("__some"))
    out = F.when(F.col("__some"), F.col(into)).otherwise(F.when(F.col("__ids").isNotNull(), F.lit(b"")))
    return rows.join(made, "__nth", "left").select("__row.*", out.alias(into))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op11_byte_bpe": op11_byte_bpe}
ORACLES = {}
