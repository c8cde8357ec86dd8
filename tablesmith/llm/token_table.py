"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids.

Documents lie in ascending order of their ids, over all files and within each, so a search for ids skips files and
stripes by their statistics and row groups by the Bloom filter, and readers take stripes side by side.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import new_path, ship, table
from tablesmith.llm.wordscan import FOLD, HashIndex, blocks, chunks, leading, mix, runs

END_ID = 1
#: Words whose ids a worker remembers.
CACHED_WORDS = 1 << 20
#: Marks that end words; an apostrophe isn't one of them, as tokenizers split contractions there.
MARKS = b".,!?;:*&%$#|)\""

_GAP, _MARK, _LETTER = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b" \n", MARKS, bytes(range(65, 91)) + bytes(range(97, 123))))
_coders: dict[tuple[str, int], TextCoder] = {}


class TextCoder:
    """Encodes texts word by word with a tokenizer of the tokenizers library, each distinct word once.

    Right for tokenizers whose pre-tokens never span white space and whose normaliser drops it, as the text then
    has the ids of its words, one after the other. Texts are split at spaces and line feeds only; other white space
    is left to the tokenizer. Up to four marks behind an ASCII letter are words of their own, if the tokenizer parts
    them there anyway. Words are cut, looked up and put together over whole buffers: a word of up to 16 bytes is known
    by these bytes themselves, in a table sorted by their hash; longer ones, and those with NUL or `<`, which special
    tokens begin with, by a dictionary.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # plain words can go to the model directly if case and pre-tokenising make no difference to them
        probe = ["the", "Reading", "XQZ", "s", "wordsworthian"]
        self.plain = [self._model(w.lower()) for w in probe] == self._whole(probe)
        self.splits = self._whole(["word.,", 'Etx*&")']) == [a + b for a, b in zip(self._whole(["word", "Etx"]), self._whole([".,", '*&")']), strict=True)]
        #: Ids of all entries and where each begins; entry 0 is the end of a text. Entries that the table lacks by key.
        self.ids, self.first = array("i", [end_id]), array("q", [0, 1])
        self.known: dict[bytes, int] = {}
        self.lo, self.hi, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.index = HashIndex(np.zeros(0, np.uint64))

    def _model(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _add(self, keys: list[bytes]) -> None:
        """Entries for words that have none."""
        direct = [self.plain and k.isalpha() and k.islower() for k in keys]  # of bytes, these are about ASCII
        rest = iter(self._whole([k.decode() for k, d in zip(keys, direct, strict=True) if not d]))
        for k, d in zip(keys, direct, strict=True):
            self.known[k] = len(self.first) - 1
            self.ids.extend(self._model(k.decode()) if d else next(rest))
            self.first.append(len(self.ids))

    @staticmethod
    def _hash(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix(lo + mix(hi ^ np.uint64(0x9E3779B97F4A7C15)))

    def _settle(self) -> None:
        """Forget entries beyond the limit, and move short words from the dictionary to the table once there are enough."""
        if len(self.first) - 1 > CACHED_WORDS:
            del self.ids[self.first[CACHED_WORDS] :]
            del self.first[CACHED_WORDS + 1 :]
            self.known = {k: e for k, e in self.known.items() if e < CACHED_WORDS}
        short = [(k, e) for k, e in self.known.items() if len(k) <= 16 and not _odd(k)] if len(self.known) > 4096 + len(self.entry) // 4 else []
        if len(short) <= 4096 + len(self.entry) // 4:
            return
        own = np.frombuffer(b"".join(k.ljust(16, b"\0") for k, _ in short), "<u8").reshape(-1, 2)
        lo, hi = np.concatenate((self.lo, own[:, 0])), np.concatenate((self.hi, own[:, 1]))
        entry = np.concatenate((self.entry, [e for _, e in short]))
        order = np.argsort(h := self._hash(lo, hi))
        self.lo, self.hi, self.entry, self.index = lo[order], hi[order], entry[order], HashIndex(h[order])
        self.known = {k: e for k, e in self.known.items() if len(k) > 16 or _odd(k)}

    def _words(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end, marks at their ends apart."""
        start, stop = runs(~_GAP[raw], at)
        if not self.splits or not len(start):
            return start, stop
        last = stop - 1
        for _ in range(4):
            last -= _MARK[raw[last]] & (last > start)
        cut = (last < stop - 1) & _LETTER[raw[last]]
        spot = np.arange(len(start)) + np.cumsum(cut) - cut
        begin, end = np.empty(len(start) + int(cut.sum()), np.int64), np.empty(len(start) + int(cut.sum()), np.int64)
        begin[spot], end[spot] = start, np.where(cut, last + 1, stop)
        begin[spot[cut] + 1], end[spot[cut] + 1] = last[cut] + 1, stop[cut]
        return begin, end

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a buffer (offsets at), each with the end id, and how many belong to each text."""
        start, stop = self._words(raw, at)
        size = stop - start
        folded = np.zeros(len(raw) + 24, np.uint8)
        folded[: len(raw)] = FOLD[raw] if self.plain else raw
        odd = np.flatnonzero((raw == 0) | (raw == ord("<")))
        strange = np.searchsorted(start, odd, "right") - 1
        ahead = blocks(folded)
        lo, hi = leading(ahead, start, size), leading(ahead, start + 8, np.maximum(size - 8, 0))
        place = self.index.find(self._hash(lo, hi))
        hit = (place >= 0) & (size <= 16)
        hit[strange] = False
        on = np.flatnonzero(hit)
        hit[on] = (self.lo[place[on]] == lo[on]) & (self.hi[place[on]] == hi[on])
        entry = np.zeros(len(start), np.int64)
        entry[hit] = self.entry[place[hit]]
        rest = np.flatnonzero(~hit)
        text, plain, marked = folded.tobytes(), raw.tobytes() if len(odd) else b"", set(strange.tolist())
        keys = [(plain if i in marked else text)[a:b] for i, a, b in zip(rest.tolist(), start[rest].tolist(), stop[rest].tolist(), strict=True)]
        self._add([k for k in dict.fromkeys(keys) if k not in self.known])
        entry[rest] = [self.known[k] for k in keys]
        ends = np.searchsorted(start, at[1:])
        entry = np.insert(entry, ends, 0)
        first = np.frombuffer(self.first, np.int64)
        begin = first[entry]
        many = first[entry + 1] - begin
        upto = np.cumsum(many)
        flat = np.frombuffer(self.ids, np.int32)[np.repeat(begin - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)]
        del first
        self._settle()
        return flat, np.diff(upto[ends + np.arange(len(ends))], prepend=0)


def _odd(word: bytes) -> bool:
    return b"\0" in word or b"<" in word


def coder(path: str, end_id: int) -> TextCoder:
    if (path, end_id) not in _coders:
        _coders[path, end_id] = TextCoder(path, end_id)
    return _coders[path, end_id]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Encode docs (doc_id, text) and write path: part, seq (row in its part), doc_id, ids (with end_id at the end).

    Null texts count as empty and hold the end id alone. Null ids come first; rows that repeat an id follow each
    other in the order of a hash of their texts. An empty table gives files without rows.
    """

    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seq = coder(tokenizer, end_id), 0
        for batch in batches:
            for lo, hi, raw, at in chunks(batch.column(1)):
                flat, many = code.encode(raw, at)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(range(seq, seq + hi - lo), pa.int64()), batch.column(0).slice(lo, hi - lo), lists], ["seq", "doc_id", "ids"])
                seq += hi - lo

    rows = docs.select("doc_id", "text").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    out = rows.mapInArrow(encode, f"seq long, doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>").select(F.spark_partition_id().alias("part"), "seq", "doc_id", "ids")
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000"}
    out.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, doc_id (of the type with which it was written) and ids."""
    return spark.read.orc(path).select("part", "seq", "doc_id", "ids")


def find_tokens(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """Rows of some documents; the filter reaches the ORC reader, which prunes by statistics and Bloom filters."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(doc_ids))


def summary(tokens: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 for each document of a token table."""

    @F.arrow_udf("bigint")
    def crc(ids: pa.Array) -> pa.Array:
        flat, offsets = ids.values, ids.offsets.to_pylist()
        raw = memoryview(flat.buffers()[1])[flat.offset * 4 :] if len(flat) else b""
        return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:], strict=False)], pa.int64())

    slim = tokens.select("part", "seq", "doc_id", F.size("ids").cast("long").alias("n_tokens"), crc("ids").alias("ids_crc32"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = tokens.groupBy("part").agg(F.sum(F.size("ids").cast("long")).alias("n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    slim = slim.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return slim.join(parts, "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return summary(read_tokens(spark, path))


QUERIES = {"op6_token_table": op6_token_table}
ORACLES = {}
