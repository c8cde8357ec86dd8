"""Texts as blocks: the distinct symbols of about BLOCK bytes of text, and the texts as sequences of their numbers.

What is known of a symbol all over the corpus meets the blocks that hold it, not its occurrences: a block sends each
of its symbols once, and what comes back is looked up by number. Tables of blocks are bucketed by block, so what
comes back is joined to them without moving the sequences.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.common import new_path
from tablesmith.llm.wordscan import LONG, blocks, buffers, chunks, hash_words, leading

#: Bytes of text in a block, and in a piece of it that is worked on at a time; a longer text is a block of its own.
BLOCK, PIECE = 64 << 20, 1 << 20
#: Bytes of Parquet for each bucket of a table of blocks, at most so many buckets.
BUCKET, MOST_BUCKETS = 128 << 20, 20_000


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32, their bytes by place, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 3)


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def gather(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Places first[i], first[i]+1, ... (many[i] of them) for each i, one after the other."""
    upto = np.cumsum(many)
    return np.repeat(first - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)


def number(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its number among the distinct ones, and the first place of each of these.

    Words are told apart by 64-bit hashes; all bytes are compared with those of the first of the same hash, and should
    two words ever share one, numbers come from the words themselves.
    """
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    codes, _ = pd.factorize(hash_words(padded, start, stop))
    first = _first(codes)
    if not _same(padded, start, stop, first[codes]):
        codes, _ = pd.factorize(np.array([bytes(raw[a:b]) for a, b in zip(start, stop, strict=True)], object))
        first = _first(codes)
    return codes, first


def _first(codes: np.ndarray) -> np.ndarray:
    """The first place of each code."""
    first = np.zeros(int(codes.max(initial=-1)) + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)  # the last one written stays
    return first


def _same(padded: np.ndarray, start: np.ndarray, stop: np.ndarray, other: np.ndarray) -> bool:
    """Whether each word has the bytes of another (by place among the words)."""
    size, ahead = stop - start, blocks(padded)
    if (size != size[other]).any():
        return False
    at = np.arange(len(start))
    for k in range(0, LONG, 8):
        at = at[size[at] > k]
        if not len(at):
            return True
        left = size[at] - k
        if (leading(ahead, start[at] + k, left) != leading(ahead, start[other[at]] + k, left)).any():
            return False
    at = at[size[at] > LONG]
    return all(padded[start[i] : stop[i]].tobytes() == padded[start[j] : stop[j]].tobytes() for i, j in zip(at.tolist(), other[at].tolist(), strict=True))


class Block:
    """The distinct symbols of texts that are added piece by piece, and the numbers of all their symbols."""

    def __init__(self):
        self.symbols, self.sequence, self.size, self.bytes = [], [], 0, 0

    def add(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        """The words at start..stop of a buffer; -1 in both stands for a gap."""
        words = np.flatnonzero(start >= 0)
        start, stop, numbers = start[words], stop[words], np.full(len(start), -1, np.int32)
        codes, first = number(raw, start, stop)
        a, size = start[first], stop[first] - start[first]
        at = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        flat = raw[gather(a, size)]
        self.symbols.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(at), pa.py_buffer(flat)]))
        numbers[words] = codes + self.size
        self.size += len(a)
        self.sequence.append(numbers)
        self.bytes += len(raw)

    def finish(self, buckets: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct symbols, bucket by bucket and more frequent ones first; where each bucket begins; how often each number occurs; the numbers of all symbols.

        A symbol's bucket is the same in all blocks. Number 0 is a gap; the symbol at place i of bucket b has number
        1 + i * buckets + b, so it needn't be told, and frequent symbols have small numbers.
        """
        symbols = pa.concat_arrays(self.symbols).cast(pa.binary()) if self.symbols else pa.array([], pa.binary())
        self.symbols = []
        coded = symbols.dictionary_encode()  # pieces hold the same words
        distinct, kind = coded.dictionary, np.append(coded.indices.to_numpy(), np.int32(-1))
        counts = np.zeros(len(distinct) + 1, np.int64)  # the last place is for gaps
        for k, part in enumerate(self.sequence):
            self.sequence[k] = kind[part]
            counts += np.bincount(self.sequence[k] + (self.sequence[k] < 0) * len(counts), minlength=len(counts))
        at, flat = buffers(distinct)
        padded = np.concatenate((flat[: at[-1]], np.zeros(8, np.uint8)))
        bucket = (hash_words(padded, at[:-1], at[1:]) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((-counts[:-1], bucket))
        ends = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))
        place = np.zeros(len(counts), np.int32)
        place[order] = 1 + (np.arange(len(order)) - ends[bucket[order]]) * buckets + bucket[order]
        for k, part in enumerate(self.sequence):
            self.sequence[k] = place[part]  # -1, a gap, is the last place
        numbers = np.concatenate(self.sequence) if self.sequence else np.zeros(0, np.int32)
        self.sequence = []
        often = np.zeros(int(place.max(initial=0)) + 1, np.int64)
        often[place] = counts
        return distinct.take(pa.array(order)), ends, often, numbers


def by_bucket(symbols: pa.Array, ends: np.ndarray) -> pa.Array:
    """One list of lists: the symbols of each bucket."""
    inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), symbols)
    return pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)


def exploded(texts: DataFrame, buckets: int) -> DataFrame:
    """(block, number, symbol) for the symbols of blocks, each bucket in a partition of its own; a block's symbols of a bucket move as one row."""
    rows = texts.select("block", F.posexplode("symbols").alias("bucket", "symbols")).filter("size(symbols) > 0")
    rows = rows.repartitionById(buckets, "bucket").select("block", "bucket", F.posexplode("symbols").alias("at", "symbol"))
    return rows.select("block", (F.col("at") * buckets + F.col("bucket") + 1).alias("number"), "symbol")


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, the bytes of their texts and where each text begins: about `size` bytes or one text at a time."""
    for batch in batches:
        for lo, hi, raw, at in chunks(batch.column(column), size):
            yield batch.slice(lo, hi - lo), raw, at


def read_size(df: DataFrame) -> int:
    """Bytes of the files and tables that df reads, as far as Spark knows them before it runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)  # beyond, Spark has no idea


def block_id(partition: int, nth: int) -> int:
    return partition << 32 | nth


def buckets_for(df: DataFrame) -> int:
    """Buckets of a table of blocks of df's texts, by the size of what it reads."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, read_size(df) // BUCKET))


def bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """df written to the shared folder, bucketed by its column block, and read back."""
    spark = df.sparkSession
    known, path = f"tablesmith_{name}_{uuid.uuid4().hex}", new_path(spark, name)
    atexit.register(_forget, spark, known)
    df.write.bucketBy(buckets, "block").option("path", path).option("compression", "zstd").saveAsTable(known)
    return spark.table(known)


def _forget(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
