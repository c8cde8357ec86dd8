"""Phrases that hold together, by hierarchical pair naming.

Frequent words get names. A frequent phrase of k words is a pair of frequent phrases of k - 1 words that overlap in
all but one word each, so one level's names, side by side in the text, are the next level's candidates: blocks send
each distinct pair once, pairs are counted over the corpus, the frequent ones get names, and these go back to the
blocks that hold them. The two halves of a pair are its parents: along them a phrase finds what its cuts weigh,
how it is spelt, and which phrases lie in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.llm.blocks import BLOCK, PIECE, Block, block_id, bucketed, buckets_for, pack, pieces, unpack
from tablesmith.llm.common import materialise, ship, table
from tablesmith.llm.wordscan import FOLD, runs

#: Bytes that end a piece of a text, and those that part words within it.
ENDS, GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
_END = np.isin(np.arange(256), np.frombuffer(ENDS, np.uint8))
_SOLID = ~_END & ~np.isin(np.arange(256), np.frombuffer(GAPS, np.uint8))
#: Rows of a batch that goes back to Spark, and phrases of one language that are ranked in one place at first.
ROWS, RANKED = 1 << 16, 200_000


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts (offsets at) begin and end; -1 in both where a piece or a text ends between two."""
    start, stop = runs(_SOLID[raw], at)
    if not len(start):
        return start, stop
    ends = np.concatenate(([0], np.cumsum(_END[raw])))
    text = np.searchsorted(at, start, "right")
    cut = np.flatnonzero((ends[start[1:]] != ends[stop[:-1]]) | (text[1:] != text[:-1])) + 1
    return np.insert(start, cut, -1), np.insert(stop, cut, -1)


def cut_blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of docs (lang, text), each of one lang: block, lang, total (words), numbers (of all words, 0 for a gap), symbols (the distinct words, and how often each occurs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, nth, open_ = TaskContext.get().partitionId(), 0, {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal nth
            for lang, block in open_.items():
                symbols, _, often, numbers = block.finish(1)
                rows = pa.StructArray.from_arrays([symbols, pa.array(often[1:], pa.int64())], ["word", "n"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block_id(partition, nth)], pa.int64()), pa.array([lang], pa.string()), pa.array([int((numbers > 0).sum())], pa.int64()),
                     pa.array([pack(numbers)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], ["block", "lang", "total", "numbers", "symbols"]
                )
                nth += 1
            open_.clear()

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            for k, lang in enumerate(coded.dictionary.to_pylist()):
                mine = batch.filter(pa.array(coded.indices.to_numpy() == k))
                for _, raw, at in pieces([mine], 1, min(PIECE, size)):
                    if open_ and sum(b.bytes for b in open_.values()) + len(raw) > size:
                        yield from flush()
                    folded = FOLD[raw]
                    start, stop = words_of(folded, at)
                    block = open_.setdefault(lang, Block())
                    block.add(folded, np.append(start, -1), np.append(stop, -1))
        yield from flush()

    return docs.select("lang", "text").mapInArrow(run, "block long, lang string, total long, numbers binary, symbols array<struct<word binary, n long>>")


def name(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """rows (key, block, n, ...) of keys that occur `least` times or more, with f, how often that is, and id, a number for each key.

    rows has one row for a key and block, so a window holds no more rows than there are blocks. The number is the
    place of the key's first row in its partition, whatever the order of its rows.
    """
    rows = rows.repartition(*key).sortWithinPartitions(*key).withColumn("seq", F.monotonically_increasing_id())
    w = Window.partitionBy(*key)
    return rows.withColumns({"f": F.sum("n").over(w), "id": F.min("seq").over(w)}).filter(F.col("f") >= least).drop("seq", "n")


def _planes(columns: list[np.ndarray]) -> bytes:
    """Whole numbers, their bytes by place, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), 1)


def _numbers(packed: list[bytes], n: int) -> list[np.ndarray]:
    parts = [np.frombuffer(zstandard.decompress(x), np.uint8).reshape(n, 8, -1) for x in packed]
    return [np.concatenate([np.ascontiguousarray(p[k].T).view("<i8").ravel() for p in parts] or [np.zeros(0, np.int64)]) for k in range(n)]


def to_blocks(named: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """(block, known): for each block the values of whole-number columns of its rows, packed many in one row on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)] if len(block) else [0]
            values = [batch.column(1 + k).to_numpy() for k in range(len(columns))]
            known = [_planes([v[a:b] for v in values]) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]], pa.int64()), pa.array(known, pa.binary())], ["block", "known"])

    longs = [F.col(c).cast("long").alias(c) for c in columns]
    rows = named.select("block", *longs).sortWithinPartitions("block", *columns).mapInArrow(run, "block long, known binary")
    return rows.repartition(buckets, "block").groupBy("block").agg(F.collect_list("known").alias("known"))  # of one block


def renamed(texts: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """Blocks (block, numbers, ids) of the next level: numbers of named words (width 2) or pairs (width 3) at their places, 0 elsewhere, and the name of each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                numbers, told = unpack(batch.column(1)[k].as_py()), _numbers(batch.column(2)[k].as_py(), width)
                if width == 2:  # number, id
                    place = np.zeros(int(max(numbers.max(initial=0), told[0].max(initial=0))) + 1, np.int64)
                    place[told[0]] = np.arange(1, len(told[0]) + 1)
                    new = place[numbers]
                else:  # left id, right id, id
                    names = batch.column(3)[k].values.to_numpy()
                    new = _pairs_at(numbers, _keys(names, told[0], told[1]), len(names))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), pa.array([pack(new)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(told[-1])], pa.int32()), pa.array(told[-1], pa.int64()))], ["block", "numbers", "ids"]
                )

    own = ["ids"] if width == 3 else []
    joined = texts.select("block", "numbers", *own).join(known, "block").select("block", "numbers", "known", *own)  # a block without names has no pairs
    return joined.mapInArrow(run, "block long, numbers binary, ids array<long>")


def _keys(names: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs of names as one number each, by the places of the names in a block."""
    order = np.argsort(names)
    at = [order[np.searchsorted(names, x, sorter=order)] + 1 for x in (left, right)]
    return at[0] * (len(names) + 1) + at[1]


def _pairs_at(numbers: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """For each place the number (from 1) of the key that begins there, else 0."""
    here = numbers[:-1].astype(np.int64) * (size + 1) + numbers[1:]
    order = np.argsort(keys)
    at = np.minimum(np.searchsorted(keys, here, sorter=order), max(0, len(keys) - 1))
    found = order[at] if len(keys) else np.zeros(0, np.int64)
    return np.where(keys[found] == here, found + 1, 0) if len(keys) else np.zeros(len(here), np.int64)


def count_pairs(level: DataFrame) -> DataFrame:
    """(block, l, r, n): the pairs of names side by side in each block, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                numbers, names = unpack(batch.column(1)[k].as_py()).astype(np.int64), batch.column(2)[k].values.to_numpy()
                both = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
                codes, keys = pd.factorize(numbers[both] * (len(names) + 1) + numbers[both + 1])
                del numbers, both
                n = np.bincount(codes, minlength=len(keys))
                for lo in range(0, len(keys), ROWS):
                    part = keys[lo : lo + ROWS]
                    l, r = names[part // (len(names) + 1) - 1], names[part % (len(names) + 1) - 1]
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], len(part)), pa.array(l), pa.array(r), pa.array(n[lo : lo + ROWS])], ["block", "l", "r", "n"])

    return level.select("block", "numbers", "ids").mapInArrow(run, "block long, l long, r long, n long")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)), exact up to 10^15."""
    x, y, z = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (x * x), y * z)


def phrases(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50) -> DataFrame:
    """Frequent phrases of docs (text, lang): lang, phrase, words, a (occurrences), l and r (those of the two sides of the lowest-scoring cut), n (all words of the lang), score.

    Words are parted by spaces and tabs, pieces by .,;:!? and line ends; A-Z count as a-z. Phrases of 2 to `longest`
    words that occur `least` times or more count; one that lies in a longer such phrase with `cover` % of its
    occurrences or more is dropped. The score of a cut is floor(1,000,000 a a / (l r)); the lowest counts, on ties the
    first. A null lang counts as `und`, a null text as empty; an empty table gives an empty result, and other columns are
    ignored. All rows count, whether their ids repeat or not.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = buckets_for(docs)
    texts = bucketed(cut_blocks(rows), "phrase_words", buckets)
    sizes = texts.groupBy("lang").agg(F.sum("total").alias("n"))
    words = texts.select("block", "lang", F.posexplode("symbols").alias("at", "s")).select("block", "lang", (F.col("at") + 1).alias("number"), "s.word", "s.n")
    named = materialise(name(words, ["lang", "word"], least), "phrase-named")
    word = F.col("word").cast("string")
    known = named.select("id", "lang", word.alias("phrase"), word.alias("last"), F.array("f").alias("ahead"), F.array("f").alias("behind"), "f").distinct()
    level = bucketed(renamed(texts, to_blocks(named, ["number", "id"], buckets), 2), "phrase_level", buckets) if longest > 1 else None
    levels = []
    for k in range(2, longest + 1):
        pairs = count_pairs(level)
        if k < longest:
            named = materialise(name(pairs, ["l", "r"], least), "phrase-named")
            found = named.select("id", "l", "r", "f").distinct()
            level = bucketed(renamed(level, to_blocks(named, ["l", "r", "id"], buckets), 3), "phrase_level", buckets)
        else:
            found = pairs.groupBy("l", "r").agg(F.sum("n").alias("f")).filter(F.col("f") >= least).withColumn("id", F.lit(None).cast("long"))
        left = known.select(F.col("id").alias("l"), "lang", "phrase", "ahead")
        right = known.select(F.col("id").alias("r"), "last", "behind")
        known = found.join(left, "l").join(right, "r").select(
            "id", "l", "r", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.concat("ahead", F.array("f")).alias("ahead"), F.concat("behind", F.array("f")).alias("behind"), "f"
        )
        known = materialise(known, "phrase-level")
        levels.append(known)
    out = []
    for k, here in enumerate(levels, 2):
        cuts = [F.struct(_score(F.col("f"), F.col("ahead")[j - 1], F.col("behind")[k - j - 1]).alias("score"), F.lit(j).alias("k"), F.col("ahead")[j - 1].alias("l"), F.col("behind")[k - j - 1].alias("r")) for j in range(1, k)]
        if k < longest:
            longer = levels[k - 1].select(F.explode(F.array("l", "r")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("most"))
            here = here.join(longer, "id", "left").filter(F.coalesce(100 * F.col("most") < cover * F.col("f"), F.lit(True)))
        out.append(here.select("lang", "phrase", F.lit(k).alias("words"), F.col("f").alias("a"), F.array_min(F.array(*cuts)).alias("cut")))
    all_ = out[0]
    for more in out[1:]:
        all_ = all_.unionByName(more)
    return all_.join(sizes, "lang").select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def best(found: DataFrame, most: int) -> DataFrame:
    """The first `most` phrases of each lang by score, occurrences and spelling, with rank from 1.

    Phrases are ranked in as many places as they ask for, then the best of these in one place for each lang.
    """
    found = materialise(found, "phrase-found")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    places = max(1, -(-found.count() // RANKED))
    near = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(places))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= most)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    longs = ["rank", "a", "l", "r", "n", "score"]
    out = best(phrases(table(spark, sf_dir, "documents")), 2000).select(*[F.col(c).cast("long").alias(c) for c in longs], "lang", "phrase")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {
    "op12_collocations": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), p AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM d
), w AS (
  SELECT piece, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM p
), t AS (
  SELECT lang, x, lead(x) OVER q AS y, lead(x, 2) OVER q AS z FROM w WINDOW q AS (PARTITION BY piece ORDER BY i)
), g AS (
  SELECT lang, 1 AS k, [x] AS words FROM t
  UNION ALL SELECT lang, 2, [x, y] FROM t WHERE y IS NOT NULL
  UNION ALL SELECT lang, 3, [x, y, z] FROM t WHERE z IS NOT NULL
), f AS (
  SELECT lang, k, words, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10
), n AS (
  SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang
), cuts AS (
  SELECT c.lang, c.k, c.words, c.a, l.a AS l, r.a AS r, j.j,
         (1000000::hugeint * c.a * c.a) // (l.a::hugeint * r.a) AS score
  FROM f c JOIN (SELECT unnest([1, 2]) AS j) j ON j.j < c.k
  JOIN f l ON l.lang = c.lang AND l.words = c.words[1:j.j]
  JOIN f r ON r.lang = c.lang AND r.words = c.words[j.j + 1:]
  WHERE c.k >= 2
), s AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, j) = 1
), inside AS (
  SELECT lang, words[1:2] AS words, max(a) AS most FROM f WHERE k = 3 GROUP BY ALL
  UNION ALL SELECT lang, words[2:3], max(a) FROM f WHERE k = 3 GROUP BY ALL
), longest AS (
  SELECT lang, words, max(most) AS most FROM inside GROUP BY ALL
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, array_to_string(s.words, ' ')) AS rank,
       array_to_string(s.words, ' ') AS phrase, a, l, r, n::bigint AS n, score::bigint AS score
FROM s JOIN n USING (lang) LEFT JOIN longest ON longest.lang = s.lang AND longest.words = s.words
WHERE most IS NULL OR 100 * most < 50 * a
QUALIFY rank <= 2000
"""
}
