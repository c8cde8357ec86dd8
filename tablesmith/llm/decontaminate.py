"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap of question and answer.

The test items are the index, and every passage of every document is a query: passages are windows of twice the
longest item's length, each beginning in the middle of the one before, so an item lies whole in one of them. A
passage retrieves all items that score at least a share of what the item scores against itself. What is retrieved
counts as found if the document holds enough of the item's question and of its answer, by word shingles.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.common import WORD, materialise, ship, table
from tablesmith.llm.wordscan import HashIndex, mix, scan

K1, B = 1.2, 0.75
#: A passage retrieves an item from this share of the item's score against itself.
SHARE = 0.5
#: Words of a shingle; the shares of a whole item's, and of its question's and its answer's, that a document must hold.
SHINGLE, OVERLAP, PART_OVERLAP = 5, 0.8, 0.5
#: Postings of a block; terms in at most so many items count one by one in the first bound.
BLOCK, RARE = 8, 16
#: Items, and characters of items, of one index: what every task holds at a time.
ITEMS, CHARS = 50_000, 1 << 25


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a word sequence."""
    if not 0 < k <= len(words):
        return np.zeros(0, np.uint64)
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h + words[i : i + len(h)]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.unique(mix(h))


class Index:
    """Postings of items by term, in blocks with their largest impacts; items are numbered by their place in the list.

    Postings of all terms lie one after the other, those of term t from start[t] to start[t + 1], its blocks from
    block[t] to block[t + 1]. Statistics are those of the items at hand, unless others are given: how many items there
    are, their mean length, and for each term (by hash) how many have it.
    """

    def __init__(self, items: list[tuple[int | None, str]], total: int | None = None, mean: float | None = None, frequency: dict[int, int] | None = None):
        self.ids, words, self.parts = [], [], []
        for w in scan(pa.array([t for _, t in items], pa.string())) if items else ():
            for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                if b > a:
                    own, text = w.hash[a:b], items[w.lo + i][1]
                    asked = len(text[: text.rindex("?") + 1].encode().split()) if "?" in text else 0
                    cut = asked if 0 < asked < b - a else (b - a + 1) // 2
                    self.ids.append(items[w.lo + i][0])
                    words.append(own)
                    # a part that is shorter than a shingle is one by itself
                    self.parts.append([(k := min(SHINGLE, len(part)), _shingles(part, k)) for part in (own, own[:cut], own[cut:])])
        n = max(1, len(words))
        self.sizes = np.array([len(w) for w in words], float)
        self.window = max(32, 2 * max(map(len, words), default=0))
        terms = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.lookup = HashIndex(terms)
        place = self.lookup.find(np.concatenate(words)).astype(np.int64) if words else np.zeros(0, np.int64)
        pair, tf = np.unique(place * n + np.repeat(np.arange(len(words)), self.sizes.astype(np.int64)), return_counts=True)
        term, item = pair // n, pair % n
        held = np.bincount(term, minlength=len(terms))
        start = np.concatenate(([0], np.cumsum(held)))
        known = held if frequency is None else np.array([frequency[t] for t in terms.tolist()], np.int64)
        idf = np.log(1 + ((total or n) - known + 0.5) / (known + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.sizes[item] / (mean or (self.sizes.mean() if words else 1.0))))
        of_block = np.flatnonzero((np.arange(len(pair)) - start[term]) % BLOCK == 0)
        self.start, self.block = array("q", start.tolist()), array("q", np.concatenate(([0], np.cumsum(-(-held // BLOCK)))).tolist())
        self.item, self.impact = array("q", item.tolist()), array("d", impact.tolist())
        self.top = array("d", np.maximum.reduceat(impact, of_block).tolist() if len(pair) else [])
        self.last = array("q", item[np.append(of_block[1:], len(pair)) - 1].tolist() if len(pair) else [])
        self.most = array("d", np.maximum.reduceat(impact, start[:-1]).tolist() if len(pair) else [])
        per_item = lambda on: np.bincount(item[on], impact[on], len(words))
        rare = held[term] <= RARE
        self.need = per_item(slice(None)) * SHARE
        #: What the rare terms of a passage must give an item at least, if all its common ones are there.
        self.gap = self.need - per_item(~rare)
        self.least = float(self.need.min()) if words else 0.0
        self.rare_from = np.concatenate(([0], np.cumsum(np.where(held <= RARE, held, 0))))
        self.rare_item, self.rare_impact = item[rare], impact[rare]

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items that reach their need for a set of terms, with their scores: document-at-a-time, by block-max WAND.

        Terms are walked in the order of their next item. The pivot is where the terms' largest impacts first reach
        the least need of any item; it is scored only if the blocks' largest impacts reach that too, else the walk
        goes on behind the first of those blocks to end.
        """
        out, items, impact, start, block, last, end = [], self.item, self.impact, self.start, self.block, self.last, len(self.sizes)
        at = {t: start[t] for t in terms}
        front = sorted((items[start[t]], t) for t in terms)
        least = self.least - 1e-9

        def block_of(t: int, goal: int) -> int:
            """The block of a term, from the one where it stands, that may hold the goal; block[t + 1] if there is none."""
            b = block[t] + (at[t] - start[t]) // BLOCK
            while b < block[t + 1] and last[b] < goal:
                b += 1
            return b

        def seek(t: int, goal: int) -> int:
            k = max(at[t], start[t] + (block_of(t, goal) - block[t]) * BLOCK)
            while k < start[t + 1] and items[k] < goal:
                k += 1
            at[t] = min(k, start[t + 1])
            return items[k] if k < start[t + 1] else end

        while True:
            total, pivot = 0.0, -1
            for k, (item, t) in enumerate(front):
                if item >= end:
                    break
                total += self.most[t]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                return out
            goal = front[pivot][0]
            while pivot + 1 < len(front) and front[pivot + 1][0] == goal:
                pivot += 1
            open_ = [b for b, t in ((block_of(t, goal), t) for _, t in front[: pivot + 1]) if b < block[t + 1]]
            if sum(self.top[b] for b in open_) >= least:
                score = 0.0
                for k in range(pivot + 1):
                    t = front[k][1]
                    here = seek(t, goal)
                    if here == goal:
                        score += impact[at[t]]
                        here = seek(t, goal + 1)
                    front[k] = (here, t)
                if score >= self.need[goal] - 1e-9:
                    out.append((goal, score))
            else:
                beyond = min([last[b] for b in open_], default=goal) + 1
                if pivot + 1 < len(front):
                    beyond = min(beyond, front[pivot + 1][0])
                beyond = max(beyond, goal + 1)
                for k in range(pivot + 1):
                    front[k] = (seek(front[k][1], beyond), front[k][1])
            front.sort()

    def search(self, words: np.ndarray) -> dict[int, float]:
        """Best score of each item that some passage of a document (hashes of its words) retrieves."""
        terms = self.lookup.find(words)
        spot = np.flatnonzero(terms >= 0)
        if not len(spot):
            return {}
        terms = terms[spot].astype(np.int64)
        half = self.window // 2
        block = spot // half
        size = len(self.most)
        # every word is in the passage that begins with its half window and in the one before
        key = np.unique(np.concatenate((block * size + terms, np.maximum(block - 1, 0) * size + terms)))
        passage, term = key // size, key % size
        a, b = self.rare_from[term], self.rare_from[term + 1]
        n = b - a
        spread = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        pair = np.repeat(passage, n) * len(self.ids) + self.rare_item[spread]
        which, at = np.unique(pair, return_inverse=True)
        sums = np.bincount(at, self.rare_impact[spread], len(which))
        open_ = which[sums >= self.gap[which % len(self.ids)] - 1e-9] // len(self.ids)
        if (self.gap <= 0).any():
            open_ = passage
        best: dict[int, float] = {}
        for p in np.unique(open_).tolist():
            lo, hi = np.searchsorted(passage, [p, p + 1])
            for item, score in self.wand(term[lo:hi].tolist()):
                best[item] = max(best.get(item, 0.0), score)
        return best

    def hits(self, words: np.ndarray) -> list[dict]:
        """Items found in a document, verified: item_id, score, and shares of shingles (overlap of the whole, question, answer)."""
        found = self.search(words) if len(self.ids) else {}
        if not found:
            return []
        held: dict[int, np.ndarray] = {}
        out = []
        for i in sorted(found):
            shares = []
            for k, part in self.parts[i]:
                if k not in held:
                    held[k] = _shingles(words, k)
                shares.append(float(np.isin(part, held[k], assume_unique=True).mean()) if len(part) else 1.0)
            if shares[0] >= OVERLAP and min(shares[1:]) >= PART_OVERLAP:
                out.append({"item_id": self.ids[i], "score": found[i], "overlap": shares[0], "question": shares[1], "answer": shares[2]})
        return out


HITS = "array<struct<item_id long, score double, overlap double, question double, answer double>>"


def _searcher(shared):
    @F.arrow_udf(HITS)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))
        index = shared.value
        for texts in batches:
            rows = []
            for w in scan(texts):
                rows += [index.hits(w.hash[a:b]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            yield pa.array(rows, kind)

    return search


def _terms(items: DataFrame) -> DataFrame:
    """term (hash), once for each item that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in scan(batch.column(0)):
                own = [np.unique(w.hash[a:b]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["term"])

    return items.select("text").mapInArrow(run, "term long")


def find_items(docs: DataFrame, items: DataFrame, into: str = "benchmark_hits") -> DataFrame:
    """docs with an array column `into` (in place of one of that name) of the test items (item_id, text) that each text holds, in order of ids.

    An item's question is what ends with its last question mark, its answer the rest; without a mark, or with nothing
    on one side of it, they are its halves. Items without words are left out; a hit of an
    item with a null item_id has a null one. Null and empty texts hold nothing.
    Whole texts are searched, whatever their length. Repeated rows get equal hits, items with equal texts are all
    found; an empty table or an empty benchmark gives no hits; other columns pass through.

    An index goes to every task. It covers ITEMS items and about CHARS characters at most. A larger benchmark is cut
    into blocks: the driver and the tasks hold one at a time, each text is searched for one after the other, and
    scores come from the statistics of all items, so nothing but the time depends on the blocks.
    """
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    items = items.filter(F.coalesce(F.col("text").rlike(WORD), F.lit(False))).select("item_id", "text")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-size["n"] // ITEMS), -(-(size["chars"] or 0) // CHARS))
    read = lambda df: [(r["item_id"], r["text"]) for r in df.orderBy("item_id", "text").collect()]
    if blocks == 1:
        return docs.withColumn(into, _searcher(sc.broadcast(Index(read(items))))(F.col("text")))
    frequency = materialise(_terms(items).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "items-terms")
    mean = items.agg(F.avg(F.regexp_count("text", F.lit(WORD)))).first()[0]
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    found = []
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        own = {r["term"] & (1 << 64) - 1: r["n"] for r in frequency.join(_terms(mine).distinct(), "term").collect()}
        shared = sc.broadcast(Index(read(mine), size["n"], mean, own))
        hits = docs.select(key.alias("key"), _searcher(shared)(F.col("text")).alias("hits")).filter("size(hits) > 0")
        found.append(materialise(hits.groupBy("key").agg(F.first("hits").alias("hits")), "items-hits"))  # equal texts have equal hits
        shared.unpersist()
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    hits = hits.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))  # of one text
    rows = docs.drop(into).select(F.struct("*").alias("row"), key.alias("key")).join(hits, "key", "left")
    return rows.select("row.*", F.coalesce("hits", F.array().cast(HITS)).alias(into))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item found in it; documents without any have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_items(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.explode("benchmark_hits").alias("hit")).select("doc_id", "hit.*")


QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLES = {}
