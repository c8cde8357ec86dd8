"""LM scoring with a hidden Markov language model.

Latent states emit token classes: frequent words have classes of their own, the others share classes by
their last two bytes and are told apart within them by their counts, and the end of a text is a class too. Baum-Welch
starts from a bounded sample and then runs over all training tokens; its expected counts are added up across
partitions. The scaled forward recursion gives the exact probability of a whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from tablesmith.llm.common import id_crc, materialise, ship, table
from tablesmith.llm.wordscan import FOLD, HashIndex, scan

STATES = 8
#: Words with classes of their own at most, the least count of such a word, classes that the other words share, and words whose
#: counts are broadcast. Own classes grow with the training words up to what 16 bits hold.
HEAD, OWN, SHARED, KNOWN = 64000, 12, 1024, 1 << 18
CLASSES = HEAD + SHARED + 1
END = CLASSES - 1
#: Baum-Welch starts from a sample of about so many texts, of longer ones a piece of so many tokens; its rounds there and over everything.
START_TEXTS, START_TOKENS, START_ROUNDS, ROUNDS = 1500, 2000, 25, 6
#: Rounds over everything end once one raises the training texts' log10 probability by less than this for each token.
GAIN = 0.002
#: Tokens that are worked on at a time.
TOKENS = 1 << 19


def _shared_class(w) -> np.ndarray:
    last = FOLD[w.raw[w.stop - 1]].astype(np.int64)
    before = FOLD[w.raw[np.maximum(w.stop - 2, w.start)]].astype(np.int64)
    return HEAD + (before * 31 + last) % SHARED


def count_words(texts: DataFrame) -> DataFrame:
    """hash, class (the one shared by such words), n for all words of texts (text); tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def added() -> pa.RecordBatch:
            h, first, n = np.unique(np.concatenate([x for x, _ in held]), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate([x for _, x in held])[first].astype(np.int32)), pa.array(n)], names=["hash", "class", "n"])

        for batch in batches:
            for w in scan(batch.column(0)):
                held.append((w.hash, _shared_class(w)))
                size += len(w.hash)
                if size > 4 * TOKENS:
                    yield added()
                    held, size = [], 0
        if size:
            yield added()

    rows = texts.select("text").mapInArrow(run, "hash long, class int, n long")
    return rows.groupBy("hash").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


class Vocabulary:
    """What the encoder needs to know: totals, the counts of frequent words, and sums for the shared classes."""

    def __init__(self, counts: DataFrame, texts: int):
        """counts from count_words; texts: training texts, each with one end."""
        total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
        self.tokens = (total[0] or 0) + texts
        self.types = total[1] + (texts > 0)
        self.texts = texts
        # words of equal counts are taken or left together, so no task sends more than belongs to the result
        steps = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toPandas().sort_values("n", ascending=False)
        least = steps["n"][steps["words"].cumsum() <= KNOWN].min()
        top = counts.filter(F.col("n") >= (int(least) if least == least else 1 << 62)).toPandas().sort_values(["n", "hash"], ascending=[False, True])
        order = np.argsort(top["hash"].to_numpy(np.int64).view(np.uint64))
        self.hash = top["hash"].to_numpy(np.int64).view(np.uint64)[order]
        self.n = top["n"].to_numpy(np.int64)[order]
        place = np.arange(len(top))[order]
        own = min(HEAD, int((top["n"] >= OWN).sum()))
        self.cls = np.where(place < own, place, top["class"].to_numpy(np.int64)[order]).astype(np.uint16)
        head = top.head(own)
        by = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
        n, v = np.zeros(SHARED), np.zeros(SHARED)
        np.add.at(n, by["class"].to_numpy(int) - HEAD, by["n"].to_numpy(float))
        np.add.at(v, by["class"].to_numpy(int) - HEAD, by["v"].to_numpy(float))
        np.subtract.at(n, head["class"].to_numpy(int) - HEAD, head["n"].to_numpy(float))
        np.subtract.at(v, head["class"].to_numpy(int) - HEAD, 1.0)
        #: Denominator of a word's probability within its shared class: add-one over its words and one unseen.
        self.within = n + v + 1
        #: Add-one class probabilities, the prior of every state's emissions.
        mass = np.zeros(CLASSES)  # classes that no word has never occur
        mass[: len(head)] = head["n"].to_numpy(float) + 1
        mass[HEAD : HEAD + SHARED] = n + 1
        mass[END] = texts + 1
        self.prior = mass / mass.sum()


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs' columns but text as a struct doc, with row (its number), ids (classes), n_tokens, n_known, base, inner and rare words.

    base: log10 of the unigram probability of the tokens whose counts are known here. inner: log10 of the words'
    probabilities within their shared classes. Words that aren't among the frequent ones come with how often they
    occur; base and inner lack the logarithms of their counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.hash, vocabulary.n, vocabulary.cls, vocabulary.within))
    total = np.log10(vocabulary.tokens + vocabulary.types + 1.0)
    end_base = np.log10(vocabulary.texts + 1.0) - total
    end_known = int(vocabulary.texts > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, cls, within = shared.value
        index = HashIndex(known)
        seen, log_within = np.log10(n + 1.0), np.log10(within)
        for batch in batches:
            for w in scan(batch.column(0)):
                texts = w.hi - w.lo
                at = index.find(w.hash)
                hit = at >= 0
                where = np.maximum(at, 0) if len(known) else np.zeros(len(at), np.int64)
                ids = _shared_class(w).astype(np.uint16)
                count = np.zeros(len(at))
                if len(known):
                    ids[hit] = cls[where[hit]]
                    count[hit] = seen[where[hit]]
                inner = np.where(ids < HEAD, 0.0, count - log_within[np.maximum(ids, HEAD).astype(np.int64) - HEAD])
                text_of = np.repeat(np.arange(texts), np.diff(w.first))
                per = lambda x: np.bincount(text_of, x, texts)  # noqa: E731, B023
                size = np.diff(w.first)
                raw = ids.astype("<u2").tobytes()
                packed = [raw[2 * a : 2 * b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
                # the rare words of each text, once each with their number
                lost = np.flatnonzero(~hit)
                order = lost[np.lexsort((w.hash[lost], text_of[lost]))]
                h, t = w.hash[order], text_of[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1]))) if len(h) else np.zeros(0, bool)
                begin = np.flatnonzero(new)
                times = np.diff(np.concatenate((begin, [len(h)])))
                cuts = pa.array(np.searchsorted(t[begin], np.arange(texts + 1)).astype(np.int32))
                columns = [
                    pa.array(packed, pa.binary()), pa.array(size + 1), pa.array(per(hit).astype(np.int64) + end_known),
                    pa.array(per(count - total) + end_base), pa.array(per(inner)),
                    pa.ListArray.from_arrays(cuts, pa.array(h[begin].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays([*(c.slice(w.lo, texts) for c in batch.columns[1:]), *columns], names=made.names)

    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    made = StructType([rows.schema["doc"], rows.schema["row"]]).add("ids", "binary").add("n_tokens", "long").add("n_known", "long").add("base", "double")
    made = made.add("inner", "double").add("rare", ArrayType(LongType())).add("times", ArrayType(IntegerType()))
    return rows.mapInArrow(run, made)


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        """emit has a row per class and a column per state."""
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def fresh(cls, prior: np.ndarray, states: int, seed: int) -> Model:
        draw = np.random.default_rng(seed)
        emit = prior[:, None] * draw.uniform(0.5, 1.5, (len(prior), states))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def estimate(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
        """From expected counts; the prior adds a hundred tokens' worth to each state's emissions."""
        start, move, emit = start + 1.0, move + 1.0, emit + 100.0 * prior[:, None]
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _packed(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts by falling length: their places, classes step by step, active texts per step, and offsets of steps."""
    order = np.argsort([-len(x) for x in texts], kind="stable")
    lo = 0
    while lo < len(order):
        hi, total = lo, 0
        while hi < len(order) and (hi == lo or total + len(texts[order[hi]]) <= TOKENS):
            total += len(texts[order[hi]])
            hi += 1
        group = order[lo:hi]
        sizes = np.array([len(texts[i]) for i in group])
        active = len(group) - np.searchsorted(sizes[::-1], np.arange(1, sizes[0] + 1))
        step = np.concatenate(([0], np.cumsum(active)))
        flat = np.empty(total, np.int64)
        for k, i in enumerate(group):
            flat[step[: sizes[k]] + k] = texts[i]
        yield group, flat, active, step
        lo = hi


def log10_likelihood(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Exact log10 probability of each sequence of classes (none empty), by the scaled forward recursion."""
    out = np.zeros(len(texts))
    for group, flat, active, step in _packed(texts):
        sums = np.zeros(len(group))
        alpha = np.broadcast_to(model.start, (len(group), len(model.start)))
        for t in range(len(active)):
            n = active[t]
            here = alpha[:n] if t == 0 else alpha[:n] @ model.move
            alpha = here * model.emit[flat[step[t] : step[t] + n]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            sums[:n] += np.log10(scale)
        out[group] = sums
    return out


def expected_counts(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch: expected starts, moves and emissions, and log10 of the texts' probability, by scaled forward and backward recursions."""
    s, logs = len(model.start), 0.0
    start, move, emit = np.zeros(s), np.zeros((s, s)), np.zeros((len(model.emit), s))
    for group, flat, active, step in _packed(texts):
        if len(active) > TOKENS:  # a text by itself
            first, moved, emitted, log = _long_counts(model, flat)
            start, move, emit, logs = start + first, move + moved, emit + emitted, logs + log
            continue
        e = model.emit[flat]
        alpha = np.empty_like(e)
        scale = np.empty(len(flat))
        for t in range(len(active)):
            a, b = step[t], step[t + 1]
            here = model.start if t == 0 else alpha[step[t - 1] : step[t - 1] + active[t]] @ model.move
            x = here * e[a:b]
            scale[a:b] = x.sum(1)
            alpha[a:b] = x / scale[a:b, None]
        logs += float(np.log10(scale).sum())
        beta = np.ones((len(group), s))
        gamma = alpha.copy()
        for t in range(len(active) - 1, 0, -1):
            a, b, n = step[t], step[t + 1], active[t]
            ahead = e[a:b] * beta[:n] / scale[a:b, None]
            before = step[t - 1]
            move += alpha[before : before + n].T @ ahead
            beta[:n] = ahead @ model.move.T
            gamma[before : before + n] *= beta[:n]
        start += gamma[: active[0]].sum(0)
        for k in range(s):
            emit[:, k] += np.bincount(flat, gamma[:, k], len(emit))
    return start, move * model.move, emit, logs


def _long_counts(model: Model, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """expected_counts of one long text, TOKENS at a time: only the states' shares where a block begins are kept on the way forward."""
    s = len(model.start)
    move, emit, logs, heads, alpha = np.zeros((s, s)), np.zeros((len(model.emit), s)), 0.0, [], None
    for lo in range(0, len(text), TOKENS):
        heads.append(alpha)
        for k in text[lo : lo + TOKENS]:
            alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[k]
            alpha = alpha / alpha.sum()
    beta, start = np.ones(s), np.zeros(s)
    for i in range(len(heads) - 1, -1, -1):
        part, head = text[i * TOKENS : (i + 1) * TOKENS], heads[i]
        e, scale = model.emit[part], np.empty(len(part))
        alphas = np.empty_like(e)
        for t in range(len(part)):
            before = alphas[t - 1] if t else head
            x = (model.start if before is None else before @ model.move) * e[t]
            scale[t] = x.sum()
            alphas[t] = x / scale[t]
        logs += float(np.log10(scale).sum())
        gamma = alphas.copy()
        for t in range(len(part) - 1, -1, -1):
            gamma[t] *= beta
            before = alphas[t - 1] if t else head
            if before is None:
                start = gamma[t]
                break
            ahead = e[t] * beta / scale[t]
            move += np.outer(before, ahead)
            beta = model.move @ ahead
        for k in range(s):
            emit[:, k] += np.bincount(part, gamma[:, k], len(emit))
    return start, move, emit, logs


def _sequences(ids: pa.Array, ends: Iterable[bool] = repeat(True)) -> list[np.ndarray]:
    """Classes of each text or piece, followed by the end of the text where `ends` says that it comes there."""
    end = np.array([END], "<u2").tobytes()
    return [np.frombuffer(x.as_py() + end if last else x.as_py(), "<u2") for x, last in zip(ids, ends, strict=False)]


def _together(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches joined up to some million tokens, so that long texts find others to keep them company."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes // 2
        if size > 16 * TOKENS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def train(encoded: DataFrame, vocabulary: Vocabulary, states: int = STATES, rounds: int = ROUNDS, seed: int = 11) -> Model:
    """Baum-Welch over all rows of encoded (row, ids): a start from a bounded sample, then up to `rounds` over everything.

    They end early once the gain of the last one is under GAIN for each token, whatever the number or length of texts.
    """
    share = START_TEXTS / max(1, vocabulary.texts)
    picked = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share * (1 << 30)
    pieces = F.greatest(F.lit(1), F.ceil(F.length("ids") / (2 * START_TOKENS)))
    piece = F.pmod(F.xxhash64("row", F.lit(1)), pieces)
    sample = encoded.filter(picked).select(F.substring("ids", (piece * 2 * START_TOKENS + 1).cast("int"), F.lit(2 * START_TOKENS)).alias("ids"), (piece == pieces - 1).alias("ends")).toArrow()
    texts = _sequences(sample.column(0).combine_chunks(), sample.column(1).to_pylist()) if len(sample) else []
    model = Model.fresh(vocabulary.prior, states, seed)
    for _ in range(START_ROUNDS if texts else 0):
        model = Model.estimate(*expected_counts(model, texts)[:3], vocabulary.prior)
    sc = encoded.sparkSession.sparkContext
    # rows CLASSES.. hold starts, moves and the logarithm of the probability
    rows, before = CLASSES + 2 + states, -np.inf
    fields = "k int, " + ", ".join(f"s{i} double" for i in range(states))
    for _ in range(rounds if vocabulary.texts else 0):
        now = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((rows, states))
            for batch in _together(batches, 0):
                start, move, emit, logs = expected_counts(now.value, _sequences(batch.column(0)))
                total += np.vstack((emit, start[None], move, np.full((1, states), logs)))
            k = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), *(pa.array(total[k, i]) for i in range(states))], names=["k", *(f"s{i}" for i in range(states))])

        sums = encoded.select("ids").mapInArrow(run, fields).groupBy("k").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(states)]).toPandas()
        total = np.zeros((rows, states))
        total[sums["k"].to_numpy()] = sums[[f"s{i}" for i in range(states)]].to_numpy()
        model = Model.estimate(total[CLASSES], total[CLASSES + 1 : -1], total[:CLASSES], vocabulary.prior)
        now.unpersist()
        if total[-1, 0] - before < GAIN * vocabulary.tokens:
            break
        before = total[-1, 0]
    return model


def score(docs: DataFrame, training: Column, states: int = STATES, rounds: int = ROUNDS, into: str = "lm") -> DataFrame:
    """docs' columns but text, with a struct column `into` (in place of one of that name): n_tokens, n_known, train_tokens, base_score, score.

    The rows where `training` holds teach the model. Null texts count as empty; an empty text is its end alone.
    Texts of any length are scored whole. With no training rows every word is unseen and the states' emissions are
    the uniform prior. Repeated rows are texts like any other, null ids too, and an empty table gives no rows.

    Words are known by 64-bit hashes. Counts of the most frequent words go to every task; those of all others are
    joined with the rare words of the texts by a shuffle.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("text", into)]
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own"), F.coalesce(training, F.lit(False)).alias("teaches"))
    taught = rows.filter("teaches")
    counts = materialise(count_words(taught), "hmm-counts")
    vocabulary = Vocabulary(counts, taught.select("teaches").count())
    encoded = materialise(encode(rows, vocabulary), "hmm-encoded")
    model = train(encoded.filter("doc.teaches").select("row", "ids"), vocabulary, states, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _together(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(log10_likelihood(shared.value, _sequences(batch.column(1))))], names=["row", "hidden"])

    hidden = encoded.select("row", "ids").mapInArrow(run, "row long, hidden double")
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("hash"), F.col("x.times").alias("times"))
    rare = rare.join(counts.select("hash", "n"), "hash").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    out = encoded.select("doc.own", "row", "n_tokens", "n_known", "base", "inner").join(hidden, "row").join(rare, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    scored = F.struct(
        "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(vocabulary.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("hidden") + F.col("inner") + logs).alias("score"),
    )
    return out.select(*[F.col("own").getField(c).alias(c) for c in kept], scored.alias(into))


def op2_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(id_crc(F.col("doc_id")), F.lit(7)) == 2
    out = score(docs.withColumn("held_out", held_out), ~F.col("held_out"))
    return out.select("doc_id", "held_out", "lm.*")


QUERIES = {"op2_hmm_score": op2_hmm_score}
ORACLES = {}
