"""Secret scans: patterns, and a linear-chain conditional random field that adds what they miss.

Tokens are tagged as beginning a secret, inside one or outside. The field's features are a token's shape (length,
digits, case, marks, changes between digits and letters), the two words on either side (hashed), signs and quotes
next to it, the lengths of its neighbours, and the file's density of digits and of signs; tags are decoded by
Viterbi. It learns from what the patterns find, partly with the words next to it hidden, from made-up secrets of
kinds that no pattern knows, and from made-up text that only looks like one, both planted in the corpus' own prose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.common import ship, table

#: The patterns, and how long a match has to be (assign: its value).
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")

#: About so many texts are looked at for training, and windows of so many characters of so many of each kind are used.
SAMPLE_TEXTS, TRAIN_TEXTS, TRAIN_CHARS = 10_000, 300, 600
WINDOW, ROUNDS, WORD_BITS = 40, 100, 12
CHUNK = 1 << 20

#: What training plants: words before secrets, what stands between, and words that follow telling words without being secrets.
TELLING = "password passwd pwd pass secret client_secret token api_key apikey access_key key private_key credential credentials auth authorization bearer login".split()
BETWEEN = (" = ", "=", ": ", ":", ' = "', '="', ': "', '":"', " ", " is ")
HARMLESS = "required optional policy reset here below none unknown example changed expired the your a for of and must is field garden meeting management".split()

_SPACE, _QUOTE, _SIGN, _OTHER, _LOWER, _UPPER, _DIGIT, _MARK, _BEYOND = range(9)
_CLASS = np.full(129, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[ord(c) for c in "\"'`"]] = _QUOTE
_CLASS[[ord(c) for c in ":="]] = _SIGN
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[ord(c) for c in "+/_.-"]] = _MARK
_CLASS[128] = _BEYOND
SHAPES, CONTEXTS, SIDES, FILES, NEAR = 6 * 4 * 4 * 3 * 2 * 3, 8, 49, 16, (-1, -2, 1, 2)
#: Where the features of each kind begin; each token has one of each. A word's feature 0 stands for a hidden or missing one.
_FROM = np.cumsum([0, SHAPES, CONTEXTS, SIDES, FILES, *[1 << WORD_BITS] * len(NEAR)])
FEATURES, COLUMNS = int(_FROM[-1]), len(_FROM) - 1
_POWER = np.cumprod(np.full(64, 0x9E3779B1, np.uint32))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns, each kind leftmost and non-overlapping."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]


@dataclass
class Tokens:
    """Tokens of some texts joined by line feeds: places, the features of each (as columns), first token of each text."""

    start: np.ndarray
    stop: np.ndarray
    feature: np.ndarray
    first: np.ndarray


def tokenise(joined: str, begins: np.ndarray) -> Tokens:
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    c = _CLASS[np.minimum(chars, 128)]
    inside = c >= _LOWER
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(start)
    if not n:
        return Tokens(start, stop, np.zeros((0, COLUMNS), np.int32), np.zeros(len(begins), np.int64))
    size = stop - start
    own, at = c[inside], np.cumsum(size) - size  # the tokens' characters side by side, and where each begins
    total = lambda x: np.add.reduceat(x, at, dtype=np.int32)
    digits, upper, lower, odd, marks = (total(own == k) for k in (_DIGIT, _UPPER, _LOWER, _BEYOND, _MARK))
    digit = own == _DIGIT
    change = np.zeros(len(own), bool)
    change[1:] = digit[1:] != digit[:-1]
    change[at] = False
    changes = total(change)
    length = np.digitize(size, [4, 8, 16, 24, 32])
    share = np.where(digits == 0, 0, 1 + np.digitize(digits / size, [0.2, 0.5]))
    case = np.where(upper + lower == 0, 0, np.where(upper == 0, 1, np.where((lower == 0) | ((upper == 1) & (own[at] == _UPPER)), 2, 3)))
    switch = np.where(changes == 0, 0, 1 + (changes / size > 0.2))
    shape = ((((length * 4 + share) * 4 + case) * 3 + switch) * 2 + (odd > 0)) * 3 + np.minimum(marks, 2)
    first = np.searchsorted(start, begins)
    texts = np.repeat(np.arange(len(begins) - 1), np.diff(first))
    gap = np.concatenate(([0], stop[:-1]))
    gap = np.maximum(gap, begins[texts])  # nothing tells across texts
    between = lambda k: (s := np.concatenate(([0], np.cumsum(c == k, dtype=np.int32))))[start] - s[gap] > 0
    after = np.zeros(n, bool)
    after[stop < len(c)] = c[stop[stop < len(c)]] == _QUOTE
    context = between(_SIGN) * 4 + between(_QUOTE) * 2 + after
    letters = chars[inside]
    letters = letters + 32 * ((letters >= 65) & (letters <= 90)).astype(np.uint32)
    place = np.minimum(np.arange(len(own)) - np.repeat(at, size), 63)
    word = np.add.reduceat(letters * _POWER[place], at, dtype=np.uint32) * np.uint32(0x85EBCA6B)
    word = np.maximum(1, word >> np.uint32(32 - WORD_BITS)).astype(np.int32)

    def near(x: np.ndarray, step: int, none: int) -> np.ndarray:
        """x of the token so many steps on, in the same text."""
        out = np.full(n, none, np.int32)
        if n > abs(step):
            here, there = (slice(None, -step), slice(step, None)) if step > 0 else (slice(-step, None), slice(None, step))
            out[here] = np.where(texts[here] == texts[there], x[there], none)
        return out

    sides = near(length, -1, 6) * 7 + near(length, 1, 6)
    signs = np.concatenate(([0], np.cumsum((c == _SIGN) | (c == _OTHER), dtype=np.int32)))
    many = np.maximum(1, begins[1:] - begins[:-1])
    all_digits = np.concatenate(([0], np.cumsum(digits)))
    dense = np.digitize((all_digits[first[1:]] - all_digits[first[:-1]]) / many, [0.01, 0.03, 0.1]) * 4 + np.digitize((signs[begins[1:]] - signs[begins[:-1]]) / many, [0.01, 0.03, 0.1])
    columns = [shape, context, sides, dense[texts], *[near(word, step, 0) for step in NEAR]]
    return Tokens(start, stop, np.stack([x + a for x, a in zip(columns, _FROM, strict=False)], 1).astype(np.int32), first)


def join_texts(texts: list[str]) -> tuple[str, np.ndarray]:
    """Texts joined by line feeds, which no pattern and no token crosses, and where each begins (one more at the end)."""
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return "\n".join(texts) + "\n", begins.astype(np.int64)


@dataclass
class Field:
    """Weights of features (a column per tag: begin, inside, outside), of moves between tags, and of first tags."""

    weight: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def viterbi(self, score: np.ndarray) -> np.ndarray:
        """Best tags for token scores (tokens x 3)."""
        back = np.zeros(score.shape, np.int8)
        best = self.start + score[0]
        for t in range(1, len(score)):
            way = best[:, None] + self.move
            back[t] = way.argmax(0)
            best = way.max(0) + score[t]
        tags = np.empty(len(score), np.int8)
        tags[-1] = best.argmax()
        for t in range(len(score) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags

    def hot(self, feature: np.ndarray) -> np.ndarray:
        """Tokens that could pay for a secret. A run of begin and inside tags without any scores less than the same
        tokens outside, whatever the moves, so a text that has none is outside from end to end.

        What a token may gain is at most the sum of what each of its features may gain.
        """
        gain = max(0.0, float((self.move - self.move[2, 2]).max()), float((self.start - self.start[2]).max()))
        pays = (self.weight[:, :2].max(1) - self.weight[:, 2]).astype(np.float32)
        total = pays[feature[:, 0]]
        for k in range(1, COLUMNS):
            total += pays[feature[:, k]]
        return total + np.float32(2 * gain + 1e-3) >= 0


def train(windows: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, rate: float = 0.3, decay: float = 5e-5) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam, on windows (features, tags)."""
    field = Field(np.zeros((FEATURES, 3)), np.zeros((3, 3)), np.zeros(3))
    field.weight[:, 2] = 1.0  # outside until shown otherwise
    if not windows:
        return field
    longest = max(len(t) for _, t in windows)
    n = len(windows)
    feature, tag, live = np.zeros((n, longest, COLUMNS), np.int64), np.full((n, longest), 2), np.zeros((n, longest), bool)
    for i, (f, t) in enumerate(windows):
        feature[i, : len(t)], tag[i, : len(t)], live[i, : len(t)] = f, t, True
    one = np.eye(3)
    seen_w, seen_m = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    for k in range(COLUMNS):
        np.add.at(seen_w, feature[..., k][live], one[tag[live]])
    pair = live[:, 1:]
    np.add.at(seen_m, (tag[:, :-1][pair], tag[:, 1:][pair]), 1)
    seen_s = one[tag[:, 0]].sum(0)
    moments = [np.zeros_like(x) for x in (field.weight, field.move, field.start) for _ in range(2)]
    for turn in range(1, rounds + 1):
        e = np.exp(field.weight[feature].sum(2))
        move, alpha, beta = np.exp(field.move), np.zeros((longest, n, 3)), np.ones((longest, n, 3))
        for t in range(longest):
            a = np.exp(field.start) * e[:, 0] if t == 0 else np.where(live[:, t, None], (alpha[t - 1] @ move) * e[:, t], alpha[t - 1])
            alpha[t] = a / a.sum(1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            b = (e[:, t + 1] * beta[t + 1]) @ move.T
            beta[t] = np.where(live[:, t + 1, None], b / b.sum(1, keepdims=True), beta[t + 1])
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        want_w, want_m = np.zeros((FEATURES, 3)), np.zeros((3, 3))
        flat = p.transpose(1, 0, 2)[live]
        for k in range(COLUMNS):
            for y in range(3):
                want_w[:, y] += np.bincount(feature[..., k][live], flat[:, y], FEATURES)
        for t in range(longest - 1):
            on = live[:, t + 1]
            x = alpha[t][on][:, :, None] * move * (e[:, t + 1] * beta[t + 1])[on][:, None, :]
            want_m += (x / x.sum((1, 2), keepdims=True)).sum(0)
        for i, (x, g) in enumerate(((field.weight, seen_w - want_w), (field.move, seen_m - want_m), (field.start, seen_s - p[0].sum(0)))):
            g = g / n - decay * x
            moments[2 * i] += 0.1 * (g - moments[2 * i])
            moments[2 * i + 1] += 0.001 * (g**2 - moments[2 * i + 1])
            x += rate * (moments[2 * i] / (1 - 0.9**turn)) / (np.sqrt(moments[2 * i + 1] / (1 - 0.999**turn)) + 1e-8)
    return field


def make_secret(draw: np.random.Generator, kind: int) -> str:
    """A made-up secret: 0 hexadecimal, 1 mixed letters and digits, 2 base64, 3 prefixed, 4 three dotted parts, 5 a password."""
    of = lambda alphabet, low, high: "".join(draw.choice(list(alphabet), draw.integers(low, high)))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    if kind == 0:
        return of(digit + draw.choice(["abcdef", "ABCDEF"]), 20, 65)
    if kind == 1:
        return of(lower + upper + digit, 20, 49)
    if kind == 2:
        return of(lower + upper + digit + "+/", 24, 65)
    if kind == 3:
        return "_".join(of(lower, 2, 5) for _ in range(draw.integers(1, 3))) + draw.choice(["_", "-"]) + of(lower + upper + digit, 18, 41)
    if kind == 4:
        return ".".join(of(lower + upper + digit + "-_", 16, 60) for _ in range(3))
    return of(lower, 2, 6) + of(digit + upper, 2, 5) + of(lower + digit, 3, 6)


def make_harmless(draw: np.random.Generator) -> str:
    """Made-up text that looks like a secret in part: numbers, dates, versions, paths, names in code, telling words in prose."""
    of = lambda alphabet, low, high: "".join(draw.choice(list(alphabet), draw.integers(low, high)))
    letters = "aaabcdeeefghiiklmnooprsttuuvw"
    word = lambda: of(letters, 3, 10)
    kind = draw.integers(0, 10)
    if kind == 0:
        return of("0123456789", 1, 13)
    if kind == 9:
        return word() + str(draw.choice(BETWEEN)) + (of("0123456789", 1, 7) if draw.random() < 0.5 else word())
    if kind == 1:
        return f"{draw.integers(1900, 2100)}-{draw.integers(10, 13)}-{draw.integers(10, 31)}"
    if kind == 2:
        return ".".join(str(draw.integers(0, 40)) for _ in range(3))
    if kind == 3:
        return f"https://{word()}.{word()}/{word()}/{word()}-{word()}{draw.choice(['', '.html', '?id=' + of('0123456789', 2, 7)])}"
    if kind == 4:
        return word() + "".join(word().capitalize() for _ in range(draw.integers(1, 4)))
    if kind == 5:
        return "_".join(word() for _ in range(draw.integers(2, 5)))
    if kind == 6:
        return f"{word()}.{word()}@{word()}.org"
    if kind == 7:
        return "".join(word() for _ in range(draw.integers(2, 5)))
    return f"{draw.choice(TELLING)}{draw.choice(BETWEEN)}{draw.choice([*HARMLESS, word()])}"


def planted(draw: np.random.Generator, text: str, kind: int | None) -> tuple[str, tuple[int, int] | None]:
    """text with a secret of a kind (none: something harmless) between two of its words, and where the secret is."""
    words = text.split(" ")
    cut = int(draw.integers(0, len(words) + 1))
    ahead = " ".join(words[:cut]) + " "
    if kind is None:
        return ahead + make_harmless(draw) + " " + " ".join(words[cut:]), None
    value = make_secret(draw, kind)
    if kind == 5 or draw.random() < 0.7:  # passwords are told by the words before them alone
        between = str(draw.choice(BETWEEN[:-2] if kind == 5 else BETWEEN))
        name = str(draw.choice(TELLING))
        ahead += draw.choice([str.upper, str.title, str, str, str])(name) + between
        value_end = '"' if between.endswith('"') else ""
        if draw.random() < 0.15:  # a word more before the value
            ahead += draw.choice([str.title, str])(str(draw.choice(["bearer", "basic", "token", "key"]))) + " "
    else:
        value_end = ""
    return ahead + value + value_end + " " + " ".join(words[cut:]), (len(ahead), len(ahead) + len(value))


def windows_of(text: str, spans: list[tuple[int, int]], draw: np.random.Generator, hide: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, tags) of windows around the spans, or of the text's first one; at some spans the words around are hidden."""
    joined, begins = join_texts([text])
    tokens = tokenise(joined, begins)
    tags = np.full(len(tokens.start), 2)
    for a, b in spans:
        at = np.flatnonzero((tokens.start < b) & (tokens.stop > a))
        tags[at[:1]], tags[at[1:]] = 0, 1
        if draw.random() < hide:
            tokens.feature[at, -len(NEAR) :] = _FROM[-1 - len(NEAR) : -1]
    middles = np.flatnonzero(tags == 0)[:4].tolist() or [min(WINDOW // 2, len(tags) // 2)]
    cuts = [(max(0, m - WINDOW // 2), m + WINDOW // 2) for m in middles]
    return [(tokens.feature[a:b].astype(np.int64), tags[a:b]) for a, b in cuts if len(tags[a:b])]


def fit(docs: DataFrame, seed: int = 13) -> Field:
    """A field from docs (doc_id, text).

    Of about SAMPLE_TEXTS documents, chosen by a hash of ids and texts, TRAIN_TEXTS that hold a base secret and as many
    that don't give a window of up to TRAIN_CHARS characters each, whatever their length: around the first secret, or
    at a place that the hash decides; the driver gets no more than these windows of the chosen documents. Labels are
    what the patterns find, at half of them with the neighbouring words hidden. Into each window without a secret go
    one made-up secret of each kind and as many harmless things, each into a copy of its own. Without any text with a
    word, the field tags nothing.
    """
    total = docs.count()
    share = SAMPLE_TEXTS / max(1, total)
    place = F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(1 << 30))
    pattern = r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}"
    some = docs.filter(place < share * (1 << 30)).select("text", place.alias("place"), F.regexp_instr("text", F.lit(pattern)).alias("at")).filter("text is not null")
    begin = F.when(F.col("at") > 0, F.greatest(F.lit(1), F.col("at") - TRAIN_CHARS // 2)).otherwise(F.pmod("place", F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1))) + 1)
    some = some.select("place", (F.col("at") > 0).alias("holds"), F.substring("text", begin.cast("int"), F.lit(TRAIN_CHARS)).alias("text"))
    kinds = [[r["text"] for r in some.filter(k).orderBy("place", "text").limit(TRAIN_TEXTS).collect()] for k in (F.col("holds"), ~F.col("holds"))]
    draw, windows = np.random.default_rng(seed), []
    for text in kinds[0]:
        windows += windows_of(text, _secret_spans(text), draw, 0.5)
    for text in kinds[1]:
        windows += windows_of(text, _secret_spans(text), draw, 0.5)
        for kind in range(6):
            for k in (kind, None):
                made, at = planted(draw, text[: TRAIN_CHARS // 2], k)
                windows += windows_of(made, [at] if at else _secret_spans(made), draw, 0.2 if kind < 5 else 0.0)
    return train(windows)


def _secret_spans(text: str) -> list[tuple[int, int]]:
    """Where the patterns find secrets, of an assignment its value alone."""
    spans = [(text.rindex(m.group(2), m.start(), m.end()), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    return spans + [(a, b) for a, b, k in base_spans(text) if k]


def spans_of(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) of each text, base spans and those the field adds, by start and kind."""
    joined, begins = join_texts(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = sorted(base_spans(joined))
    owner = np.searchsorted(begins, [a for a, _, _ in found], "right") - 1
    for (a, b, k), i in zip(found, owner.tolist(), strict=True):
        out[i].append((a - int(begins[i]), b - int(begins[i]), k))
    tokens = tokenise(joined, begins)
    if len(tokens.start):
        hot = np.unique(np.searchsorted(tokens.first, np.flatnonzero(field.hot(tokens.feature)), "right") - 1)
        for i in hot.tolist():
            lo, hi = int(tokens.first[i]), int(tokens.first[i + 1])
            tags = field.viterbi(field.weight[tokens.feature[lo:hi]].sum(1))
            at = int(begins[i])
            base = list(out[i])
            for t in np.flatnonzero(tags == 0).tolist():
                end = t
                while end + 1 < len(tags) and tags[end + 1] == 1:
                    end += 1
                a, b = int(tokens.start[lo + t]) - at, int(tokens.stop[lo + end]) - at
                if not any(a < y and x < b for x, y, _ in base):
                    out[i].append((a, b, 3))
    for spans in out:
        spans.sort(key=lambda s: (s[0], s[2]))
    return out


def find_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with an array column `secrets` of structs start, end, kind: code points, end exclusive, by start and kind.

    Base spans always stay; the field's spans (kind crf) come where no base span lies. Null texts count as empty and
    have none. Whole texts are scanned. Repeated rows get equal spans; an empty table gives an empty result; other
    columns pass through.
    """
    ship(docs.sparkSession)
    model = fit(docs) if field is None else field

    @F.arrow_udf("array<struct<start int, end int, kind string>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for column in batches:
            texts = [t or "" for t in column.to_pylist()]
            rows, lo = [], 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
                    size += len(texts[hi])
                    hi += 1
                rows += [[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in s] for s in spans_of(texts[lo:hi], model)]
                lo = hi
            yield pa.array(rows, kind)

    return docs.withColumn("secrets", scan(F.col("text")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    joined = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = joined(F.filter("secrets", lambda s: s["kind"] != KINDS[3]))
    return out.select("doc_id", *map(number, KINDS[:3]), F.sha2(base, 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


QUERIES = {"op4_secret_scan": op4_secret_scan}
ORACLES = {}
