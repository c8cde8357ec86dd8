"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Each document gets a mask of the filters that it fails; a part's documents then are at most 2^k cells of counts.
All orders are visited by swaps of neighbours, so a swap changes two steps only, which are read off the cells again;
what each filter removes, summed over the walk, is its Shapley value (times the number of orders).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.common import WORD, attach, materialise, ship, table

#: Orders grow with the factorial of the filters: so many are 40,320.
MOST_FILTERS = 8
COUNTS = ["n", "good", "toxic"]


def swaps(k: int) -> Iterator[int]:
    """Places i whose elements i and i+1 change places, one after the other, until each order of k was there once.

    The largest element runs from end to end; where it turns, the others make one step of their own walk.
    """
    if k < 2:
        return
    inner, down = swaps(k - 1), True
    while True:
        yield from (range(k - 2, -1, -1) if down else range(k - 1))
        step = next(inner, None)
        if step is None:
            return
        yield step + down  # the largest stands in front of the others now, or behind them
        down = not down


def walk(names: str, cells: dict[int, tuple[int, ...]]) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, good, toxic) for each order of the filters and each of its steps.

    cells: counts (n, good, toxic) by mask, filter i at bit i. A step depends on its filter and on the set of those
    before it, so a swap of two neighbours leaves all other steps as they are.
    """
    k = len(names)
    order, size = list(range(k)), sum(c[0] for c in cells.values())
    fails = [sum(c[0] for m, c in cells.items() if m >> f & 1) for f in range(k)]

    def removes(f: int, before: int) -> tuple[int, ...]:
        hit = [c for m, c in cells.items() if m >> f & 1 and not m & before]
        return tuple(sum(c[j] for c in hit) for j in range(len(COUNTS)))

    ahead = [sum(1 << f for f in order[:i]) for i in range(k)]
    gone = [removes(f, ahead[i]) for i, f in enumerate(order)]
    kept = [size - sum(g[0] for g in gone[: i + 1]) for i in range(k)]
    moves = swaps(k)
    while True:
        name = "".join(names[f] for f in order)
        for i, f in enumerate(order):
            yield name, i + 1, kept[i], gone[i][0], fails[f] - gone[i][0], gone[i][1], gone[i][2]
        i = next(moves, None)
        if i is None:
            return
        order[i], order[i + 1] = order[i + 1], order[i]
        ahead[i + 1] = ahead[i] | 1 << order[i]
        gone[i], gone[i + 1] = removes(order[i], ahead[i]), removes(order[i + 1], ahead[i + 1])
        kept[i] = (kept[i - 1] if i else size) - gone[i][0]


def repeats(rows: DataFrame) -> DataFrame:
    """Distinct rows (doc_id, digest, others) with `times`, how often each is there, and `repeated`: whether a smaller doc_id has the digest.

    A null doc_id is no smaller than any and has none smaller. What is known of a hot digest is copied to several
    places, each of which gets a part of its rows.
    """
    rows = materialise(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times")), "audit-rows")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    least = materialise(least, "audit-texts")
    total = least.agg(F.sum("n")).first()[0] or 0
    return attach(rows, least, "digest", total).withColumn("repeated", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("least")


def cells(docs: DataFrame, filters: dict[str, Column], marks: DataFrame, part: Column, repeated: str | None = None) -> DataFrame:
    """Counts (part, mask, n, good, toxic) of docs (doc_id, text and whatever the filters read).

    filters: for each one-letter name, when a document fails; null counts as passed. `repeated` names one more filter:
    a document fails it if another's text with a smaller doc_id is the same (by SHA-256 of UTF-8; null counts as empty).
    marks: doc_id, good and toxic (booleans); rows that repeat an id are taken together.
    """
    names = list(filters)
    mask = sum((F.when(filters[f], 1 << i).otherwise(0) for i, f in enumerate(names)), F.lit(0))
    rows = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), part.alias("part"), mask.alias("mask"))
    marks = marks.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("good", "toxic")])
    none = [F.lit(False).alias(c) for c in ("good", "toxic")]
    known = rows.filter("doc_id is not null").join(marks, "doc_id", "left").select(*rows.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    rows = known.unionByName(rows.filter("doc_id is null").select("*", *none))
    if repeated is None:
        rows = rows.withColumn("times", F.lit(1).cast("long"))
    else:
        rows = repeats(rows).withColumn("mask", F.col("mask") + F.when(F.col("repeated"), 1 << len(names)).otherwise(0))
    n = F.col("times")
    return rows.groupBy("part", "mask").agg(F.sum(n).alias("n"), *[F.sum(F.when(F.col(c), n).otherwise(0)).alias(c) for c in ("good", "toxic")])


def audit(counted: DataFrame, names: str) -> DataFrame:
    """The walk through all orders for each part of `cells`: one row for each part, order and step, zeros included.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. A part
    is one row of at most 2^k cells, and the parts are worked on side by side. An empty table gives an empty result.
    """
    if len(names) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    ship(counted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch["part"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                by = {c["mask"]: tuple(c[x] for x in COUNTS) for c in found}
                rows = list(walk(names, by))
                shapley = dict.fromkeys(names, 0)
                for order, step, _, removed, *_ in rows:
                    shapley[order[step - 1]] += removed
                alone = [order[step - 1] for order, step, *_ in rows]
                cols = [[part] * len(rows), *map(list, zip(*rows, strict=True))]
                unique = [by.get(1 << names.index(f), (0,))[0] for f in alone]
                cols = [*cols[:6], unique, *cols[6:], [shapley[f] for f in alone]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7, strict=True)], names=LABELS)

    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # 2^k cells at most
    longs = ", ".join(f"{c} long" for c in LABELS[3:])
    return parts.mapInArrow(run, f"part string, filter_order string, step int, {longs}")


LABELS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_facts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) with words, distinct words, capitals, code points and whether a mark of markup is there; null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    gaps = "[" + WORD.removeprefix("[^").removesuffix("]+") + "]+"
    docs = docs.select("doc_id", text.alias("text"), "lang", F.array_remove(F.split(text, gaps), "").alias("words"))
    capitals = F.octet_length(F.regexp_replace("text", "[^A-Z]+", ""))
    return docs.select("doc_id", "text", "lang", F.size("words").alias("words"), F.size(F.array_distinct("words")).alias("distinct"), capitals.alias("capitals"), F.length("text").alias("chars"), F.col("text").rlike("[#$%&*|]").alias("marked"))


FILTERS = {"A": "words < 200", "B": "100L * distinct < 50L * words", "C": "100L * capitals > 3L * chars", "D": "marked"}


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_facts(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    counted = cells(docs, {f: F.expr(c) for f, c in FILTERS.items()}, labels, F.coalesce("lang", F.lit("")), repeated="E")
    return audit(counted, "ABCDE")


QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {
    "op13_filter_audit": r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 200)::int AS a, (100 * len(list_distinct(w)) < 50 * len(w))::int AS b,
         (100 * strlen(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text))::int AS c,
         regexp_matches(text, '[#$%&*|]')::int AS d,
         (t.doc_id > min(t.doc_id) OVER (PARTITION BY text))::int AS e
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id
), cell AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM m GROUP BY ALL
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT p.f || q.f || r.f || s.f || u.f AS filter_order
  FROM f p, f q, f r, f s, f u
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, u.f])) = 5
), steps AS (
  SELECT filter_order, step, f.bit,
         (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE instr(left(filter_order, step - 1), g.f) > 0) AS before
  FROM orders, range(1, 6) x(step) JOIN f ON true
  WHERE f.f = substr(filter_order, step, 1)
), counted AS (
  SELECT p.part, s.filter_order, s.step, s.bit,
         sum(CASE WHEN mask & (s.before | s.bit)::bigint = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & s.bit > 0 AND mask & s.before::bigint = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & s.bit > 0 AND mask & s.before::bigint > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = s.bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & s.bit > 0 AND mask & s.before::bigint = 0 THEN c.good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & s.bit > 0 AND mask & s.before::bigint = 0 THEN c.toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT DISTINCT part FROM cell) p JOIN cell c ON c.part = p.part, steps s
  GROUP BY ALL
)
SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant,
       unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::bigint AS shapley
FROM counted
"""
}
