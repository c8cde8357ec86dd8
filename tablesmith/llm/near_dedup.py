"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Shingles are permuted once (sigma); every signature coordinate is the minimum of one second permutation (pi) of
what sigma gives, shifted circularly by one more place for each coordinate. Documents with equal shingle sets are
one class from the start, so copies cost nothing further on.

Links between classes are confirmed on full sets. First every class is compared with one member of its buckets,
which is enough for most groups. What then still shares a bucket without being connected is compared completely,
in blocks of bounded size, until each pair of different components in a bucket has been checked: no bucket is
capped, and no link that decides about a component is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from tablesmith.llm.common import WORD, attach, materialise, ship, table
from tablesmith.llm.wordscan import mix, scan

#: Coordinates of a band. With 24 bands a pair of similarity 0.85 is missed once in a million times, with 36 one of 0.8.
ROWS = 5
#: Classes of a block; two blocks are compared in one go. Classes that meet one copy of the set that they are compared with.
BLOCK, STAR = 256, 512
#: Places where the rows of a bucket meet its first class.
SPREAD = 8


def shingle_sets(texts: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct hashes of the k-word shingles of each text; a text of fewer words is one shingle, one of none has none."""
    for w in scan(texts):
        n = len(w.hash)
        odd = np.uint64(0xC2B2AE3D27D4EB4F)
        h = np.zeros(max(0, n - k + 1), np.uint64)
        for i in range(k if n >= k else 0):
            h = (h + w.hash[i : i + n - k + 1]) * odd
        if n >= k:
            mix(h)
        out = []
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(h[a : b - k + 1]))
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for i in range(a, b):
                    whole = (whole ^ w.hash[i : i + 1]) * odd
                out.append(mix(whole))
            else:
                out.append(np.zeros(0, np.uint64))
        yield out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: one row of unsigned 32-bit minima per set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.empty((len(sets), coordinates), np.uint32)
    lo = 0
    while lo < len(sets):
        hi = lo + 1
        total = sizes[lo]
        while hi < len(sets) and total + sizes[hi] <= 65536:
            total += sizes[hi]
            hi += 1
        sigma = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
        begins = np.concatenate(([0], np.cumsum(sizes[lo : hi - 1])))
        x, y = np.empty_like(sigma), np.empty_like(sigma)
        for c in range(coordinates):
            np.subtract(sigma, np.uint32(c), out=x)  # the shift is modulo 2^32
            for shift, odd in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                np.right_shift(x, np.uint32(shift), out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, np.uint32(odd), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            out[lo:hi, c] = np.minimum.reduceat(x, begins)
        lo = hi
    return out


def _digests(sets: list[np.ndarray]) -> list[bytes]:
    """128-bit digest of each set."""
    return [hashlib.blake2b(s, digest_size=16).digest() for s in sets]


def _spot():
    """What finds a row's text again; sets are recognised by their digest, so nothing hangs on its being unique."""
    return F.xxhash64("doc_id", "text").alias("spot")


def sign(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """row (struct of docs' columns without text), spot, n_shingles, digest (of the set), bands (their hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(0), k):
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                full = [s for s in sets if len(s)]
                h = np.zeros((len(full), bands), np.uint64)
                if full:
                    s = signatures(full, bands * ROWS).reshape(len(full), bands, ROWS)
                    for i in range(ROWS):
                        h = (h ^ s[:, :, i]) * salt[i]
                    mix(h)
                cut = np.concatenate(([0], np.cumsum(np.where(sizes > 0, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(h.reshape(-1).view(np.int64)))
                n = len(sets)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in batch.columns[1:]), pa.array(sizes), pa.array(_digests(sets)), lists], names=["row", "spot", "n_shingles", "digest", "bands"])
                at += n

    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), _spot())
    made = StructType([rows.schema["row"], rows.schema["spot"]]).add("n_shingles", LongType()).add("digest", BinaryType()).add("bands", ArrayType(LongType()))
    return rows.mapInArrow(run, made)


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """class, shingles (its set as bytes) for the classes of wanted (class, spot, digest): one of the rows of each gives its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(0), k):
                want = batch.column(2).slice(at, len(sets)).to_pylist()
                hit = [i for i, own in enumerate(_digests(sets)) if own == want[i]]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(sets)).take(pa.array(hit, pa.int64())), pa.array([sets[i].tobytes() for i in hit], pa.binary())], names=["class", "shingles"])
                at += len(sets)

    rows = docs.select("text", _spot()).join(wanted, "spot").select("text", "class", "digest")
    # a repeated row gives the same set again
    return rows.mapInArrow(run, "class long, shingles binary").groupBy("class").agg(F.first("shingles").alias("shingles"))


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def confirm(stars: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets have den * intersection >= num * union; no a comes twice.

    Many classes may have the same b, so its set goes to a task for every STAR of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            hit = [i for i in range(len(batch)) if _linked(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64), num, den)]
            yield batch.select(["a", "b"]).take(pa.array(hit, pa.int64()))

    stars = materialise(stars, "near-stars")
    hubs = materialise(stars.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / STAR)), "near-hubs")
    spread = attach(stars, hubs, "b", stars.count()).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts"))).drop("parts")
    left, right = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    right = right.join(hubs, "b").select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "y")
    return spread.join(left, "a").join(right, ["b", "part"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """class, root (the smallest class reachable) for all classes on links (a, b); large-star and small-star in turn."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = materialise(both(links).filter("a > b").distinct(), "links")
    before = size(edges)
    while True:
        near = both(edges)
        low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = attach(near, materialise(low, "links-low"), "a", 2 * before[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.distinct(), "links")
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "links-low")
        small = attach(large, low, "a", before[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = materialise(small.filter("a <> b").distinct(), "links")
        now = size(edges)
        if now == before:
            break
        before = now
    root = edges.select(F.col("a").alias("class"), F.col("b").alias("root"))
    return root.unionByName(edges.select(F.col("b").alias("class"), F.col("b").alias("root")).distinct())


def rest_links(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between different components of the same bucket, members (a table) being bucket, class, root, main.

    The members outside a bucket's main component are compared with all others of the bucket that are of another
    component. Both sides are cut into blocks; a task compares two blocks, so the largest bucket only makes more tasks.
    """
    hashed = lambda n: F.pmod(F.xxhash64("class"), n)
    number = [F.ceil(F.count(F.when(c, 1)) / BLOCK).cast("long").alias(x) for x, c in (("others", F.col("root") != F.col("main")), ("mains", F.col("root") == F.col("main")))]
    blocks = materialise(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *number).filter("others > 0"), "near-blocks")
    m = attach(members, blocks, "bucket", members.count()).withColumn("out", F.col("root") != F.col("main"))
    m = m.withColumn("own", F.when(F.col("out"), hashed(F.col("others"))).otherwise(hashed(F.greatest("mains", F.lit(1)))))
    # task (i, j): j below others is a block outside the main component, j from there on one inside
    inner = F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda i: F.struct(i.alias("i"), (F.col("others") + F.col("own")).alias("j")))
    as_i = F.filter(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") + F.col("mains") - 1), lambda j: F.struct(F.when(j < F.col("others"), F.least(j, F.col("own"))).otherwise(F.col("own")).alias("i"), F.when(j < F.col("others"), F.greatest(j, F.col("own"))).otherwise(j).alias("j"))),
        lambda x: x["i"].isNotNull(),
    )
    tasks = m.withColumn("task", F.explode(F.when(F.col("out"), as_i).otherwise(inner))).select("bucket", "task.i", "task.j", "class", "root", "out")
    tasks = tasks.join(sets, "class").select("bucket", "i", "j", "class", "root", "out", "shingles")

    def compare(ids: np.ndarray, roots: np.ndarray, out: np.ndarray, shingles: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        sizes = np.fromiter(map(len, shingles), np.int64, len(shingles))
        owner = np.repeat(np.arange(len(ids)), sizes)
        values = np.concatenate(shingles)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        new = np.concatenate(([True], values[1:] != values[:-1]))
        number = np.cumsum(new) - 1
        shared = np.bincount(number)[number] > 1  # only shingles of two members or more count
        owner, number = owner[shared], number[shared]
        both = np.zeros((len(ids), len(ids)), np.float32)
        if len(owner):
            columns = np.unique(number, return_inverse=True)[1]
            step = 4096
            for lo in range(0, int(columns.max()) + 1, step):
                here = (columns >= lo) & (columns < lo + step)
                grid = np.zeros((len(ids), step), np.float32)
                grid[owner[here], columns[here] - lo] = 1
                both += grid @ grid.T
        rows, cols = np.nonzero(np.triu(den * both >= num * (sizes[:, None] + sizes[None, :] - both), 1))
        for r, c in zip(rows.tolist(), cols.tolist(), strict=True):
            if roots[r] != roots[c] and (out[r] or out[c]):
                yield (int(ids[r]), int(ids[c]))

    def forest(found: Iterator[tuple[int, int]], root_of: dict[int, int]) -> list[tuple[int, int]]:
        """The links that join components which the links before them left apart; the others say nothing new."""
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        out = []
        for a, b in found:
            x, y = top(root_of[a]), top(root_of[b])
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((a, b))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> pa.RecordBatch:
            ids = np.array([x["class"] for x in held])
            roots = np.array([x["root"] for x in held])
            found = []
            if len(held) > 1:
                links = compare(ids, roots, np.array([x["out"] for x in held]), [np.frombuffer(x["shingles"], np.uint64) for x in held])
                found = forest(links, dict(zip(ids.tolist(), roots.tolist(), strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for x in batch.to_pylist():
                if held and (x["bucket"], x["i"], x["j"]) != (held[0]["bucket"], held[0]["i"], held[0]["j"]):
                    yield done()
                    held = []
                held.append(x)
        if held:
            yield done()

    return tasks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = 36, into: str = "near") -> DataFrame:
    """docs' columns but text, with a struct column `into` (in place of one of that name): n_shingles, component_id (the smallest doc_id of the component).

    A document's set holds the distinct k-word shingles of its text, A-Z lower-cased, words being runs of anything
    but ASCII white space; fewer than k words are one shingle. Null texts and texts without words have an empty set
    and stay alone. Documents are linked where den * intersection >= num * union. Null ids are left out of the
    minimum where a component has others. Rows that repeat an id are rows like any other. An empty table gives an
    empty result.

    Words and shingles are known by 64-bit hashes when two sets are compared, equal sets by 128-bit digests of these.
    """
    found = _grouped(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")), k, num, den, bands)
    kept = [c for c in docs.columns if c not in ("text", into)]
    return found.select(*[F.col("row.row").getField(c).alias(c) for c in kept], F.struct("n_shingles", "component_id").alias(into))


def _grouped(docs: DataFrame, k: int, num: int, den: int, bands: int) -> DataFrame:
    """row (docs' columns without text), n_shingles, component_id and root, a key of the component that does not depend on ids (null for an empty set).

    Where a class, a bucket, a set or a component has a great share of all rows, what is known of it is copied
    (`attach`, `confirm`) instead of gathering its rows.
    """
    ship(docs.sparkSession)
    signed = materialise(sign(docs, k, bands), "near-signed")
    full = signed.filter("n_shingles > 0").select(F.col("row.doc_id").alias("doc_id"), "spot", "digest", "bands")
    classes = full.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.min("spot").alias("spot"), F.first("bands").alias("bands"))
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()), "near-classes")
    buckets = materialise(classes.select("class", F.posexplode("bands").alias("band", "hash")).select("class", F.xxhash64("band", "hash").alias("bucket")), "near-buckets")
    first = materialise(buckets.groupBy("bucket").agg(F.min("class").alias("main"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-first")
    # most buckets have one class and end here; the rows of the others meet in SPREAD places each, as a bucket may be large
    spread = buckets.withColumn("part", F.pmod(F.xxhash64("class"), F.lit(SPREAD)))
    copies = first.select("bucket", "main", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("part"))
    members = materialise(spread.join(copies, ["bucket", "part"]).drop("part"), "near-members")
    needed = members.select("class").distinct().join(classes.select("class", "spot", "digest"), "class")
    sets = materialise(sets_of(docs, needed, k), "near-sets")
    stars = members.filter("class <> main").groupBy("class").agg(F.min("main").alias("b")).withColumnRenamed("class", "a")
    links = materialise(confirm(stars, sets, num, den), "near-links")
    roots = materialise(components(links), "near-roots")
    own = lambda df, c, out: df.join(roots.select(F.col("class").alias(c), F.col("root").alias(out)), c, "left").withColumn(out, F.coalesce(out, c))
    mains = materialise(own(first, "main", "main_root").select("bucket", "n", F.col("main_root").alias("main")), "near-mains")
    owned = materialise(own(members.drop("main"), "class", "root"), "near-owned")
    known = materialise(attach(owned, mains, "bucket", owned.count()).select("bucket", "class", "root", "main"), "near-known")
    rest = materialise(rest_links(known, sets, num, den), "near-rest")
    roots = materialise(components(links.unionByName(rest)), "near-roots")
    linked = materialise(classes.select("class", "doc_id").join(roots, "class"), "near-linked")
    least = materialise(linked.groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "near-least")
    linked = attach(linked.drop("doc_id"), least, "root", linked.count())
    per_class = classes.select("class", "digest", "doc_id", "n").join(linked, "class", "left")
    per_class = materialise(per_class.select("digest", "n", F.coalesce("root", "class").alias("root"), F.coalesce("least", "doc_id").alias("component_id")), "near-components")
    rows = signed.select("row", "n_shingles", "digest")
    out = attach(rows.filter("n_shingles > 0"), per_class, "digest", signed.count()).drop("digest")
    alone = rows.filter("n_shingles = 0").select("row", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("row.doc_id").alias("component_id"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = 36) -> DataFrame:
    """The rows of docs that stay: of each component the document with the smallest id, once even if its row is repeated.

    Of rows with the same id and text that differ in other columns, the one with the least hash of all columns stays.

    Documents without words all stay. Components are told apart by what they hold, not by their ids: null ids and rows
    that share an id but differ in their texts lose nothing. A null id stays where its component has no other.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    found = _grouped(docs.select("doc_id", "text", key.alias("key")), k, num, den, bands).filter("n_shingles > 0")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("row.doc_id").isNull().alias("no_id"), "row.doc_id", "row.key")).alias("x"))
    stays = first.select(F.col("x.doc_id").alias("__id"), F.col("x.key").alias("__key"))
    spoken = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = docs.filter(spoken).select(F.struct("*").alias("__row"), "doc_id", key.alias("__key"))
    rows = rows.join(stays, rows["doc_id"].eqNullSafe(stays["__id"]) & (rows["__key"] == stays["__key"])).select("__row", rows["doc_id"], rows["__key"])
    told = [F.col("__row")[c] for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    once = rows.groupBy("doc_id", "__key").agg(F.min_by("__row", F.xxhash64(F.lit(1), *told)).alias("__row"))  # repeats go before the shuffle
    return once.select("__row.*").unionByName(docs.filter(~spoken))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, num=85, bands=24)
    return out.select("doc_id", "near.n_shingles", "near.component_id", F.col("doc_id").eqNullSafe(F.col("near.component_id")).alias("kept"))


QUERIES = {"op9_near_duplicates": op9_near_duplicates}
ORACLES = {}
