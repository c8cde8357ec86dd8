"""Sharding by balanced label propagation over groups of linked documents.

Native: DataFrame functions only. The law is `rows`: shard sizes in rows differ by one at most.

Linked documents are those with equal texts. They are first dealt out in turn; then, turn by turn, documents ask to
move to a shard where more of their neighbours are, until the number of cut edges stops falling. A shard takes no
more linked documents than its size, counting those that leave it in the same turn, so documents may change places
in pairs or along longer cycles; where that is not enough, groups that lie whole in a shard give way, which cuts
nothing. Documents without neighbours, as well off anywhere, fill what is left of each shard. All of this works on
`units`, the rows (group, shard, number of documents), so a group that a third of all rows share is a few rows; only
the documents wanted and granted between each pair of shards are known to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import bucketed_rank_base, materialise, table

#: Turns at most, and turns without fewer cut edges after which there are no more.
TURNS, PATIENCE = 24, 4


def buckets_for(rows: int) -> int:
    """Buckets of a running total, and salts of a group: some 50,000 rows each, whatever the input."""
    return max(64, -(-rows // 50_000))


def _spread(df: DataFrame, parts: list[str], n: str, out: str, buckets: int, seed: int = 0) -> DataFrame:
    """Running total of n before each row, within parts, by a hash of the group and a seed; no window holds more than a bucket."""
    hashed = F.xxhash64("group", F.lit(seed)) if seed else F.xxhash64("group")
    df = df.withColumn("bucket", F.pmod(hashed, F.lit(buckets)).cast("int"))
    base = bucketed_rank_base(df.groupBy(*parts, "bucket").agg(F.sum(n).alias("all")), parts, "bucket", "all", "base").drop("all")
    w = Window.partitionBy(*parts, "bucket").orderBy("group", *[c for c in ("shard",) if c in df.columns]).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("within", F.coalesce(F.sum(n).over(w), F.lit(0)))
    return df.join(base, [*parts, "bucket"]).withColumn(out, F.col("base") + F.col("within")).drop("bucket", "within", "base")


def deal(groups: DataFrame, shards: int, buckets: int) -> DataFrame:
    """Units for groups (group, n): all their documents, in the order of their groups, are dealt to the shards in turn."""
    g = _spread(groups, [], "n", "first", buckets)
    g = g.withColumn("shard", F.explode(F.array(*[F.lit(s) for s in range(shards)])))
    upto = lambda x: F.floor((x + (shards - 1) - F.col("shard")) / shards)  # noqa: E731  documents 0..x-1 that fall to the shard
    return g.withColumn("k", (upto(F.col("first") + F.col("n")) - upto(F.col("first"))).cast("long")).filter("k > 0").select("group", "shard", "n", F.col("k").alias("here"))


def together(units: DataFrame) -> tuple[int, dict[int, int]]:
    """Pairs of linked documents in one shard, and how many linked documents each shard has."""
    here = F.col("here").cast("decimal(38,0)")
    rows = units.groupBy("shard").agg(F.sum(here * (here - 1)).alias("pairs"), F.sum("here").alias("n")).collect()  # a row for each shard
    return sum(int(r["pairs"]) for r in rows) // 2, {r["shard"]: r["n"] for r in rows}


def grant(ask: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many of the documents that ask to move from a to b may: no shard gains more than its room, less what leaves it."""
    given = dict(ask)
    again = True
    while again:
        again = False
        for b, free in room.items():
            over = sum(n for (_, y), n in given.items() if y == b) - sum(n for (x, _), n in given.items() if x == b) - free
            for pair in sorted((p for p in given if p[1] == b), key=lambda p: -given[p]):
                less = min(given[pair], max(0, over))
                given[pair] -= less
                over -= less
                again |= less > 0
    return given


def _values(spark: SparkSession, columns: str, rows: list[tuple[int, ...]]) -> DataFrame:
    """A table of a few whole numbers; without rows, an empty one."""
    shown = ", ".join(str(r) for r in rows) or "(" + ", ".join(["0"] * len(columns.split(","))) + ")"
    out = spark.sql(f"SELECT * FROM VALUES {shown} AS t({columns})")
    return out if rows else out.limit(0)


def propagate(units: DataFrame, room: dict[int, int], turn: int, buckets: int) -> DataFrame:
    """Units (group, shard, n of the whole group, here) after one turn.

    The shards of a group are in order: more documents first, then by a hash, another one each time. On even turns a
    unit asks for the first of them, whether it has room or not, on odd ones for the first before its own that has.
    """
    spark = units.sparkSession
    rank = F.struct((-F.col("here")).alias("less"), F.xxhash64("group", "shard", F.lit(turn // 2)).alias("draw"), "shard")
    order = F.array_sort(F.collect_list(rank).over(Window.partitionBy("group")))  # one for each shard at most
    full = [s for s, free in room.items() if free <= 0]
    open_ = (lambda x: ~x["shard"].isin(*full)) if turn % 2 and full else (lambda x: F.lit(True))
    asked = units.withColumns({"rank": rank, "order": order})
    asked = asked.withColumn("to", F.get(F.filter("order", lambda x: (x < F.col("rank")) & open_(x)), F.lit(0))["shard"]).drop("rank", "order")
    asked = materialise(asked, "shard-asked")
    ask = {(r["shard"], r["to"]): r["n"] for r in asked.filter("to is not null").groupBy("shard", "to").agg(F.sum("here").alias("n")).collect()}  # pairs of shards
    quota = grant(ask, room)
    left = {(b, a): n - quota[a, b] for (a, b), n in ask.items() if n > quota[a, b]}
    moves = None
    if left:  # groups that lie whole in b go to a, so that as many documents may come from a to b
        low, ranges = dict.fromkeys(room, 0), []
        for (b, a), n in sorted(left.items()):
            ranges.append((b, a, low[b], n))
            low[b] += n
        whole = _spread(asked.filter("here = n").select("group", "shard", "n", "here"), ["shard"], "here", "at", buckets)
        whole = whole.join(F.broadcast(_values(spark, "shard, to, low, room", ranges)), "shard")  # pairs of shards
        moves = materialise(whole.filter("at >= low and at + here <= low + room").select("group", "shard", "to", "n", F.col("here").alias("m")), "shard-whole")
        for r in moves.groupBy("shard", "to").agg(F.sum("m").alias("m")).collect():
            quota[r["to"], r["shard"]] += r["m"]
    granted = _values(spark, "shard, to, quota", [(a, b, n) for (a, b), n in quota.items() if n])
    moved = _spread(asked.filter("to is not null"), ["shard", "to"], "here", "before", buckets).join(F.broadcast(granted), ["shard", "to"])
    moved = moved.select("group", "shard", "to", "n", F.least("here", F.col("quota") - F.col("before")).alias("m")).filter("m > 0")
    moved = moved if moves is None else moved.unionByName(moves)
    change = F.explode(F.array(F.struct("shard", (-F.col("m")).alias("here")), F.struct(F.col("to").alias("shard"), F.col("m").alias("here"))))
    after = asked.select("group", "n", "shard", "here").unionByName(moved.select("group", "n", change.alias("x")).select("group", "n", "x.*"))
    return after.groupBy("group", "n", "shard").agg(F.sum("here").alias("here")).filter("here > 0")


def fill(alone: DataFrame, room: dict[int, int], buckets: int) -> DataFrame:
    """Units for documents without neighbours (group), as many for each shard as it has room."""
    low, ranges = 0, []
    for s, n in sorted(room.items()):
        ranges.append((s, low, n))
        low += n
    at = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(a).cast("long").alias("low"), F.lit(n).cast("long").alias("n")) for s, a, n in ranges])
    rows = _spread(alone.withColumn("here", F.lit(1).cast("long")), [], "here", "nth", buckets).withColumn("at", at)
    return rows.select("group", F.expr("filter(at, x -> x.low <= nth and nth < x.low + x.n)[0].shard").alias("shard"), F.lit(1).cast("long").alias("n"), "here")


def salt_of(docs: DataFrame, salts: int) -> Column:
    """A salt by everything that a row holds but its text, so equal texts spread unless their rows are equal throughout."""
    told = [F.col(f"`{c}`") for c, t in docs.dtypes if c != "text" and "map<" not in t and "variant" not in t]
    return F.pmod(F.xxhash64(F.lit(1), *told), F.lit(salts)).cast("int")


def shard(docs: DataFrame, shards: int = 8, into: str = "placed", report: list | None = None) -> DataFrame:
    """docs with a struct column `into` (in place of one of that name): group (digest of the text), shard, slot (gapless from 0 in each shard).

    A null text is a group of its own, apart from empty texts. Null and repeated ids are ordinary rows. An empty
    table gives an empty result, and other columns pass through. Texts are equal if their SHA-256 digests are. The cut
    edges before and after each turn go to `report`.
    """
    group = F.coalesce(F.sha2("text", 256), F.lit("null"))
    docs = docs.drop(into)
    total = docs.count()
    buckets = buckets_for(total)
    key = docs.select(group.alias("group"), salt_of(docs, buckets).alias("salt"))
    parts = materialise(key.groupBy("group", "salt").agg(F.count(F.lit(1)).alias("n")), "shard-parts")
    sizes = materialise(parts.groupBy("group").agg(F.sum("n").alias("n")), "shard-groups")
    most = {s: total // shards + (s < total % shards) for s in range(shards)}
    units = materialise(deal(sizes.filter("n > 1"), shards, buckets), "shard-units")
    n = F.col("n").cast("decimal(38,0)")
    edges = int(sizes.agg(F.coalesce(F.sum(n * (n - 1)), F.lit(0))).first()[0]) // 2
    pairs, held = together(units)
    cut, stale = [edges - pairs], 0
    for turn in range(TURNS):
        if not cut[-1] or stale == PATIENCE:
            break
        units = materialise(propagate(units, {s: most[s] - held.get(s, 0) for s in most}, turn, buckets), "shard-units")
        pairs, held = together(units)
        stale = stale + 1 if edges - pairs >= min(cut) else 0
        cut.append(edges - pairs)
    if report is not None:
        report.extend(cut)
    units = units.unionByName(fill(sizes.filter("n = 1").select("group"), {s: most[s] - held.get(s, 0) for s in most}, buckets))
    units = _spread(units.drop("n"), ["shard"], "here", "slot", buckets, seed=1)  # the buckets by which shards were filled lie in one shard each
    w = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("low", F.coalesce(F.sum("here").over(w), F.lit(0)))
    ranges = units.groupBy("group").agg(F.collect_list(F.struct("low", F.col("here").alias("n"), "shard", "slot")).alias("ranges"))  # one for each shard at most
    by_salt = Window.partitionBy("group").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("first", F.coalesce(F.sum("n").over(by_salt), F.lit(0))).drop("n").join(ranges, "group")
    rows = docs.select(F.struct("*").alias("row"), group.alias("group"), salt_of(docs, buckets).alias("salt"))
    nth = F.row_number().over(Window.partitionBy("group", "salt").orderBy("row.doc_id")) - 1
    rows = rows.withColumn("nth", nth).join(parts, ["group", "salt"]).withColumn("nth", F.col("nth") + F.col("first"))
    rows = rows.withColumn("at", F.expr("filter(ranges, x -> x.low <= nth and nth < x.low + x.n)[0]"))
    return rows.select("row.*", F.struct("group", F.col("at.shard").alias("shard"), (F.col("at.slot") + F.col("nth") - F.col("at.low")).alias("slot")).alias(into))


def op3_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.coalesce(F.sha2("text", 256), F.lit("null")).alias("text"))
    out = shard(slim)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("placed.shard").cast("int").alias("shard"), F.col("placed.slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_shard_documents": op3_shard_documents}
ORACLES = {}
