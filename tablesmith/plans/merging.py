"""Queries on merging, coalescing and distinct rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.operators import profiling, resolve, tables
from tablesmith.plans.base import table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def nations(spark, d):
    n = table(spark, d, "nation")
    score = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey").cast("double"))
    return n.select(F.col("n_name").alias("entity_name"), score.alias("score"), F.lit("nation").alias("source_url"))


def per_nation(spark, d, name, key, value, out):
    t = table(spark, d, name).join(F.broadcast(table(spark, d, "nation")), F.col(key) == F.col("n_nationkey"))
    return t.groupBy(F.col("n_name").alias("entity_name")).agg(F.round(F.sum(value), 2).alias("score"), F.count(F.lit(1)).alias(out)).withColumn("source_url", F.lit(name))


@query("""
WITH r AS (SELECT n_name AS entity_name, round(sum(s_acctbal), 2) AS score, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT n.n_name AS entity_name, coalesce(CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey::DOUBLE END, r.score) AS score,
       CASE WHEN r.entity_name IS NULL THEN 'nation' ELSE 'nation | supplier' END AS source_url, r.suppliers
FROM nation n LEFT JOIN r ON n.n_name = r.entity_name""")
def merge_coalesce_left(spark, d):
    return tables.coalescing_join(nations(spark, d), per_nation(spark, d, "supplier", "s_nationkey", "s_acctbal", "suppliers"))


@query("""
WITH l AS (SELECT n_name AS entity_name, round(sum(s_acctbal), 2) AS score, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 4 <> 0 GROUP BY 1),
     r AS (SELECT n_name AS entity_name, round(sum(c_acctbal), 2) AS score, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 <> 0 GROUP BY 1)
SELECT coalesce(l.entity_name, r.entity_name) AS entity_name, coalesce(l.score, r.score) AS score, suppliers,
       CASE WHEN l.entity_name IS NULL THEN 'customer' WHEN r.entity_name IS NULL THEN 'supplier' ELSE 'supplier | customer' END AS source_url, customers, r.entity_name AS right_name
FROM l FULL JOIN r ON l.entity_name = r.entity_name""")
def merge_full_outer(spark, d):
    keep = table(spark, d, "nation").select(F.col("n_name").alias("n"), "n_nationkey")
    some = lambda t, m: t.join(F.broadcast(keep.filter(F.col("n_nationkey") % m != 0)), F.col("entity_name") == F.col("n"), "left_semi")
    left = some(per_nation(spark, d, "supplier", "s_nationkey", "s_acctbal", "suppliers"), 4)
    right = some(per_nation(spark, d, "customer", "c_nationkey", "c_acctbal", "customers"), 3)
    right = right.withColumn("right_name", F.col("entity_name"))
    return tables.coalescing_join(left, right, how="full")


@query("""
WITH l AS (SELECT DISTINCT c_nationkey AS k FROM customer), r AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey % 2 = 0),
c AS (SELECT (SELECT count(*) FROM l) AS left_keys, (SELECT count(*) FROM r) AS right_keys, (SELECT count(*) FROM l SEMI JOIN r USING (k)) AS overlap)
SELECT *, overlap >= CASE WHEN least(left_keys, right_keys) <= 5 THEN 1 ELSE greatest(3, least(left_keys, right_keys) // 30) END AS eligible FROM c""")
def merge_coverage(spark, d):
    left = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    right = table(spark, d, "supplier").filter("s_nationkey % 2 = 0").select(F.col("s_nationkey").alias("k"))
    return tables.key_coverage(left, right, "k")


@query("""
SELECT s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer""")
def concat_union_by_name(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return tables.union_by_name(s, c)


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, unnest([o_orderpriority, o_orderstatus]) AS part, unnest([0, 1]) AS n FROM orders),
f AS (SELECT o_custkey, part, min((o_orderkey, n)) AS spot FROM p GROUP BY 1, 2)
SELECT o_custkey, string_agg(part, ' | ' ORDER BY spot) AS sources FROM f GROUP BY 1""")
def row_sources_union(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.concat_ws(" | ", "o_orderpriority", "o_orderstatus").alias("sources"))
    return tables.group_sources(o, "o_custkey", "o_orderkey", "sources")


@query("""
WITH p AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE p_name END AS v FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(v) DESC, p_partkey) AS k FROM p WHERE v <> 'n/a')
SELECT p_brand, (SELECT min(p_partkey) FROM part q WHERE q.p_brand = r.p_brand) AS p_partkey, v AS p_name FROM r WHERE k = 1""")
def coalesce_group_text_longest(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(F.col("p_name")).alias("p_name"))
    return tables.coalesce_groups(p, "p_brand", "p_partkey")


@query("""
SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) AS o_totalprice,
  arg_min(length(o_orderpriority)::INT, o_orderkey) AS size FROM orders GROUP BY 1""")
def coalesce_group_numeric_first(spark, d):
    t = table(spark, d, "orders")
    t = t.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("o_totalprice"), F.length("o_orderpriority").alias("size"))
    return tables.coalesce_groups(t, "o_custkey", "o_orderkey")


@query("SELECT doc_id, text, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def distinct_keep_first(spark, d):
    return tables.distinct_first(table(spark, d, "documents").select("doc_id", "text", "source"), ["text"], "doc_id")


@query("""
SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS k FROM conversations) WHERE k = 1""")
def record_fingerprint_dedupe(spark, d):
    c = table(spark, d, "conversations").withColumn("at", F.struct("conv_id", "turn"))
    c = c.withColumn("mark", tables.fingerprint(["role", "text"]))
    return tables.distinct_first(c, ["mark"], "at").drop("mark", "at")


@query("""
WITH c AS (SELECT count_if(l_quantity / 2 * 2 <> l_quantity) AS halved, count_if(trim(' ' || l_returnflag) <> l_returnflag) AS shown, count_if(CASE WHEN l_orderkey = 1 THEN l_tax + 1 ELSE l_tax END <> l_tax) AS nearly,
  count_if(coalesce(CASE WHEN l_orderkey % 2 = 0 THEN l_returnflag END, '') <> l_returnflag) AS partly FROM lineitem),
u AS (SELECT unnest(['halved', 'shown', 'nearly', 'partly']) AS dropped, unnest([halved, shown, nearly, partly]) AS apart FROM c) SELECT dropped FROM u WHERE apart = 0""")
def dup_value_columns(spark, d):
    """Of two columns with equal values the later one goes; one row that differs is enough to keep it."""
    t = table(spark, d, "lineitem")
    k = F.col("l_orderkey")
    t = t.select(
        (k * 10 + F.col("l_linenumber")).alias("pos"), "l_quantity", "l_tax", (F.col("l_quantity") / 2 * 2).alias("halved"), "l_returnflag", F.concat(F.lit(" "), F.col("l_returnflag")).alias("shown"),
        F.when(k == 1, F.col("l_tax") + 1).otherwise(F.col("l_tax")).alias("nearly"), F.when(k % 2 == 0, F.col("l_returnflag")).alias("partly"),
    )
    return spark.createDataFrame([(c,) for c in tables.duplicate_columns(t, "pos")], "dropped string")


@query("""
SELECT p.p_partkey, trim(regexp_replace(lower(regexp_replace(p_brand, '([A-Za-z])([0-9])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')) AS entity_name FROM part p""")
def resolve_exact(spark, d):
    return resolve.resolve_exact(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "entity_name")


VARIANT = "'team ' || translate(md5(p_name), '0123456789', 'ghijklmnop')[:16] || (['x', 'y', 'z'])[p_partkey % 3 + 1]"


@query(f"""
WITH v AS (SELECT p_partkey AS pos, p_name AS base, {VARIANT} AS name FROM part)
SELECT pos, name, arg_min(name, pos) OVER (PARTITION BY base) AS entity_name FROM v""")
def resolve_fuzzy(spark, d):
    """Names that differ by their last letter (42 of 44 letters in common) go to the first of them; other names share no more than chance."""
    name = F.concat(F.lit("team "), F.substring(F.translate(F.md5("p_name"), "0123456789", "ghijklmnop"), 1, 16), F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("p_partkey") % 3 + 1).cast("int")))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), name.alias("name"))
    return resolve.resolve_fuzzy(parts, "name", "pos").select("pos", "name", "entity_name")


@query("""
SELECT d.source, count(*) AS documents, count(l.doc_id) AS labelled, round(avg(l.quality), 6) AS quality, round(avg(l.toxic), 6) AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def label_join_quality(spark, d):
    labels = table(spark, d, "labels").withColumn("labelled", F.lit(1))
    joined = tables.coalescing_join(table(spark, d, "documents").select("doc_id", "source"), labels, key="doc_id", source="")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("labelled").alias("labelled"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))


def flagship(spark, d):
    """Nations, suppliers and customers merged wide, then profiled."""
    wide = tables.coalescing_join(nations(spark, d), per_nation(spark, d, "supplier", "s_nationkey", "s_acctbal", "suppliers"))
    wide = tables.coalescing_join(wide, per_nation(spark, d, "customer", "c_nationkey", "c_acctbal", "customers"))
    return profiling.profile(wide)
