"""Queries on data quality, profiles and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.functions.text import strict_double
from tablesmith.operators import profiling, quality, records
from tablesmith.plans.base import table
from tablesmith.plans.merging import query  # noqa: F401  one catalogue for all

NOISY = """n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN ' N/A ' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 2 = 0 THEN 'Unknown' ELSE o_orderpriority END AS priority,
  'x' AS fixed, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS cust FROM orders)"""


def noisy(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 7 == 0, None).when(k % 11 == 0, " N/A ").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 5 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k % 2 == 0, "Unknown").otherwise(F.col("o_orderpriority")).alias("priority"), F.lit("x").alias("fixed"), F.when(k % 13 != 0, F.col("o_custkey")).alias("cust"),
    )


@query(f"""WITH {NOISY} SELECT unnest(['status', 'price', 'priority', 'fixed', 'cust']) AS "column", round(unnest([
  avg((status IS NULL OR lower(trim(status)) = 'n/a')::INT), avg((price IS NULL)::INT), avg((priority = 'Unknown')::INT), 0.0, avg((cust IS NULL)::INT)]), 9) AS missing_rate FROM n""")
def missing_rates(spark, d):
    return quality.missing_rates(noisy(spark, d).drop("o_orderkey")).withColumn("missing_rate", F.round("missing_rate", 9))


@query("""
WITH s AS (SELECT 'o_orderkey' AS c, count(o_orderkey) AS n, count(DISTINCT o_orderkey) AS d FROM orders UNION ALL SELECT 'o_totalprice', count(o_totalprice), count(DISTINCT o_totalprice) FROM orders
  UNION ALL SELECT 'fixed', count(*), 1 FROM orders UNION ALL SELECT 'blank', 0, 0 UNION ALL SELECT 'rare', count(*) FILTER (WHERE o_orderkey = 1), 1 FROM orders)
SELECT c AS dropped FROM s WHERE n < 10 OR d <= 1""")
def low_value_columns(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("fixed"), F.lit(None).cast("string").alias("blank"), F.when(F.col("o_orderkey") == F.lit(1), 1).alias("rare"))
    return spark.createDataFrame([(c,) for c in sorted(quality.low_value_columns(t, 20))], "dropped string")


@query(f"""WITH {NOISY}, r AS (SELECT *, (status IS NULL OR lower(trim(status)) = 'n/a')::INT + (priority = 'Unknown')::INT + (cust IS NULL)::INT AS lacking FROM n WHERE price IS NOT NULL)
SELECT o_orderkey, status, price, cust FROM r WHERE lacking / 5.0 <= 0.5""")
def prune_rows_columns(spark, d):
    return quality.prune(noisy(spark, d), "price", protected=()).df


@query(f"""WITH {NOISY}, m AS (SELECT unnest(['price', 'status', 'priority', 'cust']) AS "column", unnest([
  avg((price IS NULL)::INT), avg((status IS NULL OR lower(trim(status)) = 'n/a')::INT), avg((priority = 'Unknown')::INT), avg((cust IS NULL)::INT)]) AS missing_rate FROM n)
SELECT "column", round(missing_rate, 9) AS missing_rate, missing_rate <= CASE WHEN "column" = 'price' THEN 0.1 ELSE 0.4 END AS accepted FROM m""")
def fill_rate_gate(spark, d):
    return quality.fill_rates(noisy(spark, d), "price", ["status", "priority", "cust"]).withColumn("missing_rate", F.round("missing_rate", 9))


OUTLIERS = ("l_quantity", "l_extendedprice", "l_discount")


@query("""
WITH v AS (SELECT 'l_quantity' AS "column", l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem),
m AS (SELECT "column", count(x) AS n, median(x) AS median, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY 1)
SELECT m."column", n, round(m.median, 6) AS median, round(q1, 6) AS q1, round(q3, 6) AS q3, round(median(abs(x - m.median)), 6) AS mad
FROM v JOIN m ON v."column" = m."column" GROUP BY ALL""")
def robust_outliers(spark, d):
    s = quality.outlier_stats(table(spark, d, "lineitem"), list(OUTLIERS))
    return s.select("column", "n", *[F.round(c, 6).alias(c) for c in ("median", "q1", "q3", "mad")])


STRETCHED = """w AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN l_quantity * 1000 ELSE l_quantity END AS quantity,
  CASE WHEN l_orderkey % 194 = 0 THEN l_extendedprice * 1000 ELSE l_extendedprice END AS price FROM lineitem)"""


@query(f"""WITH {STRETCHED}, s AS (SELECT median(quantity) AS mq, quantile_cont(quantity, 0.25) AS q1q, quantile_cont(quantity, 0.75) AS q3q,
  median(price) AS mp, quantile_cont(price, 0.25) AS q1p, quantile_cont(price, 0.75) AS q3p FROM w),
a AS (SELECT median(abs(quantity - mq)) AS aq, median(abs(price - mp)) AS ap FROM w, s),
f AS (SELECT l_orderkey, l_linenumber, (abs(0.6745::DOUBLE * (quantity - mq) / aq) > 8 OR quantity < q1q - 5 * (q3q - q1q) OR quantity > q3q + 5 * (q3q - q1q))::INT
  + (abs(0.6745::DOUBLE * (price - mp) / ap) > 8 OR price < q1p - 5 * (q3p - q1p) OR price > q3p + 5 * (q3p - q1p))::INT AS outliers FROM w, s, a)
SELECT * FROM f WHERE outliers < 2""")
def outlier_row_rejection(spark, d):
    t = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * F.when(F.col("l_orderkey") % 97 == 0, 1000).otherwise(1)).alias("quantity"),
        (F.col("l_extendedprice") * F.when(F.col("l_orderkey") % 194 == 0, 1000).otherwise(1)).alias("price"),
    )
    return quality.drop_outliers(t, ["quantity", "price"]).select("l_orderkey", "l_linenumber", "outliers")


#: Names and the limits that they set: words can't be negative, percentages and rates have limits besides, growth wider ones or none.
LIMITED = {
    "account_income": "v < 0", "share_pct": "v < 0 OR v > 100", "win_percentage": "v < 0 OR v > 100", "income_share": "v < 0 OR v > 100", "score_pct": "v < 0 OR v > 100",
    "change_pct": "v < -100 OR v > 500", "price_change_pct": "v < 0 OR v > 500", "growth_rate": "FALSE", "tax_rate": "v < 0 OR v > 100", "founding_year": "v < 1800 OR v > 2100", "market_cap": "FALSE",
}


@query(" UNION ALL ".join(f"""SELECT c_custkey AS row_index, 'bounds' AS category, '{name}' AS field, 'error' AS severity
  FROM (SELECT c_custkey, c_acctbal / {k + 1} AS v FROM customer) WHERE {bad}""" for k, (name, bad) in enumerate(LIMITED.items())))
def hard_bounds(spark, d):
    t = table(spark, d, "customer").select("c_custkey", *[(F.col("c_acctbal") / (k + 1)).alias(name) for k, name in enumerate(LIMITED)])
    return quality.issues(t, "c_custkey").select("row_index", "category", "field", "severity")


@query("""
SELECT l_orderkey * 10 + l_linenumber AS row_index, 'amount_min' AS field FROM lineitem WHERE l_quantity * 1000 < l_extendedprice""")
def bound_pairs(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_extendedprice").alias("amount_min"), (F.col("l_quantity") * 1000).alias("amount_max"))
    return quality.issues(t, "k").filter("category = 'range'").select("row_index", "field")


@query("""
WITH g AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS domains, min(l_extendedprice) AS low, max(l_extendedprice) AS high, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS middle FROM lineitem GROUP BY 1)
SELECT l_partkey, domains, low, high, middle, (high - low) / greatest(abs(middle), 1.0) > 0.35 AS conflict FROM g WHERE domains >= 2""")
def source_conflict_numeric(spark, d):
    out = quality.numeric_conflicts(table(spark, d, "lineitem"), "l_partkey", "l_extendedprice", "l_suppkey")
    return out.select("l_partkey", "domains", "low", "high", "middle", "conflict")


@query("""
WITH g AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS domains, count(DISTINCT lower(l_returnflag)) AS versions FROM lineitem GROUP BY 1)
SELECT *, versions > 1 AS conflict FROM g WHERE domains >= 2""")
def source_conflict_text(spark, d):
    return quality.text_conflicts(table(spark, d, "lineitem"), "l_partkey", "l_returnflag", "l_suppkey")


@query("""
SELECT count(*)::INT AS input_rows, count(*) FILTER (WHERE c_acctbal >= 0)::INT AS kept_rows, count(*) FILTER (WHERE c_acctbal < 0) AS errors, 0::BIGINT AS warnings,
  count(*) FILTER (WHERE c_acctbal >= 0) > 0 AND NOT (count(*) >= 10 AND count(*) FILTER (WHERE c_acctbal < 0) / count(*) > 0.35) AS passed FROM customer""")
def validation_summary(spark, d):
    t = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("income"))
    found = quality.issues(t, "c_custkey")
    kept = t.join(found.select(F.col("row_index").alias("c_custkey")).distinct(), "c_custkey", "left_anti")
    return quality.summary(found, t.count(), kept.count())


@query("""
WITH s AS (SELECT count(*) AS n, count(c_custkey) AS n1, count(DISTINCT c_custkey) AS d1, count(nullif(c_mktsegment, 'BUILDING')) AS n2, count(DISTINCT nullif(c_mktsegment, 'BUILDING')) AS d2,
  count(c_nationkey) AS n3, count(DISTINCT c_nationkey) AS d3 FROM customer)
SELECT unnest(['c_custkey', 'segment', 'c_nationkey']) AS "column", unnest(['bigint', 'string', 'int']) AS dtype, n AS rows, unnest([n1, n2, n3]) AS non_null,
  unnest([round(1 - n1 / n, 4), round(1 - n2 / n, 4), round(1 - n3 / n, 4)]) AS null_fraction, unnest([d1, d2, d3]) AS "distinct" FROM s""")
def profile_columns(spark, d):
    return profiling.profile(table(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), "c_nationkey"))


@query("""
WITH s AS (SELECT count(*) AS n, count(DISTINCT o_totalprice) AS d1, count(DISTINCT o_orderstatus) AS d2, count(DISTINCT o_custkey) AS d3 FROM orders),
u AS (SELECT unnest(['total_price', 'status', 'cust']) AS "column", unnest([58, 0, 8]) AS score, n AS non_null, unnest([10, 11, 11]) AS compactness, unnest([d1, d2, d3]) AS "distinct" FROM s)
SELECT *, row_number() OVER (ORDER BY score DESC, non_null DESC, compactness DESC, "distinct" DESC)::INT AS rank FROM u""")
def target_ranking(spark, d):
    t = table(spark, d, "orders").select(F.col("o_totalprice").alias("total_price"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"))
    return profiling.target_ranking(t, "Predict the price of an order")


@query("""
WITH c AS (SELECT unnest(['scaled', 'l_quantity', 'l_discount', 'fixed']) AS "column",
  unnest([1.0::DOUBLE, corr(l_quantity, l_extendedprice), corr(l_discount, l_extendedprice), NULL]) AS correlation FROM lineitem)
SELECT "column", round(correlation, 6) AS correlation, coalesce(abs(correlation) >= 0.995, FALSE) AS leaks FROM c""")
def leakage_correlation(spark, d):
    t = table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_extendedprice") * 2 + 1).alias("scaled"), "l_quantity", "l_discount", F.lit(1.5).cast("double").alias("fixed"))
    return profiling.leakage(t, "l_extendedprice").withColumn("correlation", F.round("correlation", 6))


@query("""
SELECT s_suppkey::DOUBLE AS s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Unknown' ELSE s_name END AS name,
  coalesce(CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END, (SELECT median(s_acctbal) FROM supplier WHERE s_suppkey % 4 <> 0)) AS balance FROM supplier""")
def impute_median_unknown(spark, d):
    k = F.col("s_suppkey")
    return profiling.impute(table(spark, d, "supplier").select("s_suppkey", F.when(k % 6 == 0, "").when(k % 3 != 0, F.col("s_name")).alias("name"), F.when(k % 4 != 0, F.col("s_acctbal")).alias("balance")))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("SELECT c_custkey, " + ", ".join(f"c_mktsegment = '{s}' AS seg_{s}" for s in SEGMENTS) + " FROM customer")
def one_hot_segments(spark, d):
    return profiling.one_hot(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg")), "seg")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ' Not Disclosed' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 3 <> 0""")
def target_present_filter(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, " Not Disclosed").otherwise(F.col("o_orderstatus")).alias("status"))
    return records.with_target(t, "status")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE o_orderpriority END AS priority FROM orders)
SELECT o_custkey, min(o_orderkey) AS o_orderkey,
  coalesce(arg_min(price, o_orderkey) FILTER (WHERE price <> 0), min(price)) AS price,
  arg_min(priority, o_orderkey) FILTER (WHERE priority <> 'unknown') AS priority FROM r GROUP BY 1""")
def record_merge_prefer(spark, d):
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(k % 3 == 0, 0.0).when(k % 5 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 4 == 0, "unknown").otherwise(F.col("o_orderpriority")).alias("priority"))
    # a leading zero yields to a later number, and a leading number stays: both are the first non-zero one
    return records.merge_records(t, "o_custkey", "o_orderkey")


@query(f"""WITH {NOISY} SELECT count(*) AS records,
  round(avg(1 + (status IS NOT NULL)::INT + (price IS NOT NULL)::INT + 1 + 1 + (cust IS NOT NULL)::INT) / 6, 9) AS filled,
  round((count(cust) - count(DISTINCT cust)) / count(cust), 9) AS repeated,
  avg(1 + (status IS NOT NULL)::INT + (price IS NOT NULL)::INT + 1 + 1 + (cust IS NOT NULL)::INT) / 6 >= 0.6 AND (count(cust) - count(DISTINCT cust)) / count(cust) <= 0.1 AS clean FROM n""")
def structural_cleanliness(spark, d):
    out = records.cleanliness(noisy(spark, d), "cust")
    return out.withColumns({c: F.round(c, 9) for c in ("filled", "repeated")})


@query(f"""WITH {NOISY} SELECT count(*) AS records, round(avg(1 + (status IS NOT NULL)::INT + (price IS NOT NULL)::INT + 1 + 1 + (cust IS NOT NULL)::INT), 9) AS coverage,
  count(*) >= 100 AND avg(1 + (status IS NOT NULL)::INT + (price IS NOT NULL)::INT + 1 + 1 + (cust IS NOT NULL)::INT) >= 2 AS satisfied FROM n""")
def schema_coverage(spark, d):
    return records.schema_coverage(noisy(spark, d), 100).withColumn("coverage", F.round("coverage", 9))


@query("""
SELECT unnest(['number', 'mixed', 'text']) AS "column", round(unnest([1.0, avg((p_partkey % 4 <> 0)::INT), 0.0]), 9) AS share, unnest([TRUE, avg((p_partkey % 4 <> 0)::INT) >= 0.7, FALSE]) AS "numeric" FROM part""")
def numeric_inference(spark, d):
    t = table(spark, d, "part").select(F.col("p_retailprice").cast("string").alias("number"), F.when(F.col("p_partkey") % 4 == 0, "n.k.").otherwise(F.col("p_size").cast("string")).alias("mixed"), F.col("p_brand").alias("text"))
    return quality.numeric_share(t, t.columns, {c: strict_double(F.col(c)) for c in t.columns}).withColumn("share", F.round("share", 9))
