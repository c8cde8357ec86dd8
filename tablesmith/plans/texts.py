"""Queries on text functions: texts are composed from the tables, and have to be read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.functions import text
from tablesmith.operators import columns, matching, records
from tablesmith.plans import seams
from tablesmith.plans.base import table
from tablesmith.plans.merging import query
from tablesmith.sources import pages, state


@query("""
SELECT p_partkey, (p_size + 1)::BIGINT AS ram_gb, CASE WHEN p_partkey % 2 = 0 THEN p_size * 1024 ELSE p_size END::BIGINT AS storage_gb,
  CASE p_partkey % 3 WHEN 0 THEN 'RTX ' || (4000 + p_size) WHEN 1 THEN 'AMD Radeon RX ' || p_size END AS gpu_model FROM part""")
def hardware_specs(spark, d):
    k = F.col("p_partkey")
    unit = F.when(k % 2 == 0, "TB HDD").otherwise("gb ssd")
    gpu = F.when(k % 3 == 0, F.concat(F.lit("RTX "), F.col("p_size") + 4000)).when(k % 3 == 1, F.concat(F.lit("AMD Radeon RX "), "p_size")).otherwise("none")
    made = F.concat(F.col("p_size") + 1, F.lit("GB RAM DDR5, "), "p_size", unit, F.lit(", "), gpu, F.lit(", Windows"))
    return table(spark, d, "part").select("p_partkey", text.extract_specs(made).alias("s")).select("p_partkey", "s.*")


@query("""
SELECT p_partkey, 'Book ' || p_size AS name, CASE p_partkey % 3 WHEN 0 THEN 'Intel Core Ultra 7-' || p_size WHEN 1 THEN 'Apple M' || (p_size % 9) || ' Pro' END AS cpu_model,
  CASE WHEN p_partkey % 4 <> 0 THEN 'NVIDIA GeForce RTX ' || (4000 + p_size) END AS gpu_model, (p_size * 2)::DOUBLE AS ram_gb,
  CASE WHEN p_size BETWEEN 10 AND 20 THEN p_size::DOUBLE END AS display_size_inches FROM part WHERE p_size >= 10""")
def laptop_names(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    cpu = F.when(k % 3 == 0, F.concat(F.lit("Intel Core Ultra 7-"), n)).when(k % 3 == 1, F.concat(F.lit("Apple M"), n % 9, F.lit(" Pro"))).otherwise("unknown chip")
    gpu = F.when(k % 4 != 0, F.concat(F.lit("NVIDIA GeForce RTX "), n + 4000)).otherwise("on board")
    made = F.concat_ws(" | ", F.concat(F.lit(" Book  "), n), cpu, F.concat(gpu, F.lit(" ,")), F.concat(n * 2, F.lit(" GB RAM")))
    return table(spark, d, "part").filter("p_size >= 10").select("p_partkey", text.laptop_fields(made).alias("s")).select("p_partkey", "s.*")


@query("""
WITH t AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'P' || c_custkey WHEN 1 THEN '$' || round(c_acctbal, 1) WHEN 2 THEN c_custkey || '.' WHEN 3 THEN c_name ELSE '1,' || c_custkey || '%' END AS v FROM customer)
SELECT c_custkey, c_custkey % 5 IN (0, 4) OR (c_custkey % 5 = 1) AS numeric_like FROM t""")
def numeric_like_flags(spark, d):
    k, c = F.col("c_custkey"), table(spark, d, "customer")
    shown = F.round("c_acctbal", 1).cast("decimal(20,1)").cast("string")
    v = F.when(k % 5 == 0, F.concat(F.lit("P"), k)).when(k % 5 == 1, F.concat(F.lit("$"), shown)).when(k % 5 == 2, F.concat(k, F.lit("."))).when(k % 5 == 3, F.col("c_name")).otherwise(F.concat(F.lit("1,"), k, F.lit("%")))
    return c.select("c_custkey", text.is_numeric_like(v).alias("numeric_like"))


@query("""
SELECT p_partkey, round_even(p_size / 2.0, 0)::BIGINT AS pieces, p_size / 2.0::DOUBLE AS price, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE END AS ram_gb FROM part""")
def coerced_numbers(spark, d):
    p = table(spark, d, "part")
    half = F.format_number(F.col("p_size") / 2, 1)
    ram = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("about "), "p_size", F.lit(" GB Memory"))).otherwise("none")
    return p.select("p_partkey", text.coerce_number(half, "pieces", True).alias("pieces"), text.coerce_number(F.concat(F.lit("€ "), half), "price", False).alias("price"), text.coerce_number(ram, "ram_gb", False).alias("ram_gb"))


@query("""
SELECT p_partkey, p_name AS name, p_size::DOUBLE AS price_usd, CASE WHEN p_partkey % 2 = 0 THEN 64.0::DOUBLE ELSE p_size::DOUBLE END AS ram_gb, p_size::DOUBLE AS storage_gb FROM part""")
def payload_clean(spark, d):
    k = F.col("p_partkey")
    t = table(spark, d, "part").select(
        k, F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("name"), F.concat(F.lit(" $"), F.col("p_size").cast("string"), F.lit(".00")).alias("price_usd"),
        F.when(k % 2 == 0, "64").otherwise(" Unknown ").alias("ram_gb"), F.concat("p_size", F.lit(" GB RAM, "), "p_size", F.lit(" GB SSD")).alias("specs"),
    )
    out = records.clean_payload(t, {"name": "string", "price_usd": "number", "ram_gb": "number", "storage_gb": "number"})
    return out.select("p_partkey", "name", "price_usd", "ram_gb", "storage_gb")


@query("""
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 3 THEN 'North Bulldogs' ELSE 'North ' || n_name END AS school, CASE WHEN s_suppkey % 2 = 0 THEN 'basketball' END AS sport,
  CASE WHEN s_suppkey % 3 = 0 THEN 'list_entry' ELSE 'directory_entry' END AS category FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def school_names(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    tail = F.when(k % 4 == 0, " Tar Heels").when(k % 4 == 1, " TIGERS").otherwise("")
    team = F.when(k % 4 == 3, "North Bulldogs").otherwise(F.concat(F.lit("North "), "n_name", tail))
    url = F.concat(F.when(k % 3 == 0, "https://en.wikipedia.org/").otherwise("https://x.example/"), F.when(k % 2 == 0, "Basketball").otherwise("chess"))
    return s.select("s_suppkey", text.school_name(team).alias("school"), text.sport_of(url).alias("sport"), text.category_of(url).alias("category"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (2000 + o_orderkey % 100)::INT WHEN o_orderkey % 3 = 1 THEN 2025 ELSE 2026 END AS season FROM orders""")
def season_years(spark, d):
    k = F.col("o_orderkey")
    goal = F.when(k % 3 == 0, F.concat(F.lit("Stats from 1999 to "), k % 100 + 2000)).when(k % 3 == 1, F.lit("College Basketball teams")).otherwise("Pay of players in 123456")
    return table(spark, d, "orders").select("o_orderkey", text.season_year(goal).alias("season"))


@query("""
SELECT page_id, trim(regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/?#]*(?:/[^?#]*)?/([^/?#]+)/?(?:[?#]|$)', 1)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM pages""")
def metric_slugs(spark, d):
    return table(spark, d, "pages").select("page_id", text.metric_slug(F.col("url")).alias("slug"))


@query("""
SELECT doc_id, CASE WHEN length(text) > 100 THEN text[:50] || ' ... ' || text[-50:] ELSE text END AS text FROM documents""")
def middle_truncation(spark, d):
    return table(spark, d, "documents").select("doc_id", text.middle_truncate(F.col("text"), 100, " ... ").alias("text"))


LINES = "list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\f]'), lambda x: regexp_replace(x, '^[\\s\\x0B\\x{A0}\\x{85}]+|[\\s\\x0B\\x{A0}\\x{85}]+$', '', 'g')), lambda x: x <> '')"


@query(f"SELECT doc_id, array_to_string({LINES}[:25], chr(10)) AS head, length(array_to_string({LINES}, chr(10)))::VARCHAR AS size FROM documents")
def snapshot_signatures(spark, d):
    s = table(spark, d, "documents").select("doc_id", pages.signature(F.col("text")).alias("s"))
    return s.select("doc_id", "s.head", F.substring_index("s.material", ":", 1).alias("size"))


@query("""
SELECT event_id, CASE WHEN length(props) > 8 THEN '{"_truncated":true,"_preview":"' || replace(props[:8], '"', '\\"') || '"}' ELSE props END AS kept, event_id % 3 = 0 AS is_json FROM events""")
def json_blobs(spark, d):
    e = table(spark, d, "events")
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("  "), "props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("x"), "props")).otherwise(F.substring("props", 1, 4))
    return e.select("event_id", state.truncated_json(F.col("props"), 8).alias("kept"), state.raw_json(body).isNotNull().alias("is_json"))


@query("""
SELECT n_nationkey, n_name AS first, n_regionkey AS number, 2 AS strings FROM nation""")
def model_answers(spark, d):
    """Answers with talk around their JSON: the records, and lists of strings."""
    rows = []
    for r in table(spark, d, "nation").collect():
        fence = f'Sure!\n```json\n{{"note": 1, "items": [{{"name": "{r["n_name"]}", "k": {r["n_regionkey"]}}}, {{}}]}}\n```'
        bare = f'[{{"name": "{r["n_name"]}", "k": {r["n_regionkey"]}}}, {{}}] as asked {{}}'
        import json

        one = seams.records_of(json.loads(seams.json_part(fence if r["n_nationkey"] % 2 else bare)))[0]
        rows.append((r["n_nationkey"], one["name"], one["k"], len(seams.string_list('drop these: ["a", 1, "b"].'))))
    return spark.createDataFrame(rows, "n_nationkey int, first string, number int, strings int")


@query("""
SELECT page_id, url, CASE WHEN page_id % 700 BETWEEN 100 AND 599 THEN (page_id % 700)::INT END AS status, html[:100] AS body, length(html) > 100 AS truncated FROM pages""")
def artifacts(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", pages.artifact((F.col("page_id") % 700).cast("int"), F.col("url"), F.col("html"), 100).alias("a")).select("page_id", "a.*")


FAILED = """f AS (SELECT event_id, 'https://x.example/' || user_id AS url, event_id % 2 = 0 AS ok, [403, 429, 500, NULL, NULL][(event_id % 5 + 1)::INT] AS status, event_id % 10 = 9 AS browser FROM events),
r AS (SELECT *, CASE WHEN status = 403 THEN 'http_403' WHEN status = 429 THEN 'http_429' WHEN status IS NOT NULL THEN 'http_error' WHEN browser THEN 'browser_error' ELSE 'network_error' END AS reason FROM f)"""


def failed(spark, d):
    k = F.col("event_id")
    status = F.when(k % 5 == 0, 403).when(k % 5 == 1, 429).when(k % 5 == 2, 500)
    e = table(spark, d, "events").select(k, F.concat(F.lit("https://x.example/"), "user_id").alias("url"), (k % 2 == 0).alias("ok"), pages.failure_reason(status, k % 10 == 9).alias("reason"), (k % 3 == 0).alias("written"))
    return e


@query(f"WITH {FAILED} SELECT event_id, reason FROM r")
def failure_reasons(spark, d):
    return failed(spark, d).select("event_id", "reason")


@query(f"""WITH {FAILED}, c AS (SELECT reason, count(*) AS n FROM r WHERE NOT ok GROUP BY 1)
SELECT count(url) AS input_urls, count(DISTINCT url) AS unique_urls, count(url) - count(DISTINCT url) AS deduped_urls, count_if(ok)::BIGINT AS handled_urls, count_if(NOT ok)::BIGINT AS failed_urls,
  count_if(event_id % 3 = 0)::BIGINT AS artifacts_written, (SELECT string_agg(reason || '=' || n, ',' ORDER BY reason) FROM c) AS failed_by_reason FROM r""")
def fetch_batch_stats(spark, d):
    out = pages.batch_stats(failed(spark, d))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("failed_by_reason")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return out.withColumn("failed_by_reason", shown)


@query("""
SELECT s_suppkey, 'https://stats.nba.com/stats/' || CASE WHEN s_suppkey % 2 = 0 THEN 'leaguedashplayerstats' ELSE 'leaguedashteamstats' END AS endpoint,
  CASE s_suppkey % 3 WHEN 0 THEN '2019-20' WHEN 1 THEN '2023-24' ELSE '2025-26' END AS season, CASE WHEN s_suppkey % 5 = 0 THEN 'Pre Season' ELSE 'Regular Season' END AS season_type FROM supplier WHERE s_suppkey % 7 <> 0""")
def stats_requests(spark, d):
    k = F.col("s_suppkey")
    host = F.when(k % 7 == 0, "https://x.example/stats/").otherwise("https://www.nba.com/stats/")
    season = F.when(k % 3 == 0, "Season=2019-20").when(k % 3 == 1, "year=2024").otherwise("x=1")
    url = F.concat(host, F.when(k % 2 == 0, "players/x?").otherwise("teams?"), season, F.when(k % 5 == 0, "&SeasonType=Pre+Season").otherwise(""))
    s = table(spark, d, "supplier").select(k, pages.stats_request(url).alias("r"))
    return s.filter("r is not null").select("s_suppkey", "r.*")


@query("""
SELECT c_nationkey, 'Base' AS "set", row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INT - 1 AS n, c_custkey::VARCHAR AS id, c_name AS name FROM customer""")
def result_set_rows(spark, d):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: F.array(x["c_custkey"].cast("string"), x["c_name"]))
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(rows.alias("rows"))
    sets = F.array(F.struct(F.lit("Base").alias("name"), F.array(F.lit("ID"), F.lit("NAME")).alias("headers"), F.col("rows").alias("rowSet")))
    got = pages.result_rows(c.select("c_nationkey", F.to_json(F.struct(sets.alias("resultSets"))).alias("j")), "j", "c_nationkey")
    return got.select("c_nationkey", "set", "n", F.col("cells")["ID"].alias("id"), F.col("cells")["NAME"].alias("name"))


@query("SELECT r_regionkey, r_name AS name, 'b=c' AS other FROM region")
def env_files(spark, d):
    lines = F.concat(F.lit("# comment\n\nNAME=old\n NAME = '"), "r_name", F.lit("'\nno sign\nOTHER=\"b=c\"\n"))
    r = table(spark, d, "region").select("r_regionkey", pages.env_values(lines).alias("v"))
    return r.select("r_regionkey", F.col("v")["NAME"].alias("name"), F.col("v")["OTHER"].alias("other"))


@query("""
SELECT DISTINCT p_brand, 'pct' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') || '_per_team' AS name, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS letters,
  len(regexp_extract_all(lower(p_brand || ' of Size'), '[a-z0-9]+'))::INT AS words FROM part""")
def header_names(spark, d):
    brands = [r[0] for r in table(spark, d, "part").select("p_brand").distinct().collect()]
    rows = [(b, columns.normalize(f" %{b}/Tm. "), matching.letters(b), len(matching.words_of(f"{b} of Size"))) for b in brands]
    return spark.createDataFrame(rows, "p_brand string, name string, letters string, words int")
