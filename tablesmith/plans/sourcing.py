"""Queries on text functions, source ranking, pages, HTML tables, JSON state and goals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.functions import text
from tablesmith.operators import ranking, records
from tablesmith.plans.base import table
from tablesmith.plans.merging import query
from tablesmith.sources import html, pages, state


@query("""
SELECT p_partkey, unnest(['us', 'eu']) AS locale, p_retailprice AS price FROM part""")
def clean_price_locale(spark, d):
    p = table(spark, d, "part")
    us = F.format_number("p_retailprice", 2)
    eu = F.concat(F.translate(us, ",.", ".,"), F.lit(" €"))
    rows = p.select("p_partkey", F.explode(F.array(F.struct(F.lit("us").alias("locale"), F.concat(F.lit("Price: $"), us).alias("shown")), F.struct(F.lit("eu").alias("locale"), eu.alias("shown")))).alias("x"))
    return rows.select("p_partkey", "x.locale", text.clean_price(F.col("x.shown")).alias("price"))


@query("""
SELECT o_orderkey, round(o_totalprice / 1000, 1) * 1000 AS thousands, round(o_totalprice / 1000, 1) * 1e6 AS millions, round(o_totalprice / 1000, 1) * 1e9 AS money, o_orderkey::DOUBLE AS plain FROM orders""")
def numeric_suffix_scale(spark, d):
    o = table(spark, d, "orders")
    shown = F.round(F.col("o_totalprice") / 1000, 1).cast("decimal(20,1)").cast("string")
    return o.select(
        "o_orderkey", text.parse_numeric(F.concat(F.lit(" $"), shown, F.lit("K "))).alias("thousands"), text.numeric_like(F.concat(F.lit("Team $"), shown, F.lit("m"))).alias("millions"),
        text.parse_money(F.concat(F.lit("Loan fee: €"), shown, F.lit("bn"))).alias("money"), text.parse_numeric(F.concat(F.format_number("o_orderkey", 0), F.lit(" kg"))).alias("plain"),
    )


HOST = "trim(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '.')"
ROOT = f"""CASE WHEN len(split({HOST}, '.')) <= 2 THEN {HOST}
  WHEN split({HOST}, '.')[-2] IN ('co', 'com', 'org', 'gov', 'ac') THEN array_to_string(split({HOST}, '.')[-3:], '.')
  ELSE array_to_string(split({HOST}, '.')[-2:], '.') END"""


@query(f"SELECT {ROOT} AS domain, count(*) AS pages FROM pages GROUP BY 1")
def root_domain_counts(spark, d):
    return table(spark, d, "pages").groupBy(text.root_domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@query("SELECT DISTINCT url FROM pages")
def url_normalize_distinct(spark, d):
    p = table(spark, d, "pages")
    loud = F.concat(F.lit(" "), F.upper(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)), F.regexp_extract("url", "^[a-z]+://[^/?#]*(.*)$", 1))
    return p.select("url").unionByName(p.select(loud.alias("url"))).select(text.normalize_url(F.col("url")).alias("url")).distinct()


FULL = "lower(regexp_extract(url, '^[a-z]+://([^?#]*)', 1))"
GOAL = "Predict which example blog lists cheap news"


def _points(tokens: dict) -> str:
    return " + ".join(f"CASE WHEN contains({FULL}, '{t}') THEN {p} ELSE 0 END" for t, p in tokens.items())


SCORED = f"""s AS (SELECT DISTINCT url, {_points(ranking.SIGNALS)} + {_points(ranking.BAD_SIGNALS)} + {_points(dict.fromkeys(sorted(set(GOAL.lower().split())), 1))}
  - CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN 3 ELSE 0 END AS score FROM pages)"""


@query(f"WITH {SCORED} SELECT url, score FROM s ORDER BY score DESC, url LIMIT 12")
def source_rank_topk(spark, d):
    return ranking.top_sources(ranking.rank(table(spark, d, "pages"), GOAL), 12)


@query(f"""WITH {SCORED}, r AS (SELECT url, score, {ROOT} AS domain FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, url)::INT AS place FROM r) SELECT * FROM k WHERE place <= 2""")
def per_domain_cap(spark, d):
    return ranking.cap_per_domain(ranking.rank(table(spark, d, "pages"), GOAL), ranking.domain_cap(100)).select("url", "score", "domain", "place")


REASONS = ("success", "http_403", "network_error", "empty_content", "anti_bot")


@query("""
WITH e AS (SELECT 'site' || (user_id % 40) AS domain, ['success', 'http_403', 'network_error', 'empty_content', 'anti_bot'][(event_id % 5 + 1)::INT] AS reason, value FROM events),
c AS (SELECT domain, count(*) AS attempts, count_if(reason = 'success') AS ok, count_if(reason = 'success' AND value < 10) AS empty,
  count_if(reason IN ('http_403', 'anti_bot')) AS block, count_if(reason IN ('http_403', 'anti_bot', 'network_error')) AS hard, count_if(reason = 'empty_content') AS soft FROM e GROUP BY 1)
SELECT domain, attempts, hard AS hard_failures, block AS anti_bot_failures, soft AS soft_failures, empty AS empty_results, hard * 6 + block * 8 + soft * 2 + least(empty, 3) AS penalty,
  block >= 2 OR hard >= 3 AS cooldown FROM c""")
def domain_health_penalty(spark, d):
    e = table(spark, d, "events")
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), (F.col("event_id") % 5 + 1).cast("int"))
    log = e.select(F.concat(F.lit("site"), F.col("user_id") % 40).alias("domain"), reason.alias("reason"), F.when(F.col("value") < 10, " ").otherwise("x").alias("text")).withColumn("ok", F.col("reason") == "success")
    return ranking.health_of(log).select("domain", "attempts", "hard_failures", "anti_bot_failures", "soft_failures", "empty_results", "penalty", "cooldown")


@query("""
WITH f AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 403 WHEN page_id % 7 = 1 THEN 429 WHEN page_id % 7 = 2 THEN 500 ELSE 200 END AS status,
  CASE WHEN page_id % 7 = 3 THEN 'Just A Moment...' WHEN page_id % 7 = 4 THEN '  ' ELSE html END AS body FROM pages)
SELECT page_id, CASE WHEN status = 403 THEN 'http_403' WHEN status = 429 THEN 'http_429' WHEN contains(lower(body), 'just a moment') OR contains(lower(body), 'access denied') THEN 'anti_bot'
  WHEN status >= 400 THEN 'http_error' WHEN trim(body) = '' THEN 'empty_content' ELSE 'success' END AS reason FROM f""")
def fetch_classify(spark, d):
    m = F.col("page_id") % 7
    p = table(spark, d, "pages").select("page_id", F.when(m == 0, 403).when(m == 1, 429).when(m == 2, 500).otherwise(200).alias("status"), F.when(m == 3, "Just A Moment...").when(m == 4, "  ").otherwise(F.col("html")).alias("body"))
    return p.select("page_id", pages.fetch_reason(F.col("status"), F.col("body")).alias("reason"))


@query("""
WITH e AS (SELECT user_id, event_id, (value < 50)::INT AS bad FROM events),
i AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e),
r AS (SELECT user_id, island, sum(bad)::BIGINT AS run FROM i GROUP BY 1, 2)
SELECT user_id, max(run) AS longest, max(run) >= 3 AS abort FROM r GROUP BY 1""")
def fail_fast_runs(spark, d):
    return ranking.rejection_runs(table(spark, d, "events"), "user_id", "event_id", F.col("value") < 50)


#: SQL for a page's text: markup off, the entities that the pages hold read (`&amp` last), white space collapsed.
BARE = r"""regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script>', ' ', 'gis'), '<style\b[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', chr(10), 'g')"""
READ = f"""regexp_replace(replace(replace(replace({BARE}, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g')"""
KEPT = " AND ".join(["length(x) > 2", *(f"NOT contains(lower(x), '{p}')" for p in pages.DOCUMENT_CHROME)])


@query(f"""
WITH t AS (SELECT page_id, list_filter(list_transform(string_split({READ}, chr(10)), lambda x: trim(regexp_replace(x, '[\\s\\x{{A0}}]+', ' ', 'g'))), lambda x: {KEPT}) AS own FROM pages),
l AS (SELECT page_id, own, list_transform(own, lambda x: lower(x)) AS low FROM t),
j AS (SELECT page_id, array_to_string(list_filter(own, lambda x, i: list_position(low, lower(x)) = i), chr(10)) AS text FROM l)
SELECT page_id, CASE WHEN length(text) > 24000 THEN text[:12000] || chr(10) || '...[truncated]...' || chr(10) || text[-12000:] ELSE text END AS text FROM j""")
def document_text_prepare(spark, d):
    return pages.document_text(table(spark, d, "pages").select("page_id", "html"), "html").select("page_id", "text")


CHROME_SQL = " OR ".join(f"contains(lower(text), '{p}')" for p in records.CHROME)


@query(f"SELECT doc_id FROM documents WHERE NOT ({CHROME_SQL})")
def chrome_filter(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.filter(~records.looks_like_chrome(docs.select("text"))).select("doc_id")


@query("""
SELECT c_nationkey % 5 AS page, 'Customer ' || c_custkey AS name FROM customer WHERE c_custkey % 3 <> 0""")
def line_candidates(spark, d):
    c = table(spark, d, "customer")
    line = F.concat(F.lit('link "Customer '), "c_custkey", F.lit('" [ref=e'), "c_custkey", F.lit("]"))
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('button "Menu '), "c_custkey", F.lit('" [ref=e1]'))).otherwise(line)
    snaps = c.groupBy((F.col("c_nationkey") % 5).alias("page")).agg(F.array_join(F.collect_list(line), "\n").alias("snapshot"))
    return pages.directory_entries(snaps, "snapshot", "page").select("page", "name")


def _html(rows, key, names, cells, head="thead"):
    """One page per key: a table with a header row and a row per record, in the order of the first cell."""
    tr = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>")) for c in cells], F.lit("</tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(cells[0].alias("k"), tr.alias("tr")))), lambda x: x["tr"]), "\n")
    top = "<tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"
    top = f"<thead>{top}</thead>" if head == "thead" else top
    return rows.groupBy(key).agg(F.concat(F.lit(f"<html><body><table>{top}\n"), body, F.lit("</table></body></html>")).alias("html"))


@query("""
SELECT 'https://n.example/' || r_name AS source_url, n_nationkey::BIGINT AS nation_key, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def html_table_roundtrip(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    made = _html(n.withColumn("url", F.concat(F.lit("https://n.example/"), "r_name")), "url", ["Nation key", "Name"], [F.col("n_nationkey"), F.col("n_name")])
    return html.schema_rows(made, {"nation_key": "bigint", "name": "string"})


@query("SELECT s_suppkey::VARCHAR AS suppkey, s_name AS name FROM supplier")
def html_header_repeat(spark, d):
    s = table(spark, d, "supplier").select(F.lit("https://s.example").alias("url"), F.col("s_suppkey").cast("string").alias("k"), F.col("s_name").alias("v"))
    extra = s.filter(F.col("k") == "5").select("url", F.explode(F.array(F.struct(F.lit("Suppkey").alias("k"), F.lit("Name").alias("v")), F.struct(F.lit("").alias("k"), F.lit(" ").alias("v")))).alias("x")).select("url", "x.*")
    made = _html(s.unionByName(extra), "url", ["Suppkey", "Name"], [F.col("k"), F.col("v")], head="th")
    return html.table_frame(html.table_rows(made), "https://s.example", 0).select("suppkey", "name")


@query("SELECT p_partkey AS partkey, p_brand AS brand FROM part")
def paginated_concat(spark, d):
    parts = table(spark, d, "part")
    made = _html(parts.withColumn("n", F.col("p_partkey") % 4 + 1), "n", ["Partkey", "Brand"], [F.col("p_partkey"), F.col("p_brand")])
    first = spark.createDataFrame([("https://p.example", '<a href="/x/p2">2</a> <a href="/x/p4">last</a>')], "url string, html string")
    numbers = first.select(F.explode(html.page_numbers(F.col("html"))).alias("n"))
    all_pages = made.join(numbers, "n").select(F.concat(F.lit("https://p.example/p"), "n").alias("url"), "html")
    return html.schema_rows(all_pages, {"partkey": "bigint", "brand": "string"}).select("partkey", "brand")


@query("""
SELECT n_name AS club, count(*) FILTER (WHERE s_suppkey % 2 = 0) AS incoming, count(*) FILTER (WHERE s_suppkey % 2 = 1) AS outgoing,
  coalesce(sum(s_suppkey * 1000.0::DOUBLE) FILTER (WHERE s_suppkey % 2 = 0), 0) AS spend, coalesce(sum(s_suppkey * 1000.0::DOUBLE) FILTER (WHERE s_suppkey % 2 = 1), 0) AS income
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def paired_table_summary(spark, d):
    s = table(spark, d, "supplier")
    clubs = s.select("s_nationkey").distinct()
    sides = clubs.select("s_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    tr = F.concat(F.lit("<tr><td>"), "s_name", F.lit("</td><td>€"), "s_suppkey", F.lit("k</td></tr>"))
    bodies = s.groupBy("s_nationkey", (F.col("s_suppkey") % 2).cast("int").alias("side")).agg(F.array_join(F.collect_list(tr), "").alias("body"))
    bodies = sides.join(bodies, ["s_nationkey", "side"], "left")
    one = F.concat(F.lit("<table><tr><th>Player</th><th>Fee</th></tr>"), F.coalesce("body", F.lit("")), F.lit("</table>"))
    made = bodies.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("side", one.alias("t")))), lambda x: x["t"]), "").alias("t"))
    made = made.select(F.col("s_nationkey").cast("string").alias("url"), F.concat(F.lit("<table><tr><td>overview</td></tr></table>"), "t").alias("html"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("url"), F.lit(0).alias("club_idx"), F.col("n_name").alias("club"))
    return html.paired_summary(html.html_cells(made), names)


@query("SELECT s_suppkey, s_name AS name, s_acctbal AS balance FROM supplier")
def json_state_roundtrip(spark, d):
    s = table(spark, d, "supplier")
    body = F.to_json(F.struct(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")).alias("item")))
    lenient = F.concat(F.lit("{item: {id: "), "s_suppkey", F.lit(", name: '"), "s_name", F.lit("', balance: "), F.col("s_acctbal").cast("string"), F.lit(", gone: undefined,},}"))
    page = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('<script type="application/json" id="__NEXT_DATA__">'), body, F.lit("</script>")))
    page = page.otherwise(F.concat(F.lit("<script>window.__INITIAL_STATE__ = "), lenient, F.lit("; more();</script>")))
    got = state.page_states(s, page).withColumn("json", F.col("states")[0]["state"])
    return got.select("s_suppkey", F.get_json_object("json", "$.item.name").alias("name"), F.get_json_object("json", "$.item.balance").cast("double").alias("balance"))


@query("""
SELECT event_id, unnest(['k', 'in.list[0]', 'in.list[1]']) AS path, unnest([props->>'$.k', event_type, user_id::VARCHAR]) AS value FROM events""")
def json_flatten(spark, d):
    e = table(spark, d, "events")
    nested = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "in": {"list": ["'), "event_type", F.lit('", '), "user_id", F.lit("]}}"))
    return state.json_paths(e.select("event_id", nested.alias("j")), "j", "event_id")


@query("""
SELECT c_nationkey, 'data.rows' AS path, count(*)::INT AS length, ['id', 'name'] AS keys FROM customer GROUP BY 1 HAVING count(*) >= 2""")
def json_collections(spark, d):
    c = table(spark, d, "customer")
    rows = c.groupBy("c_nationkey").agg(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).alias("rows"))
    return state.json_collections(rows.select("c_nationkey", F.to_json(F.struct(F.struct("rows").alias("data"))).alias("j")), "j", "c_nationkey")
