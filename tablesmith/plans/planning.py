"""Queries on goals, blueprints, and columns and tables against a schema. Goals and headers are composed from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.operators import columns, matching, profiling, quality, ranking
from tablesmith.plans import blueprint, discovery, intent, pipeline, seams
from tablesmith.plans.base import table
from tablesmith.plans.merging import query

STARTS = ("Predict", "Forecast the", "List of", "I want to predict", "A table of", "Build a dataset to predict")
MEASURES = ("salary", "revenue growth", "valuation", "population growth rate", "price and specs", "wins", "gdp", "pay")
KINDS = ("NBA players", "NBA teams", "U.S. states", "startup companies", "laptops", "soccer clubs", "largest banks", "NCAA basketball programs", "Fortune 500 companies", "NCAA basketball team statistics", "top 40 companies", "schools")
ENDS = ("", " in 2019", " this season", " historical", " from 1999 to 2021.")


def _pick(words: tuple[str, ...], k: str) -> str:
    return "([" + ", ".join("'" + w + "'" for w in words) + f"])[({k}) % {len(words)} + 1]"


COMPOSED = f"""g AS (SELECT DISTINCT {_pick(STARTS, 'c_custkey')} || ' ' || {_pick(MEASURES, 'c_custkey // 6')} || ' of ' || {_pick(KINDS, 'c_custkey // 7')} || {_pick(ENDS, 'c_custkey // 11')} AS goal FROM customer),
l AS (SELECT goal, lower(goal) AS low FROM g)"""


def goals(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(k / n) % len(words) + 1).cast("int"))
    made = F.concat(pick(STARTS, 1), F.lit(" "), pick(MEASURES, 6), F.lit(" of "), pick(KINDS, 7), pick(ENDS, 11))
    return table(spark, d, "customer").select(made.alias("goal")).distinct()


def _word(*words: str) -> str:
    return f"regexp_matches(low, '\\b({'|'.join(words)})\\b')"


def _rules(rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {' AND '.join(_word(*g) for g in groups)} THEN '{label}'" for label, groups in rules) + f" ELSE '{otherwise}' END"


DOMAIN, ENTITY = _rules(intent.DOMAIN_RULES, "generic"), _rules(intent.ENTITY_RULES, "entity")
DATED = _word("19\\d{2}|20\\d{2}|21\\d{2}")


@query(f"""WITH {COMPOSED} SELECT goal, {DOMAIN} AS domain_intent, {ENTITY} AS entity_intent,
  CASE WHEN {_word('salary', 'pay')} THEN 'salary' WHEN {_word('valuation')} THEN 'valuation' WHEN {_word('population growth', 'growth rate')} THEN 'population_growth' WHEN {_word('revenue')} THEN 'revenue'
    WHEN {_word('price')} THEN 'price' WHEN {_word('gdp')} THEN 'gdp' WHEN {_word('wins')} THEN 'wins' END AS target_hint,
  CASE WHEN {DATED} OR {_word('historical')} THEN 'historical' WHEN {_word('this season')} THEN 'current' ELSE 'recent' END AS temporal_scope,
  concat_ws(',', CASE WHEN {_word('gdp')} THEN 'gdp' END, CASE WHEN {_word('population')} THEN 'population' END, CASE WHEN {_word('specs')} THEN 'hardware_specs' END,
    CASE WHEN {_word('statistics')} AND FALSE THEN 'x' END) AS features FROM l""")
def goal_intent(spark, d):
    x = goals(spark, d).withColumn("x", intent.decompose(F.col("goal")))
    return x.select("goal", "x.domain_intent", "x.entity_intent", "x.target_hint", "x.temporal_scope", F.array_join("x.feature_hints", ",").alias("features"))


@query(f"""WITH {COMPOSED} SELECT goal, CASE WHEN contains(low, 'top 40') THEN 40
  WHEN contains(low, 'nba teams') THEN CASE WHEN {_word('historical', 'season')} THEN NULL ELSE 30 END WHEN contains(low, 'u.s. states') THEN 50 WHEN contains(low, 'fortune 500') THEN 500
  WHEN contains(low, 'ncaa') THEN 365 END AS row_count_hint FROM l""")
def goal_cardinality(spark, d):
    return goals(spark, d).select("goal", intent.cardinality(F.col("goal"))["count"].alias("row_count_hint"))


@query(f"""WITH {COMPOSED} SELECT goal, ({_word(*discovery.PREDICTIVE)} OR contains(low, 'ncaa basketball team statistics'))
  AND (NOT (contains(low, 'dataset of') OR contains(low, 'table of') OR contains(low, 'list of')) OR {_word(*discovery.OUTWEIGHS)} OR contains(low, 'ncaa basketball team statistics')) AS applicable,
  CASE WHEN goal ILIKE 'predict%' AND NOT (contains(low, 'table')) THEN '{discovery.CANONICAL[0]}' || rtrim(goal[9:], '.') || '{discovery.CANONICAL[1]}'
       WHEN goal ILIKE 'i want to predict%' THEN '{discovery.CANONICAL[0]}' || rtrim(goal[19:], '.') || '{discovery.CANONICAL[1]}' ELSE goal END AS normal FROM l""")
def goal_applicability(spark, d):
    return goals(spark, d).select("goal", discovery.applicable(F.col("goal")).alias("applicable"), discovery.normal_goal(F.col("goal")).alias("normal"))


@query(f"""WITH {COMPOSED}, i AS (SELECT *, replace({DOMAIN}, '-', ' ') AS dom, {ENTITY} AS ent FROM l)
SELECT goal, goal || ' public table' AS first, dom || ' ' || ent || ' list' || CASE WHEN {DATED} OR {_word('historical')} THEN ' historical' WHEN {_word('this season')} THEN ' current' ELSE ' latest' END AS third,
  goal || ' wikipedia list' AS fifth FROM i""")
def goal_search_queries(spark, d):
    q = goals(spark, d).withColumn("q", discovery.search_queries(F.col("goal")))
    return q.select("goal", F.col("q")[0].alias("first"), F.col("q")[2].alias("third"), F.col("q")[4].alias("fifth"))


def _adapters() -> str:
    """SQL for the list of known pages, from the same table of fixed values."""
    parts = []
    year = "regexp_extract_all(goal, '\\b(19\\d{2}|20\\d{2}|21\\d{2})\\b')[-1]::INT"
    for _, groups, of_domain, of_entity, y, urls in discovery.ADAPTERS:
        holds = [f"({' OR '.join(f'contains(low, {chr(39)}{p}{chr(39)})' for p in g)})" for g in groups]
        holds += [f"dom = '{of_domain}'"] * bool(of_domain) + [f"ent = '{of_entity}'"] * bool(of_entity)
        made = []
        for u in urls:
            quoted = "'" + u.replace("'", "''") + "'"
            for mark, value in (("{y}", f"coalesce({year}, {y})"), ("{p}", f"coalesce({year}, {y}) - 1"), ("{s}", f"right((coalesce({year}, {y}))::VARCHAR, 2)")):
                quoted = f"replace({quoted}, '{mark}', ({value})::VARCHAR)" if mark in u else quoted
            made.append(quoted)
        parts.append(f"CASE WHEN {' AND '.join(holds) or 'TRUE'} THEN [{', '.join(made)}] ELSE [] END")
    return " || ".join(parts)


INTENT = f"i AS (SELECT *, {DOMAIN} AS dom, {ENTITY} AS ent FROM l)"
ESCAPED = "replace(replace(goal, ' ', '+'), ',', '%2C')"


@query(f"""WITH {COMPOSED}, {INTENT}, a AS (SELECT goal, dom, ent, {_adapters()} AS known FROM i),
p AS (SELECT goal, known || ['https://en.wikipedia.org/w/index.php?search=' || {ESCAPED} || '+list', 'https://www.wikidata.org/w/index.php?search=' || {ESCAPED}]
  || CASE WHEN dom = 'public-data' OR ent = 'state' THEN ['https://www.census.gov/data/tables/time-series/demo/popest/2020s-state-total.html', 'https://www.bea.gov/data/gdp/gdp-state'] ELSE [] END
  || CASE WHEN dom IN ('startup', 'bank') OR ent = 'company' THEN ['https://www.forbes.com/lists/'] ELSE [] END
  || CASE dom WHEN 'nba' THEN ['https://www.basketball-reference.com/leagues/NBA_2025_per_game.html'] WHEN 'ncaa-basketball' THEN ['https://www.sports-reference.com/cbb/seasons/']
     WHEN 'soccer' THEN ['https://www.transfermarkt.com/'] WHEN 'laptop' THEN ['https://www.notebookcheck.net/'] ELSE [] END AS urls FROM a),
u AS (SELECT goal, url, min(n) AS n FROM (SELECT goal, unnest(urls) AS url, generate_subscripts(urls, 1) AS n FROM p) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY n) AS place FROM u WHERE NOT contains(url, 'forbes.com'))
SELECT goal, string_agg(url, ' ' ORDER BY place) AS urls FROM k WHERE place <= 8 GROUP BY 1""")
def goal_discovery(spark, d):
    found = discovery.discover(goals(spark, d), forbidden=("Forbes.com",), limit=8)
    return found.select("goal", F.array_join(F.transform("candidates", lambda x: x["url"]), " ").alias("urls"))


@query(f"""WITH {COMPOSED}, {INTENT}, a AS (SELECT goal, {_adapters()} || CASE WHEN dom = 'public-data' OR ent = 'state'
  THEN ['https://www.census.gov/data/tables/time-series/demo/popest/2020s-state-total.html'] ELSE [] END AS known FROM i), u AS (SELECT goal, unnest(['https://own.example/1'] || known) AS url FROM a)
SELECT goal, count(DISTINCT url) AS urls FROM u WHERE NOT contains(url, 'wikipedia.org') GROUP BY 1""")
def goal_expansion(spark, d):
    own = goals(spark, d).withColumn("own", F.array(F.lit("https://own.example/1"), F.lit("ftp://no"), F.lit("https://own.example/1")))
    blocked = spark.range(1).select(F.lit("wikipedia.org").alias("domain"))
    return _expanded(discovery.expand(own, "own", blocked, limit=40, forbidden=("wikidata",)))


def _expanded(rows: DataFrame) -> DataFrame:
    places = [u for u, *_ in discovery.PLACES if "{" not in u]
    known = {u for *_, urls in discovery.ADAPTERS for u in urls}
    return rows.filter(~F.col("url").isin(*[p for p in places if p not in known])).groupBy("goal").agg(F.count_distinct("url").alias("urls"))


def _holds(groups) -> str:
    return " AND ".join("(" + " OR ".join(f"contains(low, '{p}')" for p in g) + ")" for g in groups) or "TRUE"


@query(f"""WITH {COMPOSED} SELECT goal, CASE {' '.join(f"WHEN {_holds(t[0])} THEN " + (f"'{t[1]}'" if t[1] else "NULL") for t in blueprint.TEMPLATES)} END AS dataset,
  CASE {' '.join(f"WHEN {_holds(t[0])} THEN '{t[3]}'" for t in blueprint.TEMPLATES)} END AS target, {' OR '.join(f'({_holds(g)})' for g in blueprint.GATES)} AS own FROM l""")
def goal_templates(spark, d):
    return goals(spark, d).select("goal", blueprint.template_of(F.col("goal")).alias("t")).select("goal", "t.dataset", "t.target", "t.own")


@query(f"""WITH {COMPOSED}, c AS (SELECT goal, low, CASE WHEN contains(low, 'top 40') THEN 40 WHEN contains(low, 'nba teams') THEN CASE WHEN {_word('historical', 'season')} THEN NULL ELSE 30 END
  WHEN contains(low, 'u.s. states') THEN 50 WHEN contains(low, 'fortune 500') THEN 500 WHEN contains(low, 'ncaa') THEN 365 END AS n,
  CASE {' '.join(f"WHEN {_holds(t[0])} THEN {t[2]}" for t in blueprint.TEMPLATES)} END AS r, CASE {' '.join(f"WHEN {_holds(t[0])} THEN '{t[3]}'" for t in blueprint.TEMPLATES)} END AS target FROM l)
SELECT goal, coalesce(n, greatest(25, least(r, 1000)))::INT AS records, target FROM c""")
def goal_blueprints(spark, d):
    rows = goals(spark, d).withColumn("n", intent.cardinality(F.col("goal"))["count"]).collect()  # some goals
    made = [(r["goal"], blueprint.design(r["goal"], r["n"])) for r in rows]
    assert not any(blueprint.validate(b) for _, b in made)
    return spark.createDataFrame([(g, b.records, b.target) for g, b in made], "goal string, records int, target string")


@query(f"""WITH {COMPOSED}, {INTENT} SELECT goal, CASE WHEN dom = 'nba' AND ent = 'player' THEN 'player' WHEN dom = 'public-data' AND ent = 'state' THEN 'state'
  WHEN dom = 'ncaa-basketball' AND contains(low, 'team statistics') THEN 'team' END AS demo FROM i""")
def goal_demos(spark, d):
    return goals(spark, d).select("goal", discovery.demo_of(F.col("goal")).alias("demo"))


@query(f"""WITH {COMPOSED}, y AS (SELECT goal, regexp_extract_all(goal, '\\b(19\\d{{2}}|20\\d{{2}})\\b')[-1]::INT AS y FROM g)
SELECT goal, 'https://www.nba.com/stats/teams/traditional' || coalesce('?Season=' || (y - 1) || '-' || right(y::VARCHAR, 2), '') AS url FROM y""")
def seed_urls(spark, d):
    return goals(spark, d).select("goal", discovery.seed_url(F.lit("https://www.NBA.com/stats/standings?x"), F.col("goal")).alias("url"))


# --- headers and fields ---------------------------------------------------------------------------------------------
FIRST = ("population", "GDP", "real gdp", "State", "price", "Name", "salary", "points", "rank", "revenue", "Pop", "chip", "screen", "min", "gross domestic product", "team")
SECOND = ("", " growth", " change", " 2024", " 2025-26", " model", " per game", " rate", " territory")
FIELDS = ("population", "population_growth_rate", "gdp", "gdp_growth_rate", "state", "name", "price_usd", "cpu_model", "display_size_inches", "salary", "revenue_usd_millions", "points_per_game", "minutes_per_game", "rank", "company", "other")
HEADERS = f"h AS (SELECT DISTINCT {_pick(FIRST, 'p_partkey')} || {_pick(SECOND, 'p_partkey // 3')} AS header FROM part)"


def headers(spark, d) -> list[str]:
    k = F.col("p_partkey")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(k / n) % len(words) + 1).cast("int"))
    return sorted(r[0] for r in table(spark, d, "part").select(F.concat(pick(FIRST, 1), pick(SECOND, 3)).alias("h")).distinct().collect())


def _score_sql(field: str, own: str, wanted: str, aliases, rules, never, exact: int, part: str) -> str:
    """SQL for a score: groups of words as whole, then the field's rules one after the other."""
    every = lambda ws: "(" + " AND ".join(f"list_contains(t, '{w}')" for w in ws) + ")"
    some = lambda ws: "(" + " OR ".join(f"own = '{w[1:]}'" if w.startswith("=") else f"list_contains(t, '{w}')" for w in ws) + ")"
    groups = aliases.get(field, ((wanted,),))
    base = "greatest(0, " + ", ".join(f"CASE WHEN {every(g)} THEN {3 * len(g)} ELSE 0 END" for g in groups) + f", CASE WHEN own = '{wanted}' THEN {exact} WHEN {part} THEN {matching.PART} ELSE 0 END)"
    for holds, effect, n in rules.get(field, ()):
        met = " AND ".join(some(g) for g in holds)
        after = {"zero": "-1000", "floor": f"CASE WHEN s < 0 THEN s ELSE greatest(s, {n}) END", "cap": f"least(s, {n})", "plus": f"CASE WHEN s > 0 THEN s + {n} ELSE s END"}[effect]
        base = f"(SELECT CASE WHEN {met} THEN {after} ELSE s END FROM (SELECT {base} AS s))"
    return f"CASE WHEN own IN ({', '.join(repr(x) for x in never)}) THEN 0 ELSE greatest(0, {base}) END"


NORMAL = "trim(regexp_replace(lower(header), '[^a-z0-9]+', '_', 'g'), '_')"
LETTERS = "regexp_replace(lower(header), '[^a-z0-9]+', '', 'g')"


def _all_scores(own: str, form, aliases, rules, never, exact, part) -> str:
    tokens = "list_filter(regexp_split_to_array(lower(header || ' ' || own), '[^a-z0-9]+'), lambda x: x <> '')"
    parts = [f"SELECT header, '{f}' AS field, {_score_sql(f, own, form(f), aliases, rules, never, exact, part(form(f)))} AS score FROM o" for f in FIELDS]
    return f"WITH {HEADERS}, n AS (SELECT header, {own} AS own FROM h), o AS (SELECT *, {tokens} AS t FROM n), s AS ({' UNION ALL '.join(parts)})"


EXTRACTOR = _all_scores(LETTERS, matching.letters, matching.EXTRACTOR_ALIASES, matching.EXTRACTOR_RULES, matching.EXTRACTOR_NEVER, matching.EXTRACTOR_EXACT, lambda w: f"starts_with(own, '{w}') OR starts_with('{w}', own)")
BUILDER = _all_scores(NORMAL, columns.normalize, matching.BUILDER_ALIASES, matching.BUILDER_RULES, matching.BUILDER_NEVER, matching.BUILDER_EXACT, lambda w: f"contains(own, '{w}')")


@query(f"{EXTRACTOR} SELECT header, field, score::INT AS score FROM s")
def extractor_scores(spark, d):
    return spark.createDataFrame([(h, f, matching.extractor_score(f, h)) for h in headers(spark, d) for f in FIELDS], "header string, field string, score int")


@query(f"{BUILDER} SELECT header, field, score::INT AS score FROM s")
def builder_scores(spark, d):
    return spark.createDataFrame([(h, f, matching.builder_score(f, h)) for h in headers(spark, d) for f in FIELDS], "header string, field string, score int")


@query(f"""{EXTRACTOR}, own AS (SELECT header, regexp_replace(lower(header), '[^a-z0-9]+', '', 'g') AS l FROM h),
special AS (SELECT 'name' AS field, min(header) AS header FROM own WHERE l IN ('team', 'name', 'program') HAVING count(*) > 0),
b AS (SELECT field, arg_min(header, (-score, header)) AS header FROM s WHERE score >= 4 GROUP BY 1)
SELECT field, header FROM special UNION ALL SELECT field, header FROM b WHERE field NOT IN (SELECT field FROM special)""")
def header_mapping(spark, d):
    found = matching.map_headers(headers(spark, d), list(FIELDS))
    return spark.createDataFrame(list(found.items()), "field string, header string")


@query(f"""{BUILDER}, b AS (SELECT field, header, row_number() OVER (PARTITION BY field ORDER BY score DESC, length(header) % 3 DESC, header) AS k FROM s WHERE score >= 4)
SELECT field, header FROM b WHERE k = 1""")
def column_mapping(spark, d):
    own = headers(spark, d)
    filled = {h: len(h) % 3 / 3 for h in own}
    rows = [(f, matching.match_column(own, f, filled)) for f in FIELDS]
    return spark.createDataFrame([r for r in rows if r[1]], "field string, header string")


@query("""
WITH c AS (SELECT 'total_' || lower(replace(p_brand, '#', '_')) AS name, min(p_partkey) AS k FROM part GROUP BY 1)
SELECT name, CASE WHEN k % 2 = 0 THEN name END AS pruner, name AS builder FROM c""")
def quality_columns(spark, d):
    """A field finds its column by its name, by a part of it (both), or by its score (the builder's alone)."""
    rows = table(spark, d, "part").groupBy(F.concat(F.lit("total_"), F.lower(F.regexp_replace("p_brand", "#", "_"))).alias("name")).agg(F.min("p_partkey").alias("k")).collect()
    out = []
    for r in rows:
        asked = f"Total/{r['name']}".replace("Total/total_", "Total ") if r["k"] % 2 == 0 else "salary"
        own = [r["name"], "other"] if r["k"] % 2 == 0 else ["other", f"{r['name']}_2025_26"]
        back = lambda c: c.replace("_2025_26", "") if c else None
        out.append((r["name"], back(matching.quality_column(own, ["", asked])), back(matching.quality_column(own, ["", asked], dict.fromkeys(own, 1.0)))))
    return spark.createDataFrame(out, "name string, pruner string, builder string")


@query("""
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'y' WHEN 1 THEN 'profit_' || n_nationkey WHEN 2 THEN 'x_score' END AS validator,
  CASE n_nationkey % 4 WHEN 0 THEN 'y' WHEN 1 THEN 'churned' WHEN 2 THEN NULL ELSE 'status' END AS synthesizer, CASE n_nationkey % 4 WHEN 0 THEN 'y' WHEN 1 THEN 'churned' WHEN 2 THEN 'x_score' ELSE 'status' END AS designer FROM nation""")
def target_fields(spark, d):
    out = []
    for (k,) in table(spark, d, "nation").select("n_nationkey").collect():
        own = (["a", "price", "y"], ["a", f"profit_{k}", "churned"], ["a", "x_score"], ["a", "status"])[k % 4]
        roles = {"y": "target"} if k % 4 == 0 else {}
        spec = [blueprint.Field(n, role=roles.get(n, "")) for n in own]
        out.append((k, matching.target_field(own, matching.VALIDATOR_TARGETS, roles), matching.target_field(own, matching.SYNTHESIZER_TARGETS, roles), blueprint.resolve_target(spec)))
    return spark.createDataFrame(out, "n_nationkey int, validator string, synthesizer string, designer string")


@query("""
SELECT n_nationkey, 'a_b' || n_nationkey AS collapsed, 'total' || n_nationkey AS valued, 'a_b_c_d_' || (n_nationkey + 1) * 100 || '9' AS numbered, 'x' || n_nationkey || '_2' AS second FROM nation""")
def final_labels(spark, d):
    out = []
    for (k,) in table(spark, d, "nation").select("n_nationkey").collect():
        names = columns.final_labels([f"a_b{k}_a_b{k}", f"total{k}_total{k}_value", f"a_b_c_d_{(k + 1) * 100}9_{k % 100}", f"x{k}", f"x{k}_x{k}"])
        out.append((k, names[0], names[1], names[2], names[4]))
    return spark.createDataFrame(out, "n_nationkey int, collapsed string, valued string, numbered string, second string")


@query("""
WITH c AS (SELECT unnest(['name', 'wins', 'salary', 'p_size', 'zeta', 'source']) AS "column", unnest([0, 2, 1, 3, 4, 5]) AS place) SELECT "column", place::INT AS place FROM c""")
def column_ordering(spark, d):
    t = table(spark, d, "part").select(F.lit("x").alias("zeta"), F.col("p_brand").alias("source"), "p_size", F.col("p_type").alias("wins"), F.col("p_retailprice").alias("salary"), F.col("p_name").alias("name"))
    ordered = columns.column_order(t.columns, [], quality.numeric_columns(t), "most wins")
    return spark.createDataFrame(list(zip(ordered, range(len(ordered)), strict=True)), "column string, place int")


@query("""
SELECT unnest(['points_per_game_avg', 'scoring_offense_avg', 'rank']) AS renamed, (SELECT count(*) FROM nation) AS rows""")
def metric_prefixes(spark, d):
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("rank"), F.col("n_regionkey").alias("avg"))
    page = t.withColumnsRenamed(columns.prefixed(t.columns, columns.metric_of("https://www.teamrankings.com/nba/stat/points-per-game/?date=1")))
    numbered = t.withColumnsRenamed(columns.prefixed_by_number(t.columns, "https://www.ncaa.com/stats/team/145"))
    names = dict.fromkeys([*page.columns, *numbered.columns])
    return spark.createDataFrame([(n, page.join(numbered, "rank").count()) for n in names], "renamed string, rows long")


# --- tables against a goal ------------------------------------------------------------------------------------------
def _entities(spark, d):
    """A table whose columns have telling names only in part."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("_pos"), F.col("p_partkey").cast("string").alias("rank_of_name"), F.col("p_size").cast("string").alias("x_1"), F.col("p_name").alias("col_name_2"), F.lit("z").alias("unnamed_3"), (F.col("p_partkey") + 1).alias("counter"))


@query("""
SELECT 'col_name_2' AS entity, string_agg(c, ',' ORDER BY c) AS low_signal, TRUE AS names, FALSE AS numbers
FROM (SELECT 'unnamed_3' AS c UNION ALL SELECT 'counter' WHERE (SELECT list(p_partkey + 1 ORDER BY p_partkey)[:25] = range(1, 26) FROM part) UNION ALL SELECT 'rank_of_name' WHERE FALSE)""")
def entity_detection(spark, d):
    t = _entities(spark, d)
    own = [c for c in t.columns if c != "_pos"]
    samples = matching.head_samples(t, own, "_pos", 20)
    low = matching.low_signal_columns(t, "_pos")
    row = (matching.entity_column(own, "generic", samples), ",".join(sorted(low)), matching.entity_like(samples["col_name_2"]), matching.entity_like(samples["x_1"]))
    return spark.createDataFrame([row], "entity string, low_signal string, names boolean, numbers boolean")


@query("""
SELECT p_partkey AS _pos, p_name AS name, p_name AS company, p_size AS real_gdp, p_size AS gdp FROM part""")
def schema_aliases(spark, d):
    """The schema's gdp is copied from the column that fits, and its company, which holds numbers, gets the names."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("_pos"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("company"), F.col("p_size").alias("real_gdp"))
    return matching.repair_entities(matching.alias_columns(p, ["gdp", "company"]), ["gdp", "company"], "_pos")


FRAMES = (("https://x.example/a", "name"), ("https://x.example/players/b", "player"), ("https://x.example/salary-season", "player"))


@query("""
WITH n AS (SELECT count(*) AS a, count(*) FILTER (WHERE s_suppkey % 2 = 0) AS b, count(*) FILTER (WHERE s_suppkey % 5 = 0) AS c FROM supplier)
SELECT unnest([0, 1, 2]) AS frame, unnest([8, 12, 12])::INT AS alignment, unnest([-abs(a - 30.0), -abs(b - 30.0), -abs(c - 30.0)])::DOUBLE AS row_score, unnest([FALSE, TRUE, TRUE]) AS signal,
  CASE WHEN abs(b - 30.0) <= abs(c - 30.0) THEN 1 ELSE 2 END AS best FROM n""")
def frame_choice(spark, d):
    s = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "_pos")
    goal = "Predict salary of NBA players"
    parts = [s.select("_pos", F.col("s_name").alias("raw_entity_name"), F.col("s_acctbal").alias("balance")), s.filter("_pos % 2 = 0").select("_pos", F.col("s_name").alias("raw_entity_name"), F.col("s_acctbal").alias("salary")), s.filter("_pos % 5 = 0").select("_pos", F.col("s_name").alias("raw_entity_name"), F.col("s_acctbal").alias("salary"))]
    frames = [matching.frame_of(p, url, entity, "_pos") for p, (url, entity) in zip(parts, FRAMES, strict=True)]
    best = matching.best_frame(frames, goal, "player", "salary", 30, True)
    rows = [(i, matching.alignment(f, goal, "player"), matching.row_count_score(f.rows, 30, True), matching.target_signal(f, goal), best) for i, f in enumerate(frames)]
    return spark.createDataFrame(rows, "frame int, alignment int, row_score double, signal boolean, best int")


@query("""
SELECT count(*)::INT AS rows, count(*) BETWEEN 15 AND 45 AS exact, count(*) BETWEEN 12 AND 60 AS approximate, count(*) >= 20 AS without FROM nation""")
def row_count_gate(spark, d):
    n = table(spark, d, "nation").count()
    return spark.createDataFrame([(n, intent.row_count_fits(n, 30, True), intent.row_count_fits(n, 30, False), intent.row_count_fits(n, None, True))], "rows int, exact boolean, approximate boolean, without boolean")


@query("""
WITH s AS (SELECT avg((p_size > 10)::INT) AS size_filled, avg((p_partkey % 3 <> 0)::INT) AS name_filled, count(DISTINCT p_type) AS types, count(DISTINCT p_retailprice) AS prices FROM part)
SELECT unnest(['p_retailprice', 'p_type', 'p_name', 'p_size']) AS "column", unnest([0, 1, CASE WHEN name_filled >= size_filled THEN 2 ELSE 3 END, CASE WHEN name_filled >= size_filled THEN 3 ELSE 2 END])::INT AS place FROM s""")
def core_features(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("p_name"), "p_type", "p_retailprice")
    found = quality.core_features(t, "p_partkey")
    return spark.createDataFrame(list(zip(found, range(4), strict=True)), "column string, place int")


@query("""
WITH s AS (SELECT count(*) AS n, avg((r_regionkey > 0)::INT) AS gdp FROM region)
SELECT unnest(['team', 'salary', 'gdp']) AS "column", unnest([1.0::DOUBLE, 1.0, gdp]) AS filled, unnest([FALSE, TRUE, TRUE]) AS is_target FROM s""")
def final_trim(spark, d):
    """Two protected columns, one of which the table lacks, and the two best of the others."""
    t = table(spark, d, "region").select(F.col("r_name").alias("team"), F.lit(1.0).alias("salary"), F.when(F.col("r_regionkey") > 0, 1).alias("gdp"), F.lit("x").alias("other"), F.lit(None).cast("string").alias("empty"))
    kinds, filled, numbers = {r["column"]: r["distinct"] for r in profiling.profile(t).collect()}, matching.coverage(t), quality.numeric_columns(t)
    scores = {c: matching.final_score(c, filled[c], c in numbers, kinds[c]) for c in t.columns}
    kept = matching.trim(t.columns, ["team", "absent"], scores, 4)
    return spark.createDataFrame([(c, filled[c], scores[c][0]) for c in kept], "column string, filled double, is_target boolean")


@query("""
WITH t AS (SELECT count(*) FILTER (WHERE o_totalprice IS NOT NULL) AS n, count(DISTINCT o_orderstatus) AS kinds FROM orders)
SELECT 'revenue' AS target, 'regression' AS task, 'order_id,source_name' AS dropped, CASE WHEN kinds <= 2 THEN 'binary classification' ELSE 'regression' END AS status_task, 'binary classification' AS flag_task FROM t""")
def target_inference(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("revenue"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 2).alias("flag"), F.col("o_orderpriority").alias("source_name"))
    guess = seams.infer_target(t, "Predict revenue of orders")
    asked = seams.infer_target(t, "Predict revenue of orders", lambda goal, names: {"inferred_target_column": "flag", "task_type": "regression"})
    assert asked.column == "revenue"
    return spark.createDataFrame([(guess.column, guess.task, ",".join(sorted(guess.dropped)), profiling.task_type(t, "status"), profiling.task_type(t, "flag"))], "target string, task string, dropped string, status_task string, flag_task string")


@query("""
SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'domain_adapter' WHEN page_id % 5 = 0 THEN 'fetch_failed' WHEN page_id % 4 = 0 THEN 'json_payload' WHEN page_id % 3 = 0 THEN 'html_table' ELSE 'browser' END AS strategy,
  page_id % 6 <> 0 AND (page_id % 5 = 0 OR (page_id % 4 <> 0 AND page_id % 3 <> 0)) AND page_id % 2 = 1 AS needs_browser FROM pages""")
def extraction_routing(spark, d):
    k = F.col("page_id")
    n = lambda m: F.when(k % m == 0, 3).otherwise(0)
    p = table(spark, d, "pages").select("page_id", (k % 5 != 0).alias("ok"), n(6).alias("adapter"), n(4).alias("payload"), n(3).alias("tables"), (k % 2 == 1).alias("open"))
    return seams.route(p, "ok", {"domain_adapter": "adapter", "json_payload": "payload", "html_table": "tables"}, "open").select("page_id", "strategy", "needs_browser")


@query("""
SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1""")
def model_merge_fallback(spark, d):
    """Too many records for a model, so it isn't asked."""
    t = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"))

    def model(known, new):
        raise AssertionError("a model was asked")

    return seams.merge(t, "o_custkey", "o_orderkey", model)


@query("""
SELECT r_regionkey, r_name AS name, count(*) AS read FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL""")
def model_extraction(spark, d):
    """A model that reads names from text; without one, nothing is read, and no column is dropped."""
    texts = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.concat_ws(";", F.collect_list("n_name")).alias("text"))

    def model(text):
        return 'Here: {"rows": [' + ", ".join(f'{{"name": "{x}"}}' for x in text.split(";")) + "]}"

    assert seams.extract(texts, "text", "name string").filter("size(records) > 0").isEmpty() and seams.drop_by_meaning(texts, "text", ()) == []
    assert seams.drop_by_meaning(texts, "text", (), lambda names, target: '["r_name", "x"]') == ["r_name"]
    got = seams.extract(texts, "text", "name string", model)
    return got.select("r_regionkey", F.col("r_name").alias("name"), F.size("records").cast("long").alias("read"))


@query("""
SELECT count(*) FILTER (WHERE ok) AS matching, count(*) AS goals FROM (SELECT n_name, n_nationkey % 2 = 0 AS ok FROM nation)""")
def result_matches_goal(spark, d):
    rows = table(spark, d, "nation").collect()
    ok = sum(blueprint.matches_goal(["name", "net_salary" if r["n_nationkey"] % 2 == 0 else "x"], f"Predict salary in {r['n_name']}", None) for r in rows)
    assert blueprint.matches_goal(["x"], "Predict it", None) and blueprint.matches_goal(["pct_change"], "growth", None) and not blueprint.matches_goal(["x"], "y", "team_wins")
    return spark.createDataFrame([(ok, len(rows))], "matching long, goals long")


@query("""
SELECT r_regionkey, 'outcome_' || lower(r_name) AS target, 3::INT AS fields, 2::INT AS required, 'unknown' AS source_type, greatest(25, least(r_regionkey * 500, 1000))::INT AS records FROM region WHERE r_regionkey > 0""")
def recovered_blueprints(spark, d):
    """Blueprints from elsewhere, with parts missing or odd, made regular."""
    out = []
    for r in table(spark, d, "region").filter("r_regionkey > 0").collect():
        name = f"outcome_{r['r_name'].lower()}"
        raw = {"target_record_count": r["r_regionkey"] * 500, "starting_urls": ["https://a.example"], "row_schema": {"fields": [{"name": "kind", "type": "object"}, {"name": name, "type": "number", "ml_role": "target", "nullable": False}, {"name": "image_url"}, {"name": "is_x", "type": "thing", "nullable": True}, 7]}}
        got = blueprint.recover(raw)
        b = blueprint.normalise(got["dataset"], got["fields"], got["target"], got["records"], None, got["required"], tuple(u for u, _ in got["sources"]))
        assert not blueprint.validate(b) and b.dataset == "recovered_dataset" and dict((f.name, f.dataType.simpleString()) for f in b.schema)["is_x"] == "boolean"
        out.append((r["r_regionkey"], b.target, len(b.schema), len(b.required), got["sources"][0][1], b.records))
    assert blueprint.recover({})["target"] == "outcome_label"
    return spark.createDataFrame(out, "r_regionkey int, target string, fields int, required int, source_type string, records int")


@query("""
WITH s AS (SELECT DISTINCT url, CASE WHEN len(split(h, '.')) <= 2 THEN h ELSE array_to_string(split(h, '.')[-2:], '.') END AS domain FROM (SELECT url, regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) AS h FROM pages))
SELECT count(DISTINCT domain) AS chosen, count(DISTINCT url) AS with_duplicates FROM s""")
def source_choice(spark, d):
    p = table(spark, d, "pages").select("url")
    one, many = blueprint.choose_sources(p, "x", False), blueprint.choose_sources(p, "x", True)
    return one.agg(F.count(F.lit(1)).alias("chosen")).crossJoin(F.broadcast(many.agg(F.count(F.lit(1)).alias("with_duplicates"))))


@query("""
SELECT unnest(['a', 'b', 'entity']) AS "column", unnest(['left | right', 'left', 'derived']) AS source FROM (SELECT count(*) AS n FROM region) WHERE n > 0""")
def provenance_merge(spark, d):
    t = table(spark, d, "region")
    got = pipeline.joined_provenance({"a": "left", "b": "left"}, {"a": "right"}, ["a", "b", "entity", "entity_name"])
    assert t.count() > 0
    return spark.createDataFrame(list(got.items()), "column string, source string")


@query("""
SELECT place::INT AS place, url FROM (SELECT row_number() OVER (ORDER BY hits DESC, n_name, url) AS place, url FROM (SELECT n_name, 'https://' || lower(n_name) || '.example/' || n_regionkey AS url, 9 - (n_regionkey % 2) * 4 AS hits FROM nation)) WHERE place <= 6""")
def source_memory_similarity(spark, d):
    n = table(spark, d, "nation")
    url = F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example/"), "n_regionkey")
    memory = n.select(F.col("n_name").alias("goal"), F.lit("nba").alias("domain_intent"), F.when(F.col("n_regionkey") % 2 == 0, "player").otherwise("team").alias("entity_intent"), F.lit("").alias("target_hint"), F.array().cast("array<string>").alias("feature_hints"), F.array(url).alias("urls"))
    goal = intent.read_goal("Predict NBA player salary from performance")
    return ranking.similar_sources(memory, {"domain_intent": goal.domain, "entity_intent": goal.entity, "target_hint": goal.target, "feature_hints": goal.features})


# --- targets --------------------------------------------------------------------------------------------------------
COLUMNS = ("salary", "net_salary_pct", "population_growth_rate", "population_change", "gdp_change", "gdp/rate", "price", "revenue_growth", "revenue", "wins", "points", "target_label", "entity_name", "valuation", "width", "x")


def _points_sql() -> str:
    """SQL for the points of a column (name c, its words w) under a goal (low), rule by rule; of rules with a letter the first that fits counts."""
    ranked: dict[str, list[str]] = {}
    total = []
    for asked, named, points, rank in profiling.TARGET_POINTS:
        met = [" OR ".join(f"contains(low, '{p}')" for p in g) for g in asked] + [" OR ".join(f"list_contains(w, '{x}')" for x in g) for g in named]
        when = f"WHEN {' AND '.join(f'({m})' for m in met)} THEN {points}"
        ranked.setdefault(rank or f"own{len(total)}{len(ranked)}", []).append(when)
    total = [f"CASE {' '.join(whens)} ELSE 0 END" for whens in ranked.values()]
    some = lambda words: " OR ".join(f"contains(c, '{x}')" for x in words)
    return f"CASE WHEN {some(profiling.NO_TARGET)} THEN -50 ELSE 0 END + CASE WHEN {some(profiling.PRIORITY)} THEN 10 ELSE 0 END + CASE WHEN is_number THEN 8 ELSE 0 END + " + " + ".join(total)


@query(f"""WITH {COMPOSED}, n AS (SELECT unnest({list(COLUMNS)}) AS c, generate_subscripts({list(COLUMNS)}, 1) % 2 = 1 AS is_number), x AS (SELECT goal, low, c, is_number, regexp_split_to_array(c, '[_/]') AS w FROM l, n)
SELECT goal, c AS "column", ({_points_sql()})::INT AS points FROM x""")
def target_points(spark, d):
    rows = [(r["goal"], c, profiling.name_score(r["goal"], c, i % 2 == 0)) for r in goals(spark, d).collect() for i, c in enumerate(COLUMNS)]  # some goals
    return spark.createDataFrame(rows, "goal string, column string, points int")
