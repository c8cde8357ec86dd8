"""From a goal to places to look: whether it asks for a prediction, search phrases, known pages, and what comes first.

Everything is a Column expression of the goal, so a table of goals is planned in one pass, and a single goal as a
table of one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions.text import any_of, root_domain
from tablesmith.plans.intent import decompose, domain_intent, entity_intent, has, tokens

# --- Fixed values ---------------------------------------------------------------------------------------------------
#: Words that ask for a prediction, phrases that ask for a list instead, and words that outweigh these.
PREDICTIVE = (
    "predict", "predictor", "prediction", "predictive", "estimate", "estimation", "forecast", "forecasting", "model", "modeling", "modelling",
    "classification", "regression", "feature", "features", "target", "label",
)
LISTING, OUTWEIGHS = ("dataset of", "table of", "list of"), ("predict", "prediction", "predictive", "target", "label")
TEAM_STATISTICS = ("ncaa", "basketball", "team statistics")
#: Words that show that a goal is already spelled out, how it may be asked, and how it is spelled out.
SPELLED_OUT = ("dataset", "table", "rows", "columns", "features")
ASKED = (r"^\s*i want to predict\s+(.+?)\s*$", r"^\s*i'?d like to predict\s+(.+?)\s*$", r"^\s*help me predict\s+(.+?)\s*$", r"^\s*predict\s+(.+?)\s*$")
CANONICAL = (
    "Build a predictive dataset to predict ",
    ". Infer the most useful feature columns, choose sensible row entities, "
    "find public web sources, validate the scraped data, and return a clean modeling table.",
)
#: Words for the time that a goal is about.
TIMES = {"historical": "historical", "current": "current", "recent": "latest"}
#: Pages that are known for a goal: name, phrases (one of each group), intents of domain and entity (empty: any), the year if the
#: goal names none (0: it doesn't matter), and URLs with {y} for the year, {p} for the one before, {s} for the year's last digits.
ADAPTERS = (
    ("ncaa-basketball", (("basketball",), ("ncaa", "college", "division i")), "", "", 2026, (
        "https://www.ncaa.com/stats/basketball-men/d1/current/team/145",
        "https://www.sports-reference.com/cbb/seasons/{y}-school-stats.html",
        "https://www.sports-reference.com/cbb/seasons/{y}-advanced-school-stats.html",
        "https://www.sports-reference.com/cbb/seasons/{y}-opponent-stats.html",
        "https://en.wikipedia.org/wiki/List_of_NCAA_Division_I_men%27s_basketball_programs",
        "https://www.teamrankings.com/ncb/stats/",
    )),
    ("nba-basketball", (), "nba", "team", 2025, (
        "https://www.nba.com/stats/teams/traditional?Season={p}-{s}",
        "https://www.teamrankings.com/nba/stat/points-per-game",
        "https://en.wikipedia.org/wiki/List_of_National_Basketball_Association_seasons",
        "https://en.wikipedia.org/wiki/National_Basketball_Association",
    )),
    ("nba-players", (), "nba", "player", 0, (
        "https://www.espn.com/nba/stats/player",
        "https://www.espn.com/nba/salaries",
        "https://hoopshype.com/salaries/players/",
        "https://www.nba.com/players",
    )),
    ("fortune-companies", (("fortune 500",),), "", "", 0, (
        "https://en.wikipedia.org/wiki/List_of_Fortune_500_companies",
        "https://fortune.com/ranking/fortune500/",
        "https://companiesmarketcap.com/largest-companies-by-revenue/",
    )),
    ("startup-companies", (), "startup", "", 0, ("https://en.wikipedia.org/wiki/List_of_unicorn_startup_companies",)),
    ("soccer-clubs", (), "soccer", "club", 2025, (
        "https://www.transfermarkt.com/premier-league/transfers/wettbewerb/GB1/plus/?saison_id={p}&s_w=s&leihe=1&intern=0",
        "https://www.transfermarkt.com/laliga/transfers/wettbewerb/ES1/plus/?saison_id={p}&s_w=s&leihe=1&intern=0",
        "https://www.transfermarkt.com/serie-a/transfers/wettbewerb/IT1/plus/?saison_id={p}&s_w=s&leihe=1&intern=0",
        "https://www.transfermarkt.com/ligue-1/transfers/wettbewerb/FR1/plus/?saison_id={p}&s_w=s&leihe=1&intern=0",
        "https://www.transfermarkt.com/bundesliga/transfers/wettbewerb/L1/plus/?saison_id={p}&s_w=s&leihe=1&intern=0",
    )),
    ("banks", (("bank",),), "", "", 0, (
        "https://www.usbanklocations.com/bank-rank/net-income---incomeexpense--ie-netinc.html?d=2024-06-30",
        "https://www.usbanklocations.com/bank-rank/quarterly-net-income.html",
        "https://en.wikipedia.org/wiki/List_of_largest_banks_in_the_United_States",
        "https://en.wikipedia.org/wiki/List_of_largest_banks",
        "https://companiesmarketcap.com/banks/largest-banks-by-market-cap/",
    )),
    ("population", (("population",),), "", "", 0, (
        "https://en.wikipedia.org/wiki/List_of_U.S._states_and_territories_by_population_growth_rate",
        "https://en.wikipedia.org/wiki/List_of_U.S._states_and_territories_by_economic_growth_rate",
        "https://en.wikipedia.org/wiki/List_of_U.S._states_and_territories_by_population",
        "https://en.wikipedia.org/wiki/List_of_U.S._states_and_territories_by_GDP",
        "https://www.census.gov/data/tables/time-series/demo/popest/2020s-state-total.html",
    )),
    ("laptops", (("laptop", "laptops", "notebook", "notebooks"), ("spec", "specs", "price", "prices", "pc")), "", "", 0, (
        "https://www.notebookcheck.net/Ranking-Best-all-around-laptops-reviewed-by-Notebookcheck.98608.0.html",
        "https://www.notebookcheck.net/Ranking-Best-affordable-all-around-laptops.281362.0.html",
        "https://www.notebookcheck.net/The-Best-Ultrabooks.91067.0.html",
    )),
)
#: Parts of known pages whose tables are in their state.
STATE_PAGES = ("nba.com/stats", "transfermarkt")
#: General places, in order: URL ({q}: the goal, {l}: the goal and `list`, as a query), type, family, and domains or entities that
#: they are for (none: all).
PLACES = (
    ("https://en.wikipedia.org/w/index.php?search={l}", "html_table", "reference_list", (), ()),
    ("https://www.wikidata.org/w/index.php?search={q}", "html_table", "reference_list", (), ()),
    ("https://www.census.gov/data/tables/time-series/demo/popest/2020s-state-total.html", "html_table", "official_dataset", ("public-data",), ("state",)),
    ("https://www.bea.gov/data/gdp/gdp-state", "html_table", "official_dataset", ("public-data",), ("state",)),
    ("https://www.forbes.com/lists/", "browser_heavy", "publisher_list", ("startup", "bank"), ("company",)),
    ("https://www.basketball-reference.com/leagues/NBA_2025_per_game.html", "html_table", "aggregator", ("nba",), ()),
    ("https://www.sports-reference.com/cbb/seasons/", "html_table", "aggregator", ("ncaa-basketball",), ()),
    ("https://www.transfermarkt.com/", "browser_heavy", "aggregator", ("soccer",), ()),
    ("https://www.notebookcheck.net/", "html_table", "aggregator", ("laptop",), ()),
)
#: Parts of URLs that lead nowhere any more.
STALE = ("statbunker.com", "nanoreview.net/en/laptop-list")
#: Goals that have made-up tables to start with: domain, entity (empty: any), phrases of which one is there (none: any).
DEMOS = (("player", "nba", "player", ()), ("state", "public-data", "state", ()), ("team", "ncaa-basketball", "", ("team statistics", "team strength", "teams")))
#: A page that is replaced by a better one of the same site, how it names the season, and the better one without a season.
REPLACED = ("nba.com/stats/standings", r"(?i)[?&]season=(\d{4})\b", "https://www.nba.com/stats/teams/traditional")
# --------------------------------------------------------------------------------------------------------------------

YEAR = r"\b(19\d{2}|20\d{2}|21\d{2})\b"
CANDIDATES = "array<struct<url string, type string, family string>>"


def holds(low: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """Whether a text contains one phrase of each group."""
    return reduce(lambda a, b: a & b, [any_of(low, g) for g in groups], F.lit(True))


def applicable(goal: Column) -> Column:
    """Whether a goal asks for a prediction, and not merely for a list."""
    low, words = F.lower(goal), tokens(goal)
    statistics = holds(low, tuple((p,) for p in TEAM_STATISTICS))
    return (has(words, PREDICTIVE) | statistics) & (~any_of(low, LISTING) | has(words, OUTWEIGHS) | statistics)


def normal_goal(goal: Column) -> Column:
    """A goal in few words (`predict X`) spelled out; others with single spaces."""
    clean = F.trim(F.regexp_replace(goal, r"\s+", " "))
    target = F.lit(None).cast("string")
    for p in reversed(ASKED):
        target = F.when(clean.rlike(f"(?i){p}"), F.nullif(F.regexp_replace(F.trim(F.regexp_extract(clean, f"(?i){p}", 1)), r"[.!?]+$", ""), F.lit(""))).otherwise(target)
    return F.when(any_of(F.lower(clean), SPELLED_OUT) | target.isNull(), clean).otherwise(F.concat(F.lit(CANONICAL[0]), target, F.lit(CANONICAL[1])))


def search_queries(goal: Column, limit: int = 8) -> Column:
    """Distinct search phrases for a goal, in order."""
    d = decompose(goal)
    plain = lambda c: F.regexp_replace(c, "[_-]", " ")
    domain, entity, target = plain(d["domain_intent"]), plain(d["entity_intent"]), F.coalesce(F.translate(d["target_hint"], "_", " "), F.lit("target"))
    time = F.lit("")
    for scope, word in TIMES.items():
        time = F.when(d["temporal_scope"] == scope, word).otherwise(time)
    features = F.transform(F.slice(d["feature_hints"], 1, 2), lambda x: F.translate(x, "_", " "))
    join = lambda *parts: F.concat_ws(" ", *parts)
    made = [
        join(goal, F.lit("public table")), join(domain, entity, target, F.lit("stats table")), join(domain, entity, F.lit("list"), time),
        join(entity, target, F.lit("directory")), join(goal, F.lit("wikipedia list")),
        F.when(F.size(features) > 0, join(domain, entity, F.array_join(features, " "), F.lit("dataset"))),
    ]
    clean = F.transform(F.array_compact(F.array(*made)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: x != "")), 1, limit)


def goal_year(goal: Column) -> Column:
    """The last year from 1900 to 2199 that a goal names."""
    return F.try_element_at(F.regexp_extract_all(goal, F.lit(YEAR), F.lit(1)), F.lit(-1)).cast("int")


def adapter_urls(goal: Column) -> Column:
    """URLs of the known pages for a goal, each once."""
    low, domain, entity = F.lower(goal), domain_intent(goal), entity_intent(goal)
    parts = []
    for _, groups, of_domain, of_entity, year, urls in ADAPTERS:
        fits = holds(low, groups)
        fits = fits & (domain == of_domain) if of_domain else fits
        fits = fits & (entity == of_entity) if of_entity else fits
        y = F.coalesce(goal_year(goal), F.lit(year or None).cast("int"))
        made = []
        for u in urls:
            c = F.lit(u)
            for mark, value in (("{y}", y), ("{p}", y - 1), ("{s}", F.right(y.cast("string"), F.lit(2)))):
                c = F.replace(c, F.lit(mark), value.cast("string")) if mark in u else c
            made.append(c)
        parts.append(F.when(fits, F.array(*made)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.array(*parts)))


def _query(c: Column) -> Column:
    """A text as a query's value: spaces as plus signs."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def places(goal: Column) -> Column:
    """General places to look, with the type of page and the family of source."""
    domain, entity = domain_intent(goal), entity_intent(goal)
    out = []
    for url, kind, family, domains, entities in PLACES:
        u = F.replace(F.replace(F.lit(url), F.lit("{l}"), _query(F.concat(goal, F.lit(" list")))), F.lit("{q}"), _query(goal)) if "{" in url else F.lit(url)
        fits = F.lit(not domains and not entities) | (domain.isin(*domains) if domains else F.lit(False)) | (entity.isin(*entities) if entities else F.lit(False))
        out.append(F.when(fits, F.struct(u.alias("url"), F.lit(kind).alias("type"), F.lit(family).alias("family"))))
    return F.array_compact(F.array(*out))


def discover(goals: DataFrame, goal: str = "goal", memory: DataFrame | None = None, forbidden: tuple[str, ...] = (), limit: int = 12) -> DataFrame:
    """goals with `candidates`, in order: what memory has for them (goal, urls), known pages, general places; distinct URLs,
    none that is stale or forbidden, `limit` at most."""
    known = F.transform(adapter_urls(F.col(goal)), lambda u: F.struct(u.alias("url"), F.when(any_of(u, STATE_PAGES), "react_state").otherwise("html_table").alias("type"), F.lit("adapter").alias("family")))
    out = goals
    first = F.array().cast(CANDIDATES)
    if memory is not None:
        out = out.join(memory.select(F.col("goal").alias("__goal"), F.col("urls").alias("__urls")), F.col(goal) == F.col("__goal"), "left").drop("__goal")
        first = F.transform(F.coalesce("__urls", F.array().cast("array<string>")), lambda u: F.struct(u.alias("url"), F.lit("html_table").alias("type"), F.lit("memory").alias("family")))
    everything = F.concat(first, known.cast(CANDIDATES), places(F.col(goal)).cast(CANDIDATES))
    bad = (*STALE, *(f.lower() for f in forbidden))
    trimmed = F.transform(everything, lambda x: F.struct(F.trim(x["url"]).alias("url"), x["type"].alias("type"), x["family"].alias("family")))
    out = out.withColumn("__fresh", F.filter(trimmed, lambda x: (x["url"] != "") & ~any_of(F.lower(x["url"]), bad)))
    first_of = F.filter("__fresh", lambda x, i: F.array_position(F.transform("__fresh", lambda y: y["url"]), x["url"]) == i + 1)
    return out.withColumn("candidates", F.slice(first_of, 1, limit)).drop("__urls", "__fresh")


def expand(goals: DataFrame, given: str, blocked: DataFrame | None = None, **more) -> DataFrame:
    """goal, n, url: given URLs (an array column), then what is discovered; http(s) only, each once, without blocked domains."""
    found = discover(goals, **more)
    urls = F.array_distinct(F.concat(F.coalesce(given, F.array().cast("array<string>")), F.transform("candidates", lambda x: x["url"])))
    rows = found.select("goal", F.posexplode(urls).alias("n", "url")).filter(F.col("url").rlike("^https?://"))
    if blocked is not None:
        rows = rows.withColumn("domain", root_domain(F.col("url"))).join(blocked.select("domain"), "domain", "left_anti").drop("domain")
    return rows


def demo_of(goal: Column) -> Column:
    """Which made-up table a goal may start with, if any."""
    domain, entity, low = domain_intent(goal), entity_intent(goal), F.lower(goal)
    out = F.lit(None).cast("string")
    for name, of_domain, of_entity, phrases in reversed(DEMOS):
        fits = domain == of_domain
        fits = fits & (entity == of_entity) if of_entity else fits
        out = F.when(fits & (any_of(low, phrases) if phrases else F.lit(True)), name).otherwise(out)
    return out


def literal_table(spark: SparkSession, records: list[dict], source: str) -> tuple[DataFrame, dict[str, str]]:
    """A table of a few given records with its source in each row, and where its columns come from."""
    names = list(dict.fromkeys(k for r in records for k in r))
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], names).withColumn("source_url", F.lit(source))
    return df, {n: source for n in (*names[1:], "source_url")}


def seed_url(url: Column, goal: Column) -> Column:
    """A page that yields little replaced by a better one of its site, for the season that it or the goal names."""
    part, season, better = REPLACED
    year = F.coalesce(F.nullif(F.regexp_extract(url, season, 1), F.lit("")).cast("int"), goal_year(goal))
    named = F.concat(F.lit(f"{better}?Season="), (year - 1).cast("string"), F.lit("-"), F.right(year.cast("string"), F.lit(2)))
    return F.when(F.contains(F.lower(url), F.lit(part)), F.coalesce(named, F.lit(better))).otherwise(url)
