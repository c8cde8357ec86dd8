"""Ranking of sources, limits per domain, fetch health, fail-fast runs, and the memory of goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions.text import any_of, host, normalize_url, root_domain

#: Points of trusted hosts (the first that fits counts), of signals in host and path, and of families.
TRUSTED = {
    "wikipedia.org": 5, "ncaa.com": 5, "sec.gov": 5, "data.gov": 5, "census.gov": 5, "notebookcheck.net": 5, "nanoreview.net": 4,
    "sports-reference.com": 4, "fortune.com": 3, "forbes.com": 2,
}
SIGNALS = {
    "list": 4, "stats": 5, "ranking": 4, "rankings": 4, "table": 4, "directory": 4, "leaders": 4, "salary": 4, "salaries": 4,
    "dataset": 4, "data": 3, "api": 4, "fortune500": 5, "fortune-500": 5, "season": 3, "companies": 3, "laptop": 3, "notebook": 3,
}
BAD_SIGNALS = {
    "search": -4, "login": -6, "signup": -6, "subscribe": -4, "video": -3, "podcast": -3, "reviews": -2, "article": -2, "news": -3,
    "/news/": -3, "/story/": -3, "statbunker.com": -10, "nanoreview.net/en/laptop-list": -8,
}
GENERIC_HOMES = ("statbunker.com", "forbes.com", "notebookcheck.net")
FAMILIES = {"memory": 7, "adapter": 6, "official_dataset": 7, "aggregator": 5, "reference_list": 4, "publisher_list": 1, "search": -8}
FAIL_FAST = ("http_403", "http_429", "anti_bot", "network_error", "http_error", "browser_error")


def url_score(url: Column, goal: str = "", preferred: tuple[str, ...] = (), queries: tuple[str, ...] = (), family: Column | None = None) -> Column:
    """Points of a normalised URL by its host, path and goal; health is added by `rank`."""
    import re

    h = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1))
    path = F.lower(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1))
    full = F.concat(h, path)
    trusted = F.lit(0)
    for domain, points in reversed(TRUSTED.items()):
        trusted = F.when(h.contains(domain), points).otherwise(trusted)
    score = trusted
    for token, points in {**SIGNALS, **BAD_SIGNALS}.items():
        score = score + F.when(full.contains(token), points).otherwise(0)
    for token in sorted(set(re.findall(r"[a-z0-9]+", goal.lower()))):
        score = score + F.when(full.contains(token), 1).otherwise(0)
    home = path.isin("", "/") & h.contains(".")
    score = score - F.when(home, 3).otherwise(0) - F.when(home & any_of(h, GENERIC_HOMES), 3).otherwise(0)
    if family is not None:
        points = F.create_map(*[x for k, v in FAMILIES.items() for x in (F.lit(k), F.lit(v))])
        score = score + F.coalesce(points[family], F.lit(0))
    if preferred:
        score = score + F.when(any_of(h, preferred), 3).otherwise(0)
    matched = F.lit(0)
    for query in queries:
        words = [w for w in re.findall(r"[a-z0-9]+", query.lower()) if len(w) >= 4]
        if words:
            matched = matched + (sum((full.contains(w).cast("int") for w in words), F.lit(0)) >= 2).cast("int")
    return score + F.least(matched, F.lit(2)) * 2


def rank(urls: DataFrame, goal: str, health: DataFrame | None = None, **context) -> DataFrame:
    """Distinct normalised http(s) URLs with score; who needs an order (`top_sources`, `cap_per_domain`) sorts by score and URL.

    health (domain, penalty, cooldown): its penalty is taken off, and 20 more of a domain that cools down.
    """
    known = urls.select(normalize_url(F.col("url")).alias("url")).filter("url <> ''").distinct()
    out = known.withColumn("score", url_score(F.col("url"), goal, **context))
    if health is not None:
        out = out.withColumn("domain", root_domain(F.col("url"))).join(health.select("domain", "penalty", "cooldown"), "domain", "left")
        out = out.withColumn("score", F.col("score") - F.coalesce("penalty", F.lit(0)) - F.when(F.col("cooldown"), 20).otherwise(0)).select("url", "score")
    return out


def top_sources(ranked: DataFrame, k: int = 12) -> DataFrame:
    return ranked.orderBy(F.desc("score"), "url").limit(k)


def cap_per_domain(ranked: DataFrame, cap: int, blocked: DataFrame | None = None) -> DataFrame:
    """At most cap URLs of each root domain, the best ones; blocked (domain) takes domains out first."""
    rows = ranked.withColumn("domain", root_domain(F.col("url")))
    if blocked is not None:
        rows = rows.join(blocked.select("domain"), "domain", "left_anti")
    w = Window.partitionBy("domain").orderBy(F.desc("score"), "url")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap)


def domain_cap(target_records: int) -> int:
    return 4 if target_records <= 60 else 2


def health_of(fetches: DataFrame, extractions: DataFrame | None = None) -> DataFrame:
    """Counters per root domain from fetches (domain, ok, reason, text) and extractions (domain, records, success, reason).

    With penalty (6 a hard failure, 8 a block, 2 a soft one, less for successes and records), cooldown and known_bad.
    """
    bad = ~F.col("ok")
    block, hard = F.col("reason").isin("http_403", "http_429", "anti_bot"), F.col("reason").isin("network_error", "http_error", "browser_error")
    n = lambda c, name: F.count_if(c).alias(name)
    out = fetches.filter("domain <> ''").groupBy("domain").agg(
        F.count(F.lit(1)).alias("attempts"), n(F.col("ok"), "fetch_successes"), n(F.col("ok") & (F.trim(F.coalesce("text", F.lit(""))) == ""), "empty_results"),
        n(bad & block, "anti_bot_failures"), n(bad & (block | hard), "hard_failures"), n(bad & ~block & ~hard, "soft_failures"),
    )
    zero = ["successes", "records", "soft_more"]
    if extractions is None:
        out = out.withColumns({c: F.lit(0).cast("long") for c in zero})
    else:
        soft = F.col("reason").isin("no_tables", "empty_content", "schema_mismatch")
        more = extractions.filter("domain <> ''").groupBy("domain").agg(n(F.col("success"), "successes"), F.sum(F.greatest("records", F.lit(0))).alias("records"), n(~F.col("success") & soft, "soft_more"))
        out = out.join(more, "domain", "full").na.fill(0)
    out = out.withColumn("soft_failures", F.col("soft_failures") + F.col("soft_more")).drop("soft_more")
    penalty = F.col("hard_failures") * 6 + F.col("anti_bot_failures") * 8 + F.col("soft_failures") * 2 + F.least("empty_results", F.lit(3))
    penalty = penalty - F.least("successes", F.lit(3)) * 2 - F.least(F.floor(F.col("records") / 25), F.lit(4)) * 2
    cooldown = (F.col("anti_bot_failures") >= 2) | (F.col("hard_failures") >= 3)
    known_bad = (F.col("anti_bot_failures") >= 1) | (F.col("hard_failures") >= 2)
    return out.withColumns({"penalty": penalty, "cooldown": cooldown, "known_bad": known_bad})


#: Pieces that the positions of a log are cut into when runs are looked for, and rows of a key up to which it isn't cut.
PIECES, WHOLE = 256, 1_000_000


def rejection_runs(log: DataFrame, key: str, pos: str, rejected: Column, threshold: int = 3) -> DataFrame:
    """Per key the longest run of rejections in a row, and whether it reaches the threshold: gaps and islands.

    Positions are numbers. If a key has more than WHOLE rows, runs are counted within pieces of the log, of which no
    task sees more than one for a key; then the pieces of a key are put together by the rejections that each begins
    and ends with. Else one shuffle by key does.
    """
    per = log.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("a"), F.max(pos).alias("b"))
    span = per.agg(F.max("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).first()
    if (span["n"] or 0) <= WHOLE:
        rows = log.select(key, pos, F.coalesce(rejected, F.lit(False)).cast("int").alias("bad"))
        rows = rows.withColumn("island", F.sum(1 - F.col("bad")).over(Window.partitionBy(key).orderBy(pos)))
        return rows.groupBy(key, "island").agg(F.sum("bad").alias("run")).groupBy(key).agg(F.max("run").alias("longest")).withColumn("abort", F.col("longest") >= threshold)
    width = max(1, (int(span["b"]) - int(span["a"])) // PIECES + 1) if span["a"] is not None else 1
    rows = log.select(key, pos, F.floor((F.col(pos) - F.lit(span["a"])) / width).alias("piece"), F.coalesce(rejected, F.lit(False)).cast("int").alias("bad"))
    rows = rows.withColumn("island", F.sum(1 - F.col("bad")).over(Window.partitionBy(key, "piece").orderBy(pos)))
    runs = rows.groupBy(key, "piece", "island").agg(F.sum("bad").alias("run"))
    # the first island has what comes before any other row, the last what comes after all of them
    ends = runs.groupBy(key, "piece").agg(
        F.max("run").alias("longest"), F.max("island").alias("others"), F.max(F.when(F.col("island") == 0, F.col("run"))).alias("head"), F.max_by("run", "island").alias("tail"),
    )
    by_piece = Window.partitionBy(key).orderBy("piece")  # PIECES rows at most
    ends = ends.withColumn("block", F.sum((F.col("others") > 0).cast("int")).over(by_piece))
    before = F.sum("tail").over(Window.partitionBy(key, "block").orderBy("piece"))
    ends = ends.withColumn("open", before).withColumn("met", F.coalesce(F.lag("open").over(by_piece), F.lit(0)) + F.coalesce("head", F.lit(0)))
    longest = F.max(F.greatest("longest", "met")).alias("longest")
    return ends.groupBy(key).agg(longest).withColumn("abort", F.col("longest") >= threshold)


def similar_sources(memory: DataFrame, goal: dict, limit: int = 6) -> DataFrame:
    """place, url: URLs that served goals like this one, best goals first, each URL once.

    memory: goal, domain_intent, entity_intent, target_hint, feature_hints and urls (arrays).
    """
    hints = F.array(*[F.lit(h) for h in goal["feature_hints"]]).cast("array<string>")
    score = (
        F.when(F.col("domain_intent") == goal["domain_intent"], 5).otherwise(0)
        + F.when(F.col("entity_intent") == goal["entity_intent"], 4).otherwise(0)
        + F.when((F.col("target_hint") != "") & (F.col("target_hint") == F.lit(goal["target_hint"])), 5).otherwise(0)
        + F.size(F.array_intersect("feature_hints", hints)) * 2
    )
    urls = memory.withColumn("score", score).filter("score > 0").select("score", "goal", F.posexplode("urls").alias("n", "url"))
    best = urls.groupBy("url").agg(F.min(F.struct((-F.col("score")).alias("s"), "goal", "n")).alias("at"))
    first = best.orderBy("at", "url").limit(limit)
    w = Window.orderBy("at", "url")  # over `limit` rows
    return first.select(F.row_number().over(w).alias("place"), "url")


def remember(memory: DataFrame, entry: DataFrame, pos: str, most: int = 50) -> DataFrame:
    """memory with entry in the place of the same goal's, or at the end; only the last `most` stay."""
    old = memory.join(entry.select("goal", F.lit(True).alias("__new")), "goal", "left")
    place = memory.join(entry.select("goal"), "goal", "left_semi").agg(F.max(pos).alias("__p"))
    end = memory.agg((F.coalesce(F.max(pos), F.lit(0)) + 1).alias("__e"))
    fresh = entry.join(F.broadcast(place)).join(F.broadcast(end)).withColumn(pos, F.coalesce("__p", "__e")).drop("__p", "__e")
    all_ = old.filter("__new is null").drop("__new").unionByName(fresh)
    return all_.orderBy(F.desc(pos)).limit(most)
