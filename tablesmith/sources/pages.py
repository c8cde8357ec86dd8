"""Pages as text: fetch outcomes, document text, lines of directory snapshots, page state."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions.text import NUMBER, any_of, middle_truncate, strip
from tablesmith.session import ship

#: What blocking pages say, and what is left out of lines, pages and documents.
ANTI_BOT = (
    "verify you are human", "enable javascript and cookies", "just a moment", "access denied", "cf-browser-verification",
    "cf-challenge", "why do i have to complete a captcha",
)
BLOCKED_LINES = (
    "jump to content", "main menu", "search wikipedia", "create account", "log in", "donate", "help", "navigation", "button",
    "searchbox", "combobox", "radio", "appearance", "page tools", "personal tools", "site", "views", "tools", "automatic", "dark",
    "light", "enabled", "disabled", "thumbnail for", "request that a redirect be created", "create a draft and submit it for review",
)
BLOCKED_STARTS = ("button", "menu", "sign in", "subscribe", "navigation", "searchbox")
BLOCKED_PAGES = ("search results", "search wikipedia", "create account", "request that a redirect be created", "results for")
POSITIVE_PAGES = ("list of", "teams", "schools", "companies", "directory", "standings", "rankings", "roster")
DOCUMENT_CHROME = ("cookie policy", "privacy policy", "accept cookies", "sign in", "log in", "jump to content", "main menu")
REFERENCE = r"(?i)@?(e\d+)\b"
TABLE_SIGNAL = r"(?i)\b(row|cell|columnheader|table|listitem)\b"
LINK, HEADING, ADDRESS = r'(?i)link\s+"([^"]+)"\s+\[ref=(e\d+)\]', r'(?i)heading\s+"([^"]+)"', r"(?i)https?://\S+"
LINE_PARTS = ((REFERENCE, ""), (r"(?i)https?://\S+", ""), (r"\[[^\]]*\]", ""))
LINE_ROLES, STATE_ROLES, LINE_ENDS = r"(?i)^(?:link|heading|listitem|row|cell)\s+", r"(?i)^(?:link|heading|listitem|row|cell|button)\s+", r"""^[ \-|:\t"']+|[ \-|:\t"']+$"""
#: What page states are about: blocking phrases, phrases and beginnings that a summary leaves out, roles of lines,
#: points of a line, the least that it needs, and the most lines and characters of a summary; most headings, links and table lines.
STATE_BLOCKED = ("search results", "verify you are human", "cloudflare", "just a moment", "create account", "log in", "request that a redirect be created")
SUMMARY_BLOCKED = ("navigation item", "main menu", "jump to content", "create account", "log in", "search")
SUMMARY_STARTS = ("button ", "textbox ", "searchbox ", "menuitem ")
ROLES = ("link", "button", "textbox", "heading", "row", "cell", "listitem")
SUMMARY_POINTS, SUMMARY_LEAST, SUMMARY_LINES, SUMMARY_CHARS = (5, 4, 3, 1, 1, 1), 3, 30, 2500
HEADINGS, LINKS, TABLE_LINES = 20, 40, 30
#: What pages of search results say, words of a goal that say nothing, words and points of lists, links that are never
#: followed, and actions that scroll.
RESULTS, PLAIN_WORDS, LIST_WORDS, LIST_POINTS = "search results", ("build", "dataset", "data", "of", "the", "and", "for", "a"), "list of", 5
UNFOLLOWED, SCROLLS = ("donate", "help", "create account", "log in"), ("scroll_down", "scroll_up")
#: Phrases of pages that ask for a proof of being human; the site of the statistics service, and its two tables.
VERIFICATION = ("cloudflare", "verify you are human", "just a moment", "enable javascript and cookies")
STATS_SITE, STATS_PART, PLAYER_PARTS = "nba.com", "/stats", ("/players/", "player")
STATS_TABLES = ("https://stats.nba.com/stats/leaguedashplayerstats", "https://stats.nba.com/stats/leaguedashteamstats")
STATS_SEASON, STATS_KIND = "2025-26", "Regular Season"


def _lines(text: str | None) -> str | None:
    """Lines of text whose entities are read: white space collapsed, short ones, page furniture and repeats left out."""
    kept: dict[str, str] = {}
    for raw in html.unescape(text or "").splitlines():
        line = " ".join(raw.split())
        low = line.lower()
        if len(line) > 2 and not any(p in low for p in DOCUMENT_CHROME):
            kept.setdefault(low, line)
    return "\n".join(kept.values())


@cache
def _reader():
    @F.arrow_udf("string")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(map(_lines, column.to_pylist()), pa.string())

    return read


def fetch_reason(status: Column, body: Column) -> Column:
    """Why a fetch failed, or `success`: 403, 429, blocking text, other errors, empty body, in this order."""
    low = F.lower(F.coalesce(body, F.lit("")))
    return (
        F.when(status == 403, "http_403").when(status == 429, "http_429").when(any_of(low, ANTI_BOT), "anti_bot")
        .when(status >= 400, "http_error").when(strip(low) == "", "empty_content").otherwise("success")
    )


def failure_reason(status: Column, browser: Column) -> Column:
    """Why a fetch raised an error: its status if there is one, else the browser or the network."""
    coded = F.when(status == 403, "http_403").when(status == 429, "http_429").otherwise("http_error")
    return F.when(status.isNotNull(), coded).when(F.coalesce(browser, F.lit(False)), "browser_error").otherwise("network_error")


def batch_stats(fetches: DataFrame) -> DataFrame:
    """One row about a batch of fetches (url, ok, reason, written): URLs given, distinct, repeated, handled and failed, artifacts,
    and failures by reason."""
    whole = fetches.agg(
        F.count("url").alias("input_urls"), F.count_distinct("url").alias("unique_urls"), F.count_if("ok").alias("handled_urls"),
        F.count_if(~F.col("ok")).alias("failed_urls"), F.count_if("written").alias("artifacts_written"),
    ).withColumn("deduped_urls", F.col("input_urls") - F.col("unique_urls"))
    by = fetches.filter(~F.col("ok")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))  # a row for each reason
    by = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("failed_by_reason"))
    return whole.crossJoin(F.broadcast(by))  # one row each


def needs_verification(text: Column) -> Column:
    """Whether a snapshot asks for a proof of being human."""
    return any_of(F.lower(text), VERIFICATION)


#: Fixed value: what ends a line of a text.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def signature(text: Column, lines: int = 25) -> Column:
    """Struct of a snapshot's first lines, and its length with a hash of all its lines: what tells whether it has changed."""
    own = snapshot_lines(text)
    whole = F.array_join(own, "\n")
    return F.struct(F.array_join(F.slice(own, 1, lines), "\n").alias("head"), F.concat_ws(":", F.length(whole), F.xxhash64(whole)).alias("material"))


def snapshot_lines(text: Column) -> Column:
    """A snapshot's lines that aren't blank, without outer white space."""
    return F.filter(F.transform(F.split(text, LINE_END), strip), lambda x: x != "")


def stats_request(url: Column) -> Column:
    """Struct of endpoint, season and season_type that a page of the statistics service stands for; null for other pages."""
    low, year = F.lower(url), F.regexp_extract(url, r"\b(20\d{2})\b", 1)
    own = F.regexp_extract(low, "^[a-z]+://([^/?#:]*)", 1).endswith(STATS_SITE) & F.contains(low, F.lit(STATS_PART))
    named = F.nullif(F.regexp_extract(url, r"(?i)[?&]season=(\d{4}-\d{2})", 1), F.lit(""))
    of_year = F.when(year != "", F.concat((year.try_cast("int") - 1).cast("string"), F.lit("-"), F.right(year, F.lit(2))))
    kind = F.replace(F.nullif(F.regexp_extract(url, r"(?i)[?&]seasontype=([^&]+)", 1), F.lit("")), F.lit("+"), F.lit(" "))
    table = F.when(any_of(low, PLAYER_PARTS), STATS_TABLES[0]).otherwise(STATS_TABLES[1])
    return F.when(own, F.struct(table.alias("endpoint"), F.coalesce(named, of_year, F.lit(STATS_SEASON)).alias("season"), F.coalesce(kind, F.lit(STATS_KIND)).alias("season_type")))


def result_rows(payloads: DataFrame, column: str, *keep: str) -> DataFrame:
    """keep, set, n, cells (a map from header to text): the rows of the result sets in a statistics service's answer."""
    sets = F.from_json(column, "struct<resultSets array<struct<name string, headers array<string>, rowSet array<array<string>>>>>")["resultSets"]
    one = payloads.select(*keep, F.explode(sets).alias("s")).select(*keep, F.col("s.name").alias("set"), "s.headers", F.posexplode("s.rowSet").alias("n", "row"))
    return one.filter(F.size("headers") == F.size("row")).select(*keep, "set", "n", F.map_from_arrays("headers", "row").alias("cells"))


def env_values(lines: Column) -> Column:
    """Map of names and values of lines `name=value`: comments and lines without a sign left out, outer quotes off, the last value of a name."""
    own = F.filter(snapshot_lines(lines), lambda x: ~x.startswith("#") & F.contains(x, F.lit("=")))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.regexp_replace(strip(F.regexp_replace(x, "^[^=]*=", "")), r"""^['"]+|['"]+$""", "").alias("v"))
    pairs = F.transform(own, pair)
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def artifact(status: Column, url: Column, body: Column, most: int = 200_000) -> Column:
    """What is kept of a fetch: body cut to `most` characters, whether it was, status from 100 to 599, http(s) URL or null."""
    return F.struct(
        F.when(url.rlike("^https?://[^/]+"), url).alias("url"), F.when(status.between(100, 599), status).alias("status"),
        F.substring(body, 1, most).alias("body"), (F.length(body) > most).alias("truncated"),
    )


def document_text(pages: DataFrame, column: str, into: str = "text", most: int = 24_000) -> DataFrame:
    """pages with the lines of each one's text: markup gone, entities read, short lines, page furniture and repeats left out, the middle cut."""
    ship(pages.sparkSession)
    t = F.regexp_replace(F.coalesce(column, F.lit("")), r"(?is)<script\b[^>]*>.*?</script>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?is)<style\b[^>]*>.*?</style>", " "), "<[^>]+>", "\n")
    read = pages.withColumn(into, _reader()(t))
    return read.withColumn(into, middle_truncate(F.col(into), most, "\n...[truncated]...\n"))


def lines_of(snapshots: DataFrame, column: str, *keep: str) -> DataFrame:
    """keep, line_no, line of the lines that aren't blank."""
    return snapshots.select(*keep, F.posexplode(F.split(column, LINE_END)).alias("line_no", "line")).withColumn("line", strip(F.col("line"))).filter("line <> ''")


def clean_line(line: Column, roles: str = LINE_ROLES) -> Column:
    """A line without references, URLs, bracketed parts and its leading role."""
    for pattern, by in LINE_PARTS:
        line = F.regexp_replace(line, pattern, by)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(line, roles, ""), r"\s+", " "), LINE_ENDS, "")


def page_state(snapshots: DataFrame, column: str, *keep: str) -> DataFrame:
    """keep, and of each snapshot: title, summary, headings, links (ref, role, label, url), table_lines, blocked, row_signals, lines.

    Lines stay arrays of their snapshot, so nothing is shuffled. What the parts ask of a line is found once for each line.
    The summary takes lines by points, as long as there is room for them, and shows them in the page's order.
    """
    text = F.coalesce(column, F.lit(""))  # a null snapshot has no lines
    group = lambda x, p, i=1: F.regexp_extract(x, p, i)

    def read(x: Column) -> Column:
        return F.struct(
            x.alias("line"), F.lower(x).alias("low"), clean_line(x, STATE_ROLES).alias("clean"), x.rlike(HEADING).alias("heading"),
            x.rlike(TABLE_SIGNAL).alias("table"), x.rlike(LINK).alias("link"), x.rlike(REFERENCE).alias("ref"),
        )

    rows = snapshots.select(*keep, F.lower(text).alias("low"), F.transform(snapshot_lines(text), read).alias("own"))

    def element(x: Column) -> Column:
        role = F.lit("element")
        for r in reversed(ROLES):
            role = F.when(x["low"].startswith(r), r).otherwise(role)
        ref = F.when(x["link"], group(x["line"], LINK, 2)).otherwise(F.lower(group(x["line"], REFERENCE)))
        label = F.when(x["link"], strip(group(x["line"], LINK))).otherwise(x["clean"])
        url = F.nullif(group(x["line"], ADDRESS, 0), F.lit(""))
        return F.struct(F.concat(F.lit("@"), ref).alias("ref"), F.when(x["link"], "link").otherwise(role).alias("role"), label.alias("label"), url.alias("url"))

    def points(x: Column) -> Column:
        size = F.size(F.split(x["clean"], r"\s+"))
        holds = (x["heading"], x["table"], x["link"], x["ref"], x["clean"].rlike(r"\d"), (size >= 6) & (size <= 18))
        return sum((F.when(h, n).otherwise(0) for h, n in zip(holds, SUMMARY_POINTS, strict=True)), F.lit(0))

    starts = lambda low: reduce(lambda a, b: a | b, [low.startswith(s) for s in SUMMARY_STARTS])
    phrases = (*STATE_BLOCKED, *SUMMARY_BLOCKED)
    fits = F.filter("own", lambda x: (x["clean"] != "") & ~any_of(F.lower(x["clean"]), phrases) & ~starts(x["low"]))
    pointed = F.transform(fits, lambda x, i: F.struct((-points(x)).alias("less"), i.alias("i"), x["clean"].alias("line")))
    chosen = F.sort_array(F.filter(pointed, lambda x: x["less"] <= -SUMMARY_LEAST))
    start = F.struct(F.array().cast("array<struct<i int, line string>>").alias("got"), F.lit(0).alias("chars"))

    def take(so_far: Column, x: Column) -> Column:
        got = so_far["got"]
        chars = so_far["chars"] + F.length(x["line"]) + F.when(F.size(got) > 0, 1).otherwise(0)
        room = (F.size(got) < SUMMARY_LINES) & (chars <= SUMMARY_CHARS) & ~F.exists(got, lambda y: y["line"] == x["line"])
        return F.when(room, F.struct(F.concat(got, F.array(F.struct(x["i"].alias("i"), x["line"].alias("line")))).alias("got"), chars.alias("chars"))).otherwise(so_far)

    summary = F.array_join(F.transform(F.array_sort(F.aggregate(chosen, start, take)["got"]), lambda x: x["line"]), "\n")
    key = lambda x: F.struct(x["ref"], x["label"])
    none = F.array().cast("array<struct<ref string, role string, label string, url string>>")

    def add(got: Column, x: Column) -> Column:
        fresh = (F.size(got) < LINKS) & ~F.exists(got, lambda y: key(y) == key(x))  # an element meets LINKS others at most
        return F.when(fresh, F.concat(got, F.array(x))).otherwise(got)

    links = F.aggregate(F.transform(F.filter("own", lambda x: x["ref"]), element), none, add)
    headings = F.transform(F.slice(F.filter("own", lambda x: x["heading"]), 1, HEADINGS), lambda x: strip(group(x["line"], HEADING)))
    lines = F.array_distinct(F.transform(F.filter("own", lambda x: x["table"] & (x["clean"] != "")), lambda x: x["clean"]))
    signals = F.size(F.filter("own", lambda x: x["table"] | x["ref"]))
    rows = rows.select(
        *keep, "low", F.left(summary, F.lit(SUMMARY_CHARS)).alias("summary"), headings.alias("headings"), links.alias("links"),
        F.slice(lines, 1, TABLE_LINES).alias("table_lines"), signals.alias("row_signals"), F.size("own").alias("lines"),
    )
    blocked = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(p)), p) for p in STATE_BLOCKED]))
    title = F.coalesce(F.get("headings", F.lit(0)), F.get("links", F.lit(0))["label"])
    return rows.select(*keep, title.alias("title"), "summary", "headings", "links", "table_lines", blocked.alias("blocked"), "row_signals", "lines")


def is_candidate(line: Column) -> Column:
    """Whether a line looks like an entry of a directory."""
    low, text = F.lower(line), clean_line(line)
    starts = F.lit(False)
    for s in BLOCKED_STARTS:
        starts = starts | low.startswith(s)
    quotes = F.length(line) - F.length(F.regexp_replace(line, '"', ""))
    spaces = F.length(text) - F.length(F.regexp_replace(text, " ", ""))
    return (
        F.length(line).between(8, 220) & line.rlike(REFERENCE) & ~any_of(low, BLOCKED_LINES) & ~starts & (quotes >= 2)
        & (F.length(text) >= 5) & (spaces <= 10) & text.rlike(r"[A-Z][A-Za-z&.'-]+")
    )


def page_gate(snapshots: DataFrame, column: str, key: str) -> DataFrame:
    """key, candidates, extract: whether a snapshot is a useful directory page."""
    lines = lines_of(snapshots, column, key).groupBy(key).agg(F.count_if(is_candidate(F.col("line"))).alias("candidates"))
    low = F.lower(column)
    out = snapshots.join(lines, key, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    good = ~any_of(low, BLOCKED_PAGES) & (F.col("candidates") >= 5) & (any_of(low, POSITIVE_PAGES) | (F.col("candidates") >= 12))
    return out.select(key, "candidates", good.alias("extract"))


def directory_entries(snapshots: DataFrame, column: str, key: str) -> DataFrame:
    """key, line_no, name: entries of directory pages, each name of a page once, the first."""
    rows = lines_of(snapshots, column, key).filter(is_candidate(F.col("line"))).withColumn("name", clean_line(F.col("line")))
    rows = rows.filter(F.size(F.split("name", " ")).between(1, 8))
    return rows.groupBy(key, "name").agg(F.min("line_no").alias("line_no")).select(key, "line_no", "name")


def page_signals(snapshots: DataFrame, column: str, key: str) -> DataFrame:
    """key, lines, row_signals, table_lines: how much of a snapshot looks like rows."""
    rows = lines_of(snapshots, column, key)
    table = F.col("line").rlike(TABLE_SIGNAL)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("lines"), F.count_if(table | F.col("line").rlike(REFERENCE)).alias("row_signals"), F.count_distinct(F.when(table, F.nullif(clean_line(F.col("line")), F.lit("")))).alias("table_lines"))


def best_link(states: DataFrame, goal: str) -> DataFrame:
    """states (of `page_state`) with `follow`, the reference of the link that suits a goal best, the first among equals: on pages of
    search results only, and null where no link says anything."""
    words = sorted(set(re.findall(r"[a-z0-9]+", goal.lower())) - set(PLAIN_WORDS))

    def points(label: Column) -> Column:
        low = F.lower(label)
        score = F.when(F.contains(low, F.lit(LIST_WORDS)), LIST_POINTS).otherwise(0) + sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
        return F.when(any_of(low, UNFOLLOWED), -1).otherwise(score)

    scored = F.transform("links", lambda x, i: F.struct(points(x["label"]).alias("points"), (-i).alias("place"), x["ref"].alias("ref")))
    best = F.array_max(scored)
    results = F.contains(F.lower("summary"), F.lit(RESULTS)) | F.array_contains("blocked", RESULTS)
    return states.withColumn("follow", F.when(results & (best["points"] > 0), best["ref"]))


def action(kind: Column, target: Column, value: Column) -> Column:
    """Struct of an action's target and value as they are meant, and whether the action is well formed."""
    scrolls = kind.isin(*SCROLLS)
    number = F.when(value.rlike(NUMBER), value.try_cast("double"))
    value = F.when((value == "") | (scrolls & (F.floor(number) <= 0)), None).otherwise(value)
    moved = (kind == "open_url") & target.isNull() & value.rlike("^https?://")
    aim = F.when(moved, value).when(scrolls & target.isin("page", "document"), None).otherwise(target)
    value = F.when(~F.coalesce(moved, F.lit(False)), value)
    on_element, address = aim.startswith("@e"), aim.rlike("^https?://")
    number = F.when(value.rlike(NUMBER), value.try_cast("double"))
    good = (
        F.when(kind == "none", aim.isNull() & value.isNull()).when(kind == "click", on_element & value.isNull()).when(kind == "type", on_element & value.isNotNull())
        .when(kind == "open_url", address & value.isNull()).when(kind == "wait", aim.isNull() & (value.isNull() | (number >= 0)))
        .when(scrolls, aim.isNull() & (value.isNull() | (F.floor(number) > 0)))
    )
    return F.struct(aim.alias("target"), value.alias("value"), F.coalesce(good, F.lit(False)).alias("valid"))


def tail(log: DataFrame, pos: str, n: int) -> DataFrame:
    """The last n lines, n from 1 to 500, in order."""
    return log.orderBy(F.desc(pos)).limit(max(1, min(n, 500))).orderBy(pos)


def first_per_url(targets: DataFrame, pos: str) -> DataFrame:
    w = Window.partitionBy("url").orderBy(pos)
    return targets.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
