"""Tables of HTML pages: cells, headers, pages of a series, side-by-side tables and paired summaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html import unescape
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablesmith.functions.text import MISSING, clean_cell, is_numeric_like, missing, parse_money, strip
from tablesmith.operators.columns import normalize, unique
from tablesmith.operators.matching import map_headers
from tablesmith.session import ship

#: Words that show that a first row is a header.
BUILDER_WORDS = ("name", "player", "team", "salary", "company", "bank", "state", "club")
EXTRACTOR_WORDS = ("name", "team", "school", "player", "company", "conference")
#: Most rows and columns that one cell covers, by the HTML standard.
SPANS = {"rowspan": 65534, "colspan": 1000}
CELLS = "table_idx int, row_idx int, col_idx int, header boolean, text string"


#: Comments, scripts and styles (which hold no markup), other tags with their attributes, and attributes.
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.DOTALL | re.IGNORECASE)
_SPANS = re.compile(r"""\b(rowspan|colspan)\s*=\s*["']?\s*(\d+)""", re.IGNORECASE)


#: Rows that a task hands on at a time.
BATCH = 2000


def _rows_in(html: str) -> Iterator[tuple[int, list[dict]]]:
    """(table, cells) of each row that has cells, once it is whole; a cell has text, header, head, rows, cols.

    Tables, nested ones apart, are numbered as they begin. Only the rows of open tables are held.
    """
    open_: list[dict] = []
    begun = at = 0
    for m in _TOKEN.finditer(html):
        if open_ and open_[-1]["cell"] and m.start() > at:
            open_[-1]["cell"]["text"].append(html[at : m.start()])
        at = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            continue
        if tag == "table":
            if not m.group(2):
                open_.append({"number": begun, "row": [], "cell": None, "head": False})
                begun += 1
            elif open_:
                t = open_.pop()
                if t["row"]:
                    yield t["number"], t["row"]
        elif not open_:
            continue
        elif tag in ("thead", "tbody", "tfoot"):
            open_[-1]["head"] = tag == "thead" and not m.group(2)
        elif tag in ("td", "th"):
            t = open_[-1]
            t["cell"] = None
            if not m.group(2):
                spans = {k.lower(): max(1, min(SPANS[k.lower()], int(v))) for k, v in _SPANS.findall(m.group(4))} if m.group(4) else {}
                t["cell"] = {"text": [], "header": tag == "th", "head": t["head"], "rows": spans.get("rowspan", 1), "cols": spans.get("colspan", 1)}
                t["row"].append(t["cell"])
        elif tag == "tr" and not m.group(2):
            t = open_[-1]
            row, t["row"], t["cell"] = t["row"], [], None
            if row:
                yield t["number"], row
        elif tag == "br" and open_[-1]["cell"]:
            open_[-1]["cell"]["text"].append(" ")
    for t in open_:
        if t["row"]:
            yield t["number"], t["row"]


def _cells_in(html: str) -> Iterator[tuple[int, int, list[tuple]]]:
    """(table, row, cells as (column, header, text)) of each row; a cell that spans is repeated in each place it covers.

    A cell covers as many rows and columns as the standard allows (SPANS) at most. Header rows are those in a thead, and
    rows of th cells before any other row.
    """
    known: dict[int, dict] = {}
    for number, row in _rows_in(html):
        t = known.setdefault(number, {"row": 0, "late": {}, "body": False})
        i, late = t["row"], t["late"]  # late: of each column, where cells above end and their texts, the nearest end last
        t["row"] += 1
        heading = all(c["header"] for c in row) and not t["body"] or all(c["head"] for c in row)
        t["body"] |= not heading
        for c in list(late):
            while late[c] and late[c][-1][0] <= i:
                late[c].pop()
            if not late[c]:
                del late[c]
        full, at = {c: x[-1][1] for c, x in late.items()}, 0
        own: dict[int, tuple[bool | None, str]] = {c: (None, text) for c, text in full.items()}
        for cell in row:
            while at in full:
                at += 1
            text = " ".join(unescape("".join(cell["text"])).split())
            for c in range(at, at + cell["cols"]):
                own[c] = heading, text
                if cell["rows"] > 1:
                    above, end = late.setdefault(c, []), i + cell["rows"]
                    while above and above[-1][0] <= end:
                        above.pop()
                    above.append((end, text))
            at += cell["cols"]
        yield number, i, [(c, *own[c]) for c in sorted(own)]


def parse_cells(html: str | None) -> list[tuple]:
    """(table, row, column, header, text) of all cells (`_cells_in`). A table without rows gives nothing."""
    found: dict[int, list[tuple]] = {}
    for number, r, cells in _cells_in(html or ""):
        found.setdefault(number, []).extend((r, *c) for c in cells)
    return [(place, *c) for place, number in enumerate(sorted(found)) for c in found[number]]


def cells_of(html: str | None) -> Iterator[tuple]:
    """What `parse_cells` gives, row by row: the page is read twice, as only its end tells which tables have rows."""
    places = {number: place for place, number in enumerate(sorted({number for number, _ in _rows_in(html or "")}))}
    for number, r, cells in _cells_in(html or ""):
        for c in cells:
            yield places[number], r, *c


def _streamed(pages: DataFrame, keep: tuple[str, ...], more: str, kinds: dict[str, pa.DataType], read: Callable[[str | None], Iterable[tuple]]) -> DataFrame:
    """keep and the columns of `more`: the rows that `read` gives for each page's html, handed on in batches, so that a task
    holds a page's text and not all its rows."""
    ship(pages.sparkSession)
    own = pages.select(*keep, "html")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(c) for c in keep), *(pa.field(n, k) for n, k in kinds.items())])
            for i in range(batch.num_rows):
                kept = [batch.column(c)[i].as_py() for c in keep]
                found = iter(read(batch.column("html")[i].as_py()))
                while part := list(islice(found, BATCH)):
                    columns = [[v] * len(part) for v in kept] + list(zip(*part, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

    return own.mapInArrow(rows, StructType([*own.drop("html").schema.fields, *StructType.fromDDL(more).fields]))


def html_cells(pages: DataFrame, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Cells of pages (url, html): keep, table_idx, row_idx, col_idx, header, text. Null pages and pages without tables give none."""
    kinds = {"table_idx": pa.int32(), "row_idx": pa.int32(), "col_idx": pa.int32(), "header": pa.bool_(), "text": pa.string()}
    return _streamed(pages, keep, CELLS, kinds, cells_of)


def absent_cell(text: str) -> bool:
    return text.strip().lower() in MISSING["empty_row"]


def rows_of(html: str | None, words: tuple[str, ...], fields: tuple[str, ...] = ()) -> Iterator[tuple[int, int, list[str], list[str | None]]]:
    """(table, row, names, values) of a page's data rows; with fields, each table's values in their order, as matched to its header.

    Several header rows are joined by column. If all headers are digits or missing, and the first row is informative
    enough and has one of the words, it becomes the header. Rows that repeat the header, and empty ones, are gone. The
    page is read twice: first for the tables' headers and widths, then for their rows.
    """
    known: dict[int, dict] = {}
    for number, r, cells in _cells_in(html or ""):
        t = known.setdefault(number, {"head": {}, "width": 0, "first": None})
        t["width"] = max(t["width"], cells[-1][0] + 1)
        for c, header, text in cells:
            if header:
                t["head"].setdefault(c, []).append(text)
        if t["first"] is None:
            body = {c: text for c, header, text in cells if not header}
            t["first"] = (r, body) if body else None
    for place, number in enumerate(sorted(known)):
        t = known[number]
        head, width, (at, body) = t["head"], t["width"], t["first"] or (None, {})
        names = [" ".join(head[c]) if c in head else None for c in range(width)]
        first = [body.get(c, "") for c in range(width)]
        plain = all(n is None or re.fullmatch(r"(?i)(\d+|unnamed.*)?", n.strip()) for n in names)
        told = sum(not absent_cell(x) for x in first)
        promoted = plain and told >= max(2, width // 2) and any(w in x.lower() for x in first for w in words)
        names = [f"unnamed_{c}" if n is None else n for c, n in enumerate(first if promoted else names)]
        match = map_headers(names, list(fields)) if fields else {}
        places = [names.index(match[f]) if f in match else None for f in fields] if fields else list(range(width))
        t |= {"place": place, "names": names, "low": [n.strip().lower() for n in names], "places": places, "header": at if promoted else None}
    for number, r, cells in _cells_in(html or ""):
        t = known[number]
        width, places = t["width"], t["places"]
        row = {c: text for c, header, text in cells if not header}
        if not row or r == t["header"] or all(k is None for k in places):
            continue
        values = [row.get(c, "") for c in range(width)]
        same = sum(v.strip().lower() == n != "" for v, n in zip(values, t["low"], strict=True))
        if same < max(2, width // 2) and not all(map(absent_cell, values)):
            yield t["place"], r, t["names"], [None if k is None else values[k] for k in places]


def _table_rows(pages: DataFrame, words: tuple[str, ...], fields: tuple[str, ...] = ()) -> DataFrame:
    kinds = {"table_idx": pa.int32(), "row_idx": pa.int32(), "names": pa.list_(pa.string()), "values": pa.list_(pa.string())}
    return _streamed(pages, ("url",), "table_idx int, row_idx int, names array<string>, values array<string>", kinds, lambda page: rows_of(page, words, fields))


def table_rows(pages: DataFrame, words: tuple[str, ...] = BUILDER_WORDS) -> DataFrame:
    """url, table_idx, row_idx, names, values: data rows of pages (url, html) with their table's header (`rows_of`).

    A page is parsed by itself, so nothing is shuffled.
    """
    return _table_rows(pages, words)


def table_frame(rows: DataFrame, url: str, table_idx: int) -> DataFrame:
    """One table as a DataFrame of text columns with normalised names, `_pos` and `_source_url`; columns without values are gone."""
    own = rows.filter((F.col("url") == url) & (F.col("table_idx") == table_idx))
    first = own.select("names").first()
    names = unique([normalize(n) or f"column_{i}" for i, n in enumerate(first["names"])]) if first else []
    out = own.select(F.col("row_idx").alias("_pos"), F.col("url").alias("_source_url"), *[F.get("values", F.lit(i)).alias(n) for i, n in enumerate(names)])
    filled = out.agg(*[F.count_if(~missing(F.col(n), "empty_row")).alias(n) for n in names]).first() if names else {}
    return out.select("_pos", "_source_url", *[n for n in names if filled[n]])


def schema_rows(pages: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Rows of all tables of pages (url, html), mapped to fields (name → Spark type): source_url and the fields.

    Each table's header is matched to the fields where the page is parsed, so the plan is the same for any number of
    different headers. Cells are cleaned and cast, rows in which nothing could be read are dropped, and equal rows of
    a page stay once.
    """
    rows = _table_rows(pages, EXTRACTOR_WORDS, tuple(fields)).withColumnRenamed("url", "source_url")
    cell = lambda i: clean_cell(F.get("values", F.lit(i)))
    typed = [(F.regexp_replace(cell(i), "[,$%]", "").try_cast(t) if t != "string" else cell(i)).alias(f) for i, (f, t) in enumerate(fields.items())]
    out = rows.select("source_url", *typed)
    return out.filter(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull()).distinct()


def page_numbers(html: Column) -> Column:
    """Numbers of all pages of a series that a page links to as `/pN`, from 1 to the highest."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r"/p(\d{1,4})\b"), F.lit(1)), lambda x: x.cast("int"))
    return F.sequence(F.lit(1), F.coalesce(F.array_max(found), F.lit(1)))


def side_by_side(cells: DataFrame) -> DataFrame:
    """url, left_idx, right_idx: neighbouring tables that are halves of one.

    They have equally many rows, only the left one has an identity column, and at least five of the cells in the right
    one's first five rows look like numbers.
    """
    identity = F.lower(strip(F.col("text"))).isin("name", "player", "team", "company")
    body = ~F.col("header")
    first = F.min(F.when(body, F.col("row_idx"))).over(Window.partitionBy("url", "table_idx"))
    t = cells.withColumn("first", first).groupBy("url", "table_idx").agg(
        F.count_distinct(F.when(body, F.col("row_idx"))).alias("rows"), F.max(F.col("header") & identity).alias("identity"),
        F.count_if(body & (F.col("row_idx") < F.col("first") + 5) & is_numeric_like(F.col("text"))).alias("numbers"),
    )
    left, right = t.alias("l"), t.alias("r")
    both = left.join(right, F.expr("l.url = r.url and r.table_idx = l.table_idx + 1"))
    fits = F.expr("l.rows = r.rows and l.rows > 0 and l.identity and not r.identity and r.numbers >= 5")
    return both.filter(fits).select(F.col("l.url").alias("url"), F.col("l.table_idx").alias("left_idx"), F.col("r.table_idx").alias("right_idx"))


def combine(rows: DataFrame, halves: DataFrame) -> DataFrame:
    """rows (of `table_rows`) in which the halves of side-by-side tables (url, left_idx, right_idx) are one table: rows meet by their
    place, and a name that both have keeps the left one's values. A table is the half of one other at most, the first."""
    once = halves.alias("a").join(halves.alias("b"), F.expr("a.url = b.url and a.left_idx = b.right_idx"), "left_anti")
    place = F.row_number().over(Window.partitionBy("url", "table_idx").orderBy("row_idx"))
    numbered = rows.withColumn("place", place)
    left = numbered.join(once.withColumnRenamed("left_idx", "table_idx"), ["url", "table_idx"], "left")
    right = numbered.select("url", F.col("table_idx").alias("right_idx"), "place", F.col("names").alias("more"), F.col("values").alias("beside"))
    both = left.join(right, ["url", "right_idx", "place"], "left")
    pairs = F.zip_with("more", "beside", lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    both = both.withColumn("fresh", F.filter(pairs, lambda x: ~F.array_contains("names", x["name"])))
    add = lambda own, part: F.concat(own, F.coalesce(F.col(f"fresh.{part}"), F.array().cast("array<string>")))
    out = both.select("url", "table_idx", "row_idx", add(F.col("names"), "name").alias("names"), add(F.col("values"), "value").alias("values"))
    return out.join(once.select("url", F.col("right_idx").alias("table_idx")), ["url", "table_idx"], "left_anti")


def paired_summary(cells: DataFrame, clubs: DataFrame, money: str = "Fee") -> DataFrame:
    """club, incoming, outgoing, spend, income: tables 2i+1 and 2i+2 of a page are the arrivals and departures of club i.

    clubs: url, club_idx, club. Sums of money are rounded to 4 places.
    """
    column = cells.filter("header").filter(F.lower(strip(F.col("text"))) == money.lower()).groupBy("url", "table_idx").agg(F.min("col_idx").alias("money"))
    body = cells.filter(~F.col("header")).join(column, ["url", "table_idx"], "left")
    per = body.groupBy("url", "table_idx").agg(F.count_distinct("row_idx").alias("n"), F.sum(F.when(F.col("col_idx") == F.col("money"), parse_money(F.col("text"))).otherwise(0.0)).alias("total"))
    per = per.filter("table_idx >= 1").withColumn("club_idx", F.floor((F.col("table_idx") - 1) / 2).cast("int")).withColumn("inward", F.col("table_idx") % 2 == 1)
    side = lambda c, inward: F.coalesce(F.sum(F.when(F.col("inward") == inward, F.col(c))), F.lit(0))
    out = per.join(clubs, ["url", "club_idx"]).groupBy("url", "club_idx", "club").agg(
        side("n", True).alias("incoming"), side("n", False).alias("outgoing"), F.round(side("total", True), 4).alias("spend"), F.round(side("total", False), 4).alias("income")
    )
    return out.drop("url", "club_idx")
