"""Blueprints, the whole run from pages to a table, files, parsers and streams."""

import pytest
from pyspark.sql import functions as F

from tablesmith.operators import profiling, quality, resolve
from tablesmith.plans import blueprint, pipeline, seams
from tablesmith.sources import files, html, pages, state
from tablesmith.streaming import incremental


def page(names, rows):
    head = "<tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"
    return "<table><thead>" + head + "</thead>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def test_blueprint():
    b = blueprint.design("Predict NBA player salary from performance stats")
    assert b.target == "salary" and not blueprint.validate(b)
    assert [f.metadata["ml_role"] for f in b.schema].count("feature") == 5


def test_validation_drops_what_is_wrong(spark):
    """Bounds, outliers in two columns, a target far out, and entities whose sources differ; and the gate on how much may go."""
    rows = [(f"e{i}", float(i % 7 + 1), float(i % 5 + 1), float(i % 3 + 1)) for i in range(40)]
    rows += [("low", -1.0, 1.0, 1.0), ("far", 1e6, 1e6, 1.0), ("top", 1.0, 1.0, 1e9), ("once", 1e6, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "name string, salary double, wins double, goal double")
    raw = spark.createDataFrame([("E1", "https://a.example/1", 10.0), ("E1", "https://b.example/1", 99.0), ("e2", "https://a.example/1", 5.0), ("e2", "https://b.example/2", 5.0)], "name string, source_url string, goal double")
    valid, found, summary = pipeline.validate(df, "name", "goal", raw)
    kept = {r["name"] for r in valid.collect()}
    assert {r[0] for r in rows} - kept == {"low", "far", "top", "e1"}
    assert {(r["category"], r["severity"]) for r in found.collect()} == {("bounds", "error"), ("outlier", "warning")} and summary.first()["kept_rows"] == 40
    with pytest.raises(pipeline.QualityError):
        pipeline.validate(df.withColumn("salary", F.when(F.col("wins") < 3, -1.0).otherwise(F.col("salary"))), "name", "goal")
    assert {r["name"] for r in pipeline.validate(df.limit(5), "name", "goal")[0].collect()} == {f"e{i}" for i in range(5)}


def test_states_of_odd_snapshots(spark):
    got = pages.page_state(spark.createDataFrame([(1, None), (2, ""), (3, 'heading "A"')], "i int, s string"), "s", "i").orderBy("i").collect()
    assert [(r["title"], r["summary"], r["lines"], r["links"]) for r in got] == [(None, "", 0, []), (None, "", 0, []), ("A", "A", 1, [])]


def test_links_of_a_long_snapshot(spark):
    """The first links that differ in reference or label, each as it stood first; a page's time grows with its lines, not their square."""
    import time

    often = [f'link "L{i // 3 % 30}" [ref=e{i // 3 % 30}] https://x.example/{i}' for i in range(1000)]
    lines = [*often, *(f'link "M{i}" [ref=e{i}]' for i in range(7000)), 'row "plain" cell']
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(often))], "i int, s string")
    began = time.monotonic()
    got = {r["i"]: r for r in pages.page_state(df, "s", "i").collect()}
    took = time.monotonic() - began
    first = [(f"@e{i}", f"L{i}", f"https://x.example/{3 * i}") for i in range(30)]
    assert [(x["ref"], x["label"], x["url"]) for x in got[2]["links"]] == first
    assert [(x["ref"], x["label"], x["url"]) for x in got[1]["links"]] == [*first, *((f"@e{i}", f"M{i}", None) for i in range(10))]
    assert got[1]["lines"] == got[1]["row_signals"] == 8001 and took < 60, took


def test_state_reads_a_line_once(spark):
    """A line is cleaned and told apart once, however many parts of a state ask; the summary takes lines by points, then place."""
    lines = [*(f'link "P{i}" [ref=e{i}]' for i in range(40)), *(f'heading "H{i}" [ref=e{i}]' for i in range(25)), "search results 1 2 3", 'row "r" cell', "button row 1"]
    df = pages.page_state(spark.createDataFrame([(1, "\n".join(lines))], "i int, s string"), "s", "i")
    got, plan = df.first(), df._jdf.queryExecution().optimizedPlan().toString()
    assert got["summary"].split("\n") == [*(f"P{i}" for i in range(5)), *(f"H{i}" for i in range(25))]
    assert got["headings"] == [f"H{i}" for i in range(20)] and got["title"] == "H0" and len(got["links"]) == 40
    assert got["table_lines"] == ['r" cell', "row 1"] and got["row_signals"] == 67 and got["lines"] == 68 and got["blocked"] == ["search results"]
    asked = {p: plan.count(p) for p in (pages.LINE_PARTS[2][0], pages.TABLE_SIGNAL)}
    assert set(asked.values()) == {1}, asked


def test_model_seams(spark):
    """Answers that are no JSON, no list or no blueprint; the number of times a model is asked, and what it is given."""
    import json

    asked = []

    def designer(goal):
        asked.append(goal)
        return ["sorry", '{"row_schema": 7}', "```json\n" + json.dumps({"dataset_name": "My Set", "row_schema": {"fields": [{"name": "team"}, {"name": "wins", "type": "integer", "ml_role": "target"}]}}) + "```"][min(len(asked), 3) - 1]

    made = seams.design("Predict things", model=designer)
    assert len(asked) == 2 and made.target == "outcome_label"  # a schema that lacks fields gets those of any goal
    assert seams.design("Predict NBA player salary", model=lambda g: 1 / 0).target == "salary"
    assert seams.design("Predict things", 40, lambda g: "no").dataset == "things" and seams.design("Predict things", 40).records == 40
    rows = [(i, f"k{i // 2}", f"v{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "pos int, name string, value string")
    calls = []

    def merger(known, new):
        calls.append((len(known), len(new)))
        return list({r["name"]: r for r in [*known, *new]}.values())

    got = seams.merge(df, "name", "pos", merger).collect()
    assert calls == [(0, 20), (10, 10), (0, 15)] and {r["value"] for r in got} == {f"v{i}" for i in range(1, 30, 2)}
    assert seams.merge(spark.createDataFrame([*rows, *((i, f"m{i}", "x") for i in range(30, 80))], df.schema), "name", "pos", merger).count() == 65
    assert len(calls) == 3
    assert seams.records_of({"x": 1, "list": [1]}) == [1] and seams.records_of({"records": "no"}) == seams.records_of(7) == []
    assert seams.json_part('a {"b": [1]} c') == '{"b": [1]}' and seams.json_part("[1] {2}") == "[1]" and seams.json_part(" none ") == "none"


def test_build(spark):
    teams = [f"{a}{b} City" for a in ("Alba", "Breno", "Cosmo", "Delfi", "Elmo") for b in ("villa", "west", "xanti", "yonder", "zubar")]
    first = page(["Team", "Wins", "Losses", "Payroll"], [(t, i, 40 - i, f"${i + 1}.5M") for i, t in enumerate(teams)])
    second = page(["Team", "Pace", "Home", "Away"], [(t, 90 + i / 10, i * 2, i * 3 % 7) for i, t in enumerate(teams)])
    df = spark.createDataFrame([("https://www.teamrankings.com/nba/stat/payroll", first), ("https://www.teamrankings.com/nba/stat/tempo", second), ("https://x.example/none", "<p>no table</p>")], "url string, html string")
    plan = blueprint.design("Predict wins of teams")
    got = pipeline.build(df, plan, "Predict wins of teams")
    assert got.table.count() == 25 and got.target == "payroll_wins"
    assert {"name", "entity_name", "payroll", "payroll_wins", "tempo_pace", "tempo_home"} <= set(got.table.columns)
    assert got.provenance["tempo_pace"].endswith("tempo") and got.provenance["payroll_wins"].endswith("payroll")
    assert got.table.orderBy("payroll_wins").first()["payroll"] == 1.5e6
    assert got.reports["summary"].first()["passed"] and got.reports["leakage"].filter("leaks").count() >= 1
    with pytest.raises(pipeline.QualityError):
        pipeline.build(df.limit(0), plan, "Predict wins of teams")
    with pytest.raises(pipeline.QualityError):  # a longer table than the goal asks for
        pipeline.build(df, plan, "Predict wins of teams", count=10)


def test_html_cells():
    cells = html.parse_cells("<table><tr><th>A</th><th>B</th></tr><tr><td rowspan=2>x</td><td>1&nbsp;<b>2</b></td></tr><tr><td>3</td></tr></table><table></table>")
    assert [(r, c, h, t) for _, r, c, h, t in cells] == [(0, 0, True, "A"), (0, 1, True, "B"), (1, 0, False, "x"), (1, 1, False, "1 2"), (2, 0, None if cells[4][3] is None else False, "x"), (2, 1, False, "3")]
    assert html.parse_cells(None) == [] and html.parse_cells("<p>none</p>") == []
    odd = """<TABLE><!-- <td>no</td> --><tr><td title="a > b">1 &lt; 2<script>if (a<td) {}</script></td><td COLSPAN='2'>x<br>y<table><tr><td>in</td></tr></table>z</td></tr><tr><td>u<td>v</table>after"""
    assert [(n, r, c, t) for n, r, c, _, t in html.parse_cells(odd)] == [(0, 0, 0, "1 < 2"), (0, 0, 1, "x yz"), (0, 0, 2, "x yz"), (0, 1, 0, "u"), (0, 1, 1, "v"), (1, 0, 0, "in")]
    assert len(html.parse_cells("<table><tr><td colspan=99999 rowspan=3>x</td></tr></table>")) == html.SPANS["colspan"]


def test_a_long_page_is_handed_on_in_batches():
    """A task holds a page's text and some of its rows, not all of them."""
    import tracemalloc

    long = page(["Partkey", "Brand"], [(i, f"Brand#{i % 25}") for i in range(20_000)])
    tracemalloc.start()
    n = sum(1 for _ in html.rows_of(long, html.BUILDER_WORDS, ("partkey", "brand")))
    cells = sum(1 for _ in html.cells_of(long))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and cells == 40_002 and most < len(long), (most, len(long))


def test_rows_of_tables_in_tables(spark):
    """Spans, nested tables and tables without rows, by cells and by rows: as `parse_cells` has them."""
    odd = "<table><table><tr><th>A<th>B<tr><td rowspan=3 colspan=2>x<tr><td>1<tr><td>2<td rowspan=9>3</table><tr><td>in<table></table><table><tr><td>u</table><tr><td>v</table>"
    df = spark.createDataFrame([(1, odd), (2, None), (3, "<p>")], "k int, html string")
    got = sorted((r["table_idx"], r["row_idx"], r["col_idx"], r["header"], r["text"]) for r in html.html_cells(df, ("k",)).collect())
    assert got == html.parse_cells(odd) and len(got) == 14
    rows = html.table_rows(df.withColumnRenamed("k", "url")).collect()
    assert sorted((r["table_idx"], r["row_idx"], r["values"]) for r in rows) == [
        (0, 0, ["in"]), (0, 1, ["v"]), (1, 1, ["x", "x", "", ""]), (1, 2, ["x", "x", "1", ""]), (1, 3, ["x", "x", "2", "3"]), (2, 0, ["u"]),
    ]


def test_digit_headers_are_replaced(spark):
    h = "<table><tr><th>0</th><th>1</th></tr><tr><td>Player</td><td>Salary</td></tr><tr><td>A</td><td>$51.4M</td></tr><tr><td>Player</td><td>Salary</td></tr></table>"
    rows = html.table_rows(spark.createDataFrame([("u", h)], "url string, html string")).collect()
    assert [(r["names"], r["values"]) for r in rows] == [(["Player", "Salary"], ["A", "$51.4M"])]


def test_many_headers_make_one_plan(spark):
    made = [(f"u{i}", f"<table><tr><th>Place</th><th>Other {i}</th><th>Team Name{'' if i % 2 else 's'}</th></tr><tr><td>{i}</td><td>x</td><td>T{i}</td></tr></table>") for i in range(500)]
    got = html.schema_rows(spark.createDataFrame([*made, ("v", None), ("w", "<p>")], "url string, html string"), {"place": "int", "team_name": "string"})
    assert sorted((r["place"], r["team_name"]) for r in got.collect()) == [(i, f"T{i}") for i in range(500)]


def test_state():
    assert state.states_of("<script>window.__PRELOADED_STATE__ = {a: 'undefined: {', b: [1,2,], c: undefined}; f()</script>") == [("window.__PRELOADED_STATE__", {"a": "undefined: {", "b": [1, 2], "c": None})]
    both = '<script type="application/json" id="__NEXT_DATA__">{"a": "x &amp; y"}</script><script>window.__INITIAL_STATE__={items: [{n: 1}, {n: 2}]}</script>'
    assert state.states_of(both) == [("__NEXT_DATA__", {"a": "x & y"}), ("window.__INITIAL_STATE__", {"items": [{"n": 1}, {"n": 2}]})]
    assert state.states_of('<script id="__NEXT_DATA__">{"a": [1]}</script>') == state.states_of("<p>") == state.states_of(None) == []
    assert state.inventory({"a": [1, {"b": None}]}) == ([("a[0]", "1"), ("a[1].b", None)], [])
    assert state.inventory({"a": [{"x": 1}, {"y": 2}], "b": [1, 2, 3]})[1] == [("a", 2, ["x", "y"]), ("b", 3, [])]
    deep = {"l": [[{"a": 1}, {"b": 2}]] * 60, "s": list(range(60))}
    paths, groups = state.inventory(deep, "k")
    assert len(paths) == 100 + 50 and [g[0] for g in groups[:2]] == ["k.l", "k.l[0]"] and len(groups) == 22


def test_page_inventory(spark):
    both = '<script type="application/json" id="__NEXT_DATA__">{"a": 1}</script><script>window.__INITIAL_STATE__={items: [{n: 1}, {n: 2}]}</script>'
    df = spark.createDataFrame([(1, both), (2, None)], "i int, html string")
    got = {r["i"]: r["inventory"] for r in state.page_inventory(df, F.col("html")).collect()}
    assert [(p["path"], p["value"]) for p in got[1]["paths"]] == [("__NEXT_DATA__.a", "1"), ("window.__INITIAL_STATE__.items[0].n", "1"), ("window.__INITIAL_STATE__.items[1].n", "2")]
    assert [c["path"] for c in got[1]["collections"]] == ["window.__INITIAL_STATE__.items"] and got[2]["paths"] == []
    long = df.select(state.truncated_json(F.lit('{"a": "' + "x" * 100 + '"}'), 20).alias("j")).first()["j"]
    assert long.startswith('{"_truncated":true,"_preview":')


def test_document_text(spark):
    h = "<nav>Log in</nav><script>var x = 'gone';</script><p>Row &amp; one</p><p>row &amp; ONE</p><p>ab</p><p>Second   row</p>"
    got = pages.document_text(spark.createDataFrame([(h,), (None,)], "html string"), "html").collect()
    assert [r["text"] for r in got] == ["Row & one\nSecond row", ""]


def test_outliers_and_leakage(spark):
    rows = [(i, float(i % 7), float(i % 5), 1.0) for i in range(40)] + [(40, 1e6, 1.0, 1.0), (41, 1e6, 1e6, 1.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double")
    kept = quality.drop_outliers(df, ["a", "b", "c"])
    assert {r["k"] for r in kept.collect()} == set(range(41))
    assert {r["k"] for r in quality.drop_outliers(df, ["a", "b", "c"], target="a").collect()} == set(range(40))
    leaks = {r["column"]: r["leaks"] for r in profiling.leakage(df.withColumn("d", F.col("a") * -3), "a").collect()}
    assert leaks == {"k": False, "b": False, "c": False, "d": True}


def test_fuzzy_resolution(spark):
    names = ["international business machine", "international business machines", "internatinal business machines", "other thing entirely", "ab", "ab"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, name string")
    got = {r["pos"]: r["entity_name"] for r in resolve.resolve_fuzzy(df, "name", "pos").collect()}
    from difflib import SequenceMatcher

    seen, want = [], {}
    for i, n in enumerate(names):
        hit = next((s for s in seen if s == n or SequenceMatcher(a=n, b=s).ratio() >= 0.94), None)
        want[i] = hit or n
        if not hit:
            seen.append(n)
    assert got == want


def test_fuzzy_resolution_of_many_names(spark):
    """Against the greedy fold itself: chains of names that differ by letters, many of which share their beginnings."""
    import random
    from difflib import SequenceMatcher

    r = random.Random(4)
    bases = ["consolidated transport and company services", "consolidated transport and community services", "northern river paper mills limited", "general electric motors of the south", "ab", "long names of nothing at all"]
    names = []
    for _ in range(300):
        n = list(r.choice(bases))
        for _ in range(r.randint(0, 4)):
            n[r.randrange(len(n))] = r.choice("abcdefg ")
        names.append("x" + "".join(n).strip() + "x")
    df = spark.createDataFrame(list(enumerate(names)), "pos int, name string")
    got = {x["pos"]: x["entity_name"] for x in resolve.resolve_fuzzy(df, "name", "pos").collect()}
    keys = {x["pos"]: x["entity_name"] for x in resolve.resolve_exact(df, "name").collect()}
    seen, want = [], {}
    for i in sorted(keys):
        hit = next((s for s in seen if s == keys[i] or SequenceMatcher(a=keys[i], b=s).ratio() >= 0.94), None)
        want[i] = hit or keys[i]
        if not hit:
            seen.append(keys[i])
    assert got == want and len(seen) < len(set(keys.values()))


def test_document_text_against_the_pages(spark, sf):
    """Against a plain reading of each page: markup off, entities read, lines by their first appearance."""
    import html as entities
    import re

    df = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    got = {x["page_id"]: x["text"] for x in pages.document_text(df, "html", most=2000).collect()}
    for r in df.collect():
        t = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ", r["html"] or "")
        lines = {}
        for line in entities.unescape(re.sub("<[^>]+>", "\n", t)).splitlines():
            line = " ".join(line.split())
            if len(line) > 2 and not any(p in line.lower() for p in pages.DOCUMENT_CHROME):
                lines.setdefault(line.lower(), line)
        want = "\n".join(lines.values())
        assert got[r["page_id"]] == (want if len(want) <= 2000 else want[:1000] + "\n...[truncated]...\n" + want[-1000:])


def test_exact_quantiles(spark):
    """Against numpy: ties, outliers, nulls, NaN, one value, none; also with brackets that have to be narrowed."""
    import random

    import numpy as np

    from tablesmith.operators import stats

    r = random.Random(11)
    n = 5000
    own = {
        "even": [r.random() for _ in range(n)], "ties": [float(r.randint(0, 3)) for _ in range(n)], "tail": [r.random() ** 20 * 1e12 for _ in range(n)],
        "some": [None if i % 3 else float(i) for i in range(n)], "odd": [float("nan") if i % 2 else -float(i) for i in range(n)], "one": [7.0] + [None] * (n - 1), "none": [None] * n,
    }
    df = spark.createDataFrame(list(zip(*own.values(), strict=True)), ", ".join(f"{c} double" for c in own)).repartition(4)
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    for few in (stats.FEW, 3):
        stats.FEW = few
        try:
            got = stats.exact_quantiles(df, {c: F.col(c) for c in own}, shares)
        finally:
            stats.FEW = 20_000
        for c, values in own.items():
            known = [v for v in values if v is not None and v == v]
            assert got[c][0] == len(known)
            assert got[c][1] == (pytest.approx(np.quantile(known, shares).tolist(), rel=1e-12) if known else [None] * len(shares))


def test_runs_over_pieces(spark, monkeypatch):
    """Longest runs against counting, with pieces smaller and larger than runs, gaps in positions, and keys of one kind only."""
    import itertools
    import random

    from tablesmith.operators import ranking

    r = random.Random(9)
    rows = [(k, p, k == "all" or (k != "none" and r.random() < 0.7)) for k in ("a", "b", "all", "none") for p in sorted(r.sample(range(1000), 120))]
    df = spark.createDataFrame(rows, "k string, p int, bad boolean")
    want = {k: max(len(list(g)) if bad else 0 for bad, g in itertools.groupby(x[2] for x in rows if x[0] == k)) for k in ("a", "b", "all", "none")}
    for pieces, whole in ((1, 0), (7, 0), (256, 0), (256, 120)):
        monkeypatch.setattr(ranking, "PIECES", pieces)
        monkeypatch.setattr(ranking, "WHOLE", whole)
        got = {x["k"]: (x["longest"], x["abort"]) for x in ranking.rejection_runs(df, "k", "p", F.col("bad")).collect()}
        assert got == {k: (n, n >= 3) for k, n in want.items()}
    assert ranking.rejection_runs(df.limit(0), "k", "p", F.col("bad")).count() == 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "pos int, name string")
    key = files.run_key("goal", "set", df.schema)
    files.save_checkpoint(df, str(tmp_path / "c"), key, "pos")
    files.save_checkpoint(spark.createDataFrame([(4, "c"), (5, "b")], "pos int, name string"), str(tmp_path / "c"), key, "pos")
    assert sorted(r["name"] for r in files.load_checkpoint(spark, str(tmp_path / "c"), key, df.schema).collect()) == ["a", "b", "c"]
    assert files.load_checkpoint(spark, str(tmp_path / "c"), "other", df.schema).count() == 0
    csv, _ = files.write_table(df, str(tmp_path), "My Table!", single=True)
    assert files.preview(spark, csv, 999).count() == 3
    with pytest.raises(ValueError):
        files.write_records(df.limit(0), df.schema, str(tmp_path / "x"))
    job = files.move_job(files.new_job("1", "goal"), "running")
    assert files.move_job(job, "partial_success")["state"] == "partial_success"
    with pytest.raises(ValueError):
        files.move_job(files.move_job(job, "completed"), "running")


def test_stream(spark, sf, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = incremental.distinct_records(stream, ["event_type"], "ts", "3650 days")
    q = out.writeStream.format("memory").queryName("kinds").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("kinds").count() == 5


def test_fuzzy_candidates_of_keys_with_one_beginning(spark):
    """About 3,000 keys that begin alike: of 4.5 million pairs few reach the edit test, and none that it would let through is lost."""
    import random

    r = random.Random(5)
    keys = {}
    while len(keys) < 2800:
        keys.setdefault("university of " + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(6, 12))), len(keys))
    for k in list(keys)[:200]:
        at = r.randrange(14, len(k))
        keys.setdefault(k[:at] + r.choice(["", "q", k[at] + "z"]) + k[at + 1 :], len(keys))
    df = spark.createDataFrame(list(keys.items()), "key string, pos long").cache()
    assert resolve.met_pairs(df).count() < 50_000
    got = {(x.a, x.b) for x in resolve.candidate_pairs(df).collect()}
    a, b = df.toDF("a", "a_pos"), df.toDF("b", "b_pos")
    most = (F.length("a") + F.length("b")) * (1 - resolve.RATIO) + 1e-9
    close = a.join(b, (F.col("a_pos") > F.col("b_pos")) & (F.abs(F.length("a") - F.length("b")) <= 2)).filter(F.levenshtein("a", "b") <= most)
    matches = {(x.a, x.b) for x in close.filter(resolve.sequence_ratio()("a", "b") >= resolve.RATIO).select("a", "b").collect()}
    assert len(matches) > 50 and matches <= got


def test_conflicts_of_all_fields_by_one_aggregation(spark):
    """Against each field by itself, with the middle value as it is told there."""
    import random

    r = random.Random(8)
    kinds = [None, -3.0, 0.0, 2.0, 100.0, 135.0, 1e6], [None, 100.0, 110.0, 125.0, 140.0, 150.0], [-100.0, -110.0, -125.0, -150.0]
    rows = [(k, f"https://s{r.randint(0, 3)}.org/x", r.choice(kinds[k % 3]), r.choice(kinds[k // 3 % 3]), r.choice([None, "A", " a ", "b", "n/a"])) for k in [r.randint(0, 80) for _ in range(500)]]
    df = spark.createDataFrame(rows, "k int, url string, price double, share double, flag string")
    domain = df.withColumn("d", F.regexp_extract("url", "s[0-9]", 0))
    parts = [quality.numeric_conflicts(domain, "k", c, "d", most).select("k", F.lit(c).alias("field"), "conflict") for c, most in (("price", 0.35), ("share", 0.2))]
    parts.append(quality.text_conflicts(domain, "k", "flag", "d").select("k", F.lit("flag").alias("field"), "conflict"))
    each = parts[0].union(parts[1]).union(parts[2]).filter("conflict").groupBy("k").agg(F.count("field").alias("fields"), F.max(F.col("field") == "share").alias("on_target"))
    want = {tuple(x) for x in each.filter("on_target or fields >= 2").collect()}
    assert len(want) > 20
    got = quality.conflicting_entities(df, "k", "url", ["price", "share"], ["flag"], "share")
    assert {tuple(x) for x in got.collect()} == want
    facts = quality.source_facts(df, "k", "url", {"price": 0.35, "share": 0.2}, ["flag"])
    assert facts.filter("c0 is null or c1 is null").count() > 0  # the middle value had to tell for some
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Expand" not in plan


def test_distinct_counts_without_copies_of_rows(spark, monkeypatch):
    rows = [(i, i % 7, None if i % 3 else f"t{i % 50}", -0.0 if i % 2 else 0.0, [i % 2], float("nan")) for i in range(3000)] + [(None,) * 6]
    df = spark.createDataFrame(rows, "a int, `b.c` int, t string, z double, l array<int>, nan double")
    want = {"a": (3000, 3000), "b.c": (3000, 7), "t": (1000, 50), "z": (3000, 1), "l": (3000, 2), "nan": (3000, 1)}
    for few in (quality.FEW, 5, 10**6):
        monkeypatch.setattr(quality, "FEW", few)
        out = profiling.profile(df)
        assert {x["column"]: (x["non_null"], x["distinct"]) for x in out.collect()} == want
        assert {x["rows"] for x in out.collect()} == {3001}
        assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert {x["column"]: x["distinct"] for x in profiling.profile(df.limit(0)).collect()} == dict.fromkeys(df.columns, 0)


def test_first_values_of_all_columns_in_one_scan(spark):
    from tablesmith.operators import matching

    rows = [(i, None if i % 4 else f"n{i}", i * 2 if i > 50 else None, "n/a" if i < 20 else "x", None) for i in range(400)]
    df = spark.createDataFrame(rows, "p int, a string, b int, c string, none string").repartition(6)
    got = matching.head_samples(df, ["a", "b", "c", "none"], "p", 5)
    assert got == {"a": ["n0", "n4", "n8", "n12", "n16"], "b": ["102", "104", "106", "108", "110"], "c": ["x"] * 5, "none": []}
    assert matching.head_samples(df.limit(0), ["a"], "p", 5) == {"a": []}
