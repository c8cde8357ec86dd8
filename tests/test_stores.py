"""Checkpoints and memory that several writers share."""

import threading

import pytest


from tablesmith.sources import commits, files, html, memory, pages


def together(*work):
    failed = []

    def run(f):
        try:
            f()
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=run, args=(f,)) for f in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed, failed


def test_two_writers_add_each_record_once(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "c"), "pos int, name string"
    one, two = (spark.createDataFrame([(i, f"r{i}") for i in rows], schema) for rows in (range(0, 30), range(20, 50)))
    meet, real = threading.Barrier(2), commits.commit
    seen = []

    def late(*args):
        if len(seen) < 2:  # both have read the same state and written before either commits
            seen.append(args)
            meet.wait(60)
        return real(*args)

    monkeypatch.setattr(commits, "commit", late)
    together(*(lambda d=d: files.save_checkpoint(d, path, "k", "pos") for d in (one, two)))
    got = [r["name"] for r in files.load_checkpoint(spark, path, "k", one.schema).collect()]
    assert sorted(got) == sorted(f"r{i}" for i in range(50))
    assert len(commits.committed(spark, f"{path}/run=k")) == 2


def test_what_was_not_committed_is_not_there(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([(1, "a")], "pos int, name string")
    files.save_checkpoint(df, path, "k", "pos")
    df.select("name").write.json(f"{path}/run=k/part-of-a-writer-that-died")
    assert files.load_checkpoint(spark, path, "k", df.schema).count() == 1
    assert not commits.commit(spark, f"{path}/run=k", 0, "late")  # the first place is taken


def test_broken_rows_are_set_aside(spark, tmp_path):
    import datetime

    path = str(tmp_path / "c")
    rows = [(1, "a", 1.5, datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)), (2, None, float("nan"), None), (3, "", None, None)]
    df = spark.createDataFrame(rows, "pos int, name string, x double, t timestamp")
    files.save_checkpoint(df, path, "k", "pos")
    part = commits.committed(spark, f"{path}/run=k")[0]
    (tmp_path / "c" / "run=k" / part / "part-99.json").write_text('{"pos": 4, "name": "d"}\n{"pos": "x", "name"\n{"pos": "no number", "name": "e"}\n')
    files.save_checkpoint(df, path, "k", "pos")  # nothing new
    got = files.load_checkpoint(spark, path, "k", df.schema).collect()
    assert sorted(r.pos for r in got) == [1, 2, 3, 4]
    assert {(r.pos, r.name, r.t) for r in got if r.pos < 4} == {(1, "a", rows[0][3]), (2, None, None), (3, "", None)}
    assert sorted(r.text for r in files.broken_records(spark, path, "k", df.schema).collect()) == ['{"pos": "no number", "name": "e"}', '{"pos": "x", "name"']


INTENTS = {"domain_intent": "sports", "entity_intent": "team", "target_hint": "wins", "feature_hints": ["pace"]}


def test_two_sessions_share_a_memory(spark, tmp_path):
    path, other = str(tmp_path / "m"), spark.newSession()
    assert memory.load(spark, path).count() == 0
    together(*(lambda s=s, n=n: memory.record(s, path, f"goal {n}", [f" https://{n}.org ", ""], INTENTS) for s, n in ((spark, 1), (other, 2), (spark, 3))))
    assert {r.goal for r in memory.load(other, path).collect()} == {"goal 1", "goal 2", "goal 3"}
    place = {r.goal: r.pos for r in memory.load(spark, path).collect()}
    memory.record(other, path, "goal 2", ["https://new.org"], INTENTS)
    memory.record(other, path, "goal 9", [" "], INTENTS)  # nothing worked
    rows = {r.goal: r for r in memory.load(spark, path).collect()}
    assert {g: r.pos for g, r in rows.items()} == place and rows["goal 2"].urls == ["https://new.org"]
    assert [r.url for r in memory.similar(spark, path, INTENTS, 2).orderBy("place").collect()] == ["https://1.org", "https://new.org"]


def test_memory_keeps_the_last_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(memory, "MOST", 3)
    monkeypatch.setattr(memory, "KEPT", 2)
    path = str(tmp_path / "m")
    for n in range(5):
        memory.record(spark, path, f"goal {n}", ["u"], INTENTS)
    assert [r.goal for r in memory.load(spark, path).orderBy("pos").collect()] == ["goal 2", "goal 3", "goal 4"]
    assert len([x for x in (tmp_path / "m").iterdir() if x.name.startswith("part-")]) == 2


def test_cells_that_cover_many_rows(spark):
    rows = "".join(f"<tr><td>n{i}</td></tr>" for i in range(1, 1400))
    made = f'<table><tr><th>region</th><th>name</th></tr><tr><td rowspan="1500">west</td><td>n0</td></tr>{rows}</table>'
    got = html.table_rows(spark.createDataFrame([("u", made)], "url string, html string")).collect()
    assert [r["values"] for r in got] == [["west", f"n{i}"] for i in range(1400)]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "])
def test_line_ends(spark, end):
    df = spark.createDataFrame([(1, f"one{end}{end} two")], "k int, text string")
    assert df.select(pages.snapshot_lines(df.text).alias("x")).first().x == ["one", "two"]
    assert [r.line for r in pages.lines_of(df, "text", "k").collect()] == ["one", "two"]


def test_commits_on_a_store_that_is_no_local_disk(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    root = "viewfs://store/in/c"
    assert commits.committed(spark, root) == []
    assert commits.commit(spark, root, 0, "a") and not commits.commit(spark, root, 0, "b") and commits.commit(spark, root, 1, "c")
    assert commits.committed(spark, root) == ["a", "c"]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "pos int, name string")
    files.save_checkpoint(df, "viewfs://store/in/d", "k", "pos")
    assert files.load_checkpoint(spark, "viewfs://store/in/d", "k", df.schema).count() == 2
