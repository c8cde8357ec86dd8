"""The filter audit against brute force over all orders."""

import itertools
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablesmith.llm import filter_audit

COLUMNS = "doc_id long, text string, lang string, n int"
LONG = " ".join(f"word{i}" for i in range(250))
ROWS = [(i, t, lang, i) for i, (t, lang) in enumerate(itertools.product([LONG, "a b c", "A B C #", "x " * 300, "", None, "ÉTÉ x " * 210, "tab\tand\x0bfeed\n" * 90], ["en", "de", None]))]
ROWS += [(None, LONG, "en", 0), (None, LONG, "en", 1), (0, LONG, "fr", 2), (0, LONG, "fr", 2), (1, "a b c", "fr", 3), (900, " ".join(["ONE"] * 400), "", 4)]
LABELS = [(0, 1, 0), (0, 0, 1), (3, 1, 1), (4, None, 1), (900, 1, None), (None, 1, 1), (77, 1, 1)]


def failing(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield i, lang or "", {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None, "E": i is not None and i > least[t],
        }


def brute(rows, labels):
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    docs, out = list(failing(rows)), {}
    for part in {p for _, p, _ in docs}:
        mine = [(i, f) for i, p, f in docs if p == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                removed = [(i, x) for i, x in left if x[f]]
                left = [(i, x) for i, x in left if not x[f]]
                shapley[f] += len(removed)
                all_fail = [x for _, x in mine if x[f]]
                unique = sum(sum(x.values()) == 1 for x in all_fail)
                out[part, "".join(order), step] = [len(left), len(removed), len(all_fail) - len(removed), unique, sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def run(spark, rows, labels):
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("x") for c in ("mask", "part", "words", "digest", "least", "times", "good")})
    facts = filter_audit.text_facts(docs)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    filters = {f: F.expr(c) for f, c in filter_audit.FILTERS.items()}
    return filter_audit.audit(filter_audit.cells(facts, filters, marks, F.coalesce("lang", F.lit("")), repeated="E"), "ABCDE")


def test_audit(spark):
    got = [tuple(r) for r in run(spark, ROWS, LABELS).collect()]
    assert len(got) == 600 * 4
    assert set(got) == brute(ROWS, LABELS)


def test_no_documents_no_labels(spark):
    assert run(spark, [], []).count() == 0
    got = {tuple(r) for r in run(spark, ROWS[:5], []).collect()}
    assert got == brute(ROWS[:5], [])


@pytest.mark.parametrize("k", range(1, 7))
def test_swaps_visit_every_order_once(k):
    order, seen = list(range(k)), [tuple(range(k))]
    for i in filter_audit.swaps(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) == math.factorial(k)


def test_too_many_filters(spark):
    with pytest.raises(ValueError, match="at most"):
        filter_audit.audit(spark.createDataFrame([], "part string, mask int, n long, good long, toxic long"), "ABCDEFGHI")


def test_other_filters_without_repeats(spark):
    docs = spark.createDataFrame([(i, "t", i) for i in range(10)], "doc_id long, text string, x int")
    marks = spark.createDataFrame([], "doc_id long, good boolean, toxic boolean")
    counted = filter_audit.cells(docs, {"P": F.col("x") < 6, "Q": F.col("x") % 2 == 0}, marks, F.lit("all"))
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(counted, "PQ").collect()}
    assert got == {("PQ", 1): (4, 6, 0, 3, 9), ("PQ", 2): (2, 2, 3, 2, 7), ("QP", 1): (5, 5, 0, 2, 7), ("QP", 2): (2, 3, 3, 3, 9)}
