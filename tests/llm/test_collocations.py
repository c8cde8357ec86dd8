"""Phrases against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablesmith.llm import collocations


def brute(rows, longest, least, cover):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    known = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    out = set()
    for (lang, p), a in known.items():
        longer = [b for (g, q), b in known.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= cover * a for b in longer):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:j]] * f[lang, p[j:]]), j, f[lang, p[:j]], f[lang, p[j:]]) for j in range(1, len(p)))
        out.add((lang, " ".join(p), len(p), a, left, right, n[lang], score))
    return out


def make(n, seed=1):
    r = random.Random(seed)
    words = ["The", "of", "new", "york", "city", "É", "x\x00y", "a\x0by", "tab\there", "0", "end."]
    rows = [("".join(r.choice(words) + r.choice([" ", " ", " ", ", ", "\n", "\t", "  "]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), ("new york city " * 400, "fr"), ("new york city " * 5, "und"), ("lone", ""), (", ;. \n", "en")] * 2


@pytest.mark.parametrize(("longest", "least", "cover", "size"), [(3, 10, 50, 1 << 20), (4, 3, 80, 700), (2, 2, 50, 1 << 20)])
def test_phrases(spark, monkeypatch, longest, least, cover, size):
    rows = make(60)
    cut = collocations.cut_blocks
    monkeypatch.setattr(collocations, "cut_blocks", lambda docs: cut(docs, size))  # many blocks or few
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumns({c: F.lit("x") for c in ("block", "n", "l", "r", "id", "word", "number")})
    got = collocations.phrases(docs, longest, least, cover).collect()
    want = brute(rows, longest, least, cover)
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


def test_no_documents(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.best(collocations.phrases(none), 5).count() == 0


def test_best_is_ranked_alike_in_one_place_and_in_many(spark, monkeypatch):
    r = random.Random(2)
    rows = [(r.choice(["en", "de"]), f"phrase {i}", 2, r.randint(1, 3), 1, 1, 1, r.randint(1, 3)) for i in range(300)]
    found = spark.createDataFrame(rows, "lang string, phrase string, words int, a long, l long, r long, n long, score long")
    want = {(g, i + 1, x[1]) for g in ("en", "de") for i, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[7], -x[3], x[1]))[:40])}
    for ranked in (collocations.RANKED, 20):
        monkeypatch.setattr(collocations, "RANKED", ranked)
        assert {(x.lang, x["rank"], x.phrase) for x in collocations.best(found, 40).collect()} == want


def test_scores_beyond_64_bits(spark):
    a, left, right = 987_654_321_012, 998_765_432_109, 999_999_999_999
    got = spark.range(1).select(collocations._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first().s
    assert got == 1_000_000 * a * a // (left * right)
