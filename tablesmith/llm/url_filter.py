"""URL filters: rules on host and path, and gradient-boosted trees on lexical features where no rule fits."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.common import ship, table

#: (host, path, verdict): the rules of the query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: About so many labelled URLs train the trees; statistics are kept for so many suffixes of each kind: the host's last label, its
#: last two, and the path's first segment, which a site's sections end in.
SAMPLE_URLS, SUFFIXES = 20_000, 1000
KINDS = ("label", "domain", "section")
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32


def ascii_fold(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.coalesce(ascii_fold(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does. A rule's host holds for its subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def suffixes(host: str, segments: list[str]) -> tuple[str, ...]:
    """What statistics are kept for, in the order of KINDS."""
    labels = host.lower().rsplit(".", 2)
    return labels[-1], ".".join(labels[-2:]), segments[0] if segments else ""


def features(url: str, rates: dict[tuple[str, str], tuple[float, float]], base: float) -> list[float]:
    """Lengths, depth, digit ratio, entropy, parameter counts and statistics of the suffixes."""
    rest = url.partition("://")[2]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path, _, query = tail.partition("#")[0].partition("?")
    n = max(1, len(url))
    digits = sum(c.isdigit() for c in url)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(url).values())
    segments = [s for s in path.split("/") if s]
    known = [rates.get(key, (base, 0.0)) for key in zip(KINDS, suffixes(host, segments), strict=True)]
    return [
        len(url), len(host), len(path), len(query), len(segments), digits / n, sum(c.isdigit() for c in path), entropy,
        query.count("=") , query.count("&"), host.count("."), host.count("-"), float("#" in tail), float(url[:8].lower() == "https://"),
        len(segments[0]) if segments else 0, len(segments[-1]) if segments else 0, max(map(len, host.split("."))),
        *(rate for rate, _ in known), *(math.log1p(seen) for _, seen in known),
    ]


def _matrix(urls: list[str | None], rates: dict, base: float) -> np.ndarray:
    return np.array([features(u or "", rates, base) for u in urls], float).reshape(len(urls), len(features("", {}, 0.0)))


@dataclass
class Trees:
    """Boosted trees of fixed depth: for each, the feature and bound of every inner node, and the values of its leaves."""

    bias: float
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, bound, leaf in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > bound[at])
            out += leaf[at - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> Trees:
    """Logistic loss, second-order gains on quantile bins, a floor of one on the hessian of a leaf."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Trees(math.log(share / (1 - share)), [])
    if not len(y) or y.min() == y.max():
        return model
    bounds = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(b, x[:, f], "left") for f, b in enumerate(bounds)], 1)
    margin = np.full(len(y), model.bias)
    inner = 2**DEPTH - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, bound, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for node in range(inner):
            here = np.flatnonzero(at == node)
            best = (1e-6, 0, math.inf)
            if len(here):
                whole = g[here].sum() ** 2 / (h[here].sum() + 1)
                for f, b in enumerate(bounds):
                    if not len(b):
                        continue
                    gl = np.cumsum(np.bincount(binned[here, f], g[here], len(b) + 1))
                    hl = np.cumsum(np.bincount(binned[here, f], h[here], len(b) + 1))
                    gain = gl**2 / (hl + 1) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + 1) - whole
                    k = int(np.argmax(gain[:-1]))
                    if gain[k] > best[0]:
                        best = (gain[k], f, b[k])
            feature[node], bound[node] = best[1], best[2]
            at[here] = 2 * node + 1 + (x[here, feature[node]] > bound[node])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        margin += value[leaf]
        model.nodes.append((feature, bound, value))
    return model


def fit(urls: DataFrame, sample: int = SAMPLE_URLS) -> tuple[Trees, dict, float]:
    """Trees, suffix statistics and base rate from labelled urls (url, block).

    The statistics count all labelled URLs, for the most frequent suffixes; the trees see about `sample` of them,
    chosen by a hash of the URL.
    """
    total = urls.agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("k")).first()
    n, k = total["n"] or 0, total["k"] or 0
    base = (k + 1) / (n + 2)
    host, section = host_of(F.col("url")), F.regexp_extract(path_of(F.col("url")), "^/*([^/]*)", 1)
    rates = {}
    for kind, value in zip(KINDS, (F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), section), strict=True):
        counts = urls.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("k"))
        top = counts.orderBy(F.desc("n"), "value").limit(SUFFIXES).collect()
        rates |= {(kind, r["value"]): ((r["k"] + 5 * base) / (r["n"] + 5), float(r["n"])) for r in top}
    share = min(1.0, sample / max(1, n))
    picked = urls.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < share * (1 << 30)).select("url", "block").distinct().orderBy("url").collect()
    x = _matrix([r["url"] for r in picked], rates, base)
    return boost(x, np.array([float(r["block"]) for r in picked])), rates, base


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """pages with a struct column `judged`: host, path, rule, verdict, score (of blocking, where the trees decide).

    URLs that a rule fits are the labelled ones: they get its verdict, and train the trees for the others. Null and
    malformed URLs have an empty host and path, fit no rule and are judged by the trees; with nothing to learn from,
    or as often allowed as blocked, the verdict is allow. Repeated rows get equal verdicts; an empty table gives an
    empty result; other columns pass through.
    """
    ship(pages.sparkSession)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(host, path, rules)
    labelled = pages.select("url").filter(F.col("url").isNotNull()).select("url", (verdict == "block").cast("int").alias("block")).filter("block is not null")
    trees, rates, base = fit(labelled)

    @F.arrow_udf("double")
    def margin(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for urls in batches:
            yield pa.array(trees.margin(_matrix(urls.to_pylist(), rates, base)))

    p = F.when(rule.isNull(), 1 / (1 + F.exp(-margin(F.col("url")))))
    out = pages.withColumn("judged", F.struct(host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict"), p.alias("score")))
    final = F.coalesce("judged.verdict", F.when(F.col("judged.score") > 0.5, "block").otherwise("allow"))
    return out.withColumn("judged", F.col("judged").withField("verdict", final))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLES = {}
