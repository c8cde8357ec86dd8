"""Where a model may be plugged in: what is asked of it, when, and what happens without one.

A model is a callable given by the caller; nothing here calls a network. Every seam has a deterministic fallback.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.operators import profiling, records
from tablesmith.plans import blueprint
from tablesmith.session import materialise, ship

#: Records that a model merges at a time and at most, and times that it is asked for a blueprint; keys under which
#: answers hold their records.
BATCH, MOST, TRIES = 20, 40, 3
RECORD_KEYS = ("canonical_records", "extracted_records", "rows", "items", "data")
#: Ways to read a page, in the order in which they are tried.
STRATEGIES = ("domain_adapter", "json_payload", "react_state", "html_table", "document_text")


def json_part(answer: str) -> str:
    """The outermost object or array of an answer, whichever begins first; all of it if there is neither."""
    clean = "".join(c for c in answer if c >= " " or c in "\n\r\t").strip()
    spans = [(clean.find(a), clean.rfind(b)) for a, b in ("{}", "[]")]
    found = sorted((a, b + 1) for a, b in spans if 0 <= a < b)
    return clean[slice(*found[0])] if found else clean


def string_list(answer: str) -> list[str]:
    """The strings of a JSON list in an answer; anything but a list is an error."""
    a, b = answer.find("["), answer.rfind("]")
    value = json.loads(answer[a : b + 1] if 0 <= a < b else answer.strip())
    if not isinstance(value, list):
        raise ValueError("a list was asked for")
    return [x for x in value if isinstance(x, str)]


def records_of(value) -> list:
    """The records of an answer: the list itself, or what stands under `records`, a like name, or the first list there is."""
    if isinstance(value, list):
        return value
    if not isinstance(value, dict):
        return []
    if "records" in value:
        return value["records"] if isinstance(value["records"], list) else []
    named = [value[k] for k in RECORD_KEYS if isinstance(value.get(k), list)]
    return next(iter(named), next((v for v in value.values() if isinstance(v, list)), []))


def wants_merge(df: DataFrame, key: str, model: Callable | None) -> bool:
    """Whether a model is to merge records: there is one, there are MOST at most, and they aren't clean already."""
    if model is None or df.limit(MOST + 1).count() > MOST:
        return False
    return not records.cleanliness(df, key).first()["clean"]


def merge(df: DataFrame, key: str, pos: str, model: Callable[[list[dict], list[dict]], list[dict]] | None = None) -> DataFrame:
    """Records merged: by a model in batches of BATCH (known ones, new ones → merged ones) and once more over the result, where
    it is wanted; else field by field by preference."""
    if not wants_merge(df.drop(pos), key, model):
        return records.merge_records(df, key, pos)
    rows = [r.asDict(recursive=True) for r in df.orderBy(pos).limit(MOST).collect()]
    merged: list[dict] = []
    for lo in range(0, len(rows), BATCH):
        merged = model(merged, rows[lo : lo + BATCH])
    merged = model([], merged)
    return df.sparkSession.createDataFrame([tuple(m.get(c) for c in df.columns) for m in merged], df.schema)


def drop_by_meaning(df: DataFrame, target: str, protected: tuple[str, ...], model: Callable[[list[str], str], str] | None = None) -> list[str]:
    """Columns that a model calls irrelevant to the target; none without a model, or if its answer is no list."""
    asked = [c for c in df.columns if c != target and c not in protected]
    if model is None or not asked:
        return []
    try:
        named = string_list(model(asked, target))
    except ValueError:
        return []
    return list(dict.fromkeys(c.strip() for c in named if c.strip() in asked))


@dataclass(frozen=True)
class Target:
    column: str | None
    task: str
    dropped: tuple[str, ...]


def infer_target(df: DataFrame, goal: str, model: Callable[[str, list[str]], dict] | None = None) -> Target:
    """Target, task and features to drop: the better of the model's column and the names' and values' own, by their score."""
    own = profiling.infer_target(df, goal)
    answer = model(goal, df.columns) if model else {}
    candidates = [c for c in (answer.get("inferred_target_column") or answer.get("target"), own) if c in df.columns]
    best = profiling.best_candidate(df, goal, candidates)
    dropped = answer.get("dropped_features") or profiling.dropped_features(df.columns)
    return Target(best, answer.get("ml_task_type") or answer.get("task_type") or profiling.task_type(df, best), tuple(dropped))


def design(goal: str, count: int | None = None, model: Callable[[str], str] | None = None) -> blueprint.Blueprint:
    """A goal's blueprint: by its own template if it is one of those that have one, else by a model, asked up to TRIES times until
    its answer makes a valid one; without a model, or if no answer does, by the template for all goals."""
    for _ in range(0 if model is None or blueprint.has_own(goal) else TRIES):
        try:
            got = blueprint.recover(json.loads(json_part(model(goal))))
        except (ValueError, AttributeError):
            continue
        made = blueprint.normalise(got["dataset"], got["fields"], got["target"], got["records"], count, got["required"], tuple(u for u, _ in got["sources"]))
        if not blueprint.validate(made):
            return made
    return blueprint.design(goal, count)


def extract(texts: DataFrame, column: str, schema: str, model: Callable[[str], str] | None = None) -> DataFrame:
    """texts with `records`, an array of structs: what a model reads from a state or a document's text; without one, none.

    The model is called where the texts are, once for each; an answer that holds no records gives none.
    """
    kind = f"array<struct<{schema}>>"
    ship(texts.sparkSession)
    if model is None:
        return texts.withColumn("records", F.array().cast(kind))

    def read(text: str | None) -> str | None:
        try:
            return json.dumps(records_of(json.loads(json_part(model(text))))) if text else None
        except ValueError:
            return None

    answered = texts.withColumn("__answer", F.udf(read, "string")(column))
    return materialise(answered, "seam-answers").withColumn("records", F.coalesce(F.from_json("__answer", kind), F.array().cast(kind))).drop("__answer")


def route(pages: DataFrame, ok: str, counts: dict[str, str], browser: str) -> DataFrame:
    """pages with `strategy` and `needs_browser`: the first way to read a page that gives records.

    counts: for each strategy the column with its number of records (a strategy without one gives none). Pages that
    weren't fetched, and those that nothing could be read from, go to the browser if their type allows that.
    """
    out = F.lit("browser")
    for s in reversed(STRATEGIES):
        if s in counts:
            out = F.when(F.coalesce(F.col(counts[s]), F.lit(0)) > 0, s).otherwise(out)
    first = F.coalesce(F.col(counts[STRATEGIES[0]]), F.lit(0)) > 0 if STRATEGIES[0] in counts else F.lit(False)
    chosen = F.when(first, STRATEGIES[0]).when(~F.coalesce(F.col(ok), F.lit(False)), "fetch_failed").otherwise(out)
    return pages.withColumn("strategy", chosen).withColumn("needs_browser", F.col("strategy").isin("fetch_failed", "browser") & F.coalesce(F.col(browser), F.lit(False)))
