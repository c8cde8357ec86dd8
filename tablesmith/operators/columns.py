"""Names of columns: normalising, prefixes, final labels and order. Inputs are headers, so this is driver-side."""

from __future__ import annotations

import re

#: Spellings in headers; columns that keep their names on pages of one metric, by kind of page; the pages
#: whose columns are named after them, and how; and the metrics of numbered pages.
SPELLINGS = (("%", "_pct"), ("/", "_per_"), ("tm.", "team"), ("opp.", "opponent"))
UNPREFIXED = ("rank", "team", "name", "player", "school", "club", "company", "bank", "state", "organization", "entity_name", "raw_entity_name")
UNPREFIXED_NUMBERED = ("rank", "team")
METRIC_PAGES = (("teamrankings.com/nba/stat/", None), ("hoopshype.com/salaries/players", "salary"), ("espn.com/nba/salaries", "salary"))
METRICS = {
    "145": "scoring_offense", "146": "scoring_defense", "147": "scoring_margin", "148": "field_goal_pct", "149": "field_goal_pct_defense",
    "150": "free_throw_pct", "151": "rebound_margin", "152": "three_point_pct", "168": "winning_pct", "214": "blocks_per_game",
    "215": "steals_per_game", "216": "assists_per_game", "217": "turnovers_per_game", "474": "assist_turnover_ratio",
    "518": "three_point_pct_defense", "519": "turnover_margin", "931": "turnovers_forced_per_game", "932": "rebounds_per_game",
    "1288": "effective_fg_pct",
}
#: Parts of names that come first among a final table's other columns.
PRIORITY = ("target", "label", "outcome", "salary", "valuation", "revenue", "income", "gdp", "growth")


def normalize(name: str) -> str:
    """Lower case, `%`, `/`, `tm.` and `opp.` spelled out, everything else to single underscores."""
    low = name.strip().lower()
    for old, new in SPELLINGS:
        low = low.replace(old, new)
    return re.sub(r"[^a-z0-9]+", "_", low).strip("_")


def unique(names: list[str]) -> list[str]:
    """Repeated names get `_2`, `_3` and so on, the first that is free."""
    seen: dict[str, None] = {}
    for n in names:
        k = 1
        while (made := n if k == 1 else f"{n}_{k}") in seen:
            k += 1
        seen[made] = None
    return list(seen)


def metric_of(url: str) -> str | None:
    """What a page's columns are named after: the last part of a metric page's path, or what stands for the page."""
    for part, name in METRIC_PAGES:
        if part in url:
            path = re.sub(r"^[a-z]+://[^/?#]*", "", url).split("?")[0].split("#")[0]
            return name or normalize(path.rstrip("/").rpartition("/")[2])
    return None


def prefixed(names: list[str], prefix: str | None, fixed: tuple[str, ...] = UNPREFIXED) -> dict[str, str]:
    """New names of metric columns: the page's metric comes first; identity columns keep theirs."""
    return {n: f"{prefix}_{n}" for n in names if prefix and n not in fixed and not n.startswith(f"{prefix}_")}


def prefixed_by_number(names: list[str], url: str) -> dict[str, str]:
    """The same for pages whose last part is the number of a metric."""
    prefix = METRICS.get(url.rstrip("/").rpartition("/")[2])
    return {n: f"{prefix}_{n}" for n in names if prefix and n not in UNPREFIXED_NUMBERED}


def final_label(name: str) -> str:
    """`source_url` to `source`; a beginning of two parts or more that is said again (but for a number behind it) said
    once; short numbers off the end of long names; repeated neighbours and `_value` at the end off."""
    if name == "source_url":
        return "source"
    number = lambda p: p.isdigit() and len(p) <= 2
    parts = [p for p in name.split("_") if p]
    for n in range(2, len(parts) // 2 + 1):
        if parts[:n] == parts[n : 2 * n] and all(map(number, parts[2 * n :])):
            parts = parts[:n]
            break
    while len(parts) > 4 and number(parts[-1]):
        parts = parts[:-1]
    parts = [p for i, p in enumerate(parts) if i == 0 or p != parts[i - 1]]
    return "_".join(parts[:-1] if len(parts) > 1 and parts[-1] == "value" else parts) or name


def final_labels(names: list[str]) -> list[str]:
    return unique([final_label(n) for n in names])


def words(label: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", label.lower()) if w]


def column_order(names: list[str], schema: list[str], numbers: list[str] = (), goal: str = "") -> list[str]:
    """name, entity_name, schema fields; then what may be a target, what the goal names, numbers, others, each by name; sources last."""
    first = [n for n in dict.fromkeys(["name", "entity_name", *schema]) if n in names]
    asked = set(words(goal))

    def place(n: str) -> tuple:
        low = n.lower()
        kinds = (low in ("source", "source_url"), (4, 0)), (any(p in low for p in PRIORITY), (1, 0)), (any(w in low for w in asked), (2, 0)), (n in numbers, (2, 1))
        return *next((at for holds, at in kinds if holds), (3, 0)), low

    return first + sorted((n for n in names if n not in first), key=place)


def width(minimum: int, rows: int) -> int:
    """Most columns of a final table."""
    return max(minimum, min(24, max(12, 2 * rows)))


def slug(name: str, otherwise: str = "dataset", any_letters: bool = False) -> str:
    """A name for files: words of ASCII letters and digits (or of any letters) joined by underscores; `otherwise` if there are none."""
    return re.sub(r"[\W_]+" if any_letters else r"[^a-z0-9]+", "_", name.lower()).strip("_") or otherwise
