"""Scalar functions on the cases that matter."""

import pytest
from pyspark.sql import functions as F

from tablesmith.functions import text
from tablesmith.operators import columns, quality
from tablesmith.plans import intent


def values(spark, fn, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [r[1] for r in df.select("i", fn(F.col("c"))).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (text.clean_price, {"$1,299.99": 1299.99, "29,99 €": 29.99, "1.234.567,5": 1234567.5, "1,234,567": 1234567.0, "1.2.3": 12.3, "none": None, "": None, None: None, "-5": -5.0, "12,345": 12345.0}),
        (text.parse_numeric, {"$2.7T": 2.7e12, "1.8%": 1.8, "−3": -3.0, "16 GB": 16.0, "15.6 inches": 15.6, "1,200k": 1.2e6, "abc": None, "2m": 2e6, None: None}),
        (text.numeric_like, {"Team 76": 76.0, "4.1bn": 4.1e9, "$51.4M": 51.4e6, "250k": 250e3, "2t": None, "n/a": None, "1_000": None}),
        (text.parse_money, {"Loan fee: €250k": 250e3, "1.5m": 1.5e6, "4.1bn": 4.1e9, "free transfer": 0.0, "2b": 0.0, None: 0.0, "USD 30": 30.0}),
        (text.is_numeric_like, {"P12": True, "1,200.5%": True, "x1": False, "": False, None: False}),
        (text.strict_double, {"1d": None, "1_000": None, "1e3": 1000.0, ".5": 0.5, "inf": None, "5.": 5.0}),
        (text.canonical_key, {"SpaceX": "spacex", "OpenAI": "openai", "ScaleAI": "scaleai", "Acme Corp. [a]": "acme", "A & B Group": "a and", "nan": "", None: "", "New York": "new york"}),
        (text.root_domain, {"https://a.b.co.uk/x": "b.co.uk", "http://WWW.Example.COM:80/": "example.com", "http://x.y.example.org": "example.org", "mailto:x": "", None: ""}),
        (text.normalize_url, {" HTTP://A.com/Path?Q ": "http://a.com/Path?Q", "ftp://x": "", "": "", "https://B.org": "https://b.org"}),
        (text.clean_cell, {" a[1]  b ": "a b", "N/A": None, "\xa0x\xa0": "x"}),
        (text.season_year, {"ncaa things": 2025, "from 1999 to 2012": 2012, "player pay": 2026}),
    ],
)
def test_functions(spark, fn, cases):
    got = values(spark, fn, list(cases))
    assert [pytest.approx(x) if isinstance(x, float) else x for x in cases.values()] == got


def test_specs(spark):
    got = values(spark, text.extract_specs, ["16GB RAM DDR5, 512GB SSD, RTX 4060", "2TB SSD", None])
    assert (got[0]["ram_gb"], got[0]["storage_gb"], got[0]["gpu_model"]) == (16, 512, "RTX 4060")
    assert got[1]["storage_gb"] == 2048 and got[2]["ram_gb"] is None


def test_sources(spark):
    got = spark.sql("SELECT 'a | b' AS x, 'b|c ' AS y, cast(null AS string) AS z").select(text.join_sources(F.col("x"), F.col("y"), F.col("z"))).first()[0]
    assert got == "a | b | c"


def test_names():
    assert columns.normalize("Tm. PTS/G %") == "team_pts_per_g_pct"
    assert columns.final_labels(["salary_salary", "points_per_game_value", "source_url", "salary"]) == ["salary", "points_per_game", "source", "salary_2"]
    assert columns.unique(["a", "b", "a"]) == ["a", "b", "a_2"]
    assert columns.unique(["a", "a_2", "a"]) == ["a", "a_2", "a_3"]
    assert [columns.final_label(x) for x in ("a_b_a_b_12", "a_b_c_d_2024_5", "value", "x_x_y", "_")] == ["a_b", "a_b_c_d_2024", "value", "x_y", "_"]
    assert columns.prefixed(["rank", "2025", "wins"], columns.metric_of("https://www.teamrankings.com/nba/stat/points-per-game?x=1")) == {"2025": "points_per_game_2025", "wins": "points_per_game_wins"}
    assert columns.metric_of("https://x.example/a") is None and columns.metric_of("http://espn.com/nba/salaries/_/year") == "salary"
    assert columns.prefixed_by_number(["rank", "avg"], "https://x.example/145/") == {"avg": "scoring_offense_avg"}
    assert columns.column_order(["z", "source", "gdp", "n", "wins", "b", "name"], ["b"], ["n"], "most wins") == ["name", "b", "gdp", "wins", "n", "z", "source"]
    assert [columns.slug("Über Uns!"), columns.slug("!!", "ml_dataset"), columns.slug("Über Uns!", any_letters=True)] == ["ber_uns", "ml_dataset", "über_uns"]
    assert columns.width(8, 5) == 12 and columns.width(8, 50) == 24


def test_bounds():
    assert quality.bounds("birth_year") == (1800.0, 2100.0)
    assert quality.bounds("salary") == (0.0, None)
    assert quality.bounds("market_cap") is None  # words are matched one by one
    assert quality.bounds("growth_rate") is None and quality.bounds("tax_rate") == (0.0, 100.0)
    assert quality.bounds("win_percentage") == (0.0, 100.0) and quality.bounds("income_share") == (0.0, 100.0)
    assert quality.bounds("change_pct") == (-100.0, 500.0) and quality.bounds("price_change_pct") == (0.0, 500.0)
    assert quality.bound_pairs(["salary_min", "salary_max", "x_low"]) == [("salary_min", "salary_max")]


def test_goals():
    goal = intent.read_goal("Predict NBA player salary from performance stats")
    assert (goal.entity, goal.domain, goal.target, goal.features) == ("player", "nba", "salary", ("performance_stats",))
    assert intent.row_count_fits(30, 30, True) and not intent.row_count_fits(80, 30, True)
