"""Date presets, bounds, text clean-up and number formatting."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions import formatting, text
from ledgerscope.functions.periods import PRESETS, Window, date_presets, preset_window

WED = dt.date(2024, 1, 31)


def preset_bounds_sql(d: str) -> list[tuple[str, str, str]]:
    """(name, start, end) SQL date expressions per preset, in menu order."""
    def minus(days: str) -> str:
        return f"CAST({d} - CAST({days} AS INTEGER) AS DATE)"
    last_sunday = minus(f"CASE WHEN dayofweek({d}) = 0 THEN 7 ELSE dayofweek({d}) END")
    month1 = f"CAST(DATE_TRUNC('month', {d}) AS DATE)"
    return [
        ("Today", d, d),
        ("Past 7 Days", minus("6"), d),
        ("Last 14 Days", minus("13"), d),
        ("This Week", minus(f"CAST(dayofweek({d}) AS INTEGER)"), d),
        ("Last Week", f"CAST({last_sunday} - 6 AS DATE)", last_sunday),
        ("Last 30 Days", minus("29"), d),
        ("Last Month", f"CAST({month1} - INTERVAL 1 MONTH AS DATE)", f"CAST({month1} - 1 AS DATE)"),
        ("All Time", "DATE '2022-01-01'", d),
    ]


def test_presets_on_a_wednesday():
    want = {
        "Today": ("2024-01-31", "2024-01-31"),
        "Past 7 Days": ("2024-01-25", "2024-01-31"),
        "Last 14 Days": ("2024-01-18", "2024-01-31"),
        "This Week": ("2024-01-28", "2024-01-31"),      # weeks start on Sunday
        "Last Week": ("2024-01-22", "2024-01-28"),      # Monday .. that Sunday
        "Last 30 Days": ("2024-01-02", "2024-01-31"),
        "Last Month": ("2023-12-01", "2023-12-31"),
        "All Time": ("2022-01-01", "2024-01-31"),
    }
    for name, (lo, hi) in want.items():
        assert preset_window(name, WED) == Window.of(lo, hi), name


def test_presets_on_sunday_and_monday():
    sun, mon = dt.date(2024, 2, 4), dt.date(2024, 2, 5)
    assert preset_window("This Week", sun) == Window(sun, sun)
    assert preset_window("Last Week", sun) == Window.of("2024-01-22", "2024-01-28")
    assert preset_window("This Week", mon) == Window.of("2024-02-04", "2024-02-05")
    assert preset_window("Last Week", mon) == Window.of("2024-01-29", "2024-02-04")
    assert preset_window("Last Month", dt.date(2024, 3, 1)) == Window.of("2024-02-01", "2024-02-29")


def test_unknown_preset_raises():
    with pytest.raises(ValueError):
        preset_window("Yesterday", WED)


def test_spark_presets_equal_python_for_four_years(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2023-01-01', DATE'2026-12-31')) AS as_of")
    rows = date_presets(spark, days).collect()
    assert len(rows) == 1461 * 8
    for r in rows:
        w = preset_window(r["preset"], r["as_of"])
        assert (r["start_date"], r["end_date"]) == (w.start, w.end), (r["as_of"], r["preset"])
    assert [r["preset"] for r in rows[:8]] == list(PRESETS)


def test_oracle_preset_sql_equals_python_for_four_years():
    import duckdb
    con = duckdb.connect()
    d = dt.date(2023, 1, 1)
    cols = preset_bounds_sql("d")
    sel = ", ".join(f"{lo} AS lo{i}, {hi} AS hi{i}" for i, (_, lo, hi) in enumerate(cols))
    got = con.execute(f"SELECT d, {sel} FROM (SELECT CAST(x AS DATE) AS d FROM "
                      f"range(DATE '2023-01-01', DATE '2027-01-01', INTERVAL 1 DAY) t(x))").fetchall()
    assert len(got) == 1461
    for row in got:
        d = row[0]
        for i, (name, _, _) in enumerate(cols):
            w = preset_window(name, d)
            assert (row[1 + 2 * i], row[2 + 2 * i]) == (w.start, w.end), (d, name)


def test_window_bounds(spark):
    w = Window.of("2024-01-05", "2024-01-20")
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 20, 0, 0),), (dt.datetime(2024, 1, 20, 0, 0, 1),),
         (dt.datetime(2024, 1, 5, 0, 0),), (dt.datetime(2024, 1, 4, 23, 59, 59),)],
        "ts timestamp_ntz")
    got = df.select(w.ts_between("ts").alias("a"), w.day_between("ts").alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(True, True), (False, True), (True, True),
                                               (False, False)]


def test_strip_removes_tabs_newlines_and_unicode_spaces(spark):
    values = [" a ", "\tb\n", "\r\nc\x0b", " d　", "e", "", None, " f g "]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(text.strip(F.col("v"))).collect()]
    assert got == [None if v is None else v.strip() for v in values]


def test_aliases_whole_value_only(spark):
    df = spark.createDataFrame([("Non Binary",), ("non binary x",), (None,), ("MALE ",)], "v string")
    got = [r[0] for r in df.select(text.clean_label(F.col("v"), {"non binary": "non-binary"})).collect()]
    assert got == ["non-binary", "non binary x", None, "male"]


@pytest.mark.parametrize("v", [0.0, 1.005, 2.675, 0.125, 1234567.891, -1234.5, 1e13 + 0.25,
                               999.995, 12519.14, None])
def test_money_format_matches_python(spark, v):
    df = spark.createDataFrame([(v,)], "v double")
    got = df.select(formatting.money(F.col("v"))).collect()[0][0]
    assert got == (f"{v:,.2f}" if v is not None else "0.00")


@pytest.mark.parametrize("v", [0.0, 7.9, -7.9, 1234567.0, None])
def test_int_format_matches_python(spark, v):
    df = spark.createDataFrame([(v,)], "v double")
    got = df.select(formatting.integer(F.col("v"))).collect()[0][0]
    assert got == (f"{int(v):,}" if v is not None else "0")


def test_long_date(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 5),)], "d date")
    assert df.select(formatting.long_date(F.col("d"))).collect()[0][0] == WED.replace(day=5).strftime("%B %d, %Y")
