"""Birth date spellings, and the count of those that no format reads."""

import datetime as dt

from frames import ledger_tables, user
from pyspark.sql import functions as F

from ledgerscope.functions import text
from ledgerscope.functions.periods import Window
from ledgerscope.operators import users

DAY = dt.date(1990, 6, 15)
SPELLED = ["1990-06-15", " 1990-06-15\t", "1990/06/15", "15/06/1990", "06/15/1990", "6/15/1990", "19900615",
           "June 15, 1990", "Jun 15, 1990", "15 June 1990", "15.06.1990", "15-06-1990", "1990-06-15T10:00:00"]


def test_spellings(spark):
    df = spark.createDataFrame([(s,) for s in SPELLED], "s string")
    assert {r["s"]: r["d"] for r in df.select("s", text.birth_date(F.col("s")).alias("d")).collect()} == {
        s: DAY for s in SPELLED}


def test_no_dates_become_null_and_month_comes_first(spark):
    rows = ["n/a", "", "31/31/1990", "soon", None, "199"]
    df = spark.createDataFrame([(s,) for s in rows], "s string")
    got = [r[0] for r in df.select(text.birth_date(F.col("s"))).collect()]
    assert got[:5] == [None] * 5
    both = spark.createDataFrame([("05/06/1990",)], "s string").select(text.birth_date(F.col("s")))
    assert both.first()[0] == dt.date(1990, 5, 6)


def test_unparsed_are_counted(spark):
    t = ledger_tables(spark, users=[user(i, created_at="2024-01-05", dob=d) for i, d in enumerate(
        ["1990-06-15", "June 15, 1990", "n/a", None])])
    r = users.unparsed_birth_dates(t, Window.of("2024-01-01", "2024-02-01")).first()
    assert (r["given"], r["unparsed"]) == (3, 1)


def both_ways(spark, dobs):
    return ledger_tables(spark, users=[user(i, created_at="2024-01-05", dob=d) for i, d in enumerate(dobs)])


def test_the_column_settles_day_and_month(spark):
    w, as_of = Window.of("2024-01-01", "2024-02-01"), dt.date(2024, 1, 31)
    clean = lambda dobs: {r["user_id"]: r["dob"] for r in users.user_clean(both_ways(spark, dobs), w, as_of).collect()}
    day_first = clean(["03/04/1990", "25/12/1990", "13-01-1980", "12/31/1985", "03-04-1990"])
    assert day_first["0"] == dt.date(1990, 4, 3) == day_first["4"]
    assert (day_first["1"], day_first["3"]) == (dt.date(1990, 12, 25), dt.date(1985, 12, 31))
    assert clean(["03/04/1990", "12/25/1990"])["0"] == dt.date(1990, 3, 4)
    assert clean(["03/04/1990", "1990-01-02"])["0"] == dt.date(1990, 3, 4)  # no vote: the month is first


def test_few_parses_in_the_plan(spark):
    from ledgerscope.plans import catalog
    for key in ("user_clean", "dist_age_group", "dist_gender"):
        plan = catalog.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("AS date)") + plan.count("as date)") <= 12, key


def test_wrong_and_odd_spellings(spark):
    rows = ["31/02/1990", "00/01/1990", "June 31, 1990", "Sept 3, 1990", "1990/13/01", "19901301", "3 Foo 1990", "JUNE 15, 1990", "15 jun 1990",
            "0/0/0", "1990-06-15x", "15/06-1990"]
    df = spark.createDataFrame([(s,) for s in rows], "s string")
    got = {r["s"]: r["d"] for r in df.select("s", text.birth_date(F.col("s")).alias("d")).collect()}
    assert got["JUNE 15, 1990"] == got["15 jun 1990"] == DAY
    assert all(v is None for k, v in got.items() if k not in ("JUNE 15, 1990", "15 jun 1990"))


def test_every_row_votes_by_plain_matches(spark):
    vote = {"25/12/1990": 1, "12-25-1990": -1, " 13/1/1990\n": 1, "1/13/1990　": -1, "12/12/1990": 0, "13/13/1990": 0, "13/00/1990": 1,
            "0/99/1990": -1, "13/12-1990": 0, "13/012/1990": 0, "13/1/199": 0, "1990-13-01": 0, "13.01.1990": 0, "13/01/1990x": 0,
            "13/01/1990\n\n": 1, "x\n13/01/1990": 0, "١٣/01/1990": 0, "": 0, None: 0}
    df = spark.createDataFrame([(s,) for s in vote], "s string")
    assert {r["s"]: r["v"] for r in df.select("s", text.day_first_votes(F.col("s")).alias("v")).collect()} == vote
    plan = df.agg(F.sum(text.day_first_votes(F.col("s"))))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "regexp_replace" not in plan  # compiled with the scan; no rewriting of each text
