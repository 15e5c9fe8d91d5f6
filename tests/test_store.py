"""The co-partitioned store: no exchange between ledger and pairs, the window's months only, heavy pairs dealt."""

import pytest
from frames import ledger_tables, tx, user
from pyspark.sql import functions as F

from ledgerscope.functions.periods import Window
from ledgerscope.operators import ledger, trend
from ledgerscope.plans import params as P
from ledgerscope.sources import store
from ledgerscope.sources.tables import fixture_tables

SF = "/root/testdata/sf0.001"
W = Window.of("2024-02-03", "2024-03-10")


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("ledgerscope.broadcast.maxRows", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("ledgerscope.broadcast.maxRows")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def months(spark, hot=0):
    txs = [tx(i, f"2024-{1 + i % 5:02d}-{1 + i % 27:02d} 10:00:00", i + 1, ["deposit", "withdrawal", None][i % 3], plan_id=[1, 2, None, 77][i % 4],
              investment_plan_id=[None, 11, 12][i % 3], provider=["p", None, "Flex Dollar"][i % 7 % 3]) for i in range(120)]
    txs += [tx(1000 + i, f"2024-02-{1 + i % 27:02d} 10:00:00", 1, plan_id=1) for i in range(hot)]
    row = list(tx(900, "2024-02-05", 3, plan_id=1))
    row[7] = None
    return ledger_tables(spark, transactions=[*txs, tuple(row)], users=[user(1), user(2, restricted=True), user(3)],
                         plans=[(1, 1, "s"), (2, 2, "s")], investment_plans=[(11, 3, 7, "f", None), (12, 1, 8, "f", None)],
                         assets=[(7, "equity", None)])


def test_no_exchange_between_ledger_and_pairs(spark, tmp_path, no_broadcast):
    t = fixture_tables(spark, SF)
    made = store.open_store(spark, store.write_store(t, str(tmp_path / "s"), buckets=4))
    base = store.ledger_base(made)
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    assert rows(base) == rows(ledger.ledger_base(t))
    for grain in trend.GRANULARITIES:
        got = store.transaction_trend(made, P.WINDOW, grain)
        assert rows(got) == rows(trend.transaction_trend(t, P.WINDOW, grain))
    lines = store.transaction_trend(made, P.WINDOW)._jdf.queryExecution().executedPlan().toString().splitlines()
    join = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    assert not any("Exchange" in x for x in lines[join:])


def test_only_the_windows_months_are_read(spark, tmp_path):
    t = months(spark)
    made = store.open_store(spark, store.write_store(t, str(tmp_path / "s"), buckets=2))
    read = made.rows(W).inputFiles()
    assert {p.split("month=")[1][:7] for p in read if "month=" in p} == {"2024-02", "2024-03"}
    assert rows(store.transaction_trend(made, W)) == rows(trend.transaction_trend(t, W))
    assert rows(store.ledger_base(made)) == rows(ledger.ledger_base(t))  # rows without an instant too


def test_a_store_is_found_by_another_session(spark, tmp_path):
    t = months(spark)
    root = store.write_store(t, str(tmp_path / "s"), buckets=2)
    other = spark.newSession()
    for table in spark.catalog.listTables():
        if table.name.startswith("ledgerscope_"):
            spark.sql(f"DROP TABLE {table.name}")  # external: files stay
    assert rows(store.ledger_base(store.open_store(other, root))) == rows(ledger.ledger_base(t))
    with pytest.raises(ValueError):
        store.open_store(spark, str(tmp_path / "nowhere"))


def test_pairs_are_refreshed_when_owners_change(spark, tmp_path):
    t = months(spark)
    root = store.write_store(t, str(tmp_path / "s"), buckets=2)
    now = ledger_tables(spark, users=[user(1, restricted=True), user(2), user(3)])
    changed = type(t)(**{**{n: getattr(t, n) for n in ("transactions", "plans", "investment_plans", "assets", "profiles", "budgets",
                                                       "external_transactions", "messages")}, "users": now.users}, fees=t.fees)
    before = rows(store.ledger_base(store.open_store(spark, root)))
    store.refresh_pairs(changed, root)
    after = rows(store.ledger_base(store.open_store(spark, root)))
    assert after == rows(ledger.ledger_base(changed)) != before


def test_a_heavy_pair_lies_in_many_buckets(spark, tmp_path):
    t = months(spark, hot=900)
    made = store.open_store(spark, store.write_store(t, str(tmp_path / "s"), buckets=8))
    hot = made.ledger.filter("plan_key = '1' AND investment_key = ''")
    assert hot.select("salt").distinct().count() > 20
    held = [r["count"] for r in hot.groupBy(F.input_file_name().alias("f")).count().collect()]
    assert max(held) < 0.4 * sum(held)
    assert rows(store.ledger_base(made)) == rows(ledger.ledger_base(t))
