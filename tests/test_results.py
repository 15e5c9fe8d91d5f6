"""Results are computed once for the same files and arguments, and anew when a file changes."""

import os
import threading
import time

import pytest
from frames import ledger_tables, tx, user

from ledgerscope.functions.periods import Window
from ledgerscope.operators import metrics, report
from ledgerscope.operators.results import ResultStore, SourceChanged
from ledgerscope.plans import params as P
from ledgerscope.sources import files
from ledgerscope.sources.tables import SOURCE_NAMES, fixture_tables, parquet_tables

SF = "/root/testdata/sf0.001"
W = Window.of("2024-01-01", "2024-02-01")


def small(spark, root, extra=()):
    t = ledger_tables(spark, transactions=[tx(1, "2024-01-03", 10, plan_id=1), *extra], users=[user(1)],
                      plans=[(1, 1, "savings_usd_a")])
    for logical, name in SOURCE_NAMES.items():
        getattr(t, logical).write.mode("overwrite").parquet(f"{root}/{name}")
    return parquet_tables(spark, root, fees=t.fees)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_second_call_reads_the_store_and_no_ledger_file(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    t = fixture_tables(spark, SF)
    first = report.mart_tables(t, P.WINDOW, P.AS_OF, store)
    assert len(store.entries()) == 1
    calls = []
    again = store.reuse("report_mart", {"window": P.WINDOW, "as_of": P.AS_OF}, t, lambda now, save: calls.append(1))
    assert not calls and set(report.MART_TABLES) <= set(again)
    for name in report.MART_TABLES:
        plan = plan_of(again[name])
        assert "events.parquet" not in plan and "customer.parquet" not in plan and str(tmp_path) in plan
        assert sorted(map(repr, again[name].collect())) == sorted(map(repr, first[name].collect()))
    direct = metrics.general_metrics(t, P.WINDOW)
    assert [tuple(r) for r in again["general_metrics"].collect()] == [tuple(r) for r in direct.collect()]
    assert report.mart_tables(t, Window.of("2024-01-06", "2024-01-20"), P.AS_OF, store) and len(store.entries()) == 2


def test_changed_and_added_files_force_a_rebuild(spark, tmp_path):
    root, store = str(tmp_path / "ledger"), ResultStore(spark, str(tmp_path / "store"))
    count = lambda t: report.reused("general_metrics", t, store=store, window=W).first()["deposit_count"]
    t = small(spark, root)
    assert count(t) == 1 and count(t) == 1 and len(store.entries()) == 1
    one = ledger_tables(spark, transactions=[tx(2, "2024-01-04", 5, plan_id=1)]).transactions
    one.write.mode("append").parquet(f"{root}/transactions")
    assert count(t) == 2 and count(parquet_tables(spark, root, fees=t.fees)) == 2 and len(store.entries()) == 2
    time.sleep(1.1)
    t = small(spark, root, [tx(3, "2024-01-05", 1, plan_id=1), tx(4, "2024-01-06", 1, plan_id=1)])
    assert count(t) == 3


def test_a_table_that_the_job_does_not_read_may_change(spark, tmp_path):
    root, store = str(tmp_path / "ledger"), ResultStore(spark, str(tmp_path / "store"))
    t = small(spark, root)
    before = store.key("general_metrics", {"window": W}, t, report.REUSABLE["general_metrics"][0])
    t.messages.limit(0).withColumnRenamed("user_ref", "user").write.mode("append").parquet(f"{root}/{SOURCE_NAMES['messages']}")
    assert store.key("general_metrics", {"window": W}, t, report.REUSABLE["general_metrics"][0]) == before
    assert store.key("user_insights", {"window": W}, t) != store.key("user_insights", {"window": P.WINDOW}, t)
    assert store.key("general_metrics", {"window": W}, t, fees=t.fees.limit(2)) != store.key("general_metrics", {"window": W}, t)


def test_two_writers_leave_one_valid_result(spark, tmp_path):
    store, t = ResultStore(spark, str(tmp_path / "store")), fixture_tables(spark, SF)
    meet, got = threading.Barrier(2), []

    def build(now, save):
        df = metrics.user_counts(now, P.WINDOW)
        meet.wait(30)
        save("user_counts", df)

    def run():
        got.append(store.reuse("user_counts", {"window": P.WINDOW}, t, build, ("users",))["user_counts"].collect())

    threads = [threading.Thread(target=run) for _ in range(2)]
    [x.start() for x in threads]
    [x.join(120) for x in threads]
    assert len(got) == 2 and got[0] == got[1]
    manifest, = store.entries().values()
    assert os.listdir(tmp_path / "store" / "data") == [manifest["run"]]


def test_publishing_twice_keeps_the_first(spark, tmp_path):
    path = str(tmp_path / "index" / "k.json")
    (tmp_path / "aside").mkdir()
    assert files.publish_text(spark, path, "one", str(tmp_path / "aside" / "a"))
    assert not files.publish_text(spark, path, "two", str(tmp_path / "aside" / "b"))
    assert files.read_text(spark, path) == "one" and os.listdir(tmp_path / "aside") in ([], [".a.crc"])


def test_a_change_during_the_run_is_not_stored(spark, tmp_path):
    root, store = str(tmp_path / "ledger"), ResultStore(spark, str(tmp_path / "store"))
    t = small(spark, root)

    def build(now, save):
        save("x", now.transactions)
        now.transactions.write.mode("append").parquet(f"{root}/transactions_new")
        now.users.limit(1).write.mode("append").parquet(f"{root}/users")

    with pytest.raises(SourceChanged):
        store.reuse("x", {}, t, build)
    assert store.entries() == {} and os.listdir(tmp_path / "store" / "data") == []


def test_lost_files_and_dead_runs(spark, tmp_path):
    store, t = ResultStore(spark, str(tmp_path / "store")), fixture_tables(spark, SF)
    first = report.reused("user_counts", t, store=store, window=P.WINDOW).collect()
    manifest, = store.entries().values()
    files.delete(spark, f"{store.root}/data/{manifest['run']}")
    assert report.reused("user_counts", t, store=store, window=P.WINDOW).collect() == first
    metrics.user_counts(t, P.WINDOW).write.parquet(f"{store.root}/data/dead/user_counts")
    assert store.sweep() == [] and store.sweep(-60) == ["dead"]
    assert report.reused("user_counts", t, store=store, window=P.WINDOW).collect() == first
    assert store.forget(3600) == 0 and store.forget(-1) == 1 and store.entries() == {}


def test_frames_without_files_are_computed_each_time(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    t = ledger_tables(spark, users=[user(1, created_at="2024-01-05")])
    assert report.reused("user_counts", t, store=store, window=W).first()["registered_users"] == 1
    assert store.entries() == {}
    assert report.reused("user_clean", fixture_tables(spark, SF), store=store, window=P.WINDOW, as_of=P.AS_OF).count() == 38


def test_batch_job_reuses_results(spark, tmp_path, capsys):
    from ledgerscope.__main__ import main
    args = ["--fixture", SF, "--preset", "Last 30 Days", "--as-of", "2024-01-31", "--results", str(tmp_path / "r"), "--local"]
    main(args)
    first = capsys.readouterr().out
    main(args)
    second = capsys.readouterr().out
    assert "(computed)" in first and "(reused)" in second
    assert first.splitlines()[:-1] == second.splitlines()[:-1] and len(first.splitlines()) == len(report.MART_TABLES) + 1
    with pytest.raises(SystemExit):
        main([*args, "--out", "x"])
