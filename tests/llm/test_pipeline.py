"""Stages against their own brute-force rules, on small tables and awkward documents."""

import re

import corpus_pipeline as pipeline
from ledgerscope.llm import common
import pytest
from llm_cases import documents, empty
from test_op4_decontamination import brute as windows
from test_op10_jaccard_join import brute as groups

DIR = "/root/testdata/sf0.001"
SECRET = re.compile(r'AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}')


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = pipeline.table(spark, DIR, "documents"), []
    for name, stage in pipeline.STAGES:
        result = pipeline.durable(stage(spark, docs, DIR), name)
        out.append((docs, result))
        docs = result
    return out


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "secret_scan",
                                               "sentencepiece"]
    for before, after in stages[:-1]:
        assert before.columns == after.columns and before.dtypes == after.dtypes


def test_language_keeps_documents_with_a_clear_language(stages):
    before, after = stages[0]
    kept = set(rows(after, *before.columns))
    gone = [r for r in rows(before, *before.columns) if r not in kept]
    assert kept <= set(rows(before, *before.columns)) and all(len(r[1]) < 60 for r in gone)


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1]
    want = {doc for doc, _, least in groups(rows(before, "doc_id", "text")) if doc == least}
    assert sorted(r[0] for r in rows(after, "doc_id")) == sorted(want)


def test_contaminated_documents_go(spark, stages):
    before, after = stages[2]
    items = rows(pipeline.table(spark, DIR, "benchmark"), "item_id", "text")
    want = {doc for doc, _, hit, _ in windows(rows(before, "doc_id", "text"), items) if not hit}
    assert {r[0] for r in rows(after, "doc_id")} == want


def test_secrets_are_masked_and_nothing_else_changes(stages):
    before, after = stages[3]
    now = {r[0]: r for r in rows(after, "doc_id", "text", "n_chars")}
    assert len(now) == before.count()
    for doc, text, n in rows(before, "doc_id", "text", "n_chars"):
        if not SECRET.search(text):
            assert now[doc] == (doc, text, n)
        assert now[doc][2] == len(now[doc][1])


def test_pieces_give_the_texts(stages):
    before, after = stages[4]
    assert after.where("lossless").count() == before.count() > 100


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_documents_pass_every_stage(spark, extra):
    docs = documents(spark, extra)
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.durable(stage(spark, docs, DIR), name)
        assert out.columns == docs.columns
        if extra:
            assert out.where("score <> 'own' OR items <> 'own' OR pieces <> 'own'").count() == 0
        docs = out
    last = pipeline.STAGES[-1][1](spark, docs, DIR)
    assert last.count() == docs.count() == last.where("lossless").count()


def test_keys_joined_instead_of_broadcast(spark, stages, monkeypatch):
    monkeypatch.setattr(pipeline, "BROADCAST_KEYS", 0)
    before, after = stages[1]
    assert sorted(rows(pipeline.jaccard_join(spark, before, DIR), "doc_id")) == sorted(rows(after, "doc_id"))


def test_repeated_rows_and_null_ids_in_the_join(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(4, text, "en", "s", 1), (4, text, "en", "s", 1), (9, text, None, None, None),
                                  (None, text, "en", "s", 1), (None, None, None, None, None), (5, "", "en", "s", 0),
                                  (6, "", "en", "s", 0)], schema)
    out = pipeline.jaccard_join(spark, docs, DIR)
    assert sorted(rows(out, "doc_id"), key=str) == [(4,), (5,), (6,), (None,), (None,)]


def test_different_texts_of_one_id_are_different_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one, two = "one two three four five six seven eight nine ten", "a b c d e f g h i j k l m n"
    texts = [(4, one), (4, two), (9, one), (4, "other words stand in this third text of id four"), (2, two), (7, two), (4, ""),
             (4, None), (4, one), (1, "x y z"), (1, "x y z"), (3, "x y z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], schema)
    out = pipeline.jaccard_join(spark, docs, DIR)
    want = [(4, one), (4, "other words stand in this third text of id four"), (2, two), (4, ""), (4, None), (1, "x y z")]
    assert sorted(rows(out, "doc_id", "text"), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    docs = empty(spark)
    for _, stage in pipeline.STAGES:
        docs = pipeline.durable(stage(spark, docs, DIR), "empty")
        assert docs.count() == 0


def test_run(spark, stages):
    import os
    from ledgerscope.session import shared_dir
    folder, keys = shared_dir(spark), [k for k, _, _ in common._BATCHES]
    for key in keys:
        spark.conf.unset(key)
    before, conf = set(os.listdir(folder.removeprefix("file:"))), [spark.conf.get(k, None) for k in keys]
    got = pipeline.run(spark, DIR)
    new = set(os.listdir(folder.removeprefix("file:"))) - before
    assert len(new) == 1 and new.pop().startswith("pipeline-sentencepiece")
    assert [spark.conf.get(k, None) for k in keys] == conf
    assert sorted(rows(got, "doc_id", "n_pieces")) == sorted(rows(stages[-1][1], "doc_id", "n_pieces"))


def test_few_files_where_the_session_joins_no_partitions(spark, stages):
    """Each written file costs a process of the executor; a join's small steps are not written in a file a partition."""
    import glob
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "48"}
    kept = {key: spark.conf.get(key) for key in settings}
    before, after = stages[1]
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        with common.passing(spark) as folders:
            got = sorted(rows(pipeline.jaccard_join(spark, before, DIR), *before.columns))
            files = [len(glob.glob(f"{folder.removeprefix('file:')}/part-*")) for folder in folders]
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert got == sorted(rows(after, *after.columns))
    assert len(files) > 10 and max(files) <= max(spark.sparkContext.defaultParallelism, before.rdd.getNumPartitions())


def test_files_grow_with_the_rows(spark):
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "48"}
    kept = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        assert common._files(spark, 0) == spark.sparkContext.defaultParallelism
        assert common._files(spark, 20 * common.ROWS_A_FILE) == 20
        assert common._files(spark, 48 * common.ROWS_A_FILE) is None
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert common._files(spark, 0) is None


def test_known_rows_in_few_files_and_no_marker(spark):
    """Where the session joins small partitions, files go by size, not by the partitions of the step."""
    import glob
    import os
    with common.passing(spark) as folders:
        got = common.durable(spark.range(1000).repartition(40), "narrow", 1000)
        path = folders[0].removeprefix("file:")
        assert sorted(r["id"] for r in got.collect()) == list(range(1000))
        assert len(glob.glob(f"{path}/part-*")) <= spark.sparkContext.defaultParallelism
        assert not os.path.exists(f"{path}/_SUCCESS")


def test_held_until_the_end(spark):
    persistent = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = persistent()
    with common.holding() as hold:
        assert hold(spark.range(10)).where("id > 3").count() == 6 and persistent() == before + 1
    assert persistent() == before


def test_a_worker_keeps_one_tool(monkeypatch):
    monkeypatch.setattr(common, "_tools", {})
    first = common.tool(("one", 1), list)
    assert common.tool(("one", 1), list) is first
    other = common.tool(("two", 1), list)
    assert other is not first and list(common._tools) == [("two", 1)]
    common.put_away()
    assert not common._tools


def test_known_rows_in_a_file_per_so_many(spark):
    """A step's files follow its rows, not the cores, whether or not the session joins small partitions."""
    import glob
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    kept = {k: spark.conf.get(k) for k in (key, "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "48")
        for joins in ("true", "false"):
            spark.conf.set(key, joins)
            for known, most in ((1000, 1), (3 * common.ROWS_A_FILE, 3)):
                with common.passing(spark) as folders:
                    got = common.durable(spark.range(1000).repartition(40), "narrow", known)
                    assert sorted(r["id"] for r in got.collect()) == list(range(1000))
                    assert len(glob.glob(f"{folders[0].removeprefix('file:')}/part-*")) <= most
    finally:
        for k, value in kept.items():
            spark.conf.set(k, value)


def test_stages_read_small_cuts_together(spark, stages):
    """Map stages write a file a task; cuts of a few KB are read by as many tasks as there are cores."""
    settings = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "4k"}
    kept = {key: spark.conf.get(key) for key in settings}
    cores = spark.sparkContext.defaultParallelism
    wide = pipeline.durable(stages[0][0].repartition(24), "cuts")
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        assert wide.rdd.getNumPartitions() >= 24
        for k in (0, 2, 3, 4):
            out = pipeline.STAGES[k][1](spark, wide, DIR)
            assert out.rdd.getNumPartitions() <= cores, pipeline.STAGES[k][0]
        got = sorted(rows(pipeline.language_id(spark, wide, DIR), "doc_id", "text"), key=str)
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert got == sorted(rows(stages[0][1], "doc_id", "text"), key=str)
