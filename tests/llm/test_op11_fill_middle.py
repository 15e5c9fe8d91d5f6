import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import LONG, TEXTS, documents, empty
from pyspark.sql import functions as F

from ledgerscope.llm.fill_middle import (Marks, boundaries, boundary_index, cut_at, fill_in_middle, fit_segments,
                                         index_of, restore)
from ledgerscope.llm.common import text_buffer

UNIT = re.compile(r"[^\n]*\n|[^\n]+")
SCHEMA = "doc_id long, text string"


def brute(doc, text, seed=7, percent=100, spm=50):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed=5, n=120):
    rng = random.Random(seed)
    out = ["\n", "\n\n\n", "a\n", "a\nb", "\nb", "é\n😀😀\nß", "<P>x\ny", "x\n<\nS>", "<P\n>", "x" * 5000 + "\n" + "y\n" * 3000, "\r\n\r\nx"]
    for _ in range(n):
        out.append("".join(rng.choice(["word", "é", "😀", " ", "\n", "\n", "x" * rng.randint(0, 400), "<"])
                           for _ in range(rng.randint(0, 300))))
    return out


def test_every_boundary_is_exact():
    rows = texts() + [None, "", LONG]
    raw, at = text_buffer(pa.array(rows, pa.string()))
    first, offsets = boundaries(raw, at)
    for i, text in enumerate(rows):
        want = [0, *np.cumsum([len(u) for u in UNIT.findall(text or "")]).tolist()]
        assert offsets[first[i]:first[i + 1]].tolist() == want


@pytest.mark.parametrize("bound", [1, 9, 127, 1023])
def test_segments_keep_their_bound_and_predict_with_residuals(bound):
    rows = texts() + ["", LONG.replace(" ", "\n")]
    for text, index in zip(rows, index_of(pa.array(rows), bound).to_pylist()):
        want = [0, *np.cumsum([len(u) for u in UNIT.findall(text)]).tolist()]
        knots, at, residuals = index["ranks"], index["offsets"], index["residuals"]
        assert knots[0] == 0 and knots[-1] == len(want) - 1 and at[-1] == len(text) and len(residuals) == len(want)
        assert max(map(abs, residuals)) <= bound
        for rank, offset in enumerate(want[:-1]):
            i = sum(k <= rank for k in knots)
            rise, run = at[i] - at[i - 1], knots[i] - knots[i - 1]
            assert at[i - 1] + rise * (rank - knots[i - 1]) // run + residuals[rank] == offset


def test_even_lines_need_one_segment():
    first, offsets = boundaries(*text_buffer(pa.array(["twelve chars\n" * 5000])))
    assert len(fit_segments(first, offsets)[0]) == 1


def test_stored_index_gives_every_cut(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], SCHEMA)
    each = boundary_index(docs, bound=3).withColumn("rank", F.explode(F.expr(
        "sequence(0, element_at(line_index.ranks, -1))"))).withColumn("at", cut_at(F.col("line_index"), F.col("rank")))
    got = {}
    for r in each.select("doc_id", "rank", "at").collect():
        got.setdefault(r["doc_id"], {})[r["rank"]] = r["at"]
    for i, text in enumerate(texts()):
        assert [got[i][r] for r in sorted(got[i])] == [0, *np.cumsum([len(u) for u in UNIT.findall(text)]).tolist()]


@pytest.mark.parametrize("percent, spm", [(100, 50), (60, 0), (0, 50)])
def test_against_brute_force(spark, percent, spm):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts() + TEXTS)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.monotonically_increasing_id())
    out = fill_in_middle(docs, percent=percent, spm_percent=spm).withColumn(
        "back", restore(F.col("output"), F.col("form"))).orderBy("at").collect()
    assert len(out) == len(rows)
    for (doc, text), r in zip(rows, out):
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(
            doc, text, percent=percent, spm=spm)
        assert r["back"] == (text or "")


def test_stored_index_and_other_marks(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], SCHEMA)
    marks = Marks("<|pre|>", "<|suf|>", "<|mid|>")
    made = fill_in_middle(boundary_index(docs), index="line_index", marks=marks)
    assert "line_index" in made.columns
    rows = made.withColumn("back", restore(F.col("output"), F.col("form"), marks)).collect()
    assert all(r["back"] == r["text"] for r in rows)
    assert sum(r["form"] == "plain" for r in rows) == sum(not t for t in texts())
    with pytest.raises(ValueError):
        boundary_index(docs, bound=40_000)


def test_awkward_documents(spark):
    docs = documents(spark, extra=True).withColumn("n", F.lit("own")).withColumn("output", F.lit("own"))
    out = fill_in_middle(docs).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["text"])
        assert r["score"] == "own"
    assert fill_in_middle(empty(spark)).count() == 0


def test_one_map_stage(spark):
    plan = fill_in_middle(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_query(spark):
    from ledgerscope.llm.queries import queries
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries()["op11_fill_middle"](spark, folder).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc, text in rows:
        n, form, p, m, output = brute(doc, text)
        assert tuple(got[doc]) == (doc, n, form, p, m, sha(output), sha(text))


def test_small_cuts_of_files_are_read_together(spark, tmp_path):
    """Each written file costs a process of the executor; cuts of a few KB don't become tasks, and so files, of their own."""
    import glob
    from ledgerscope.llm import common
    from ledgerscope.llm.fill_middle import op11_fill_middle
    key, folder, out = "spark.sql.files.maxPartitionBytes", str(tmp_path / "tables"), str(tmp_path / "out")
    rows = [(i, t) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, SCHEMA).repartition(24).write.parquet(f"{folder}/documents.parquet")
    kept, opened = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set(key, "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "4k")
        table = common.table(spark, folder, "documents")
        assert table.rdd.getNumPartitions() >= 24
        assert common.joined(table).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        op11_fill_middle(spark, folder).write.parquet(out)
    finally:
        spark.conf.set(key, kept)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)
    assert len(glob.glob(f"{out}/part-*")) <= spark.sparkContext.defaultParallelism
    got = {r["doc_id"]: r for r in spark.read.parquet(out).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        n, form, p, m, output = brute(doc, text)
        assert (got[doc]["n"], got[doc]["form"], got[doc]["prefix_chars"], got[doc]["middle_chars"]) == (n, form, p, m)
        assert got[doc]["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()


def test_tasks_grow_with_the_files(spark, monkeypatch):
    """Whole rounds of the cores, and no task of more than about ``TASK_BYTES`` of cuts."""
    from ledgerscope.llm import common
    key, cores = "spark.sql.files.maxPartitionBytes", spark.sparkContext.defaultParallelism
    kept = spark.conf.get(key)
    cuts = spark.range(1000, numPartitions=40 * cores)
    try:
        spark.conf.set(key, "1MB")
        monkeypatch.setattr(common, "TASK_BYTES", 30 << 20)
        assert common.joined(cuts).rdd.getNumPartitions() == 2 * cores
        monkeypatch.setattr(common, "TASK_BYTES", 1 << 20)
        assert common.joined(cuts) is cuts
    finally:
        spark.conf.set(key, kept)
    assert common.joined(cuts) is cuts
    assert [common._bytes(x) for x in ("16m", "1MB", "134217728b", "512", "2GiB")] == [16 << 20, 1 << 20, 128 << 20, 512, 2 << 30]
