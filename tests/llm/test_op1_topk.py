import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.llm.topk_search import Queries, search

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, is_query, k):
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in whole:
        if not is_query(qi):
            continue
        best = sorted((-sum(a * b for a, b in zip(q, c)), ci) for ci, c in whole if ci != qi)[:k]
        out += [(qi, r + 1, ci, -s) for r, (s, ci) in enumerate(best)]
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("seed, block, shard, group", [(1, 7, 50, 9), (2, 64, 1000, 512)])
def test_equals_brute_force_with_ties(spark, seed, block, shard, group):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 6) / 8]) for i in rng.permutation(230)]
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (503, [float("inf")] + [0.0] * 5),
             (None, [0.5] * 6), (504, []), (505, [0.5, 0.25]), (506, [0.5] * 6), (507, [0.5] * 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = collected(search(df.where("vec_id % 5 = 0"), df, k=20, block=block, shard=shard, group=group))
    assert got == brute(rows, lambda i: i % 5 == 0, 20)


def test_fewer_candidates_than_k_and_extra_columns(spark):
    rows = [(i, [i / 4.0, 1.0], "x", 9) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA + ", score string, rank int")
    got = collected(search(df, df, k=20))
    assert got == brute([r[:2] for r in rows], lambda i: True, 20)
    assert len(got) == 12


def test_empty_and_no_query(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert search(df, df).count() == 0
    some = spark.createDataFrame([(1, [1.0])], SCHEMA)
    assert search(df, some).count() == 0
    assert search(some, some).count() == 0


def test_repeated_rows_ask_each(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = search(df.where("vec_id = 1"), df, k=5).groupBy("query_id", "rank").count().collect()
    assert {(r["rank"], r["count"]) for r in got} == {(1, 2), (2, 2)}


def test_blocks_below_the_kth_score_are_not_read():
    rng = np.random.default_rng(3)
    centres = rng.integers(-40, 40, (30, 16))
    blocks = [(np.arange(i * 50, i * 50 + 50), centres[i] + rng.integers(-2, 3, (50, 16))) for i in range(30)]
    high = np.array([rows.max(axis=0) for _, rows in blocks])
    low = np.array([rows.min(axis=0) for _, rows in blocks])
    read = set()

    def block(i):
        read.add(i)
        return blocks[i]

    q = Queries(np.array([10_000]), centres[4:5], 10)
    scored = q.search(high, low, block)
    _, found, score = q.results()
    every = sorted((-int(r @ centres[4]), int(i)) for ids, rows in blocks for i, r in zip(ids, rows))[:10]
    assert [(-int(s), int(i)) for s, i in zip(score, found)] == every
    assert scored == len(read) < 15


def test_query_passes_the_whole_table(spark):
    from ledgerscope.llm.queries import queries
    got = queries()["op1_topk_search"](spark, "/root/testdata/sf0.001")
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert collected(got) == brute(rows, lambda i: i % 20 == 0, 20)
    assert dict(got.dtypes)["rank"] == "int"
    assert got.select(F.max("score")).first()[0] > 0
