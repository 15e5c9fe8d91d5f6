import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
import pytest
from llm_cases import LONG, TEXTS, documents, empty, prose
from pyspark.sql import functions as F

from ledgerscope.llm.resampling import bucket_gains, draw, feature_counts, features, importance_scores

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def bag(text, buckets, lengths):
    w = words(text)
    return [crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(lengths[0], lengths[1] + 1)
            for i in range(len(w) - k + 1)]


def brute(docs, target, buckets=10_000, lengths=(1, 1), percent=10, least=20, seed=2024):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(bag(text, buckets, lengths))
    for text in target:
        t.update(bag(text, buckets, lengths))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
            for b in range(buckets)]
    rows = []
    for doc, text in docs:
        held = bag(text, buckets, lengths)
        weight = sum(gain[b] for b in held)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, len(held), weight, score, len(words(text)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    drawn = len(able) * percent // 100
    ranked = [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(able)]
    return ranked + [(*r[:4], None) for r in rows if not r[4]]


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def corpus(n=150, seed=4):
    rng = random.Random(seed)
    docs = [(i, prose(rng, rng.choice([0, 3, 19, 20, 60, 400]), alphabet="abcdé")) for i in range(n)]
    docs += [(None, prose(rng, 40)), (None, prose(rng, 40)), (3, docs[3][1]), (4, "Ä1 " * 30), (n, None), (n + 1, LONG)]
    return docs, [prose(rng, 200, alphabet="abc") for _ in range(5)] + [None, ""]


@pytest.mark.parametrize("lengths", [(1, 1), (1, 2), (2, 3)])
def test_features_of_a_batch(lengths):
    texts = [t for _, t in corpus()[0]] + TEXTS
    got = [[] for _ in texts]
    for bucket, parent in features(pa.array(texts, pa.string()), 1 << 40, lengths):
        for b, p in zip(bucket.tolist(), parent.tolist()):
            got[p].append(b)
    assert got == [bag(t, 1 << 40, lengths) for t in texts]


@pytest.mark.parametrize("lengths, buckets, percent, least", [((1, 1), 10_000, 10, 20), ((1, 2), 97, 35, 1), ((2, 2), 500, 100, 5)])
def test_against_brute_force(spark, lengths, buckets, percent, least):
    docs, target = corpus()
    rows = spark.createDataFrame(docs, SCHEMA).repartition(5)
    gains = bucket_gains(rows, spark.createDataFrame([(t,) for t in target], "text string"), buckets=buckets, lengths=lengths)
    scored = importance_scores(rows, gains, lengths=lengths).drop("text")
    out = draw(scored, percent=percent, least_words=least).select("doc_id", "n_features", "weight", "score", "rank")
    same(out.collect(), brute(docs, target, buckets, lengths, percent, least))


def test_counts_are_one_row_a_bucket_and_task(spark):
    docs = spark.createDataFrame([(i, "one two two") for i in range(1000)], SCHEMA).repartition(4)
    got = {r["bucket"]: r["count"] for r in feature_counts(docs).collect()}
    assert got == {crc32(b"one") % 10_000: 1000, crc32(b"two") % 10_000: 2000}


def test_ties_and_hot_copies_rank_by_key(spark):
    """Rows of one text and one hash tie; ranks have no gaps however many rows a score holds."""
    scored = spark.createDataFrame([(i, 50, 50, 7, 9) for i in range(4000)] + [(9999, 50, 50, 8, 10), (None, 50, 50, 7, 9)],
                                   "doc_id long, n_words long, n_features long, weight long, score long").repartition(7)
    out = draw(scored, percent=50).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 2002))
    assert [r["doc_id"] for r in out] == [9999, *range(2000)]


def test_prefers_the_target(spark):
    rng = random.Random(1)
    near = [(i, prose(rng, 80, alphabet="abc", size=30)) for i in range(100)]
    far = [(1000 + i, prose(rng, 80, alphabet="xyz", size=30)) for i in range(900)]
    docs = spark.createDataFrame(near + far, SCHEMA)
    target = spark.createDataFrame([(t,) for _, t in near[:20]], "text string")
    drawn = draw(importance_scores(docs, bucket_gains(docs, target)).drop("text")).where("rank IS NOT NULL").collect()
    assert len(drawn) == 100 and sum(r["doc_id"] < 1000 for r in drawn) > 90


def test_awkward_documents_and_empty_tables(spark):
    docs = documents(spark, extra=True).withColumns({c: F.lit("own") for c in ("weight", "rank", "bucket", "n_features")})
    target = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    scored = importance_scores(docs, bucket_gains(docs, target))
    assert scored.where("margin = 'own' AND bucket = 'own'").count() == len(TEXTS) + 1
    out = draw(scored.drop("text")).select("doc_id", "n_features", "weight", "score", "rank").collect()
    same(out, brute([(r["doc_id"], r["text"]) for r in docs.collect()], TEXTS))
    none = target.where("false")
    assert draw(importance_scores(empty(spark), bucket_gains(empty(spark), none))).count() == 0
    same(draw(importance_scores(docs, bucket_gains(docs, none)).drop("text")).select(
        "doc_id", "n_features", "weight", "score", "rank").collect(), brute([(r["doc_id"], r["text"]) for r in docs.collect()], []))


def test_query(spark):
    from ledgerscope.llm.queries import queries
    folder = "/root/testdata/sf0.001"
    got = queries()["op13_resampling"](spark, folder).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    same(got, brute(docs, target))
