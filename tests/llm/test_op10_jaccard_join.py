import random
import re

import numpy as np
import pytest
from llm_cases import documents, empty, prose
from pyspark.sql import functions as F

from ledgerscope.llm import jaccard_join
from ledgerscope.llm.components import components
from ledgerscope.llm.jaccard_join import jaccard_classes, parity_bits, part_keys

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def near_copies(seed, n=170):
    """Groups at similarities around the threshold, chains, exact copies, a passage that many share."""
    rng = random.Random(seed)
    passage, texts = prose(rng, 40), []
    while len(texts) < n:
        base = prose(rng, rng.choice([3, 5, 6, 9, 12, 25, 60, 150, 400])).split()
        if rng.random() < 0.4:
            base[rng.randint(0, len(base)):0] = passage.split()
        for _ in range(rng.choice([1, 1, 2, 4, 8])):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                base[rng.randrange(len(base))] = f"new{rng.randint(0, 10**6)}"
            if rng.random() < 0.3:
                base += prose(rng, rng.randint(1, 1 + len(base) // 8)).split()
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def classes(spark, rows):
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect())


@pytest.mark.parametrize("seed, block", [(1, 4096), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies(seed)
    want = brute(rows)
    assert len({c for _, _, c in want}) < 0.8 * len(rows)
    assert classes(spark, rows) == want


def test_joined_texts_instead_of_broadcast_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", -1)
    rows = near_copies(3, 60)
    assert classes(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_linked_sets_share_a_bucket_and_pass_the_sketch(seed):
    rng = np.random.default_rng(seed)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        most = 10 ** 9
        base = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        n = len(base)
        gone, new = int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, n // 4 + 1))
        other = np.unique(np.concatenate([rng.permutation(base)[gone:], rng.integers(1, 2**63, new, dtype=np.uint64)]))
        common = len(np.intersect1d(base, other))
        if not len(other) or 100 * common < 80 * (n + len(other) - common):
            continue
        assert set(part_keys(base).tolist()) & set(part_keys(other).tolist())
        apart = sum(bin(a ^ b).count("1") for a, b in zip(parity_bits(base), parity_bits(other)))
        assert apart <= n + len(other) - 2 * common < most


def test_awkward_documents(spark):
    rows = jaccard_classes(documents(spark, extra=True)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert len(rows) == 14
    assert by[0] == [(0, 0)] and by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[4] == [(1, 4)]
    assert by[11] == [(2, 11)] and by[12] == [(2, 11)] * 2 and by[None] == [(1, None)]
    assert jaccard_classes(empty(spark)).count() == 0


def test_null_and_repeated_ids_link_like_others(spark):
    """Ids are attached at the end: a null or shared one neither hides a bucket nor breaks a chain."""
    base = [f"w{i}" for i in range(60)]
    near = lambda *at: " ".join(f"new{i}" if i in at else w for i, w in enumerate(base))
    other = " ".join(f"x{i}" for i in range(30))
    rows = [(None, near()), (5, near()), (6, near(59)),  # a set met first with a null id
            (7, other), (7, other + " y"),  # near copies that share an id
            (20, near(59, 58, 57, 56, 55)), (30, other + " y z")]
    far = [f"v{i}" for i in range(100)]
    rows += [(40, " ".join(far)), (None, " ".join(far[7:] + ["p"] * 1)), (41, " ".join(far[14:] + ["p"] * 1))]
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    want = brute([(10**6 if d is None else d, t) for d, t in rows])
    key = lambda r: (r[0], r[1], r[2])
    assert sorted(((10**6 if r[0] is None else r[0], r[1], r[2]) for r in got), key=key) == want
    assert {c for d, _, c in want if d in (5, 6)} == {5} and {c for d, _, c in want if d in (7, 30)} == {7}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1040)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(1000, 1040)) and 5 not in got


def test_a_star_is_written_once(spark):
    from ledgerscope.llm.common import passing
    with passing(spark) as folders:
        got = components(spark.createDataFrame([(1, i) for i in range(2, 30)] + [(40, 41)], "a long, b long"))
        assert len(folders) == 1 and {r["node"]: r["root"] for r in got.collect()} == {
            **dict.fromkeys(range(1, 30), 1), 40: 40, 41: 40}
        assert components(spark.createDataFrame([(3, 3), (None, 4)], "a long, b long")).count() == 0


def test_writes_few_folders_and_frees_what_it_held(spark):
    """Only what is read after the join, or in a round, is written."""
    from ledgerscope.llm.common import passing
    rng = random.Random(5)
    base = prose(rng, 60)
    rows = [(1, base), (2, base + " more"), (3, base + " other end"), (4, prose(rng, 60)), (5, None)]
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    with passing(spark) as folders:
        assert [c for _, _, c in sorted(classes(spark, rows))] == [1, 1, 1, 4, 5]
        names = [folder.rsplit("/", 1)[1].rsplit("-", 1)[0] for folder in folders]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
    assert sorted(n for n in names if n != "edges") == [
        "buckets", "mixed", "pairs", "pairs", "sets", "sets", "shared-keys", "sketches"]


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    """300 near copies meet their bucket's smallest member, not each other."""
    rng = random.Random(8)
    base = prose(rng, 120).split()
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w)))
    seen = []
    verified = jaccard_join._verified

    def counted(pairs, *rest):
        seen.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    assert {c for _, _, c in classes(spark, rows)} == {0}
    assert sum(seen) < 10 * len(rows)


def test_query(spark):
    from ledgerscope.llm.queries import queries
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = queries()["op10_jaccard_join"](spark, "/root/testdata/sf0.001")
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(docs)
    assert got.select(F.countDistinct("component_id")).first()[0] < 200
