import hashlib
import random
import re

import numpy as np
import pytest
from llm_cases import LONG, documents, empty, prose

from ledgerscope.llm.decontamination import RUN, WINDOW, decontaminate, winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = "item_id long, text string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(WINDOW, len(w))
        if item is None or text is None or not n:
            continue
        for i in range(len(w) - n + 1):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    lengths, out = {len(k) for k in windows}, []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def check(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate(
        d, spark.createDataFrame(items, ITEM), **how).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)


def planted(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randint(1, 45))) for i in range(25)]
    items += [(25, items[3][1]), (3, items[4][1]), (26, ""), (27, None), (None, items[5][1]), (28, "a a a a a a a a a a a a")]
    docs = []
    for i in range(120):
        w = prose(rng, rng.randint(0, 150)).split()
        for _ in range(rng.randint(0, 3)):
            source = (rng.choice(items)[1] or "x").split()
            at, lo = rng.randint(0, len(w)), rng.randint(0, max(0, len(source) - 1))
            w[at:at] = source[lo:lo + rng.randint(1, 30)]
        docs.append((i, "".join(x.upper() + rng.choice([" ", ", ", "\n", ".."]) for x in w)))
    return docs + [(500, "A, a a a! a a a a a a a a a a a a"), (501, None), (502, ""), (503, "--"), (504, LONG)], items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    check(spark, *planted(seed))


def test_blocks_of_items_give_the_same(spark):
    check(spark, *planted(3), block_bytes=1500)


def test_winnowing_keeps_a_position_of_every_run():
    values = np.random.default_rng(1).integers(0, 4, 200).astype(np.uint64)
    kept = set(winnow(values).tolist())
    assert all(kept & set(range(i, i + RUN)) for i in range(200 - RUN + 1))


def test_awkward_documents_and_clashing_columns(spark):
    docs = documents(spark, extra=True)
    items = spark.createDataFrame([(1, "same text twice here now again"), (2, "😀")], ITEM)
    out = decontaminate(docs, items)
    assert out.count() == docs.count() and out.columns[:5] == docs.columns[:5]
    hit = {(r["text"] or "")[:9] for r in out.where("contaminated").collect()}
    assert hit == {"same text", "😀 😀  😀"}
    assert decontaminate(empty(spark), items).count() == 0
    none = decontaminate(docs, spark.createDataFrame([], ITEM))
    assert none.where("contaminated").count() == 0 and none.count() == docs.count()


def test_query_digest(spark):
    from ledgerscope.llm.queries import queries
    got = {r["doc_id"]: tuple(r)[1:] for r in queries()["op4_decontamination"](
        spark, "/root/testdata/sf0.001").collect()}
    rows = lambda t, a: [(r[a], r["text"]) for r in spark.read.parquet(
        f"/root/testdata/sf0.001/{t}.parquet").collect()]
    for doc, n, hit, items in brute(rows("documents", "doc_id"), rows("benchmark", "item_id")):
        digest = hashlib.sha256(",".join(items).encode()).hexdigest()
        assert got[doc] == (n, hit, len(items), digest, hit > 0)


def test_index_stays_within_eight_times_its_items():
    import pickle
    import pyarrow as pa
    from ledgerscope.llm.decontamination import INDEX_FACTOR, ItemIndex
    rng = random.Random(3)
    texts = [prose(rng, 100, size=5000) for _ in range(9000)]
    index = ItemIndex(pa.table({"id": [str(i) for i in range(9000)], "t": texts}))
    size = sum(len(t) for t in texts)
    assert size > 4e6 and index.nbytes() <= INDEX_FACTOR * size and len(pickle.dumps(index)) <= INDEX_FACTOR * size


def test_one_item_repeated_and_one_text_under_many_ids(spark):
    rng = random.Random(8)
    text = prose(rng, 30)
    items = [(7, text)] * 3000 + [(1000 + i, text) for i in range(50)] + [(9, "short item")] * 100
    docs = [(1, f"so {text} it is"), (2, prose(rng, 60)), (3, "a Short   ITEM here")]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM))
    want = brute(docs, {(i, t) for i, t in items})
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.orderBy("doc_id").collect()] == want


def test_several_blocks_give_what_one_gives(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([4, 12, 40]))) for i in range(60)]
    docs = [(i, " ".join([prose(rng, 10), items[i % 60][1], prose(rng, 10), items[(7 * i) % 60][1]])) for i in range(40)]
    df, own = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM)
    got = decontaminate(df, own, block_bytes=15_000).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got] == brute(docs, items)
