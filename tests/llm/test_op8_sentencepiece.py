import collections

import numpy as np
import public_tokenizers
import pytest
from llm_cases import TEXTS, documents, empty, prose

from ledgerscope.llm import sp_sampling
from ledgerscope.llm.common import mix64
from ledgerscope.llm.sp_sampling import Lattices, decode_pieces, sample_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["  ", "a  b ", "▁x ▁▁", "<s> </s>", "\n\n  \t x", "a　b", " " * 40 + "x" + " " * 17, "x" * 3000, "\U0010ffff a",
       "q" * 40 + "é" * 40] + [t for t in TEXTS if t]


@pytest.fixture(scope="module")
def tool():
    return Lattices(MODEL)


def split(tool, texts, keys):
    ids, counts = tool.sample(texts, np.array(keys, np.uint64))
    ends = np.concatenate(([0], np.cumsum(counts)))
    return [tuple(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])]


def test_decoding_gives_the_text(tool):
    texts = ODD + [""]
    for text, ids in zip(texts, split(tool, texts, range(len(texts)))):
        assert b"".join(tool.spelled[i] for i in ids)[1:].decode() == text


def paths(tool, text):
    if not text:
        return [((), 1.0)]
    return [((tool.pieces[text[:k]][0], *ids), tool.pieces[text[:k]][1] * w) for k in range(1, len(text) + 1)
            if text[:k] in tool.pieces for ids, w in paths(tool, text[k:])]


@pytest.mark.parametrize("text", ["the cat", "aan"])
def test_draws_have_the_probability_of_their_weight(tool, text):
    n = 30_000
    seen = collections.Counter(split(tool, [text] * n, mix64(np.arange(n, dtype=np.uint64))))
    ways = [((), 1.0)]
    for word in text.split():
        ways = [(a + b, x * y) for a, x in ways for b, y in paths(tool, "▁" + word)]
    total = sum(w for _, w in ways)
    assert set(seen) <= {p for p, _ in ways}
    for p, w in ways:
        assert abs(seen[p] / n - w / total) < 5 * np.sqrt(w / total / n) + 1e-4


def test_a_row_depends_on_key_and_text_alone(tool, monkeypatch):
    import random
    rng = random.Random(1)
    texts = [prose(rng, 30) for _ in range(60)] + ODD
    keys = list(range(len(texts)))
    first = split(tool, texts, keys)
    monkeypatch.setattr(sp_sampling, "SEGMENTS_KEPT", 20)
    other = Lattices(MODEL)
    back = list(reversed(range(len(texts))))
    again = [x for i in range(0, len(back), 7) for x in split(
        other, [texts[j] for j in back[i:i + 7]], [keys[j] for j in back[i:i + 7]])]
    assert again == first[::-1]
    assert split(tool, texts, [k + 1000 for k in keys]) != first


def test_columns_equal_one_by_one(tool, monkeypatch):
    words = sorted(tool.known)[:400]
    fast, slow = Lattices(MODEL), Lattices(MODEL)
    a = fast.add(words)
    monkeypatch.setattr(sp_sampling, "_COLUMNS", 0)
    b = slow.add(words)

    def edges(x, i):
        lo, hi = x.open[x.final[i - 1] + 1 if i else 0], x.n_edges
        if i + 1 < x.n_segments:
            hi = x.open[x.final[i] + 1]
        return x.before[lo:hi].tolist(), x.piece[lo:hi].tolist(), x.upto[lo:hi].tolist()

    assert all(edges(fast, a[w]) == edges(slow, b[w]) for w in words)


def slots(tool, text):
    h = tool._hash(text)
    slot = int(h >> tool.shift)
    while tool.hashes[slot] not in (h, 0):
        slot += 1
    return tool.hashes[slot] == h, int(tool.hashed_id[slot])


def test_columns_look_up_only_what_begins_a_piece(tool):
    some = sorted(tool.pieces)[::97]
    for p in some:
        assert slots(tool, p) == (True, tool.pieces[p][0])
        for k in range(1, len(p)):  # a beginning is found, so that its longer ones are tried
            assert slots(tool, p[:k]) == (True, tool.pieces.get(p[:k], (-1,))[0])
    assert not slots(tool, "\ufffe\uffff")[0]


def test_odd_segments_equal_one_by_one(monkeypatch):
    odd = ["▁", "▁▁▁", "▁\x00", "▁a\x7f", "▁" + sp_sampling._LITERAL, "▁é", "▁\U0010ffff", "▁日本語", "▁" + "x" * 31, "▁" + "x" * 32,
           "▁the", "▁" + "ab" * 40, "▁a\n\tb", "▁qzxj"]
    fast, slow = Lattices(MODEL), Lattices(MODEL)
    a = fast.add(odd)
    monkeypatch.setattr(sp_sampling, "_COLUMNS", 0)
    b = slow.add(odd)
    assert a.keys() == b.keys() == set(odd)

    def edges(x, i):
        at = int(x.final[i - 1]) + 1 if i else 0
        into = np.append(x.open[at:int(x.final[i]) + 1], x.open[int(x.final[i]) + 1] if i + 1 < x.n_segments else x.n_edges)
        lo, hi = int(into[0]), int(into[-1])
        return (into - lo).tolist(), x.before[lo:hi].tolist(), x.piece[lo:hi].tolist(), x.upto[lo:hi].tolist()

    assert all(edges(fast, a[w]) == edges(slow, b[w]) for w in odd)


def test_frames(spark):
    docs = documents(spark, extra=True)
    rows = decode_pieces(sample_pieces(docs, MODEL, verify=True), MODEL).collect()
    assert len(rows) == docs.count() and all(r["decoded"] == (r["text"] or "") and r["lossless"] for r in rows)
    assert rows[0]["score"] == "own"
    again = {(r["doc_id"], r["text"]): r["pieces"] for r in sample_pieces(docs.repartition(3), MODEL).collect()}
    assert all(again[r["doc_id"], r["text"]] == r["pieces"] for r in rows)
    other = {(r["doc_id"], r["text"]): r["pieces"] for r in sample_pieces(docs, MODEL, seed=5).collect()}
    assert other != again
    assert sample_pieces(empty(spark), MODEL).count() == 0 == decode_pieces(sample_pieces(empty(spark), MODEL), MODEL).count()


def test_query(spark):
    from ledgerscope.llm.queries import queries
    got = queries()["op8_sentencepiece"](spark, "/root/testdata/sf0.001")
    assert got.where("lossless").count() == 200 == got.where("n_pieces = size(pieces)").count()
