import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import TEXTS, documents, empty
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerscope.llm.common import run_folder
from ledgerscope.llm.token_files import (TokenFileReader, TokenFileWriter, WordEncoder, pack, read_token_files, unpack,
                                         width, write_token_files)

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_packing_round_trip(bits, ids):
    ids = np.array(ids, np.uint64) & np.uint64((1 << bits) - 1)
    data = pack(ids, bits)
    assert len(data) == -(-len(ids) // 64) * 8 * bits
    assert (unpack(data, len(ids), bits) == ids).all()


def test_least_width():
    assert [width(n) for n in (1, 2, 3, 256, 257, 49408, 65537)] == [1, 1, 2, 8, 9, 16, 17]


def test_random_access_in_a_file(tmp_path):
    import pyarrow as pa
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 1000, n).astype("<u4") for n in (0, 5, 700, 1, 64, 129, 0, 3)]
    with pa.OSFile(str(tmp_path / "f"), "wb") as out:
        writer = TokenFileWriter(out, 1000, block_ids=64)
        for i, d in enumerate(docs):
            writer.add(None if i == 3 else i * 10, d)
        writer.close()
    flat = np.concatenate(docs)
    with pa.OSFile(str(tmp_path / "f"), "rb") as f:
        file = TokenFileReader(f)
        assert file.bits == 10 and file.ids == len(flat)
        for lo, hi in ((0, 0), (0, len(flat)), (63, 65), (64, 128), (700, 703), (len(flat) - 1, len(flat))):
            assert (file.read(lo, hi) == flat[lo:hi]).all()
        ids, valid, ends = file.documents(2, 5)
        assert ids.tolist() == [20, 0, 40] and valid.tolist() == [True, False, True]
        assert ends.tolist() == [5, 705, 706, 770]


def expected(rows):
    tool, start, out = Tokenizer.from_file(PATH), 0, []
    for i, text in rows:
        ids = np.array(tool.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_words_equal_whole_texts():
    tool = WordEncoder(PATH)
    assert tool.by_words
    odd = ["it's we'll 'S", "<|endoftext|> a", "a²b 12", "ẞ ΣΑΣ", "naïve—x", "a b\x1cc", "!'s..'t 'tis", "İx", "x'dd''ll",
           "a_b_1", "ŉa ſ ¼", "co\xadop"] + [t for t in TEXTS if t]
    for text in odd * 2:
        assert tool.encode(text) == tool._whole(text), text[:40]


def test_files_give_back_what_was_encoded(spark):
    docs = documents(spark, extra=True).where("doc_id IS NOT NULL")
    folder = run_folder(spark, "t")
    got = read_token_files(write_token_files(docs, PATH, folder, block_ids=256), read_docs=3).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).orderBy("start").collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=lambda r: r[0])
    assert [tuple(r) for r in got] == expected(rows)


def test_null_id_comes_first_and_empty_table(spark):
    docs = documents(spark)
    got = read_token_files(write_token_files(docs, PATH, run_folder(spark, "t"))).orderBy("start").collect()
    assert got[0]["doc_id"] is None and len(got) == docs.count()
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert read_token_files(write_token_files(empty(spark), PATH, run_folder(spark, "t"))).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    from ledgerscope.llm.queries import queries
    got = queries()["op3_token_files"](spark, f"/root/testdata/{sf}").orderBy("doc_id").collect()
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected([(d["doc_id"], d["text"]) for d in docs])
