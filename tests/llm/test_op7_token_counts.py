import public_tokenizers
import sentencepiece
from llm_cases import TEXTS, documents, empty

from ledgerscope.llm.common import run_folder
from ledgerscope.llm.token_counts import PieceCounter, count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def library():
    tool = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return lambda text: len(tool.encode(text or ""))


def test_segments_equal_whole_texts():
    counter, whole = PieceCounter(MODEL), library()
    assert counter.splits
    odd = ["  a  b ", "▁x ▁▁", "<s> </s> <unk> <0x0A>", "\n\n  \t x", "a　b", " " * 40 + "x" + " " * 17, "x" * 3000]
    for text in (odd + [t for t in TEXTS if t]) * 2:
        assert counter.count(text) == whole(text)


def test_counts_and_the_cache(spark):
    docs, path, whole = documents(spark, extra=True), run_folder(spark, "t"), library()
    got = count_tokens(docs, MODEL, path, limit=5)
    rows = got.collect()
    assert len(rows) == docs.count() and "text" not in got.columns
    by_id = {r["doc_id"]: r for r in rows}
    for r in docs.collect():
        g = by_id[r["doc_id"]]
        assert g["n_bytes"] == len((r["text"] or "").encode()) and g["n_tokens"] == whole(r["text"])
        assert g["over_limit"] == (g["n_tokens"] > 5)
    stored = spark.read.parquet(path)
    assert stored.count() == len({t or "" for t in TEXTS}) == stored.select("digest").distinct().count()
    # Known texts are not encoded again; one new text is.
    more = docs.unionByName(spark.createDataFrame([(99, "a text not met before")], "doc_id long, text string"),
                            allowMissingColumns=True)
    again = count_tokens(more, MODEL, path, limit=5)
    assert {r["doc_id"]: r["n_tokens"] for r in again.collect()} == {
        r["doc_id"]: whole(r["text"]) for r in more.collect()}
    assert spark.read.parquet(path).count() == stored.count() + 1


def test_another_tokenizer_version_is_not_reused(spark):
    path = run_folder(spark, "t")
    docs = spark.createDataFrame([(1, "hello there")], "doc_id long, text string")
    spark.sql("SELECT unhex(sha2('hello there', 256)) digest, X'00' version, 77L n_tokens").write.parquet(path)
    assert count_tokens(docs, MODEL, path).first()["n_tokens"] == library()("hello there")


def test_empty_table(spark):
    assert count_tokens(empty(spark), MODEL, run_folder(spark, "t")).count() == 0


def test_query(spark):
    from ledgerscope.llm.queries import queries
    whole = library()
    want = {r["doc_id"]: (len(r["text"].encode()), whole(r["text"])) for r in spark.read.parquet(
        "/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries()["op7_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)


def test_the_query_meets_a_cache_that_outlives_a_run(spark, tmp_path):
    from ledgerscope.llm import token_counts
    from ledgerscope.llm.queries import queries
    run, folder = queries()["op7_token_counts"], "/root/testdata/sf0.001"
    spark.conf.set(token_counts.CACHE_CONF, str(tmp_path / "cache"))
    try:
        first = sorted(map(tuple, run(spark, folder).collect()))
        held = token_counts.read_cache(spark, str(tmp_path / "cache")).count()
        assert sorted(map(tuple, run(spark, folder).collect())) == first
        assert token_counts.read_cache(spark, str(tmp_path / "cache")).count() == held  # nothing was encoded again
        more = run(spark, "/root/testdata/sf0.01").count()
        assert token_counts.read_cache(spark, str(tmp_path / "cache")).count() > held and more == 1000
        assert token_counts.read_cache(spark, str(tmp_path / "cache")).groupBy("digest").count().where("count > 1").isEmpty()
    finally:
        spark.conf.unset(token_counts.CACHE_CONF)
