"""Corpus pipeline: documents to sampled SentencePiece ids.

``STAGES`` are ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which ``run`` writes as Parquet in the shared folder and reads
again as the next one's ``docs``; ``docs`` are read from files (``joined``).  All stages but the last return the columns of
``docs``.

1. language_id: documents whose language can't be told go.
2. jaccard_join: of each group of near copies the document with the smallest id stays.
3. decontamination: documents that hold a benchmark window go.
4. secret_scan: secrets are masked in the text, and ``n_chars`` follows it.
5. sentencepiece: texts become sampled pieces that decode to them.

Defined results: null, empty and letterless texts go in stage 1; documents that
are no near copy, hold no benchmark window and no secret pass unchanged; rows of
one id and one text are one document, of which stage 2 keeps one row, and rows of one id with different texts
are different documents; rows with a null id always stay there; an empty table passes through every stage; columns named like
an operator's result keep their own values.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import durable, joined, passing, settings_kept, table, text_batches
from ledgerscope.llm.decontamination import decontaminate
from ledgerscope.llm.jaccard_join import jaccard_members, text_digest
from ledgerscope.llm.language_id import fit_table, fold_of, identify
from ledgerscope.llm.secret_scan import scan_secrets
from ledgerscope.llm.sp_sampling import sample_pieces

#: No SQL: compression, forests and sampling can't be expressed; tests hold stages against brute force.
ORACLE_SQL = None

#: Documents (an id and a text's 16 bytes) that are broadcast; more are joined.
BROADCAST_KEYS = 500_000

_BASE = ("doc_id", "text", "lang", "source")


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with every column that no stage reads renamed, out of the operators' way."""
    return docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c not in _BASE})


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`" if c in _BASE else f"`_own_{c}`").alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = joined(docs)
    model = fit_table(docs.where(fold_of("doc_id", 5) != 0))
    return _columns(identify(_apart(docs), model).where("NOT rejected"), docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is its id and its text; of a component's documents with an id, the first by these stays."""
    text_batches(spark)
    docs, size = joined(docs), docs.count()
    members = durable(jaccard_members(docs.select("doc_id", "text")).where("doc_id IS NOT NULL").select(
        "doc_id", F.coalesce("text_digest", F.lit(b"")).alias("_text"), "root"), "members", size)
    linked = members.where("root IS NOT NULL").distinct()
    first = linked.groupBy("root").agg(F.min(F.struct("doc_id", "_text")).alias("stays"))
    gone = linked.join(first, "root").where("struct(doc_id, _text) <> stays").select("doc_id", "_text")
    again = members.groupBy("doc_id", "_text").count().where("count > 1").select("doc_id", "_text")
    keyed = docs.withColumn("_text", F.coalesce(text_digest(F.col("text")), F.lit(b"")))
    left = keyed.join(_few(gone, size), ["doc_id", "_text"], "left_anti")
    again = durable(again, "repeats", size)
    if again.isEmpty():
        return left.select(docs.columns)
    once = left.join(_few(again, size), ["doc_id", "_text"], "left_semi").dropDuplicates(["doc_id", "_text"])
    return left.join(_few(again, size), ["doc_id", "_text"], "left_anti").select(docs.columns).union(once.select(docs.columns))


def _few(keys: DataFrame, rows: int) -> DataFrame:
    """``keys``, about ``rows`` at most, written; broadcast while they are at most ``BROADCAST_KEYS``."""
    keys = durable(keys, "keys", rows)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark)
    out = decontaminate(_apart(joined(docs)), table(spark, sf_dir, "benchmark"))
    return _columns(out.where("NOT contaminated"), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = scan_secrets(_apart(joined(docs))).withColumn("text", F.col("redacted"))
    if "n_chars" in docs.columns:
        out = out.withColumn("_own_n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(
            F.col("_own_n_chars")))
    return _columns(out, docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sample_pieces(joined(docs).select("doc_id", "lang", "text"), model, verify=True).select(
        "doc_id", "lang", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "lossless")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages write on the way is deleted once the next one's rows are written."""
    docs = table(spark, sf_dir, "documents")
    with settings_kept(spark), passing(spark) as stages:
        for name, stage in STAGES:
            with passing(spark) as within:
                docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
                stages.append(within.pop())
        stages.pop()
    return docs
