"""Token counts through a digest cache.

``count_tokens`` joins the digest of each text (normalised: null is empty; the tokenizer
tells any other difference, so none may share a count) and the tokenizer
version's digest to a stored table of counts, encodes only distinct texts that
the table lacks, and appends those counts to it.

Defined results: a null text counts as empty (0 tokens); repeated rows and
copies share one count; an empty table gives an empty result; other columns
pass through untouched unless their name is one of the four result columns,
which then replace them; a null id stays null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import durable, run_folder
from ledgerscope.operators.membership import bits_for, bloom, kept

LIMIT = 4096
#: Words whose counts one Python worker remembers (some 150 MB).
WORDS_KEPT = 1_000_000
#: Session setting that names a cache folder for all runs of the query; without it a run has its own.
CACHE_CONF = "ledgerscope.tokenCounts.cache"
CACHE_SCHEMA = "digest binary, version binary, n_tokens long"

_MARK = "▁"
_SEGMENT = re.compile(f"{_MARK}+[^{_MARK}]*")


def tokenizer_version(model_file: str) -> bytes:
    with open(model_file, "rb") as f:
        return hashlib.sha256(f.read() + sentencepiece.__version__.encode()).digest()


class PieceCounter:
    """Counts of pieces as the sentencepiece library gives them for whole texts.

    No piece of the vocabulary holds the space mark after another character
    (checked on loading), so no merge crosses the start of a run of marks and
    the pieces of a text are those of its marked segments.  Segments not met
    before go to the library together, as one text; the first ``WORDS_KEPT``
    are remembered.  A vocabulary with such pieces has its texts encoded whole.
    """

    def __init__(self, model_file: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.opens = np.array([p.startswith(_MARK) for p in pieces])
        self.splits = (_MARK in pieces and not any(_MARK in p.lstrip(_MARK) for p in pieces)
                       and self.sp.normalize(" a  \n ﬁ①") == f"{_MARK}{_MARK}a{_MARK}{_MARK}\n{_MARK}ﬁ①")
        self.known: dict[str, int] = {}

    def _encode(self, segments: list[str]) -> dict[str, int]:
        plain = [s for s in segments if s[1:2] != _MARK and len(s) > 1]
        out = {s: len(self.sp.encode(s[1:])) for s in segments if s[1:2] == _MARK}
        if _MARK in segments:  # the library would put another mark before a lone one
            out[_MARK] = 1
        if plain:
            ids = np.array(self.sp.encode("".join(plain)[1:]))
            first = np.flatnonzero(self.opens[ids])
            out.update(zip(plain, np.diff(first, append=len(ids)).tolist(), strict=True))
        return out

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.sp.encode(text))
        parts = _SEGMENT.findall(_MARK + text.replace(" ", _MARK))
        known = self.known
        new = [p for p in set(parts) if p not in known]
        if not new:
            return sum(map(known.__getitem__, parts))
        counts = self._encode(new)
        if len(known) < WORDS_KEPT:
            known.update(counts)
            return sum(map(known.__getitem__, parts))
        return sum([known[p] if p in known else counts[p] for p in parts])


_counters: dict[str, PieceCounter] = {}


def counter(model_file: str) -> PieceCounter:
    """One counter a Python worker and file, kept between tasks."""
    if model_file not in _counters:
        _counters[model_file] = PieceCounter(model_file)
    return _counters[model_file]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an absent table is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, model_file: str, cache_path: str, limit: int = LIMIT,
                 text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes, n_tokens, over_limit`` instead of the text.

    Digests meet the cache first.  Texts whose digest is stored are dropped where they are read, by a
    membership filter over the missing digests; a miss travels once per map
    task that holds it, reduced to one row per digest.  The last join moves
    digests and ids only, and AQE splits a digest that many rows share.
    """
    spark = docs.sparkSession
    version = F.lit(bytearray(tokenizer_version(model_file)))
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn("_digest", F.unhex(F.sha2(whole, 256)))
    stored = read_cache(spark, cache_path).where(F.col("version") == version).select(F.col("digest").alias("_digest")).distinct()
    texts = keyed.select("_digest", whole.alias("_text"))
    if not stored.isEmpty():
        missing = durable(keyed.select("_digest").distinct().join(stored, "_digest", "left_anti"), "missing")
        bits = bits_for(missing.count())
        texts = kept(texts, bloom(missing, "_digest", bits), F.col("_digest"), bits)
        misses = texts.groupBy("_digest").agg(F.first("_text").alias("_text")).join(missing, "_digest", "left_semi")
    else:
        misses = texts.groupBy("_digest").agg(F.first("_text").alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts_of = counter(model_file)
        for batch in batches:
            counts = [counts_of.count(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    (misses.mapInArrow(encode, "digest binary, n_tokens long")
     .select("digest", version.alias("version"), "n_tokens").write.mode("append").parquet(cache_path))

    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version).groupBy(
        F.col("digest").alias("_digest")).agg(F.max("n_tokens").alias("_n"))
    out = keyed.withColumn("_bytes", F.octet_length(whole).cast("long")).drop(text)
    keep = [c for c in out.columns if c not in ("_digest", "_bytes", "n_bytes", "n_tokens", "over_limit")]
    return out.join(counts, "_digest", "left").select(
        *[F.col(f"`{c}`") for c in keep], F.col("_bytes").alias("n_bytes"), F.col("_n").alias("n_tokens"),
        (F.col("_n") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cache = spark.conf.get(CACHE_CONF, None) or run_folder(spark, "token-counts")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), cache)
