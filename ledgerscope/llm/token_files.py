"""Token-ID files with fixed-width bit packing.

One file holds consecutive documents::

    blocks      each of BLOCK_IDS ids, every id in the least number of bits
                that the vocabulary needs; the last block may hold fewer
    documents   int64 id, int64 valid (0: the id was null), int64 end (ids up
                to and with this document) of each document
    offsets     int64 byte position of each block and of the blocks' end
    tail        TAIL: bits, ids, documents, blocks, block size, byte position of
                the document table, magic

Ids are packed 64 at a time: 64 ids of ``b`` bits are ``b`` little-endian 64-bit
words, so packing and unpacking are ``64`` numpy operations on whole columns and
any range of ids is read from its own blocks alone.

Documents are dealt to files by ranges of (id, text hash) and written in that
order by one task a file, streaming; a file's name is new for every attempt, and
only files in the written manifest count, so a repeated task leaves no trace.

Defined results: a null text is empty and yields the end id alone; null ids
come first; repeated rows follow each other; an empty table gives no files and
an empty result; other columns are not stored.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import durable, file_system, qualified, run_folder

BLOCK_IDS = 1 << 15
TAIL = struct.Struct("<qqqqqq8s")
MAGIC = b"TOKBITS1"
END_ID = 2
#: Documents of a file that one reading task row covers.
READ_DOCS = 2048
#: Ids that a reading task gives back at a time.
READ_IDS = 1 << 20
#: Words whose ids one Python worker remembers (some 220 MB).
WORDS_KEPT = 1_000_000


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    rows = -(-len(ids) // 64)
    full = np.zeros((rows, 64), np.uint64)
    full.reshape(-1)[:len(ids)] = ids
    out = np.zeros((rows, bits), "<u8")
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        out[:, word] |= full[:, i] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= full[:, i] >> np.uint64(64 - shift)
    return out.tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, i] = value & mask
    return out.reshape(-1)[:count]


class TokenFileWriter:
    """Streams documents into one file; memory is a block and the document table."""

    def __init__(self, stream, vocabulary: int, block_ids: int = BLOCK_IDS):
        self.stream, self.bits, self.block_ids = stream, width(vocabulary), block_ids
        self.waiting, self.held = [], 0
        self.ids = self.at = 0
        self.offsets, self.docs = [0], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        self.docs.append((doc_id or 0, int(doc_id is not None), self.ids))
        if self.held >= self.block_ids:
            held = np.concatenate(self.waiting)
            whole = len(held) // self.block_ids * self.block_ids
            for i in range(0, whole, self.block_ids):
                self._put(held[i:i + self.block_ids])
            self.waiting, self.held = [held[whole:]], len(held) - whole

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.stream.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.waiting))
        self.stream.write(np.array(self.docs, "<i8").reshape(-1, 3).tobytes())
        self.stream.write(np.array(self.offsets, "<i8").tobytes())
        self.stream.write(TAIL.pack(self.bits, self.ids, len(self.docs), len(self.offsets) - 1,
                                    self.block_ids, self.at, MAGIC))
        self.stream.close()


class TokenFileReader:
    """Random access by document number or id position; reads only what is asked for."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        file.seek(end - TAIL.size)
        self.bits, self.ids, self.n_docs, self.n_blocks, self.block_ids, self.table, magic = TAIL.unpack(
            file.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")

    def _array(self, at: int, count: int) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * count), "<i8")

    def documents(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, validity and id positions (one more than documents) of documents ``lo`` to ``hi``."""
        rows = self._array(self.table + 24 * max(0, lo - 1), 3 * (hi - max(0, lo - 1))).reshape(-1, 3)
        first = 0 if lo == 0 else int(rows[0, 2])
        rows = rows if lo == 0 else rows[1:]
        return rows[:, 0], rows[:, 1] == 1, np.concatenate(([first], rows[:, 2]))

    def read(self, lo: int, hi: int) -> np.ndarray:
        """The ids at positions ``lo`` to ``hi``."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block_ids, (hi - 1) // self.block_ids
        offsets = self._array(self.table + 24 * self.n_docs + 8 * first, last - first + 2)
        self.file.seek(int(offsets[0]))
        data = self.file.read(int(offsets[-1] - offsets[0]))
        base = first * self.block_ids
        return unpack(data, min(self.ids, (last + 1) * self.block_ids) - base, self.bits)[lo - base:hi - base]


#: The split pattern of the vocabulary file, for texts of these characters only: there it and the
#: file's normaliser (composed form, single spaces, lower case) are the rules below.
_FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_UNUSUAL = re.compile("[^\t-\r -~\xa0-įı-ſ]|<\\|")
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


class WordEncoder:
    """Ids that the tokenizers library gives for whole texts, as little-endian 32-bit bytes.

    Where the file's rules are the ones above, a text's ids are those of its
    words; words not met before go to the library together, and the first
    ``WORDS_KEPT`` are remembered.  Any other file or text goes to the library whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        suffix = rules["model"].get("end_of_word_suffix")
        self.closes = np.zeros(self.vocabulary, bool)
        self.closes[[i for t, i in rules["model"]["vocab"].items() if suffix and t.endswith(suffix)]] = True
        steps = [s["type"] for s in (rules.get("normalizer") or {}).get("normalizers", [])]
        split = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        added = all(t["content"].startswith("<|") for t in rules.get("added_tokens", []))
        self.by_words = (bool(suffix) and steps == ["NFC", "Replace", "Lowercase"] and added and split.get("invert") is True
                         and split.get("behavior") == "Removed"
                         and split.get("pattern") == {"Regex": _FILE_PATTERN})
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
        if len(ends) != len(words):
            return {w: self._whole(w) for w in words}
        data = ids.tobytes()
        return {w: data[4 * a:4 * b] for w, a, b in zip(words, [0, *ends], ends)}

    def encode(self, text: str) -> bytes:
        if not self.by_words or _UNUSUAL.search(text):
            return self._whole(text)
        words, known = _WORDS.findall(text.lower()), self.known
        new = [w for w in set(words) if w not in known]
        if not new:
            return b"".join(map(known.__getitem__, words))
        found = self._encode(new)
        if len(known) < WORDS_KEPT:
            known.update(found)
            return b"".join(map(known.__getitem__, words))
        return b"".join([known[w] if w in known else found[w] for w in words])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker and file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


#: Text bytes that one file, and the task that writes it, should take.
FILE_BYTES = 256 << 20
MANIFEST = "path string, number long, n_docs long, n_ids long"


def _files_for(rows: DataFrame) -> int:
    """Ranges of about ``FILE_BYTES`` of text, and as many at least as the session's shuffles have partitions."""
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text",
                      end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write ``docs`` in ascending id order; the manifest of files, in order of ``number``."""
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = (rows.withColumn("h", F.xxhash64("text"))
               .repartitionByRange(_files_for(rows), "doc", "h")
               .sortWithinPartitions("doc", "h").select("doc", "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, writer, path = encoder(tokenizer), None, ""
        number = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if batch.num_rows and writer is None:
                files, top = file_system(folder)
                files.create_dir(top, recursive=True)
                name = f"{number:06d}-{uuid.uuid4().hex[:12]}.ids"
                path = f"{folder}/{name}"
                writer = TokenFileWriter(files.open_output_stream(f"{top}/{name}"),
                                         max(tool.vocabulary, end_id + 1), block_ids)
            for doc, body in zip(batch.column("doc").to_pylist(), batch.column("text")):
                writer.add(doc, np.frombuffer(tool.encode(body.as_py()) + end, "<u4"))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "number": [number], "n_docs": [len(writer.docs)],
                                              "n_ids": [writer.ids]})

    return durable(ordered.mapInArrow(write, MANIFEST), "token-files")


def read_token_files(manifest: DataFrame, read_docs: int = READ_DOCS) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the manifest's files.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian
    unsigned 32-bit integers.  A file is read in ranges of documents, each a
    task row.  The running total is over files, a row each.
    """
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    ranges = based.select("path", "base", "n_docs", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(read_docs).cast("long"))).alias("lo"))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranges.select("path", "base", "lo", F.least(F.col("lo") + read_docs, "n_docs").alias("hi")).repartition(
        parts, "path", "lo")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = file_system(row["path"])
                with files.open_input_file(path) as f:
                    file = TokenFileReader(f)
                    doc, valid, ends = file.documents(row["lo"], row["hi"])
                    lo = 0
                    while lo < len(doc):
                        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + READ_IDS, side="right")) - 1)
                        hi = min(hi, len(doc))
                        data = file.read(int(ends[lo]), int(ends[hi])).astype("<u4").tobytes()
                        cut = ((ends[lo:hi + 1] - ends[lo]) * 4).astype(np.int32)
                        ids = pa.Array.from_buffers(pa.binary(), hi - lo,
                                                    [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(data)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc[lo:hi], mask=~valid[lo:hi]), pa.array(row["base"] + ends[lo:hi]),
                             pa.array(np.diff(ends[lo:hi + 1])), ids],
                            names=["doc_id", "start", "n_tokens", "ids"])
                        lo = hi

    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), run_folder(spark, "token-ids"))
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
