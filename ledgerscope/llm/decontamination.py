"""Benchmark decontamination by winnowing.

Item texts are cut into words; a window is ``WINDOW`` consecutive words of an
item (an item with fewer words is one window).  Of an item's and a document's
word ``GRAM``-grams the smallest hash of each run of ``RUN`` is kept as a
fingerprint.  ``GRAM + RUN - 1 == WINDOW``, so a window that occurs in a
document shares a fingerprint with it.  Documents' fingerprints are joined with
the items'; around each shared one the hit is extended to the windows that
cover it, which are compared by hash and then word by word.  Windows shorter
than ``WINDOW`` have no fingerprint guarantee; documents' grams of exactly
their lengths are joined instead.

The item side is broadcast as an index of arrays, in blocks of at most about ``BLOCK_BYTES``
(reckoned before anything is gathered); documents pass the blocks one after
the other, so no row of theirs is shuffled, whatever the passage frequency.

Defined results: null, empty or wordless texts have no words and no hits; null
item ids or texts take no part; repeated item ids count once in ``items``;
repeated documents are answered row by row; an empty benchmark hits nothing;
other document columns pass through, except ones named like a result column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import durable, give_back, mix64, put_away, row_runs, text_buffer
from ledgerscope.llm.words import ALNUM, grams, scan

WINDOW = 10
GRAM = 5
RUN = WINDOW - GRAM + 1
#: Most bytes of a block's index, and those that a byte of item text takes in it (measured: about 6).
BLOCK_BYTES = 128 << 20
INDEX_FACTOR = 8
#: Rows that a task gives back at a time.
ROWS = 1024
RESULT = ("n_words long, n_hit long, items array<string>, spans array<struct<first:long,end:long>>, "
          "contaminated boolean")
_FILTER_BITS = 20


def winnow(hashes: np.ndarray, run: int = RUN) -> np.ndarray:
    """Positions of the last smallest value of every ``run`` consecutive values."""
    n = len(hashes) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = hashes[:n].copy(), np.zeros(n, np.int8)
    for i in range(1, run):
        now = hashes[i:i + n]
        less = now <= best
        np.copyto(best, now, where=less)
        at[less] = i
    chosen = np.zeros(len(hashes), bool)
    chosen[np.arange(n) + at] = True
    return np.flatnonzero(chosen)


class Known:
    """A set of 64-bit hashes with a bit filter in front of the search."""

    def __init__(self, hashes):
        self.sorted = np.unique(np.asarray(hashes, np.uint64))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.sorted >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Positions in ``hashes`` of members."""
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(maybe):
            return maybe
        values = hashes[maybe]
        slot = np.minimum(np.searchsorted(self.sorted, values), len(self.sorted) - 1)
        return maybe[self.sorted[slot] == values]


def word_slices(low: np.ndarray, start: int, end: int) -> bytes:
    """The words between two byte positions, joined by one space."""
    return b" ".join(w for w in low[start:end].tobytes().split(b"\0") if w)


def gram_rows(rows: np.ndarray) -> np.ndarray:
    """``grams`` of each row as a whole."""
    out = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += rows[:, i]
    return mix64(out ^ np.uint64(rows.shape[1]))


class Windows:
    """The windows of one length, as arrays: the different ones in order of hash, each with the place of its words
    in the items' bytes and the numbers of the texts that hold it."""

    def __init__(self, hashes: np.ndarray, again: np.ndarray, start: np.ndarray, end: np.ndarray, texts: np.ndarray):
        order = np.lexsort((texts, again, hashes))
        hashes, again, texts = hashes[order], again[order], texts[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (again[1:] != again[:-1])
        first = np.flatnonzero(new)
        self.known = Known(hashes[first])
        self.hashes, self.start, self.end = hashes[first], start[order][first], end[order][first]
        self.texts, self.first = texts, np.append(first, len(order)).astype(np.uint32)

    def holders(self, value: int, words: bytes, low: np.ndarray) -> np.ndarray | None:
        """The texts that hold the window of hash ``value`` and these words."""
        at = int(np.searchsorted(self.hashes, np.uint64(value)))
        while at < len(self.hashes) and self.hashes[at] == value:
            if word_slices(low, self.start[at], self.end[at]) == words:
                return self.texts[self.first[at]:self.first[at + 1]]
            at += 1
        return None


class ItemIndex:
    """Windows of one block of items (a table ``id, t``): fingerprints, window hashes, where their words are and whose.

    Texts are held once each, as bytes; a window is two places in them.  Item ids are listed by text.
    """

    def __init__(self, items: pa.Table):
        texts = items.column("t").combine_chunks().dictionary_encode()
        codes = texts.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        self.ids = items.column("id").combine_chunks().take(pa.array(order))
        self.ids_first = np.searchsorted(codes[order], np.arange(len(texts.dictionary) + 1))
        raw, offsets = text_buffer(texts.dictionary)
        starts, ends, hashes, row_first = scan(raw, offsets, ALNUM)
        starts, ends = starts.astype(np.uint32), ends.astype(np.uint32)
        self.low = ALNUM[raw]
        n = np.diff(row_first)
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.prints, self.by_length = None, {}
        for length in np.unique(np.minimum(n[n > 0], WINDOW)).tolist():
            if length == WINDOW:
                at = np.arange(len(hashes) - WINDOW + 1)
                at = at[row[at] == row[at + WINDOW - 1]]
                short = grams(hashes, GRAM)
                # Runs across two texts add fingerprints and take none away.
                self.prints = Known(short[winnow(short)])
                del short
            else:
                at = row_first[:-1][n == length]
            whole = grams(hashes, length)[at]
            again = grams(mix64(hashes ^ np.uint64(0x9FB21C651E98DF25)), length)[at]
            self.by_length[length] = Windows(whole, again, starts[at], ends[at + length - 1], row[at])

    def items(self, texts: set[int]) -> list[str]:
        """The different ids of some texts, sorted."""
        found = {i for t in texts for i in self.ids[self.ids_first[t]:self.ids_first[t + 1]].to_pylist()}
        return sorted(found)

    def nbytes(self) -> int:
        """Bytes that the index takes in memory."""
        total = self.low.nbytes + self.ids.nbytes + self.ids_first.nbytes
        total += self.prints.sorted.nbytes + self.prints.filter.nbytes if self.prints else 0
        for w in self.by_length.values():
            total += sum(x.nbytes for x in (w.hashes, w.start, w.end, w.texts, w.first, w.known.sorted, w.known.filter))
        return total

    def hits(self, low, starts, ends, hashes, row_first) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """``(row, first word, end word, texts)`` of every occurrence of a window; words count
        over the whole buffer."""
        for length, windows in self.by_length.items():
            known = windows.known
            if length == WINDOW:
                short = grams(hashes, GRAM)
                at = winnow(short)
                at = at[self.prints.find(short[at])]
                if not len(at):
                    continue
                at = np.unique(at[:, None] - np.arange(RUN))
                at = at[(at >= 0) & (at + WINDOW <= len(hashes))]
                whole = gram_rows(hashes[at[:, None] + np.arange(WINDOW)])
                found = known.find(whole)
                at, whole = at[found], whole[found]
            else:
                whole = grams(hashes, length)
                at = known.find(whole)
                whole = whole[at]
            rows = np.searchsorted(row_first, at, side="right") - 1
            inside = at + length <= row_first[rows + 1]
            for i, h, row in zip(at[inside].tolist(), whole[inside].tolist(), rows[inside].tolist()):
                texts = windows.holders(h, word_slices(low, starts[i], ends[i + length - 1]), self.low)
                if texts is not None:
                    yield row, i, i + length, texts


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def _pass(docs: DataFrame, items: pa.Table, text: str, earlier: bool) -> DataFrame:
    """One block of items over all documents; adds to what earlier blocks found."""
    index = docs.sparkSession.sparkContext.broadcast(ItemIndex(items))
    names = {x.split()[0] for x in RESULT.split(", ")}
    kept = [f for f in docs.schema.fields if f.name not in names]
    columns = [f.name for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [RESULT])
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put_away()
        block = index.value
        for batch in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            raw, offsets = text_buffer(batch.column(text))
            n = batch.num_rows
            n_words = np.zeros(n, np.int64)
            spans: dict[int, list] = {}
            texts_of: dict[int, set[int]] = {}
            for lo, hi in row_runs(offsets):
                part = raw[offsets[lo]:offsets[hi]]
                starts, ends, hashes, first = scan(part, offsets[lo:hi + 1] - offsets[lo], ALNUM)
                n_words[lo:hi] = np.diff(first)
                low = None
                if block.by_length:
                    low = ALNUM[part]
                    for row, a, b, texts in block.hits(low, starts, ends, hashes, first):
                        spans.setdefault(lo + row, []).append((a - int(first[row]), b - int(first[row])))
                        texts_of.setdefault(lo + row, set()).update(texts.tolist())
            items_of = {row: set(block.items(texts)) for row, texts in texts_of.items()}
            if earlier:
                for row, (old, ids) in enumerate(zip(batch.column("spans"), batch.column("items"))):
                    if len(old):
                        spans.setdefault(row, []).extend((s["first"], s["end"]) for s in old.as_py())
                        items_of.setdefault(row, set()).update(ids.as_py())
            merged = {row: _merged(x) for row, x in spans.items()}
            n_hit = np.zeros(n, np.int64)
            for row, x in merged.items():
                n_hit[row] = sum(b - a for a, b in x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [pa.array(n_words), pa.array(n_hit),
                   pa.array([sorted(items_of.get(i, ())) for i in range(n)], pa.list_(pa.string())),
                   pa.array([[{"first": a, "end": b} for a, b in merged.get(i, ())] for i in range(n)], spans_type),
                   pa.array(n_hit > 0)],
                names=columns + ["n_words", "n_hit", "items", "spans", "contaminated"])
        give_back()

    return docs.mapInArrow(mark, schema)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with their benchmark hits: word counts, item ids, word spans.

    A benchmark whose index would go beyond ``block_bytes`` is split by a hash of its rows; the
    marked documents are written between blocks, so that one block's index is
    in an executor's memory at a time.  Repeated rows count once.
    """
    rows = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("t")).where(
        F.col("id").isNotNull() & F.col("t").isNotNull()).distinct()
    size = rows.agg(F.sum(F.octet_length("t") * INDEX_FACTOR + F.octet_length("id") + F.lit(64))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    out = docs
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == block) if blocks > 1 else rows
        out = _pass(out, part.toArrow(), text, block > 0)
        if block + 1 < blocks:
            out = durable(out, "decontaminate")
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate(docs, items)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
