"""Fill-in-the-middle rearrangement of texts, cut at unit boundaries found by a learned rank index.

A text is cut into units (lines); boundary ``r`` is the code-point offset at which
unit ``r`` begins, boundary ``n`` the text's length.  The offsets grow almost linearly with
their rank, so each text gets a piecewise-linear index over all of them: segments
whose chord misses no boundary by more than ``BOUND`` code points, and for each boundary the
residual, two bytes, by which the chord misses it.  A cut at rank ``r`` is the chord's
prediction in ``r``'s segment plus the stored residual, which is exact.

The index is one struct column, made in numpy from the text alone
(``boundary_index``); it can be stored with the documents and serves any number of draws.
Cuts, rearrangement and its inverse (``restore``) are DataFrame functions in the
document's own row: no key, no shuffle.

Two hashes of the row's key draw the ranks; the text before the smaller cut is the prefix, after
the larger the suffix, the middle between them.  Forms: ``plain`` (the text), ``psm``
(prefix, suffix, middle) and ``spm`` (suffix, prefix, middle), each part after its mark.

Defined results: a null text is an empty one; empty texts and those that contain a mark
are plain, without lengths of parts; a null key draws as an empty one; equal keys draw equal
hashes, so repeated rows get equal results; an empty table gives an empty result; other
columns pass through, except ones named like a result column, which the result replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import give_back, joined, row_runs, table, text_batches, text_buffer

#: Most code points by which a segment's chord may miss a boundary; a residual is two bytes.
BOUND = 1023
MOST = 32767
SEED, PERCENT, SPM_PERCENT = 7, 100, 50
INDEX = "struct<ranks:array<int>,offsets:array<bigint>,residuals:array<smallint>>"
_ARROW_INDEX = pa.struct([("ranks", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())),
                          ("residuals", pa.list_(pa.int16()))])


@dataclass(frozen=True)
class Marks:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def boundaries(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(first, offsets)``: the boundary offsets of all rows in code points, row ``r``'s at
    ``first[r]:first[r + 1]``; the rows' bytes are ``raw[at[r]:at[r + 1]]``."""
    rows = len(at) - 1
    breaks = np.flatnonzero(raw == 10) + 1
    starts = np.union1d(at[:-1][np.diff(at) > 0], breaks[~np.isin(breaks, at)])
    units = np.searchsorted(starts, at, side="left")
    # A code point is a byte that continues none.
    length = np.add.reduceat((raw & 0xC0) != 0x80, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(length)])
    row = np.repeat(np.arange(rows), np.diff(units))
    first = units + np.arange(rows + 1)
    offsets = np.zeros(first[-1], np.int64)
    offsets[np.arange(len(starts)) + row + 1] = total[1:] - total[units[:-1]][row]
    return first, offsets


def fit_segments(first: np.ndarray, offsets: np.ndarray, bound: int = BOUND) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, residuals)`` of the segments of all rows at once.

    A row is one chord from its first boundary to its last; a chord that misses a boundary by more than
    ``bound`` is halved by rank, until none does.  A chord of two boundaries misses none.
    """
    residuals = np.zeros(len(offsets), np.int64)
    lo, hi = first[:-1], first[1:] - 1
    lo, hi = lo[hi > lo], hi[hi > lo]
    fitted = []
    while len(lo):
        sizes = hi - lo
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        step = np.arange(sizes.sum()) - np.repeat(begin, sizes)
        point = np.repeat(lo, sizes) + step
        chord = np.repeat(offsets[lo], sizes) + np.repeat(offsets[hi] - offsets[lo], sizes) * step // np.repeat(sizes, sizes)
        missed = offsets[point] - chord
        good = np.maximum.reduceat(np.abs(missed), begin) <= bound
        keep = np.repeat(good, sizes)
        residuals[point[keep]] = missed[keep]
        fitted.append(lo[good])
        lo, hi = lo[~good], hi[~good]
        middle = (lo + hi) // 2
        lo, hi = np.concatenate([lo, middle]), np.concatenate([middle, hi])
    return np.sort(np.concatenate(fitted)) if fitted else np.zeros(0, np.int64), residuals


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def index_of(column: pa.Array, bound: int = BOUND) -> pa.Array:
    """The index of each text of an Arrow column.

    ``ranks`` and ``offsets`` are the segments' ends (knots), ``residuals`` has an entry a boundary.
    """
    raw, at = text_buffer(column)
    parts = []
    for lo, hi in row_runs(at):
        first, offsets = boundaries(raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
        starts, residuals = fit_segments(first, offsets, bound)
        last = first[1:] - 1
        knots = np.sort(np.concatenate([starts, last]))
        row = np.searchsorted(last, knots, side="left")
        ends = np.concatenate([[0], np.searchsorted(knots, last, side="right")])
        parts.append(pa.StructArray.from_arrays(
            [_lists(knots - first[row], ends, pa.int32()), _lists(offsets[knots], ends, pa.int64()),
             _lists(residuals, first, pa.int16())], fields=list(_ARROW_INDEX)))
    return pa.concat_arrays(parts) if parts else pa.array([], _ARROW_INDEX)


def boundary_index(docs: DataFrame, text: str = "text", index: str = "line_index", bound: int = BOUND) -> DataFrame:
    """``docs`` with the column ``index``: the learned rank index of the text's lines."""
    if not 1 <= bound <= MOST:
        raise ValueError(f"a residual is two bytes: bound must lie within 1 and {MOST}")
    text_batches(docs.sparkSession)

    @F.arrow_udf(INDEX)
    def made(texts: pa.Array) -> pa.Array:
        out = index_of(texts, bound)
        give_back()
        return out

    return docs.withColumn(index, made(F.col(text)))


def n_units(index: Column) -> Column:
    return F.element_at(index["ranks"], -1).cast("long")


def cut_at(index: Column, rank: Column) -> Column:
    """Offset of boundary ``rank`` (0 to n): its segment's prediction, corrected by its residual."""
    ranks, offsets, residuals = index["ranks"], index["offsets"], index["residuals"]

    def corrected(i: Column) -> Column:
        lo, base = F.get(ranks, i - 1).cast("long"), F.get(offsets, i - 1)
        run, rise = F.get(ranks, i) - lo, F.get(offsets, i) - base
        return base + F.call_function("div", rise * (rank - lo), run) + F.get(residuals, rank.cast("int"))

    # The segment's number is bound to a name, so that it is looked up once.
    after = F.array(F.size(F.filter(ranks, lambda r: r <= rank)))
    return F.get(F.transform(after, lambda i: F.when(i < F.size(ranks), corrected(i)).otherwise(
        F.element_at(offsets, -1))), F.lit(0))


def _drawn(key: Column, seed: int, i: int) -> Column:
    """The ``i``-th unsigned 32-bit group of the key's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", index: str | None = None,
                   seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT,
                   marks: Marks = Marks()) -> DataFrame:
    """``docs`` with ``n, form, prefix_chars, middle_chars, output``.

    ``percent`` of the texts are rearranged, ``spm_percent`` of those suffix first.
    ``index``: the column of a ``boundary_index`` made before; without it one is made here.
    """
    result = ["n", "form", "prefix_chars", "middle_chars", "output"]
    own = index or "_line_index"
    rows = docs.drop(*[c for c in result if c not in (key, text, index)])
    if index is None:
        rows = boundary_index(rows, text, own)
    whole, cuts = F.coalesce(F.col(text), F.lit("")), F.col("_n") + 1
    marked = F.lit(False)
    for mark in (marks.prefix, marks.suffix, marks.middle):
        marked = marked | F.contains(whole, F.lit(mark))
    plain = (F.col("_n") == 0) | marked | (_drawn(F.col(key), seed, 2) % 100 >= percent)
    spm = _drawn(F.col(key), seed, 3) % 100 < spm_percent
    ranks = [_drawn(F.col(key), seed, i) % cuts for i in (0, 1)]
    rows = rows.withColumn("_n", n_units(F.col(own)))
    rows = rows.withColumns({"_lo": F.least(*ranks), "_hi": F.greatest(*ranks),
                             "_form": F.when(plain, "plain").when(spm, "spm").otherwise("psm")})
    rows = rows.withColumns({"_a": cut_at(F.col(own), F.col("_lo")).cast("int"),
                             "_b": cut_at(F.col(own), F.col("_hi")).cast("int")})
    prefix = F.substring(whole, F.lit(1), F.col("_a"))
    middle = F.substring(whole, F.col("_a") + 1, F.col("_b") - F.col("_a"))
    suffix = F.substring(whole, F.col("_b") + 1, F.length(whole))
    p, s, m = F.lit(marks.prefix), F.lit(marks.suffix), F.lit(marks.middle)
    output = (F.when(F.col("_form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
              .when(F.col("_form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(whole))
    arranged = F.col("_form") != "plain"
    rows = rows.withColumns({
        "n": F.col("_n"), "form": F.col("_form"), "prefix_chars": F.when(arranged, F.col("_a").cast("long")),
        "middle_chars": F.when(arranged, (F.col("_b") - F.col("_a")).cast("long")), "output": output})
    gone = ["_n", "_lo", "_hi", "_form", "_a", "_b"]
    return rows.drop(*gone, *([] if index else [own]))


def restore(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text, from ``output`` and ``form`` alone: no part holds a mark, so each mark's first place is its own."""
    def between(a: str, b: str) -> Column:
        begin = F.instr(output, a) + len(a)
        return F.substring(output, begin, F.instr(output, b) - begin)

    after = F.instr(output, marks.middle) + len(marks.middle)
    middle = F.substring(output, after, F.length(output))
    return (F.when(form == "psm", F.concat(between(marks.prefix, marks.suffix), middle,
                                           between(marks.suffix, marks.middle)))
            .when(form == "spm", F.concat(between(marks.prefix, marks.middle), middle,
                                          between(marks.suffix, marks.prefix)))
            .otherwise(output))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = joined(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
