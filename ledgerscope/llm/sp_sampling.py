"""SentencePiece sampling: forward filtering, backward sampling over the piece lattice.

The lattice of a text has a node between characters and an edge for every
vocabulary piece that spells the characters between two nodes; a character that
no piece spells is its UTF-8 bytes, an edge each.  A forward pass sums the
weights of all paths to a node; from the end, each step draws an incoming edge in
proportion to the paths through it, so a segmentation is drawn with the
probability of its weight.  Weights are ``exp(score)`` powers for models that
score pieces by log probability, and powers of ``1 / (1 + rank)`` for merge
ranks, which this vocabulary stores.

No piece holds the space mark after another character (checked), so the lattice
of a text falls into those of its marked segments; segments met before keep their
forward pass.  The draws are 32-bit integers hashed from seed, row key, segment
number and node, and thresholds are 32-bit integers too: a row's segmentation
depends on nothing but its key, its text and the seed.

``decode`` is lossless: marks become spaces, byte pieces bytes, and the first
mark, which encoding added, goes.  A space mark in the text itself is encoded as
its bytes.

Defined results: null or empty text has no pieces and decodes to an empty text;
a null key counts as the text's hash; repeated rows get the same pieces; other
columns pass through, except ones named like a result column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import give_back, mix64, row_runs, text_buffer, tool

#: Segments whose forward pass one Python worker keeps (some 400 bytes each), and the longest of them.
SEGMENTS_KEPT, LONGEST_KEPT = 80_000, 48
#: Text bytes that are sampled, and rows that are decoded at a time.
RUN_BYTES, DECODED_ROWS = 1 << 18, 512
ALPHA = 1.0

_MARK, _LITERAL = "▁", "\ud800"  # a lone surrogate stands for a mark that the text holds itself
_SEGMENT = re.compile(f"{_MARK}+[^{_MARK}]*")
_TINY = 1e-100
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Longest segments that are filtered as columns, and how many at a time.
_COLUMNS, _TOGETHER = 32, 1024
_MOST = (1 << 32) - 1


class Lattices:
    """Forward passes of segments as flat arrays: nodes, their incoming edges and thresholds."""

    def __init__(self, model_file: str, alpha: float = ALPHA, by_rank: bool = True):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if sp.normalize(" a  \n ﬁ①") != f"{_MARK}{_MARK}a{_MARK}{_MARK}\n{_MARK}ﬁ①":
            raise ValueError("the model's normaliser changes texts; decoding could not be lossless")
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes = [0] * 256
        self.spelled: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.spelled.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.spelled.append(b"")
            else:
                if _MARK in piece.lstrip(_MARK):
                    raise ValueError(f"piece {piece!r} holds a space mark after another character")
                score = sp.get_score(i)
                self.pieces[piece] = (i, (1.0 - score) ** -alpha if by_rank else float(np.exp(alpha * score)))
                self.spelled.append(piece.replace(_MARK, " ").encode())
        self.longest = max(map(len, self.pieces))
        # The same vocabulary for whole columns of segments: hashes of pieces and of their beginnings, with the ids
        # of pieces (-1: a beginning only) and weights by id.  An ASCII character that no piece spells is one byte
        # piece and so stands among them.
        lone = {chr(b): (self.bytes[b], 1.0) for b in range(128) if chr(b) not in self.pieces}
        spelled = self.pieces | lone
        begun = {p[:k] for p in spelled for k in range(1, len(p))}
        spread = max(16, (3 * len(begun | spelled.keys())).bit_length())
        self.shift, size = np.uint64(64 - spread), 1 << spread
        self.hashes, self.hashed_id = np.zeros(size + 64, np.uint64), np.full(size + 64, -1, np.int32)
        self.weight = np.zeros(sp.get_piece_size())
        for p in begun | spelled.keys():
            h = self._hash(p)
            slot = int(h >> self.shift)
            while self.hashes[slot]:
                slot += 1
            self.hashes[slot] = h
            if p in spelled:
                self.hashed_id[slot], self.weight[spelled[p][0]] = spelled[p]
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in spelled if len(p) == 1]] = True
        self.known: dict[str, int] = {}
        self.final = np.zeros(1 << 16, np.int64)      # last node of each segment
        self.upto = np.zeros(1 << 18, np.uint32)      # largest draw that takes each edge or one before it
        self.before = np.zeros(1 << 18, np.int32)     # nodes from the segment's first to the edge's start
        self.piece = np.zeros(1 << 18, np.int32)
        self.open = np.zeros(1 << 16, np.int64)       # first edge into each node
        self.n_segments = self.n_nodes = self.n_edges = 0

    def _units(self, segment: str) -> tuple[list, bool]:
        units, plain = [], True
        for c in segment:
            if c in self.pieces:
                units.append(c)
            else:
                plain = False
                units.extend((_MARK if c == _LITERAL else c).encode())
        return units, plain

    def _forward(self, segment: str, upto: list, before: list, piece: list, into: list) -> int:
        """Append a segment's edges and how many lead into each node; the number of its nodes."""
        units, plain = self._units(segment)
        pieces, longest = self.pieces, self.longest
        reached = [1.0]
        into.append(0)
        for end in range(1, len(units) + 1):
            if not plain and isinstance(units[end - 1], int):
                reached.append(reached[end - 1])
                upto.append(_MOST)
                before.append(end - 1)
                piece.append(self.bytes[units[end - 1]])
                into.append(1)
                continue
            ways, total = [], 0.0
            for start in range(max(0, end - longest), end):
                found = pieces.get(segment[start:end] if plain else self._joined(units, start, end))
                if found:
                    total += reached[start] * found[1]
                    ways.append((start, found[0], total))
            if total < _TINY:  # only ratios within a piece's length matter
                scale = 1.0 / _TINY
                for i in range(max(0, end - longest), end):
                    reached[i] *= scale
                ways, total = [(s, p, t * scale) for s, p, t in ways], total * scale
            reached.append(total)
            for start, which, sum_ in ways:
                upto.append(max(0, int(sum_ / total * 4294967296.0) - 1))
                before.append(start)
                piece.append(which)
            upto[-1] = _MOST
            into.append(len(ways))
        return len(units) + 1

    @staticmethod
    def _joined(units: list, start: int, end: int) -> str | None:
        part = units[start:end]
        return None if any(isinstance(u, int) for u in part) else "".join(part)

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = h * _BASE + np.uint64(ord(c) + 1)
        return (h * _SPREAD)[0]

    def _forward_many(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``_forward`` for segments of one length, a row of character codes each, all of them pieces or bytes."""
        n, length = codes.shape
        width = min(length, self.longest)
        padded = np.zeros((n, length + 1), np.uint64)  # a code of 0 ends what begins in a segment
        padded[:, :length] = codes
        padded[:, :length] += np.uint64(1)
        padded = padded.ravel()
        ids = np.full(n * (length + 1) * width, -1, np.int32)  # [segment, end, start - first possible start]
        weights = np.zeros(ids.shape)
        at = np.flatnonzero(padded)  # starts of what may still become a piece
        h = np.zeros(len(at), np.uint64)
        for size in range(1, width + 1):
            h = h * _BASE + padded[at + (size - 1)]
            mixed = h * _SPREAD
            slot = (mixed >> self.shift).astype(np.int64)
            there = self.hashes[slot]
            other = np.flatnonzero((there != mixed) & (there != 0))
            while len(other):
                slot[other] += 1
                now = self.hashes[slot[other]]
                there[other] = now
                other = other[(now != mixed[other]) & (now != 0)]
            begun = np.flatnonzero(there == mixed)  # an empty place says that no piece begins like this
            at, h = at[begun], h[begun]
            if not len(at):
                break
            which = self.hashed_id[slot[begun]]
            whole = np.flatnonzero(which >= 0)
            place = (at[whole] + size) * width + (width - size)
            ids[place] = which[whole]
            weights[place] = self.weight[which[whole]]
        weights = weights.reshape(n, length + 1, width)
        reached = np.zeros((n, length + 1))
        reached[:, 0] = 1.0
        for end in range(1, length + 1):
            first = max(0, end - width)
            own = weights[:, end, width - end + first:]
            own *= reached[:, first:end]
            np.cumsum(own, axis=1, out=own)
            reached[:, end] = own[:, -1]
        edge = np.flatnonzero(ids >= 0)
        node = edge // width
        upto = weights.ravel()[edge] / reached.ravel()[node]
        draws = np.maximum((upto * 4294967296.0).astype(np.int64) - 1, 0)
        draws[np.append(node[1:] != node[:-1], True)] = _MOST
        starts = node % (length + 1) - width + (edge - node * width)
        return draws, starts.astype(np.int32), ids[edge], np.bincount(node, minlength=n * (length + 1))

    def _room(self, name: str, n: int) -> None:
        array = getattr(self, name)
        if n > len(array):
            more = max(n, len(array) + len(array) // 4) - len(array)
            setattr(self, name, np.concatenate([array, np.zeros(more, array.dtype)]))

    def _columns(self, segments: list[str]) -> Iterator[tuple[list[str], np.ndarray | None]]:
        """The segments by length, with their character codes; None for those to be filtered one by one."""
        segments = sorted(segments, key=len)
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        few = int(np.searchsorted(lengths, _COLUMNS, side="right"))
        codes = np.frombuffer("".join(segments[:few]).encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.concatenate(([0], np.cumsum(lengths)))
        alone = segments[few:]
        for length in np.unique(lengths[:few]).tolist():
            lo, hi = np.searchsorted(lengths[:few], [length, length + 1]).tolist()
            rows = codes[at[lo]:at[hi]].reshape(hi - lo, length)
            plain = self.single[rows].all(axis=1)
            group = segments[lo:hi]
            if not plain.all():
                alone += [group[i] for i in np.flatnonzero(~plain)]
                group, rows = [group[i] for i in np.flatnonzero(plain)], rows[plain]
            for i in range(0, len(group), _TOGETHER):
                yield group[i:i + _TOGETHER], rows[i:i + _TOGETHER]
        for i in range(0, len(alone), _TOGETHER):
            yield alone[i:i + _TOGETHER], None

    def add(self, segments: list[str]) -> dict[str, int]:
        """Numbers of new segments, whose forward passes go to the end of the arrays."""
        order: list[str] = []
        n = self.n_segments
        for some, codes in self._columns(segments):
            node = self.n_nodes
            if codes is not None:
                length = codes.shape[1]
                upto, before, piece, into = self._forward_many(codes)
                final = node + length + np.arange(len(some)) * (length + 1)
            else:
                upto, before, piece, into, final, at = [], [], [], [], [], node
                for s in some:
                    at += self._forward(s, upto, before, piece, into)
                    final.append(at - 1)
            m = self.n_edges
            first = m + np.cumsum(into) - into
            for name, values, to in (("final", final, n + len(order)), ("upto", upto, m), ("open", first, node),
                                     ("before", before, m), ("piece", piece, m)):
                self._room(name, to + len(values))
                getattr(self, name)[to:to + len(values)] = values
            order += some
            self.n_segments, self.n_edges, self.n_nodes = n + len(order), m + len(upto), int(final[-1]) + 1
        return dict(zip(order, range(n, n + len(order))))

    def sample(self, texts: list[str], row_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, and their number for each text."""
        parts, counts = [], []
        for t in texts:
            own = _SEGMENT.findall(_MARK + t.replace(_MARK, _LITERAL).replace(" ", _MARK)) if t else ()
            parts.extend(own)
            counts.append(len(own))
        new = [p for p in set(parts) if p not in self.known]
        if len(self.known) < SEGMENTS_KEPT:
            new.sort(key=lambda p: len(p) > LONGEST_KEPT)
        keep = [p for p in new[:max(0, SEGMENTS_KEPT - len(self.known))] if len(p) <= LONGEST_KEPT]
        known = self.known
        known.update(self.add(keep))
        mark = self.n_segments, self.n_edges, self.n_nodes
        passing = self.add(new[len(keep):])
        known.update(passing)
        numbers = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        for p in passing:
            del known[p]
        drawn = self._backward(numbers, np.array(counts, np.int64), row_keys)
        self.n_segments, self.n_edges, self.n_nodes = mark  # the others were for this run only
        return drawn

    def _backward(self, segments, counts, row_keys) -> tuple[np.ndarray, np.ndarray]:
        n = len(segments)
        row = np.repeat(np.arange(len(counts)), counts)
        number = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        seeds = mix64(row_keys[row] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        final, upto = self.final[:self.n_segments], self.upto[:self.n_edges]
        node = final[segments]
        first = np.concatenate(([-1], final[:-1]))[segments] + 1
        alive, steps, lengths = np.arange(n), [], np.zeros(n, np.int64)
        while len(alive):
            at = node[alive]
            own = (at - first[alive]).astype(np.uint64)
            draw = mix64(seeds[alive] ^ (own * np.uint64(0xD1342543DE82EF95))) >> np.uint64(32)
            draw, edge = draw.astype(np.uint32), self.open[at]
            over = np.flatnonzero(upto[edge] < draw)
            while len(over):
                edge[over] += 1
                over = over[upto[edge[over]] < draw[over]]
            steps.append((alive, lengths[alive], self.piece[edge]))
            lengths[alive] += 1
            back = self.before[edge]
            node[alive] = first[alive] + back
            alive = alive[back > 0]
        ends = np.cumsum(lengths)
        out = np.empty(int(ends[-1]) if n else 0, np.int32)
        for which, step, piece in steps:
            out[ends[which] - 1 - step] = piece
        return out, np.bincount(row, weights=lengths, minlength=len(counts)).astype(np.int64)


def lattices(model_file: str, alpha: float, by_rank: bool) -> Lattices:
    """One set of lattices a Python worker and model, kept between tasks."""
    return tool(("lattices", model_file, alpha, by_rank), lambda: Lattices(model_file, alpha, by_rank))


def _schema(df: DataFrame, without: list[str], added: str) -> tuple[list[str], str]:
    kept = [f for f in df.schema.fields if f.name not in without]
    return [f.name for f in kept], ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [added])


def spell(ids: np.ndarray, ends: np.ndarray, spelled: np.ndarray) -> Iterator[bytes]:
    """The text of each run of piece ids, without the mark that encoding put first."""
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield b"".join(spelled[ids[a:b]])[1:]


def sample_pieces(docs: DataFrame, model_file: str, seed: int = 0, key: str = "doc_id", text: str = "text",
                  alpha: float = ALPHA, by_rank: bool = True, verify: bool = False) -> DataFrame:
    """``docs`` with ``pieces array<int>``, a sampled segmentation; a map job, no shuffle.

    ``verify`` decodes every row again and adds ``lossless``: whether that gave its text.
    """
    keyed = docs.withColumn("_key", F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.col(text))))
    added = ["pieces", "lossless"] if verify else ["pieces"]
    columns, schema = _schema(docs, added, "pieces array<int>" + ", lossless boolean" * verify)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = lattices(model_file, alpha, by_rank)
        spelled = np.array(sampler.spelled, object)
        for batch in batches:
            _, offsets = text_buffer(batch.column(text))
            keys = np.asarray(batch.column("_key")).astype(np.int64).view(np.uint64)
            for lo, hi in row_runs(offsets, RUN_BYTES):
                texts = [t or "" for t in batch.column(text).slice(lo, hi - lo).to_pylist()]
                ids, counts = sampler.sample(texts, keys[lo:hi])
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
                if verify:
                    made.append(pa.array([t.encode() == d for t, d in zip(texts, spell(ids, ends, spelled))]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, hi - lo) for c in columns] + made, names=columns + added)
        give_back()

    return keyed.mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, model_file: str, pieces: str = "pieces") -> DataFrame:
    """``rows`` with ``decoded``, the text of their pieces (null pieces: empty)."""
    columns, schema = _schema(rows, ["decoded"], "decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = np.array(lattices(model_file, ALPHA, True).spelled, object)
        for batch in batches:
            for lo in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(lo, DECODED_ROWS)
                lists = part.column(pieces)
                lists = lists.fill_null([]) if lists.null_count else lists
                flat, ends = np.asarray(lists.values), np.asarray(lists.offsets)
                texts = [t.decode() for t in spell(flat, ends, spelled)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + [pa.array(texts, pa.string())],
                                                 names=columns + ["decoded"])

    return rows.mapInArrow(run, schema)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sample_pieces(docs, model, verify=True).select(
        "doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "lossless")
