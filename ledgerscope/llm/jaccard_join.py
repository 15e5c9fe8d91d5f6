"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct word shingles.  Two sets link
when ``100 * |A and B| >= 80 * |A or B|``; then their symmetric difference has
at most ``n // 4`` members for the smaller set (of ``n``) and ``2 * n // 9`` for
the larger.

* **Parity sketches.**  A set is dealt by token hash into the parts of a
  sketch, and each part is the XOR of its tokens' 64-bit hashes.  A token in
  one set only changes one part, so the number of differing parts is at most
  the symmetric difference.
* **Pigeonhole join per size band.**  Bands double.  A band's sketch has more
  parts than any difference that its links allow, so linked sets agree in some
  part.  With ``P`` parts, a set that tolerates ``t`` differences agrees with a
  partner in ``P - t`` parts at least; it therefore may leave out its ``P - t - 1``
  lowest parts in any order that depends on a part's content only.  Parts with
  the fewest tokens, which unrelated documents share most, are the lowest.  A
  set at the low end of a band joins the band below as well.
* **Verify.**  Pairs pass the Hamming bound of a ``SKETCH_BITS`` one-bit-a-token
  sketch, then the exact test on the sets.

Pairs are first made between each bucket's members and its smallest member.
Linked sets become components.  Only members of a bucket that are in different
components then are compared with each other: in numpy blocks on the sketches,
so that what becomes rows is what the Hamming bound leaves.  Copies within
a group therefore never become pairs, and no link between different sets is lost.

Buckets, pairs and the exact test know a document by a hash of its text; ids, null or
repeated, are attached at the end.

Defined results: null, empty or wordless text: empty set, linked with nothing,
its own component; fewer than five words: the whole sequence is the one shingle;
equal sets (repeated rows included) are one class; a null id takes its class's
smallest id, null if there is none; equal ids with different texts are different
documents; other columns pass through, except ones named like a result column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import durable, give_back, holding, mix64, put_away, row_runs, signed, text_buffer
from ledgerscope.llm.components import components
from ledgerscope.llm.words import SPACED, grams, scan
from ledgerscope.operators.membership import bits_for, bloom, kept

SHINGLE = 5
PERCENT = 80
SKETCH_BITS = 1024
#: Parts beyond the least number, as an eighth of it plus this.
SPARE = 4
#: Members of a bucket that are compared in memory at a time.
BLOCK = 4096
#: Smallest keys that a member of a compared bucket carries: a pair is told only where it shares no smaller one.
LOW_KEYS = 8
#: Document ids that are broadcast to pick the texts to verify (8 bytes each); more are joined.
BROADCAST_IDS = 2_000_000
#: Sets that one task remembers having emitted (a repeat emits no parts again).
REMEMBERED = 500_000
#: Keys that a document shares with others, about, and narrow rows that one row of shingles is as large as (for ``durable``).
SHARED_KEYS, WIDE = 8, 64

_ONE = np.uint64(1)

Hold = Callable[[DataFrame], DataFrame]


def token_sets(column) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of an Arrow string column."""
    raw, offsets = text_buffer(column)
    for lo, hi in row_runs(offsets):
        _, _, words, first = scan(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], SPACED)
        shingles = grams(words, SHINGLE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE:
                yield np.unique(shingles[a:b - SHINGLE + 1])
            else:
                yield grams(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def set_digest(tokens: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    mixed = mix64(tokens ^ np.uint64(0xA0761D6478BD642F))
    return (np.bitwise_xor.reduce(mixed).tobytes()
            + (mix64(mixed + np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)).tobytes())


def parity_bits(tokens: np.ndarray) -> bytes:
    """``SKETCH_BITS`` bits, each the parity of the tokens that fall on it."""
    places = (mix64(tokens + np.uint64(0x8EBC6AF09C88C6E3)) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    odd = np.bincount(places, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def part_keys(tokens: np.ndarray) -> np.ndarray:
    """Bucket keys of a set: its highest parts in its band and, at the low end, in the band below."""
    n = len(tokens)
    own = n.bit_length() - 1
    bands = [(own, n // 4)]
    if own and 80 * n <= 100 * ((1 << own) - 1):  # a partner of the band below can reach it
        bands.append((own - 1, min(2 * n // 9, ((1 << own) - 1) // 4)))
    out = []
    for band, tolerated in bands:
        most = ((2 << band) - 1) // 4
        parts = most + 1 + most // 8 + SPARE
        of = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        sums = np.bitwise_xor.reduceat(mix64(tokens), first)
        sizes = np.diff(first, append=n)
        where = of[first]
        if len(where) < tolerated + 1:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), where)
            where = np.concatenate((where, empty))
            sums = np.concatenate((sums, np.zeros(len(empty), np.uint64)))
            sizes = np.concatenate((sizes, np.zeros(len(empty), sizes.dtype)))
        keys = mix64(sums ^ mix64((where << np.uint64(6)) + np.uint64(band)))
        out.append(keys[np.lexsort((keys, -sizes))[:tolerated + 1]])
    return np.concatenate(out)


def _sketched(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id, doc, text_digest, n, set, bits, keys`` of every document, ``doc`` a hash of its text; a task's
    repeats of a set have no keys."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put_away()
        seen: set[bytes] = set()
        for batch in batches:
            n, digests, bits, sizes, keys = [], [], [], [], []
            for tokens in token_sets(batch.column("text")):
                n.append(len(tokens))
                digests.append(digest := set_digest(tokens) if len(tokens) else None)
                fresh = bool(len(tokens)) and digest not in seen
                bits.append(parity_bits(tokens) if len(tokens) else None)
                own = part_keys(tokens) if fresh else np.zeros(0, np.uint64)
                if fresh and len(seen) < REMEMBERED:
                    seen.add(digest)
                sizes.append(len(own))
                keys.append(own)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            flat = signed(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("doc"), batch.column("text_digest"), pa.array(n, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(bits, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["id", "doc", "text_digest", "n", "set", "bits", "keys"])
        give_back()

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("doc"),
                       text_digest(F.col(text)).alias("text_digest"), F.col(text).alias("text")).mapInArrow(
        sketch, "id long, doc long, text_digest binary, n long, set binary, bits binary, keys array<long>")


def text_digest(text: Column) -> Column:
    """128 bits of the text; null for null."""
    return F.unhex(F.md5(text))


def _near(bits_x, bits_y, n_x, n_y):
    """Whether the Hamming distance leaves a link possible."""
    apart = np.bitwise_count(bits_x ^ bits_y).sum(axis=1, dtype=np.int64)
    return (9 * apart <= n_x + n_y) & (5 * np.minimum(n_x, n_y) >= 4 * np.maximum(n_x, n_y))


def _bit_rows(column) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint64).reshape(-1, SKETCH_BITS // 64)


def _hamming(pairs: DataFrame) -> DataFrame:
    """Pairs ``x, y`` with ``n_x, n_y, bits_x, bits_y`` that the Hamming bound leaves."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                good = _near(_bit_rows(b.column("bits_x")), _bit_rows(b.column("bits_y")),
                             np.asarray(b.column("n_x")), np.asarray(b.column("n_y")))
                yield b.select(["x", "y"]).filter(pa.array(good))
    return pairs.mapInArrow(keep, "x long, y long")


def _verified(pairs: DataFrame, docs: DataFrame, text: str, size: int) -> DataFrame:
    """Links ``a, b`` between the sets of the document pairs ``x, y``, about ``size``, that pass the exact test."""
    pairs = durable(pairs.distinct(), "pairs", size)
    ids = pairs.select(F.col("x").alias("doc")).union(pairs.select("y")).distinct()
    texts = ids.count()
    few = texts <= BROADCAST_IDS
    wanted = docs.select(F.xxhash64(text).alias("doc"), text_digest(F.col(text)).alias("text_digest"),
                         F.col(text).alias("text")).join(F.broadcast(ids) if few else ids, "doc")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:  # one row of a text is enough; texts whose hashes meet both count
            fresh = []
            for digest in batch.column("text_digest").to_pylist():
                fresh.append(digest not in seen)
                if len(seen) < REMEMBERED:
                    seen.add(digest)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            sets = list(token_sets(batch.column("text")))
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc", "set", "tokens"])
        give_back()

    sets = durable(wanted.mapInArrow(tokens, "doc long, set binary, tokens array<long>").dropDuplicates(
        ["doc", "set"]), "sets", texts * WIDE, wide=True)
    side = lambda end, name: sets.select(
        F.col("doc").alias(end), F.col("set").alias(name), F.col("tokens").alias(f"{name}_tokens"))
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    whole = F.size("a_tokens") + F.size("b_tokens") - common
    return (pairs.join(side("x", "a"), "x").join(side("y", "b"), "y")
            .where((F.col("a") != F.col("b")) & (100 * common >= PERCENT * whole)).select("a", "b"))


def _meetings(rows: DataFrame, hold: Hold) -> DataFrame:
    """``rows`` once for each block of their bucket that they are compared with: ``i, j`` name the two blocks, ``own``
    the row's.

    A root with at least half of ``BLOCK`` members in a bucket has blocks of its own, which never meet each other; the
    members of other roots share blocks, which meet all.  Members are dealt into blocks by hash, so no
    task numbers a bucket.
    """
    sizes = hold(rows.groupBy("key", "root").agg(F.count("*").alias("size")))
    large = F.col("size") >= F.lit(BLOCK / 2)
    kinds = sizes.withColumn("kind", F.when(large, F.col("root"))).groupBy("key", "kind").agg(F.sum("size").alias("size"))
    blocks = kinds.select("key", "kind", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    listed = blocks.groupBy("key").agg(F.collect_list(F.struct("kind", "blocks")).alias("all"))
    own = sizes.select("key", "root", F.when(large, F.col("root")).alias("kind"))
    placed = rows.join(own, ["key", "root"]).join(listed, "key")
    mine = F.element_at(F.filter("all", lambda b: b["kind"].eqNullSafe(F.col("kind"))), 1)["blocks"]
    block = lambda kind, number: F.xxhash64(F.lit("block"), kind, kind.isNull(), number)
    others = F.flatten(F.transform(F.filter("all", lambda b: b["kind"].isNull() | ~b["kind"].eqNullSafe(F.col("kind"))),
                                   lambda b: F.transform(F.sequence(F.lit(0), b["blocks"] - 1), lambda n: block(b["kind"], n))))
    placed = placed.withColumn("own", block(F.col("kind"), F.pmod(F.xxhash64("doc"), mine).cast("int"))).withColumn(
        "other", F.explode(others))
    return placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "n",
                         "root", "bits", "lows")


def _across(rows: DataFrame, hold: Hold) -> DataFrame:
    """Pairs of members of one bucket that are in different components and near by sketch.

    ``rows``: ``key, doc, n, bits, root, lows``.  Each two blocks of a bucket that may hold such pairs
    meet in a group of their own (``_meetings``), so a group is bounded.  Near members share many keys;
    a bucket leaves a pair to one of a smaller key that ``lows`` show both to have.
    """
    spark = rows.sparkSession
    met = _meetings(rows, hold)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows_ = pa.Table.from_batches([batch])
            rest = rows_ if rest is None else pa.concat_tables([rest, rows_])
            group = np.stack([np.asarray(rest[c]).astype(np.int64) for c in ("key", "i", "j")])
            ends = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0))
            if len(ends):
                yield pairs_of(rest.slice(0, int(ends[-1]) + 1))
                rest = rest.slice(int(ends[-1]) + 1)
        if rest is not None and rest.num_rows:
            yield pairs_of(rest)
        give_back()

    def pairs_of(t: pa.Table) -> pa.RecordBatch:
        group = np.stack([np.asarray(t[c]).astype(np.int64) for c in ("key", "i", "j")])
        own, doc, n, root = (np.asarray(t[c]) for c in ("own", "doc", "n", "root"))
        bits = _bit_rows(t["bits"])
        lows = np.asarray(pc.list_flatten(t["lows"].combine_chunks())).reshape(-1, LOW_KEYS)
        found = [np.zeros((2, 0), np.int64)]
        left, step = np.arange(t.num_rows), 0
        while len(left):  # members that have another one ``step`` rows on in their group
            step += 1
            left = left[left + step < t.num_rows]
            left = left[(group[:, left] == group[:, left + step]).all(axis=0)]
            # Two blocks meet for their mixed pairs; a block by itself for its own.
            x = left[(root[left] != root[left + step])
                     & ((own[left] != own[left + step]) | (group[1, left] == group[2, left]))]
            y = x + step
            if len(x):
                good = _near(bits[x], bits[y], n[x], n[y])
                x, y = x[good], y[good]
                both = (lows[x][:, :, None] == lows[y][:, None, :]) & (lows[x][:, :, None] < group[0, x][:, None, None])
                first = ~both.any(axis=(1, 2))
                found.append(np.stack([doc[x[first]], doc[y[first]]]))
        x, y = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))],
                                          names=["x", "y"])

    return dealt.mapInArrow(compare, "x long, y long")


def _mixed(rows: DataFrame, value: str, keep: Hold) -> DataFrame:
    """The rows of keys with more than one ``value``, with the smallest as ``least``.

    An aggregate a key, kept by ``keep`` and joined back: AQE splits a key that a large part of all rows share.  Rows of
    other keys, nearly all, are dropped by a membership filter before they would be shuffled again.
    """
    ends = keep(rows.groupBy("key").agg(F.min(value).alias("least"), F.max(value).alias("most"))
                .where("least < most").select("key", "least"))
    bits = bits_for(ends.count())
    return kept(rows, bloom(ends, "key", bits), F.col("key"), bits).join(ends, "key")


def _roots(sketched: DataFrame, docs: DataFrame, text: str, hold: Hold) -> DataFrame:
    """``node, root`` of the sets that are linked with others."""
    size = sketched.count() * SHARED_KEYS
    about = sketched.where("n > 0").select("doc", "n", "set", "bits").dropDuplicates(
        ["doc", "set"])
    # Written, not held: all keys were shuffled for it.
    shared = _mixed(sketched.select("doc", F.explode("keys").alias("key")), "doc", lambda ends: durable(ends, "shared-keys", size))
    buckets = durable(shared.select("key", "doc", "least"), "buckets", size)

    def end(name: str) -> DataFrame:
        return about.select(F.col("doc").alias(name), F.col("n").alias(f"n_{name}"),
                            F.col("set").alias(f"set_{name}"), F.col("bits").alias(f"bits_{name}"))

    star = buckets.where("least < doc").select(F.col("least").alias("x"), F.col("doc").alias("y")).distinct()
    star = star.join(end("y"), "y").join(end("x"), "x").where("set_x <> set_y")
    stars = components(_verified(_hamming(star.select("x", "y", "n_x", "n_y", "bits_x", "bits_y")),
                                 docs, text, size), size)
    rooted = about.select("doc", "set").join(stars, F.col("set") == F.col("node"), "left").select(
        "doc", F.xxhash64(F.coalesce("root", "set")).alias("root"))
    mixed = _mixed(hold(buckets.select("key", "doc").join(rooted, "doc")), "root", hold)
    mixed = durable(mixed.select("key", "doc", "root"), "mixed", size)
    none = F.array_repeat(F.lit((1 << 63) - 1).cast("long"), LOW_KEYS)
    lows = mixed.groupBy("doc").agg(F.slice(F.concat(F.sort_array(F.collect_set("key")), none), 1, LOW_KEYS).alias("lows"))
    mixed = mixed.join(about.select("doc", "n", "bits").join(lows, "doc"), "doc").select(
        "key", "doc", "n", "bits", "root", "lows")
    more = _verified(_across(mixed, hold), docs, text, size)
    # A star of the first components joins the same nodes as the links that made it.
    return components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), size)


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_shingles, component_id``."""
    return jaccard_members(docs, doc_id, text).select("doc_id", "n_shingles", "component_id")


def jaccard_members(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_digest, n_shingles, component_id, root``; ``root`` names the component whatever ids its
    documents have, null for an empty set."""
    sketched = durable(_sketched(docs, doc_id, text), "sketches")
    with holding() as hold:
        roots = _roots(sketched, docs, text, hold)

    least = sketched.where("n > 0").groupBy("set").agg(F.min("id").alias("id"))
    of = least.join(roots, F.col("set") == F.col("node"), "left").select(
        "set", "id", F.coalesce("root", "set").alias("root"))
    first = of.groupBy("root").agg(F.min("id").alias("component"))
    classes = of.join(first, "root").select("set", "root", "component")
    return sketched.select("id", "text_digest", "n", "set").join(classes, "set", "left").select(
        F.col("id").alias("doc_id"), "text_digest", F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"), "root")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
