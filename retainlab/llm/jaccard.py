"""Exact Jaccard self-join of shingle sets with set-relation skipping.

1. One scan gives each document's set (3-word shingles, 64-bit hashes), a
   digest of it, and a fixed-size sketch of how often shingles occur, which
   orders shingles from rare to frequent. Equal sets are one node from here.
2. The rarest ``n - ceil(t n) + 1`` shingles of a set are its index entries
   (any pair that links shares one). Index lists are cut into blocks of sets
   of like size, and an entry holds the shingle's position in its set: blocks
   too short or too long, and entries whose positions or toggled bits leave
   too little to share, are skipped before any set is read. Pairs of large sets
   must also pass on toggled bits of a number that grows with the sets.
3. Answers of a set are derived from those of a highly similar one: in each
   block all sets are compared with one pivot only. Sets that link to a pivot
   are in one component, and need no comparing with each other; what is left
   to compare are pairs of one list in different components. Every such pair
   is verified on the texts, so components are those of all links.

Hot shingles stand last in the order and seldom are index entries; groups of
near copies cost a comparison with the pivot for each member, not all pairs.
Null text or text without words: an empty set, linked with nothing. Repeated
rows have equal sets. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, chunks, load, near_pairs, remove_stage, small_batches, span_hashes, toggled, write_stage
from .groups import components
from .postings import PACKED, pack, part_bits, shared_lists, short

SKETCH_BITS, SKETCH_ROWS = 20, 64
SETS = "doc_id long, hash long, n_shingles long, key binary, toggles array<long>, wide binary, piece int, counts binary"
_SETS = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("toggles", pa.list_(pa.int64())), ("wide", pa.binary()), ("piece", pa.int32()), ("counts", pa.binary())])


def shingle_set(text: str | None, size: int = 3) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``size`` words; of fewer
    words, the one sequence; no words, none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(size, len(words))
    data = np.frombuffer(b" ".join(words), np.uint8)
    return np.unique(span_hashes(data, starts[: len(words) - k + 1], ends[k - 1 :]))


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def toggles(found: np.ndarray) -> list[int]:
    """256 bits, of which each shingle toggles one: two sets differ in at
    least as many shingles as these bits do."""
    odd = np.bincount((found & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def wide_toggles(found: np.ndarray) -> bytes | None:
    """As many bits as shingles, or up to twice as many; none for a set for
    which ``toggles`` has enough."""
    if len(found) <= 256:
        return None
    return toggled(found, np.zeros(len(found), np.int64), np.array([1 << (len(found) - 1).bit_length()]))[0]


def describe(docs: DataFrame, shingle: int) -> DataFrame:
    """A row per document (size and digest of its set), and rows of partial
    shingle counts by the leading bits of the hash (``piece`` not null)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)

        def rows():
            for doc_id, code, text in arrow_rows(batches, "doc_id", "hash", "text"):
                s = shingle_set(text, shingle)
                np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                yield doc_id, code, len(s), digest(s) if len(s) else None, toggles(s), wide_toggles(s), None, None
            if counts.any():
                for i, part in enumerate(np.split(counts, SKETCH_ROWS)):
                    yield None, None, None, None, None, None, i, part.tobytes()

        yield from chunks(rows(), _SETS, 2000)

    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(run, SETS)


def levels(described: DataFrame) -> np.ndarray:
    """log2 of the summed counts: one byte for each of 2**20 hash classes."""
    schema = pa.schema([("piece", pa.int32()), ("total", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for piece, counts in arrow_rows(batches, "piece", "counts"):
            part = np.frombuffer(counts, np.uint32).astype(np.int64)
            sums[piece] = sums[piece] + part if piece in sums else part
        yield from chunks(((k, v.tobytes()) for k, v in sums.items()), schema)

    parts = described.filter("piece is not null").select("piece", "counts")
    out = np.zeros((SKETCH_ROWS, (1 << SKETCH_BITS) // SKETCH_ROWS), np.int64)
    summed = parts.repartition(SKETCH_ROWS, "piece").mapInArrow(run, "piece int, total binary")
    summed = write_stage(parts.sparkSession, summed, "levels")
    for row in summed.collect():
        out[row["piece"]] += np.frombuffer(row["total"], np.int64)
    remove_stage(parts.sparkSession, summed)
    return np.log2(out.ravel() + 1).astype(np.uint8)


def least_of(n: int, percent: int) -> int:
    """ceil(n * percent / 100)"""
    return -(-n * percent // 100)


def entries(docs: DataFrame, rarity: np.ndarray, shingle: int, percent: int, bits: int) -> DataFrame:
    """Packed index entries of each set, once a task for equal sets; a spot is
    the shingle's position, and in the low 32 bits the size of the set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()

        def made():
            for (text,) in arrow_rows(batches, "text"):
                s = shingle_set(text, shingle)
                key = digest(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                keep = len(s) - least_of(len(s), percent) + 1
                order = np.lexsort((s, rarity[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[:keep]
                of = np.full(keep, int.from_bytes(key[:8], "big", signed=True))
                yield short(s[order]), of, np.arange(keep, dtype=np.int64) << 32 | len(s), of

        yield from pack(made(), bits)

    return docs.select("text").mapInArrow(run, PACKED)


def set_number(key: str) -> Column:
    """The first 64 bits of a digest."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def may_link(x: str, y: str, percent: int, first: bool = False) -> Column:
    """Bounds of two entries of one list, none of which a linked pair fails:
    the sizes, the positions (at most ``min(at) + 1 + min(rest)`` shingles can
    be shared) and the toggled bits (so many shingles differ at least).
    ``first``: a linked pair passes in the list of its first common shingle, an
    entry of both, before which nothing is shared, if not in its other lists."""
    size, at = (F.col(f"{x}size"), F.col(f"{y}size")), (F.col(f"{x}at"), F.col(f"{y}at"))
    share = F.least(size[0] - at[0], size[1] - at[1]) + (0 if first else F.least(*at))
    differ = sum(F.bit_count(F.col(f"{x}toggles")[i].bitwiseXOR(F.col(f"{y}toggles")[i])) for i in range(4))
    return (
        (F.least(*size) * 100 >= F.greatest(*size) * percent)
        & (share * (100 + percent) >= (size[0] + size[1]) * percent)
        & (differ * (100 + percent) <= (size[0] + size[1]) * (100 - percent))
    )


def verified(spark: SparkSession, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``: set numbers) whose sets link, by their digests."""
    one, two = (nodes.select(F.col("set").alias(x), F.col("n_shingles").alias(f"{x}_n"), F.col("wide").alias(f"{x}_wide")) for x in "ab")
    met = near_pairs(pairs.join(one, "a").join(two, "b"), lambda m, n: (m + n) * (100 - percent) // (100 + percent))
    pairs = write_stage(spark, met, "near")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.hash") == F.col("n.hash"))
    found = keyed.join(nodes.join(wanted, "set").alias("n"), same).select("n.set", "n.key", "d.text")
    texts = write_stage(spark, found.dropDuplicates(["set"]), "texts")  # repeated documents
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def set_of(key: bytes, text: str) -> np.ndarray | None:
            if key not in known:
                s = shingle_set(text, shingle)
                if digest(s) != key:  # another text under a repeated id
                    return None
                known[key] = s
                if len(known) > 64:
                    known.popitem(last=False)
            else:
                known.move_to_end(key)
            return known[key]

        def rows():
            for ka, kb, ta, tb in arrow_rows(batches, "ka", "kb", "ta", "tb"):
                x, y = set_of(ka, ta), set_of(kb, tb)
                if x is None or y is None:
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    yield ka, kb

        yield from chunks(rows(), schema)

    left = texts.select(F.col("set").alias("a"), F.col("key").alias("ka"), F.col("text").alias("ta"))
    right = texts.select(F.col("set").alias("b"), F.col("key").alias("kb"), F.col("text").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b").select("ka", "kb", "ta", "tb")
    linked = write_stage(spark, joined.mapInArrow(run, "a binary, b binary"), "verified")
    remove_stage(spark, texts)
    remove_stage(spark, pairs)
    return linked


def pivot_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each set of a block with the block's pivot, its least set number."""
    block = lists.withColumn("block", F.floor(F.log(100 / percent, F.col("size"))))
    pivots = (
        block.groupBy("token", "block")
        .agg(F.min(F.struct("set", "size", "at", "toggles")).alias("p"), F.max("set").alias("most"))
        .filter("p.set < most")
        .select("token", "block", *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("set", "size", "at", "toggles")))
    )
    return (
        block.join(pivots, ["token", "block"])
        .filter((F.col("set") != F.col("p_set")) & may_link("", "p_", percent))
        .select(F.col("p_set").alias("a"), F.col("set").alias("b"))
        .distinct()
    )


def other_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of one list in different components (``label``). The sets outside
    a list's commonest component meet all sets of the list; those inside need
    not meet each other."""
    of = lists.groupBy("token", "label").agg(F.count("*").alias("n"))
    common = of.groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("common"), F.count("*").alias("labels"))
    mixed = lists.join(common.filter("labels > 1").drop("labels"), "token").distinct()
    few = mixed.filter(F.col("label") != F.col("common")).select(
        "token", *(F.col(c).alias(f"p_{c}") for c in ("set", "size", "at", "toggles", "label"))
    )
    differ = (F.col("label") != F.col("p_label")) & ((F.col("label") == F.col("common")) | (F.col("set") > F.col("p_set")))
    return (
        mixed.join(few, "token")
        .filter(differ & may_link("", "p_", percent, first=True))
        .select(F.least("set", "p_set").alias("a"), F.greatest("set", "p_set").alias("b"))
        .distinct()
    )


def link_groups(spark: SparkSession, docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id``, ``hash`` (of the text), ``n_shingles``, ``label`` (of the
    component, null for an empty set) and ``component_id``, the least id among
    the documents that links reach."""
    small_batches(spark)
    described = write_stage(spark, describe(docs, shingle), "sets")
    rarity = levels(described)
    described = described.filter("piece is null")
    sets = described.select("doc_id", "hash", "n_shingles", "key")
    same = [F.first(c).alias(c) for c in ("n_shingles", "toggles", "wide")]
    nodes = described.filter("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "hash")).alias("place"), *same
    )
    nodes = nodes.select("key", "least", "place.doc_id", "place.hash", "n_shingles", "toggles", "wide")
    nodes = write_stage(spark, nodes.withColumn("set", set_number("key")), "nodes")
    toggled = nodes.select("set", "toggles")
    bits = part_bits(sets.agg(F.sum("n_shingles")).first()[0] or 0)
    lists = shared_lists(entries(docs, rarity, shingle, percent, bits))
    size, at = F.col("spot").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"), F.shiftright("spot", 32).cast("int")
    lists = write_stage(spark, lists.select("token", F.col("node").alias("set"), size.alias("size"), at.alias("at")), "lists")

    pairs = write_stage(spark, pivot_pairs(lists.join(toggled, "set"), percent), "pairs")
    links = verified(spark, docs, nodes, pairs, shingle, percent)
    first = components(spark, links)
    labels = first.select(set_number("node").alias("set"), set_number("label").alias("to"))
    labelled = lists.join(labels, "set", "left").withColumn("label", F.coalesce("to", "set")).drop("to")
    mixed = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token")
    labelled = write_stage(spark, labelled.join(mixed, "token").join(toggled, "set"), "labelled")
    remove_stage(spark, lists)
    rest = other_pairs(labelled, percent).join(pairs, ["a", "b"], "left_anti")
    rest = write_stage(spark, rest, "pairs")
    remove_stage(spark, labelled)
    more = verified(spark, docs, nodes, rest, shingle, percent)
    found = components(spark, links.unionByName(more))

    grouped = nodes.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    by_key = grouped.select("key", "label").join(least, "label").select("key", "label", "component_id")
    return sets.join(by_key, "key", "left").select(
        "doc_id", "hash", "n_shingles", "label", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard of at least 0.9."""
    return link_groups(spark, load(spark, sf_dir, "documents")).drop("hash", "label")
