"""Packing documents into token windows by best-fit decreasing.

1. Every whole text is tokenised in the scan and an end id appended; an
   overlong document is cut into full windows and one rest. The pieces (five
   numbers each) are written once to the shared folder.
2. Rests of one length are interchangeable, so the exact global best-fit
   decreasing run over all rests needs only their counts by length: at most
   ``window - 1`` rows, whatever the corpus holds. A segment tree indexed by
   remaining capacity finds the tightest open window for each length.
3. Each rest gets its rank within its length (hot lengths are dealt over
   salted counters) and reads its window and place off the runs of the plan.

Null or empty text: one piece with the end id alone. Repeated rows are packed
as often as they occur. An empty table gives no rows. A table without the
columns ``doc_id`` and ``text`` is an error; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, chunks, load, small_batches, write_stage
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
RUNS = "length long, runs array<struct<lo: long, hi: long, sequence: long, each: long, offset: long>>"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """Pieces of at most ``window`` ids: all full but the last of a document."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()

        def rows():
            for doc_id, text in arrow_rows(batches, "doc_id", "text"):
                ids = np.frombuffer(enc.encode(text or "") + end, dtype=enc.dtype).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    yield doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)

        yield from chunks(rows(), _PIECES)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


class TightestFit:
    """Segment tree over remaining capacities 0..top: which are present."""

    def __init__(self, top: int):
        self.size = 1 << (top + 1).bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        node = capacity + self.size
        while node:
            self.tree[node] += n
            node //= 2

    def at_least(self, need: int) -> int | None:
        """The smallest present capacity of at least ``need``."""
        node = need + self.size
        if self.tree[node]:
            return need
        while node > 1:  # climb to the first right sibling with windows
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.size:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.size


@dataclass
class Open:
    """``count`` windows filled alike, numbered from ``first``."""

    first: int
    count: int


def best_fit_decreasing(counts: dict[int, int], window: int) -> tuple[dict[int, list[tuple]], int]:
    """The runs (lo, hi, first sequence, items each, offset) by length, and the
    number of windows. Items ``lo..hi`` of a length lie ``each`` to a window.

    Equal to placing one item after the other, longest first, each into the
    tightest open window: while a window takes an item of the length at hand
    it stays the tightest one for the next, so it is filled with as many as
    fit, and windows with one remaining capacity are taken in turn.
    """
    tree, heaps = TightestFit(window), [[] for _ in range(window + 1)]
    runs: dict[int, list[tuple]] = {}
    n_windows = 0

    def put(capacity: int, group: Open) -> None:
        if group.count:
            heaps[capacity].append(group)
            tree.add(capacity, group.count)

    for length in sorted(counts, reverse=True):
        left, done, out = counts[length], 0, []
        while left:
            capacity = tree.at_least(length)
            if capacity is None:
                capacity = window
                group = Open(n_windows, -(-left // (window // length)))
                n_windows += group.count
            else:
                group = heaps[capacity].pop()
                tree.add(capacity, -group.count)
            each = capacity // length
            full = min(group.count, left // each)
            if full:
                out.append((done, done + full * each, group.first, each, window - capacity))
                done, left = done + full * each, left - full * each
                put(capacity - each * length, Open(group.first, full))
            first, rest = group.first + full, group.count - full
            if rest and left and left < each:
                out.append((done, done + left, first, left, window - capacity))
                put(capacity - left * length, Open(first, 1))
                done, left, first, rest = done + left, 0, first + 1, rest - 1
            put(capacity, Open(first, rest))
        runs[length] = out
    return runs, n_windows


def ranked(rests: DataFrame, salts: int) -> DataFrame:
    """Column ``rank``: 0, 1, ... within each length, dealt over ``salts``."""
    salted = rests.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return (
        salted.withColumn("at", F.row_number().over(own) - 1)
        .join(base, ["length", "salt"])
        .withColumn("rank", F.col("base") + F.col("at"))
        .drop("salt", "at", "base")
    )


def pack(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    window: int = 2048,
    salts: int = 64,
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` (gapless from 0)."""
    small_batches(spark)
    pieces = write_stage(spark, token_pieces(docs, tokenizer, end_id, window), "pieces")
    rests = pieces.filter(F.col("length") < window)
    counts = {r["length"]: r["n"] for r in rests.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, n_windows = best_fit_decreasing(counts, window)
    # at most window - 1 rows; the runs of all lengths are bounded by the window too
    plan = F.broadcast(spark.createDataFrame(list(runs.items()), RUNS))
    run = F.element_at(F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"])), 1)
    at = F.col("rank") - F.col("run.lo")
    placed = (
        ranked(rests, salts)
        .join(plan, "length")
        .withColumn("run", run)
        .withColumn("sequence_id", F.col("run.sequence") + F.floor(at / F.col("run.each")).cast("long"))
        .withColumn("offset", F.col("run.offset") + F.pmod(at, F.col("run.each")) * F.col("length"))
    )
    full = (
        pieces.filter(F.col("length") == window)
        .withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(n_windows))
        .withColumn("offset", F.lit(0).cast("long"))
    )
    names = [*pieces.columns, "sequence_id", "offset"]
    return full.select(names).unionByName(placed.select(names))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 ids of the word tokenizer."""
    return pack(spark, load(spark, sf_dir, "documents"))
