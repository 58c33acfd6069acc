"""Token ids in files, coded by a static range asymmetric numeral system.

File format (a folder of two tables, written and read by Spark, so that it
lies in any store Spark reaches and a lost task leaves no half file):

* ``table``: ``symbol``, ``freq``; the frequencies of all ids of the corpus,
  scaled to sum to ``2**SCALE_BITS``. One table is shared by all blocks.
* ``blocks``: one row per block of at most ``BLOCK`` ids. ``segment`` and
  ``block`` give its place in ascending document order, ``n_ids`` its length,
  ``payload`` the coded ids and ``doc_*`` the documents that begin in it or
  run into it (id, first id in the segment, length).

A payload is independent of all others. Its ids lie on ``LANES`` interleaved
64-bit states; each state emits 32-bit words. Every ``CHECKPOINT`` steps the
payload holds all states and the word position, and the crc32 of the ids up
to the next checkpoint, so a reader may start at any checkpoint and every
part is verified on its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, chunks, load, remove_stage, small_batches, stage_path, write_stage
from .tokens import encoder

SCALE_BITS, LANES, CHECKPOINT = 20, 1024, 128
BLOCK = 2 * CHECKPOINT * LANES
LOWEST = np.uint64(1 << 31)
MAGIC = b"rans1\0\0\0"
_BLOCKS = pa.schema(
    [("segment", pa.int64()), ("block", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]
    + [(n, pa.list_(pa.int64())) for n in ("doc_id", "doc_first", "doc_length")]
)
BLOCKS = "segment long, block long, n_ids long, payload binary, doc_id array<long>, doc_first array<long>, doc_length array<long>"


def scaled(counts: dict[int, int], bits: int = SCALE_BITS) -> dict[int, int]:
    """Counts scaled to sum to ``2**bits``, none of them below 1."""
    total, whole = sum(counts.values()), 1 << bits
    if len(counts) > whole:
        raise ValueError(f"{len(counts)} symbols do not fit {bits} bits")
    out = {s: max(1, c * whole // total) for s, c in counts.items()}
    rest = whole - sum(out.values())
    for s in sorted(out, key=lambda s: (-out[s], s)):  # the most frequent ones take up the difference
        step = max(rest, 1 - out[s])
        out[s] += step
        rest -= step
        if not rest:
            break
    return out


class Coder:
    """Encodes and decodes blocks with one frequency table."""

    def __init__(self, table: dict[int, int]):
        symbols = np.array(sorted(table), dtype=np.int64)
        freqs = np.array([table[s] for s in symbols.tolist()], dtype=np.int64)
        top = int(symbols[-1]) + 1 if len(symbols) else 1
        self.freq, self.below = np.zeros(top, np.uint64), np.zeros(top, np.uint64)
        self.freq[symbols] = freqs
        self.below[symbols] = np.cumsum(freqs) - freqs
        self.slot = np.repeat(symbols, freqs).astype(np.uint32)

    def encode(self, ids: np.ndarray) -> bytes:
        n, bits = len(ids), np.uint64(SCALE_BITS)
        steps = -(-n // LANES)
        state = np.full(LANES, LOWEST)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        for s in range(steps - 1, -1, -1):
            at = ids[s * LANES : (s + 1) * LANES]
            f, x = self.freq[at], state[: len(at)]
            over = x >= f << np.uint64(63 - SCALE_BITS)
            words.append((x[over] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(over, x >> np.uint64(32), x)
            state[: len(at)] = ((x // f) << bits) + x % f + self.below[at]
            if s % CHECKPOINT == 0:
                marks.append((len(words), state.copy()))
        words.reverse()
        before = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        out = [MAGIC, struct.pack("<QII", n, LANES, CHECKPOINT), struct.pack("<I", len(marks))]
        for k, (done, states) in enumerate(reversed(marks)):
            part = ids[k * CHECKPOINT * LANES : (k + 1) * CHECKPOINT * LANES].astype("<u4")
            out.append(struct.pack("<QI", before[steps - done], zlib.crc32(part.tobytes())))
            out.append(states.astype("<u8").tobytes())
        return b"".join([*out, *(w.tobytes() for w in words)])

    def parts(self, payload: bytes) -> int:
        return struct.unpack_from("<I", payload, 24)[0]

    def decode_part(self, payload: bytes, k: int) -> np.ndarray:
        """The ids from checkpoint ``k`` to the next, verified."""
        if payload[:8] != MAGIC:
            raise ValueError("not a block of this format")
        n, lanes, every = struct.unpack_from("<QII", payload, 8)
        parts, size = self.parts(payload), 12 + 8 * lanes
        at, crc = struct.unpack_from("<QI", payload, 28 + k * size)
        state = np.frombuffer(payload, "<u8", lanes, 28 + k * size + 12).astype(np.uint64)
        words = np.frombuffer(payload, "<u4", offset=28 + parts * size).astype(np.uint64)
        first, last = k * every * lanes, min(n, (k + 1) * every * lanes)
        ids = np.empty(last - first, dtype="<u4")
        bits, mask = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
        for s in range(0, len(ids), lanes):
            x = state[: min(lanes, len(ids) - s)]
            low = x & mask
            sym = self.slot[low]
            ids[s : s + len(x)] = sym
            x = self.freq[sym] * (x >> bits) + low - self.below[sym]
            need = np.flatnonzero(x < LOWEST)
            x[need] = (x[need] << np.uint64(32)) | words[at : at + len(need)]
            at += len(need)
            state[: len(x)] = x
        if zlib.crc32(ids.tobytes()) != crc or k == parts - 1 and (state != LOWEST).any():
            raise ValueError("block part fails its checksum")
        return ids

    def decode(self, payload: bytes) -> np.ndarray:
        return np.concatenate([self.decode_part(payload, k) for k in range(self.parts(payload))])


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``doc_id`` and its ids as bytes, the end id last; null text: the end id."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        rows = ((d, enc.encode(t or "") + end) for d, t in arrow_rows(batches, "doc_id", "text"))
        yield from chunks(rows, schema, 1000)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, dtype: str) -> dict[int, int]:
    """Corpus counts by id; one row per id of the vocabulary comes back."""
    schema = pa.schema([("symbol", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:  # a batch at a time: a count is as long as the vocabulary
            one = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), dtype))
            if len(one) > len(total):
                total = np.pad(total, (0, len(one) - len(total)))
            total[: len(one)] += one
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], schema=schema)

    partial = tokens.select("ids").mapInArrow(run, "symbol long, n long")
    return {r["symbol"]: r["n"] for r in partial.groupBy("symbol").agg(F.sum("n").alias("n")).collect()}


def write_corpus(
    spark: SparkSession, docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0
) -> None:
    """Encode all documents in ascending ``doc_id`` order into ``path``.

    Null ids come first, equal ids in the order of their coded ids; repeated
    rows are kept. An empty table leaves a table and no blocks. Ranges of
    document ids are segments, one task each; a task holds one block.
    """
    small_batches(spark)
    tokens = write_stage(spark, tokenised(docs, tokenizer, end_id), "tokens")
    dtype = encoder(tokenizer).dtype.str
    table = scaled(id_counts(tokens, dtype)) if tokens.head(1) else {}
    spark.createDataFrame(sorted(table.items()), "symbol long, freq long").coalesce(1).write.parquet(f"{path}/table")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, segment = Coder(table), TaskContext.get().partitionId()

        def blocks():
            held: list[np.ndarray] = []
            index: list[tuple] = []
            size = block = first = 0
            for doc_id, raw in arrow_rows(batches, "doc_id", "ids"):
                ids = np.frombuffer(raw, dtype)
                doc, at = (doc_id, first, len(ids)), 0
                while at < len(ids):
                    part = ids[at : at + BLOCK - size]
                    held.append(part)
                    index.append(doc)
                    at, size = at + len(part), size + len(part)
                    if size == BLOCK:
                        yield segment, block, size, coder.encode(np.concatenate(held)), *map(list, zip(*index, strict=True))
                        held, index, size, block = [], [], 0, block + 1
                first += len(ids)
            if size:
                yield segment, block, size, coder.encode(np.concatenate(held)), *map(list, zip(*index, strict=True))

        yield from chunks(blocks(), _BLOCKS, 4)

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    remove_stage(spark, tokens)


def crc_join(crc1: int, crc2: int, length2: int) -> int:
    """crc32 of two byte strings in a row from their own crc32 values."""

    def times(matrix: list[int], vector: int) -> int:
        out = 0
        for row in matrix:
            if vector & 1:
                out ^= row
            vector >>= 1
            if not vector:
                break
        return out

    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        step = [times(step, row) for row in step]
    while length2:
        if length2 & 1:
            crc1 = times(step, crc1)
        length2 >>= 1
        if length2:
            step = [times(step, row) for row in step]
    return crc1 ^ crc2


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files of ``path``: ``doc_id``, ``start``, ``n_tokens``,
    ``ids_crc32`` per document. Blocks are decoded in parallel; the pieces of
    a document that runs over blocks meet as (length, crc) pairs only."""
    table = {r["symbol"]: r["freq"] for r in spark.read.parquet(f"{path}/table").collect()}
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    names = ("segment", "doc_id", "first", "n_tokens", "at", "length", "crc")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table)

        def pieces():
            for segment, block, payload, ids, firsts, lengths in arrow_rows(
                batches, "segment", "block", "payload", "doc_id", "doc_first", "doc_length"
            ):
                data, begin = coder.decode(payload), block * BLOCK
                for doc_id, first, length in zip(ids, firsts, lengths, strict=True):
                    lo, hi = max(first, begin), min(first + length, begin + len(data))
                    part = data[lo - begin : hi - begin]
                    yield segment, doc_id, first, length, lo - first, hi - lo, zlib.crc32(part.tobytes())

        yield from chunks(pieces(), schema)

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([(n, pa.int64()) for n in ("segment", "doc_id", "first", "n_tokens", "ids_crc32")])

        def rows():
            for segment, doc_id, first, n, parts in arrow_rows(batches, "segment", "doc_id", "first", "n_tokens", "parts"):
                crc = parts[0]["crc"]
                for p in parts[1:]:
                    crc = crc_join(crc, p["crc"], 4 * p["length"])
                yield segment, doc_id, first, n, crc

        yield from chunks(rows(), out)

    pieces = blocks.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    docs = (
        pieces.groupBy("segment", "first")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_tokens").alias("n_tokens"),
            F.sort_array(F.collect_list(F.struct("at", "length", "crc"))).alias("parts"),
        )
        .mapInArrow(joined, "segment long, doc_id long, first long, n_tokens long, ids_crc32 long")
    )
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # one row a segment
    base = (
        blocks.groupBy("segment")
        .agg(F.sum("n_ids").alias("n"))
        .select("segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    return docs.join(base, "segment").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def op1_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids of the byte tokenizer, coded, written, read back."""
    path = stage_path(spark, "rans")
    write_corpus(spark, load(spark, sf_dir, "documents"), path)
    return read_digests(spark, path)
