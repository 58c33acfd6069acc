"""Lists of an inverted index, shuffled as packed entries.

An entry is a token (its leading ``TOKEN_BITS`` bits are kept: tokens that fall
together only make a list longer), a node, a spot (two numbers of 32 bits) and
the node's group. A task sorts its entries by token, cuts them by leading bits
into parts and sends a part as one compressed row. The receiving task reads one
part at a time and passes on the lists with nodes of more than one group. Of a
part of more than ``HELD`` entries all lists are passed on, so that no task
holds more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows

TOKEN_BITS, GATHERED, HELD, PER_PART = 48, 1 << 20, 1 << 22, 1 << 20
PACKED = "part int, n int, entries binary"
_PACKED = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("entries", pa.binary())])
LISTS = "token long, node long, spot long, long boolean"
_LISTS = pa.schema([(c, pa.int64()) for c in ("token", "node", "spot")] + [("long", pa.bool_())])

Entries = tuple[np.ndarray, ...]  # token (unsigned), node, spot, label, and further columns


def part_bits(entries: int) -> int:
    """Leading bits that cut so many entries into parts."""
    return min(16, max(5, (entries // PER_PART).bit_length()))


def packed(token: np.ndarray, node: np.ndarray, spot: np.ndarray, label: np.ndarray, *more: np.ndarray) -> bytes:
    columns = np.diff(token, prepend=token.dtype.type(0)), node, spot, label ^ node, *more
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked(n: int, data: bytes, width: int = 4) -> Entries:
    planes = np.frombuffer(pa.decompress(data, n * width * 8, codec="zstd", asbytes=True), np.uint8).reshape(width, 8, n)
    step, node, spot, differ, *more = (np.ascontiguousarray(p.T).view(np.int64).ravel() for p in planes)
    return np.cumsum(step.view(np.uint64), dtype=np.uint64), node, spot, differ ^ node, *more


def _joined(held: list[Entries]) -> Entries:
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order] for c in columns)


def pack(entries: Iterable[Entries], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``PACKED`` from a task's entries (tokens of ``TOKEN_BITS``)."""

    def rows(held: list[Entries]) -> Iterator[pa.RecordBatch]:
        columns = _joined(held)
        ends = np.searchsorted(columns[0] >> np.uint64(TOKEN_BITS - bits), np.arange(1 << bits, dtype=np.uint64), side="right")
        lo = 0
        for part, hi in enumerate(ends.tolist()):
            if hi > lo:
                yield pa.RecordBatch.from_pylist([{"part": part, "n": hi - lo, "entries": packed(*(c[lo:hi] for c in columns))}], schema=_PACKED)
            lo = hi

    held: list[Entries] = []
    size = 0
    for columns in entries:
        held.append(columns)
        size += len(columns[0])
        if size >= GATHERED:
            yield from rows(held)
            held, size = [], 0
    if size:
        yield from rows(held)


def short(hashes: np.ndarray) -> np.ndarray:
    """Tokens of 64-bit hashes."""
    return hashes >> np.uint64(64 - TOKEN_BITS)


def shared_lists(made: DataFrame) -> DataFrame:
    """``LISTS``: the entries of the lists with nodes of more than one group,
    of rows of ``PACKED``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(columns: Entries, long: bool) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(columns[0]), 1 << 16):
                some = [pa.array(c[lo : lo + (1 << 16)].astype(np.int64)) for c in columns[:3]]
                yield pa.RecordBatch.from_arrays([*some, pa.array(np.full(len(some[0]), long))], schema=_LISTS)

        def several(held: list[Entries]) -> Entries:
            columns = _joined(held)
            token, label = columns[0], columns[3]
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            mixed = np.minimum.reduceat(label, start) < np.maximum.reduceat(label, start)
            keep = np.repeat(mixed, np.diff(start, append=len(token)))
            return tuple(c[keep] for c in columns)

        held: list[Entries] = []
        at, size = None, 0
        for part, n, data in arrow_rows(batches, "part", "n", "entries"):
            if part != at:
                if held:
                    yield from out(several(held), False)
                at, held, size = part, [], 0
            held.append(unpacked(n, data))
            size += n
            if size > HELD:  # all lists of the part are passed on as they are
                for columns in held:
                    yield from out(columns, True)
                held = []
        if held:
            yield from out(several(held), False)

    return made.repartition("part").sortWithinPartitions("part").mapInArrow(run, LISTS)


def list_pairs(lists: DataFrame, bits: int, found: Callable[[Entries], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """``a``, ``b``: the pairs of nodes that ``found`` makes of the lists of a
    part, sorted by token, each pair once. ``lists`` has only numbers, the
    columns of ``Entries``; of no part more than ``HELD`` rows."""
    names = lists.columns
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ([b.column(c).to_numpy() for c in names] for b in batches if b.num_rows)
        yield from pack(((c[0].view(np.uint64), *c[1:]) for c in columns), bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[Entries]) -> Iterator[pa.RecordBatch]:
            for a, b in found(_joined(held)):
                pairs = np.unique(np.stack([a, b]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=schema)

        held: list[Entries] = []
        at = None
        for part, n, data in arrow_rows(batches, "part", "n", "entries"):
            if part != at and held:
                yield from out(held)
                held = []
            at = part
            held.append(unpacked(n, data, len(names)))
        if held:
            yield from out(held)

    sent = lists.mapInArrow(send, PACKED).repartition("part").sortWithinPartitions("part")
    return sent.mapInArrow(run, "a long, b long").distinct()
