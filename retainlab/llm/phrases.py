"""Fingerprints of texts from their Lempel-Ziv phrases.

A text is parsed into phrases of a growing dictionary: the longest phrase seen
before, and one character more. What two texts have in common then shows in
common phrases, as it does in the size of their joint compression. The phrase
set is hashed into ``BINS`` bins, of which each keeps its least hash (one
permutation minimum hashing); two fingerprints are alike in the share of bins
with equal values among those that either fills.

The next document and the edited text come in one sorted pass: ranges of
document ids are sorted, and the first document of each range is also sent to
the end of the range before it. Null text counts as empty; an empty text has
an empty fingerprint, and two empty ones are alike (1.0), an empty and another
not (0.0). Equal ids are ordered by their text. Null ids come first.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, chunks, load, mix64, small_batches

BINS = 64


class Parse:
    """The phrases of a text, which further text may be added to."""

    def __init__(self) -> None:
        self.phrases: set[str] = set()
        self.open = ""

    def add(self, text: str) -> None:
        seen, word = self.phrases, self.open
        take = seen.add
        for ch in text:
            word += ch
            if word not in seen:
                take(word)
                word = ""
        self.open = word


def fingerprint(phrases: Iterable[str]) -> np.ndarray:
    """Least hash of each bin, 0 for an empty one."""
    crc = zlib.crc32
    codes = np.array([crc(p.encode("utf-8", "surrogatepass")) for p in phrases], dtype=np.uint64)
    out = np.zeros(BINS, dtype=np.uint32)
    if len(codes):
        h = mix64(codes + np.uint64(1))
        least = np.full(BINS, 0xFFFFFFFF, dtype=np.uint32)
        np.minimum.at(least, (h % np.uint64(BINS)).astype(np.int64), (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1))
        filled = np.unique((h % np.uint64(BINS)).astype(np.int64))
        out[filled] = least[filled]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    either = (a > 0) | (b > 0)
    return float(((a == b) & either).sum() / either.sum()) if either.any() else 1.0


def pair_prints(text: str, nxt: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The edited text, and the fingerprints of text and edited text; what
    both begin with is parsed once."""
    cut = len(text) // 4
    kept = text[: len(text) - cut]
    edited = kept + nxt[:cut]
    both = Parse()
    both.add(kept)
    other = Parse()
    other.phrases, other.open = set(both.phrases), both.open
    both.add(text[len(kept) :])
    other.add(edited[len(kept) :])
    return edited, fingerprint(both.phrases), fingerprint(other.phrases)


def ranges(docs: DataFrame, parts: int) -> DataFrame:
    """``part`` (range of ``doc_id``) and ``last`` (the copy that ends a
    range: the next range's first row) beside ``doc_id`` and ``text``."""
    share = [i / parts for i in range(1, parts)]
    cuts = sorted(set(docs.approxQuantile("doc_id", share, 1 / (4 * parts)))) if share else []
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    bounds = F.array(*(F.lit(int(c)) for c in cuts)).cast("array<long>")
    part = F.size(F.filter(bounds, lambda c: c <= key)) if cuts else F.lit(0)
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key")).withColumn("part", part)
    firsts = sorted((r["part"], r["first"]) for r in placed.groupBy("part").agg(F.min("key").alias("first")).collect())
    # each range's first row also goes to the range before it, the first range's to the last
    sends = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    if not sends:
        return placed.select("part", F.lit(0).alias("last"), "doc_id", "text", "key")
    to = F.create_map(*(F.lit(x) for pair in sends for x in pair)).cast("map<long,int>")[F.col("key")]
    placed = placed.withColumn("to", to)
    own = placed.select("part", F.lit(0).alias("last"), "doc_id", "text", "key")
    sent = placed.filter("to is not null").select(F.col("to").alias("part"), F.lit(1).alias("last"), "doc_id", "text", "key")
    return own.unionByName(sent)


def fingerprints(spark: SparkSession, docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per document: ``n_chars``, ``edited`` (text), both fingerprints as
    arrays of numbers, and their likeness to each other and to the next
    document's."""
    small_batches(spark)
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string())]
    fields += [("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = pa.schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            held = None  # the document whose next one is awaited
            waiting = None  # its row, but for the next one's fingerprint
            for part, last, doc_id, text in arrow_rows(batches, "part", "last", "doc_id", "text"):
                if held is not None and held[0] == part:
                    edited, own, other = pair_prints(held[2], text)
                    if waiting is not None:
                        yield *waiting[0], likeness(waiting[1], own)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    row = (held[1], len(held[2]), sha, own.tobytes().hex(), other.tobytes().hex(), likeness(own, other))
                    waiting = (row, own)
                    if last:  # the copy's own row is another task's; only its fingerprint is needed
                        whole = Parse()
                        whole.add(text)
                        yield *waiting[0], likeness(own, fingerprint(whole.phrases))
                        held = waiting = None
                        continue
                held = None if last else (part, doc_id, text)

        yield from chunks(out(), schema, 1000)

    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    # four ranges a task: chance puts several of them into one
    dealt = ranges(docs, 4 * parts).repartition(parts, "part").sortWithinPartitions("part", "last", "key", "text")
    return dealt.select("part", "last", "doc_id", "text").mapInArrow(run, ddl)


def op4_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of all documents, their edited texts and the next."""
    return fingerprints(spark, load(spark, sf_dir, "documents"))
