"""Mixing sources to target weights by Sainte-Lague apportionment of blocks.

1. Words are counted in the scan; (doc_id, source, size, hash) is written once.
2. Targets: sources in code point order, null last, share ``percent`` of all
   words by repeating weights; no target exceeds ``most`` times its source, the
   excess goes by weight to the others until none is above.
3. A source is dealt by seeded hash over shards, and a shard's documents, in
   hash order, form one run of words cut into blocks of equal size (the last of
   a shard may be shorter). The mix takes whole passes over a source while they
   fit its target; the rest of all targets is allocated in blocks, each block
   to the source with the highest quotient rest / (2 * blocks given + 1), then
   each source's blocks in the same way to its shards: integer quotas.
4. A shard takes its quota evenly over its blocks from a seeded start (block i
   of n with quota q is taken if (i * q + s) mod n passes n), so which blocks a
   document overlaps, and which of those are taken, is known from its own place.

Blocks have ``block`` words, fewer where the smallest source would have under
512 of them, so each source's words come within about a block a shard of its
target. Shards hold some 65,536 words, more once there would be over 16,384:
the driver gets a row per source and per shard, never per document.

Null text and text without words have size 0 and nothing is taken. Rows equal
in all of doc_id, source and text are counted together, take consecutive places
and come out as often as they occur; rows with equal ids and other texts are
separate documents. A null source is one more source; a null id is an id. An
empty table gives no rows. Only doc_id, source and text are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, write_stage

WORD = r"[^\x20\x09-\x0D]+"
#: Tables of at most so many rows are broadcast; larger ones are joined as they are.
SMALL = 32_768


def targets(sizes: Sequence[int], weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2) -> list[Fraction]:
    """Words wanted of each source, exact, in the order given."""
    out, open_ = [Fraction(0)] * len(sizes), list(range(len(sizes)))
    left = Fraction(percent * sum(sizes), 100)
    while open_:
        unit = left / sum(weights[i % len(weights)] for i in open_)
        for i in open_:
            out[i] = unit * weights[i % len(weights)]
        above = [i for i in open_ if out[i] > most * sizes[i]]
        if not above:
            break
        for i in above:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if out[i] < most * sizes[i] or i not in above]
    return out


def sainte_lague(votes: Sequence[Fraction | int], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotients vote / (2 * seats + 1), none above its cap;
    ties go to the earlier party. Starts from rounded shares, which highest
    quotients give up to a few seats, and steps from there."""
    total = sum(votes)
    if not total:
        return [0] * len(votes)
    got = [min(cap, int(Fraction(v * seats, 1) / total + Fraction(1, 2))) for v, cap in zip(votes, caps, strict=True)]
    missing = seats - sum(got)
    if missing >= 0:
        heap = [(-Fraction(v) / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if v and g < caps[i]]
        step = 1
    else:
        heap = [(Fraction(v) / (2 * g - 1), -i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if g]
        step = -1
    heapq.heapify(heap)
    for _ in range(abs(missing)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        i = abs(i)
        got[i] += step
        if step == 1 and got[i] < caps[i]:
            heapq.heappush(heap, (-Fraction(votes[i]) / (2 * got[i] + 1), i))
        elif step == -1 and got[i]:
            heapq.heappush(heap, (Fraction(votes[i]) / (2 * got[i] - 1), -i))
    return got


def block_words(sizes: Sequence[int], block: int) -> int:
    """At most ``block`` words, and 512 blocks in the smallest source."""
    return max(1, min([block, *(s // 512 for s in sizes if s)]))


def shard_quotas(sizes: Sequence[int], wanted: Sequence[Fraction], shards: dict[tuple[int, int], int], words: int) -> dict[tuple[int, int], int]:
    """Blocks to take from each (source, shard) beyond whole passes, from the
    words in each shard."""
    rest = [t - int(t / s) * s if s else Fraction(0) for t, s in zip(wanted, sizes, strict=True)]
    of = _by_source(shards, len(sizes))
    caps = [sum(-(-shards[k] // words) for k in keys) for keys in of]
    quotas: dict[tuple[int, int], int] = {}
    for keys, blocks in zip(of, sainte_lague(rest, round(sum(rest) / words), caps), strict=True):
        held = [shards[k] for k in keys]
        quotas.update(zip(keys, sainte_lague(held, blocks, [-(-h // words) for h in held]), strict=True))
    return quotas


def _by_source(shards: dict[tuple[int, int], int], n: int) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k in sorted(shards):
        out[k[0]].append(k)
    return out


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= SMALL else table


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, hash): words of every whole text."""
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("hash"),
    )


def _taken_before(block: Column) -> Column:
    """Blocks taken among the first ``block`` ones of a shard."""
    return F.floor((block * F.col("quota") + F.col("s")) / F.col("blocks"))


def _spans(start: Column, size: Column, words: int) -> Column:
    """Spans (from, to) of the document's words that lie in taken blocks."""
    first, last = F.floor(start / words), F.floor((start + size - 1) / words)
    taken = F.filter(F.sequence(first, last), lambda b: _taken_before(b + 1) > _taken_before(b))
    spans = F.transform(taken, lambda b: F.struct(F.greatest(b * words - start, F.lit(0)).alias("from"), F.least((b + 1) * words - start, size).alias("to")))
    return F.when((size > 0) & (F.col("quota") > 0), spans).otherwise(F.array().cast("array<struct<from: long, to: long>>"))


def mix(
    spark: SparkSession,
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    percent: int = 150,
    most: int = 2,
    block: int = 256,
    shard_words: int = 65_536,
    seed: int = 42,
) -> DataFrame:
    """Every document with ``passes``, how often its whole text is taken, and
    ``spans``, the word spans taken once more."""
    rows = write_stage(spark, sized(docs, seed), "sizes")
    found = [(r["source"], r["size"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [size for _, size in found]
    wanted, words = targets(sizes, weights, percent, most), block_words(sizes, block)
    per_shard = max(shard_words, words * 256, sum(sizes) // 16_384)
    table = [(name, i, -(-size // per_shard) or 1, size, float(t), int(t / size) if size else 0) for i, ((name, size), t) in enumerate(zip(found, wanted, strict=True))]
    sources = spark.createDataFrame(table, "source string, number int, shards long, source_size long, target double, passes int")
    dealt = (
        rows.join(_small(sources.withColumnRenamed("source", "name"), len(table)), F.col("source").eqNullSafe(F.col("name")))
        .withColumn("shard", F.pmod("hash", "shards"))
        .groupBy("number", "shard", "hash", "doc_id", "source", "size", "source_size", "target", "passes")
        .agg(F.count("*").alias("copies"))
    )
    dealt = write_stage(spark, dealt, "shards")
    shards = {
        (r["number"], r["shard"]): r["w"] for r in dealt.groupBy("number", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("w")).collect()
    }
    quotas = shard_quotas(sizes, wanted, shards, words)
    plan = [(*k, q, n := max(1, -(-shards[k] // words)), zlib.crc32(f"{seed}:{k}".encode()) % n) for k, q in quotas.items()]
    planned = spark.createDataFrame(plan, "number int, shard long, quota long, blocks long, s long")
    before = Window.partitionBy("number", "shard").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("first", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(before), F.lit(0)))
    each = (
        placed.join(_small(planned, len(plan)), ["number", "shard"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("start", F.col("first") + F.col("copy") * F.col("size"))
    )
    return each.select("doc_id", "source", "hash", "size", "source_size", "target", "passes", _spans(F.col("start"), F.col("size"), words).alias("spans"))


def words_taken(mixed: DataFrame) -> DataFrame:
    """Column ``taken``: words the mix takes of a document, repeats counted."""
    more = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return mixed.withColumn("taken", F.col("passes") * F.col("size") + more)


def mixed_texts(docs: DataFrame, mixed: DataFrame, seed: int = 42) -> DataFrame:
    """The mix itself: (doc_id, source, text), a row per whole pass and per
    span of every document with words. Repeated rows share one text, held once
    by id and hash."""
    texts = docs.select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("hash")).dropDuplicates(["doc_id", "hash"])
    taken = mixed.filter((F.col("size") > 0) & ((F.col("passes") > 0) | (F.size("spans") > 0)))
    both = taken.alias("m").join(texts.alias("t"), F.col("t.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("t.hash") == F.col("m.hash")))
    pieces = F.concat(
        F.array_repeat("text", F.col("passes")),
        F.transform("spans", lambda s: F.array_join(F.slice("words", (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")), " ")),
    )
    out = both.select("m.doc_id", "m.source", "t.text", "m.passes", "m.spans")
    return out.withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD})"))).select("doc_id", "source", F.explode(pieces).alias("text"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words by source weights 3, 1, 2."""
    mixed = mix(spark, load(spark, sf_dir, "documents"))
    return words_taken(mixed).select("doc_id", "size", "source_size", "target", "taken")
