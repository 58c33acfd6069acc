"""Benchmark decontamination by a prefix-filtered set join, in SQL functions.

A window is ``WINDOW`` consecutive words of a benchmark item (an item of fewer
words is one window). Shingles are pairs of neighbouring words. A window lies
in a document only if all its shingles do, so by the prefix principle its one
rarest shingle is enough to find it: counts of the benchmark's shingles over
all documents give the order, and documents join windows on the prefix shingle
alone. An occurrence at word p of a document and word q of the window starts
at p - q; the start and the window's length must lie inside the document.
What is left is verified word by word on the document.

Words: runs of digits, ASCII letters and all characters beyond ASCII, lower
case in A-Z. Null or empty texts have no words; items without words have no
windows. Repeated documents are reported each; repeated items count each.
Empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, load, write_stage

WINDOW = 10
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text; null gives none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), "")


def pairs(w: Column) -> Column:
    """Hashes of the neighbouring pairs of an array of words."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))


def item_windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal items (``item_class``, ``item_id``) and their distinct
    windows (``win``, ``words``, ``item_classes``)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("item_class", F.sha2(F.array_join("words", " "), 256))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    distinct = items.groupBy("item_class").agg(F.first("words").alias("words"))
    cut = distinct.select("item_class", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("words"))
    wins = cut.groupBy("words").agg(F.collect_set("item_class").alias("item_classes"))
    return items.select("item_class", "item_id"), wins.select(
        F.sha2(F.array_join("words", " "), 256).alias("win"), "words", "item_classes"
    )


def prefixes(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """``token``, ``at``, ``win``, ``words``: the rarest shingle of each
    window of two words or more. Windows with a shingle that no document has
    are gone."""
    each = wins.filter(F.size("words") > 1).select("win", "words", F.posexplode(pairs(F.col("words"))).alias("at", "token"))
    ranked = each.join(counts, "token", "left")
    rarest = ranked.groupBy("win").agg(
        F.first("words").alias("words"),
        F.min_by(F.struct("token", "at"), F.struct(F.coalesce("n", F.lit(0)), "token", "at")).alias("p"),
        F.min(F.coalesce("n", F.lit(0))).alias("n"),
    )
    return rarest.filter("n > 0").select(F.col("p.token").alias("token"), F.col("p.at").alias("at"), "win", "words")


def occurrences(spark: SparkSession, docs: DataFrame, wins: DataFrame) -> DataFrame:
    """Verified windows of each document: ``doc_id``, ``hash`` (of the text),
    ``found``: array of (start from 0, win, n)."""
    doc = docs.select("doc_id", F.xxhash64("text").alias("hash"), words(F.col("text")).alias("w"))
    tokens = wins.filter(F.size("words") > 1).select(F.explode(pairs(F.col("words"))).alias("token")).distinct()
    tokens = write_stage(spark, tokens, "tokens")
    met = doc.select(F.explode(pairs(F.col("w"))).alias("token")).join(tokens, "token")
    counts = write_stage(spark, met.groupBy("token").agg(F.count("*").alias("n")), "counts")
    prefix = write_stage(spark, prefixes(wins, counts), "prefixes")
    sought = write_stage(spark, prefix.select("token").distinct(), "sought")  # numbers only: the planner may broadcast them
    size = F.size("w").alias("size")
    by_pair = (
        doc.select("doc_id", "hash", size, F.posexplode(pairs(F.col("w"))).alias("p", "token"))
        .join(sought, "token")
        .join(prefix, "token")
        .select("doc_id", "hash", "size", (F.col("p") - F.col("at")).alias("start"), "win", "words")
        .filter((F.col("start") >= 0) & (F.col("start") + F.size("words") <= F.col("size")))
        .drop("size")
    )
    single = wins.filter(F.size("words") == 1).select(F.element_at("words", 1).alias("word"), "win", "words")
    single = write_stage(spark, single, "single")
    by_word = (
        doc.select("doc_id", "hash", F.posexplode("w").alias("start", "word"))
        .join(single, "word")
        .select("doc_id", "hash", "start", "win", "words")
    )
    tried = by_pair.unionByName(by_word).groupBy("doc_id", "hash").agg(F.collect_set(F.struct("start", "win", "words")).alias("tried"))
    same = (F.col("d.doc_id").eqNullSafe(F.col("t.doc_id"))) & (F.col("d.hash") == F.col("t.hash"))
    checked = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).alias("d")
        .join(tried.alias("t"), same)
        .select("d.doc_id", "d.hash", words(F.col("d.text")).alias("w"), "tried")
    )
    right = F.filter("tried", lambda t: F.slice(F.col("w"), t["start"] + 1, F.size(t["words"])) == t["words"])
    found = F.transform(right, lambda t: F.struct(t["start"].alias("start"), t["win"].alias("win"), F.size(t["words"]).alias("n")))
    rows = checked.select("doc_id", "hash", found.alias("found")).filter(F.size("found") > 0)
    return rows.dropDuplicates(["doc_id", "hash"])  # repeated documents


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: ``doc_id``, ``hash``, ``n_words``, ``hit`` (positions of
    hit words, sorted) and ``items`` (ids of items with a window in it, sorted
    as strings)."""
    items, wins = item_windows(benchmark, window)
    wins = write_stage(spark, wins, "windows")
    found = write_stage(spark, occurrences(spark, docs, wins), "found")
    spans = F.transform("found", lambda f: F.sequence(f["start"], f["start"] + f["n"] - 1))
    hit = found.select("doc_id", "hash", F.array_sort(F.array_distinct(F.flatten(spans))).alias("hit"))
    classes = (
        found.select("doc_id", "hash", F.explode(F.array_distinct(F.transform("found", lambda f: f["win"]))).alias("win"))
        .join(wins.select("win", "item_classes"), "win")
        .select("doc_id", "hash", F.explode("item_classes").alias("item_class"))
        .distinct()
    )
    named = classes.join(items, "item_class").groupBy("doc_id", "hash")
    named = named.agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    all_docs = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.size(words(F.col("text"))).alias("n_words")).alias("d")

    def same(x: str) -> Column:
        return F.col("d.doc_id").eqNullSafe(F.col(f"{x}.doc_id")) & (F.col("d.hash") == F.col(f"{x}.hash"))

    return (
        all_docs.join(hit.alias("h"), same("h"), "left")
        .join(named.alias("i"), same("i"), "left")
        .select("d.doc_id", "d.hash", "d.n_words", F.col("h.hit").alias("hit"), F.col("i.items").alias("items"))
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    found = contamination(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    none = F.array().cast("array<string>")
    items = F.coalesce("items", none)
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(F.array_size("hit"), F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("hit").isNotNull().alias("contaminated"),
    )


#: the same by joining every window of documents with every item window
OP2_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
item AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (
  SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT rid, s, n, item_id FROM spot JOIN win USING (n, win)),
place AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY rid),
named AS (SELECT rid, string_agg(item_id, ',' ORDER BY item_id) AS items, count(*) AS n_items
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN place USING (rid) LEFT JOIN named USING (rid)
"""
