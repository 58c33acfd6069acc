"""The corpus pipeline and the registered queries on the small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from retainlab.llm import jaccard, lines
from retainlab.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SMALL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    want = duck.execute(ORACLE_SQL[name])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_run(spark, name):
    table = {"op5_html": "pages", "op12_whitening": "embeddings"}.get(name, "documents")
    rows = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    n = QUERIES[name](spark, SMALL).count()
    assert n >= rows if name == "op7_packing" else n == rows * (32 if name == "op12_whitening" else 1)


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    blank = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "...", None, None, None)], docs.schema)
    docs = docs.unionByName(blank)
    columns, at = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SMALL).cache()
        assert at.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in at.collect()}
    assert 10**6 not in kept["language_id"] and 10**6 + 1 not in kept["language_id"]
    seen: set[bytes] = set()
    for text in kept["line_dedup"].values():
        for x in lines.normalised(text):
            if x.count(b" ") >= 4:
                assert x not in seen
                seen.add(x)
    sets = [set(jaccard.shingle_set(t).tolist()) for t in kept["near_copies"].values()]
    for i, x in enumerate(sets):
        assert not any(100 * len(x & y) >= 90 * len(x | y) for y in sets[:i] if x and y)
    whole = corpus_pipeline.run(spark, SMALL)
    packed = whole.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert packed.filter("n <> m").count() == 0
    assert {r["doc_id"] for r in packed.collect()} == set(kept["decontaminate"])


def test_near_copies_by_five_words(spark):
    """One of 50 words replaced: five-word Jaccard 41 / 51, three-word 45 / 51."""
    words = [f"w{i}" for i in range(50)]
    far = [*words[:10], "x", *words[11:30], "y", *words[31:]]
    texts = [words, [*words[:25], "x", *words[26:]], far, ["other", *words[:9]]]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [set(jaccard.shingle_set(" ".join(t), 5).tolist()) for t in texts]
    alike = [[100 * len(x & y) >= 80 * len(x | y) for y in sets] for x in sets]
    assert alike[0] == [True, True, False, False]
    threes = [set(jaccard.shingle_set(" ".join(t)).tolist()) for t in texts]
    assert 100 * len(threes[0] & threes[1]) < 90 * len(threes[0] | threes[1])
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, SMALL).collect()} == {0, 2, 3}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
