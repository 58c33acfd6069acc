"""Clustering, whitening and mixing against brute force, on odd small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from retainlab.llm import centroids, mixing, whitening
from retainlab.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
EMB = "vec_id long, embedding array<float>, label int, x array<int>, cluster string, index int, n int, v double, id string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, hash int, target double, shards int, copies long"


def odd_vectors(dims: int = 64, rows: int = 90) -> list[tuple]:
    rnd = random.Random(5)
    base = [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(rows)]
    out = [(i, v) for i, v in enumerate(base)]
    out += [(3, base[3]), (3, base[3]), (200, base[3]), (None, base[7]), (201, None), (202, []), (203, base[0][:-1])]
    for bad in (None, float("nan"), float("inf"), -float("inf")):
        out.append((300, [*base[1][:-1], bad]))
    out.append((301, [0.0] * dims))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, [1], "c", 2, 3, 0.5, "i") for i, v in rows], EMB).repartition(4)


def clean(rows, dims=64):
    return [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]


def plain_clusters(rows, k=16, rounds=3):
    def digest(i):
        return (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")

    cents = [list(v) for _, v in sorted(rows, key=lambda r: (*digest(r[0]), r[1]))[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
        return min(d), d.index(min(d))

    for _ in range(rounds):
        members = [[] for _ in cents]
        for _, v in rows:
            members[nearest(v)[1]].append(v)
        cents = [[sum(c) // len(m) for c in zip(*m)] if m else old for m, old in zip(members, cents)]
    got = [(i, nearest(v)[1], nearest(v)[0]) for i, v in rows]
    inertia = {c: sum(d for _, k_, d in got if k_ == c) for _, c, _ in got}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in got]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_clusters_equal_brute_force(spark):
    rows = odd_vectors()
    got = centroids.cluster_vectors(spark, table(spark, rows))
    assert order(got.collect()) == order(plain_clusters(clean(rows)))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.5] * 64)]])
def test_clusters_of_few_rows(spark, rows):
    got = centroids.cluster_vectors(spark, table(spark, rows))
    assert order(got.collect()) == (order(plain_clusters(clean(rows))) if clean(rows) else [])


def test_walk_gives_the_nearest_with_ties_and_stops_early():
    rng = np.random.default_rng(2)
    for dims, k, spread in ((1, 1, 3), (2, 9, 3), (3, 40, 5), (8, 200, 400)):
        c, x = rng.integers(-spread, spread, (k, dims)), rng.integers(-spread, spread, (300, dims))
        who, best, depth = centroids.SortedLists(c).nearest(x)
        d = ((x[:, None, :] - c) ** 2).sum(2)
        assert (best == d.min(1)).all() and (who == d.argmin(1)).all()  # argmin: the smaller number
        assert (depth <= k).all()
    assert depth.mean() < k / 2
    spread_out = np.arange(0, 10_000, 100)[:, None]
    assert (centroids.SortedLists(spread_out).nearest(spread_out + 1)[2] == 2).all()


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="64-bit"):
        centroids.cluster_vectors(spark, table(spark, [(1, [1e30] * 64)])).collect()


def test_clusters_equal_sql(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(ORACLE_SQL["op11_centroids"])
    names = [c[0] for c in want.description]
    assert order(want.fetchall()) == order(QUERIES["op11_centroids"](spark, SF).select(names).collect())


def plain_whitening(rows, dims, most):
    x = np.array([v for _, v in rows], dtype=object) + 1_000_000
    n, sums = len(x), x.sum(0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(v, sums))) for v in x]
    c = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in x])
    val, vec = np.linalg.eigh(c.T @ c / n)
    val, vec = val[::-1][:most], vec[:, ::-1][:, :most]
    return n, deviation, c @ (vec / np.sqrt(val)), val / np.trace(c.T @ c / n)


@pytest.mark.parametrize("dims,most", [(6, 4), (6, 32), (64, 32)])
def test_whitening_equals_brute_force(spark, monkeypatch, dims, most):
    monkeypatch.setattr(whitening, "ROWS", 16)  # several blocks, several tasks a scatter
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    rows = odd_vectors(dims, 150)
    got = whitening.whiten(spark, table(spark, rows), most).collect()
    kept = clean(rows, dims)
    n, deviation, white, share = plain_whitening(kept, dims, min(most, dims))
    assert len(got) == n * white.shape[1] and {r["n"] for r in got} == {n}
    assert {r["component"] for r in got} == set(range(1, white.shape[1] + 1))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    signs = {}
    for j in range(white.shape[1]):
        mine = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"], r["whitened"]) for r in got if r["component"] == j + 1))
        theirs = sorted((i is None, i or 0, d, w) for (i, _), d, w in zip(kept, deviation, white[:, j]))
        flipped = sorted((i is None, i or 0, d, -w) for (i, _), d, w in zip(kept, deviation, white[:, j]))
        assert [r[:3] for r in mine] == [r[:3] for r in theirs]
        signs[j] = min(max(abs(a[3] - b[3]) for a, b in zip(mine, side)) for side in (theirs, flipped))
        assert all(abs(r["explained"] / share[j] - 1) < 1e-9 for r in got if r["component"] == j + 1)
    assert max(signs.values()) < 1e-8


def test_whitening_without_variance(spark):
    assert whitening.whiten(spark, table(spark, [])).count() == 0
    assert whitening.whiten(spark, table(spark, [(1, [0.5] * 4)])).count() == 0
    assert whitening.whiten(spark, table(spark, [(1, [0.5] * 4), (2, [0.5] * 4)])).count() == 0
    line = [(i, [i / 8, -i / 8, 0.0, 1.0]) for i in range(9)]  # rank one
    got = whitening.whiten(spark, table(spark, line)).collect()
    assert [r["component"] for r in got] == [1] * 9 and abs(got[0]["explained"] - 1) < 1e-9


def test_whitening_query(spark):
    got = QUERIES["op12_whitening"](spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    worst = got.agg(F.count("*"), F.max("identity_error"), F.countDistinct("vec_id")).first()
    assert worst[0] == 32 * n and worst[1] < 1e-4 and worst[2] == n


# ------------------------------------------------------------------ mixing
def highest_quotients(votes, seats, caps):
    got = [0] * len(votes)
    for _ in range(seats):
        able = [i for i in range(len(votes)) if got[i] < caps[i] and votes[i]]
        if not able:
            break
        got[max(able, key=lambda i: (Fraction(votes[i]) / (2 * got[i] + 1), -i))] += 1
    return got


def test_apportionment_equals_highest_quotients():
    rnd = random.Random(4)
    for _ in range(400):
        n = rnd.randint(1, 7)
        votes = [rnd.choice((0, 1, 5, 5, Fraction(rnd.randint(1, 900), rnd.randint(1, 9)))) for _ in range(n)]
        caps = [rnd.choice((0, 2, 1000)) for _ in range(n)]
        seats = rnd.randint(0, 60)
        assert mixing.sainte_lague(votes, seats, caps) == highest_quotients(votes, seats, caps), (votes, seats, caps)


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200, 75, 175] or mixing.targets([100, 100, 100]) == [200, Fraction(250, 3), Fraction(500, 3)]
    rnd = random.Random(1)
    for _ in range(200):
        sizes = [rnd.choice((0, 1, 10, 1000, 12345)) for _ in range(rnd.randint(1, 9))]
        got, weights = mixing.targets(sizes), [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        assert sum(got) == Fraction(3 * sum(sizes), 2)
        level = [t / w for t, w, s in zip(got, weights, sizes) if t < 2 * s]
        assert all(t <= 2 * s for t, s in zip(got, sizes)) and len(set(level)) <= 1
        assert all(2 * s <= level[0] * w for t, w, s in zip(got, weights, sizes) if level and t == 2 * s)


def odd_documents() -> list[tuple]:
    rnd = random.Random(11)
    out = []
    for i in range(400):
        n = rnd.choice((1, 3, 40, 200))
        out.append((i, " ".join(f"w{rnd.randint(0, 99)}" for _ in range(n)), f"s{i % 4}" if i % 3 else "hot"))
    out += [(5, "a b c", "s1")] * 3 + [(5, "a b c", "hot"), (5, "d e f", "s1"), (None, "x y", "s2"), (None, "x y", "s2"), (None, None, "s2")]
    out += [(900, None, None), (901, "\t one\x0btwo three \n", None), (902, "", "empty"), (903, "z " * 9000, "long"), (904, "é ü", "é")]
    return out


def docs_table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "a", 1, 0.5, 2, 7) for i, t, s in rows], DOCS).repartition(5)


def test_mix_equals_brute_force(spark):
    rows = odd_documents()
    docs = docs_table(spark, rows)
    args = {"block": 16, "shard_words": 1500}
    mixed = mixing.mix(spark, docs, **args)
    got = mixing.words_taken(mixed).collect()
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(w for w, r in zip(words, rows) if r[2] == s) for s in names]
    wanted, unit = mixing.targets(sizes), mixing.block_words(sizes, 16)
    per_shard = max(1500, unit * 256, sum(sizes) // 16_384)
    # every source as a list of (document, word) in shards, blocks taken one by one
    keyed = mixing.sized(docs, 42).collect()
    shards = {}
    for r in sorted(keyed, key=lambda r: (r["hash"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"])):
        i = names.index(r["source"])
        key = (i, r["hash"] % (-(-sizes[i] // per_shard) or 1))
        shards.setdefault(key, []).append(r)
    lengths = {k: sum(r["size"] for r in v) for k, v in shards.items()}
    quotas = mixing.shard_quotas(sizes, wanted, lengths, unit)
    import zlib

    want = []
    for key, members in shards.items():
        stream = [(j, w) for j, r in enumerate(members) for w in range(r["size"])]
        n, q = max(1, -(-len(stream) // unit)), quotas[key]
        s = zlib.crc32(f"42:{key}".encode()) % n
        chosen = [b for b in range(n) if ((b + 1) * q + s) // n > (b * q + s) // n]
        assert len(chosen) == q
        extra = [j for b in chosen for j, _ in stream[b * unit : (b + 1) * unit]]
        i = key[0]
        passes = int(wanted[i] / sizes[i]) if sizes[i] else 0
        want += [(r["doc_id"], r["source"], r["size"], sizes[i], float(wanted[i]), passes * r["size"] + extra.count(j)) for j, r in enumerate(members)]
    have = [(r["doc_id"], r["source"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got]
    assert order(have) == order(want) and len(have) == len(rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    for s, size, t in zip(names, sizes, wanted):
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - t) <= max(unit * 1.5 * (-(-size // per_shard) + 1), 0.01 * t)
    texts = mixing.mixed_texts(docs, mixed).collect()
    per_source = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in texts if r["source"] == s) for s in names}
    assert per_source == {s: sum(r["taken"] for r in got if r["source"] == s) for s in names}
    assert order(mixing.words_taken(mixing.mix(spark, docs.repartition(2), **args)).drop("hash").collect()) == order(mixing.words_taken(mixed).drop("hash").collect())


def test_mix_of_an_empty_table(spark):
    assert mixing.words_taken(mixing.mix(spark, docs_table(spark, []))).count() == 0
    only = docs_table(spark, [(1, None, "a"), (2, "", None)])
    assert [r["taken"] for r in mixing.words_taken(mixing.mix(spark, only)).collect()] == [0, 0]


def test_mixing_query(spark):
    got = QUERIES["op13_mixing"](spark, SF)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source")
    by = got.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"))
    assert got.count() == docs.count()
    assert all(abs(r["t"] / r["w"] - 1) < 0.01 and r["over"] <= 0 for r in by.collect())
