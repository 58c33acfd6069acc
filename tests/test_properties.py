"""Properties: K1 equals a plain window, AUC is invariant under monotone
maps, the one-pass sweep equals direct counts, isotonic output is monotone,
tiers add up, exact quantiles equal percentile()."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from retainlab.operators import blocks as B
from retainlab.operators import calibrate as CA
from retainlab.operators import evaluate as E


@pytest.fixture(scope="module")
def scores(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        m = "a" if i % 2 else "b"
        pts = rnd.randint(0, 40) * 25  # many ties, edges of the grid included
        rows.append((i, m, int(rnd.random() < pts / 1000), pts / 1000.0))
    return spark.createDataFrame(rows, "id long, model string, y_true int, score double")


def test_k1_equals_window(scores):
    got = B.prefix_sums(scores, [-F.col("score"), F.col("id")], {"y": F.col("y_true")},
                        group=["model"], n_ranges=7)
    w = Window.partitionBy("model").orderBy(F.col("score").desc(), F.col("id").asc())
    ref = scores.select("id", F.row_number().over(w).alias("r"),
                        F.sum("y_true").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    a = {r["id"]: (r["rank"], r["cum_y"]) for r in got.collect()}
    b = {r["id"]: (r["r"], r["c"]) for r in ref.collect()}
    assert a == b


def test_k1_ranges_split_a_hot_value(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 3 == 0).cast("int").alias("v"))
    key = F.struct("v", "id")
    bounds = B.range_bounds(rows, key, 8)
    assert len(bounds.first()["_bounds"]) == 7
    sizes = rows.crossJoin(bounds).groupBy(B.range_of(key, 8).alias("r")).agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("z")).orderBy("r").collect()
    assert [r["r"] for r in sizes] == list(range(8)) and max(r["n"] for r in sizes) < 4000 / 3
    assert all(tuple(x["z"]) < tuple(y["a"]) for x, y in zip(sizes, sizes[1:]))
    few = rows.limit(2)
    assert B.prefix_sums(few, [F.col("id")], n_ranges=50).count() == 2
    assert B.prefix_sums(rows.limit(0), [F.col("id")], n_ranges=5).count() == 0


def test_campaign_plan_moves_few_columns(spark):
    from retainlab.operators import portfolio as P
    from retainlab.plans.q_portfolio import BUDGET, OFFER_COST, scored_portfolio

    from .conftest import SMALL

    plan = P.campaign_summary(scored_portfolio(spark, SMALL), BUDGET, OFFER_COST)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and "checkpoint" not in plan and not any("StreamingTV" in line for line in windows)


def test_auc_monotone_invariant(scores):
    a = {r[0]: r[1] for r in E.roc_auc(scores).collect()}
    t = scores.withColumn("score", F.col("score") * 3 + 1)
    b = {r[0]: r[1] for r in E.roc_auc(t).collect()}
    assert a == b


def test_auc_pairs(scores):
    pos = scores.filter("y_true = 1").alias("p")
    neg = scores.filter("y_true = 0").alias("n")
    pr = pos.join(neg, F.col("p.model") == F.col("n.model")).groupBy("p.model").agg(
        F.avg(F.when(F.col("p.score") > F.col("n.score"), 1.0)
              .when(F.col("p.score") == F.col("n.score"), 0.5).otherwise(0.0)).alias("auc"))
    want = {r[0]: round(r[1], 6) for r in pr.collect()}
    got = {r[0]: r[1] for r in E.roc_auc(scores).collect()}
    assert got == want


def test_sweep_equals_direct(scores):
    grid = B.linspace_values(0.001, 0.999, 999)
    sw = {(r["model"], r["threshold"]): (r["tp"], r["fp"]) for r in E.sweep_counts(scores, 0.001, 0.999, 999).collect()}
    for t in [grid[i] for i in (0, 24, 99, 249, 250, 499, 624, 998)]:
        d = scores.groupBy("model").agg(F.count_if((F.col("score") >= t) & (F.col("y_true") == 1)).alias("tp"),
                                        F.count_if((F.col("score") >= t) & (F.col("y_true") == 0)).alias("fp"))
        for r in d.collect():
            assert sw[(r["model"], t)] == (r["tp"], r["fp"])


def test_isotonic_monotone(scores):
    iso = CA.fit_isotonic(scores.filter("model = 'a'"))
    out = CA.apply_isotonic(scores.filter("model = 'b'"), iso).select("id", F.col("score").alias("cal"))
    j = out.join(scores.select("id", "score"), "id").orderBy("score").collect()
    vals = [r["cal"] for r in j]
    assert all(x <= y + 1e-12 for x, y in zip(vals, vals[1:]))


def test_exact_quantile(scores):
    got = {r[0]: r[1] for r in B.exact_quantiles(scores, "model", "score", 0.5, n_ranges=5).collect()}
    want = {r[0]: r[1] for r in scores.groupBy("model").agg(F.percentile("score", 0.5)).collect()}
    assert got == pytest.approx(want)


def test_tiers_sum_to_total(spark):
    from retainlab.operators import portfolio as P
    from retainlab.plans.q_portfolio import scored_portfolio

    from .conftest import SMALL

    pf = scored_portfolio(spark, SMALL)
    rows = P.tier_breakdown(pf).filter("Contract IS NULL").collect()
    assert sum(r["n"] for r in rows) == pf.count()


def test_smote_counts_and_segments(spark):
    from retainlab.operators.prepare import smote

    rows = [(i, 1 if i % 4 == 0 else 0, [float(i % 7), float(i % 5)]) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, y_true int, vec array<double>")
    out = smote(df, k=3)
    assert out.count() == 150 - 50
    mino = [r[2] for r in rows if r[1] == 1]
    lo = [min(v[i] for v in mino) for i in range(2)]
    hi = [max(v[i] for v in mino) for i in range(2)]
    for r in out.collect():
        assert all(lo[i] - 1e-9 <= r["features"][i] <= hi[i] + 1e-9 for i in range(2))


def test_pair_counts_of_many_models(spark):
    from retainlab.operators import diversity as D

    rnd = random.Random(2)
    names = [f"m{i:02d}" for i in range(25)]
    y = {k: rnd.randint(0, 1) for k in range(40)}
    score = {(k, m): rnd.choice((0.1, 0.5, 0.9)) for k in y for m in names}
    rows = [(f"c{k}", m, y[k], s) for (k, m), s in score.items()]
    df = spark.createDataFrame(rows, "customerID string, model string, y_true int, score double")
    got = {(r["model_a"], r["model_b"]): (r["n11"], r["n10"], r["n01"], r["n00"]) for r in D.pair_contingency(df, names).collect()}
    right = {(k, m): int(score[k, m] >= 0.5) == y[k] for k, m in score}
    assert len(got) == 300
    for (a, b), counts in got.items():
        pairs = [(right[k, a], right[k, b]) for k in y]
        assert counts == tuple(pairs.count(p) for p in ((True, True), (True, False), (False, True), (False, False)))


def test_des_summary_joins_the_query_rows_with_their_neighbours_once(spark, monkeypatch):
    from retainlab.plans import q_neighbours as Q

    from .conftest import SMALL

    joins, join = [], Q.N.knn_join

    def counted(queries, refs, k, **more):
        joins.append((k, more.get("vec", "embedding"), more.get("exclude_self", False)))
        return join(queries, refs, k, **more)

    monkeypatch.setattr(Q.N, "knn_join", counted)
    assert Q.q_des_summary(spark, SMALL).count() == 3
    assert len(joins) == len(set(joins)) == 4
