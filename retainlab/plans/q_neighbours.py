"""Neighbour and dynamic-selection queries (N1-N7, M11) on the vectors
fixture: query rows are the test side, reference rows the selection side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainlab.operators import evaluate as E
from retainlab.operators import neighbours as N
from retainlab.plans.q_evaluate import metric_sql
from retainlab.plans.registry import query
from retainlab.sources.fixtures import VECTOR_SCORERS, vector_scores, vectors

K_DES = 7
K_PROFILE = 5
K_VOTE = 15

DIST = ("sqrt(list_reduce(list_transform(range(1, len(q.embedding) + 1), lambda i: "
        "(CAST(q.embedding[i] AS DOUBLE) - CAST(r.embedding[i] AS DOUBLE)) * "
        "(CAST(q.embedding[i] AS DOUBLE) - CAST(r.embedding[i] AS DOUBLE))), lambda a, b: a + b))")


def nb_sql(k: int) -> str:
    return f"""
    , q AS (SELECT * FROM vectors WHERE role = 'query'), r AS (SELECT * FROM vectors WHERE role = 'reference'),
    d AS (SELECT q.vec_id AS qid, r.vec_id AS rid, {DIST} AS dist FROM q, r),
    nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rank FROM d) t
           WHERE rank <= {k})
    """


VS_SQL = ", vs AS (" + " UNION ALL ".join(
    f"SELECT vec_id, role, y_true, '{m}' AS model, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + "
    f"2.0::DOUBLE * CAST(embedding[{j + 1}] AS DOUBLE))) AS score FROM vectors"
    for m, j in VECTOR_SCORERS.items()
) + ")"
COMP_SQL = nb_sql(K_DES) + VS_SQL + f"""
, comp AS (SELECT nb.qid, vs.model,
                  CAST(sum(CAST((CASE WHEN vs.score >= 0.5 THEN 1 ELSE 0 END) = vs.y_true AS INTEGER)) AS INTEGER) AS hits,
                  CAST(coalesce(min(CASE WHEN (CASE WHEN vs.score >= 0.5 THEN 1 ELSE 0 END) <> vs.y_true THEN nb.rank END) - 1,
                                {K_DES}) AS INTEGER) AS prefix
           FROM nb JOIN vs ON vs.vec_id = nb.rid AND vs.role = 'reference' GROUP BY nb.qid, vs.model),
qs AS (SELECT * FROM vs WHERE role = 'query')
"""
KE_SQL = COMP_SQL + """
, mx AS (SELECT qid, max(prefix) AS mp FROM comp GROUP BY qid),
ke AS (SELECT c.qid, list_reduce(list(qs.score ORDER BY c.model), lambda a, b: a + b) / count(*) AS score,
              count(*) AS n_selected
       FROM comp c JOIN mx USING (qid) JOIN qs ON qs.vec_id = c.qid AND qs.model = c.model
       WHERE mx.mp = 0 OR c.prefix = mx.mp GROUP BY c.qid)
"""
KU_SQL = """
, ku AS (SELECT c.qid, CASE WHEN sum(c.hits) > 0
                  THEN list_reduce(list(c.hits * qs.score ORDER BY c.model), lambda a, b: a + b) / sum(c.hits)
                  ELSE list_reduce(list(qs.score ORDER BY c.model), lambda a, b: a + b) / count(*) END AS score
         FROM comp c JOIN qs ON qs.vec_id = c.qid AND qs.model = c.model GROUP BY c.qid)
"""


def _vec(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v.filter(F.col("role") == "query"), v.filter(F.col("role") == "reference"), v


def _competence(spark, sf_dir, nb=None):
    q, r, v = _vec(spark, sf_dir)
    nb = N.knn_join(q, r, K_DES) if nb is None else nb
    vs = vector_scores(v)
    comp = N.local_competence(nb, vs.filter(F.col("role") == "reference"), K_DES)
    return comp, vs.filter(F.col("role") == "query"), q


@query("knn_join", nb_sql(K_DES) + """
SELECT qid AS vec_id, rid AS neighbour_id, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS distance FROM nb
""")
def q_knn_join(spark, sf_dir):
    q, r, _ = _vec(spark, sf_dir)
    nb = N.knn_join(q, r, K_DES)
    return nb.select(F.col("qid").alias("vec_id"), F.col("rid").alias("neighbour_id"), "rank",
                     F.round("dist", 6).alias("distance"))


@query("knn_vote", nb_sql(K_VOTE) + """
, j AS (SELECT nb.qid, nb.dist, r.y_true AS ny FROM nb JOIN vectors r ON r.vec_id = nb.rid),
g AS (SELECT qid, count_if(dist = 0) AS z, sum(CASE WHEN dist = 0 THEN ny END) AS zy,
             sum(1.0 / dist) AS w, sum(ny / dist) AS wy FROM j GROUP BY qid)
SELECT qid AS vec_id, round(CASE WHEN z > 0 THEN CAST(zy AS DOUBLE) / z ELSE wy / w END, 6) AS score,
       CAST(CASE WHEN z > 0 THEN CAST(zy AS DOUBLE) / z ELSE wy / w END >= 0.5 AS INTEGER) AS pred
FROM g
""")
def q_knn_vote(spark, sf_dir):
    q, r, v = _vec(spark, sf_dir)
    s = N.knn_vote(N.knn_join(q, r, K_VOTE), r)
    return s.select("vec_id", F.round("score", 6).alias("score"), (F.col("score") >= 0.5).cast("int").alias("pred"))


@query("local_accuracy", COMP_SQL + " SELECT qid AS vec_id, model, hits, prefix FROM comp")
def q_local_accuracy(spark, sf_dir):
    comp, _, _ = _competence(spark, sf_dir)
    return comp.withColumnRenamed("qid", "vec_id")


@query("knora_e", KE_SQL + """
SELECT qid AS vec_id, round(score, 6) AS score, CAST(score >= 0.5 AS INTEGER) AS pred, n_selected FROM ke
""")
def q_knora_e(spark, sf_dir):
    comp, qs, _ = _competence(spark, sf_dir)
    s = N.knora_e(comp, qs)
    return s.select(F.col("qid").alias("vec_id"), F.round("score", 6).alias("score"),
                    (F.col("score") >= 0.5).cast("int").alias("pred"), "n_selected")


@query("knora_u", COMP_SQL + KU_SQL + """
SELECT qid AS vec_id, round(score, 6) AS score, CAST(score >= 0.5 AS INTEGER) AS pred FROM ku
""")
def q_knora_u(spark, sf_dir):
    comp, qs, _ = _competence(spark, sf_dir)
    s = N.knora_u(comp, qs)
    return s.select(F.col("qid").alias("vec_id"), F.round("score", 6).alias("score"),
                    (F.col("score") >= 0.5).cast("int").alias("pred"))


def _summary_sql(cte: str, name: str) -> str:
    return f"""
    SELECT '{name}' AS method, round({metric_sql('f1')}, 6) AS f1, round({metric_sql('recall')}, 6) AS recall,
           round({metric_sql('precision')}, 6) AS precision, round({metric_sql('accuracy')}, 6) AS accuracy,
           (SELECT round(CAST(2 * count_if(p.score > n.score) + count_if(p.score = n.score) AS DOUBLE)
                         / (CAST(tp + fn AS DOUBLE) * CAST(fp + tn AS DOUBLE) * 2.0), 6)
            FROM {cte}y p, {cte}y n WHERE p.y_true = 1 AND n.y_true = 0) AS roc_auc
    FROM (SELECT count_if(y_true = 1 AND score >= 0.5) AS tp, count_if(y_true = 0 AND score >= 0.5) AS fp,
                 count_if(y_true = 1 AND score < 0.5) AS fn, count_if(y_true = 0 AND score < 0.5) AS tn FROM {cte}y) c
    """


MD_CTES = f"""
rs AS (SELECT vec_id AS rid, model, CAST((CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) = y_true AS DOUBLE) AS ok,
              CASE WHEN y_true = 1 THEN score ELSE 1.0::DOUBLE - score END AS pt FROM vs WHERE role = 'reference'),
prof AS (SELECT vec_id, role, list(score ORDER BY model) AS embedding FROM vs GROUP BY vec_id, role),
fn AS (SELECT * FROM (SELECT q.vec_id AS qid, r.vec_id AS rid, row_number() OVER (PARTITION BY q.vec_id ORDER BY {DIST}, r.vec_id) AS rank
                      FROM vectors q, vectors r WHERE r.role = 'reference' AND q.vec_id <> r.vec_id) t WHERE rank <= {K_DES}),
pn AS (SELECT * FROM (SELECT q.vec_id AS qid, r.vec_id AS rid, row_number() OVER (PARTITION BY q.vec_id ORDER BY {DIST}, r.vec_id) AS rank
                      FROM prof q, prof r WHERE r.role = 'reference' AND q.vec_id <> r.vec_id) t WHERE rank <= {K_PROFILE}),
fa AS (SELECT qid, model, list(ok ORDER BY rank) AS oks, list(pt ORDER BY rank) AS pts, avg(ok) AS acc FROM fn JOIN rs USING (rid) GROUP BY qid, model),
pa AS (SELECT qid, model, list(ok ORDER BY rank) AS oks FROM pn JOIN rs USING (rid) GROUP BY qid, model),
mf AS (SELECT fa.qid, fa.model, vs.role, vs.score, vs.y_true,
              list_concat(list_concat(list_concat(list_concat(fa.oks, fa.pts), [fa.acc]), pa.oks), [abs(vs.score * 2 - 1)]) AS x
       FROM fa JOIN pa ON fa.qid = pa.qid AND fa.model = pa.model JOIN vs ON vs.vec_id = fa.qid AND vs.model = fa.model),
dis AS (SELECT vec_id FROM vs GROUP BY vec_id HAVING count(DISTINCT score >= 0.5) > 1),
tr AS (SELECT CAST((CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) = y_true AS INTEGER) AS c, unnest(x) AS v, generate_subscripts(x, 1) AS i
       FROM mf WHERE role = 'reference' AND qid IN (SELECT vec_id FROM dis)),
st AS (SELECT c, i, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM tr GROUP BY c, i),
gb AS (SELECT c, i, m, greatest(s + 1e-9::DOUBLE * (SELECT max(s) FROM st), 1e-12::DOUBLE) AS s,
              ln(CAST(n AS DOUBLE) / (SELECT sum(n) FROM st WHERE i = 1)) AS prior FROM st),
te AS (SELECT qid, model, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM mf WHERE role = 'query'),
ll AS (SELECT te.qid, te.model, gb.c, max(prior) + sum(-0.5::DOUBLE * (ln(2 * pi() * gb.s) + (v - m) * (v - m) / gb.s)) AS l
       FROM te JOIN gb USING (i) GROUP BY te.qid, te.model, gb.c),
ju AS (SELECT qid, model, max(CASE WHEN c = 1 THEN l ELSE '-inf'::DOUBLE END) >= max(CASE WHEN c = 0 THEN l ELSE '-inf'::DOUBLE END) AS good
       FROM ll GROUP BY qid, model),
an AS (SELECT qid, bool_or(good) AS some_good FROM ju GROUP BY qid),
md AS (SELECT ju.qid, list_reduce(list(vs.score ORDER BY ju.model), lambda a, b: a + b) / count(*) AS score, count(*) AS n_selected
       FROM ju JOIN an USING (qid) JOIN vs ON vs.vec_id = ju.qid AND vs.model = ju.model WHERE good OR NOT some_good GROUP BY ju.qid)
"""


def _meta_des(spark, sf_dir, nb=None):
    """META-DES over the pool: meta features of every reference row on which the
    pool disagrees (neighbours without the row itself) train the selector, those
    of the query rows choose models. ``nb``: the query rows' neighbours, if at hand."""
    q, r, v = _vec(spark, sf_dir)
    vs = vector_scores(v)
    rs, qs = vs.filter(F.col("role") == "reference"), vs.filter(F.col("role") == "query")
    rp, qp = N.output_profiles(rs), N.output_profiles(qs)
    train = N.meta_features(N.knn_join(r, r, K_DES, exclude_self=True),
                            N.knn_join(rp, rp, K_PROFILE, vec="profile", exclude_self=True), rs, rs)
    selector = N.fit_selector(train.join(N.disagreed(rs), "qid", "left_semi"))
    nb = N.knn_join(q, r, K_DES) if nb is None else nb
    return N.meta_des(selector, N.meta_features(nb, N.knn_join(qp, rp, K_PROFILE, vec="profile"), rs, qs))


@query("des_summary", KE_SQL + KU_SQL + "," + MD_CTES + """
, key AS (SELECT ke.score, q.y_true FROM ke JOIN q ON q.vec_id = ke.qid),
kuy AS (SELECT ku.score, q.y_true FROM ku JOIN q ON q.vec_id = ku.qid),
mdy AS (SELECT md.score, q.y_true FROM md JOIN q ON q.vec_id = md.qid)
""" + " UNION ALL ".join(_summary_sql(*n) for n in (("ke", "knora_e"), ("ku", "knora_u"), ("md", "meta_des"))))
def q_des_summary(spark, sf_dir):
    q, r, _ = _vec(spark, sf_dir)
    nb = N.knn_join(q, r, K_DES).checkpoint()  # k rows a query, which all three methods read
    comp, qs, _ = _competence(spark, sf_dir, nb)
    labels = q.select(F.col("vec_id").alias("qid"), "y_true")
    found = {"knora_e": N.knora_e(comp, qs), "knora_u": N.knora_u(comp, qs), "meta_des": _meta_des(spark, sf_dir, nb)}
    s = reduce(DataFrame.unionByName, [p.select("qid", "score").withColumn("model", F.lit(n)) for n, p in found.items()])
    s = s.join(labels, "qid").checkpoint()  # a row per query and method: both kinds of metrics read it
    m = E.with_metrics(E.confusion(s), ("f1", "recall", "precision", "accuracy")).drop("tp", "fp", "fn", "tn")
    return m.join(E.roc_auc(s), "model").withColumnRenamed("model", "method")


@query("meta_des", VS_SQL + "," + MD_CTES + """
SELECT qid AS vec_id, round(score, 6) AS score, CAST(score >= 0.5 AS INTEGER) AS pred, n_selected FROM md
""")
def q_meta_des(spark, sf_dir):
    return _meta_des(spark, sf_dir).select(F.col("qid").alias("vec_id"), F.round("score", 6).alias("score"),
                                           (F.col("score") >= 0.5).cast("int").alias("pred"), "n_selected")
