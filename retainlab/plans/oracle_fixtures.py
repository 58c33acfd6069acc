"""The fixtures of ``retainlab.sources.fixtures`` written as DuckDB CTEs.

Every oracle statement is ``WITH <these CTEs> <body>``; DuckDB only plans
the CTEs a body references.
"""

from __future__ import annotations

_SCORERS = {
    "m1": ("risk_pts", None),
    "m2": ("risk_pts", (32452843, 301)),
    "m3": ("risk_pts", (104729, 801)),
    "m4": ("1000 - 12 * tenure", (1299709, 201)),
    "m5": (
        "CASE Contract WHEN 'Month-to-month' THEN 850 WHEN 'One year' THEN 400 ELSE 150 END",
        (15485863, 301),
    ),
    "m6": ("500", None),
}


def _scorer_sql(name: str) -> str:
    base, noise = _SCORERS[name]
    if noise:
        mult, mod = noise
        base = f"({base}) + (k * {mult}) % {mod} - {(mod - 1) // 2}"
    return f"CAST(least(1000, greatest(0, {base})) AS INTEGER)"


_SCORES_UNION = "\n    UNION ALL ".join(
    f"SELECT customerID, k, '{m}' AS model, split, y_true, {_scorer_sql(m)} AS pts FROM ps"
    for m in _SCORERS
)

FIXTURE_CTES = f"""
ord AS (
  SELECT o_custkey,
         min(o_orderdate) AS first_o, max(o_orderdate) AS last_o,
         count_if(o_orderpriority = '1-URGENT') AS c1,
         count_if(o_orderpriority = '2-HIGH') AS c2,
         count_if(o_orderpriority = '3-MEDIUM') AS c3,
         count_if(o_orderpriority = '4-NOT SPECIFIED') AS c4,
         count_if(o_orderpriority = '5-LOW') AS c5,
         count_if(o_orderstatus = 'F') AS c6
  FROM orders GROUP BY o_custkey
),
base AS (
  SELECT c.c_custkey AS k, c.c_nationkey AS n, c.c_name AS customerID, c.c_mktsegment AS seg,
         abs(CAST(round(c.c_acctbal * 100) AS BIGINT)) AS cents,
         CAST(date_diff('day', CAST(o.first_o AS DATE), CAST(o.last_o AS DATE)) % 73 AS INTEGER) AS tenure,
         c1 % 2 AS p1, c2 % 2 AS p2, c3 % 2 AS p3, c4 % 2 AS p4, c5 % 2 AS p5, c6 % 2 AS p6
  FROM customer c JOIN ord o ON c.c_custkey = o.o_custkey
),
b2 AS (
  SELECT *,
    CASE n % 3 WHEN 0 THEN 'DSL' WHEN 1 THEN 'Fiber optic' ELSE 'No' END AS InternetService,
    CASE WHEN seg IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'Month-to-month'
         WHEN seg = 'HOUSEHOLD' THEN 'One year' WHEN seg = 'MACHINERY' THEN 'Two year' END AS Contract,
    CASE k % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check'
         WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS PaymentMethod,
    1825 + cents % 10051 AS m_cents
  FROM base
),
b3 AS (
  SELECT *,
    CAST(floor((m_cents * tenure * (90 + 2 * (n % 11)) + 50) / 100) AS BIGINT) AS tc,
    CAST((CASE Contract WHEN 'Month-to-month' THEN 300 WHEN 'One year' THEN 60 ELSE 0 END)
       + (CASE InternetService WHEN 'Fiber optic' THEN 180 WHEN 'DSL' THEN 60 ELSE 0 END)
       + (CASE WHEN PaymentMethod = 'Electronic check' THEN 140 ELSE 0 END)
       + (72 - tenure) * 4 AS BIGINT) AS risk_pts
  FROM b2
),
pk AS (
  SELECT k, customerID,
    CASE WHEN k % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
    CAST(CASE WHEN n % 6 = 0 THEN 1 ELSE 0 END AS INTEGER) AS SeniorCitizen,
    CASE WHEN k % 8 >= 4 THEN 'Yes' ELSE 'No' END AS Partner,
    CASE WHEN k % 3 = 0 THEN 'Yes' ELSE 'No' END AS Dependents,
    tenure,
    CASE WHEN k % 10 <> 0 THEN 'Yes' ELSE 'No' END AS PhoneService,
    CASE WHEN k % 10 = 0 THEN 'No phone service' WHEN k % 2 = 1 THEN 'Yes' ELSE 'No' END AS MultipleLines,
    InternetService,
    CASE WHEN InternetService = 'No' THEN 'No internet service' WHEN p1 = 1 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
    CASE WHEN InternetService = 'No' THEN 'No internet service' WHEN p2 = 1 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
    CASE WHEN InternetService = 'No' THEN 'No internet service' WHEN p3 = 1 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
    CASE WHEN InternetService = 'No' THEN 'No internet service' WHEN p4 = 1 THEN 'Yes' ELSE 'No' END AS TechSupport,
    CASE WHEN InternetService = 'No' THEN 'No internet service' WHEN p5 = 1 THEN 'Yes' ELSE 'No' END AS StreamingTV,
    CASE WHEN InternetService = 'No' THEN 'No internet service' WHEN p6 = 1 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
    Contract,
    CASE WHEN k % 5 < 3 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
    PaymentMethod,
    CAST(m_cents AS DOUBLE) / 100.0 AS MonthlyCharges,
    CASE WHEN tenure = 0 THEN ' '
         ELSE CAST(tc // 100 AS VARCHAR) || '.' || lpad(CAST(tc % 100 AS VARCHAR), 2, '0') END AS TotalCharges,
    CASE WHEN risk_pts + (k * 7919) % 401 >= 780 THEN 'Yes' ELSE 'No' END AS Churn,
    risk_pts, m_cents
  FROM b3
),
profile AS (
  SELECT customerID, gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService, MultipleLines,
         InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV,
         StreamingMovies, Contract, PaperlessBilling, PaymentMethod, MonthlyCharges, TotalCharges, Churn
  FROM pk
),
ps AS (
  SELECT *,
    CASE WHEN h < 0.7 THEN 'train' WHEN h < 0.7 + 0.1 THEN 'val' ELSE 'test' END AS split,
    CAST(CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS INTEGER) AS y_true
  FROM (SELECT *, CAST(('0x' || substr(md5(CAST(k AS VARCHAR) || '|42'), 1, 8)) AS BIGINT) / 4294967296.0 AS h
        FROM pk) t
),
sl AS (
    {_SCORES_UNION}
),
scores_long AS (
  SELECT customerID, k, model, split, y_true, pts, CAST(pts AS DOUBLE) / 1000.0 AS score FROM sl
),
dirty AS (
  SELECT k, customerID, gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService, MultipleLines,
         InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV,
         StreamingMovies, Contract, PaperlessBilling, PaymentMethod, MonthlyCharges, TotalCharges, Churn
  FROM pk
  UNION ALL
  SELECT k, customerID || '-dup', gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService, MultipleLines,
         InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV,
         StreamingMovies, Contract, PaperlessBilling, PaymentMethod, MonthlyCharges, TotalCharges, Churn
  FROM pk WHERE k % 100 = 1
  UNION ALL
  SELECT k, customerID || '-maybe', gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService, MultipleLines,
         InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV,
         StreamingMovies, Contract, PaperlessBilling, PaymentMethod, MonthlyCharges, TotalCharges, 'Maybe'
  FROM pk WHERE k % 150 = 2
  UNION ALL
  SELECT k, customerID || '-nopay', gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService, MultipleLines,
         InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV,
         StreamingMovies, Contract, PaperlessBilling, NULL, MonthlyCharges, TotalCharges, Churn
  FROM pk WHERE k % 70 = 3
  UNION ALL
  SELECT k, customerID || '-nosec', gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService, MultipleLines,
         InternetService, NULL, OnlineBackup, DeviceProtection, TechSupport, StreamingTV,
         StreamingMovies, Contract, PaperlessBilling, PaymentMethod, MonthlyCharges, TotalCharges, Churn
  FROM pk WHERE k % 80 = 4
),
portfolio AS (
  SELECT ps.customerID, ps.k, ps.split, gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService,
         MultipleLines, InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport,
         StreamingTV, StreamingMovies, Contract, PaperlessBilling, PaymentMethod, MonthlyCharges,
         TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges, Churn,
         s.score AS churn_probability,
         CASE WHEN s.score <= 0.3 THEN 'low' WHEN s.score <= 0.6 THEN 'medium' ELSE 'high' END AS risk_tier,
         CAST(CASE WHEN s.score >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS predicted_churn,
         CAST(CASE Contract WHEN 'Month-to-month' THEN 6 WHEN 'One year' THEN 18 WHEN 'Two year' THEN 30
              ELSE 12 END AS INTEGER) AS lifetime_months
  FROM ps JOIN scores_long s ON s.k = ps.k AND s.model = 'm1'
  WHERE TRY_CAST(trim(TotalCharges) AS DOUBLE) IS NOT NULL
),
pf AS (
  SELECT *, churn_probability * MonthlyCharges * lifetime_months AS revenue_at_risk,
         MonthlyCharges * 12 AS annual_revenue
  FROM portfolio
),
vectors AS (
  SELECT vec_id, embedding, CASE WHEN vec_id % 10 = 0 THEN 'query' ELSE 'reference' END AS role,
         CAST(CASE WHEN label >= 5 THEN 1 ELSE 0 END AS INTEGER) AS y_true
  FROM embeddings
)
"""


def _bigint_counts(sql: str) -> str:
    """DuckDB types count_if as HUGEINT; the FILTER form is BIGINT like Spark."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(f"count(*) FILTER (WHERE {_bigint_counts(sql[j + len(key):k - 1])})")
        i = k


def with_fixtures(body: str) -> str:
    """Prefix the fixture CTEs; a body starting with ',' adds its own CTEs."""
    body = body.strip()
    sep = "" if body.startswith(",") else "\n"
    head = "WITH RECURSIVE" if "/*recursive*/" in body else "WITH"
    return _bigint_counts(f"{head} {FIXTURE_CTES.strip()}{sep}{body}")
