"""Portfolio analytics on the scored customer table.

Every function takes the ``portfolio`` DataFrame (one row per scored
customer) and plain parameters and returns a DataFrame, so a batch of
requests is a table too. Nothing is collected to the driver; top-k outputs
are either ``orderBy().limit()`` (TakeOrderedAndProject, k is the feature)
or a K1 rank filter when k grows with the data (budgets).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retainlab import config as C
from retainlab.functions import rules as R
from retainlab.functions.features import engineer_features
from retainlab.operators.blocks import exact_quantiles, numpy_bin, numpy_edge, prefix_sums

ID = C.ID_COL


# ---------------------------------------------------------------- B1 scoring
def build_portfolio(
    keyed_profile: DataFrame,
    scores: DataFrame | None = None,
    threshold: float = C.DEFAULT_THRESHOLD,
) -> DataFrame:
    """Scored portfolio: coerced charges, rows without charges dropped (S3, S6),
    probability, tier, predicted flag and lifetime months.

    ``scores`` has (k, score); the join is an equi-join on the customer key
    (sort-merge or AQE broadcast, decided on runtime sizes). Without
    ``scores`` the profile must already carry a ``score`` column (a scorer
    evaluated as an expression, no join at all).
    """
    p = keyed_profile.withColumn(
        "TotalCharges", F.expr("try_cast(trim(TotalCharges) AS DOUBLE)")
    ).na.drop(subset=["TotalCharges"])
    if scores is None:
        out = p.withColumnRenamed("score", "churn_probability")
    else:
        s = scores.select("k", F.col("score").alias("churn_probability"))
        out = p.join(s, "k", "inner")
    prob = F.col("churn_probability")
    return out.withColumns(
        {
            "risk_tier": R.risk_tier(prob),
            "predicted_churn": (prob >= F.lit(threshold)).cast("int"),
            "lifetime_months": R.lifetime_months(F.col("Contract")),
        }
    )


def with_revenue(pf: DataFrame) -> DataFrame:
    return pf.withColumns(
        {
            "revenue_at_risk": R.revenue_at_risk(
                F.col("churn_probability"), F.col("MonthlyCharges"), F.col("lifetime_months")
            ),
            "annual_revenue": F.col("MonthlyCharges") * 12,
        }
    )


# ----------------------------------------------------------- B2, B3 per row
def risk_levels(pf: DataFrame) -> DataFrame:
    p = F.col("churn_probability")
    return pf.select(ID, R.risk_level(p).alias("risk_level"), R.recommendation(p).alias("recommendation"))


def score_requests(
    requests: DataFrame,
    default_threshold: float = C.DEFAULT_THRESHOLD,
    cost_fn: float = C.COST_FN,
    cost_fp: float = C.COST_FP,
) -> DataFrame:
    """Batch form of the single prediction: per-row threshold override."""
    p = F.col("churn_probability")
    t = F.coalesce(F.col("threshold"), F.lit(default_threshold))
    flagged = p >= t
    return requests.select(
        ID,
        F.round(p, 4).alias("churn_probability"),
        flagged.alias("churn_prediction"),
        R.risk_level(p).alias("risk_level"),
        F.round(t, 4).alias("threshold_used"),
        R.recommendation(p).alias("recommended_action"),
        F.when(flagged, F.lit(cost_fp)).otherwise(F.round(p * cost_fn, 2)).alias("expected_cost"),
    )


# ------------------------------------------------------------ B4 attribution
def top_factors(
    features: DataFrame, weights: dict[str, float], means: DataFrame, n: int = 8
) -> DataFrame:
    """Linear attribution w_j (x_j - mean_j); top n per row by |value|.

    ``means`` is a one-row table of column means (a global aggregate).
    """
    names = list(weights)
    mcols = means.select(*[F.col(c).alias(f"_mean_{c}") for c in names])
    x = features.crossJoin(F.broadcast(mcols))  # one row, bounded
    contrib = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                (F.lit(weights[c]) * (F.col(c).cast("double") - F.col(f"_mean_{c}"))).alias("value"),
            )
            for c in names
        ]
    )
    # rank inside each row's own array (one sort per row, no shuffle)
    ranked = F.sort_array(F.transform(contrib, lambda c: F.struct(
        (-F.abs(c["value"])).alias("k"), c["feature"].alias("feature"), c["value"].alias("value"))))
    top = x.select(ID, F.posexplode(F.slice(ranked, 1, n)).alias("pos", "s"))
    return top.select(
        ID,
        (F.col("pos") + 1).cast("bigint").alias("rank"),
        F.col("s.feature").alias("feature"),
        F.round("s.value", 6).alias("contribution"),
        F.when(F.col("s.value") > 0, "increases churn").otherwise("decreases churn").alias("direction"),
    )


# -------------------------------------------------------------- B5-B7 summary
def portfolio_summary(pf: DataFrame, cost_fn: float = C.COST_FN) -> DataFrame:
    y = F.col("Churn")
    return pf.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(y == "Yes").alias("actual_churn_count"),
        F.round(F.try_divide(F.count_if(y == "Yes"), F.count(F.lit(1))), 4).alias("actual_churn_rate"),
        F.sum("predicted_churn").cast("bigint").alias("predicted_churn_count"),
        F.round(F.avg("churn_probability"), 4).alias("avg_probability"),
        F.round(F.sum("churn_probability") * cost_fn, 2).alias("total_expected_cost"),
    )


def tier_breakdown(pf: DataFrame) -> DataFrame:
    """Rows and mean monthly charge per tier, and contract counts per tier,
    in one scan (GROUPING SETS)."""
    return pf.sparkSession.sql(
        """
        SELECT risk_tier, Contract, count(*) AS n,
               round(avg(MonthlyCharges), 2) AS avg_monthly_charges
        FROM {pf}
        GROUP BY GROUPING SETS ((risk_tier), (risk_tier, Contract))
        """,
        pf=pf,
    )


def probability_histogram(pf: DataFrame, bins: int = 20) -> DataFrame:
    """numpy histogram on range (0, 1): values outside are ignored, last bin
    closed, empty bins reported (right join to the fixed bin table)."""
    spark = pf.sparkSession
    p = F.col("churn_probability")
    zero, one = F.lit(0.0), F.lit(1.0)
    counts = pf.filter((p >= 0) & (p <= 1)).groupBy(numpy_bin(p, zero, one, bins).alias("bin"))
    counts = counts.agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = F.broadcast(grid).join(counts, "bin", "left")
    return out.select(
        "bin",
        F.round(numpy_edge(F.col("bin"), zero, one, bins), 2).alias("lo"),
        F.round(numpy_edge(F.col("bin") + 1, zero, one, bins), 2).alias("hi"),
        F.coalesce(F.col("n"), F.lit(0)).alias("count"),
    )


# ------------------------------------------------------------------ B8 paging
PAGE_COLUMNS = (
    ID,
    "gender",
    "tenure",
    "Contract",
    "MonthlyCharges",
    "TotalCharges",
    "InternetService",
    "churn_probability",
    "risk_tier",
    "predicted_churn",
    "Churn",
)


def customer_page(
    pf: DataFrame,
    page: int = 1,
    per_page: int = 20,
    tier: str | None = None,
    sort_by: str = "churn_probability",
    sort_desc: bool = True,
    after: tuple | None = None,
) -> DataFrame:
    """One page plus total and total_pages; ties broken by id. Shallow pages
    use offset + limit (one TakeOrderedAndProject); deep pages should pass
    ``after`` = (sort value, id) of the previous page's last row (key-set
    paging), so no task keeps offset + limit rows."""
    df = pf
    if tier in C.TIERS:
        df = df.filter(F.col("risk_tier") == tier)
    order: list[Column] = []
    if sort_by in df.columns:
        order.append(F.col(sort_by).desc() if sort_desc else F.col(sort_by).asc())
    order.append(F.col(ID).asc())
    total = df.agg(F.count(F.lit(1)).alias("total"))
    if after is not None and sort_by in df.columns:
        # key-set paging: rows strictly after the last (value, id) of the previous page
        v, last_id = after
        c = F.col(sort_by)
        beyond = (c < F.lit(v)) if sort_desc else (c > F.lit(v))
        rows = df.filter(beyond | ((c == F.lit(v)) & (F.col(ID) > F.lit(last_id)))).orderBy(*order).limit(per_page)
    else:
        rows = df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    rows = rows.select(
        *[F.round(c, 4).alias(c) if c == "churn_probability" else F.col(c) for c in PAGE_COLUMNS]
    )
    out = rows.crossJoin(F.broadcast(total))  # one-row total
    return out.select(
        *PAGE_COLUMNS,
        "total",
        F.lit(page).alias("page"),
        F.lit(per_page).alias("per_page"),
        ((F.col("total") + per_page - 1) / per_page).cast("bigint").alias("total_pages"),
    )


# ---------------------------------------------------------------- B9 what-if
def scenario_delta(
    pf: DataFrame,
    scenarios: DataFrame,
    score_fn,
) -> DataFrame:
    """Customers x scenario overrides (a small fixed table, broadcast):
    re-derive features, score both versions, delta and level.

    ``scenarios`` has ``scenario`` plus nullable override columns named like
    the profile columns; ``score_fn`` maps a feature DataFrame to a score column.
    """
    over = [c for c in scenarios.columns if c != "scenario"]
    s = scenarios.select("scenario", *[F.col(c).alias(f"_new_{c}") for c in over])
    x = pf.crossJoin(F.broadcast(s))  # a fixed, small scenario table
    # both versions are scored in the same row: no self-join
    x = engineer_features(x)
    x = x.withColumn("p_orig", score_fn(x))
    x = x.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in over})
    x = engineer_features(x)
    j = x.withColumn("p_mod", score_fn(x))
    return j.select(
        ID,
        "scenario",
        F.round("p_orig", 4).alias("p_original"),
        F.round("p_mod", 4).alias("p_modified"),
        R.risk_level(F.col("p_orig")).alias("level_original"),
        R.risk_level(F.col("p_mod")).alias("level_modified"),
        F.round(F.col("p_mod") - F.col("p_orig"), 4).alias("delta"),
        R.recommendation(F.col("p_mod")).alias("recommendation"),
    )


# ------------------------------------------------------------ B10-B14 campaign
def campaign_eligible(pf: DataFrame, offer_cost: float = 50.0, min_probability: float = 0.0,
                      cost_fn: float = C.COST_FN) -> DataFrame:
    """Rows whose expected saving is above zero."""
    p = F.col("churn_probability")
    el = pf.filter(p >= F.lit(min_probability)).withColumn(
        "expected_savings", p * F.lit(cost_fn) - F.lit(offer_cost)
    )
    return el.filter(F.col("expected_savings") > 0)


def campaign_ranked(pf: DataFrame, offer_cost: float = 50.0, min_probability: float = 0.0,
                    cost_fn: float = C.COST_FN) -> DataFrame:
    """Eligible rows, K1 rank by saving desc then id, with the running sum of
    probabilities."""
    el = campaign_eligible(pf, offer_cost, min_probability, cost_fn)
    return prefix_sums(el, [-F.col("expected_savings"), F.col(ID)], {"p": F.col("churn_probability")})


def _target_columns(ranked: DataFrame) -> DataFrame:
    return ranked.select(
        "rank",
        ID,
        F.round("churn_probability", 4).alias("churn_probability"),
        "risk_tier",
        "Contract",
        "MonthlyCharges",
        F.round("expected_savings", 2).alias("expected_savings"),
    )


def campaign_targets(pf: DataFrame, budget: float, offer_cost: float = 50.0,
                     min_probability: float = 0.0) -> DataFrame:
    n = int(budget // offer_cost)
    ranked = campaign_ranked(pf, offer_cost, min_probability)
    return _target_columns(ranked.filter(F.col("rank") <= n))


def campaign_top(pf: DataFrame, budget: float, offer_cost: float = 50.0, min_probability: float = 0.0,
                 top: int = 20) -> DataFrame:
    """The first ``top`` targets, by a distributed top-k; the few are then ranked."""
    n = min(top, int(budget // offer_cost))
    order = [F.col("expected_savings").desc(), F.col(ID).asc()]
    few = campaign_eligible(pf, offer_cost, min_probability).orderBy(*order).limit(n)
    return _target_columns(few.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint")))


def campaign_summary(pf: DataFrame, budget: float, offer_cost: float = 50.0,
                     min_probability: float = 0.0, cost_fn: float = C.COST_FN) -> DataFrame:
    n = int(budget // offer_cost)
    ranked = campaign_ranked(pf, offer_cost, min_probability, cost_fn)
    taken = F.col("rank") <= n
    tot = ranked.agg(
        F.count(F.lit(1)).alias("total_eligible"),
        F.count_if(taken).alias("customers_targeted"),
        F.coalesce(F.sum(F.when(taken, F.col("churn_probability"))), F.lit(0.0)).alias("_ret"),
    )
    cost = F.col("customers_targeted") * F.lit(offer_cost)
    net = F.col("_ret") * F.lit(cost_fn) - cost
    return tot.select(
        "total_eligible",
        "customers_targeted",
        F.round(cost, 2).alias("campaign_cost"),
        F.round("_ret", 4).alias("expected_retained"),
        F.round(F.col("_ret") * F.lit(cost_fn), 2).alias("expected_savings"),
        F.round(net, 2).alias("net_roi"),
        F.when(cost > 0, F.round(net / cost * 100, 4)).otherwise(F.lit(0.0)).alias("roi_pct"),
    )


def campaign_breakdown(pf: DataFrame, budget: float, offer_cost: float = 50.0,
                       min_probability: float = 0.0) -> DataFrame:
    n = int(budget // offer_cost)
    tgt = campaign_ranked(pf, offer_cost, min_probability).filter(F.col("rank") <= n)
    return pf.sparkSession.sql(
        """
        SELECT CASE WHEN grouping(risk_tier) = 0 THEN 'risk_tier' ELSE 'Contract' END AS dimension,
               coalesce(risk_tier, Contract) AS value, count(*) AS n
        FROM {tgt}
        GROUP BY GROUPING SETS ((risk_tier), (Contract))
        """,
        tgt=tgt,
    )


def campaign_roi_curve(pf: DataFrame, budget: float, offer_cost: float = 50.0,
                       min_probability: float = 0.0, cost_fn: float = C.COST_FN) -> DataFrame:
    """ROI at 5 %..100 % of the budget from one ranked pass: the prefix sum at
    rank n is the saving of the first n targets (equi-join on rank)."""
    spark = pf.sparkSession
    ranked = campaign_ranked(pf, offer_cost, min_probability, cost_fn)
    levels = [
        (pct, float(budget * pct / 100), int((budget * pct / 100) // offer_cost))
        for pct in range(5, 105, 5)
    ]
    grid = spark.createDataFrame(levels, "budget_pct int, budget double, n_offers long")
    n_el = ranked.agg(
        F.count(F.lit(1)).alias("n_el"), F.coalesce(F.sum("churn_probability"), F.lit(0.0)).alias("p_el")
    )
    g = grid.crossJoin(n_el).withColumn("n_take", F.least(F.col("n_offers"), F.col("n_el")))
    pref = ranked.select(F.col("rank").alias("n_take"), F.col("cum_p"))
    j = g.join(pref, "n_take", "left")  # AQE broadcasts the 20-row side
    saved = F.coalesce(F.col("cum_p"), F.lit(0.0)) * F.lit(cost_fn)
    cost = F.col("n_take") * F.lit(offer_cost)
    return j.select(
        "budget_pct",
        F.round("budget", 2).alias("budget"),
        F.col("n_take").alias("customers_targeted"),
        F.round(saved, 2).alias("expected_savings"),
        F.round(cost, 2).alias("campaign_cost"),
        F.round(saved - cost, 2).alias("net_roi"),
    )


# ---------------------------------------------------------- B15-B19 revenue
def revenue_at_risk(pf: DataFrame) -> DataFrame:
    r = with_revenue(pf)
    return r.agg(
        F.round(F.sum("revenue_at_risk"), 2).alias("total_revenue_at_risk"),
        F.round(F.sum("annual_revenue"), 2).alias("total_annual_revenue"),
        F.when(
            F.sum("annual_revenue") > 0,
            F.round(F.sum("revenue_at_risk") / F.sum("annual_revenue") * 100, 4),
        ).otherwise(F.lit(0.0)).alias("pct_revenue_at_risk"),
    )


def revenue_top(pf: DataFrame, n: int = 50) -> DataFrame:
    """Top n by revenue at risk (TakeOrderedAndProject; n is the feature)."""
    r = with_revenue(pf).orderBy(F.col("revenue_at_risk").desc(), F.col(ID).asc()).limit(n)
    return r.select(
        ID,
        F.round("churn_probability", 4).alias("churn_probability"),
        "risk_tier",
        "Contract",
        "MonthlyCharges",
        F.round("annual_revenue", 2).alias("annual_revenue"),
        "lifetime_months",
        F.round("revenue_at_risk", 2).alias("revenue_at_risk"),
    )


def revenue_top_totals(pf: DataFrame, n: int = 50) -> DataFrame:
    """Revenue at risk and annual revenue of the top n."""
    top = with_revenue(pf).orderBy(F.col("revenue_at_risk").desc(), F.col(ID).asc()).limit(n)
    return top.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("revenue_at_risk"), 2).alias("top_revenue_at_risk"),
        F.round(F.sum("annual_revenue"), 2).alias("top_annual_revenue"),
    )


def revenue_breakdown(pf: DataFrame) -> DataFrame:
    return pf.sparkSession.sql(
        """
        SELECT CASE WHEN grouping(risk_tier) = 0 THEN 'risk_tier' ELSE 'Contract' END AS dimension,
               coalesce(risk_tier, Contract) AS value,
               count(*) AS n,
               round(sum(annual_revenue), 2) AS total_annual_revenue,
               round(sum(revenue_at_risk), 2) AS revenue_at_risk,
               round(avg(churn_probability), 4) AS avg_churn_prob
        FROM {r}
        GROUP BY GROUPING SETS ((risk_tier), (Contract))
        """,
        r=with_revenue(pf),
    )


def revenue_histogram(pf: DataFrame, bins: int = 20) -> DataFrame:
    """numpy histogram of positive revenue at risk between data min and max;
    all-equal data becomes a +-0.5 range. min/max is a one-row aggregate."""
    spark = pf.sparkSession
    r = with_revenue(pf).filter(F.col("revenue_at_risk") > 0)
    mm = r.agg(F.min("revenue_at_risk").alias("lo0"), F.max("revenue_at_risk").alias("hi0"))
    mm = mm.select(
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("first"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("last"),
    )
    first, last = F.col("first"), F.col("last")
    b = r.crossJoin(F.broadcast(mm)).select(numpy_bin(F.col("revenue_at_risk"), first, last, bins).alias("bin"))
    counts = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(mm))
    out = grid.join(counts, "bin", "left")
    return out.select(
        "bin",
        F.round(numpy_edge(F.col("bin"), first, last, bins), 2).alias("lo"),
        F.round(numpy_edge(F.col("bin") + 1, first, last, bins), 2).alias("hi"),
        F.coalesce(F.col("n"), F.lit(0)).alias("count"),
    )


# ---------------------------------------------------------- B20, B21 A/B test
def _strategy_targets(pf: DataFrame, min_probability: float) -> DataFrame:
    at_risk = with_revenue(pf.filter(F.col("churn_probability") >= F.lit(min_probability)))
    return prefix_sums(
        at_risk, [-F.col("revenue_at_risk"), F.col(ID)], {"rar": F.col("revenue_at_risk")}
    )


def _strategy_sizes(pf: DataFrame, strategies: DataFrame, budget: float, min_probability: float) -> DataFrame:
    """How many customers each strategy pays for: the at-risk ones, at most what
    the budget covers."""
    n_at = pf.filter(F.col("churn_probability") >= F.lit(min_probability)).agg(F.count(F.lit(1)).alias("total_at_risk"))
    return strategies.crossJoin(n_at).withColumn(
        "n_take",
        F.least(F.floor(F.lit(float(budget)) / F.col("cost_per_customer")).cast("bigint"),
                F.col("total_at_risk")),
    )


def _strategy_totals(pf: DataFrame, strategies: DataFrame, budget: float,
                     min_probability: float) -> DataFrame:
    s = _strategy_sizes(pf, strategies, budget, min_probability)
    pref = _strategy_targets(pf, min_probability).select(F.col("rank").alias("n_take"), "cum_rar")
    return s.join(pref, "n_take", "left").withColumn(
        "rar_sum", F.coalesce(F.col("cum_rar"), F.lit(0.0))
    )


def strategy_comparison(pf: DataFrame, strategies: DataFrame, budget: float = 50000.0,
                        min_probability: float = 0.3) -> DataFrame:
    """``strategies``: (slot 'A'/'B', name, cost_per_customer, effectiveness).
    The winner is A only if its rounded net ROI is strictly larger."""
    t = _strategy_totals(pf, strategies, budget, min_probability)
    cost = F.col("n_take") * F.col("cost_per_customer")
    saved = F.col("rar_sum") * F.col("effectiveness")
    t = t.select(
        "slot",
        "name",
        "cost_per_customer",
        "effectiveness",
        "total_at_risk",
        F.col("n_take").alias("customers_targeted"),
        F.round(cost, 2).alias("campaign_cost"),
        F.round(F.col("effectiveness") * F.col("n_take"), 4).alias("estimated_retained"),
        F.round(saved, 2).alias("revenue_saved"),
        F.round(saved - cost, 2).alias("net_roi"),
        F.when(cost > 0, F.round((saved - cost) / cost * 100, 4)).otherwise(F.lit(0.0)).alias("roi_pct"),
    )
    # winner over the strategy rows only (a window over two rows)
    w = Window.partitionBy()
    a = F.max(F.when(F.col("slot") == "A", F.col("net_roi"))).over(w)
    b = F.max(F.when(F.col("slot") == "B", F.col("net_roi"))).over(w)
    return t.withColumn("is_winner", F.when(F.col("slot") == "A", a > b).otherwise(~(a > b)))


def strategy_breakdown(pf: DataFrame, strategies: DataFrame, budget: float = 50000.0,
                       min_probability: float = 0.3) -> DataFrame:
    """Targets of each strategy by tier and by contract: the ranked at-risk
    rows joined with each strategy's row limit (a range condition on rank
    against a table of one row per strategy)."""
    ranked = _strategy_targets(pf, min_probability)
    t = _strategy_sizes(pf, strategies, budget, min_probability).select("slot", "n_take")
    tgt = ranked.join(F.broadcast(t), F.col("rank") <= F.col("n_take"))
    return pf.sparkSession.sql(
        """
        SELECT slot, CASE WHEN grouping(risk_tier) = 0 THEN 'risk_tier' ELSE 'Contract' END AS dimension,
               coalesce(risk_tier, Contract) AS value, count(*) AS n
        FROM {tgt}
        GROUP BY GROUPING SETS ((slot, risk_tier), (slot, Contract))
        """,
        tgt=tgt,
    )


def strategy_sensitivity(pf: DataFrame, strategies: DataFrame, budget: float = 50000.0,
                         min_probability: float = 0.3) -> DataFrame:
    """Effectiveness 10..50 % for both strategies; targets are computed once."""
    spark = pf.sparkSession
    t = _strategy_totals(pf, strategies, budget, min_probability)
    grid = spark.range(10, 55, 5).select(F.col("id").cast("int").alias("effectiveness_pct"))
    g = grid.crossJoin(F.broadcast(t.select("slot", "n_take", "rar_sum", "cost_per_customer")))
    roi = F.col("rar_sum") * (F.col("effectiveness_pct") / F.lit(100.0)) - F.col("n_take") * F.col("cost_per_customer")
    g = g.select("effectiveness_pct", "slot", F.round(roi, 2).alias("roi"))
    return g.groupBy("effectiveness_pct").agg(
        F.max(F.when(F.col("slot") == "A", F.col("roi"))).alias("strategy_a_roi"),
        F.max(F.when(F.col("slot") == "B", F.col("roi"))).alias("strategy_b_roi"),
    )


# ------------------------------------------------------ B22-B25 per customer
def _intervention(spec: tuple, cond: Column) -> Column:
    action, category, priority, cost, text = spec
    return F.when(
        cond,
        F.struct(
            F.lit(action).alias("action"),
            F.lit(category).alias("category"),
            F.lit(priority).alias("priority"),
            F.lit(float(cost)).alias("estimated_cost"),
            F.lit(text).alias("description"),
        ),
    )


def interventions(pf: DataFrame) -> DataFrame:
    """Rule-based interventions as array<struct> for every customer."""
    m = F.col("MonthlyCharges")
    disc_text = F.format_string(
        C.INTERVENTION_DISCOUNT_TEXT.replace("{}", "%d"), R.round_half_even_int(m)
    )
    discount = F.when(
        m > F.lit(C.INTERVENTION_DISCOUNT_MIN_CHARGE),
        F.struct(
            F.lit(C.INTERVENTION_DISCOUNT_ACTION).alias("action"),
            F.lit(C.INTERVENTION_DISCOUNT_CATEGORY).alias("category"),
            F.when(F.col("churn_probability") > C.INTERVENTION_DISCOUNT_HIGH_P, "high")
            .otherwise("medium").alias("priority"),
            (m * F.lit(C.INTERVENTION_DISCOUNT_SHARE)).alias("estimated_cost"),
            disc_text.alias("description"),
        ),
    )
    arr = F.array_compact(
        F.array(
            _intervention(C.INTERVENTION_CONTRACT, F.col("Contract").eqNullSafe("Month-to-month")),
            _intervention(C.INTERVENTION_SUPPORT, R.needs_support()),
            _intervention(C.INTERVENTION_SECURITY, R.needs_security()),
            _intervention(C.INTERVENTION_AUTOPAY, F.col("PaymentMethod").eqNullSafe("Electronic check")),
            discount,
        )
    )
    return with_revenue(pf).withColumn("interventions", arr)


def customer_interventions(pf: DataFrame) -> DataFrame:
    x = interventions(pf)
    e = x.select(ID, F.posexplode("interventions").alias("pos", "i"))
    return e.select(
        ID,
        (F.col("pos") + 1).alias("position"),
        F.col("i.action").alias("action"),
        F.col("i.category").alias("category"),
        F.col("i.priority").alias("priority"),
        F.round("i.estimated_cost", 4).alias("estimated_cost"),
        F.col("i.description").alias("description"),
    )


def customer_lookup(pf: DataFrame, requests: DataFrame) -> DataFrame:
    """Batch lookup: left join of requested ids with a found flag."""
    r = with_revenue(pf).select(
        F.col(ID),
        F.round("churn_probability", 4).alias("churn_probability"),
        "risk_tier",
        "predicted_churn",
        "Churn",
        F.round("annual_revenue", 2).alias("annual_revenue"),
        "lifetime_months",
        F.round("revenue_at_risk", 2).alias("revenue_at_risk"),
    )
    j = requests.select(F.col(ID)).join(r, ID, "left")
    return j.withColumn("found", F.col("risk_tier").isNotNull())


def customer_detail(pf: DataFrame, requests: DataFrame) -> DataFrame:
    """The whole record of each requested id: profile, score, revenue and the
    suggested interventions with their cost; unknown ids are marked."""
    x = with_revenue(interventions(pf))
    actions = F.array_join(F.transform("interventions", lambda i: i["action"]), "|")
    cost = F.aggregate("interventions", F.lit(0.0), lambda a, i: a + i["estimated_cost"])
    r = x.select(
        F.col(ID), *C.FEATURE_COLUMNS,
        F.round("churn_probability", 4).alias("churn_probability"),
        "risk_tier",
        (F.col("predicted_churn") == 1).alias("predicted_churn"),
        F.col("Churn").alias("actual_churn"),
        F.round("annual_revenue", 2).alias("annual_revenue"),
        "lifetime_months",
        F.round("revenue_at_risk", 2).alias("revenue_at_risk"),
        actions.alias("interventions"),
        F.round(cost, 4).alias("intervention_cost"),
    )
    j = requests.select(F.col(ID)).join(r, ID, "left").withColumn("found", F.col("risk_tier").isNotNull())
    return j.na.fill({"interventions": "", "intervention_cost": 0.0})


def customer_search(pf: DataFrame, pattern: str, limit: int = 10) -> DataFrame:
    """Case-insensitive regular-expression search, first ``limit`` ids."""
    m = pf.filter(F.col(ID).rlike("(?i)" + pattern))
    top = m.orderBy(F.col(ID).asc()).limit(limit)
    return top.select(
        ID,
        F.round("churn_probability", 4).alias("churn_probability"),
        "risk_tier",
        "MonthlyCharges",
        "Contract",
    )


def watch_list(pf: DataFrame, min_probability: float = 0.6, sort_by: str = "revenue_at_risk",
               limit: int = 50) -> DataFrame:
    r = with_revenue(pf.filter(F.col("churn_probability") >= F.lit(min_probability)))
    total = r.agg(F.count(F.lit(1)).alias("total"))
    order = ([F.col(sort_by).desc()] if sort_by in r.columns else []) + [F.col(ID).asc()]
    top = r.orderBy(*order).limit(limit)
    actions = F.array_compact(
        F.array(
            F.when(F.col("Contract").eqNullSafe("Month-to-month"), F.lit(C.QUICK_ACTIONS[0])),
            F.when(R.needs_support(), F.lit(C.QUICK_ACTIONS[1])),
            F.when(F.col("PaymentMethod").eqNullSafe("Electronic check"), F.lit(C.QUICK_ACTIONS[2])),
        )
    )
    top = top.select(
        ID,
        F.round("churn_probability", 4).alias("churn_probability"),
        "risk_tier",
        "Contract",
        "MonthlyCharges",
        "tenure",
        F.round("revenue_at_risk", 2).alias("revenue_at_risk"),
        F.array_join(actions, "|").alias("quick_actions"),
    )
    return top.crossJoin(F.broadcast(total)).withColumn("threshold", F.lit(float(min_probability)))


# ---------------------------------------------------------- B26, B27 segments
SEGMENT_FILTERS = {
    "contract": ("Contract", "=="),
    "internet_service": ("InternetService", "=="),
    "min_tenure": ("tenure", ">="),
    "max_tenure": ("tenure", "<="),
    "min_monthly": ("MonthlyCharges", ">="),
    "max_monthly": ("MonthlyCharges", "<="),
    "senior_citizen": ("SeniorCitizen", "=="),
    "partner": ("Partner", "=="),
    "tech_support": ("TechSupport", "=="),
    "payment_method": ("PaymentMethod", "=="),
}


def segment_predicate(filters: dict) -> Column:
    cond = F.lit(True)
    for key, value in filters.items():
        if value is None or (isinstance(value, str) and not value):
            continue
        col, op = SEGMENT_FILTERS[key]
        c = F.col(col)
        cond = cond & {"==": c == F.lit(value), ">=": c >= F.lit(value), "<=": c <= F.lit(value)}[op]
    return cond


def segment_analysis(pf: DataFrame, filters: dict) -> DataFrame:
    """One aggregate for the segment plus an exact median through K1 over
    (value, count) groups, so no task holds all values; empty gives size 0."""
    r = with_revenue(pf)
    total = r.agg(F.count(F.lit(1)).alias("_all"))
    seg = r.filter(segment_predicate(filters))
    a = seg.agg(
        F.count(F.lit(1)).alias("segment_size"),
        F.round(F.avg("churn_probability"), 4).alias("avg_churn_probability"),
        F.count_if(F.col("risk_tier") == "high").alias("high_risk_count"),
        F.round(F.avg("MonthlyCharges"), 2).alias("avg_monthly_charges"),
        F.round(F.avg("tenure"), 4).alias("avg_tenure"),
        F.round(F.sum("revenue_at_risk"), 2).alias("total_revenue_at_risk"),
        F.round(F.avg("revenue_at_risk"), 2).alias("avg_revenue_at_risk"),
    )
    med = exact_quantiles(seg.select(F.lit(0).alias("_g"), "churn_probability"), "_g", "churn_probability", 0.5)
    med = med.select(F.round("quantile", 4).alias("median_churn_probability"))
    one = a.crossJoin(total).join(med, how="left")  # all one-row tables
    return one.select(
        "segment_size",
        F.round(F.try_divide(F.col("segment_size"), F.col("_all")) * 100, 4).alias("pct_of_total"),
        "avg_churn_probability",
        "median_churn_probability",
        *[c for c in a.columns if c not in ("segment_size", "avg_churn_probability")],
    )


def segment_profile(pf: DataFrame, filters: dict) -> DataFrame:
    seg = pf.filter(segment_predicate(filters))
    return pf.sparkSession.sql(
        """
        SELECT CASE WHEN grouping(Contract) = 0 THEN 'Contract'
                    WHEN grouping(InternetService) = 0 THEN 'InternetService'
                    WHEN grouping(PaymentMethod) = 0 THEN 'PaymentMethod'
                    WHEN grouping(TechSupport) = 0 THEN 'TechSupport'
                    WHEN grouping(OnlineSecurity) = 0 THEN 'OnlineSecurity'
                    ELSE 'risk_tier' END AS dimension,
               coalesce(Contract, InternetService, PaymentMethod, TechSupport, OnlineSecurity, risk_tier) AS value,
               count(*) AS n
        FROM {seg}
        GROUP BY GROUPING SETS ((Contract), (InternetService), (PaymentMethod), (TechSupport),
                                (OnlineSecurity), (risk_tier))
        """,
        seg=seg,
    )


# ------------------------------------------------------- B28-B30 executive
def executive_summary(pf: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Totals, churn rate, tier counts, revenue and mean probability in one
    aggregate; ``model`` (one row: model_name, model_auc) names the serving
    model and its test ROC-AUC."""
    r = with_revenue(pf)
    out = r.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.round(F.avg(F.when(F.col("Churn") == "Yes", 1.0).when(F.col("Churn") == "No", 0.0)), 4).alias("churn_rate"),
        F.count_if(F.col("risk_tier") == "high").alias("high_risk_count"),
        F.count_if(F.col("risk_tier") == "medium").alias("medium_risk_count"),
        F.round(F.sum("revenue_at_risk"), 2).alias("total_revenue_at_risk"),
        F.round(F.sum("MonthlyCharges") * 12, 2).alias("total_annual_revenue"),
        F.round(F.avg("churn_probability"), 4).alias("avg_churn_probability"),
    )
    return out if model is None else out.crossJoin(model)  # one row each


def priority_actions(pf: DataFrame) -> DataFrame:
    """Three conditional aggregates in one scan, stacked; empty actions dropped."""
    r = with_revenue(pf)
    p = F.col("churn_probability")
    conds = [
        F.col("Contract").eqNullSafe("Month-to-month") & (F.col("risk_tier") == "high"),
        R.needs_support() & (p > 0.5),
        F.col("PaymentMethod").eqNullSafe("Electronic check") & (p > 0.4),
    ]
    aggs = []
    for i, c in enumerate(conds):
        aggs.append(F.count_if(c).alias(f"n{i}"))
        aggs.append(F.coalesce(F.sum(F.when(c, F.col("revenue_at_risk"))), F.lit(0.0)).alias(f"r{i}"))
    a = r.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(prio).alias("priority"),
                F.lit(action).alias("action"),
                F.col(f"n{i}").alias("affected_customers"),
                F.round(F.col(f"r{i}"), 2).alias("revenue_at_risk"),
                F.lit(cat).alias("category"),
            )
            for i, (prio, action, cat) in enumerate(C.PRIORITY_ACTIONS)
        ]
    )
    return a.select(F.inline(rows)).filter(F.col("affected_customers") > 0)


def risk_by_contract(pf: DataFrame) -> DataFrame:
    return pf.groupBy("Contract").agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg("churn_probability"), 4).alias("avg_churn"),
        F.count_if(F.col("risk_tier") == "high").alias("high_risk"),
    )
