"""Preparation P1-P11: splits, imputation, scaling, one-hot encoding,
feature names, class weights, and a fitted MLlib ``PipelineModel``.

Statistics are learned on the train rows with exact aggregates (interpolated
median through K1, mode with smallest-value ties, population deviation) and
written into a standard ``PipelineModel`` (SQLTransformer with the learned
constants, StringIndexerModel, OneHotEncoderModel, VectorAssembler), so the
model saves and loads with MLlib's own writers.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retainlab import config as C
from retainlab.operators.blocks import exact_quantiles, prefix_sums

NUMERIC_TYPES = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.DecimalType)


def split_columns(df: DataFrame, exclude=(C.ID_COL, C.TARGET_COL, "k", "split", "y_true")) -> tuple[list, list]:
    """Numeric and categorical feature columns by declared type, in column order."""
    ex = {e.lower() for e in exclude}
    num, cat = [], []
    for f in df.schema.fields:
        if f.name.lower() in ex:
            continue
        (num if isinstance(f.dataType, NUMERIC_TYPES) else cat).append(f.name)
    return num, cat


def melt(df: DataFrame, cols: list[str], id_cols=(C.ID_COL,), cast: str | None = None) -> DataFrame:
    """Long form (ids..., feature, value) of the given columns (one explode)."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), (F.col(c).cast(cast) if cast else F.col(c)).alias("value"))
            for c in cols
        ]
    )
    return df.select(*id_cols, F.inline(pairs))


# -------------------------------------------------------------- P1 splits
def stratified_exact_split(df: DataFrame, hash_col: str, key: str, label: str = "y_true",
                           train: float = 0.7, val: float = 0.1) -> DataFrame:
    """Exact per-class proportions: rank inside each class by hash (K1, the
    class is never one task), then cut at the exact shares of the class size;
    ``val`` may be 0, and ``test`` is what the two leave (more than nothing)."""
    a, b = Fraction(str(train)), Fraction(str(train)) + Fraction(str(val))
    if not 0 < a <= b < 1:
        raise ValueError(f"train {train} and val {val} leave no proper split")
    j = prefix_sums(df, [F.col(hash_col), F.col(key)], group=[label], rank_col="_r",
                    total_col="_n", write=True)

    def before(share: Fraction) -> Column:
        return (F.col("_r") - 1) * share.denominator < F.col("_n") * share.numerator

    return j.withColumn(
        "split",
        F.when(before(a), "train").when(before(b), "val").otherwise("test"),
    ).drop("_r", "_n")


# -------------------------------------------------------- P2-P5 statistics
def medians(train: DataFrame, cols: list[str]) -> DataFrame:
    """Exact interpolated median per column: (feature, median)."""
    long = melt(train, cols, id_cols=(), cast="double")
    return exact_quantiles(long, "feature", "value", 0.5).withColumnRenamed("quantile", "median")


def modes(train: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent value per column, ties to the smallest: (feature, mode).
    Two aggregates and a join, so a high-cardinality column is never one task."""
    long = melt(train, cols, id_cols=(), cast="string").filter(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("feature").agg(F.max("n").alias("n"))
    return counts.join(top, ["feature", "n"]).groupBy("feature").agg(F.min("value").alias("mode"))


def impute_numeric(df: DataFrame, med: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in med.items()})


def moments(train_imputed: DataFrame, cols: list[str]) -> DataFrame:
    long = melt(train_imputed, cols, id_cols=(), cast="double")
    return long.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


def standard_expr(c: str, mean: float, std: float) -> Column:
    scale = std if std and std > 0 else 1.0
    return (F.col(c) - F.lit(mean)) / F.lit(scale)


def minmax_expr(c: str, lo: float, hi: float) -> Column:
    rng = hi - lo
    scale = rng if rng > 0 else 1.0
    return (F.col(c) - F.lit(lo)) / F.lit(scale)


def categories(train: DataFrame, cols: list[str], mode_map: dict[str, str]) -> DataFrame:
    """Distinct (feature, value) seen in train after mode imputation."""
    filled = train.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(mode_map.get(c))) for c in cols})
    return melt(filled, cols, id_cols=(), cast="string").filter(F.col("value").isNotNull()).distinct()


def feature_names(num: list[str], cats: DataFrame, cat_order: list[str]) -> DataFrame:
    """Encoder order: numeric columns, then per categorical column its sorted
    categories as '<column>_<value>'. The name list is metadata (one row per
    output column), ordered by a window over that small table."""
    spark = cats.sparkSession
    order = spark.createDataFrame([(c, i) for i, c in enumerate(cat_order)], "feature string, ci int")
    c = cats.join(F.broadcast(order), "feature")
    w = Window.orderBy("ci", "value")
    catn = c.select((F.row_number().over(w) - 1 + len(num)).alias("position"),
                    F.concat(F.col("feature"), F.lit("_"), F.col("value")).alias("name"))
    numn = spark.createDataFrame([(i, n) for i, n in enumerate(num)], "position int, name string")
    return numn.unionByName(catn.select(F.col("position").cast("int"), "name"))


def class_weights(train: DataFrame, label: str = "y_true") -> DataFrame:
    """Balanced weights n / (2 n_c) and the negative/positive ratio."""
    c = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(
        F.sum("n").alias("_all"),
        F.sum(F.when(F.col(label) == 0, F.col("n"))).alias("_neg"),
        F.sum(F.when(F.col(label) == 1, F.col("n"))).alias("_pos"),
    )
    j = c.crossJoin(tot)  # one row
    return j.select(
        label,
        "n",
        F.round(F.col("_all") / (F.col("n") * 2.0), 6).alias("weight"),
        F.round(F.try_divide(F.col("_neg"), F.col("_pos")), 6).alias("scale_pos_weight"),
    )


def with_weights(df: DataFrame, weights: DataFrame, label: str = "y_true", out: str = "weight") -> DataFrame:
    w = weights.select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(w), label)  # one row per class


# ------------------------------------------------------------- P8 pipeline
@dataclass
class Prepared:
    model: PipelineModel
    numeric: list[str]
    categorical: list[str]
    names: list[str] = field(default_factory=list)


def fit_preprocessor(train: DataFrame, scale: str | None = "standard", output: str = "features") -> Prepared:
    """Fit on train rows; the returned PipelineModel transforms any split.

    The small learned tables (one row per feature or category) come to the
    driver to become stage parameters; rows never do.
    """
    num, cat = split_columns(train)
    train = train.persist()  # several small statistics passes read the same rows
    med = {r["feature"]: r["median"] for r in medians(train, num).collect()}
    med = {c: med.get(c, 0.0) for c in num}
    mode_map = {r["feature"]: r["mode"] for r in modes(train, cat).collect()}
    stats = {}
    if scale:
        for r in moments(impute_numeric(train, med), num).collect():
            stats[r["feature"]] = r
    exprs = []
    for c in num:
        x = f"coalesce(CAST(`{c}` AS DOUBLE), {float(med[c])!r})"
        if scale == "standard":
            s = stats[c]["std"] or 0.0
            exprs.append(f"({x} - {float(stats[c]['mean'])!r}) / {float(s if s > 0 else 1.0)!r} AS `{c}`")
        elif scale == "minmax":
            lo, hi = float(stats[c]["min"]), float(stats[c]["max"])
            exprs.append(f"({x} - {lo!r}) / {float(hi - lo if hi > lo else 1.0)!r} AS `{c}`")
        else:
            exprs.append(f"{x} AS `{c}`")
    for c in cat:
        m = mode_map.get(c)
        lit = "NULL" if m is None else "'" + m.replace("'", "''") + "'"
        exprs.append(f"coalesce(CAST(`{c}` AS STRING), {lit}) AS `{c}`")
    keep = [f"`{c}`" for c in train.columns if c not in num and c not in cat]
    sqlt = SQLTransformer(statement=f"SELECT {', '.join(keep + exprs)} FROM __THIS__")
    idx_cols = [f"{c}__idx" for c in cat]
    ohe_cols = [f"{c}__ohe" for c in cat]
    imputed_train = sqlt.transform(train)
    indexer = StringIndexer(inputCols=cat, outputCols=idx_cols, handleInvalid="keep",
                            stringOrderType="alphabetAsc").fit(imputed_train)
    labels = [list(x) for x in indexer.labelsArray]
    # the indexer puts unseen and missing values in its extra last slot; dropLast
    # removes that slot, so they become the all-zero vector (seen categories only)
    ohe = OneHotEncoder(inputCols=idx_cols, outputCols=ohe_cols, dropLast=True, handleInvalid="error")
    ohe_model = ohe.fit(indexer.transform(imputed_train))
    assembler = VectorAssembler(inputCols=num + ohe_cols, outputCol=output, handleInvalid="keep")
    names = list(num) + [f"{c}_{v}" for c, lab in zip(cat, labels) for v in lab]
    train.unpersist()
    return Prepared(PipelineModel([sqlt, indexer, ohe_model, assembler]), num, cat, names)


# --------------------------------------------------------------- P9 SMOTE
def smote(train_vec: DataFrame, key: str = "k", vec: str = "vec", label: str = "y_true", k: int = 5,
          seed: int = 42) -> DataFrame:
    """Minority oversampling by neighbour interpolation, train rows only.

    Neighbours come from the exact K2 join inside the minority class. The
    n_major - n_minor synthetic rows are spread over minority rows by their
    K1 rank (row r makes floor(need / n_min) copies, one more when
    r <= need mod n_min); copy c of row x picks neighbour
    1 + hash(x, c) mod k and the gap u = hash-uniform(x, c):
    x_new = x + u (nb - x). Deterministic, no sampling, no driver loop.
    """
    from retainlab.operators.neighbours import knn_join

    counts = {r[0]: r[1] for r in train_vec.groupBy(label).count().collect()}
    minority = min(counts, key=counts.get)
    n_min, n_maj = counts[minority], max(counts.values())
    need = n_maj - n_min
    mino = train_vec.filter(F.col(label) == minority).select(key, vec)
    if need <= 0 or n_min < 2:
        return mino.limit(0).select(F.col(key).alias("base_key"), F.lit(0).alias("copy"), F.lit(minority).alias(label),
                                    F.col(vec).alias("features"))
    nb = knn_join(mino, mino, min(k, n_min - 1), qid=key, rid=key, vec=vec, exclude_self=True)
    ranked = prefix_sums(mino, [F.col(key)], rank_col="_r", write=True)
    per, extra = divmod(need, n_min)
    copies = F.lit(per) + (F.col("_r") <= extra).cast("int")
    rep = ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).filter(copies > 0)
    kk = min(k, n_min - 1)
    h = F.xxhash64(F.col(key), F.col("copy"), F.lit(seed))
    rep = rep.withColumn("_nr", (F.pmod(h, F.lit(kk)) + 1).cast("int"))
    rep = rep.withColumn("_u", F.pmod(F.xxhash64(F.col(key), F.col("copy"), F.lit(seed + 1)), F.lit(1 << 30))
                         / F.lit(float(1 << 30)))
    nbv = nb.select(F.col("qid").alias(key), F.col("rank").alias("_nr"), F.col("rid").alias("_nb"))
    j = rep.join(nbv, [key, "_nr"]).join(mino.select(F.col(key).alias("_nb"), F.col(vec).alias("_nv")), "_nb")
    new = F.zip_with(vec, "_nv", lambda a, b: a + F.col("_u") * (b - a))
    return j.select(F.col(key).alias("base_key"), "copy", F.lit(minority).alias(label), new.alias("features"))
