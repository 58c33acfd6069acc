"""Shared building blocks that decide whether the operators scale.

K1 ``prefix_sums``: exact global running totals / ranks without moving all
   rows into one task. Bounds that cut the full sort key (with a unique
   tie-breaker, so hot values split) into ranges of about equal size are taken
   once, from a sample by key hash, and held as one row of literals; a row finds
   its range by binary search in them. So the range of a row is a plain
   expression, the same in the pass that sums the ranges (at most ``n_ranges`` x
   groups rows) and in the pass that adds up inside them, also when a stage runs
   again. Rows move once, by range, and only with the columns that are used.
K3 ``grid_index``: map a score to the number of grid thresholds it reaches,
   so a whole threshold sweep is one pass plus cumulative sums over T rows.
``exact_quantiles``: exact interpolated quantiles from (value, count) groups
   and K1, instead of gathering all values of a column in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retainlab.session import checkpoint_dir


#: Sampled keys per range.
SAMPLE = 20


def range_bounds(df: DataFrame, key: Column, n: int) -> DataFrame:
    """One row: ``_bounds``, at most n - 1 keys that cut ``df`` into about equal
    ranges, from the ``SAMPLE`` * n keys with the smallest hash."""
    keys = df.select(key.alias("_k")).orderBy(F.xxhash64("_k"), "_k").limit(SAMPLE * n)
    # at most SAMPLE * n keys: sorted and cut in one small task, then on the driver
    cut = keys.agg(F.sort_array(F.collect_list("_k")).alias("_s"))
    at = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.floor(i * F.size("_s") / n).cast("int"))
    picked = F.transform(F.array_distinct(at), lambda i: F.get("_s", i)) if n > 1 else F.slice("_s", 1, 0)
    bounds = cut.select(F.array_distinct(F.filter(picked, lambda k: k.isNotNull())).alias("_bounds"))
    return df.sparkSession.createDataFrame(bounds.collect(), bounds.schema)


def range_of(key: Column, n: int) -> Column:
    """How many of the ascending ``_bounds`` (fewer than n) are <= key."""
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(max(1, n.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when(F.get("_bounds", lo + s - 1) <= key, lo + s).otherwise(lo))


def prefix_sums(
    df: DataFrame,
    order: Sequence[Column],
    values: dict[str, Column] | None = None,
    group: Sequence[str] = (),
    rank_col: str = "rank",
    n_ranges: int | None = None,
    total_col: str = "group_total",
    write: bool = False,
) -> DataFrame:
    """Add ``rank_col`` (1-based position in ``order`` within ``group``),
    inclusive running sums ``cum_<name>`` for each value column, and the
    group's row count (``total_col``) and sums (``total_<name>``) taken from
    the per-range totals, so callers need no second aggregate.

    ``order`` has ascending keys (negate a number to sort it falling) and must
    be a total order within a group (end it with a unique key). ``group`` must
    have few distinct values (models, classes): the offset table has n_ranges x
    groups rows and is broadcast. ``df`` is computed three times (keys, totals,
    rows) and must give the same keys each time; ``write`` checkpoints it first,
    for narrow inputs that cost a shuffle. ``n_ranges``: by default the session's
    shuffle partitions.
    """
    if write:
        checkpoint_dir(df.sparkSession)
        df = df.checkpoint()
    values = values or {}
    group = list(group)
    n = n_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vcols = {f"_v_{k}": v for k, v in values.items()}
    okeys = {f"_k_{i}": c for i, c in enumerate(order)}
    base = df.withColumns({**vcols, **okeys})
    key = F.struct(*group, *okeys)
    bounds = range_bounds(base, key, n)
    ranged = base.crossJoin(F.broadcast(bounds)).withColumn("_rid", range_of(key, n)).drop("_bounds")  # one row
    aggs = [F.count(F.lit(1)).alias("_t_n")] + [F.sum(c).alias(f"_t{c}") for c in vcols]
    totals = ranged.groupBy(*group, "_rid").agg(*aggs)
    before = Window.partitionBy(*group).orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = totals.select(
        *group,
        "_rid",
        F.coalesce(F.sum("_t_n").over(before), F.lit(0)).alias("_o_n"),
        *[F.coalesce(F.sum(f"_t{c}").over(before), F.lit(0)).alias(f"_o{c}") for c in vcols],
        F.sum("_t_n").over(whole).alias(total_col),
        *[F.sum(f"_t{c}").over(whole).alias(f"total_{name}") for name, c in zip(values, vcols)],
    )
    joined = ranged.join(F.broadcast(offsets), on=[*group, "_rid"], how="inner")
    own = Window.partitionBy("_rid", *group).orderBy(*okeys)
    inside = own.rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumn(rank_col, F.col("_o_n") + F.row_number().over(own))
    for name, c in zip(values, vcols):
        out = out.withColumn(f"cum_{name}", F.col(f"_o{c}") + F.sum(c).over(inside))
    return out.drop("_rid", "_o_n", *vcols, *okeys, *[f"_o{c}" for c in vcols])


def linspace_values(start: float, stop: float, num: int) -> list[float]:
    """The grid a numpy ``linspace`` produces (i * step + start, last = stop)."""
    return [float(x) for x in np.linspace(start, stop, num)]


def grid_index(score: Column, start: float, stop: float, num: int) -> Column:
    """Number of grid points t_i (numpy linspace) with t_i <= score, 0..num.

    A first guess from the arithmetic grid is corrected against the literal
    grid values, so ``score >= t_i`` holds exactly iff index >= i + 1.
    """
    step = (stop - start) / (num - 1)

    def t(i: Column) -> Column:
        return F.when(i >= num - 1, F.lit(float(stop))).otherwise(i.cast("double") * F.lit(step) + F.lit(start))

    guess = F.floor((score - F.lit(start)) / F.lit(step)).cast("int") + 1
    g = F.least(F.greatest(guess, F.lit(0)), F.lit(num))
    # the arithmetic guess is off by at most one grid point: one step each way
    up = ((g < num) & (score >= t(g))).cast("int")
    down = ((g > 0) & (score < t(g - 1))).cast("int")
    return g + up - down


def numpy_bin(x: Column, first: Column, last: Column, bins: int) -> Column:
    """numpy.histogram bin of x for equal bins between first and last: the bin
    i with edge_i <= x < edge_(i+1), the last bin closed, edges from linspace."""
    step = (last - first) / F.lit(float(bins))

    def edge(i: Column) -> Column:
        return F.when(i >= bins, last).otherwise(i.cast("double") * step + first)

    j = F.floor((x - first) / (last - first) * F.lit(float(bins))).cast("int")
    j = F.least(F.greatest(j, F.lit(0)), F.lit(bins - 1))
    j = F.when((j > 0) & (x < edge(j)), j - 1).otherwise(j)
    j = F.when((j < bins - 1) & (x >= edge(j + 1)), j + 1).otherwise(j)
    return j


def numpy_edge(i: Column, first: Column, last: Column, bins: int) -> Column:
    step = (last - first) / F.lit(float(bins))
    return F.when(i >= bins, last).otherwise(i.cast("double") * step + first)


def exact_quantiles(
    df: DataFrame, group: str, value: str, q: float = 0.5, n_ranges: int | None = None
) -> DataFrame:
    """Exact interpolated quantile of ``value`` per ``group`` (nulls skipped).

    Distinct (group, value) counts are aggregated map-side, ranked with K1,
    and the two order statistics around q*(n-1) are picked by position.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(group, value)
        .agg(F.count(F.lit(1)).alias("_cnt"))
    )
    ranked = prefix_sums(counts, [F.col(value)], {"cnt": F.col("_cnt")}, group=[group],
                         n_ranges=n_ranges, write=True)
    pos = (F.col("total_cnt") - 1) * F.lit(float(q))
    lo_i = F.floor(pos)
    hi_i = F.ceil(pos)
    r = ranked
    first = F.col("cum_cnt") - F.col("_cnt")  # 0-based position of the first copy
    r = r.withColumn("_pos", pos).withColumn("_lo", lo_i).withColumn("_hi", hi_i)
    picked = r.filter(
        ((F.col("_lo") >= first) & (F.col("_lo") < F.col("cum_cnt")))
        | ((F.col("_hi") >= first) & (F.col("_hi") < F.col("cum_cnt")))
    )
    agg = picked.groupBy(group).agg(
        F.min_by(value, F.col(value)).alias("_vlo"),
        F.max_by(value, F.col(value)).alias("_vhi"),
        F.first("_pos").alias("_pos"),
        F.first("_lo").alias("_lo"),
    )
    frac = F.col("_pos") - F.col("_lo")
    return agg.select(
        group,
        (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * frac).alias("quantile"),
    )
