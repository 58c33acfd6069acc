"""Binary classification metrics as expressions on confusion counts.

Undefined ratios give 0 (zero_division=0). F1 uses 2tp / (2tp + fp + fn),
the count form of 2PR / (P + R); equal ratios of integers give identical
doubles, so "first best" comparisons are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def accuracy(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return _ratio(tp + tn, tp + fp + fn + tn)


def precision(tp: Column, fp: Column) -> Column:
    return _ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return _ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(tp * 2, tp * 2 + fp + fn)


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    den = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(den > 0, (tp * tn - fp * fn) / F.sqrt(den)).otherwise(F.lit(0.0))


def metric(name: str, tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return {
        "accuracy": lambda: accuracy(tp, fp, fn, tn),
        "precision": lambda: precision(tp, fp),
        "recall": lambda: recall(tp, fn),
        "f1": lambda: f1(tp, fp, fn),
        "mcc": lambda: mcc(tp, fp, fn, tn),
    }[name]()


def cost(fn: Column, fp: Column, cost_fn: float, cost_fp: float) -> Column:
    return fn.cast("double") * F.lit(cost_fn) + fp.cast("double") * F.lit(cost_fp)
