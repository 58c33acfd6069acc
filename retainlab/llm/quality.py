"""Quality score by a generalised additive model with pairwise interactions.

Every feature of a text is binned on training quantiles. Rounds of boosting
visit the features in turn; each visit fits a shallow tree of one feature to
the gradient and adds its steps to that feature's lookup table. Then pairs of
features that explain most of what is left get tables of two dimensions, by
the same cyclic boosting. A score is the logistic of a sum of table entries,
added for a batch of rows at a time.

Features are counts and ratios of the text alone. Null or empty text has
features 0 and gets a score like any other. Without labelled rows every score
is 0.5. Repeated rows score alike; a repeated label counts as often.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, small_batches
from .language import held_out

FEATURES = (
    "log_length letters digits upper signs space other_signs entropy words mean_word short_words distinct_words "
    "top_word signed_words distinct_lines line_length stops top_sign"
).split()


def _byte_groups() -> np.ndarray:
    """Letters, digits, upper case, sentence signs, white space, other signs,
    full stops of each byte, as columns."""
    g = np.zeros((256, 7))
    for b in range(256):
        ch = chr(b)
        g[b] = (
            b >= 128 or ch.isalpha(),
            ch.isdigit(),
            b < 128 and ch.isupper(),
            ch in ".,;:?'\"()-",
            b < 128 and ch.isspace(),
            b < 128 and b > 32 and not ch.isalnum() and ch not in ".,;:?'\"()-",
            ch == ".",
        )
    return g


_GROUPS = _byte_groups()


def text_features(text: str | None) -> np.ndarray:
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    n = counts.sum()
    letters, digits, upper, signs, space, other, stops = counts @ _GROUPS / n
    share = counts[counts > 0] / n
    words, lines = text.split(), text.split("\n")
    out[:8] = np.log1p(n), letters, digits, upper, signs, space, other, -(share * np.log(share)).sum()
    if words:
        seen, k = Counter(words), len(words)
        sizes = np.fromiter(map(len, seen), np.int64, len(seen))
        times = np.fromiter(seen.values(), np.int64, len(seen))
        signed = sum(t for w, t in seen.items() if not w[-1].isalnum())
        out[8:14] = (
            np.log1p(k),
            (sizes * times).sum() / k,
            times[sizes <= 3].sum() / k,
            len(seen) / k,
            times.max() / k,
            signed / k,
        )
    out[14:16] = len(set(lines)) / len(lines), np.log1p(n / len(lines))
    only_signs = counts * (_GROUPS[:, 3] + _GROUPS[:, 5])
    out[16:18] = stops, only_signs.max() / n
    return out


def steps_of(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
    """A tree of one binned feature, grown best split first: the value of each
    bin. ``grad`` and ``hess`` are sums by bin."""
    g, h = np.concatenate([[0], grad.cumsum()]), np.concatenate([[0], hess.cumsum()])

    def best(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        cut = np.arange(lo + 1, hi)
        left, right = g[cut] - g[lo], g[hi] - g[cut]
        gain = left**2 / (h[cut] - h[lo] + ridge) + right**2 / (h[hi] - h[cut] + ridge)
        gain -= (g[hi] - g[lo]) ** 2 / (h[hi] - h[lo] + ridge)
        k = int(gain.argmax())
        return float(gain[k]), int(cut[k])

    parts = [(0, len(grad))]
    while len(parts) < leaves:
        (gain, cut), (lo, hi) = max((best(*p), p) for p in parts)
        if gain <= 1e-9:
            break
        parts.remove((lo, hi))
        parts += [(lo, cut), (cut, hi)]
    out = np.zeros(len(grad))
    for lo, hi in parts:
        out[lo:hi] = -(g[hi] - g[lo]) / (h[hi] - h[lo] + ridge)
    return out


@dataclass
class PairGam:
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    coarse: int = 4

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def raw(self, b: np.ndarray) -> np.ndarray:
        z = np.full(len(b), self.start)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[b[:, i] // self.coarse, b[:, j] // self.coarse]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pairs: int = 6, rate: float = 0.1, leaves: int = 3) -> None:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = self.bins(x)
        sizes = [len(e) + 1 for e in self.edges]
        rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate_of / (1 - rate_of)))
        self.tables = [np.zeros(s) for s in sizes]
        z = np.full(len(x), self.start)

        def pull() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-z))
            return p - y, p * (1 - p)

        for _ in range(rounds):
            for j in range(len(sizes)):
                grad, hess = pull()
                step = rate * steps_of(
                    np.bincount(b[:, j], grad, sizes[j]), np.bincount(b[:, j], hess, sizes[j]), leaves
                )
                self.tables[j] += step
                z += step[b[:, j]]
        c = b // self.coarse
        shape = [-(-s // self.coarse) for s in sizes]
        cells = {(i, j): c[:, i] * shape[j] + c[:, j] for i in range(len(sizes)) for j in range(i + 1, len(sizes))}

        def cell_step(k: tuple[int, int]) -> tuple[float, np.ndarray]:
            grad, hess = pull()
            n = shape[k[0]] * shape[k[1]]
            g, h = np.bincount(cells[k], grad, n), np.bincount(cells[k], hess, n)
            return float((g**2 / (h + 5)).sum()), -g / (h + 5)

        self.pairs = sorted(cells, key=lambda k: -cell_step(k)[0])[:pairs]
        self.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in self.pairs]
        for _ in range(rounds // 3):
            for k, t in zip(self.pairs, self.pair_tables, strict=True):
                step = rate * cell_step(k)[1]
                t += step.reshape(t.shape)
                z += step[cells[k]]


def feature_rows(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep`` (numbers) and the features of ``text`` as an array."""
    fields = [docs.schema[n] for n in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [text_features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select("text", *keep).mapInArrow(run, f"{schema}, x array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = 20_000) -> PairGam:
    """A model of ``labels.quality`` from at most ``rows`` labels (by hash of
    the document's id) that ``learn`` admits."""
    chosen = (
        labels.filter(learn & F.col("quality").isNotNull())
        .select("doc_id", F.col("quality").cast("long").alias("quality"))
        .orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id")
        .limit(rows)
    )
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` labels
    sample = feature_rows(picked, ("doc_id", "quality")).orderBy(F.xxhash64("doc_id"), "quality", "x").limit(rows).collect()
    model = PairGam()
    if sample:
        model.fit(np.array([r["x"] for r in sample]), np.array([float(r["quality"] > 0) for r in sample]))
    return model


def score_quality(spark: SparkSession, docs: DataFrame, model: PairGam) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    small_batches(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack([text_features(t) for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(model.scores(x))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op9_quality(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Quality score of every document, learned from the labels not held out."""
    docs = load(spark, sf_dir, "documents")
    out = held_out("doc_id", 5, 0)
    model = fit_quality(docs, load(spark, sf_dir, "labels"), ~out)
    return score_quality(spark, docs, model).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
