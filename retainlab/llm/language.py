"""Language identification by a byte convolutional network.

Texts are cut into fixed-length windows of ``WINDOW`` byte classes (letters
fold to lower case, digits and signs to one class each). Filters of several
widths slide over a window, rectified and max-pooled, and a softmax layer
gives the language. Training is plain numpy on a bounded sample of labelled
rows; whole texts are scored window by window inside Arrow batches, a filter
of width w being a sum of table rows for pairs of neighbouring classes. A
document's score is the mean window probability of the language it gets.

Null text or text without letters: ``und`` with score 0. Without any labelled
row every document is ``und``. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import load, small_batches

WINDOW, CLASSES, WIDTHS = 256, 128, (2, 3, 4)
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def byte_classes() -> np.ndarray:
    """Class of each byte: 0 padding, 1 white space, 2 digit, 3 sign, 4-29
    letters, 30-93 continuation bytes, 94-125 two-byte leads, 126 longer."""
    out = np.full(256, 3, dtype=np.uint8)
    out[:33] = 1
    out[ord("0") : ord("9") + 1] = 2
    for i in range(26):
        out[ord("a") + i] = out[ord("A") + i] = 4 + i
    out[0x80:0xC0] = np.arange(30, 94)
    out[0xC0:0xE0] = np.arange(94, 126)
    out[0xE0:] = 126
    return out


_CLASS_OF = byte_classes()


def windows(text: str) -> np.ndarray:
    """All windows of a text, the last one padded: (n, WINDOW) classes."""
    c = _CLASS_OF[np.frombuffer(text.encode(), dtype=np.uint8)]
    n = max(1, -(-len(c) // WINDOW))
    return np.pad(c, (0, n * WINDOW - len(c))).reshape(n, WINDOW)


class ByteCnn:
    """``tables[w][k]``: filter values of class at place k of width w."""

    def __init__(self, labels: list[str], filters: int = 8, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.labels, self.filters = labels, filters
        self.tables = {w: rng.normal(0, 0.3, (w, CLASSES, filters)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(filters, np.float32) for w in WIDTHS}
        self.dense = rng.normal(0, 0.1, (filters * len(WIDTHS), len(labels))).astype(np.float32)
        self.offset = np.zeros(len(labels), np.float32)
        self._pairs: dict[int, list[np.ndarray]] = {}

    def _responses(self, x: np.ndarray, w: int) -> np.ndarray:
        """Filter responses (n, places, filters) before the rectifier."""
        if w not in self._pairs:
            t = self.tables[w]
            pairs = [(t[k][:, None] + t[k + 1][None]).reshape(-1, self.filters) for k in range(0, w - 1, 2)]
            self._pairs[w] = pairs + ([t[w - 1]] if w % 2 else [])
        places = x.shape[1] - w + 1
        both = x[:, :-1].astype(np.int32) * CLASSES + x[:, 1:]
        out = np.broadcast_to(self.bias[w], (len(x), places, self.filters)).copy()
        for k, table in enumerate(self._pairs[w]):
            index = x if len(table) == CLASSES else both
            out += np.take(table, index[:, 2 * k : 2 * k + places], axis=0)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([np.maximum(self._responses(x, w).max(axis=1), 0) for w in WIDTHS], axis=1)
        z = pooled @ self.dense + self.offset
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 2) -> None:
        """Adam on the cross-entropy; max pooling sends each filter's gradient
        to one place of each window."""
        rng = np.random.default_rng(seed)
        weights = {("t", w): self.tables[w] for w in WIDTHS} | {("b", w): self.bias[w] for w in WIDTHS}
        weights |= {"dense": self.dense, "offset": self.offset}
        m, v = ({k: np.zeros_like(a) for k, a in weights.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                xb, yb, n = x[rows], y[rows], len(rows)
                pooled, where = [], []
                self._pairs = {}
                for w in WIDTHS:
                    r = self._responses(xb, w)
                    best = r.argmax(axis=1)
                    where.append(best)
                    pooled.append(np.maximum(np.take_along_axis(r, best[:, None], axis=1)[:, 0], 0))
                h = np.concatenate(pooled, axis=1)
                z = h @ self.dense + self.offset
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), yb] -= 1
                p /= n
                back = (p @ self.dense.T) * (h > 0)
                grads = {"dense": h.T @ p, "offset": p.sum(axis=0)}
                for i, w in enumerate(WIDTHS):
                    g = back[:, i * self.filters : (i + 1) * self.filters]
                    grads["b", w] = g.sum(axis=0)
                    t = np.zeros_like(self.tables[w])
                    column = np.broadcast_to(np.arange(self.filters), g.shape)
                    for k in range(w):
                        np.add.at(t[k], (np.take_along_axis(xb, where[i] + k, axis=1), column), g)
                    grads["t", w] = t
                step += 1
                for k, a in weights.items():
                    m[k] = 0.9 * m[k] + 0.1 * grads[k]
                    v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                    a -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self._pairs = {}


def training_rows(docs: DataFrame, learn: Column, rows: int, each: int) -> DataFrame:
    """(lang, piece): ``each`` window-sized pieces from each of at most
    ``rows`` labelled documents, both chosen by hash."""
    labelled = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    chosen = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(17))).limit(rows)
    span = F.greatest(F.lit(1), F.length("text") - WINDOW)
    pieces = [F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(i)), span).cast("int") + 1, F.lit(WINDOW)) for i in range(each)]
    return (
        labelled.join(F.broadcast(chosen), "doc_id")  # at most ``rows`` ids
        .select("lang", F.explode(F.array(*pieces)).alias("piece"), F.xxhash64("doc_id").alias("order"))
        .orderBy("order", "piece", "lang")
        .limit(rows * each)
        .select("lang", "piece")
    )


def fit_language_model(docs: DataFrame, learn: Column, rows: int = 3000, each: int = 3) -> ByteCnn | None:
    """A network learned from at most ``rows`` documents that ``learn`` admits."""
    sample = training_rows(docs, learn, rows, each).collect()
    if not sample:
        return None
    labels = sorted({r["lang"] for r in sample})
    model = ByteCnn(labels)
    x = np.concatenate([windows(r["piece"])[:1] for r in sample])
    model.fit(x, np.array([labels.index(r["lang"]) for r in sample]))
    return model


def identify(text: str | None, model: ByteCnn | None) -> tuple[str, float]:
    if model is None or not text or not _LETTER.search(text):
        return UNDETERMINED, 0.0
    x = windows(text)
    total = sum(model.probabilities(x[i : i + 256]).sum(axis=0) for i in range(0, len(x), 256)) / len(x)
    best = int(total.argmax())
    return model.labels[best], float(min(1.0, total[best]))


def predict_language(spark: SparkSession, docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score``. Columns of these
    names that the input has are replaced."""
    small_batches(spark)
    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [identify(t, model) for t in b.column("text").to_pylist()]
            lang = pa.array([f[0] for f in found], pa.string())
            score = pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, lang, score], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(column: str, parts: int, part: int) -> Column:
    """Whether crc32 of the column as text leaves the remainder ``part``."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts)) == part, F.lit(False))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows not held out."""
    docs = load(spark, sf_dir, "documents")
    out = held_out("doc_id", 3, 1)
    model = fit_language_model(docs, ~out)
    return predict_language(spark, docs.select("doc_id", "text"), model).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score"
    )
