"""Personal data by patterns and a skip-chain conditional random field.

Patterns give base spans (``base_spans``). Words with a digit or an ``@`` are
the nodes of a random field over each whole document; a label is none or one
of the kinds. Neighbouring nodes are linked (chain), and so are a node and the
next one in the document with the same digits, last seven digits or letters
(skip). Both sorts of links share one weight table each. Weights are learned
by pseudo-likelihood on nodes labelled by the patterns, from a bounded sample
of documents. Loopy sum-product messages, with base spans as evidence, give
each other node its marginal; runs of nodes sure of one kind are new spans.

Null or empty text has no spans. Links are linear in the number of nodes, so
very long texts cost in proportion. Repeated rows get the same spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, chunks, load, small_batches

#: fixed values: kinds in their order and the base patterns; an address is
#: sought from its @ and a dotted number from the first of its digits, which
#: finds the same spans in linear time
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
PATTERNS = {
    "email": re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_NODE = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
_RUN = re.compile(r"[A-Za-z]+|[0-9]+")
_SIGNAL = re.compile(r"[0-9@]")
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in found.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def addresses(text: str) -> Iterator[Span]:
    free = 0  # the first place that no earlier address or @ takes
    for m in PATTERNS["email"].finditer(text):
        at = m.start()
        local = text[max(free, text.rfind("@", 0, at) + 1) : at]
        size = len(local) - len(local.rstrip(_LOCAL))
        if size:
            yield at - size, 0, m.end()
            free = m.end()


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each pattern that pass their test, by start."""
    out: list[Span] = []
    if not _SIGNAL.search(text):
        return out
    for k, kind in enumerate(KINDS):
        if kind == "email":
            out += addresses(text)
            continue
        out += [(m.start(), k, m.end()) for m in PATTERNS[kind].finditer(text) if _valid(kind, m[0])]
    return sorted(out)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


@dataclass
class Node:
    start: int
    end: int
    word: str
    features: list[str]
    label: int  # 0 none, else 1 + kind of a base span over it


def shape(word: str) -> str:
    return _RUN.sub(lambda m: ("a" if m[0][0].isalpha() else "9") + str(min(len(m[0]), 20)), word[:60])


def nodes(text: str, spans: list[Span]) -> list[Node]:
    """Words with a digit or an ``@``, their features and base labels."""
    out: list[Node] = []
    at = 0
    for m in _NODE.finditer(text):
        word = m[0]
        digits = re.sub("[^0-9]", "", word)
        core = word.strip(".,;:!?\"'$#%&*")
        before = text[max(0, m.start() - 24) : m.start()].split()[-1:]
        features = [
            "bias",
            f"shape {shape(core)}",
            f"digits {min(len(digits), 20)}",
            f"card {12 <= len(digits) <= 19 and luhn(digits)}",
            f"begins {core[:1] if not core[:1].isalnum() else 'w'}",
            f"signs {''.join(sorted(set(re.sub('[A-Za-z0-9]', '', core))))[:6]}",
            f"before {before[0][:12].lower() if before and not _SIGNAL.search(before[0]) else '-'}",
        ]
        while at < len(spans) and spans[at][2] <= m.start():
            at += 1
        label = next((1 + k for s, k, e in spans[at : at + 4] if s < m.end() and m.start() < e), 0)
        out.append(Node(m.start(), m.end(), word, features, label))
    return out


def links(found: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain links of nodes at most a space apart, and skip links from each
    node to the next like it."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1].start - found[i].end <= 1]
    last: dict[str, int] = {}
    skip: set[tuple[int, int]] = set()
    for i, node in enumerate(found):
        digits = re.sub("[^0-9]", "", node.word)
        keys = [digits, digits[-7:]] if len(digits) >= 7 else []
        if len(node.word) >= 6:
            keys.append(node.word.lower().strip(".,;:!?\"'()$#%&*"))
        for key in keys:
            if key in last and last[key] != i:
                skip.add((last[key], i))
            last[key] = i
    return chain, sorted(skip - set(chain))


class SkipChain:
    """Weights by feature, and shared weights of chain and skip links."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.chain = np.zeros((len(KINDS) + 1,) * 2)
        self.skip = 3 * np.eye(len(KINDS) + 1)  # what is alike has one label, unless the rows say otherwise

    def fit(self, rows: list[tuple[list[str], int, int, int, int]], epochs: int = 200, rate: float = 0.5) -> None:
        """Pseudo-likelihood: each node given its features and the labels of
        the nodes before, after and linked by a skip (-1: none)."""
        if not rows:
            return
        names = {f: i for i, f in enumerate(dict.fromkeys(f for r in rows for f in r[0]))}
        k, n = len(KINDS) + 1, len(rows)
        feats = np.array([[names[f] for f in r[0]] for r in rows])
        y = np.array([r[1] for r in rows])
        near = [np.array([r[c] for r in rows]) for c in (2, 3, 4)]
        w, chain, skip = np.zeros((len(names), k)), np.zeros((k, k)), self.skip.copy()
        truth = np.eye(k)[y]
        grad2 = {key: np.full(a.shape, 1e-6) for key, a in (("w", w), ("c", chain), ("s", skip))}
        for _ in range(epochs):
            z = w[feats].sum(axis=1)
            for idx, table in ((near[0], chain), (near[1], chain.T), (near[2], skip)):
                z += np.where(idx[:, None] >= 0, table[idx], 0)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - truth) / n
            gw, gc, gs = 1e-5 * w, 1e-5 * chain, 1e-4 * (skip - self.skip)
            np.add.at(gw, feats, np.repeat(d[:, None], feats.shape[1], axis=1))
            for idx, g in ((near[0], gc), (near[1], gc.T), (near[2], gs)):
                on = idx >= 0
                np.add.at(g, idx[on], d[on])
            gs = (gs + gs.T) / 2
            for key, a, g in (("w", w, gw), ("c", chain, gc), ("s", skip, gs)):
                grad2[key] += g**2
                a -= rate * g / np.sqrt(grad2[key])
        self.weights = {f: w[i] for f, i in names.items()}
        self.chain, self.skip = chain, skip

    def marginals(self, found: list[Node], rounds: int = 8) -> np.ndarray:
        """Loopy sum-product over one document; base labels are evidence."""
        k = len(KINDS) + 1
        own = np.array([sum((self.weights.get(f, 0) for f in n.features), np.zeros(k)) for n in found])
        for i, n in enumerate(found):
            if n.label:
                own[i] = -30.0
                own[i, n.label] = 0.0
        own = np.exp(own - own.max(axis=1, keepdims=True))
        chain, skip = links(found)
        pairs = chain + skip
        if not pairs:
            return own / own.sum(axis=1, keepdims=True)
        a, b = np.array(pairs).T
        tables = np.concatenate([np.repeat(np.exp(t)[None], len(x), axis=0) for t, x in ((self.chain, chain), (self.skip, skip)) if x])
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        t = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a), 2 * len(a)), np.arange(len(a))])
        msg = np.full((len(src), k), 1.0 / k)
        for _ in range(rounds):
            logs = np.log(own + 1e-300)
            np.add.at(logs, dst, np.log(msg))
            out = np.exp(logs[src] - np.log(msg[back]) - (logs[src] - np.log(msg[back])).max(axis=1, keepdims=True))
            new = np.einsum("ei,eij->ej", out, t) + 1e-12
            msg = 0.5 * msg + 0.5 * new / new.sum(axis=1, keepdims=True)
        logs = np.log(own + 1e-300)
        np.add.at(logs, dst, np.log(msg))
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def added(self, text: str, base: list[Span], sure: float = 0.7) -> list[Span]:
        """Runs of linked nodes outside base spans sure of one kind."""
        if not _SIGNAL.search(text):
            return []
        found = nodes(text, base)
        if not self.weights or all(n.label for n in found):
            return []
        p = self.marginals(found)
        out: list[Span] = []
        for n, q in zip(found, p, strict=True):
            label = int(q.argmax())
            if n.label or not label or q[label] < sure:
                continue
            core = n.word.strip(".,;:!?\"'$#%&*|")
            s = n.start + n.word.find(core)
            whole = text[out[-1][0] : s + len(core)] if out and out[-1][1] == label - 1 and s - out[-1][2] <= 1 else ""
            if whole and len(re.sub("[^0-9]", "", whole)) <= 19:
                out[-1] = (out[-1][0], label - 1, s + len(core))
            else:
                out.append((s, label - 1, s + len(core)))
        return out


def training_nodes(docs: DataFrame, rows: int, limit: int) -> list[tuple[list[str], int, int, int, int]]:
    """At most ``limit`` nodes of at most ``rows`` documents, by hash."""
    schema = "features array<string>, label int, before int, after int, alike int"
    arrow = pa.schema([("features", pa.list_(pa.string()))] + [(n, pa.int32()) for n in ("label", "before", "after", "alike")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for (text,) in arrow_rows(batches, "text"):
                found = nodes(text, base_spans(text))
                near = np.full((len(found), 3), -1)
                chain, skip = links(found)
                for i, j in chain:
                    near[j, 0], near[i, 1] = found[i].label, found[j].label
                for i, j in skip:
                    near[j, 2], near[i, 2] = found[i].label, found[j].label
                for n, (x, y, z) in zip(found, near.tolist(), strict=True):
                    if not n.label and z > 0:
                        continue  # like a base span, but none: for the field to say
                    yield n.features, n.label, x, y, z

        yield from chunks(out(), arrow, 2000)

    signal = docs.filter(F.col("text").rlike("[0-9@]"))
    chosen = signal.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(5))).limit(rows)
    picked = signal.join(F.broadcast(chosen), "doc_id")  # at most ``rows`` ids
    found = picked.select("text").mapInArrow(run, schema)
    order = F.xxhash64("features", "label", "before", "after", "alike")
    return [tuple(r) for r in found.orderBy(order, "features", "label").limit(limit).collect()]


def fit_personal(docs: DataFrame, rows: int = 3000, limit: int = 20_000) -> SkipChain:
    model = SkipChain()
    model.fit(training_nodes(docs, rows, limit))
    return model


def find_personal(spark: SparkSession, docs: DataFrame, model: SkipChain) -> DataFrame:
    """``doc_id``, ``base`` and ``added``: spans as arrays of (start, kind,
    end) in code points, end exclusive."""
    small_batches(spark)
    span = pa.list_(pa.list_(pa.int64()))
    schema = pa.schema([("doc_id", pa.int64()), ("base", span), ("added", span)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for doc_id, text in arrow_rows(batches, "doc_id", "text"):
                base = base_spans(text or "")
                yield doc_id, base, model.added(text or "", base)

        yield from chunks(out(), schema, 2000)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, base array<array<long>>, added array<array<long>>")


def op6_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans,
    and all spans."""
    docs = load(spark, sf_dir, "documents")
    found = find_personal(spark, docs, fit_personal(docs))
    kinds = F.array(*(F.lit(k) for k in KINDS))

    def text_of(spans):
        ordered = F.array_sort(spans)
        return F.array_join(
            F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(kinds, (s[1] + 1).cast("int")), s[0], s[2])), ","
        )

    def count_of(k: int):
        # a second parameter of the lambda, default or not, would be the index in the array
        return F.size(F.filter("base", lambda s: s[1] == k)).cast("long")

    counts = [count_of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(text_of(F.col("base")), 256).alias("base_sha256"),
        text_of(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
