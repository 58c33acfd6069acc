"""M3-M5, M8: boosting on histograms: first-order, leaf-wise, second-order, and
AdaBoost.

A tree grows best leaf first: the open leaf with the highest gain is split next,
until ``max_leaves`` or ``max_depth`` (0: no limit). One job computes histograms
(gradient, hessian, rows per node, feature and bin) for the children of every
open leaf that can still be reached by the splits left, the smaller child from
the rows, its sibling by subtraction from the parent; the driver then splits on
while it knows the children, so a tree costs about as many jobs as it has levels
and is the same as with a job per split. With a depth limit and no limit on
leaves that is level-wise growth.

Gain of a split: T(G_l)^2 / (H_l + l2) + T(G_r)^2 / (H_r + l2) - T(G)^2 / (H + l2),
T the soft threshold at ``l1``; leaf value -rate * T(G) / (H + l2). Rows are
sampled per tree by a hash of their key, columns by a seeded draw. The margin
starts at the weighted log odds. ``first_order`` chooses splits as least squares
on the gradient does (rows in place of hessians); the leaf values stay. For
forests (``tuning``) a tree may see a bootstrap sample (Poisson counts by key
hash) and a node ``node_columns`` of the features that vary there.

AdaBoost (binary SAMME) keeps a row's log weight where boosting keeps its margin.
Row weights start alike; a round fits a tree to rows weighted by row times class
weight, takes its error under the row weights alone, and raises the weights of
the rows it missed. With weighted shares as sums (g = w y, h = w) the same
histograms give splits of highest Gini gain and leaves that hold class shares.

Rows that one task can hold have nothing to sum between tasks: the same loop
then runs inside that task, with the same trees, and saves thousands of jobs of
some milliseconds' work. It knows from one step to the next where its rows are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame

from retainlab.operators.hist_trees import (
    BLOCK_ROWS,
    Bins,
    Block,
    Growing,
    Tree,
    feature_cuts,
    histograms,
    midpoint_cuts,
    packed_columns,
    score_rows,
    summed,
    training_blocks,
    uniform,
)
from retainlab.session import checkpoint_dir


@dataclass(frozen=True)
class Settings:
    rounds: int
    rate: float
    max_leaves: int = 0
    max_depth: int = 0
    min_rows: int = 1
    min_hessian: float = 1e-3
    l1: float = 0.0
    l2: float = 0.0
    min_gain: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    seed: int = 42
    first_order: bool = False
    bootstrap: bool = False
    node_columns: int = 0
    min_split: int = 2


# --- fixed values: the modelled settings -----------------------------------
LEAF_WISE = Settings(rounds=500, rate=0.05, max_leaves=31, min_rows=20, l1=0.1, l2=0.1, rows=0.8, columns=0.8)
FIRST_ORDER = Settings(rounds=300, rate=0.03, max_depth=3, min_rows=10, rows=0.8, first_order=True)
SECOND_ORDER = Settings(rounds=800, rate=0.05, max_depth=4, min_hessian=1.0, l2=1.0, rows=0.9, columns=0.9)

#: Trees after which the margins of the blocks are written on, and how often
#: the blocks are then checkpointed.
REFRESH, CHECKPOINTS = 4, 20

#: Nodes whose histograms are added up in one task.
SLICE_NODES = 64


def soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def worth(sums: np.ndarray, s: Settings) -> np.ndarray:
    return soft(sums[..., 0], s.l1) ** 2 / (sums[..., 2 if s.first_order else 1] + s.l2 + 1e-12)


@dataclass
class Split:
    gain: float
    feature: int
    cut: int
    left: np.ndarray
    right: np.ndarray


def drawn_columns(hist: np.ndarray, bins: Bins, n: int, seed: list[int]) -> np.ndarray:
    """``n`` of the features with more than one value at the node."""
    varies = np.flatnonzero(np.add.reduceat(hist[:, 2] > 0.5, bins.starts) > 1)
    out = np.zeros(len(bins.starts), dtype=bool)
    out[np.random.default_rng(seed).permutation(varies)[:n]] = True
    return out


def best_split(hist: np.ndarray, bins: Bins, columns: np.ndarray, s: Settings) -> Split | None:
    """The cut of highest gain (ties: first feature, lowest cut), if any."""
    places = np.flatnonzero(bins.open & columns[bins.feature])
    if not len(places):
        return None
    run = np.concatenate([np.zeros((1, 3)), hist.cumsum(axis=0)])
    total = run[bins.sizes[0]]
    left = run[places + 1] - run[bins.first[places]]
    right = total - left
    able = np.minimum(left[:, 2], right[:, 2]) >= s.min_rows - 0.5
    able &= np.minimum(left[:, 1], right[:, 1]) >= s.min_hessian
    gain = worth(left, s) + worth(right, s) - worth(total, s)
    gain = np.where(able, gain, -np.inf)
    i = int(gain.argmax())
    if not gain[i] > max(s.min_gain, 1e-9):
        return None
    at = places[i]
    return Split(float(gain[i]), int(bins.feature[at]), int(bins.bin[at]), left[i], right[i])


@dataclass(frozen=True)
class Added:
    """A tree's values join the margin."""

    tree: Tree

    def __call__(self, b: Block) -> np.ndarray:
        return self.tree.predict(b.bins, binned=True)


@dataclass(frozen=True)
class Raised:
    """Log weights of the rows a tree misses go up by ``alpha``."""

    tree: Tree
    alpha: float

    def missed(self, b: Block) -> np.ndarray:
        return (self.tree.predict(b.bins, binned=True) > 0.5) != (b.y > 0.5)

    def __call__(self, b: Block) -> np.ndarray:
        return self.alpha * self.missed(b)


def margins(b: Block, recent: list) -> np.ndarray:
    out = b.margin.copy()
    for step in recent:
        out += step(b)
    return out


def logistic(b: Block, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    return b.w * (p - b.y), b.w * p * (1.0 - p)


def shares(b: Block, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = b.w * np.exp(margin)
    return w * b.y, w


def signs(b: Block, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return b.w * (1.0 - 2.0 * b.y), b.w


def residuals(b: Block, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = 2.0 * b.y - 1.0
    return -4.0 * b.w * y / (1.0 + np.exp(2.0 * y * margin)), b.w


#: shares of a Poisson(1) count up to 0, 1, ..
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def drawn_rows(b: Block, margin: np.ndarray, loss: Callable, salt: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients and hessians under a tree's draw of the rows, and which rows it took."""
    g, h = loss(b, margin)
    drawn = uniform(b.key, salt)
    if not s.bootstrap:
        return g, h, drawn < s.rows
    count = np.searchsorted(_POISSON, drawn, side="right")
    return g * count, h * count, count > 0


def node_histogram(columns: tuple[np.ndarray, int], at: np.ndarray, drawn: tuple[np.ndarray, np.ndarray, np.ndarray], shape: Tree, nodes: list[int], bins: Bins) -> np.ndarray:
    """(node, place, 3): sums of gradient, hessian and rows by bin, of rows at node ``at``."""
    g, h, taken = drawn
    slot = np.full(len(shape.feature), -1)
    slot[nodes] = np.arange(len(nodes))
    here = slot[at]
    keep = np.flatnonzero((here >= 0) & taken)
    return histograms(columns[0][:, keep], columns[1], here[keep], (g[keep], h[keep], None), len(nodes), bins)


def block_histogram(b: Block, recent: list, loss: Callable, shape: Tree, nodes: list[int], bins: Bins, salt: int, s: Settings) -> np.ndarray:
    drawn = drawn_rows(b, margins(b, recent), loss, salt, s)
    return node_histogram(packed_columns(b.bins, bins), shape.leaves(b.bins, binned=True), drawn, shape, nodes, bins)


class Spread:
    """Blocks on the executors; their margins are written on now and then."""

    def __init__(self, blocks: RDD, start: float, loss: Callable):
        self.recent: list = []
        self.loss, self.done, self.old = loss, 0, blocks
        self.blocks = _moved(blocks, start, [])

    def sums(self, of: Callable[[Block, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over blocks of an array of block and margins."""
        recent = self.recent
        got = summed(self.blocks, lambda b: of(b, margins(b, recent)))
        if self.old is not None:  # the new blocks have been read
            self.old.unpersist()
            self.old = None
        return got

    def histograms(self, *args) -> np.ndarray:
        recent, loss = self.recent, self.loss
        slices = min(-(-len(args[1]) // SLICE_NODES), self.blocks.getNumPartitions())
        got = summed(self.blocks, lambda b: block_histogram(b, recent, loss, *args), slices)
        if self.old is not None:
            self.old.unpersist()
            self.old = None
        return got

    def add(self, step: Callable[[Block], np.ndarray]) -> None:
        self.recent = [*self.recent, step]
        if len(self.recent) == REFRESH:
            self.blocks, self.old = _moved(self.blocks, 0.0, self.recent), self.blocks
            self.recent, self.done = [], self.done + 1
            if self.done % CHECKPOINTS == 0:
                self.blocks.checkpoint()

    def release(self) -> None:
        for rdd in (self.old, self.blocks):
            if rdd is not None:
                rdd.unpersist()


class Piece:
    """Some rows of a block at hand, with what the tree that grows knows of them."""

    def __init__(self, block: Block):
        self.block, self.columns, self.salt = block, None, None

    def histogram(self, loss: Callable, shape: Tree, nodes: list[int], bins: Bins, salt: int, s: Settings) -> np.ndarray:
        if self.columns is None:
            self.columns = packed_columns(self.block.bins, bins)
        if salt != self.salt:  # a new tree
            self.salt, self.at = salt, np.zeros(len(self.block.y), dtype=np.int32)
            self.drawn = drawn_rows(self.block, self.block.margin, loss, salt, s)
        while len(on := np.flatnonzero((shape.left != np.arange(len(shape.left)))[self.at])):
            node = self.at[on]
            left = self.block.bins[on, shape.feature[node]] <= shape.cut[node]
            self.at[on] = np.where(left, shape.left[node], shape.right[node])
        return node_histogram(self.columns, self.at, self.drawn, shape, nodes, bins)


class Together:
    """One block at hand, worked on in pieces."""

    def __init__(self, block: Block, start: float, loss: Callable):
        self.loss, margin = loss, block.margin + start
        cuts = [slice(i, i + BLOCK_ROWS) for i in range(0, max(len(block.y), 1), BLOCK_ROWS)]
        self.pieces = [Piece(Block(block.bins[c], block.y[c], block.w[c], block.key[c], margin[c])) for c in cuts]

    def sums(self, of: Callable[[Block, np.ndarray], np.ndarray]) -> np.ndarray:
        return sum(of(p.block, p.block.margin) for p in self.pieces)

    def histograms(self, *args) -> np.ndarray:
        return reduce(np.add, [p.histogram(self.loss, *args) for p in self.pieces])

    def add(self, step: Callable[[Block], np.ndarray]) -> None:
        for p in self.pieces:
            p.block.margin += step(p.block)
            p.salt = None


def grow(data: Spread | Together, bins: Bins, s: Settings, round_: int) -> Tree:
    rng = np.random.default_rng([s.seed, round_])
    width = len(bins.cuts)
    columns = np.zeros(width, dtype=bool)
    columns[rng.permutation(width)[: max(1, int(width * s.columns + 0.5))]] = True
    salt, shape = s.seed * 1_000_003 + round_, Growing()

    hists = {0: data.histograms(_routing(shape), [0], bins, salt, s)[0]}
    stats = {0: hists[0][: bins.sizes[0]].sum(axis=0)}
    plan: dict[int, Split] = {}
    children: dict[int, tuple[int, int]] = {}
    heap: list[tuple[float, int]] = []

    def open_leaf(node: int) -> None:
        if s.max_depth and shape.depth[node] >= s.max_depth:
            return
        if stats[node][2] < s.min_split - 0.5:
            return
        able = columns
        if s.node_columns:
            able = drawn_columns(hists[node], bins, s.node_columns, [s.seed, round_, node])
        found = best_split(hists[node], bins, able, s)
        if found:
            plan[node] = found
            heapq.heappush(heap, (-found.gain, node))

    open_leaf(0)
    kept: set[int] = set()
    leaves, most = 1, s.max_leaves or np.inf
    while heap and leaves < most:
        _, node = heap[0]
        if node not in children:
            # every open leaf that the splits left can reach, in one job
            reach = [i for _, i in sorted(heap)[: int(min(most - leaves, len(heap)))] if i not in children]
            wanted = []
            for i in reach:
                children[i] = shape.split(i, plan[i].feature, plan[i].cut)
                for child, part in zip(children[i], (plan[i].left, plan[i].right)):
                    stats[child] = part
                last = (s.max_depth and shape.depth[i] + 1 >= s.max_depth) or leaves + 1 >= most
                if not last:
                    wanted.append(children[i][int(plan[i].left[2] > plan[i].right[2])])
            if wanted:
                for child, h in zip(wanted, data.histograms(_routing(shape), wanted, bins, salt, s)):
                    hists[child] = h
                for i in reach:
                    a, b = children[i]
                    known = a if a in hists else b
                    if known in hists:
                        hists[b if known == a else a] = hists[i] - hists[known]
        heapq.heappop(heap)
        kept.add(node)
        leaves += 1
        for child in children[node]:
            if child in hists:
                open_leaf(child)
        hists.pop(node, None)
    value = {i: float(-s.rate * soft(t[0], s.l1) / (t[1] + s.l2 + 1e-12)) for i, t in stats.items()}
    return shape.frozen(bins.cuts, value, {i: float(t[2]) for i, t in stats.items()}, kept)


def _routing(shape: Growing) -> Tree:
    n = len(shape.feature)
    split = np.array(shape.feature) >= 0
    cut = np.where(split, shape.cut, np.iinfo(np.int32).max)
    none = np.zeros(0)
    return Tree(np.where(split, shape.feature, 0), cut, none, np.array(shape.left), np.array(shape.right), np.zeros(n), none, max(shape.depth))


@dataclass
class Boosted:
    """Trees added to a starting margin; ``score`` is a probability, the logistic
    of ``scale`` times the margin."""

    start: float
    trees: list[Tree]
    scale: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += t.predict(x)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.scale * self.margin(x)))


def _blocks(train: DataFrame, weight: Column, vec: str, label: str, key: str) -> tuple[RDD, Bins] | None:
    checkpoint_dir(train.sparkSession)
    cuts = feature_cuts(train, vec)
    if not cuts:
        return None
    bins = Bins(cuts)
    return training_blocks(train, bins, weight, vec, label, key), bins


def _run(blocks: RDD, start: float, loss: Callable, loop: Callable):
    """The fit's loop over the blocks, or inside the task that holds the only one."""
    if blocks.getNumPartitions() == 1:
        out = blocks.mapPartitions(lambda it: (loop(Together(b, start, loss)) for b in it)).collect()[0]
        blocks.unpersist()
        return out
    data = Spread(blocks, start, loss)
    out = loop(data)
    data.release()
    return out


def fit_boosted(train: DataFrame, s: Settings, weight: Column, vec: str = "features", label: str = "label", key: str = "k") -> Boosted:
    """Fit on rows with a feature vector, a 0 / 1 label and a key. No rows or
    one class only: no trees."""
    made = _blocks(train, weight, vec, label, key)
    if made is None:
        return Boosted(0.0, [])
    blocks, bins = made
    neg, pos = summed(blocks, lambda b: np.array([(b.w * (1 - b.y)).sum(), (b.w * b.y).sum()]))
    if not neg or not pos:
        blocks.unpersist()
        return Boosted(float(np.sign(pos - neg) * 30.0), [])
    start = float(np.log(pos / neg))

    def loop(data: Spread | Together) -> list[Tree]:
        trees = []
        for i in range(s.rounds):
            trees.append(grow(data, bins, s, i))
            data.add(Added(trees[-1]))
        return trees

    return Boosted(start, _run(blocks, start, logistic, loop))


def fit_residual_trees(train: DataFrame, rounds: int, rate: float, max_depth: int, weight: Column, bins: int = 32,
                       vec: str = "features", label: str = "label", key: str = "k") -> Boosted:
    """Gradient-boosted regression trees as MLlib fits them, without draws: the
    first tree fits the labels (-1, 1), the others, by ``rate``, the residuals of
    the loss 2 log(1 + exp(-2 y f)); leaves hold means, cuts are MLlib's."""
    checkpoint_dir(train.sparkSession)
    cuts = midpoint_cuts(train, weight, vec, bins)
    if not cuts:
        return Boosted(0.0, [], 2.0)
    made = Bins(cuts)
    s = Settings(rounds=rounds, rate=rate, max_depth=max_depth, min_hessian=0.0)

    def loop(data: Spread | Together) -> list[Tree]:
        trees = []
        for i in range(rounds):
            trees.append(grow(data, made, s if i else replace(s, rate=1.0), i))
            data.add(Added(trees[-1]))
            data.loss = residuals
        return trees

    return Boosted(0.0, _run(training_blocks(train, made, weight, vec, label, key), 0.0, signs, loop), 2.0)


@dataclass
class Ada:
    """Trees with their say; ``score`` is the logistic of the mean vote."""

    trees: list[Tree]
    says: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        vote = np.zeros(len(x))
        for t, a in zip(self.trees, self.says):
            vote += a * np.where(t.predict(x) > 0.5, 1.0, -1.0)
        return 1.0 / (1.0 + np.exp(-vote / (sum(self.says) or 1.0)))


def fit_adaboost(train: DataFrame, class_weight: Column, rounds: int = 300, rate: float = 0.5, max_depth: int = 3,
                 vec: str = "features", label: str = "label", key: str = "k") -> Ada:
    """Binary SAMME; a tree without error ends the fit and decides alone with
    those before it, one no better than chance ends it unused."""
    made = _blocks(train, class_weight, vec, label, key)
    if made is None:
        return Ada([], [])
    blocks, bins = made
    s = Settings(rounds=rounds, rate=-1.0, max_depth=max_depth)

    def loop(data: Spread | Together) -> Ada:
        out = Ada([], [])
        for i in range(rounds):
            tree = grow(data, bins, s, i)
            missed = Raised(tree, 0.0).missed
            wrong, whole = data.sums(lambda b, m: np.array([(np.exp(m) * missed(b)).sum(), np.exp(m).sum()]))
            error = wrong / whole
            if error >= 0.5:
                break
            out.trees.append(tree)
            out.says.append(rate * float(np.log((1 - error) / error)) if error > 0 else 1.0)
            if error <= 0:
                break
            # weights are kept as they are: their common factor cancels
            data.add(Raised(tree, out.says[-1]))
        return out

    return _run(blocks, 0.0, shares, loop)


def _moved(blocks: RDD, by: float, recent: list) -> RDD:
    def move(b: Block) -> Block:
        return Block(b.bins, b.y, b.w, b.key, margins(b, recent) + by)

    return blocks.map(move).persist(StorageLevel.MEMORY_AND_DISK)


def score_boosted(df: DataFrame, model: Boosted, vec: str = "features") -> DataFrame:
    return score_rows(df, model.score, vec)
