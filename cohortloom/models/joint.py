"""Gradient-boosted trees for several classes and several training sets in common passes.

The objective is one softmax over all classes. A model is a training set (all rows, or all but one fold) over a
range of the feature columns; all models grow their trees together:

* Features are cut into at most ``bins`` bins at quantiles, once for all models.
* A round adds a tree per model and class. For each level of these trees one pass over the rows adds up gradients and
  second derivatives per (model, class, node, feature, bin). The sums of a model and class meet in one task, which reads
  the split with the largest second-order gain of each node off them. The pass also sums the loss of each model.
* Rows are dealt to the models that train on them. Margins stay with the rows (``resident``), and are moved by the
  finished trees once a round.

The gradients of a fold's training set depend on its own margins, so its sums are not those of all rows less the held-out ones; each
model has its own copy of its rows' bins and margins. A model whose rows and state fit in ``MODEL_BYTES``, with up to ``MODEL_ROWS``
rows, grows all its rounds in one task (``alone``): one job fits all models, and gradients and the nodes of rows are kept from level to
level. Larger ones have a job for each level.

What the driver gets is a few numbers for each (model, class, node), whatever the number of rows and features; a task holds classes x
nodes of one level x features x bins of one model. From models that grow alone it gets their trees, compressed. Missing values count as below every cut. The
leaf value is the step times -G / (H + ridge); a split needs ``child_weight`` of H on each side.
"""

from __future__ import annotations

import json
import pickle
import sys
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import named, quoted
from cohortloom.models.kernels import batch_matrix
from cohortloom.models.resident import Resident
from cohortloom.operators.columns import feature_vector

# Tasks get this module's functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A split must gain more than this.
LEAST_GAIN = 1e-6
#: Gains closer than this share are equal.
SAME = 1e-9
#: Most rows of a model that grows in one task, and most bytes of its rows and their state.
MODEL_ROWS = 2_000_000
MODEL_BYTES = 256 << 20
#: Of larger models: most rows in a partition, rows that are worth a partition where cores would idle; and most rows in a block.
PART_ROWS = 100_000
SHARE_ROWS = 20_000
BLOCK_ROWS = 16_384


@dataclass
class Settings:
    rounds: int = 100
    depth: int = 6
    step: float = 0.3
    bins: int = 64
    ridge: float = 1.0
    child_weight: float = 1.0
    balanced: bool = False


@dataclass
class Trees:
    """A fitted model: per round and class a full binary tree. ``feature`` is -1 at leaves; rows above cut number ``cut`` go right."""

    cuts: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0))
    splits: np.ndarray = field(default_factory=lambda: np.zeros(0))
    losses: list[float] = field(default_factory=list)

    def importance(self) -> np.ndarray:
        """Mean gain per split of each feature, scaled to sum 1."""
        mean = np.divide(self.gain, self.splits, out=np.zeros_like(self.gain), where=self.splits > 0)
        return mean / mean.sum() if mean.sum() > 0 else np.full(len(mean), 1.0 / max(1, len(mean)))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        binned = to_bins(x, self.cuts)
        margin = np.zeros((self.feature.shape[1], len(x)))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            margin += np.take_along_axis(value, route(binned, feature, cut), axis=1)
        return softmax(margin).T


def to_bins(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """How many cuts lie below each value."""
    out = np.empty(x.shape, dtype=np.uint8)
    for k, c in enumerate(cuts):
        out[:, k] = np.where(np.isnan(x[:, k]), 0, np.searchsorted(c, x[:, k], side="left"))
    return out


def softmax(margin: np.ndarray) -> np.ndarray:
    """Over the last axis but one."""
    power = np.exp(margin - margin.max(axis=-2, keepdims=True))
    return power / power.sum(axis=-2, keepdims=True)


def route(binned: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node that each row ends in, for trees given as rows of ``feature`` and ``cut``; trees x rows."""
    row = np.arange(len(binned))[None, :]
    node = np.zeros((len(feature), len(binned)), dtype=np.int64)
    depth = int(np.log2(feature.shape[1] + 1))
    for _ in range(depth):
        inner = np.minimum(node, feature.shape[1] - 1)
        f = np.take_along_axis(feature, inner, axis=1)
        moves = (f >= 0) & (node < feature.shape[1])
        if not moves.any():
            break
        right = binned[row, np.maximum(f, 0)] > np.take_along_axis(cut, inner, axis=1)
        node = np.where(moves, 2 * node + 1 + right, node)
    return node


def block_of(cuts: Sequence[np.ndarray]):
    def make(batch: pa.RecordBatch) -> dict:
        binned = to_bins(batch_matrix(batch, "x"), cuts)
        code, fold = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("code", "fold"))
        return {"bins": binned, "code": code, "fold": fold}

    return make


def of_models(columns: Sequence[tuple[int, int]], held: np.ndarray, shares: int, parts: int):
    """The rows and columns that each model trains on, in ``shares`` pieces; all pieces in order fill ``parts`` partitions."""
    def pieces(block: dict):
        for m, (lo, hi) in enumerate(columns):
            mine = np.flatnonzero(block["fold"] != held[m])
            for r in range(shares):
                rows, place = mine[r::shares], m * shares + r
                if len(rows):
                    yield (place * parts // (len(columns) * shares), place), {
                        "model": m, "bins": block["bins"][rows, lo:hi], "code": block["code"][rows]}

    return pieces


def model_of(block: dict) -> int:
    return block["model"]


def with_margins(classes: int):
    """Neighbouring pieces of a model as blocks of up to ``BLOCK_ROWS``, with margins of zero."""
    def whole(kept: list[dict]) -> dict:
        code = np.concatenate([b["code"] for b in kept])
        return {"model": kept[0]["model"], "bins": np.concatenate([b["bins"] for b in kept]), "code": code,
                "margin": np.zeros((classes, len(code)))}

    def run(found: Iterator[dict]) -> Iterator[dict]:
        kept, size = [], 0
        for piece in found:
            if kept and (piece["model"] != kept[0]["model"] or size + len(piece["code"]) > BLOCK_ROWS):
                yield whole(kept)
                kept, size = [], 0
            kept.append(piece)
            size += len(piece["code"])
        if kept:
            yield whole(kept)

    return run


def moved(feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
    """The block after a round's trees (models x classes x nodes)."""
    def step(block: dict) -> dict:
        m = block["model"]
        return {**block, "margin": block["margin"] + np.take_along_axis(value[m], route(block["bins"], feature[m], cut[m]), axis=1)}

    return step


def slopes(margin: np.ndarray, code: np.ndarray, weight: np.ndarray):
    """(loss of the rows, gradients by class, second derivatives by class)."""
    p, mine = softmax(margin), weight[code]
    loss = -np.log(np.maximum(p[code, np.arange(len(code))], 1e-300)) * mine
    g = (p - (code == np.arange(len(p))[:, None])) * mine
    return loss, g, np.maximum(2.0 * p * (1.0 - p), 1e-16) * mine


def level_sums(feature: np.ndarray, cut: np.ndarray, level: int, weights: np.ndarray, bins: int):
    """Sums of one level of a block's model, a row for each class: the loss of the class' rows, then per (feature, node, bin) of
    gradients and of second derivatives."""
    def of(block: dict) -> np.ndarray:
        code, binned, m = block["code"], block["bins"], block["model"]
        nodes, width = 2**level, binned.shape[1]
        loss, grad, second = slopes(block["margin"], code, weights[m])
        node = route(binned, feature[m], cut[m]) - (2**level - 1)
        out = np.empty((len(grad), 1 + width * 2 * nodes * bins))
        for c in range(len(grad)):
            use = np.flatnonzero(node[c] >= 0)
            g, h = grad[c][use], second[c][use]
            base, mine, at = node[c][use] * bins, binned[use], 1
            out[c, 0] = loss[code == c].sum()
            for k in range(width):
                cell = base + mine[:, k]
                for values in (g, h):
                    out[c, at:at + nodes * bins] = np.bincount(cell, values, nodes * bins)
                    at += nodes * bins
        return out

    return of


def split_of(level: int, s: Settings):
    """From a row of ``level_sums``: the loss, then seven numbers of each node: gain, feature, bin and left and whole sums."""
    def finish(row: np.ndarray) -> np.ndarray:
        sums = row[1:].reshape(-1, 2, 1, 2**level, s.bins)
        g, h = sums[:, 0], sums[:, 1]
        found = [*best_splits(g, h, s), g[0].sum(axis=2), h[0].sum(axis=2)]
        return np.concatenate([row[:1], *[np.asarray(v[0], dtype=np.float64) for v in found]])

    return finish


def best_splits(g: np.ndarray, h: np.ndarray, s: Settings):
    """(gain, feature, bin, left sums) of every (class, node), from sums per (feature, class, node, bin)."""
    left_g, left_h = g.cumsum(axis=3)[..., :-1], h.cumsum(axis=3)[..., :-1]
    all_g, all_h = g.sum(axis=3)[..., None], h.sum(axis=3)[..., None]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + s.ridge) + right_g**2 / (right_h + s.ridge) - all_g**2 / (all_h + s.ridge)
    gain = np.where((left_h >= s.child_weight) & (right_h >= s.child_weight), gain, -np.inf)
    features, classes, nodes, cuts = gain.shape
    flat = gain.transpose(1, 2, 0, 3).reshape(classes, nodes, features * cuts)
    # of gains that differ by rounding only the first counts, whatever the order of the sums
    top = flat.max(axis=2)
    best = (flat >= (top - SAME * np.abs(top))[..., None]).argmax(axis=2)
    f, b = best // cuts, best % cuts
    c, n = np.indices((classes, nodes))
    return top, f, b, left_g[f, c, n, b], left_h[f, c, n, b]


def _grow(blocks: list[dict], weight: np.ndarray, s: Settings) -> dict:
    """All rounds of a model whose rows are ``blocks``; sums are added up block by block, as ``level_sums`` of them would be."""
    classes, width = len(blocks[0]["margin"]), blocks[0]["bins"].shape[1]
    inner, whole = 2**s.depth - 1, 2 ** (s.depth + 1) - 1
    columns = [np.ascontiguousarray(b["bins"].T) for b in blocks]
    feature, cut = np.full((s.rounds, classes, inner), -1, np.int16), np.zeros((s.rounds, classes, inner), np.uint8)
    value, gains, splits, losses = np.zeros((s.rounds, classes, whole)), np.zeros(width), np.zeros(width), np.zeros(s.rounds)
    for r in range(s.rounds):
        now = [slopes(b["margin"], b["code"], weight) for b in blocks]
        for c in range(classes):
            losses[r] += sum(loss[b["code"] == c].sum() for b, (loss, _, _) in zip(blocks, now))
            # of the rows that are in a node of this level: their numbers, places among these nodes, bins and slopes
            open_ = [(np.arange(bins.shape[1]), np.zeros(bins.shape[1], np.int64), bins, g[c], h[c]) for bins, (_, g, h) in zip(columns, now)]
            ends = [np.zeros(bins.shape[1], np.int64) for bins in columns]
            nodes = np.zeros(1, np.int64)
            for level in range(s.depth):
                total, cells = None, len(nodes) * s.bins
                for _, place, bins, g, h in open_:
                    sums, base = np.empty((width, 2, cells)), place * s.bins
                    for k in range(width):
                        cell = base + bins[k]
                        sums[k, 0], sums[k, 1] = np.bincount(cell, g, cells), np.bincount(cell, h, cells)
                    if total is None:
                        total = sums
                    else:
                        total += sums
                total = total.reshape(width, 2, 1, len(nodes), s.bins)
                gain, f, b, left_g, left_h = (v[0] for v in best_splits(total[:, 0], total[:, 1], s))
                all_g, all_h = total[0, 0, 0].sum(axis=1), total[0, 1, 0].sum(axis=1)
                if level == 0:
                    value[r, c, 0] = -s.step * all_g[0] / (all_h[0] + s.ridge)
                split = gain > LEAST_GAIN
                if not split.any():
                    break
                at = nodes[split]
                feature[r, c, at], cut[r, c, at] = f[split], b[split]
                value[r, c, 2 * at + 1] = (-s.step * left_g / (left_h + s.ridge))[split]
                value[r, c, 2 * at + 2] = (-s.step * (all_g - left_g) / (all_h - left_h + s.ridge))[split]
                np.add.at(gains, f[split], gain[split])
                np.add.at(splits, f[split], 1)
                left = 2 * np.cumsum(split) - 2
                for i, (rows, place, bins, g, h) in enumerate(open_):
                    if not split.all():
                        stays = np.flatnonzero(split[place])
                        rows, place, bins, g, h = rows[stays], place[stays], np.take(bins, stays, axis=1), g[stays], h[stays]
                    right = bins.ravel()[f[place] * len(rows) + np.arange(len(rows))] > b[place]
                    ends[i][rows] = 2 * nodes[place] + 1 + right
                    open_[i] = rows, left[place] + right, bins, g, h
                nodes = np.ravel([2 * at + 1, 2 * at + 2], order="F")
            for block, end in zip(blocks, ends):
                # slopes were taken of all classes before
                block["margin"][c] += value[r, c][end]
    return {"feature": feature, "cut": cut, "value": value, "gain": gains, "splits": splits, "losses": losses}


def alone(weights: np.ndarray, s: Settings):
    """(model, its trees as compressed bytes) of neighbouring blocks that hold all rows of a model."""
    def run(blocks: Iterator[dict]) -> Iterator[tuple[int, bytes]]:
        for m, mine in groupby(blocks, model_of):
            yield m, zlib.compress(pickle.dumps(_grow(list(mine), weights[m], s), protocol=5), 1)

    return run


def fit_alone(state: Resident, columns: Sequence[tuple[int, int]], held: np.ndarray, cuts: list[np.ndarray], weights: np.ndarray,
              s: Settings) -> list[Trees]:
    """The trees of models that fit in a task each."""
    n_models, classes = weights.shape
    try:
        state.deal(of_models(columns, held, 1, n_models), n_models, with_margins(classes))
        found = {m: pickle.loads(zlib.decompress(blob)) for m, blob in state.blocks.mapPartitions(alone(weights, s)).collect()}
    finally:
        state.drop()
    fitted = []
    for m, (lo, hi) in enumerate(columns):
        inner, none = 2**s.depth - 1, np.zeros(hi - lo)
        t = found.get(m) or {"feature": np.full((s.rounds, classes, inner), -1), "cut": np.zeros((s.rounds, classes, inner)),
                             "value": np.zeros((s.rounds, classes, 2 * inner + 1)), "gain": none, "splits": none, "losses": np.zeros(s.rounds)}
        fitted.append(Trees(cuts[lo:hi], t["feature"].astype(np.int64), t["cut"].astype(np.int64), t["value"], t["gain"], t["splits"],
                            [float(v) for v in t["losses"]]))
    return fitted


def _to_array(kind, values: Sequence):
    gateway = SparkContext._gateway
    array = gateway.new_array(kind, len(values))
    for k, v in enumerate(values):
        array[k] = v
    return array


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 distinct cuts of each feature."""
    if not 2 <= bins <= 256:
        raise ValueError("bins must be between 2 and 256")
    plain = df.selectExpr(*[f"CAST({quoted(f)} AS DOUBLE) AS f{i}" for i, f in enumerate(features)])
    jvm = df.sparkSession._jvm
    shares = [i / bins for i in range(1, bins)]
    found = plain._jdf.stat().approxQuantile(_to_array(jvm.java.lang.String, plain.columns), _to_array(jvm.double, shares), 0.1 / bins)
    # a text for each feature: each number would be a call to the JVM
    found = [json.loads(jvm.java.util.Arrays.toString(values)) for values in found]
    return [np.unique(np.array(values, dtype=np.float64)) for values in found]


def fit_jointly(df: DataFrame, features: Sequence[str], code: str, classes: int, models: Sequence[tuple[int, int, int]],
                settings: Settings, fold: str | None = None) -> list[Trees]:
    """Fit each model (first feature, last feature + 1, held-out fold or -1) on rows of ``df`` with class numbers ``code``."""
    s, n_models = settings, len(models)
    columns, held = [(lo, hi) for lo, hi, _ in models], np.array([f for *_, f in models])
    kept = named(fold).cast("long") if fold else F.lit(-2).cast("long")
    rows = df.select(feature_vector(features, clip=False).alias("x"), named(code).cast("long").alias("code"), kept.alias("fold"))
    counts = np.zeros((n_models, classes))
    for r in rows.groupBy("fold", "code").count().collect():
        counts[held != r["fold"], r["code"]] += r["count"]
    weights = np.ones((n_models, classes))
    if s.balanced:
        weights = counts.sum(axis=1, keepdims=True) / (classes * np.maximum(counts, 1.0))
    cuts = quantile_cuts(df, features, s.bins)
    size, cores = int(counts.sum(axis=1).max(initial=0)), df.sparkSession.sparkContext.defaultParallelism
    state = Resident(rows, block_of(cuts))
    # a row's bins, class, number and place, and for each class margin, slopes, probability and end
    row_bytes = 2 * max((hi - lo for lo, hi in columns), default=0) + 24 + 48 * classes
    if size <= min(MODEL_ROWS, MODEL_BYTES // row_bytes):
        return fit_alone(state, columns, held, cuts, weights, s)
    per_part = min(PART_ROWS, MODEL_ROWS)
    shares = max(1, -(-size // per_part), min(cores // n_models, size // SHARE_ROWS))
    parts = min(n_models * shares, max(2 * cores, -(-n_models * size // per_part)))
    state.deal(of_models(columns, held, shares, parts), parts, with_margins(classes))
    inner, whole = 2**s.depth - 1, 2 ** (s.depth + 1) - 1
    grown, gains, splits = [], np.zeros((n_models, len(features))), np.zeros((n_models, len(features)))
    losses = []
    try:
        for _ in range(s.rounds):
            feature = np.full((n_models, classes, inner), -1, dtype=np.int64)
            cut, value = np.zeros_like(feature), np.zeros((n_models, classes, whole))
            for level in range(s.depth):
                nodes, first = 2**level, 2**level - 1
                shown = 2**level - 1 if level else 1
                found = state.reduced(level_sums(feature[..., :shown], cut[..., :shown], level, weights, s.bins), model_of,
                                      split_of(level, s), classes, n_models, shares == 1)
                if level == 0:
                    losses.append(np.zeros(n_models))
                any_split = False
                for (m, c), row in sorted(found.items()):
                    gain, f, b, left_g, left_h, all_g, all_h = row[1:].reshape(7, nodes)
                    if level == 0:
                        losses[-1][m] += row[0]
                        value[m, c, 0] = -s.step * all_g[0] / (all_h[0] + s.ridge)
                    lo = columns[m][0]
                    for n in np.flatnonzero(gain > LEAST_GAIN):
                        node, k, any_split = first + n, int(f[n]), True
                        feature[m, c, node], cut[m, c, node] = k, int(b[n])
                        value[m, c, 2 * node + 1] = -s.step * left_g[n] / (left_h[n] + s.ridge)
                        value[m, c, 2 * node + 2] = -s.step * (all_g[n] - left_g[n]) / (all_h[n] - left_h[n] + s.ridge)
                        gains[m, lo + k] += gain[n]
                        splits[m, lo + k] += 1
                if not any_split:
                    break
            grown.append((feature, cut, value))
            state.advance(moved(feature, cut, value))
    finally:
        state.drop()
    fitted = []
    for m, (lo, hi) in enumerate(columns):
        fitted.append(Trees(cuts[lo:hi], np.array([f[m] for f, _, _ in grown]), np.array([c[m] for _, c, _ in grown]),
                            np.array([v[m] for _, _, v in grown]), gains[m, lo:hi], splits[m, lo:hi], [float(v[m]) for v in losses]))
    return fitted
