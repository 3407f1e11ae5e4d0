"""Small numpy steps run inside tasks on one Arrow batch at a time."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Tasks get this module's functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EPS = np.finfo(np.float64).eps
#: Rows of a topic step at a time.
CACHED_ROWS = 2048


def batch_matrix(batch: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    """An array<double> column as a dense matrix; missing entries are NaN."""
    values = batch.column(batch.schema.get_field_index(column))
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def as_list_column(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, max(matrix.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def digamma(x: np.ndarray) -> np.ndarray:
    """psi(x) for x > 0: shift by 6, then the asymptotic series."""
    x = np.asarray(x, dtype=np.float64)
    # 1/x + ... + 1/(x + 5), in pairs that share the product t = x (x + 5)
    t = x * (x + 5.0)
    u, v = t + 4.0, t + 6.0
    both = u * v
    shift = (2.0 * x + 5.0) * (both + t * (u + v)) / (t * both)
    x = x + 6.0
    inv = 1.0 / x
    sq = inv * inv
    series = sq * (1 / 12.0 - sq * (1 / 120.0 - sq * (1 / 252.0 - sq * (1 / 240.0 - sq * (1 / 132.0)))))
    return np.log(x) - 0.5 * inv - series - shift


def exp_digamma(x: np.ndarray, out: np.ndarray, t: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """exp(psi(x)) for x > 0 into ``out``, by the same shift as ``digamma`` and the series around x + 5.5; t, u and v are scratch."""
    np.add(x, 5.0, out=t)
    t *= x
    np.add(t, 4.0, out=u)
    np.add(t, 6.0, out=v)
    np.add(u, v, out=out)
    out *= t
    u *= v
    out += u
    t *= u
    np.add(x, 2.5, out=v)
    out *= v
    out /= t
    out *= 2.0
    # psi(y + 1/2) = log(y) + 1 / (24 y^2) - ..., so no logarithm is needed
    np.add(x, 5.5, out=v)
    np.multiply(v, v, out=u)
    np.reciprocal(u, out=u)
    np.multiply(u, -1414477 / 67092480, out=t)
    for c in (511 / 67584, -127 / 30720, 31 / 8064, -7 / 960, 1 / 24):
        t += c
        t *= u
    t -= out
    np.exp(t, out=out)
    out *= v
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x > 0: shift up to 8, then Stirling's series."""
    x = np.array(x, dtype=np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8.0
        if not low.any():
            break
        shift[low] -= np.log(x[low])
        x[low] += 1.0
    inv = 1.0 / x
    sq = inv * inv
    series = inv * (1 / 12.0 - sq * (1 / 360.0 - sq * (1 / 1260.0 - sq / 1680.0)))
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series


def dirichlet_log_mean(a: np.ndarray) -> np.ndarray:
    """E[log p] under Dirichlet(a), row by row."""
    return digamma(a) - digamma(a.sum(axis=1))[:, None]


def topic_posterior(x: np.ndarray, word: np.ndarray, alpha: float, steps: int = 100, tol: float = 1e-3, start: np.ndarray | None = None):
    """Variational Dirichlet parameters of every row of ``x``.

    ``word`` is exp(E[log beta]), topics x features. Rows stop on their own
    once their parameters move less than ``tol`` on average. They begin at
    ``start``, or at ones. Rows are taken a few thousand at a time, so that
    the work of a step stays near the processor.
    """
    rows, topics = x.shape[0], word.shape[0]
    gamma = np.ones((rows, topics)) if start is None else start.copy()
    for lo in range(0, rows, CACHED_ROWS):
        _settle_rows(x[lo:lo + CACHED_ROWS], word, alpha, steps, tol, gamma[lo:lo + CACHED_ROWS])
    return gamma


def _settle_rows(x: np.ndarray, word: np.ndarray, alpha: float, steps: int, tol: float, gamma: np.ndarray) -> None:
    """The steps of ``topic_posterior``, in place; rows that have stopped are left out once they are a fifth.

    The weights of a row are not scaled to exp(psi(gamma) - psi(sum)), as the scale cancels; only ``EPS`` is scaled by it.
    """
    # topics x rows, so that sums over topics add up whole rows of the array; all steps work in the same memory
    topics, place = len(word), np.arange(len(x))
    memory, wide = [np.empty(gamma.size) for _ in range(6)], np.empty(x.size)
    narrow = [np.empty(len(x)) for _ in range(5)]

    def views(n: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
        return [m[:topics * n].reshape(topics, n) for m in memory], wide[:n * x.shape[1]].reshape(n, -1), [m[:n] for m in narrow]

    (now, new, weight, *spare), share, (total, scale, *rest) = views(len(x))
    now[:] = gamma.T
    open_ = np.ones(len(x), dtype=bool)
    for _ in range(steps):
        exp_digamma(now, weight, *spare)
        np.add.reduce(now, axis=0, out=total)
        exp_digamma(total, scale, *rest)
        scale *= EPS
        np.matmul(weight.T, word, out=share)
        share += scale[:, None]
        np.divide(x, share, out=share)
        np.matmul(word, share.T, out=new)
        new *= weight
        new += alpha
        moved = spare[0]
        np.subtract(now, new, out=moved)
        np.abs(moved, out=moved)
        gone = open_ & (np.add.reduce(moved, axis=0) / topics < tol)
        now, new = new, now
        if gone.any():
            gamma[place[gone]] = now[:, gone].T
            open_ &= ~gone
            left = int(open_.sum())
            if not left:
                return
            if left <= 0.8 * len(place):
                kept = now[:, open_]
                x, place, open_ = x[open_], place[open_], np.ones(left, dtype=bool)
                (now, new, weight, *spare), share, (total, scale, *rest) = views(left)
                now[:] = kept
    gamma[place[open_]] = now[:, open_].T


def topic_block(batch: pa.RecordBatch) -> dict:
    """A block of rows for topic fits: the matrix, and no posteriors yet."""
    return {"x": batch_matrix(batch, "x"), "posterior": {}, "sums": {}}


def topic_pass(words: dict, alphas: dict, steps: int, tol: float, warm: bool):
    """One pass over a block for several fits at once: posteriors go on from the last pass, sums are topics x features."""
    def step(block: dict) -> dict:
        x, made, sums = block["x"], {}, {}
        for k, word in words.items():
            start = block["posterior"].get(k) if warm else None
            gamma, total = topic_posterior(x, word, alphas[k], steps, tol, start), np.zeros_like(word)
            for lo in range(0, len(x), CACHED_ROWS):
                weight = np.exp(dirichlet_log_mean(gamma[lo:lo + CACHED_ROWS]))
                total += weight.T @ (x[lo:lo + CACHED_ROWS] / (weight @ word + EPS))
            sums[k] = total * word
            if warm:
                made[k] = gamma
        return {"x": x, "posterior": made, "sums": sums}

    return step


def topic_sums(block: dict) -> np.ndarray:
    return np.concatenate([s.ravel() for s in block["sums"].values()])


def topic_update(lam: np.ndarray, sums: np.ndarray, beta: float, tol: float) -> tuple[np.ndarray, bool]:
    """(topic parameters after a pass, whether they moved less than ``tol``)."""
    new = beta + sums.reshape(lam.shape)
    return new, float(np.abs(new - lam).mean() / max(np.abs(lam).mean(), 1e-300)) < tol


def topic_fit(x: np.ndarray, lam: np.ndarray, alpha: float, beta: float, max_iter: int, tol: float, settle: tuple) -> tuple:
    """All passes of one fit where ``x`` has all rows: (topic parameters, whether converged, mass after each pass)."""
    block, done, mass = {"x": x, "posterior": {}}, False, []
    while not done and len(mass) < max_iter:
        block = topic_pass({0: np.exp(dirichlet_log_mean(lam))}, {0: alpha}, *settle)(block)
        lam, done = topic_update(lam, block["sums"][0], beta, tol)
        mass.append(float(lam.sum()))
    return lam, done, mass


def topic_bound(
    x: np.ndarray, word_log: np.ndarray, word: np.ndarray, alpha: float, steps: int = 100, tol: float = 1e-3
) -> float:
    """The per-row part of the variational bound, summed over a batch."""
    gamma = topic_posterior(x, word, alpha, steps, tol)
    theta_log = dirichlet_log_mean(gamma)
    score = 0.0
    # log sum_k exp(theta + beta), stably and for a few hundred rows at a time
    for lo in range(0, len(x), 256):
        joint = theta_log[lo : lo + 256, :, None] + word_log[None, :, :]
        top = joint.max(axis=1)
        token = np.log(np.exp(joint - top[:, None, :]).sum(axis=1)) + top
        score += float((x[lo : lo + 256] * token).sum())
    topics = word.shape[0]
    score += float(((alpha - gamma) * theta_log).sum())
    score += float((log_gamma(gamma) - log_gamma(np.full_like(gamma, alpha))).sum())
    total = np.full(len(x), alpha * topics)
    return score + float((log_gamma(total) - log_gamma(gamma.sum(axis=1))).sum())


def nonnegative_weights(x: np.ndarray, h: np.ndarray, sweeps: int = 500, tol: float = 1e-8) -> np.ndarray:
    """Row-wise non-negative least squares of ``x`` on fixed patterns ``h``.

    Cyclic coordinate steps over topics, all rows of the batch at once.
    """
    gram = h @ h.T
    cross = x @ h.T
    w = np.zeros((len(x), len(h)))
    scale = max(float(np.abs(cross).max()) if cross.size else 0.0, 1e-300)
    for _ in range(sweeps):
        moved = 0.0
        for k in range(len(h)):
            if gram[k, k] <= 0.0:
                continue
            step = (cross[:, k] - w @ gram[:, k]) / gram[k, k]
            new = np.maximum(w[:, k] + step, 0.0)
            if len(new):
                moved = max(moved, float(np.abs(new - w[:, k]).max()) * gram[k, k])
            w[:, k] = new
        if moved <= tol * scale:
            break
    return w
