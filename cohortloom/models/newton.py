"""Multinomial logistic regression of all folds at once, by Newton's method.

The models of a fit differ only in the fold they leave out, so one pass over the rows gives the loss, gradient and
Hessian of all of them; the driver solves one small system a model. Passes: about ten, whatever the number of folds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.rowwise import double_of, nan_to_null, named
from cohortloom.models.common import fit_input, sum_over_rows
from cohortloom.runtime import bounded_rows

# A model is finished when a full step would lower its loss by less than this share of it.
DECREMENT = 1e-14
# A step is halved until the loss falls by at least this share of what its slope promises.
SLOPE_SHARE = 1e-4
MAX_FOLDS = 10_000


@dataclass
class Softmax:
    """One fitted model; ``coefficients`` are classes x features on the scaled features."""

    center: list[float]
    scale: list[float]
    coefficients: list[list[float]]
    intercepts: list[float]
    loss: float
    steps: int
    converged: bool
    losses: list[float] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)

    def raw(self) -> list[float]:
        """Per class the weights of the unscaled features and then the intercept, in one list."""
        w = np.array(self.coefficients) / np.array(self.scale)
        b = np.array(self.intercepts) - w @ np.array(self.center)
        return np.concatenate([w, b[:, None]], axis=1).ravel().tolist()


def fold_scales(rows: DataFrame, width: int, n_folds: int, n_classes: int):
    """Per model (n, mean, population std, class counts); model ``n_folds`` leaves nothing out.

    One aggregate gives the moments of every fold; those of the other folds are merged, never
    subtracted, so that nothing cancels. ``rows`` has (code, fold, features...) in its array ``x``.
    """
    cells = rows.select(F.get("x", F.lit(1)).alias("fold"), F.posexplode("x").alias("pos", "v"))
    moments = cells.filter("pos > 1").groupBy("fold", "pos").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var")
    )
    n, mean, square = np.zeros((3, n_folds, width))
    for r in bounded_rows(moments, MAX_FOLDS * 100, "moments per fold and feature"):
        at = int(r["fold"]), r["pos"] - 2
        n[at], mean[at], square[at] = r["n"], r["mean"], r["var"] * r["n"]
    counts = np.zeros((n_folds, n_classes))
    coded = rows.select(F.get("x", F.lit(0)).alias("code"), F.get("x", F.lit(1)).alias("fold"))
    for r in bounded_rows(coded.groupBy("fold", "code").count(), MAX_FOLDS * 100, "classes per fold"):
        counts[int(r["fold"]), int(r["code"])] = r["count"]
    out = []
    for left_out in range(n_folds + 1):
        kept = [f for f in range(n_folds) if f != left_out]
        size = n[kept].sum(axis=0)
        if not kept or not size.any():
            out.append((0.0, np.zeros(width), np.ones(width), np.zeros(n_classes)))
            continue
        middle = (n[kept] * mean[kept]).sum(axis=0) / size
        spread = (square[kept] + n[kept] * (mean[kept] - middle) ** 2).sum(axis=0) / size
        std = np.sqrt(spread)
        # a constant feature keeps its scale
        out.append((float(size[0]), middle, np.where(std > 0, std, 1.0), counts[kept].sum(axis=0)))
    return out


def _sums(points: Sequence[tuple], n_classes: int):
    """A step for ``sum_over_rows``: per point (loss, gradient, Hessian) of the log loss.

    A point is (left out fold, center, scale, present classes, parameters as classes x (features + 1)).
    """

    def step(block: np.ndarray) -> np.ndarray:
        code, fold, features = block[:, 0].astype(int), block[:, 1], block[:, 2:]
        out = []
        for left_out, center, scale, present, theta in points:
            kept = fold != left_out
            z = np.concatenate([(features[kept] - center) / scale, np.ones((kept.sum(), 1))], axis=1)
            own, width = code[kept], z.shape[1]
            logits = z @ theta.T
            logits[:, ~present] = -np.inf
            if len(z):
                logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            total = p.sum(axis=1, keepdims=True)
            p /= total
            rows = np.arange(len(z))
            loss = float((np.log(total[:, 0]) - logits[rows, own]).sum())
            difference = p.copy()
            difference[rows, own] -= 1.0
            hessian = np.zeros((n_classes, width, n_classes, width))
            for a in range(n_classes):
                for b in range(a, n_classes):
                    weight = p[:, a] * ((a == b) - p[:, b])
                    hessian[a, :, b, :] = (z * weight[:, None]).T @ z
                    hessian[b, :, a, :] = hessian[a, :, b, :].T
            out += [[loss], (difference.T @ z).ravel(), hessian.ravel()]
        return np.concatenate(out)

    return step


def fit_softmax(
    df: DataFrame,
    features: Sequence[str],
    code: str,
    n_classes: int,
    fold: str | None = None,
    n_folds: int = 1,
    models: Sequence[int] | None = None,
    max_iter: int = 1000,
) -> list[Softmax]:
    """Fit one model for each left-out fold in ``models`` (all folds and then no fold by default).

    The loss is the sum of the log losses plus half the squared weights of the scaled features; intercepts are not
    penalised and add up to zero. ``code`` is the class number 0..n_classes-1, ``fold`` 0..n_folds-1 (no fold: all rows
    are fold 0 and model 1 leaves nothing out). Missing values are refused with the columns' names. A class that a
    model's rows lack gets probability zero; a model without rows has weights of zero.
    """
    models = list(range(n_folds + 1) if models is None else models)
    names = [f"f{i}" for i in range(len(features))]
    columns = [f"{double_of(code)} AS code", ("0D" if fold is None else double_of(fold)) + " AS fold"]
    columns += [f"{double_of(f)} AS {n}" for f, n in zip(features, names)]
    try:
        rows = fit_input(df.selectExpr(*columns), ["code", "fold", *names])
    except ValueError as error:
        shown = dict(zip(names, features))
        kind, _, bad = str(error).partition(" values in ")
        raise ValueError(f"{kind} values in " + ", ".join(shown.get(b, b) for b in bad.split(", "))) from None
    try:
        width = len(features) + 1
        scales = fold_scales(rows, len(features), n_folds, n_classes)
        fits = [_Search(m, *scales[m], n_classes, width) for m in models]
        for _ in range(max_iter + 1):
            open_ = [f for f in fits if not f.done]
            if not open_:
                break
            size = n_classes * width
            sums = sum_over_rows(rows, len(open_) * (1 + size + size * size), _sums([f.point() for f in open_], n_classes))
            for f, part in zip(open_, sums.reshape(len(open_), -1)):
                f.take(part[0], part[1 : 1 + size], part[1 + size :].reshape(size, size))
    finally:
        rows.unpersist()
    return [f.result() for f in fits]


class _Search:
    """The state of one model's damped Newton steps."""

    def __init__(self, left_out: int, n: float, center, scale, counts, n_classes: int, width: int):
        self.left_out, self.center, self.scale, self.present = left_out, center, scale, counts > 0
        self.theta = np.zeros((n_classes, width))
        self.trial, self.step, self.length, self.slope = self.theta, None, 1.0, 0.0
        self.loss, self.losses, self.steps = np.inf, [], 0
        self.done, self.converged = n == 0, n == 0

    def point(self) -> tuple:
        return self.left_out, self.center, self.scale, self.present, self.trial

    def take(self, loss: float, gradient: np.ndarray, hessian: np.ndarray) -> None:
        """Take over the trial point if the loss fell enough, else try half the step."""
        weights = self.trial[:, :-1]
        loss += 0.5 * float((weights**2).sum())
        if self.step is not None and not loss <= self.loss + SLOPE_SHARE * self.length * self.slope:
            self.length /= 2.0
            # below the rounding of the loss no step can be told from none
            if self.length < 1e-10:
                self.done = True
                self.converged = -self.slope <= 1e-9 * max(abs(self.loss), 1.0)
            self.trial = self.theta + self.length * self.step
            return
        self.theta, self.loss = self.trial, loss
        self.losses.append(loss)
        penalised = np.ones_like(self.theta)
        penalised[:, -1] = 0.0
        gradient = gradient + (penalised * self.theta).ravel()
        hessian = hessian + np.diag(penalised.ravel())
        # intercepts are free up to a common shift: fix it, and those of absent classes
        free = np.zeros_like(self.theta)
        free[self.present, -1] = 1.0
        hessian += np.outer(free.ravel(), free.ravel())
        fixed = np.zeros_like(self.theta)
        fixed[~self.present, -1] = 1.0
        hessian += np.diag(fixed.ravel())
        step = -np.linalg.solve(hessian, gradient)
        self.slope = float(gradient @ step)
        if -self.slope <= DECREMENT * max(abs(loss), 1.0):
            self.done = self.converged = True
            return
        self.step, self.length = step.reshape(self.theta.shape), 1.0
        self.steps += 1
        self.trial = self.theta + self.step

    def result(self) -> Softmax:
        theta = self.theta.copy()
        theta[~self.present, -1] = -1e9
        return Softmax(self.center.tolist(), self.scale.tolist(), theta[:, :-1].tolist(), theta[:, -1].tolist(),
                       float(self.loss), self.steps, bool(self.converged), [float(v) for v in self.losses])


def probabilities(features: Sequence[str], n_classes: int, raw: Column) -> Column:
    """Class probabilities as an array; ``raw`` is the array of ``Softmax.raw``, which may differ by row.

    Null if a feature is missing.
    """
    width = len(features) + 1
    values = [nan_to_null(named(f).cast("double")) for f in features]
    logits = []
    for k in range(n_classes):
        logit = F.get(raw, F.lit(k * width + len(features)))
        for i, v in enumerate(values):
            logit = logit + v * F.get(raw, F.lit(k * width + i))
        logits.append(logit)
    complete = F.lit(True)
    for v in values:
        complete = complete & v.isNotNull()
    array = F.when(complete, F.array(*logits))
    exps = F.transform(array, lambda v: F.exp(v - F.array_max(array)))
    total = F.aggregate(exps, F.lit(0.0), lambda a, b: a + b)
    return F.transform(exps, lambda v: v / total)
