"""Quality classifier: a sparse rule ensemble compiled to Spark column expressions.

Shallow boosted trees over text statistics supply candidate rules: every path
from a root is a conjunction of threshold conditions.  A logistic model with a
lasso penalty weighs them, most weights are zero, and the rest are summed by one
column expression.

Defined cases: null and empty texts are scored like any other, from statistics
that are 0; equal texts get equal scores; without labels of both classes every
score is the share of label 1 (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cloakframe.llm.common import fold
from cloakframe.llm.rules import Condition, Rule, covered, cut_points, sample_features
from cloakframe.llm.stats import FEATURES, counted, feature_columns

SAMPLE = 10_000


def _tree(x: np.ndarray, target: np.ndarray, weight: np.ndarray, bounds: list[np.ndarray], depth: int, path: Rule, least: int, out: list) -> np.ndarray:
    """Fit a regression tree by squared error, append the path of every node to ``out``, return the fit."""
    mean = float((target * weight).sum() / max(weight.sum(), 1e-12))
    fit = np.full(len(x), mean)
    if depth == 0 or len(x) < 2 * least:
        return fit
    best, gain = None, 1e-9
    centred = (target - mean) * weight
    for f, cuts in enumerate(bounds):
        if not len(cuts):
            continue
        at = np.searchsorted(cuts, x[:, f])  # value <= cuts[k] for at <= k
        s = np.cumsum(np.bincount(at, centred, len(cuts) + 1))[:-1]
        n = np.cumsum(np.bincount(at, minlength=len(cuts) + 1))[:-1]
        w = np.cumsum(np.bincount(at, weight, len(cuts) + 1))[:-1]
        ok = (n >= least) & (len(x) - n >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = np.where(ok, s * s / w + s * s / (weight.sum() - w), -1.0)
        k = int(np.nanargmax(g))
        if g[k] > gain:
            best, gain = (f, float(cuts[k])), float(g[k])
    if best is None:
        return fit
    f, bound = best
    low = x[:, f] <= bound
    for above, at in ((False, low), (True, ~low)):
        rule = (*path, Condition(FEATURES[f], above, bound))
        out.append(rule)
        fit[at] = _tree(x[at], target[at], weight[at], bounds, depth - 1, rule, least, out)
    return fit


def candidate_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = 11) -> list[Rule]:
    """Distinct conjunctions on the paths of boosted trees."""
    order, out = np.random.default_rng(seed), []
    bounds = cut_points(x)
    z = np.zeros(len(x))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        part = order.random(len(x)) < 0.5
        if part.sum() < 10:
            part[:] = True
        rules: list[Rule] = []
        _tree(x[part], (y - p)[part], weight[part], bounds, depth, (), max(5, int(part.sum() * 0.002)), rules)
        out += rules
        leaves = [r for r in rules if not any(len(o) > len(r) and o[: len(r)] == r for o in rules)]
        for r in leaves:
            at = covered(r, x)
            if at.any():
                z[at] += rate * 4 * float(((y - p)[at] * weight[at]).sum() / weight[at].sum())
    return list(dict.fromkeys(out))


def lasso(a: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic model, by accelerated proximal gradient."""
    weight = weight / weight.sum()
    w = v = np.zeros(a.shape[1])
    b = vb = 0.0
    rate, t = 4.0 / max(1.0, float((a * a).sum(1).max()) + 1), 1.0
    for _ in range(steps):
        r = weight * (1 / (1 + np.exp(-(a @ v + vb))) - y)
        step = v - rate * (a.T @ r)
        nw = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        nb = vb - rate * float(r.sum())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[tuple[Rule, float]], float]:
    """The rules of nonzero weight, and the intercept; the penalty is chosen on a quarter of the rows."""
    if not len(y) or y.min() == y.max():
        mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return [], float(np.log(mean / (1 - mean)))
    rules = candidate_rules(x, y, weight)
    a = np.stack([covered(r, x) for r in rules], 1).astype(np.float64)
    held = np.random.default_rng(5).random(len(y)) < 0.25
    held[:1] = False
    best, least = 1e-4, np.inf
    for penalty in (3e-3, 1e-3, 3e-4, 1e-4):
        w, b = lasso(a[~held], y[~held], weight[~held], penalty, 200)
        z = a[held] @ w + b
        loss = float((weight[held] * (np.logaddexp(0, z) - y[held] * z)).sum())
        if loss < least:
            best, least = penalty, loss
    w, b = lasso(a, y, weight, best)
    return [(r, float(k)) for r, k in zip(rules, w, strict=True) if abs(k) > 1e-6], float(b)


def logit(model: tuple[list[tuple[Rule, float]], float], features: dict[str, Column]) -> Column:
    """The weighted sum of the rules that hold."""
    out = F.lit(model[1])
    for rule, weight in model[0]:
        test = F.lit(True)
        for c in rule:
            test = test & c.column(features)
        out = out + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    ``most`` bounds the labelled documents per class used for fitting; weights
    restore the classes' shares among all labelled rows outside the held fold.
    """
    x, y = sample_features(docs, labels, "quality", most, True)
    seen = {r.quality: r.n for r in labels.where(fold("doc_id", 5) != 0).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    weight = np.where(y == 1, seen.get(1, 0) / max(1, (y == 1).sum()), seen.get(0, 0) / max(1, (y == 0).sum()))
    model = fit(x, y.astype(np.float64), weight)
    features = feature_columns()
    rows = counted(docs.select("doc_id", "text")).select("doc_id", *[features[n].alias(n) for n in FEATURES])
    score = 1 / (1 + F.exp(-logit(model, {n: F.col(n) for n in FEATURES})))
    return rows.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= cut).cast("int")
    )
