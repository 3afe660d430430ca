"""Quality rules: a learned decision list over text statistics.

Sequential covering on a bounded labelled sample: a rule is grown condition by
condition (largest gain of information) on two thirds of the rows, pruned from
its end on the other third, and kept while it is precise; the documents it
covers are taken out and the next one is learned.  The ordered list becomes one
conditional Spark expression, so applying it is a scan without Python.

Defined cases: null and empty texts have no words and fail the base rule; ties
and repeated rows get equal verdicts; without labels of both classes the list is
empty and only the base rules decide; texts of any length are counted whole; an
empty table gives no rows; other columns pass through, and those named like a
result go on under their name with an underscore before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cloakframe.llm.common import labelled_ids
from cloakframe.llm.stats import COUNTS, FEATURES, counted, feature_columns, free_name

SAMPLE = 10_000
RESULTS = [*COUNTS, "base_failed", "kept"]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.bound if self.above else v <= self.bound

    def column(self, features: dict[str, Column]) -> Column:
        c = features[self.feature]
        return c > self.bound if self.above else c <= self.bound


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule]) if rule else np.ones(len(x), bool)


def cut_points(x: np.ndarray, most: int = 64) -> list[np.ndarray]:
    """For each feature, bounds between neighbouring quantiles of its distinct values."""
    out = []
    for v in x.T:
        u = np.unique(v)
        mid = (u[1:] + u[:-1]) / 2
        out.append(mid if len(mid) <= most else np.unique(mid[np.linspace(0, len(mid) - 1, most).astype(int)]))
    return out


def grow(x: np.ndarray, bad: np.ndarray, most: int) -> Rule:
    """Add the condition of largest FOIL gain until no good row is covered or nothing gains."""
    rule: Rule = ()
    at = np.ones(len(x), bool)
    while len(rule) < most:
        p0, n0 = int(bad[at].sum()), int((~bad[at]).sum())
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for name, v, bounds in zip(FEATURES, x[at].T, cut_points(x[at]), strict=True):
            if not len(bounds):
                continue
            low = v[:, None] <= bounds
            pl, nl = (low & bad[at][:, None]).sum(0), (low & ~bad[at][:, None]).sum(0)
            for above, p, n in ((False, pl, nl), (True, p0 - pl, n0 - nl)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = Condition(name, above, float(bounds[k])), float(g[k])
        if best is None:
            break
        rule += (best,)
        at &= best.holds(x)
    return rule


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drop final conditions while (bad - good) / (bad + good) on held rows does not fall."""

    def worth(r: Rule) -> float:
        at = covered(r, x)
        return (bad[at].sum() - (~bad[at]).sum()) / max(1, at.sum())

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(x: np.ndarray, bad: np.ndarray, most_rules: int = 16, most_conditions: int = 4, precision: float = 0.95, seed: int = 7) -> list[Rule]:
    """The ordered rules that mark documents as bad."""
    out: list[Rule] = []
    order = np.random.default_rng(seed)
    while len(out) < most_rules and bad.sum() >= 5 and (~bad).any():
        held = order.random(len(x)) < 1 / 3
        rule = prune(grow(x[~held], bad[~held], most_conditions), x[held], bad[held])
        at = covered(rule, x)
        if not rule or bad[at].sum() < 5 or bad[at].mean() < precision:
            break
        out.append(rule)
        x, bad = x[~at], bad[~at]
    return out


def verdict(rules: list[Rule], features: dict[str, Column]) -> Column:
    """Ordered conditions: the first rule that holds rejects, else the document is kept."""
    out = F.lit(True)
    for rule in reversed(rules):
        test = F.lit(True)
        for c in rule:
            test = test & c.column(features)
        out = F.when(test, F.lit(False)).otherwise(out)
    return out


def sample_features(docs: DataFrame, labels: DataFrame, label: str, most: int, repeats: bool) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled documents of each class, for the driver."""
    ids = F.broadcast(labelled_ids(labels, label, most))
    rows = counted(docs.select("doc_id", "text").join(ids, "doc_id"), repeats=repeats)
    rows = rows.select("doc_id", "y", *[c.cast("double").alias(n) for n, c in feature_columns().items()]).collect()
    rows.sort(key=lambda r: tuple(r))
    return np.array([r[2:] for r in rows], np.float64).reshape(len(rows), len(FEATURES)), np.array([r[1] for r in rows], np.int64)


def own_names(columns: list[str]) -> dict[str, str]:
    """New names of the columns that are named like a result."""
    taken, out = [*columns, *RESULTS], {}
    for c in columns:
        if c.lower() in RESULTS:
            out[c] = free_name(taken, c)
            taken.append(out[c])
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``docs`` with the base counts, base_failed, and kept by the learned list.

    ``most`` bounds the labelled documents per class that the list is learned
    from (rows with crc32(doc_id) mod 5 = 0 are never among them).
    """
    x, y = sample_features(docs, labels, "quality", most, True)
    rules = learn(x, y == 0)
    docs = docs.withColumnsRenamed(own_names(docs.columns))
    stats = free_name(docs.columns, "stats")
    s = F.col(stats)
    failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
    out = counted(docs, stats=stats).withColumns({c: s[c] for c in COUNTS} | {"base_failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules, feature_columns(stats))).drop(stats)


def keep_good(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    own = own_names(docs.columns)
    return quality_rules(docs, labels, most).where("kept").select(*[F.col(f"`{own.get(n, n)}`").alias(n) for n in docs.columns])
