"""Quality classifier: a sparse ensemble of rules over text statistics, run as Spark column expressions.

Method. Small regression trees, each grown on a random half of the rows and a few statistics against what the trees
before it leave unexplained, give paths; every path from a root is a rule, a conjunction of thresholds. A logistic fit
with an L1 penalty (proximal gradient steps) weighs the rules and drops most. The rest compile to one Spark expression.

Bound. The fit takes at most `sample` labelled rows, chosen by a hash of doc_id, and only rows outside the held-out fold
(crc32 of doc_id's decimal text, mod FOLDS, is 0). Statistics are the only inputs; scores cover every row and whole texts.

Defined results: null and empty texts have all-zero shares and get a score as any other; without labels of both kinds
the score is the share of good labels, 0.5 if there are none; rows with a null doc_id are scored and not held out; equal
labels of a doc_id count once; input columns named as a statistic, score or predicted are replaced.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textstats
from .common import with_text_columns
from .quality_rules import labelled

FOLDS = 5
#: Rows of a fit, trees, depth, statistics a tree may use, thresholds tried for each, share a rule must hold for, L1 penalty.
SAMPLE, TREES, DEPTH, TRIED, BINS, SUPPORT, PENALTY = 4000, 60, 3, 7, 32, 0.005, 0.0015

#: (statistic, threshold, above): the statistic is over the threshold, or is not.
Rule = tuple[tuple[int, float, bool], ...]


@dataclasses.dataclass
class Model:
    rules: list[Rule]
    weights: list[float]
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def statistics(df: DataFrame, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (its columns keep) with one double column stat_<name> for each statistic of textstats.QUALITY."""
    names = [f"stat_{n}" for n in textstats.QUALITY]

    def work(texts: list) -> dict:
        return dict(zip(names, textstats.quality(texts).T, strict=True))

    return with_text_columns(df, [T.StructField(n, T.DoubleType()) for n in names], lambda: work, column, keep)


def grown(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, allowed: np.ndarray, path: Rule, rows: np.ndarray, depth: int, rules: set, fitted: np.ndarray) -> None:
    """Splits rows by the best threshold, notes both paths, goes on below; leaves put their mean into fitted."""
    best, least = None, max(5, int(SUPPORT * len(x)))
    if depth and len(rows) >= 2 * least:
        total, n = residual[rows].sum(), len(rows)
        for j in allowed:
            size = len(edges[j]) + 1
            if size < 2:
                continue
            count = np.bincount(binned[rows, j], minlength=size)[:-1].cumsum()
            s = np.bincount(binned[rows, j], residual[rows], minlength=size)[:-1].cumsum()
            ok = (count >= least) & (n - count >= least)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(count, 1) + (total - s) ** 2 / np.maximum(n - count, 1), -1)
                k = int(gain.argmax())
                if best is None or gain[k] > best[0] + 1e-12:
                    best = (gain[k], j, k)
        if best is not None and best[0] <= total**2 / n + 1e-9:
            best = None
    if best is None:
        fitted[rows] = residual[rows].mean() if len(rows) else 0
        return
    _, j, k = best
    above = binned[rows, j] > k
    for up in (False, True):
        longer = (*path, (int(j), float(edges[j][k]), up))
        rules.add(longer)
        grown(x, binned, edges, residual, allowed, longer, rows[above == up], depth - 1, rules, fitted)


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, t, up in rule:
        out &= (x[:, j] > t) == up
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    z, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), set()
    for _ in range(TREES):
        rows = np.sort(rng.permutation(len(y))[: max(1, len(y) // 2)])
        allowed = np.sort(rng.permutation(x.shape[1])[:TRIED])
        fitted = np.zeros(len(y))
        residual = y - 1 / (1 + np.exp(-z))
        grown(x, binned, edges, residual, allowed, (), rows, DEPTH, rules, fitted)
        z = z + fitted
    found, seen = [], set()
    for r in sorted(rules, key=lambda r: (len(r), r)):
        mark = holds(x, r)
        key = mark.tobytes()
        if SUPPORT <= mark.mean() <= 1 - SUPPORT and key not in seen and (~mark).tobytes() not in seen:
            seen.add(key)
            found.append(r)
    return found


def lasso(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty on standardised columns, by accelerated proximal gradient steps."""
    spread = np.maximum(m.std(axis=0), 1e-3)
    s = (m - m.mean(axis=0)) / spread
    w, b = np.zeros(m.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    top = 1.0
    u = np.ones(m.shape[1])
    for _ in range(15):  # largest eigenvalue, for the step
        u = s.T @ (s @ u) / len(y)
        top = max(float(np.linalg.norm(u)), 1e-9)
        u /= top
    rate, past_w, past_b, momentum = 4 / (top + 1), w, b, 1.0
    at_w, at_b = w, b
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(s @ at_w + at_b, -30, 30)))
        g = (p - y) / len(y)
        w = at_w - rate * (s.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        b = at_b - rate * g.sum()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        at_w, at_b = w + (momentum - 1) / after * (w - past_w), b + (momentum - 1) / after * (b - past_b)
        past_w, past_b, momentum = w, b, after
    w = w / spread
    return w, float(b - m.mean(axis=0) @ w)


def fit_arrays(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Model:
    if len(set(y)) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Model([], [], float(np.log(share / (1 - share))))
    rules = tree_rules(x, y)
    if not rules:
        return Model([], [], float(np.log(y.mean() / (1 - y.mean()))))
    w, b = lasso(np.column_stack([holds(x, r) for r in rules]).astype(np.float64), y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Model([rules[i] for i in kept], [float(w[i]) for i in kept], b)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Model:
    """A model of label 1, learned from labelled rows outside the held-out fold."""
    learn = labels.where(~held_out(F.col("doc_id")))
    names = [f"stat_{n}" for n in textstats.QUALITY]
    rows = statistics(labelled(documents, learn, sample, label), keep=["doc_id", "label"]).select("doc_id", "label", *names).collect()
    rows.sort(key=lambda r: (r.doc_id, r.label))
    x = np.array([r[2:] for r in rows], dtype=np.float64).reshape(len(rows), len(names))
    return fit_arrays(x, np.array([r.label for r in rows], dtype=np.float64))


def compiled(model: Model) -> Column:
    """The score as a Spark expression over the columns stat_<name>."""
    names = [f"stat_{n}" for n in textstats.QUALITY]

    def test(j: int, t: float, up: bool) -> Column:
        return F.col(names[j]) > F.lit(t) if up else F.col(names[j]) <= F.lit(t)

    total = F.lit(model.bias)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        every = test(*rule[0])
        for c in rule[1:]:
            every &= test(*c)
        total = total + F.when(every, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def apply(documents: DataFrame, model: Model, threshold: float = 0.3, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """documents (their columns keep) with score (0 to 1) and predicted (1 from the threshold)."""
    scored = statistics(documents, column, keep).withColumn("score", compiled(model))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(*[f"stat_{n}" for n in textstats.QUALITY])
