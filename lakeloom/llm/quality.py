"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown over the statistics of labelled documents, every path from a root
becomes a conjunctive rule, a lasso logistic regression keeps few of the rules, and the kept rules are
compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats, store

#: At most so many labelled rows are fitted, drawn by a hash of the id.
TRAIN_ROWS = 20_000
CUT_SCORE = 0.7
Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, bound): value > bound, or <= bound


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: np.ndarray
    intercept: float
    names: list[str]

    def column(self) -> Column:
        """The score as an expression over the statistics' columns."""
        z = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights):
            cond = F.lit(True)
            for j, above, bound in rule:
                c = F.col(self.names[j])
                cond = cond & ((c > float(bound)) if above else (c <= float(bound)))
            z = z + F.when(cond, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + holds(self.rules, x) @ self.weights)))


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for j, above, bound in rule:
            out[:, k] *= (x[:, j] > bound) == above
    return out


def grow(x: np.ndarray, g: np.ndarray, depth: int, rng: np.random.Generator, path: Rule = ()) -> tuple[list[Rule], np.ndarray]:
    """(rules of all nodes under the root, fitted mean of g per row) of one regression tree."""
    fitted = np.full(len(x), g.mean() if len(g) else 0.0)
    if depth == 0 or len(x) < 20 or np.ptp(g) < 1e-9:
        return ([path] if path else []), fitted
    best = (1e-9, None, None)
    total, n = g.sum(), len(g)
    for j in rng.permutation(x.shape[1])[: max(3, x.shape[1] * 2 // 3)]:
        bounds = np.unique(np.quantile(x[:, j], np.linspace(0.03, 0.97, 24)))
        left = x[:, j][:, None] <= bounds
        nl, sl = left.sum(0), g @ left
        ok = (nl >= 8) & (nl <= n - 8)
        if ok.any():
            gain = np.where(ok, sl**2 / np.maximum(nl, 1) + (total - sl) ** 2 / np.maximum(n - nl, 1) - total**2 / n, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, bounds[k])
    if best[1] is None:
        return ([path] if path else []), fitted
    _, j, bound = best
    rules: list[Rule] = [path] if path else []
    for above in (False, True):
        side = (x[:, j] > bound) == above
        more, fitted[side] = grow(x[side], g[side], depth - 1, rng, (*path, (int(j), above, float(bound))))
        rules += more
    return rules, fitted


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, penalty: float = 0.002, seed: int = 11) -> RuleModel:
    """Fits the rules. Without rows of both labels the score is a constant: the share of label 1, or 0.5."""
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return RuleModel([], np.zeros(0), float(np.log((share + 1e-3) / (1 - share + 1e-3))), names)
    rng = np.random.default_rng(seed)
    z, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        rows = rng.random(len(y)) < min(1.0, 4000 / len(y))
        rules, _ = grow(x[rows], (y - 1 / (1 + np.exp(-z)))[rows], depth, rng)
        for r in rules:
            found.setdefault(r)
        m = holds(rules, x)
        p = 1 / (1 + np.exp(-z))
        grad, curve = m.T @ (y - p), m.T @ (p * (1 - p))
        z = z + 0.3 * m @ np.clip(grad / (curve + 5), -2, 2) / depth
    rules = list(found)
    m = holds(rules, x)
    _, first = np.unique(m, axis=1, return_index=True)
    rules, m = [rules[i] for i in sorted(first)], m[:, sorted(first)]
    center = m.mean(0)
    a = m - center
    step = 4 * len(y) / max(np.linalg.norm(a, 2) ** 2 + len(y), 1e-9)
    w, b, v, vb, t = np.zeros(a.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(a.shape[1]), 0.0, 1.0
    vb = b
    for _ in range(600):  # accelerated proximal gradient
        r = 1 / (1 + np.exp(-(vb + a @ v))) - y
        w2 = v - step * (a.T @ r) / len(y)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = vb - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        done = np.abs(w2 - w).max(initial=0) < 1e-6
        w, b, t = w2, b2, t2
        if done:
            break
    kept = np.flatnonzero(w)
    return RuleModel([rules[i] for i in kept], w[kept], float(b - center @ w), names)


def scored(docs: DataFrame, labels: DataFrame, train=None, train_rows: int = TRAIN_ROWS, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): score rises with the likelihood of label 1; every row gets one, empty texts and rows with
    a null or repeated id too. An empty table gives none.

    train is a condition on doc_id that training rows meet. Only the text's statistics are inputs, of very long texts
    too; other columns, whatever their names, are not looked at.
    """
    table = store.cut(stats.with_stats(store.small_batches(docs), id_col, text_col))
    x, y = stats.labelled(table, labels, train_rows, label, train)
    return table.select("doc_id", fit(x, y, stats.RATIOS).column().alias("score"))
