"""Quality rules by an isolation forest over rule statistics.

Random splits isolate odd documents after few steps. As the method has it, every tree is grown from a few rows that
are drawn for it, here among all labelled documents of either quality; the labels of all of them then calibrate the
bound on the anomaly score.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.relational import quantiles
from . import stats, store, textkit

#: Trees, and the rows that each is grown from: the subsampling that defines an isolation forest.
TREES, SAMPLE = 100, 256
#: The statistics that are split; a document's length is none, for length is no fault.
LOOKED_AT = ["mean_word", "symbols_word", "bang_word", "top_share", "byte_entropy", "other_end_share"]
#: Share of good labelled rows that the calibrated bound may reject.
FALSE_REJECTS = 0.003


def usual_depth(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random binary tree of n leaves."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as flat arrays: split statistic (-1: leaf), bound, left child, path length at a leaf."""

    def __init__(self, x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(x))
        self.trees = [self._grow(x[rng.choice(len(x), self.sample, replace=False)], rng) for _ in range(trees)]

    @classmethod
    def of(cls, drawn: list[np.ndarray], seed: int = 5) -> Forest:
        """A tree for each table of rows that were drawn for it, all of one length."""
        self, rng = cls.__new__(cls), np.random.default_rng(seed)
        self.sample = len(drawn[0])
        self.trees = [self._grow(x, rng) for x in drawn]
        return self

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple:
        split, bound, child, depth = [-1], [0.0], [0], [0.0]
        todo, limit = [(0, x, 0)], int(np.ceil(np.log2(max(2, self.sample))))
        while todo:
            at, rows, level = todo.pop()
            spread = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 else []
            if level >= limit or not len(spread):
                depth[at] = level + float(usual_depth(len(rows)))
                continue
            j = int(rng.choice(spread))
            cut = rng.uniform(rows[:, j].min(), rows[:, j].max())
            split[at], bound[at], child[at] = j, cut, len(split)
            for side in (rows[:, j] <= cut, rows[:, j] > cut):
                todo.append((len(split), rows[side], level + 1))
                split.append(-1), bound.append(0.0), child.append(0), depth.append(0.0)
        return np.array(split), np.array(bound), np.array(child), np.array(depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the paths, the higher."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for split, bound, child, depth in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := split[at] >= 0).any():
                j = np.maximum(split[at], 0)
                at = np.where(inner, child[at] + (x[rows, j] > bound[at]), at)
            total += depth[at]
        return 2.0 ** (-total / len(self.trees) / max(float(usual_depth(self.sample)), 1e-9))


def calibrate(score: np.ndarray, y: np.ndarray, false_rejects: float) -> float:
    """The bound that rejects most rows of label 0 while it rejects at most that share of label 1."""
    good, bad = score[y == 1], score[y == 0]
    least = float(np.quantile(good, 1 - false_rejects))
    over = bad[bad > least]
    if not len(over):
        return least
    first = float(over.min())  # nothing bad lies between: keep as far from the good as from the bad
    return (max(least, float(good[good < first].max(initial=least))) + first) / 2 if first > least else least


def drawn(rows: DataFrame, n: int, trees: int = TREES, sample: int = SAMPLE) -> list[np.ndarray]:
    """For every tree `sample` of the n rows (all, if there are fewer), those with the least hashes for that tree. Only
    hashes below a bound for half more than that go on."""
    bound = int(2**63 * min(1.0, (1.5 * sample + 100) / n)) - 1
    pick = lambda t: F.shiftrightunsigned(F.xxhash64(t, "doc_id", *LOOKED_AT), 1)
    near = rows.select("doc_id", *LOOKED_AT, F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: pick(t) < bound)).alias("tree"))
    order = Window.partitionBy("tree").orderBy(pick(F.col("tree")), "doc_id", *LOOKED_AT)
    got = near.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= sample).orderBy("tree", "_at").select("tree", *LOOKED_AT).toPandas()
    tables = [g[LOOKED_AT].to_numpy(np.float64) for _, g in got.groupby("tree")]
    least = min(map(len, tables))
    return [x[:least] for x in tables]


def bound_of(scores: DataFrame, false_rejects: float) -> float:
    """`calibrate` over all rows of (anomaly, y), where they are."""
    good, bad = scores.filter("y = 1"), scores.filter("y = 0")
    n = good.count()
    at = (n - 1) * (1 - false_rejects)
    low, high = quantiles(good, "anomaly", {"low": Fraction(int(at) + 1, n), "high": Fraction(min(int(at) + 2, n), n)}).first()
    least = low + (high - low) * (at - int(at))
    first = bad.filter(F.col("anomaly") > least).agg(F.min("anomaly")).first()[0]
    if first is None:
        return least
    last = good.filter((F.col("anomaly") < first) & (F.col("anomaly") > least)).agg(F.max("anomaly")).first()[0]
    return ((least if last is None else last) + first) / 2


def _scored(table: DataFrame, forest: Forest | None, names: list[str], types: str) -> DataFrame:
    """The named columns with `anomaly`, which is 0 without a forest."""

    @textkit.released
    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in LOOKED_AT]) if len(batch) else np.zeros((0, len(LOOKED_AT)))
            score = forest.score(x) if forest else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], [*names, "anomaly"])

    return table.mapInArrow(run, f"{types}, anomaly double")


def verdicts(docs: DataFrame, labels: DataFrame, false_rejects: float = FALSE_REJECTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS, base_failed, anomaly, kept), one row per row of docs.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. kept: not
    base_failed, and the anomaly score is at most the bound, which rejects `false_rejects` of the good
    labelled rows. With fewer than 8 good labelled rows there is no forest: anomaly is 0 and the base
    rules decide alone. Rows with a null or repeated id are judged each by their text; other columns don't matter.
    Null and empty texts have no words and fail the base rules; very long texts are counted whole; an empty table gives no rows.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    table = store.cut(stats.with_stats(store.small_batches(docs), id_col, text_col).withColumn("base_failed", failed))
    rows = store.cut(stats.marked(table, labels, keep=~F.col("base_failed")).select("doc_id", "y", *LOOKED_AT))
    n, n_good = rows.agg(F.count("*"), F.count_if(F.col("y") == 1)).first()
    forest, bound = None, 1.0
    if n_good >= 8:
        forest = Forest.of(drawn(rows, n))
        bound = bound_of(store.cut(_scored(rows, forest, ["y"], "y int")), false_rejects)
    counts = ", ".join(f"{c} long" for c in stats.COUNTS)
    out = _scored(table, forest, ["doc_id", *stats.COUNTS, "base_failed"], f"doc_id long, {counts}, base_failed boolean")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= bound))
