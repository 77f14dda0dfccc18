"""A sparse rule ensemble that scores quality.

Small trees are grown on a bounded sample of labelled rows; every path from
the root to a node is a conjunctive rule over text statistics. A logistic
regression with an L1 penalty weighs the rules, most of them with 0, and the
rest become one Spark column expression. So scoring is a scan with code that
Spark compiles: no Python and no shuffle.

Statistics see the whole text and nothing else of a row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model is fitted on, at most: the first by a hash of doc_id.
MAX_TRAIN = 10_000
TREES, DEEP, BINS, TRIED = 24, 3, 48, 5
PENALTIES = (0.02, 0.006, 0.002, 0.0006)
STEPS = 250

_GAP = r"[\\x20\\x09-\\x0D]+"


def _count(chars: str) -> str:
    return f"(length(_text) - length(regexp_replace(_text, '{chars}', '')))"


#: Each statistic, SQL over _text, its words and its lines.
STATISTICS = {
    "words": "ln(1 + size(_words))",
    "word_length": "_letters / _n",
    "symbols": _count("[#*$%&|<>]") + " / _n",
    "shouts": "(length(_text) - length(replace(_text, '!!', '!'))) / _n",
    "capitals": _count("[A-ZÀ-ÖØ-Þ]") + " / greatest(1, _letters)",
    "distinct": "size(array_distinct(_words)) / _n",
    "digits": _count("[0-9]") + " / greatest(1, _letters)",
    "stops": _count("[.,;:?]") + " / _n",
    "lines": "size(_lines) / _n",
    "same_lines": "(size(_lines) - size(array_distinct(_lines))) / greatest(1, size(_lines))",
}


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and the statistics of each text; a null text is empty, and its ratios are 0."""
    own = docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce("text", F.lit("")).alias("_text"))
    cut = own.withColumn("_words", F.expr(f"array_remove(split(_text, '{_GAP}'), '')")).withColumn("_lines", F.expr(r"split(_text, '\\n')"))
    sized = cut.withColumn("_n", F.expr("greatest(1, size(_words))")).withColumn("_letters", F.expr("length(array_join(_words, ''))"))
    return sized.select(*(F.col(f"`{c}`") for c in keep), *(F.expr(f"cast({sql} as double)").alias(f"s_{name}") for name, sql in STATISTICS.items()))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, whether above, threshold)."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, t in self.parts:
            c = F.col(f"s_{name}")
            out = out & (c > F.lit(t) if above else c <= F.lit(t))
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, t in self.parts:
            out &= x[name] > t if above else x[name] <= t
        return out


@dataclass
class Ensemble:
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    offset: float = 0.0

    def column(self) -> Column:
        """The score, from 0 to 1."""
        total = F.lit(self.offset)
        for rule, w in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, edges: list[np.ndarray], binned: np.ndarray, rows: np.ndarray, some: np.ndarray, path: tuple, names: list[str], out: set[Rule]) -> None:
    """Adds the rules of a tree's nodes: splits with the least impurity over bins of some statistics."""
    n, positive = len(rows), y[rows].sum()
    if path:
        tidy: dict[tuple[str, bool], float] = {}
        for name, above, t in path:
            key = (name, above)
            tidy[key] = t if key not in tidy else max(tidy[key], t) if above else min(tidy[key], t)
        out.add(Rule(tuple(sorted((a, b, t) for (a, b), t in tidy.items()))))
    if len(path) == DEEP or n < 20 or positive in (0, n):
        return
    best = (2 * positive * (n - positive) / n * (1 - 1e-6), None)
    for f in some:
        size = len(edges[f])
        count = np.bincount(binned[rows, f], minlength=size + 1)[: size + 1].cumsum()[:-1]
        ones = np.bincount(binned[rows, f], weights=y[rows], minlength=size + 1)[: size + 1].cumsum()[:-1]
        ok = (count >= 10) & (n - count >= 10)
        if not ok.any():
            continue
        with np.errstate(all="ignore"):
            cost = 2 * ones * (count - ones) / count + 2 * (positive - ones) * (n - count - positive + ones) / (n - count)
        cost[~ok] = np.inf
        k = int(cost.argmin())
        if cost[k] < best[0]:
            best = (cost[k], (f, k))
    if best[1] is None:
        return
    f, k = best[1]
    low = binned[rows, f] <= k
    t = float(edges[f][k])
    grow(x, y, edges, binned, rows[low], some, (*path, (names[f], False, t)), names, out)
    grow(x, y, edges, binned, rows[~low], some, (*path, (names[f], True, t)), names, out)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None) -> np.ndarray:
    """Logistic weights with an L1 penalty, the first an unpenalised offset; accelerated proximal steps."""
    n, m = z.shape
    a = np.hstack([np.ones((n, 1)), z])
    v = np.ones(m + 1)
    for _ in range(12):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(v @ (a.T @ (a @ v))) / 1.05
    w = np.zeros(m + 1) if start is None else start.copy()
    ahead, t = w.copy(), 1.0
    for _ in range(STEPS):
        g = a.T @ (1 / (1 + np.exp(-(a @ ahead))) - y) / n
        new = ahead - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def fit(x: dict[str, np.ndarray], y: np.ndarray, seed: int = 11) -> Ensemble:
    """The ensemble of some rows; without rows of both classes, their share (one half without any) for every text."""
    n = len(y)
    if n == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (n + 2) if n else 0.5
        return Ensemble(offset=float(np.log(share / (1 - share))))
    names = list(x)
    data = np.stack([x[k] for k in names], 1)
    edges = [np.unique(np.quantile(data[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(len(names))]
    binned = np.stack([np.searchsorted(edges[f], data[:, f], "left") for f in range(len(names))], 1)
    rng = np.random.default_rng(seed)
    found: set[Rule] = set()
    for _ in range(TREES):
        rows = rng.integers(0, n, n)
        grow(data, y, edges, binned, rows, rng.choice(len(names), min(TRIED, len(names)), replace=False), (), names, found)
    rules, columns, seen = [], [], set()
    for r in sorted(found, key=lambda r: (len(r.parts), r.parts)):
        z = r.holds(x)
        key = z.tobytes()
        if key not in seen and 0 < z.sum() < n:
            seen.add(key)
            rules.append(r)
            columns.append(z)
    z = np.stack(columns, 1).astype(np.float64) if columns else np.zeros((n, 0))
    test = np.arange(n) % 4 == 0
    best, w = (np.inf, PENALTIES[0]), None
    for penalty in PENALTIES:
        w = lasso(z[~test], y[~test], penalty, w)
        p = np.clip(1 / (1 + np.exp(-(w[0] + z[test] @ w[1:]))), 1e-6, 1 - 1e-6)
        best = min(best, (float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()), penalty))
    w = lasso(z, y, best[1], w)
    used = np.flatnonzero(np.abs(w[1:]) > 1e-9)
    return Ensemble([rules[i] for i in used], [float(w[1 + i]) for i in used], float(w[0]))


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Ensemble:
    """Fits on at most `most` labelled rows that aren't held out; labels without a quality are left out, and a doc_id with several counts once."""
    usable = labels.select("doc_id", "quality").filter(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), ("doc_id", "quality")).toPandas().sort_values("doc_id")
    rows = rows.sample(frac=1.0, random_state=3)
    return fit({k: rows[f"s_{k}"].to_numpy(float) for k in STATISTICS}, rows["quality"].to_numpy(float))


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """doc_id, held_out, score and predicted of each row, repeated ones too; a null text is empty, a null doc_id is not held out, and other columns are not read."""
    return statistics(docs).select("doc_id", held_out().alias("held_out"), model.column().alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
