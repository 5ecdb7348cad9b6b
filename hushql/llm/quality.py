"""Quality by a sparse ensemble of rules.

Boosted trees over text statistics give conjunctions (the paths to their nodes); an L1-penalised logistic fit keeps few
of them and weighs them; the kept rules are compiled into Spark column expressions, so scoring never leaves the JVM.

Null and empty texts have statistics of zero and are scored like others. With labels of fewer than two kinds the score
is the share of label 1 (0.5 without any). Learning takes a bounded, documented sample (PER_CLASS rows a class).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushql.llm.common import crc_fold, labelled, whole_text

FOLDS, HELD = 5, 0
PER_CLASS = 6000
GOOD_FROM = 0.3
TREES, DEPTH, RATE, CUTS, LEAST_ROWS = 40, 3, 0.3, 32, 10


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, all built-in expressions."""
    n = F.greatest(F.length(text), F.lit(1))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    words, lines = F.split(F.lower(text), r"\s+"), F.split(text, "\n")
    share = lambda parts: F.size(F.array_distinct(parts)) / F.size(parts)
    return {
        "size": F.log1p(F.length(text).cast("double")),
        "upper": count(r"\p{Lu}") / n,
        "symbols": count(r"[^\p{L}\p{N}\s.,;:?'\"()-]") / n,
        "digits": count("[0-9]") / n,
        "word_size": F.length(text) / F.size(words),
        "own_words": share(words),
        "own_lines": share(lines),
        "line_size": F.log1p(F.length(text) / F.size(lines)),
    }


NAMES = ("size", "upper", "symbols", "digits", "word_size", "own_words", "own_lines", "line_size")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether at most, bar)."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return reduce(np.logical_and, ((x[:, f] <= bar) if low else (x[:, f] > bar) for f, low, bar in self.parts))

    def column(self, names=NAMES) -> Column:
        return reduce(lambda a, b: a & b, ((F.col(names[f]) <= F.lit(bar)) if low else (F.col(names[f]) > F.lit(bar)) for f, low, bar in self.parts))


@dataclass
class Model:
    rules: list[Rule]
    weights: list[float]
    shift: float

    def column(self) -> Column:
        total = F.lit(self.shift)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.shift)
        for rule, weight in zip(self.rules, self.weights):
            total += weight * rule.holds(x)
        return 1 / (1 + np.exp(-total))


def _simplified(parts: tuple[tuple[int, bool, float], ...]) -> tuple:
    bars: dict[tuple[int, bool], float] = {}
    for f, low, bar in parts:
        key = (f, low)
        bars[key] = bar if key not in bars else min(bars[key], bar) if low else max(bars[key], bar)
    return tuple(sorted((f, low, bar) for (f, low), bar in bars.items()))


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, parts: tuple, depth: int, out: list, add: np.ndarray) -> None:
    """One regression tree by Newton gain; its paths go to ``out``, its leaf values to ``add``."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 2 * LEAST_ROWS:
        for f, bars in enumerate(cuts):
            at = np.searchsorted(bars, x[rows, f], "left")
            gl = np.cumsum(np.bincount(at, grad[rows], len(bars) + 1))[:-1]
            hl = np.cumsum(np.bincount(at, hess[rows], len(bars) + 1))[:-1]
            nl = np.cumsum(np.bincount(at, minlength=len(bars) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (f, float(bars[gain.argmax()])))
    if best[1] is None:
        add[rows] -= RATE * g / (h + 1)
        return
    f, bar = best[1]
    for low in (True, False):
        path = (*parts, (f, low, bar))
        out.append(Rule(_simplified(path)))
        grow(x, grad, hess, cuts, rows[(x[rows, f] <= bar) == low], path, depth - 1, out, add)


def lasso(a: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised weighted logistic fit by accelerated proximal steps; the intercept is free."""
    a1 = np.c_[a, np.ones(len(a))]
    step = 4 / max(1e-9, np.linalg.eigvalsh((a1 * w[:, None]).T @ a1 / w.sum())[-1])
    theta = look = np.zeros(a1.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a1 @ look, -30, 30)))
        new = look - step * (a1.T @ (w * (p - y)) / w.sum())
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, theta, t = new + (t - 1) / t1 * (new - theta), new, t1
    return theta[:-1], float(theta[-1])


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int = 42) -> Model:
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Model([], [], float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
    rules: dict[Rule, None] = {}
    score = np.zeros(len(x))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rows = np.sort(rng.choice(len(x), max(1, len(x) // 2), replace=False))
        found: list[Rule] = []
        grow(x, w * (p - y), w * p * (1 - p), cuts, rows, (), DEPTH, found, add := np.zeros(len(x)))
        score += add
        rules |= dict.fromkeys(found)
    held = [np.packbits(r.holds(x)).tobytes() for r in rules]
    rules_ = list({h: r for h, r in reversed(list(zip(held, rules)))}.values())
    a = np.array([r.holds(x) for r in rules_], float).T
    rules_, a = [r for r, s in zip(rules_, a.std(0)) if s > 0], a[:, a.std(0) > 0]
    if not rules_:
        share = float((w * y).sum() / w.sum())
        return Model([], [], float(np.log(share / (1 - share))))
    scale = a.std(0)
    test = rng.permutation(len(x)) % 4 == 0
    best = (np.inf, 0.0)
    for penalty in (0.02, 0.01, 0.005, 0.002, 0.001):
        beta, shift = lasso(a[~test] / scale, y[~test], w[~test], penalty)
        z = np.clip(a[test] / scale @ beta + shift, -30, 30)
        loss = float((w[test] * (np.logaddexp(0, z) - y[test] * z)).sum() / w[test].sum())
        if loss < best[0] * 0.98:
            best = (loss, penalty)
    beta, shift = lasso(a / scale, y, w, best[1])
    kept = [(r, float(b / s)) for r, b, s in zip(rules_, beta, scale) if abs(b) > 1e-6]
    return Model([r for r, _ in kept], [b for _, b in kept], shift)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from labelled rows whose crc32(doc_id) modulo FOLDS isn't HELD; the driver gets their statistics alone."""
    from_ = crc_fold("doc_id", FOLDS) != HELD
    rows = labelled(docs, labels, "quality", from_, per_class)
    got = sorted(tuple(r) for r in rows.select("doc_id", "y", *[c.alias(n) for n, c in statistics(F.col("text")).items()]).collect())
    data = np.array([r[1:] for r in got], float).reshape(-1, 1 + len(NAMES))
    totals = {r.y: r.n for r in labels.where(from_ & F.col("quality").isin(0, 1)).groupBy(F.col("quality").alias("y")).agg(F.count("*").alias("n")).collect()}
    y = data[:, 0]
    w = np.array([totals.get(int(v), 1) for v in y], float) / np.maximum(1, np.where(y > 0, (y > 0).sum(), (y == 0).sum()))
    return fit(data[:, 1:], y, w / max(1e-12, w.mean()) if len(w) else w)


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row's whole text."""
    model = model or learn(docs, labels)
    stats = docs.select("doc_id", *[c.alias(n) for n, c in statistics(whole_text()).items()])
    made = stats.select("doc_id", (crc_fold("doc_id", FOLDS) == HELD).alias("held_out"), model.column().alias("score"))
    return made.select("*", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))
