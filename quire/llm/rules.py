"""Quality by a sparse rule ensemble: paths of boosted shallow trees over text statistics become conjunctive rules, a lasso logistic
regression weighs them, and the few rules left are compiled into one Column expression.

Fitted on the driver on at most `SAMPLE` labelled rows of statistics (a row is a dozen numbers); scoring runs on all rows inside the
JVM, without shuffle or Python.

Defined cases: a null or empty text has statistics of an empty text and is scored by them; without labels of both kinds the score is
the smoothed share of label 1; repeated rows are scored each; a null doc_id is in fold 0 and never learned from; columns of the input
stay, one named like an output column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
TREES, DEPTH, CUTS, LEAST = 24, 3, 32, 8
LASSO = 2e-3
STEPS = 400
STATS = ["chars", "word_chars", "line_words", "pipes", "bangs", "marks", "upper", "digits", "stops", "beyond_ascii",
         "distinct_words", "distinct_lines"]


def statistics(text: Column) -> list[Column]:
    """Shares are per character, word or line of the whole text."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    words, lines = F.split(text, r"\s+"), F.split(text, "\n")

    def share(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / chars

    def held(mark: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / chars

    made = [F.length(text).cast("double"), F.length(text) / F.size(words), F.size(words) / F.size(lines), held("|"), held("!"),
            share(r"[#$%&*@^~<>={}\[\]_\\]+"), share(r"\p{Lu}+"), share("[0-9]+"), held(".") + held(","),
            (F.octet_length(text) - F.length(text)) / chars,
            F.size(F.array_distinct(words)) / F.size(words), F.size(F.array_distinct(lines)) / F.size(lines)]
    return [c.cast("double").alias(f"_{name}") for c, name in zip(made, STATS, strict=True)]


@dataclass(frozen=True)
class Rule:
    """All of (statistic, above, threshold): the statistic is above the threshold, or not."""
    tests: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(and_, [(x[n] > t) if above else (x[n] <= t) for n, above, t in self.tests])

    def column(self) -> Column:
        return reduce(and_, [(F.col(f"_{n}") > t) if above else (F.col(f"_{n}") <= t) for n, above, t in self.tests])


@dataclass(frozen=True)
class RuleModel:
    base: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = reduce(lambda a, b: a + b, [F.when(r.column(), w).otherwise(0.0) for r, w in self.rules], F.lit(self.base))
        return 1 / (1 + F.exp(-total))


def best_split(bins: np.ndarray, pull: np.ndarray, rows: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, statistic, cut) of the split that explains most of the pull."""
    best, n, total = None, len(rows), pull[rows].sum()
    for k in range(bins.shape[1]):
        own = bins[rows, k]
        left_n = np.cumsum(np.bincount(own, minlength=CUTS + 1))[:-1]
        left = np.cumsum(np.bincount(own, pull[rows], minlength=CUTS + 1))[:-1]
        fits = (left_n >= LEAST) & (n - left_n >= LEAST)
        gain = np.where(fits, left ** 2 / np.maximum(left_n, 1) + (total - left) ** 2 / np.maximum(n - left_n, 1), -1)
        at = int(gain.argmax())
        if fits[at] and (best is None or gain[at] > best[0] + 1e-12):
            best = (float(gain[at]), k, at)
    return best if best and best[0] > total ** 2 / n + 1e-9 else None


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths to all nodes of trees boosted on the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)
    logit, found = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        pull, level = y - p, [(np.arange(len(y)), ())]
        for depth in range(DEPTH + 1):
            below = []
            for rows, path in level:
                split = best_split(bins, pull, rows) if depth < DEPTH else None
                if split is None:
                    weight = (p[rows] * (1 - p[rows])).sum() + 1e-3
                    logit[rows] += 0.3 * np.clip(pull[rows].sum() / weight, -4, 4)
                    continue
                _, k, at = split
                high = bins[rows, k] > at
                for above in (False, True):
                    test = (STATS[k], above, float(cuts[k][min(at, len(cuts[k]) - 1)]))
                    below.append((rows[high == above], (*path, test)))
                    found.setdefault(Rule(tuple(sorted({*path, test}))), None)
            level = below
    return list(found)


def lasso(r: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic weights with an absolute penalty, by accelerated proximal steps."""
    n = len(y)
    a = np.hstack([np.ones((n, 1)), r])
    step = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(STEPS):
        z = v - step * (a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -40, 40))) - y)) / n
        new = np.concatenate([z[:1], np.sign(z[1:]) * np.maximum(np.abs(z[1:]) - step * LASSO, 0)])
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + (t - 1) / later * (new - w), later
    return float(w[0]), w[1:]


def fit(rows: DataFrame) -> RuleModel:
    """rows(text, _label, _order): the bounded sample, see common.learning_sample."""
    got = rows.select("_order", "_label", *statistics(F.col("text"))).collect()
    got.sort(key=lambda r: tuple(r))
    y = np.array([r["_label"] for r in got], dtype=float)
    if len(set(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), ())
    x = np.array([[r[f"_{n}"] for n in STATS] for r in got])
    rules = tree_rules(x, y)
    named = {n: x[:, k] for k, n in enumerate(STATS)}
    columns, kept = {}, []
    for rule in rules:  # rules that hold for the same rows are one
        held = rule.holds(named)
        if columns.setdefault(held.tobytes(), rule) is rule:
            kept.append((rule, held))
    if not kept:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), ())
    base, weights = lasso(np.stack([h for _, h in kept], 1).astype(float), y)
    return RuleModel(base, tuple((r, float(w)) for (r, _), w in zip(kept, weights, strict=True) if w))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """docs(text, ...) with score (0 to 1) and predicted (1 if score >= 0.5)."""
    stay = [c for c in docs.columns if c not in ("score", "predicted")]
    # the generator binds the statistics once a row: a filter on the result cannot pass it and write them out again for each rule
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in stay]).alias("row"), F.inline(F.array(F.struct(*statistics(F.col("text"))))))
    rows = rows.select("row", model.score().alias("score"))
    return rows.select("row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
