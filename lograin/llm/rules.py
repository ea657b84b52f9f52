"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees on a bounded sample of labelled documents propose rules: every
path from a root to a node is a conjunction of thresholds. A logistic regression with
a lasso penalty gives most rules no weight. What is left is compiled into one Spark
column over the statistics, so all documents are scored by generated code.

The sample has at most :data:`SAMPLE_ROWS` labelled rows, taken by the hash of their
statistics' row; statistics themselves cover every document and whole texts.

Defined cases: null and empty texts have all statistics 0 and are scored from those;
null labels are ignored; repeated rows are scored each; without labels of both kinds
the score is the share of label 1 (1 without labels: nothing is known against a text); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograin.session import materialize

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 24, 3, 64, 0.3
LASSO, LASSO_STEPS = 0.002, 600
#: Character groups counted in each text.
GROUPS = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "stress": "!?",
    "symbol": "*&%$#@~^=+_<>",
    "table": "|",
    "stop": ".,;:",
    "line": "\n",
}
STATISTICS = ("chars", "words", "word_chars", "distinct", "repeated", *GROUPS)


def statistics(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, one double per statistic, ``more``) of every document, in one pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    kept = [f"_more{i}" for i in range(len(more))]
    plain = docs.select(*[c.alias(n) for c, n in zip(more, kept)], "doc_id", text.alias("text"), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("parts"))
    chars, words = F.length("text"), F.size("parts")
    again = F.aggregate(
        "parts", F.struct(F.lit("").alias("last"), F.lit(0).alias("n")),
        lambda a, w: F.struct(w.alias("last"), (a["n"] + (w == a["last"]).cast("int")).alias("n")),
    )["n"]
    values = {
        "chars": F.log1p(chars), "words": F.log1p(words),
        "word_chars": F.length(F.array_join("parts", "")) / F.greatest(words, F.lit(1)),
        "distinct": F.size(F.array_distinct("parts")) / F.greatest(words, F.lit(1)),
        "repeated": again / F.greatest(words, F.lit(1)),
    }
    for name, group in GROUPS.items():
        values[name] = (chars - F.length(F.translate("text", group, ""))) / F.greatest(chars, F.lit(1))
    return plain.select("doc_id", *[values[n].cast("double").alias(n) for n in STATISTICS], *kept)


@dataclass(frozen=True)
class Rule:
    """All of (statistic, threshold, above) hold."""

    terms: tuple[tuple[int, float, bool], ...]

    def on(self, x: np.ndarray) -> np.ndarray:
        holds = np.ones(len(x), bool)
        for i, threshold, above in self.terms:
            holds &= (x[:, i] > threshold) if above else (x[:, i] <= threshold)
        return holds

    def column(self) -> Column:
        holds = F.lit(True)
        for i, threshold, above in self.terms:
            one = F.col(STATISTICS[i])
            holds = holds & ((one > threshold) if above else (one <= threshold))
        return holds


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 as a column over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]


def _grow(cells: np.ndarray, edges: list[np.ndarray], pull: np.ndarray, weight: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """One tree by Newton gains: its rules and the step of every row."""
    rules, step = [], np.zeros(len(pull))

    def node(rows: np.ndarray, terms: tuple, depth: int) -> None:
        g, h = pull[rows].sum(), weight[rows].sum()
        if terms:
            rules.append(Rule(terms))
        best = (1e-3, -1, -1)
        if depth < DEPTH and len(rows) > 20:
            for i, own in enumerate(edges):
                if not len(own):
                    continue
                gs = np.cumsum(np.bincount(cells[rows, i], pull[rows], len(own) + 1))[:-1]
                hs = np.cumsum(np.bincount(cells[rows, i], weight[rows], len(own) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                at = int(gain.argmax())
                best = max(best, (float(gain[at]), i, at))
        _, i, at = best
        if i < 0:
            step[rows] = g / (h + 1)
            return
        left = cells[rows, i] <= at
        node(rows[left], (*terms, (i, float(edges[i][at]), False)), depth + 1)
        node(rows[~left], (*terms, (i, float(edges[i][at]), True)), depth + 1)

    node(np.arange(len(pull)), (), 0)
    return rules, step


def propose(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Rules on the paths of boosted trees."""
    edges = _edges(x)
    # a value on an edge belongs below it, as in Rule
    cells = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    total, found = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        rules, step = _grow(cells, edges, y - p, p * (1 - p))
        total += RATE * step
        found.update(dict.fromkeys(rules))
    return list(found)


def select(x: np.ndarray, y: np.ndarray, rules: list[Rule]) -> Ensemble:
    """Lasso logistic regression over the rules, by accelerated proximal gradient steps."""
    on = np.column_stack([r.on(x) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))
    mean = on.mean(axis=0)
    centred = on - mean
    w, b = np.zeros(on.shape[1]), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    ahead, t = w, 1.0
    rate = 4 * len(y) / max(np.linalg.norm(centred, 2) ** 2, 1.0)
    for _ in range(LASSO_STEPS):
        gap = 1 / (1 + np.exp(-np.clip(centred @ ahead + b, -30, 30))) - y
        moved = ahead - rate * (centred.T @ gap) / len(y)
        following = np.sign(moved) * np.maximum(np.abs(moved) - rate * LASSO, 0)
        b -= 4 * gap.mean()
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = following + (t - 1) / later * (following - w), following, later
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble(tuple(rules[i] for i in kept), tuple(float(w[i]) for i in kept), float(b - mean @ w))


def first_rows(known: DataFrame, rows: int) -> DataFrame:
    """The first rows by a hash of theirs, ties by label."""
    mark = F.xxhash64("doc_id", *STATISTICS)
    # a hash threshold lets a little more than the sample through, so tasks sort and send little
    share = (1.1 * rows + 1000) / max(known.count(), 1)
    if share < 1:
        known = known.filter(mark < int(share * 2**64) - 2**63)
    return known.orderBy(mark, "label").limit(rows)


def fit(measured: DataFrame, labels: DataFrame) -> Ensemble:
    """Learn from the documents that ``labels`` (doc_id, label) names: at most SAMPLE_ROWS, the first by a hash."""
    known = measured.join(labels.filter("label is not null"), "doc_id")
    sample = first_rows(known, SAMPLE_ROWS)
    rows = sample.select(*STATISTICS, F.col("label").cast("double")).toPandas().to_numpy(float)
    x, y = rows[:, :-1], rows[:, -1]
    if len(np.unique(y)) < 2:
        share = y.mean() if len(y) else 1.0
        return Ensemble((), (), 30.0 if share else -30.0)
    return select(x, y, propose(x, y))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every document; ``labels`` are those that training may see."""
    measured = materialize(statistics(docs))
    return measured.select("doc_id", fit(measured, labels).score().alias("score"))
