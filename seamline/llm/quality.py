"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Statistics of a text are column expressions. A forest of shallow trees is grown on labelled rows, every path from a
root to a node becomes a conjunctive rule over the statistics, and a lasso-penalised logistic regression over the
rules keeps few of them. The kept rules and weights become one column expression, so scoring runs inside the scan.

The forest and the lasso see at most MAX_TRAINING_ROWS rows of a dozen numbers, so they are grown in numpy on the driver;
reading the texts, their statistics and all scores are Spark's.

Defined results: a null text counts as empty and is scored like an empty one, very long texts are scored whole; labels
that are null are no labels, and a document with several labelled rows learns from each; of rows with the same id one
text is learnt from; without labels, or with labels of one kind only, the score is the
smoothed share of label 1 (1.0 without any), the same for each row; repeated rows get equal scores; an empty table
gives an empty result; classify() keeps other columns but replaces score and predicted, accepted() keeps all columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import whole

#: The classifier is fitted on at most so many labelled rows, those whose ids have the smallest hashes. Scores cover all rows.
MAX_TRAINING_ROWS = 12_000


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, each a column of doubles; ratios are per character or per word."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.size(F.split(text, r"\s+")).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / n

    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "word_length": n / words,
        "upper_runs": F.regexp_count(text, F.lit(r"\p{Lu}{2,}")) / words,
        "marks": share(r"[#*$%&@^~<>{}=_+]"),
        "mark_runs": F.regexp_count(text, F.lit(r"[#*$%&!?@^~]{2,}")) / words,
        "bars": F.regexp_count(text, F.lit(r" [|] ")) / words,
        "digits": share(r"[0-9]"),
        "stops": F.regexp_count(text, F.lit(r"[.!?](?=\s|$)")) / words,
        "lines": share(r"\n"),
        "repeats": F.regexp_count(text, F.lit(r"(?<!\S)(\S+)\s+(?=\1(?!\S))")) / words,
        "distinct": F.size(F.array_distinct(F.split(text, r"\s+"))) / words,
    }


@dataclass(frozen=True)
class RuleEnsemble:
    """bias and weighted rules; a rule is a tuple of (statistic, "<=" or ">", threshold), all of which must hold."""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[str, str, float], ...]], ...] = field(default=())

    def score(self, text: Column) -> Column:
        """The logistic of bias plus the weights of the rules that hold."""
        stats = statistics(text)
        used = sorted({s for _, rule in self.rules for s, _, _ in rule})
        if not used:
            return F.lit(1 / (1 + math.exp(-self.bias)))
        row = F.struct(*[stats[s].alias(s) for s in used])

        def term(x: Column) -> Column:
            parts = [F.lit(self.bias)]
            for weight, rule in self.rules:
                holds = reduce(lambda a, b: a & b, [x[s] <= t if op == "<=" else x[s] > t for s, op, t in rule])
                parts.append(F.when(holds, F.lit(weight)).otherwise(F.lit(0.0)))
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, parts)))

        return F.transform(F.array(row), term)[0]

    def score_of(self, stats: dict[str, float]) -> float:
        """The same for one text's statistics in plain Python."""
        total = self.bias + sum(w for w, rule in self.rules if all(stats[s] <= t if op == "<=" else stats[s] > t for s, op, t in rule))
        return 1 / (1 + math.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, rows: np.ndarray, names: list[str], cuts: list[np.ndarray], depth: int, rng: np.random.Generator, held: tuple = ()) -> list[tuple]:
    """The conditions that lead to each node below the root of a tree grown on some rows, split by the Gini index."""
    n, ones = len(rows), int(y[rows].sum())
    if depth == 0 or ones in (0, n):
        return []
    best, found = 1e-9, None
    for f in sorted(rng.choice(len(names), size=max(1, -(-len(names) // 3)), replace=False).tolist()):
        place = np.searchsorted(cuts[f], x[rows, f])  # x <= cuts[k] where place <= k
        all_, one = (np.cumsum(np.bincount(place, weights=w, minlength=len(cuts[f]) + 1))[:-1] for w in (np.ones(n), y[rows]))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.nan_to_num(one**2 / all_ + (ones - one) ** 2 / (n - all_) - ones**2 / n)
        if len(gain) and gain.max() > best:
            best, found = gain.max(), (f, float(cuts[f][int(gain.argmax())]))
    if found is None:
        return []
    f, at = found
    left = x[rows, f] <= at
    paths = []
    for side, part in (("<=", rows[left]), (">", rows[~left])):
        rule = (*held, (names[f], side, at))
        paths += [rule, *_paths(x, y, part, names, cuts, depth - 1, rng, rule)]
    return paths


def _merged(rule: tuple) -> tuple:
    """One bound for each statistic and side, the tightest."""
    bounds: dict[tuple[str, str], float] = {}
    for name, side, at in rule:
        old = bounds.get((name, side), at)
        bounds[name, side] = min(old, at) if side == "<=" else max(old, at)
    return tuple(sorted((n, s, t) for (n, s), t in bounds.items()))


def _holds(x: np.ndarray, names: list[str], rule: tuple) -> np.ndarray:
    return reduce(np.logical_and, [x[:, names.index(s)] <= t if op == "<=" else x[:, names.index(s)] > t for s, op, t in rule])


def _lasso(held: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of the logistic regression with an L1 penalty on the weights, by accelerated proximal gradients."""
    data = np.hstack([np.ones((len(y), 1)), held])
    rate = 4.0 * len(y) / np.linalg.norm(data, 2) ** 2
    w = seen = np.zeros(data.shape[1])
    t = 1.0
    for _ in range(steps):
        step = seen - rate * (data.T @ (1 / (1 + np.exp(-(data @ seen))) - y)) / len(y)
        step[1:] = np.sign(step[1:]) * np.maximum(np.abs(step[1:]) - rate * penalty, 0)
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        seen, w, t = step + (t - 1) / after * (step - w), step, after
    return float(w[0]), w[1:]


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", usable: Column | None = None, limit: int = MAX_TRAINING_ROWS, text: str = "text") -> DataFrame:
    """(y, statistics): a bounded set of labelled rows. The labels are chosen first, so texts are never shuffled.

    A labelled row learns from one text: of several rows with its id, that with the smallest statistics.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    if usable is not None:
        chosen = chosen.filter(usable)
    chosen = chosen.select(F.col(doc_id).alias("__seam_id"), F.col(label).cast("double").alias("__seam_y"))
    chosen = chosen.orderBy(F.xxhash64("__seam_id"), "__seam_id", "__seam_y").limit(limit)
    ids = chosen.select("__seam_id").distinct()
    plain = docs.select(F.col(doc_id).alias("__seam_doc"), whole(text).alias("__seam_text"))
    found = plain.join(F.broadcast(ids), F.col("__seam_doc") == F.col("__seam_id"), "left_semi")
    stats = statistics(F.col("__seam_text"))
    least = found.groupBy("__seam_doc").agg(F.min(F.struct(*[c.alias(k) for k, c in stats.items()])).alias("x"))
    return chosen.join(least, F.col("__seam_doc") == F.col("__seam_id")).select(F.col("__seam_y").alias("y"), *[F.col("x")[k].alias(k) for k in stats])


def fit(rows: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 17, max_rules: int = 60, cut_points: int = 64) -> RuleEnsemble:
    """Grow the trees, turn their paths into rules, and keep those that the lasso gives a weight.

    The rows are bounded by training_rows and read by the driver; their order doesn't matter.
    """
    names = [c for c in rows.columns if c != "y"]
    got = rows.select("y", *names).toArrow()
    x = np.stack([got.column(c).to_numpy() for c in ("y", *names)], axis=1)
    x = x[np.lexsort(x.T)]
    x, y = x[:, 1:], x[:, 0]
    n, ones = len(y), float(y.sum())
    share = (ones + 1.0) / (n + 1.0) if n else 1.0
    flat = RuleEnsemble(30.0 if not n else max(-30.0, min(30.0, math.log(max(share, 1e-9) / max(1 - share, 1e-9)))))
    if n == 0 or ones in (0, n):
        return flat
    cuts = []
    for column in x.T:
        values = np.unique(column)
        near = np.unique(np.linspace(0, len(values) - 1, cut_points + 1).astype(int)[:-1]) if len(values) > 1 else np.zeros(0, int)
        cuts.append((values[near] + values[near + 1]) / 2 if len(near) else values[:0])
    rng = np.random.default_rng(seed)
    rules = sorted({_merged(p) for _ in range(trees) for p in _paths(x, y, rng.integers(0, n, n), names, cuts, depth, rng)}, key=lambda r: (len(r), r))
    if not rules:
        return flat
    bias, weights = _lasso(np.stack([_holds(x, names, r) for r in rules], axis=1).astype(np.float64), y, penalty)
    weighted = sorted(((float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-6), key=lambda p: -abs(p[0]))[:max_rules]
    return RuleEnsemble(bias, tuple(weighted))


def classify(docs: DataFrame, ensemble: RuleEnsemble, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """docs with score and predicted (1 where the score reaches the threshold)."""
    scored = docs.withColumn("score", ensemble.score(whole(text)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, ensemble: RuleEnsemble, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs that classify() predicts as 1, with their own columns alone."""
    return docs.filter(ensemble.score(whole(text)) >= threshold)
