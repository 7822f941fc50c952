"""Quality classifier: a sparse ensemble of rules, scored by Spark column expressions.

Shallow trees are boosted over text statistics on the driver; every path from a root to a node
is a conjunctive rule; a lasso logistic regression keeps the few rules that matter and weighs
them; the kept rules and weights become one Spark expression. The rows that trees and lasso see
are a bounded sample of labelled rows; all documents are scored, whole.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import SPACES, fresh, shielded, words
from tidewright.llm.quality_rules import STOP_WORDS, SYMBOLS
from tidewright.session import cut

#: Most labelled rows that a model is fitted on.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAF = 40, 3, 0.3, 32, 20
#: Lasso penalty on the mean log loss, and rounds of proximal gradient.
PENALTY, ROUNDS = 0.0015, 1500


class Rule(NamedTuple):
    """A conjunction of tests (feature, "<=" or ">", threshold)."""

    tests: tuple[tuple[str, str, float], ...]
    weight: float


class Model(NamedTuple):
    bias: float
    rules: tuple[Rule, ...]


def features(w: Column, text: Column) -> dict[str, Column]:
    """Double statistics of a text (not null) and its array of words w; ratios of nothing are 0."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    n, n_lines = F.greatest(F.size(w), F.lit(1)), F.greatest(F.size(lines), F.lit(1))
    without = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    solid = F.greatest(F.char_length(F.translate(text, SPACES, "")), F.lit(1))
    stutter = F.transform(F.array(w), lambda v: F.size(F.filter(F.transform(v, lambda x, i: x == F.get(v, i - 1)), lambda same: F.coalesce(same, F.lit(False)))))[0]
    found = {
        "words": F.size(w),
        "word_length": solid / n,
        "symbols": without(SYMBOLS) / n,
        "marks": without("!?") / n,
        "stops": without(".,;:") / n,
        "capitals": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / solid,
        "digits": without("0123456789") / solid,
        "distinct": F.size(F.array_distinct(w)) / n,
        "stutter": stutter / n,
        "function_words": F.size(F.filter(w, lambda x: x.isin(*sorted(set(STOP_WORDS))))) / n,
        "lines": F.size(lines),
        "words_a_line": F.size(w) / n_lines,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
    }
    return {k: v.cast("double") for k, v in found.items()}


def with_features(docs: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with a column for each feature of the text (null: as empty), and their names by
    feature. They are plain columns: a struct would be taken apart and computed for each use."""
    t, w = fresh(docs, "ensemble_text", "ensemble_words")
    rows = docs.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn(w, words(F.col(t)))
    found = features(F.col(w), F.col(t))
    names = dict(zip(found, fresh(rows, *(f"ensemble_{k}" for k in found)), strict=True))
    return rows.withColumns({names[k]: c for k, c in found.items()}).drop(t, w), names


def _tree(codes: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> list[tuple[tuple[tuple[int, bool, int], ...], float]]:
    """One tree on binned features: (path, value) of every node but the root. A test is
    (feature, is it above, bin); values are Newton steps."""
    out = []

    def grow(rows: np.ndarray, path: tuple, depth: int) -> None:
        g, h = grad[rows], hess[rows]
        if path:
            out.append((path, float(-g.sum() / (h.sum() + 1.0))))
        if depth == DEPTH or len(rows) < 2 * LEAF:
            return
        best, base = None, g.sum() ** 2 / (h.sum() + 1.0)
        for f in range(codes.shape[1]):
            c = codes[rows, f]
            gs, hs, ns = (np.bincount(c, x, BINS)[:-1].cumsum() for x in (g, h, np.ones(len(rows))))
            gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - base
            gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = -1
            b = int(gain.argmax())
            if gain[b] > 1e-6 and (best is None or gain[b] > best[0] + 1e-12):
                best = (gain[b], f, b)
        if best:
            _, f, b = best
            low = codes[rows, f] <= b
            grow(rows[low], (*path, (f, False, b)), depth + 1)
            grow(rows[~low], (*path, (f, True, b)), depth + 1)

    grow(np.arange(len(codes)), (), 0)
    return out


def fit(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = PENALTY) -> Model:
    """Rules and lasso logistic weights for labels y (0 or 1) over features x.

    No rows: the score is one half; one class: its smoothed share. Nothing here is random."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    bias = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Model(bias, ())
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score, paths = np.full(n, bias), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        nodes = _tree(codes, p - y, p * (1 - p))
        leaves = [k for k in nodes if not any(o[0][: len(k[0])] == k[0] and len(o[0]) > len(k[0]) for o in nodes)]
        for path, value in leaves:
            score[_holds(codes, path)] += RATE * value
        for path, _ in nodes:
            paths.setdefault(tuple(sorted(path)), None)
    masks = {}
    for path in paths:
        m = _holds(codes, path)
        if LEAF <= m.sum() <= n - LEAF:
            masks.setdefault(m.tobytes(), (path, m))
    kept = [path for path, _ in masks.values()]
    if not kept:
        return Model(bias, ())
    a = np.stack([m for _, m in masks.values()], axis=1).astype(np.float64)
    spread = a.std(axis=0)
    a = (a - a.mean(axis=0)) / spread
    weights, b = _lasso(a, y.astype(np.float64), penalty)
    mean = np.stack([m for _, m in masks.values()], axis=1).mean(axis=0)
    raw = weights / spread
    rules = []
    for path, weight in zip(kept, raw, strict=True):
        if weight:
            tests = tuple((names[f], ">" if above else "<=", float(edges[f][c])) for f, above, c in path if c < len(edges[f]))
            rules.append(Rule(tests, float(weight)))
    return Model(float(b - (raw * mean).sum()), tuple(rules))


def _holds(codes: np.ndarray, path) -> np.ndarray:
    m = np.ones(len(codes), bool)
    for f, above, c in path:
        m &= (codes[:, f] > c) == above
    return m


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the mean log loss plus penalty times the l1 norm."""
    n, k = a.shape
    full = np.hstack([a, np.ones((n, 1))])
    step = 4.0 / (np.linalg.norm(full, 2) ** 2 / n)
    w = z = np.zeros(k + 1)
    t = 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(full @ z, -40, 40)))
        new = z - step * (full.T @ (p - y)) / n
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-7:
            w = new
            break
        w, t = new, t2
    return w[:k], float(w[k])


def learn(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, penalty: float = PENALTY) -> Model:
    """Fit on the documents of at most `sample` labelled rows, those with the least id hashes.

    Rows without a label or an id teach nothing; of documents that repeat an id the one with
    the least statistics does. labels may be any table with doc_id and the label; pass only
    rows that may be learnt from."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
    known = known.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    # at most `sample` rows of two numbers: a proven bound for a broadcast
    rows = rows.join(F.broadcast(cut(known)), F.col("_doc") == F.col("_id"))
    rows, names = with_features(rows.select("_id", "_y", "_text"), "_text")
    rows = rows.select("_id", "_y", F.struct(*names.values()).alias("_f")).groupBy("_id", "_y").agg(F.min("_f").alias("_f"))
    table = rows.orderBy("_id").select("_y", "_f.*").toPandas()
    table.columns = ["_y", *names]
    names = list(names)
    return fit(table[names].to_numpy(np.float64), table["_y"].to_numpy(np.float64), names, penalty)


def compile_score(model: Model, names: dict[str, str]) -> Column:
    """The model as one expression over the columns of its features, between 0 and 1."""
    total = F.lit(model.bias)
    for rule in model.rules:
        holds = F.lit(True)
        for name, op, x in rule.tests:
            c = F.col(names[name])
            holds &= (c > x) if op == ">" else (c <= x)
        total += F.when(holds, F.lit(rule.weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


@shielded(["text"], ["out"])
def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a double column `out`: how likely label 1 is. Null texts score as empty ones;
    each row is scored alone, so repeated rows agree; other columns are untouched and unread."""
    rows, names = with_features(docs, text)
    return rows.withColumn(out, compile_score(model, names)).drop(*names.values())
