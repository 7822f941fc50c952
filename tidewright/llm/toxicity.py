"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other texts are unlabelled, toxic or not. Words and
word beginnings that positives have far more often than all other texts of the corpus make a
lexicon; a text's evidence is the sum of its hits against its length. Over that evidence a
classifier is trained with numpy on the risk estimator that corrects the unlabelled risk for the
positives' share and never lets the negative part fall below zero (Kiryo et al., 2017). Only the
positives are bounded; background rates and the unlabelled risk are from every other document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import shielded, travels
from tidewright.session import cut

#: Most confirmed toxic texts that a model is fitted on.
POSITIVES = 4_000
#: How a word's beginnings count as terms: their lengths in characters.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Different lines of positives that a term must be in.
LEAST_LINES = 4
#: Least ratio of a term's rate in positives to its rate in all other texts, and the chance that
#: any one of all terms tried passes without cause.
LEAST_LIFT, CHANCE = 2.5, 0.05
#: Steps of the table of unlabelled texts: 1 / STEP of evidence, and numbers of hits.
STEP, STEPS, HITS = 16, 256, 32
#: Words a task remembers the terms of.
REMEMBER = 300_000
EPOCHS, RATE = 600, 0.05
#: ASCII but letters, digits and the line break is no part of a word.
FOLD = bytes(b if b == 10 or 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

travels(__name__)


class Model(NamedTuple):
    """weight of each term; weights of evidence and of log(1 + hits); bias."""

    terms: dict[str, float]
    by_evidence: float
    by_hits: float
    bias: float


def folded(text: str | None) -> str:
    """A text in lower case, with spaces for what is no part of a word."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(FOLD).decode("utf-8", "surrogatepass")


def words_by_line(text: str | None) -> Counter:
    """Lower-cased words of a text, each counted once a line, equal lines once."""
    out: Counter = Counter()
    for line in dict.fromkeys(folded(text).split("\n")):
        out.update(set(line.split()))
    return out


def terms_of(word: str) -> list[str]:
    """A word's terms: itself and, marked by a final *, its beginnings."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) >= k)]


def positive_terms(positives: Iterable[str | None]) -> tuple[dict[str, int], int]:
    """Terms in at least LEAST_LINES lines of positives and how often, and the words counted.

    Equal lines of different texts count once, so that copies of a text are no evidence."""
    seen: set[str] = set()
    words: Counter = Counter()
    for text in positives:
        for line in dict.fromkeys(" ".join(x.split()) for x in folded(text).split("\n")):
            if line not in seen:
                seen.add(line)
                words.update(set(line.split()))
    terms: Counter = Counter()
    for w, n in words.items():
        for t in terms_of(w):
            terms[t] += n
    return {t: n for t, n in terms.items() if n >= LEAST_LINES}, sum(words.values())


def fresh_contexts(positives: Iterable[str | None], terms: Iterable[str]) -> dict[str, int]:
    """How often each term stands between two words of which neither stood on that side of it
    before. Copies of a passage, altered here and there, add next to nothing."""
    wanted, known = set(terms), {}
    before: dict[str, set[str]] = {t: set() for t in wanted}
    after: dict[str, set[str]] = {t: set() for t in wanted}
    out: Counter = Counter()
    for text in positives:
        words = ["", *folded(text).split(), ""]
        for i in range(1, len(words) - 1):
            w = words[i]
            if (ts := known.get(w)) is None:
                ts = known[w] = tuple(t for t in terms_of(w) if t in wanted)
            for t in ts:
                left, right = words[i - 1], words[i + 1]
                if left not in before[t] and right not in after[t]:
                    out[t] += 1
                before[t].add(left)
                after[t].add(right)
    return dict(out)


def choose_terms(positives: list[str | None], counts: dict[str, int], n_words: int, background: dict[str, int], n_background: int) -> dict[str, float]:
    """Weights of the terms that stand out, none of which is a beginning of another.

    A term stands out if its log likelihood ratio against the background rate, by its fresh
    contexts alone, would be reached by chance in CHANCE of all trials of as many terms, and its
    lift is LEAST_LIFT at least. The weight is the log of the lift. Of nested terms the one with
    most evidence stays, of equal ones the longest beginning, then the word."""
    if not counts or not n_words:
        return {}
    bar = math.log(len(counts) / CHANCE)
    expected = {t: n_words * (background.get(t, 0) + 0.5) / (n_background + 1) for t in counts}
    ratio = lambda k, e: k * math.log(k / e) - k + e if k > e else 0.0
    lifted = [t for t, k in counts.items() if k > LEAST_LIFT * expected[t] and ratio(k, expected[t]) > bar]
    contexts = fresh_contexts(positives, lifted)
    found = [(-round(r, 6), -len(t), t) for t in lifted if (r := ratio(contexts.get(t, 0), expected[t])) > bar]
    out: dict[str, float] = {}
    above: set[str] = set()
    for _, _, t in sorted(found):
        stem = t.removesuffix("*")
        if t in above or any(stem[:k] + "*" in out for k in BEGINNINGS if k <= len(stem)) or stem in out:
            continue
        out[t] = math.log(counts[t] / expected[t])
        above.update(stem[:k] + "*" for k in BEGINNINGS if k <= len(stem))
        above.add(stem)
    return out


class Lexicon:
    """Evidence of texts by known terms, remembering which words have none and which have one."""

    def __init__(self, terms: dict[str, float]):
        self.terms, self.known, self.hits = terms, set(), {}

    def weight(self, word: str) -> float:
        return max((self.terms[t] for t in terms_of(word) if t in self.terms), default=0.0)

    def evidence(self, text: str | None) -> tuple[float, int]:
        """Sum of the weights of hits against the square root of the words, and the hits."""
        words = words_by_line(text)
        if len(self.known) >= REMEMBER:
            self.known.clear()
            self.hits.clear()
        if new := words.keys() - self.known:
            self.known |= new
            self.hits |= {w: x for w in new if (x := self.weight(w))}
        found = self.hits.keys() & words.keys()
        total = math.fsum(self.hits[w] * words[w] for w in found)
        return total / math.sqrt(sum(words.values()) or 1), sum(words[w] for w in found)


def train(positive: np.ndarray, unlabelled: np.ndarray, mass: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Weights of the columns (evidence, log(1 + hits)) and the bias by full batches of the
    non-negative risk with the sigmoid loss; unlabelled rows count by mass. Weights don't fall
    below zero: hits never speak for a text. Nothing is random."""
    prior = float(np.clip(prior, 0.001, 0.9))
    scale = np.maximum(positive.std(axis=0), 1e-3)
    xp, xu = positive / scale, unlabelled / scale
    share = mass / max(1.0, mass.sum())
    at, m, v = np.array([1.0, 1.0, -2.0]), np.zeros(3), np.zeros(3)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, EPOCHS + 1):
        sp, su = sigmoid(xp @ at[:2] + at[2]), sigmoid(xu @ at[:2] + at[2])
        # sigmoid loss: 1 - s for a positive, s for a negative
        negative = su @ share - prior * sp.mean()
        dp, du = sp * (1 - sp) / len(sp), su * (1 - su) * share
        # below zero the part of the negative risk that has gone too far is undone
        cp, cu = (-2 * prior * dp, du) if negative >= 0 else (prior * dp, -du)
        g = np.array([*(cp @ xp + cu @ xu), cp.sum() + cu.sum()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        at = at - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        at[:2] = np.maximum(at[:2], 0.0)
    return float(at[0] / scale[0]), float(at[1] / scale[1]), float(at[2])


def _totals(texts: DataFrame, terms: list[str]) -> tuple[dict[str, int], int]:
    """How often all texts have each of the terms, counted as in words_by_line, and their words."""
    sent = texts.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, sums, words = sent.value, {}, Counter(), Counter()

        def add() -> None:
            """Words counted so far as terms."""
            for word, k in words.items():
                js = known.get(word)
                if js is None:
                    if len(known) >= REMEMBER:
                        known.clear()
                    js = known[word] = tuple(at[t] for t in terms_of(word) if t in at)
                for j in js:
                    sums[j] += k
            sums[-1] += sum(words.values())
            words.clear()

        for batch in batches:
            for text in batch.column(0):
                for line in dict.fromkeys(folded(text.as_py()).split("\n")):
                    words.update(set(line.split()))
                if len(words) >= REMEMBER:
                    add()
        add()
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(sums), pa.int64()), "n": pa.array(list(sums.values()), pa.int64())})

    # rows: at most one per term, of which there are as many as the bounded positives have
    found = {r["term"]: r["n"] for r in texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
    sent.unpersist()
    n = found.pop(-1, 0)
    return {terms[j]: k for j, k in found.items()}, n


def _table(texts: DataFrame, terms: dict[str, float]) -> list[tuple[int, int, int]]:
    """(evidence in steps, hits, how many texts) over all texts; STEPS x HITS rows at most."""
    sent = texts.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, seen = Lexicon(sent.value), Counter()
        for batch in batches:
            for text in batch.column(0):
                e, hits = lexicon.evidence(text.as_py())
                seen[min(STEPS - 1, round(e * STEP)), min(HITS - 1, hits)] += 1
        cells = sorted(seen)
        yield pa.RecordBatch.from_pydict({"e": pa.array([c[0] for c in cells], pa.int64()), "h": pa.array([c[1] for c in cells], pa.int64()), "n": pa.array([seen[c] for c in cells], pa.int64())})

    rows = texts.mapInArrow(count, "e long, h long, n long").groupBy("e", "h").agg(F.sum("n").alias("n")).orderBy("e", "h").collect()
    sent.unpersist()
    return [tuple(r) for r in rows]


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", prior: float | None = None, n_positive: int = POSITIVES) -> Model:
    """Fit on at most n_positive texts with label 1, those with the least hashes of their ids,
    against all other texts.

    labels holds only rows that may be learnt from. Of them only those with label 1 are told;
    every other document is unlabelled, but for copies of a told text. prior, if not given, is
    the share of label 1 among the labels. Null labels and ids teach nothing; without positives
    or terms that stand out every score is below one half."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.max("_y").alias("_y"))
    n, ones = known.agg(F.count("*"), F.sum("_y")).first()
    told = cut(known.where("_y = 1").orderBy(F.xxhash64("_id"), "_id").limit(n_positive).select("_id"))
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).cast("string").alias("_text"))
    # at most n_positive ids: a proven bound for a broadcast
    found = rows.join(F.broadcast(told), F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.min("_text").alias("_text"))
    positives = [r["_text"] for r in found.orderBy("_id").select("_text").toLocalIterator()]
    counts, n_words = positive_terms(positives)
    if not counts:
        return Model({}, 0.0, 0.0, -3.0)
    marks = cut(found.select(F.xxhash64("_text").alias("_mark")).distinct())
    others = rows.join(F.broadcast(marks), F.xxhash64("_text") == F.col("_mark"), "left_anti").select("_text")
    background, n_background = _totals(others, sorted(counts))
    terms = choose_terms(positives, counts, n_words, background, n_background)
    if not terms:
        return Model({}, 0.0, 0.0, -3.0)
    lexicon = Lexicon(terms)
    table = _table(others, terms)
    xp = np.array([(e, math.log1p(h)) for e, h in map(lexicon.evidence, positives)])
    xu = np.array([(e / STEP, math.log1p(h)) for e, h, _ in table]).reshape(-1, 2)
    return Model(terms, *train(xp, xu, np.array([k for _, _, k in table], float), prior if prior is not None else (ones or 0) / max(1, n)))


def score_of(lexicon: Lexicon, model: tuple, text: str | None) -> float:
    """The score of one text; model: the numbers of a Model after its terms."""
    e, hits = lexicon.evidence(text)
    z = model[2] + model[0] * e + model[1] * math.log1p(hits)
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


@shielded(["text"], ["out"])
def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a double column `out`: how likely the whole text is toxic.

    A text without known terms, null and empty ones too, scores the bias alone; long texts are
    read whole. Rows are scored one by one, so repeated rows agree; an empty table gives an
    empty one; other columns are untouched and unread."""
    # plain values only: executors may not have this library to unpickle its classes
    sent = docs.sparkSession.sparkContext.broadcast((dict(model.terms), tuple(model[1:])))

    @F.arrow_udf(T.DoubleType())
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms, numbers = sent.value
        lexicon = Lexicon(terms)
        for batch in batches:
            yield pa.array([score_of(lexicon, numbers, t.as_py()) for t in batch], pa.float64())

    return docs.withColumn(out, scored(F.col(text).cast("string")))
