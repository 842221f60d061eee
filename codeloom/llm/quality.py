"""Operator 7: quality classifier from weak labels.

Overlapping heuristic labellers vote on every document: bad, or no vote. Votes are
counted by pattern over all documents; expectation-maximisation on these counts
(at most 2 ** labellers patterns) estimates each labeller's accuracy and coverage
with no true labels. The posteriors of a bounded sample of documents (SAMPLE, by
hash of doc_id and text) train a hashed linear scorer on word shapes and binned
statistics, and the scorer judges all documents.

Defined cases: null and empty texts score as texts without words, for which the
labellers vote bad; repeated rows score alike; an empty table gives no rows; other
columns are carried along by keep().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Buckets of hashed features; documents that train the scorer; rounds of both fits.
BUCKETS, SAMPLE, EM_ROUNDS, EPOCHS = 1 << 12, 3000, 60, 12

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 or b >= 0xC3 for b in range(256)])
_SYMBOL = np.array([33 <= b <= 126 and not chr(b).isalnum() and chr(b) not in ".,'" for b in range(256)])
_WORDLIKE = [b >= 0x80 or chr(b).isalnum() for b in range(256)]
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])

STATISTICS = ("words", "upper", "shouted", "symbols", "odd", "digits", "repeated", "adjacent", "length", "lines")
_ENDS = frozenset(b".,;:!?'\")]")


def statistics(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Statistics of a text, and its words."""
    words = text.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = int(counts[_UPPER].sum()), int(counts[_LOWER].sum())
    solid = max(1, len(text) - int(counts[32] + counts[9:14].sum()))
    kinds = Counter(words)
    adjacent = sum(a == b for a, b in zip(words, words[1:], strict=False))
    shouted = sum(k for w, k in kinds.items() if w.isupper() and len(w) > 1)
    odd = sum(k for w, k in kinds.items() if (w[-1] not in _ENDS and not _WORDLIKE[w[-1]]))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        np.array(
            [
                n,
                upper / max(1, upper + lower),
                shouted / max(1, n),
                counts[_SYMBOL].sum() / solid,
                odd / max(1, n),
                counts[_DIGIT].sum() / solid,
                1 - len(kinds) / n if n else 0.0,
                adjacent / max(1, n - 1),
                solid / max(1, n),
                1 - len(set(lines)) / len(lines) if lines else 0.0,
            ]
        ),
        words,
    )


def votes(s: np.ndarray) -> list[int]:
    """One vote per labeller: 1 bad, 0 none."""
    n, upper, shouted, symbols, odd, digits, repeated, adjacent, length, lines = s
    usual = 0.25 + 0.1 * math.log10(n + 1)  # repeats that texts of this length have anyway
    tests = [n < 3, upper > 0.4, shouted > 0.5, symbols > 0.1, odd > 0.2, digits > 0.3, n >= 10 and repeated > min(0.95, usual + 0.25), adjacent > 0.15, n > 0 and not 2 <= length <= 20, lines > 0.6]
    return [int(bool(t)) for t in tests]


LABELLERS = ("too short", "capitals", "shouting", "symbols", "odd words", "digits", "repetition", "stutter", "word length", "repeated lines")


class WeakLabels:
    """Two classes, labellers independent given the class; each has its own rate of votes in either."""

    def __init__(self, patterns: dict[tuple[int, ...], int], rounds: int = EM_ROUNDS):
        self.prior = 0.15
        m = len(LABELLERS)
        # start: a vote is right far more often than not
        self.rates = {True: [0.3] * m, False: [0.005] * m}
        total = sum(patterns.values())
        for _ in range(rounds if total else 0):
            weight = {True: 1.0, False: 1.0}
            seen = {bad: [0.0] * m for bad in (True, False)}
            for pattern, k in patterns.items():
                p = self.posterior(pattern)
                for bad, share in ((True, p * k), (False, (1 - p) * k)):
                    weight[bad] += share
                    for j, v in enumerate(pattern):
                        seen[bad][j] += share * v
            self.prior = min(0.9, max(0.001, weight[True] / (weight[True] + weight[False])))
            self.rates = {bad: [min(0.999, max(1e-4, c / weight[bad])) for c in seen[bad]] for bad in seen}

    def posterior(self, pattern: tuple[int, ...]) -> float:
        """Probability that a document with these votes is bad."""
        odds = math.log(self.prior / (1 - self.prior))
        for v, bad, good in zip(pattern, self.rates[True], self.rates[False], strict=True):
            odds += math.log(bad / good) if v else math.log((1 - bad) / (1 - good))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


_RUNS = re.compile(rb"[A-Z]+|[a-z\x80-\xff]+|[0-9]+|([^A-Za-z0-9\x80-\xff])\1*")


def shape(word: bytes) -> bytes:
    """Letters as A and a, digits as 0, symbols as they are; runs once, but for the longest."""

    def run(m: re.Match) -> bytes:
        c = m.group()[:1]
        kind = b"A" if c.isupper() else b"0" if c.isdigit() else b"a" if c.isalpha() or c >= b"\x80" else c
        return kind + b"+" * (len(m.group()) > 1)

    return _RUNS.sub(run, word)


class _Buckets(dict):
    """Word -> bucket of its shape; bounded by emptying, long words aren't held."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(shape(word)) % BUCKETS
        if len(word) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[word] = out
        return out


_BUCKETS = _Buckets()


def features(s: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: shares of word shapes, and statistics in bins."""
    out: dict[int, float] = {}
    if words:
        at = np.bincount(np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, len(words)), minlength=1)
        for i in np.flatnonzero(at):
            out[int(i)] = float(at[i]) / len(words)
    for name, value in zip(STATISTICS, s, strict=True):
        bin_ = int(math.log2(value + 1)) if name in ("words", "length") else int(round(10 * value))
        i = xxhash.xxh3_64_intdigest(f"{name}={bin_}") % BUCKETS
        out[i] = out.get(i, 0.0) + 1.0
    return np.fromiter(out, np.int64), np.fromiter(out.values(), np.float64)


class Scorer:
    """Logistic regression on hashed features, fitted to posteriors."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], targets: list[float], epochs: int = EPOCHS):
        self.weights, self.bias = np.zeros(BUCKETS), 0.0
        square = np.full(BUCKETS, 1e-6)
        square_bias = 1e-6
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(rows)):
                at, value = rows[i]
                error = self._of(at, value) - targets[i]
                slope = error * value + 1e-5 * self.weights[at]
                square[at] += slope**2
                self.weights[at] -= 0.3 * slope / np.sqrt(square[at])
                square_bias += error**2
                self.bias -= 0.3 * error / math.sqrt(square_bias)

    def _of(self, at: np.ndarray, value: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, float(self.weights[at] @ value) + self.bias))))

    def bad(self, text: bytes) -> float:
        return self._of(*features(*statistics(text)))


def _raw(texts: pa.Array) -> Iterator[bytes]:
    for x in texts.cast(pa.binary()):
        yield x.as_py() or b""


def _votes_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of vote patterns in a task: a few rows."""
    counts: Counter = Counter()
    for batch in batches:
        counts.update(tuple(votes(statistics(t)[0])) for t in _raw(batch.column(0)))
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, p)) for p in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])


class Classifier:
    """What fit() learns."""

    def __init__(self, labels: WeakLabels, scorer: Scorer):
        self.labels, self.scorer = labels, scorer


def fit(docs: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Learn from texts alone. Vote counts cover all documents; the scorer's sample is bounded by `sample` documents."""
    counted = docs.select("text").mapInArrow(_votes_task, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    labels = WeakLabels({tuple(map(int, r["pattern"].split(","))): r["n"] for r in counted})
    order = F.xxhash64(F.lit(7), "doc_id", "text")
    total = sum(r["n"] for r in counted)
    drawn = docs.select("doc_id", "text").withColumn("_h", order)
    if total > 2 * sample:  # a share of all rows first, so that only few texts are sorted
        drawn = drawn.filter(F.pmod("_h", F.lit(1 << 30)) < int((1 << 30) * 2.0 * sample / total))
    rows, targets = [], []
    for row in drawn.orderBy("_h").limit(sample).select("text").toLocalIterator():
        s, words = statistics((row["text"] or "").encode("utf-8", "surrogatepass"))
        rows.append(features(s, words))
        targets.append(labels.posterior(tuple(votes(s))))
    return Classifier(labels, Scorer(rows, targets))


def _judge(model: Classifier):
    """Of texts alone: the scorer's and the labellers' probability that a document is bad."""

    @F.arrow_udf("struct<bad: double, posterior: double>")
    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in common.freed(columns):
            bad, posterior = [], []
            for t in _raw(texts):
                s, words = statistics(t)
                bad.append(model.scorer._of(*features(s, words)))
                posterior.append(model.labels.posterior(tuple(votes(s))))
            yield pa.StructArray.from_arrays([pa.array(bad, pa.float64()), pa.array(posterior, pa.float64())], ["bad", "posterior"])
        _BUCKETS.clear()

    return judge


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with _bad (the scorer's probability that it is bad) and _posterior (the labellers'); columns of these names are replaced.

    Only texts go to Python, and two numbers come back.
    """
    judged = docs.withColumn("_judged", _judge(model)(F.col("text")))
    return judged.withColumns({"_bad": F.col("_judged.bad"), "_posterior": F.col("_judged.posterior")}).drop("_judged")


def keep(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier does not reject, in the columns of docs."""
    inner = common.sealed(docs, "doc_id", "text")
    return common.opened(score(inner, fit(inner)).filter(F.col("_bad") < threshold).drop("_bad", "_posterior"), docs)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs))
    return scored.select("doc_id", F.col("_posterior").alias("bad_by_labellers"), F.col("_bad").alias("bad"), (F.col("_bad") >= 0.5).alias("rejected"))
