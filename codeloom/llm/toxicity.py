"""Operator 10: toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel of two strings sums, over all strings of three letters (word ends count
as letters), the products of their occurrences as subsequences that span at most
SPAN + 1 places, each weighted by DECAY per place skipped; it is normalised. So
insults with gaps, symbols or inserted letters stay near the insult. Landmarks give
the Nystroem map, in which a linear machine is trained by dual coordinate descent.
As the kernel's own features are few (32 ** 3), the machine over landmarks is one
weight per feature, and a string's score is exactly what the landmarks would give.

Training takes sentences word by word: labels are per document, so a toxic
document's witnesses are the strings that the machine scores highest (first: those
whose presence tells toxic from other documents beyond chance), and every string of a
document that isn't toxic is a negative; the worst of these are added each round.
At most TOXIC and CLEAN labelled documents are used, by hash of doc_id, none of
them held out. A document's score is a logistic function of its TOP highest margins
(of words, repeats counted) and of the rate of words with a margin above 0, fitted on
the same documents: one word that looks like an insult by chance is weaker evidence
than several, and weaker in a long text.

Defined cases: null and empty texts have the score of a text without words;
repeated rows score alike; a null doc_id is not held out; without labels of both
kinds every score is 0.0; an empty table gives no rows. Labels, language, source and
doc_id are no inputs of a score.
"""

from __future__ import annotations

import itertools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DECAY, SPAN = 0.6, 5
#: Bounds of the training set: documents of either label, landmarks of either kind, negatives.
#: LANDMARKS, WITNESSES and ODDS made the fewest errors in folds inside the training rows (`folds`, two partitions).
TOXIC, CLEAN, LANDMARKS, NEGATIVES, ROUNDS = 1000, 2000, 160, 3000, 4
#: Strings of a toxic document that a round may add to the positives.
WITNESSES = 3
KEPT = 300_000
#: Highest margins of a document that its score reads, and their bounds.
TOP, LEAST, MOST = 4, -1.5, 2.0
#: Weight of all toxic documents against that of all others, whatever the bounds draw.
ODDS = 1 / 8
#: Length of the overlapping parts of longer words with inner signs.
PART = 40
DIM, BEGIN, END, MARK = 32**3, 27, 28, 29

_OFFSETS = [(a, b) for a, b in itertools.combinations(range(1, SPAN + 1), 2)]
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Signs that stand for letters inside words.
_STANDS_FOR = str.maketrans("0134578@$!", "oieastbasi")


class _Codes(dict):
    """Character -> its codes: 1..26 (other letters by their place), then MARK where it has an accent; 0 for what is no letter."""

    def __missing__(self, c: str) -> tuple[int, ...]:
        base = unicodedata.normalize("NFD", c.lower())
        code = ord(base[0]) - 96 if "a" <= base[0] <= "z" else 1 + ord(base[0]) % 26 if base[0].isalpha() else 0
        out = self[c] = (code, MARK) if code and len(base) > 1 else (code,)
        return out


_CODES = _Codes()


def occurrences(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, feature, weight) of the kernel's feature map, each feature once per string."""
    flat: list[int] = []
    sizes = []
    for s in strings:
        start = len(flat)
        flat.append(BEGIN)
        for c in s:
            flat += _CODES[c]
        flat.append(END)
        flat += [0] * SPAN
        sizes.append(len(flat) - start)
    codes = np.array([*flat, *[0] * SPAN], np.int64)
    owner = np.repeat(np.arange(len(strings)), sizes)
    n = len(owner)
    keys, weights = [], []
    for a, b in _OFFSETS:
        x, y, z = codes[:n], codes[a : n + a], codes[b : n + b]
        at = np.flatnonzero((x > 0) & (y > 0) & (z > 0))
        keys.append(owner[at] * DIM + (x[at] * 1024 + y[at] * 32 + z[at]))
        weights.append(np.full(len(at), DECAY ** (b - 2)))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.bincount(back, np.concatenate(weights), len(key))
    return key // DIM, key % DIM, weight


def _normal(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    who, feature, weight = occurrences(strings)
    norm = np.sqrt(np.bincount(who, weight**2, len(strings)))
    return who, feature, weight / np.maximum(norm[who], 1e-12)


def dense(strings: list[str]) -> np.ndarray:
    out = np.zeros((len(strings), DIM), np.float32)
    who, feature, weight = _normal(strings)
    out[who, feature] = weight
    return out


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised kernel matrix."""
    right = np.ascontiguousarray(dense(b).T)
    out = np.zeros((len(a), len(b)))
    for i in range(0, len(a), 400):
        who, feature, weight = _normal(a[i : i + 400])
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.empty(0, np.int64)
        if len(first):
            out[i + who[first]] = np.add.reduceat(right[feature] * weight[:, None].astype(np.float32), first, axis=0)
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 20) -> np.ndarray:
    """Hinge loss, dual coordinate descent; the last column of x should be constant."""
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(y)), np.maximum((x**2).sum(axis=1), 1e-12)
    for epoch in range(epochs):
        moved = 0.0
        for i in np.random.default_rng(epoch).permutation(len(y)):
            gradient = y[i] * (w @ x[i]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class Machine:
    """The trained scorer of strings: a weight per feature of the kernel, and a bias; and of documents: a weight per entry of `evidence`, and a constant."""

    def __init__(self, weights: np.ndarray, bias: float, document: np.ndarray | None = None):
        self.weights, self.bias = weights, bias
        self.document = np.array([4.0, *[0.0] * (TOP + 2)]) if document is None else document

    @classmethod
    def trained(cls, positives: list[str], times: list[int], negatives: list[str], landmarks: list[str]) -> Machine:
        gram = kernel(landmarks, landmarks)
        values, vectors = np.linalg.eigh(gram)
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        strings = positives + negatives
        x = np.hstack([kernel(strings, landmarks) @ root, np.ones((len(strings), 1))])
        y = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
        cost = np.array([5.0 * k for k in times] + [5.0] * len(negatives))
        w = linear_svm(x, y, cost)
        return cls(((root @ w[:-1]) @ dense(landmarks)).astype(np.float64), float(w[-1]))

    def margins(self, strings: list[str]) -> np.ndarray:
        out = np.empty(len(strings))
        for i in range(0, len(strings), 20_000):
            part = strings[i : i + 20_000]
            who, feature, weight = _normal(part)
            out[i : i + len(part)] = np.bincount(who, weight * self.weights[feature], len(part)) + self.bias
        return out

    def weigh(self, toxic: list[str], clean: list[str], odds: float) -> None:
        """Fit what documents of either label are told apart by, once strings have their margins."""
        scorer = Scores(self)
        seen = np.array(scorer.texts(toxic) + scorer.texts(clean))
        truth = np.array([1.0] * len(toxic) + [0.0] * len(clean))
        self.document = logistic(seen, truth, np.where(truth > 0, odds * len(clean) / len(toxic), 1.0))

    def probability(self, evidence: np.ndarray) -> float:
        logit = float(evidence @ self.document[:-1] + self.document[-1])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))


def evidence(margins: np.ndarray) -> np.ndarray:
    """The highest margins of a document's words in falling order, what the first has above 1 (a sure insult), and the log rate of margins above 0."""
    top = np.full(TOP, LEAST)
    best = np.sort(np.partition(margins, len(margins) - TOP)[-TOP:] if len(margins) > TOP else margins)[::-1]
    top[: len(best)] = np.clip(best, LEAST, MOST)
    return np.array([*top, max(0.0, top[0] - 1), math.log(((margins > 0).sum() + 0.5) / (len(margins) + 20))])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights and a constant by Newton's method, from rows of the given weights."""
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([(x - middle) / spread, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * middle / spread).sum())


def pieces(text: str) -> list[str]:
    """Strings of a text: words in lower case, and runs of three or more single letters as one."""
    words = text.lower().split()
    out, run = list(words), []
    for w in (*words, ""):
        if len(w) == 1 and w.isalpha():
            run.append(w)
        else:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
    return out


def readings(word: str) -> list[str]:
    """A word without outer signs; where it has inner signs, also without them, and with letters they stand for."""
    inner = word.strip(_EDGE)
    if inner.isalpha() or not inner:
        return [inner] if len(inner) > 2 else []
    bare = "".join(c for c in inner if c.isalpha())
    meant = "".join(c for c in word.translate(_STANDS_FOR) if c.isalpha())
    # of long runs also overlapping parts, each of which the kernel can tell apart
    parts = [inner[i : i + PART] for i in range(0, len(inner) - PART // 2, PART // 2)] if len(inner) > PART else []
    return [r for r in dict.fromkeys((inner, bare, meant, *parts)) if sum(c.isalpha() for c in r) > 2]


class Scores:
    """Margin of each word; bounded by emptying."""

    def __init__(self, machine: Machine):
        self.machine, self.kept = machine, {}

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The evidence of each text."""
        cut = [pieces(t) for t in texts]
        kept = self.kept
        unknown = {w for words in cut for w in words} - kept.keys()
        if len(kept) + len(unknown) > KEPT:
            unknown = {w for words in cut for w in words}
            kept.clear()
        if unknown:
            low = self.machine.bias - 1.0
            order, owners, strings = list(unknown), [], []
            for i, w in enumerate(order):
                for r in readings(w):
                    owners.append(i)
                    strings.append(r)
            best = np.full(len(order), low)
            if strings:
                np.maximum.at(best, np.array(owners), self.machine.margins(strings))
            kept.update(zip(order, best.tolist(), strict=True))
        return [evidence(np.fromiter(map(kept.__getitem__, words), float, len(words))) for words in cut]


def _altered(word: str, rng: np.random.Generator) -> str:
    at = int(rng.integers(1, max(2, len(word))))
    return word[:at] + str(rng.choice(list("xzqjk*-.1"))) + word[at:]


def _unlike(bags: list[set[str]], common_words: Counter) -> list[set[str]]:
    """Bags without near copies of earlier ones, by their rare words: copies are no independent evidence."""
    holders: dict[str, list[int]] = {}
    out = []
    for bag in bags:
        rare = [w for w in bag if w not in common_words]
        met = Counter(i for w in rare for i in holders.get(w, ()))
        if met and len(rare) >= 10 and met.most_common(1)[0][1] > 0.3 * len(rare):
            continue
        for w in rare:
            holders.setdefault(w, []).append(len(out))
        out.append(bag)
    return out


def train(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS, witnesses: int = WITNESSES, odds: float = ODDS) -> Machine | None:
    """From texts of either label; None where one is missing."""
    if not toxic or not clean:
        return None
    rng = np.random.default_rng(10)
    others = [{r for w in pieces(t) for r in readings(w)[:1]} for t in clean]
    elsewhere = Counter(w for b in others for w in b)
    bags = _unlike([{r for w in pieces(t) for r in readings(w)[:1]} for t in toxic], elsewhere)
    there = Counter(w for b in bags for w in b)
    share = len(bags) / (len(bags) + len(others))
    # presence in toxic documents alone by chance: share ** times; words that others have too often are out
    evidence = {w: k * -math.log(share) - 4.0 * elsewhere[w] for w, k in there.items() if elsewhere[w] * 20 <= k}
    enough = math.log(max(2, len(there))) + 1.0
    told = [w for w, e in evidence.items() if e >= enough] or [w for w, _ in sorted(evidence.items(), key=lambda x: (-x[1], x[0]))[: max(1, len(bags) // 4)]]
    told = sorted(told, key=lambda w: (-there[w], w))
    vocabulary = sorted(elsewhere)
    if not vocabulary or not told:
        return None
    drawn = [vocabulary[i] for i in sorted(rng.choice(len(vocabulary), min(len(vocabulary), NEGATIVES // 2), replace=False))]
    negatives = dict.fromkeys(drawn)
    positives = dict.fromkeys(told[:1500])
    machine = None
    for round_ in range(ROUNDS):
        good, bad = list(positives), list(negatives)
        times = [max(1, there[w]) for w in good]
        altered = [(_altered(w, rng), max(1, k // 6)) for w, k in list(zip(good, times, strict=True))[:100] for _ in range(4) if len(w) > 4]
        marks = list(dict.fromkeys(good[:landmarks] + [bad[i] for i in rng.choice(len(bad), min(len(bad), landmarks), replace=False)]))
        machine = Machine.trained(good + [w for w, _ in altered], times + [k for _, k in altered], bad, marks)
        if round_ == ROUNDS - 1:
            break
        margins = machine.margins(vocabulary)
        for i in np.argsort(-margins, kind="stable")[:400]:
            if margins[i] > -1 and vocabulary[i] not in positives:
                negatives[vocabulary[i]] = None
        for bag in bags:  # a toxic document's witnesses: those of its words that the machine scores highest
            words = sorted(bag - elsewhere.keys() - positives.keys())
            if words:
                scores = machine.margins(words)
                for i in np.argsort(-scores, kind="stable")[:witnesses]:
                    if scores[i] > 0:
                        positives[words[i]] = None
    machine.weigh(toxic, clean, odds)
    return machine


def folds(toxic: list[str], clean: list[str], odds: list[float], landmarks: int = LANDMARKS, witnesses: int = WITNESSES, n: int = 4) -> dict[float, tuple[int, int]]:
    """odds -> (toxic texts caught, clean texts flagged), each text scored by a machine that was trained without its fold.

    Only for choosing the constants above, from training rows alone; fit() never runs it.
    """
    out = {o: [0, 0] for o in odds}
    for k in range(n):
        held = [[t for i, t in enumerate(texts) if i % n == k] for texts in (toxic, clean)]
        rest = [[t for i, t in enumerate(texts) if i % n != k] for texts in (toxic, clean)]
        machine = train(*rest, landmarks, witnesses)
        for o in odds if machine else ():
            machine.weigh(*rest, o)
            for j, texts in enumerate(held):
                out[o][j] += sum(machine.probability(e) >= 0.5 for e in Scores(machine).texts(texts))
    return {o: (a, b) for o, (a, b) in out.items()}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Machine | None:
    """The sample of labelled rows is bounded by `toxic` and `clean`, drawn by hash of doc_id from those not held out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = None
    for label, most in ((1, toxic), (0, clean)):
        part = usable.filter(F.col("toxic") == label).select("doc_id", F.col("toxic").alias("_toxic")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        drawn = part if drawn is None else drawn.unionByName(part)
    drawn = common.saved(drawn, "drawn-labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "_toxic").agg(F.min("text").alias("text")).orderBy("doc_id", "_toxic").collect()  # at most toxic + clean
    return train([r["text"] or "" for r in rows if r["_toxic"] == 1], [r["text"] or "" for r in rows if r["_toxic"] == 0])


def _score_task(machine: Machine | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(machine) if machine else None
        for batch in batches:
            out: list[float] = []
            for part in _chunks(batch.column(1)):
                out += [machine.probability(m) for m in scores.texts(part)] if scores else [0.0] * len(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return task


def _chunks(column: Iterable, size: int = 1_000_000) -> Iterator[list[str]]:
    part, n = [], 0
    for value in column:
        part.append(value.as_py() or "")
        n += len(part[-1])
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, text) -> doc_id, score."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score_task(machine), "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
