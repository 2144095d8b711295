"""Toxicity by class-conditional Kneser-Ney models.

Two models, toxic and ordinary, give the probability of each word of a text after the
word before it. A class's own counts of pairs (documents that have them, near copies
once) are discounted absolutely; the discounted mass goes to the class's continuation
counts of words, and their discounted mass to continuation counts that the classes share.
Words and pairs whose counts don't tell the classes apart are pruned to their backoff in
both, so rare expressions are smoothed together. A document's score compares its two
log-likelihoods, divided by its length, and is turned into a probability by a logistic
function fitted on documents that the compared models have not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_bound, packed, unpacked
from .shingles import mix, shingle_sets

_word = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


class KneserNey:
    """Two Kneser-Ney models of a word after the word before it, one for each class (0 ordinary, 1 toxic).

    P_c(w | h): the class's discounted count of the pair by that of its history, and the discounted mass times
    P_c(w). P_c(w): the class's discounted continuation count (after how many words w was seen) by all of them, and
    the discounted mass times P(w), which the classes share: continuation counts over both, with one
    more for words never seen. Counts are numbers of documents, so a word that a text repeats counts once.

    Words and pairs whose counts don't tell the classes apart (likelihood-ratio statistic under ``least_g``) are
    pruned: pruned words take the shared model, pruned pairs the word's, each scaled so that the
    probabilities after a history sum to 1.
    """

    def __init__(self, pairs: tuple[Counter, Counter], words: tuple[Counter, Counter], documents: tuple[int, int], least_g: float = 15.0):
        """pairs: documents by (history, word) of each class, "" the history of first words; words: by word."""
        self.told = set(self._telling(words, documents, least_g))
        after = [Counter(w for _, w in pairs[c]) for c in (0, 1)]
        seen = [max(1, after[c].total()) for c in (0, 1)]
        self.shared_n, self.shared_all = after[0] + after[1], after[0].total() + after[1].total() + 1
        discount = [self._discount(after[c].values()) for c in (0, 1)]
        mass = [discount[c] * len(after[c]) / seen[c] if after[c] else 1.0 for c in (0, 1)]
        self.word = [{w: max(after[c][w] - discount[c], 0) / seen[c] + mass[c] * self.shared(w) for w in self.told} for c in (0, 1)]
        spare = 1 - sum(map(self.shared, self.told))
        self.scale = [(1 - sum(self.word[c].values())) / spare if spare > 0 else 1.0 for c in (0, 1)]
        self.kept: dict[str, dict[str, tuple[float, float]]] = {}
        told_pairs = self._telling(pairs, documents, least_g)
        histories = {h for h, _ in told_pairs}
        own = [Counter(), Counter()]
        kinds = [Counter(), Counter()]
        for c in (0, 1):
            for (h, _), n in pairs[c].items():
                if h in histories:
                    own[c][h] += n
                    kinds[c][h] += 1
        pair_discount = [self._discount(pairs[c].values()) for c in (0, 1)]

        def after_history(c: int, h: str, w: str) -> float:
            if not own[c][h]:
                return self.after_any(c, w)
            d = pair_discount[c]
            return max(pairs[c][h, w] - d, 0) / own[c][h] + d * kinds[c][h] / own[c][h] * self.after_any(c, w)

        for h, w in told_pairs:
            self.kept.setdefault(h, {})[w] = (after_history(0, h, w), after_history(1, h, w))
        self.rest: dict[str, tuple[float, float]] = {}
        for h, told in self.kept.items():
            left = [max(1e-12, 1 - sum(p[c] for p in told.values())) for c in (0, 1)]
            base = [max(1e-12, 1 - sum(self.after_any(c, w) for w in told)) for c in (0, 1)]
            self.rest[h] = (left[0] / base[0], left[1] / base[1])
        # what a document needs: a step for each word, and what told words and histories add to it
        self.step = math.log(self.scale[1]) - math.log(self.scale[0])
        self.ratio = {w: math.log(self.word[1][w]) - math.log(self.word[0][w]) - self.step for w in self.told}
        base_ratio = lambda w: self.step + self.ratio.get(w, 0.0)
        self.turns = {
            h: (math.log(self.rest[h][1]) - math.log(self.rest[h][0]), {w: math.log(p[1]) - math.log(p[0]) - base_ratio(w) for w, p in told.items()})
            for h, told in self.kept.items()
        }

    @classmethod
    def _telling(cls, counts: tuple[Counter, Counter], documents: tuple[int, int], least_g: float) -> list:
        """The words or pairs whose counts tell the classes apart, in order."""
        rarest = min(documents) / max(1, sum(documents))
        fewest = least_g / (-2 * math.log(rarest)) if 0 < rarest < 1 else 0  # no fewer documents can reach the statistic
        every = counts[0] + counts[1]
        return sorted(x for x, n in every.items() if n >= fewest and cls._g(counts[0][x], counts[1][x], documents) >= least_g)

    @staticmethod
    def _g(a: int, b: int, documents: tuple[int, int]) -> float:
        """Likelihood-ratio statistic of a word's counts against the classes' shares of documents."""
        share = documents[0] / max(1, sum(documents))
        return 2 * sum(n * math.log(n / ((a + b) * s)) for n, s in ((a, share), (b, 1 - share)) if n and s)

    @staticmethod
    def _discount(counts: Iterable[int]) -> float:
        seen = Counter(c for c in counts if c <= 2)
        return seen[1] / (seen[1] + 2 * seen[2]) if seen[1] else 0.5

    def shared(self, word: str) -> float:
        """The backoff of both classes; all words never seen have one share."""
        return (self.shared_n[word] or 1) / self.shared_all

    def after_any(self, c: int, word: str) -> float:
        return self.word[c][word] if word in self.told else self.scale[c] * self.shared(word)

    def probability(self, c: int, history: str, word: str) -> float:
        told = self.kept.get(history)
        if told is None:
            return self.after_any(c, word)
        return told[word][c] if word in told else self.rest[history][c] * self.after_any(c, word)

    def compare(self, words: list[str]) -> float:
        """Toxic minus ordinary log-likelihood of the words in order."""
        ratio, turns = self.ratio, self.turns
        total = self.step * len(words) + sum([ratio[w] for w in words if w in ratio])
        for h, w in zip(["", *words], words):
            if h in turns:
                other, told = turns[h]
                total += told.get(w, other)
        return total

    def features(self, text: str | None) -> tuple[float, float]:
        """The comparison by length, and by the root of the length (its noise)."""
        words = words_of(text)
        total = self.compare(words)
        n = max(1, len(words))
        return total / n, total / math.sqrt(n)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) of a ridge-penalised logistic regression, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) / weight.sum() + ridge * np.r_[w[:-1], 0]
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z / weight.sum() + ridge * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return mean, scale, w


@dataclass
class ToxicityModel:
    words: KneserNey
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        x = np.array([self.words.features(t) for t in texts], dtype=float).reshape(-1, 2)
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _thinned(docs: list[tuple[str, int]], sketches: int = 3) -> list[tuple[str, int]]:
    """Without documents that share a smallest word-5-gram hash, under one of a few hash functions, with an earlier one."""
    met: set[tuple[int, int]] = set()
    kept = []
    for (text, label), grams in zip(docs, shingle_sets([t for t, _ in docs]), strict=True):
        marks = {(k, int(mix(grams ^ np.uint64(k * 0x9E3779B9)).min())) for k in range(1, sketches + 1)} if len(grams) else set()
        if not marks & met:
            kept.append((text, label))
        met |= marks
    return kept


def fit_models(docs: list[tuple[str, int]], share: float) -> ToxicityModel:
    """docs: (text, label); share: of toxic rows among all labelled rows.

    Two models, each on half of the documents, score the other half; the logistic function is fitted on those scores.
    """
    docs = _thinned(docs)
    pairs = [(Counter(), Counter()), (Counter(), Counter())]
    single = [(Counter(), Counter()), (Counter(), Counter())]
    sizes = [[0, 0], [0, 0]]
    half = []
    turn = [0, 0]
    for text, label in docs:
        side = turn[label] % 2
        turn[label] += 1
        half.append(side)
        words = words_of(text)
        pairs[side][label].update(set(zip(["", *words], words)))
        single[side][label].update(set(words))
        sizes[side][label] += 1
    halves = [KneserNey(pairs[side], single[side], tuple(sizes[side])) for side in (0, 1)]
    x = np.array([halves[1 - side].features(t) for side, (t, _) in zip(half, docs, strict=True)]).reshape(-1, 2)
    y = np.array([label for _, label in docs], dtype=float)
    toxic = int(y.sum())
    if 0 < toxic < len(y):
        mean, scale, w = fit_logistic(x, y, np.where(y == 1, share / toxic, (1 - share) / (len(y) - toxic)))
    else:
        mean, scale, w = np.zeros(2), np.ones(2), np.r_[0.0, 0.0, 30.0 if toxic else -30.0]
    both = [(a[0] + b[0], a[1] + b[1]) for a, b in (pairs, single)]
    return ToxicityModel(KneserNey(*both, tuple(turn)), mean, scale, w)


def train_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, sample_per_class: int = 2000, sample_chars: int = 8_000_000) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows where ``usable`` (of doc_id) holds.

    Of each class the ``sample_per_class`` documents with the smallest id hashes are
    taken, as long as they have ``sample_chars`` characters together; those of more than
    a hundredth of ``sample_chars`` come after all others, the shortest first, so none of
    them takes another's place. The document that meets the bound is cut there. A document with
    several labels is toxic if one of them says so; null labels are left out. Without
    labelled rows every score is near 0.
    """
    marked = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = docs.select("doc_id", F.length("text").alias("chars")).where("chars > 0").groupBy("doc_id").agg(F.max("chars").alias("chars"))
    known = marked.join(sizes, "doc_id").select("doc_id", "toxic", "chars", F.xxhash64("doc_id").alias("place"))
    known = known.withColumn("long", F.when(F.col("chars") > sample_chars // 100, F.col("chars")).otherwise(0))
    n = {(r["toxic"], r["is_long"]): r["count"] for r in known.groupBy("toxic", (F.col("long") > 0).alias("is_long")).count().collect()}
    few = None  # rows that can be in the sample, some thousand whatever the number of labels
    for label in (0, 1):
        own, short = known.where(F.col("toxic") == label), n.get((label, False), 0)
        part = own.where((F.col("long") == 0) & (F.col("place") <= hash_bound(sample_per_class, short)))
        if short < sample_per_class:  # a hundred long ones meet the bound
            part = own.where("long = 0").unionByName(own.where("long > 0").orderBy("long", "place", "doc_id").limit(101))
        few = part if few is None else few.unionByName(part)
    first = Window.partitionBy("toxic").orderBy("long", "place", "doc_id")
    some = few.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample_per_class)
    some = some.withColumn("room", sample_chars + F.col("chars") - F.sum("chars").over(first)).where("room > 0")
    picked = F.broadcast(some.select("doc_id", "toxic", F.least("room", "chars").cast("int").alias("room")))  # at most two classes of sample_per_class rows
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(picked, "doc_id")
    rows = rows.select("doc_id", F.substring("text", F.lit(1), F.col("room")).alias("text"), "toxic").collect()
    taken = sorted({(r["doc_id"], r["text"], int(r["toxic"])) for r in rows})
    share = sum(k for (label, _), k in n.items() if label == 1) / max(1, sum(n.values()))
    return fit_models([(text, label) for _, text, label in taken], share)


def score_toxicity(docs: DataFrame, model: ToxicityModel, limit: float = 0.7) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from ``limit`` on) to ``docs``; columns of these names are replaced.

    Whole texts are read; a null or empty text gets the score of an even comparison. Nothing is shuffled.
    """
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series(shared.value.scores(t if isinstance(t, str) else None for t in series))

    found = packed(docs).withColumn("score", score(F.col("row")["text"]))
    return found.select(*unpacked(columns), "score", F.when(F.col("score") >= limit, 1).otherwise(0).alias("predicted"))
