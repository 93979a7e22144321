"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_rows, settle
from .labelled import class_weights, labelled_sample, logistic

WORD = re.compile(r"\w+")
#: Prefix lengths to which a word without evidence of its own backs off, longest first.
PREFIXES = (6, 5, 4)


@dataclass(frozen=True)
class ToxicityModel:
    scores: dict[str, float]  # word, or prefix and "*": log-odds less drift, over 0
    drift: float  # each other token costs this
    decay: float  # lambda of the extreme-value distribution
    scale: float  # K of it
    a: float
    b: float


@dataclass
class _TokenScores(dict):
    """Scores by token as it stands in the text; learnt once per worker and spelling."""

    model: ToxicityModel
    most: int = 250_000
    known: dict = field(default_factory=dict)

    def __missing__(self, token: str) -> float:
        if len(self) > self.most:
            self.clear()
        own, best = self.model.scores, -self.model.drift
        for w in WORD.findall(token.lower()):
            for f in (w, *(w[:k] + "*" for k in PREFIXES if len(w) >= k)):
                if f in own:
                    best = max(best, own[f])
                    break
        self[token] = best
        return best


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments, in linear time (Ruzzo and Tompa, 1999)."""
    total = np.cumsum(scores)
    left: list[float] = []
    right: list[float] = []
    spans: list[tuple[int, int]] = []
    back: list[int] = []  # the nearest earlier segment of less left sum
    for i in np.flatnonzero(scores > 0).tolist():
        r = float(total[i])
        l, start = r - float(scores[i]), i
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= l:
                j = back[j]
            if j < 0 or right[j] >= r:
                break
            l, start = left[j], spans[j][0]
            del left[j:], right[j:], spans[j:], back[j:]
        left.append(l)
        right.append(r)
        spans.append((start, i + 1))
        back.append(j)
    return [(s, e, r - l) for (s, e), l, r in zip(spans, left, right)]


def evidence(scores: list[float], n: int, decay: float, scale: float) -> tuple[float, int]:
    """Nats against chance, and the number of segments that chance gives to fewer than one document in a hundred.

    A segment's normalised score is lambda S - ln(K n); the best sum over the r greatest, less ln r!, counts (Karlin and Altschul, 1993).
    """
    if not len(scores):
        return 0.0, 0
    each = np.sort(decay * np.asarray(scores) - math.log(scale * n))[::-1]
    sums = np.cumsum(each) - np.cumsum(np.log(np.arange(1, len(each) + 1)))
    return max(0.0, float(sums.max())), int((each > -math.log(0.01)).sum())


def probability(nats: np.ndarray, a: float, b: float) -> np.ndarray:
    """The calibrated score of evidence, whose logarithm the calibration is over, as one passage more says less than the first."""
    return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(nats), -500, 500)))


def tail_scale(counts: list[int], lengths: list[int], decay: float, least: float) -> float:
    """K of the extreme-value distribution, by clean texts: in one of n tokens chance gives K n exp(-lambda s) segments of a score of s or
    more on average. counts: segments of each text, all of which have at least the score `least`."""
    return (sum(counts) + 0.5) / (math.exp(-decay * least) * max(sum(lengths), 1))


def _features(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}


def fit_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, rest: int = 0, most: int = 16_000, vocabulary: int = 20_000, least_gain: float = 14.0, least_texts: int = 3, prior: float = 500.0, drift: float = 0.5, key: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Learns from at most `most` labelled documents outside the held-out fold; up to `vocabulary` features come to the driver.

    Three folds of the sample give the log-odds of words and word prefixes, by the documents that hold them, with a Dirichlet prior of
    weight `prior` after the pooled sample. Features that fewer than `least_texts` toxic documents hold, whose signed likelihood ratio is under
    `least_gain` or whose log-odds don't exceed `drift` say nothing; of the others the `vocabulary` of greatest ratio count. lambda
    follows from the scores' distribution over clean documents. The fourth fold gives K, from its clean documents, and the calibration,
    with weights that restore the classes' shares of all labels where the sample cuts a class.
    No labels, or of one class: scores are the smoothed share of toxic ones.
    """
    sample = labelled_sample(docs, labels, "toxic", parts, rest, most, key, text)
    clean, toxic = class_weights(labels, "toxic", parts, rest, most, key)

    def make():
        def count(part):
            c: Counter = Counter()
            for t, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist()):
                c.update((f, y) for f in _features(t))
            return {"feature": [f for f, _ in c], "y": [y for _, y in c], "n": list(c.values())}

        return count

    counts = map_rows(sample.where("fold <> 3"), make, "feature string, y int, n long")
    counts = counts.groupBy("feature").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    sums = counts.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    n_t, n_c = float(sums[0]), float(sums[1])
    if not n_t or not n_c:
        return ToxicityModel({}, drift, 1.0, 0.1, *_share(sample, clean, toxic))
    alpha = prior * (F.col("t") + F.col("c")) / (n_t + n_c or 1)
    odds = F.log((F.col("t") + alpha) / (n_t + prior - F.col("t") - alpha)) - F.log((F.col("c") + alpha) / (n_c + prior - F.col("c") - alpha))
    expected = (F.col("t") + F.col("c")) * n_t / (n_t + n_c or 1)
    others = F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (F.col("t") + F.col("c") - expected))).otherwise(0.0)
    scored = counts.where(F.col("t") >= least_texts).withColumn("odds", odds).withColumn("gain", 2 * (F.col("t") * F.log(F.col("t") / expected) + others))
    scored = scored.where((F.col("gain") >= least_gain) & (F.col("odds") > drift)).orderBy(F.desc("gain"), "feature").limit(vocabulary)
    top = [(r.feature, r.odds - drift, (r.c + prior * (r.t + r.c) / (n_t + n_c)) / (n_c + prior)) for r in scored.select("feature", "odds", "t", "c").collect()]
    scores = {f: s for f, s, _ in top}
    words = [(s, p) for f, s, p in top if not f.endswith("*")]
    decay = _decay([s for s, _ in words], [p for _, p in words], drift)
    blank = ToxicityModel(scores, drift, decay, 1.0, 0.0, 0.0)

    def make_scores():
        find = segment_finder(blank)

        def run(part):
            found = [find(t) for t in part.column("text").to_pylist()]
            return {"s": [[x[2] for x in f] for f, _ in found], "n": [n for _, n in found], "y": part.column("y").to_pylist()}

        return run

    rows = map_rows(sample.where("fold = 3"), make_scores, "s array<double>, n long, y int").collect()  # of at most `most` labelled texts
    clean_rows = [r for r in rows if not r.y]
    scale = tail_scale([len(r.s) for r in clean_rows], [r.n for r in clean_rows], decay, min(scores.values(), default=0.0))
    x, y = np.array([evidence(r.s, r.n, decay, scale)[0] for r in rows]), np.array([float(r.y) for r in rows])
    weight = np.where(y == 1, toxic, clean)
    a, b = logistic(np.log1p(x), y, weight * len(y) / (weight.sum() or 1))  # a mean of one, as the ridge is for rows of weight one
    return ToxicityModel(scores, drift, decay, scale, a, b)


def _share(sample: DataFrame, clean: float, toxic: float) -> tuple[float, float]:
    n, t = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    return float(np.log((toxic * t + 0.5) / (clean * (n - t) + 0.5))), 0.0


def _decay(scores: list[float], shares: list[float], drift: float) -> float:
    """lambda over 0 with sum p exp(lambda s) = 1 over the clean documents' tokens, by bisection; 1 where no score is over 0."""
    if not scores:
        return 1.0
    s, p = np.array([*scores, -drift]), np.array([*shares, max(0.0, 1 - sum(shares))])
    low, high = 1e-3, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 600))).sum() < 1 else (low, mid)
    return low


def segment_finder(model: ToxicityModel):
    """A function of a text: its maximal segments, and its number of tokens."""
    known = _TokenScores(model=model)

    def find(text: str) -> tuple[list[tuple[int, int, float]], int]:
        tokens = text.split()
        s = np.fromiter(map(known.__getitem__, tokens), float, len(tokens))
        return (maximal_segments(s) if len(s) and s.max() > 0 else []), len(s)

    return find


def scorer(model: ToxicityModel):
    """A function of a text: evidence, number of significant segments, the best segment's first and last token."""
    find = segment_finder(model)

    def one(text: str) -> tuple[float, int, int, int]:
        found, n = find(text)
        if not found:
            return 0.0, 0, -1, -1
        start, end, _ = max(found, key=lambda x: (x[2], -x[0]))
        return *evidence([x[2] for x in found], n, model.decay, model.scale), start, end

    return one


def score_toxicity(docs: DataFrame, model: ToxicityModel, parts: int = 5, rest: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted, n_segments, segment_start, segment_end) for each row.

    score: the calibrated probability that the text is toxic; predicted: 1 from 0.5 on. Segments are in tokens of white space, -1 for
    none. Null and empty texts have no evidence and get the score of that. Repeated rows: a row each. No rows: no rows. Texts are scored
    whole; other columns aren't read. One scan, no shuffle; the model, of bounded vocabulary, goes along with the code.
    """
    rows = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def make():
        one = scorer(model)

        def run(part):
            found = [one(t) for t in part.column("text").to_pylist()]
            score = probability(np.array([x[0] for x in found]), model.a, model.b).tolist()
            return {"key_": part.column("key_").to_pylist(), "score": score, "predicted": [int(s >= 0.5) for s in score], "n_segments": [x[1] for x in found], "segment_start": [x[2] for x in found], "segment_end": [x[3] for x in found]}

        return run

    kind = rows.schema["key_"].dataType.simpleString().replace("bigint", "long")
    out = map_rows(rows, make, f"key_ {kind}, score double, predicted int, n_segments long, segment_start long, segment_end long")
    return out.select(F.col("key_").alias(key), F.coalesce(held_out(F.col("key_"), parts, rest), F.lit(False)).alias("held_out"), "score", "predicted", "n_segments", "segment_start", "segment_end")


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """docs without rows of score >= threshold, all columns as they are. Null and empty texts as in score_toxicity()."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = scorer(model)
        for texts in parts:
            yield pd.Series(probability(np.array([one(t or "")[0] for t in texts], dtype=float), model.a, model.b))

    settle(docs.sparkSession)
    return docs.where(score(F.col(text)) < threshold)
