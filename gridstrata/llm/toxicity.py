"""Toxic passages by maximum-scoring segment search.

A token's score is its log-odds between toxic and clean training texts under an informative Dirichlet prior (a share
`prior` of the pooled counts), kept where it is at least `least_odds` and `least_z` standard errors from 0, less a small
drift for every token. A linear-time scan finds all maximal scoring segments of a text. Their scores are calibrated by the
extreme-value law of clean training texts, whose segments have an exponential tail: with decay `rate` and `location`,
n tokens hold n * exp(-rate * (S - location)) segments of score S or more by chance; the largest then follows Gumbel's law.
A segment is significant where that expectation is below `most_expected`. A text's strength is its best segment's surprise and the sum over its significant ones; a logistic curve, fitted on the training texts' strengths,
gives the probability.

The classifier is fitted on a bounded sample: at most `sample_docs` different labelled rows of each label, those with the
smallest hashes of id and text, whole texts. Counts are Spark aggregates; every text is then scored whole.

Null or empty text has no token and gets the curve's value at no strength. Rows without a label or a doc_id are never learnt from. Rows that
repeat both doc_id and text are learnt from once for each label that the id has; rows that share a doc_id alone each count. With no training row of one label, every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gridstrata.llm.common import smallest_hashes, written

SAMPLE_DOCS = 6000
PRIOR, LEAST_ODDS, LEAST_Z, LEAST_COUNT, DRIFT, MOST_EXPECTED = 0.1, 1.5, 3.0, 5, 0.02, 0.05
_TOKEN = re.compile(r"\w+")

SEGMENTS = "array<struct<first_token int, last_token int, score double, expected double>>"
SCORED = f"struct<strength double, total double, n_tokens int, segments {SEGMENTS}>"
_SCORED = pa.struct(
    [
        ("strength", pa.float64()), ("total", pa.float64()), ("n_tokens", pa.int32()),
        ("segments", pa.list_(pa.struct([("first_token", pa.int32()), ("last_token", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))),
    ]
)


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (first, last, score): scores at some places, -drift at every token.

    Candidates hold the sums before and after them, and the nearest earlier candidate that begins lower. A new one joins its own
    such candidate, with all between, if it ends higher. The search for it follows these chains of left ends, since all that
    a chain skips begins at least as high: so the time is linear in the places.
    """
    held: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, nearest that begins lower
    total, last = 0.0, -1
    for place, score in zip(places, scores, strict=True):
        total -= drift * (place - last - 1)
        before, total, last = total, total + score - drift, place
        if score <= drift:
            continue
        low, high, first, j = before, total, place, len(held) - 1
        while True:
            while j >= 0 and held[j][0] >= low:
                j = held[j][4]
            if j < 0 or held[j][1] >= high:
                held.append((low, high, first, place, j))
                break
            low, first = held[j][0], held[j][2]
            del held[j:]
            j = len(held) - 1
    return [(a, b, high - low) for low, high, a, b, _ in held]


@dataclass
class Model:
    weights: dict[str, float]
    drift: float = DRIFT
    rate: float = 1.0
    location: float = 0.0
    most_expected: float = MOST_EXPECTED
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        t = tokens(text)
        found = list(map(self.weights.get, t))
        places = [i for i, w in enumerate(found) if w is not None]
        return len(t), maximal_segments(places, [found[i] for i in places], self.drift) if places else []

    def score(self, text: str | None) -> dict:
        """The struct SCORED: strength is -log of the best segment's expectation, total that over all significant ones."""
        n, segments = self.scan(text)
        own = [(a, b, s, float(n * np.exp(-self.rate * (s - self.location)))) for a, b, s in segments]
        best = max((-np.log(max(e, 1e-300)) for *_, e in own), default=None)
        total = sum(-np.log(max(e, 1e-300)) for *_, e in own if e <= self.most_expected)
        significant = [dict(zip(("first_token", "last_token", "score", "expected"), x, strict=True)) for x in own if x[3] <= self.most_expected]
        return {"strength": 0.0 if best is None else max(float(best), 0.0), "total": float(total), "n_tokens": n, "segments": significant}


def _sample(docs: DataFrame, labels: DataFrame, text: str, label: str, doc_id: str, sample_docs: int) -> DataFrame:
    ids = labels.where(F.col(label).isNotNull()).select(F.col(doc_id).alias("d"), (F.col(label) > 0).cast("int").alias("y")).distinct()
    own = docs.select(F.col(doc_id).alias("d"), F.xxhash64(doc_id, text).alias("mark"), F.col(text).alias("t"))
    # only documents that are there count towards the bound
    chosen = smallest_hashes(ids.join(own.select("d", "mark"), "d").select("y", "mark"), "y", "mark", sample_docs)
    rows = own.join(F.broadcast(chosen), "mark").groupBy("mark", "y").agg(F.first("t").alias("t"))  # bounded: 2 * sample_docs marks
    return written(rows, "sample")  # read several times


def log_odds(counts: pd.DataFrame, prior: float = PRIOR, least_odds: float = LEAST_ODDS, least_z: float = LEAST_Z, least_count: int = LEAST_COUNT) -> dict[str, float]:
    """Token scores from counts in toxic (n1) and clean (n0) texts."""
    n1, n0 = counts["n1"].to_numpy(float), counts["n0"].to_numpy(float)
    if not len(counts) or not n1.sum() or not n0.sum():
        return {}
    alpha = (n1 + n0) * prior
    # a token that isn't there, or that is all there is, has no odds
    known = (alpha > 0) & (n1 + alpha < n1.sum() + alpha.sum()) & (n0 + alpha < n0.sum() + alpha.sum())
    safe = np.where(known, alpha, 1.0)
    odds = [np.log((n + safe) / np.where(known, n.sum() + alpha.sum() - n - alpha, 1.0)) for n in (n1, n0)]
    delta = odds[0] - odds[1]
    z = delta / np.sqrt(1 / (n1 + safe) + 1 / (n0 + safe))
    keep = known & (np.abs(delta) >= least_odds) & (np.abs(z) >= least_z) & (n1 + n0 >= least_count)
    return dict(zip(counts["token"][keep], delta[keep].tolist(), strict=True))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with an intercept and a slight ridge, by Newton steps."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _features(strength, total):
    return np.log1p(strength), np.log1p(total)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """docs and labels: training rows only."""
    rows = _sample(docs, labels, text, label, doc_id, sample_docs)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = (Counter(), Counter())
            for t, y in zip(batch["t"], batch["y"], strict=True):
                n[int(y)].update(tokens(t))
            if not (names := sorted(n[0].keys() | n[1].keys())):
                continue  # Arrow takes no empty column of strings from pandas
            yield pd.DataFrame({"token": names, "n1": [n[1][w] for w in names], "n0": [n[0][w] for w in names]}).astype({"n1": "int64", "n0": "int64"})

    counts = rows.select("t", "y").mapInPandas(count, "token string, n1 long, n0 long").groupBy("token").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # the prior needs all tokens' total, the rest only those that can pass
    sums = counts.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).toPandas()
    often = counts.where(F.col("n1") + F.col("n0") >= LEAST_COUNT).toPandas()  # bounded by the sample
    rest = sums.iloc[0].fillna(0) - often[["n1", "n0"]].sum()
    model = Model(log_odds(pd.concat([often, pd.DataFrame([{"token": "", "n1": rest["n1"], "n0": rest["n0"]}])], ignore_index=True)))
    model.weights.pop("", None)
    if not model.weights:
        return model

    least = min((w for w in model.weights.values() if w > model.drift), default=1.0) - model.drift

    def chance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [model.scan(t) for t in batch["t"]]
            excess = [x[2] - least for _, segments in out for x in segments]
            yield pd.DataFrame({"n": [sum(n for n, _ in out)], "segments": [len(excess)], "excess": [float(sum(excess))]})

    clean = rows.where("y = 0").select("t").mapInPandas(chance, "n long, segments long, excess double").agg(F.sum("n"), F.sum("segments"), F.sum("excess")).first()
    n, segments, excess = (float(x or 0) for x in clean)
    # one segment of mean excess 1 stands in for what a small sample lacks
    model.rate = (segments + 1) / (excess + 1)
    model.location = float(least + np.log((segments + 0.5) / max(n, 1.0)) / model.rate)
    scored = rows.select("y", scored_column(F.col("t"), model).alias("x")).select("y", "x.strength", "x.total").toPandas()
    if scored["y"].nunique() == 2:
        model.curve = _curve(np.column_stack(_features(scored["strength"], scored["total"])), scored["y"].to_numpy(float))
    return model


def scored_column(text: Column, model: Model) -> Column:
    """The struct SCORED of each text."""

    @arrow_udf(SCORED)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.score(t) for t in batch.to_pylist()], _SCORED)

    return scored(text)


def probability(scored: Column, model: Model) -> Column:
    a, b, c = model.curve
    return 1 / (1 + F.exp(-(F.lit(a) + b * F.log1p(scored["strength"]) + c * F.log1p(scored["total"]))))


def with_toxicity(docs: DataFrame, model: Model, text: str = "text", column: str = "toxicity") -> DataFrame:
    """docs with a struct: probability, strength and the significant passages."""
    out = docs.withColumn(column, scored_column(F.col(text), model))
    return out.withColumn(column, F.col(column).withField("probability", probability(F.col(column), model)))


def train_and_score(spark: SparkSession, docs: DataFrame, labels: DataFrame, training: Column, **options) -> DataFrame:
    return with_toxicity(docs, train(docs.where(training), labels.where(training), **options))
