"""Quality classifier: a Bradley-Terry model of preference pairs over features of whole texts.

Features are counted once for every document, in Arrow batches, and written (a few dozen numbers a document); the
labelled rows among them then meet their labels without any text. A bounded sample of labelled rows is fitted on the
driver; the threshold is a quantile of the scores over all labelled learnable rows, of 201 levels of either label's scores
the one that parts the labels best.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import materialize, remainder_is, table

#: Labelled rows of each label that are fitted, at most (about); pairs drawn for each of them.
MAX_LABELLED, PAIRS = 20_000, 8
_SYMBOLS, _PIPES, _STOPS, _SHOUTS = set("#*$%&<>@^~_=+{}[]\\/"), set("|"), set(".,;:"), set("!?")
N_FEATURES = 26


def features(text: str | None) -> list[float]:
    """Ratios and logarithms of counts over the whole text; null and empty texts give zeros and a mark of their own."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [1.0] + [0.0] * (N_FEATURES - 1)
    seen = Counter(text)
    of = lambda group: sum(seen[c] for c in group) / chars
    upper = lower = digit = space = wide = 0
    for c, k in seen.items():
        if c.isupper():
            upper += k
        elif c.islower():
            lower += k
        elif c.isdigit():
            digit += k
        elif c.isspace():
            space += k
        if c > "\x7f":
            wide += k
    p = np.fromiter(seen.values(), dtype=float) / chars
    counted = Counter(words)
    top = counted.most_common(1)[0][1]
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    pairs = Counter(zip(words, words[1:], strict=False))
    again = sum(v for v in pairs.values() if v > 1)
    stuck = sum(map(str.__eq__, words, words[1:]))
    lengths = np.fromiter(map(len, words), dtype=float, count=n)
    single = sum(1 for x in lines if len(x.split()) <= 2)
    return [
        0.0, of(_SYMBOLS), of(_PIPES), of(_STOPS), of(_SHOUTS), upper / chars, lower / chars, digit / chars, space / chars, wide / chars,
        float(-(p * np.log(p)).sum()), len(counted) / n, len(counted) / n**0.5, top / n, again / n, stuck / n, 1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n)), float(np.log1p(chars)), lengths.mean(), lengths.std(), float(lengths.max() > 40), len(lines) / n, single / max(1, len(lines)),
        sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n,
    ]


def featured(docs: DataFrame) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "x": [features(t) for t in pdf["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(each, "doc_id long, x array<double>")


class BradleyTerry:
    """Scores x @ w with P(a is preferred to b) = sigmoid(score(a) - score(b)); w minimises the logistic loss of pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, l2: float = 1e-3, steps: int = 30, seed: int = 0):
        self.mean, self.std = (x.mean(0), x.std(0)) if len(x) else (0.0, 1.0)
        self.std = np.where(self.std > 1e-9, self.std, 1.0)
        self.w = np.zeros(N_FEATURES * 2)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return
        rng = np.random.default_rng(seed)
        z = self.shaped(x)
        # each row meets `pairs` rows of the other label, so that the rarer label's rows aren't drowned
        a = np.concatenate([np.repeat(good, pairs), rng.choice(good, len(bad) * pairs)])
        b = np.concatenate([rng.choice(bad, len(good) * pairs), np.repeat(bad, pairs)])
        diff = z[a] - z[b]
        for _ in range(steps):  # Newton's method; the loss is convex
            p = 1 / (1 + np.exp(-np.clip(diff @ self.w, -30, 30)))
            grad = diff.T @ (p - 1) / len(diff) + l2 * self.w
            hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + l2 * np.eye(len(self.w))
            step = np.linalg.solve(hess, grad)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    def shaped(self, x: np.ndarray) -> np.ndarray:
        """Standard scores and their squares, held within 5 deviations so that one odd count can't outvote the rest."""
        z = np.clip((x - self.mean) / self.std, -5, 5)
        return np.concatenate([z, z * z], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.shaped(x) @ self.w


def quality(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, cut: float = 0.3, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs; labels has doc_id and quality (1 is better).

    score is a logistic of the distance to the threshold and equals `cut` there. The threshold is the quantile of the
    learnable rows' scores at which the two kinds of error on those rows are fewest in sum of rates. Rows whose crc32
    remainder is `rest`, or whose doc_id or label is null or contrary, teach nothing. Without both labels every score is
    0.5. Equal texts score alike; null and empty texts are scored by their own mark.
    """
    fx = materialize(featured(docs), "quality-features")
    y = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2")
    learn = materialize(fx.join(y.select("doc_id", "y"), "doc_id").where(~remainder_is("doc_id", mod, rest)), "quality-labelled")
    n = {r.y: r.n for r in learn.groupBy("y").agg(F.count("*").alias("n")).collect()}
    unit = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("y") == 1, min(1.0, max_labelled / max(1, n.get(1, 0)))).otherwise(min(1.0, max_labelled / max(1, n.get(0, 0))))
    rows = learn.where(unit < rate).orderBy("doc_id", "x").toPandas()
    model = BradleyTerry(np.array(rows["x"].tolist(), dtype=float).reshape(-1, N_FEATURES), rows["y"].to_numpy())
    low, width = 0.0, 1.0
    if n.get(0) and n.get(1):
        score = F.pandas_udf(lambda x: pd.Series(model.score(np.array(x.tolist(), dtype=float).reshape(-1, N_FEATURES))), "double")
        levels = [i / 200 for i in range(201)]
        q = {r.y: np.array(r.q) for r in learn.withColumn("s", score("x")).groupBy("y").agg(F.percentile_approx("s", levels, 10_000).alias("q")).collect()}
        every = np.unique(np.concatenate([q[0], q[1]]))
        errors = np.array([np.mean(q[0] >= t) + np.mean(q[1] < t) for t in every])
        best = np.flatnonzero(errors <= errors.min() + 1e-12)
        low = float(every[best[0]] + every[max(0, best[0] - 1)]) / 2
        width = max(1e-6, float(np.median(q[1]) - np.median(q[0])) / 8)
    known, at = bool(n.get(0) and n.get(1)), float(np.log(cut / (1 - cut)))

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = model.score(np.array(pdf["x"].tolist(), dtype=float).reshape(-1, N_FEATURES))
            score = 1 / (1 + np.exp(-np.clip((s - low) / width + at, -30, 30))) if known else np.full(len(pdf), 0.5)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": score})

    return fx.mapInPandas(final, "doc_id long, score double").select(
        "doc_id", remainder_is("doc_id", mod, rest).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
