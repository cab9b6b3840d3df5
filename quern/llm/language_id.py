"""Language ID by rank-order profiles: the n-grams of a text, most frequent first, against those of each language.

Profiles are learned from all labelled texts outside the held-out fold, counted in slices of Arrow batches and summed by
Spark; they (languages times `top` n-grams) are all that is sent to the executors. Prediction is one narrow pass.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.llm.shared import lean, materialize, remainder_is, slices, table

#: n-grams in a profile; letters in an n-gram; more languages are an error; n-grams that a task counts before it sums them.
TOP, LONGEST, MAX_LANGS, HELD = 400, 3, 1000, 1 << 18
#: A text is of no known language below this share of the score that all but this quantile of learned texts reach.
SHARE, QUANTILE = 2 / 3, 0.01
_OTHER = re.compile(r"[\W\d_]+")


def _words(text: str | None) -> str:
    """The lower-cased words between single blanks; empty if the text has no letter."""
    words = _OTHER.sub(" ", (text or "").lower()).strip()
    return words if any(map(str.isalpha, words)) else ""  # \w has signs besides that are no letters, as ² and Ⅷ


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of lower-cased words between single blanks; none if the text has no letter."""
    return _grams(_words(text))


def _grams(words: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of words between single blanks.

    A code holds up to three code points of 21 bits each, so different n-grams never share one.
    """
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = np.frombuffer(f" {words} ".encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    found, each = [c[c != 32]], c
    for n in range(2, LONGEST + 1):
        each = (each[:-1] << np.uint64(21)) | c[n - 1 :]
        blank = (each & np.uint64(0x1FFFFF)) == 32
        if n == 3:  # a blank inside belongs to two words
            inside = ((each >> np.uint64(21)) & np.uint64(0x1FFFFF)) == 32
            found.append(each[~inside])
        else:
            found.append(each[~(blank & ((each >> np.uint64(21)) == 32))])
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The codes of the `top` most frequent n-grams in order; ties by code."""
    if len(codes) > 4 * top:
        edge = np.partition(counts, len(counts) - top)[len(counts) - top]
        codes, counts = codes[counts >= edge], counts[counts >= edge]
    return codes[np.lexsort((codes, -counts))[:top]]


class Profiles:
    """Ranks of each language's n-grams, as one sorted table."""

    def __init__(self, ordered: dict[str, Sequence[int]], top: int = TOP):
        self.top, self.langs = top, sorted(ordered)
        self.codes = np.unique(np.array([c for x in ordered.values() for c in x], dtype=np.uint64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int32)  # the last line: not known
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, np.array(ordered[lang], dtype=np.uint64)), j] = np.arange(len(ordered[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance (ties: the smaller name) and 1 - distance / the largest possible.

        An n-gram that a profile lacks is `top` places out. und, 0: no letter in the text, or no profile. A score of 0
        says that no n-gram of the text is in any profile.
        """
        own = ranked(*grams(text), self.top)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        ranks = self.ranks[np.where(self.codes[at] == own, at, len(self.codes))] if len(self.codes) else np.full((len(own), len(self.langs)), -1)
        out = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(own))[:, None])).sum(0)
        best = int(out.argmin())
        return self.langs[best], float(1 - out[best] / (self.top * len(own)))


def _learnable(mod: int = 5, rest: int = 0) -> Column:
    """Whether a row (doc_id, text, lang) may be learned from: it has text and lang, and its crc32 remainder isn't `rest`."""
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & ~remainder_is("doc_id", mod, rest)


def learn(docs: DataFrame, mod: int = 5, rest: int = 0, top: int = TOP) -> Profiles:
    """Profiles from doc_id, text, lang: of all rows with a lang whose crc32 remainder isn't `rest`; no rows, no profiles."""
    rows = docs.where(_learnable(mod, rest)).select("lang", "text")
    if rows.select("lang").distinct().limit(MAX_LANGS + 1).count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0
        for part in slices(batches, 1, size=200_000):
            words: dict[str, list[str]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if own := _words(text):
                    words.setdefault(lang, []).append(own)
            for lang, own in words.items():
                found.setdefault(lang, []).append(_grams(" ".join(own)))
                held += len(found[lang][-1][0])
            if held >= HELD:
                yield from _summed(found)
                found, held = {}, 0
        yield from _summed(found)

    summed = rows.mapInArrow(lean(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best: dict[str, list[int]] = {}
    for r in sorted(summed.withColumn("place", place).where(F.col("place") <= top).select("lang", "place", "code").collect()):
        best.setdefault(r.lang, []).append(r.code)
    return Profiles(best, top)


def _summed(found: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """lang, code, n of each language's lists of codes and counts, each code once."""
    for lang, parts in found.items():
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        n = np.zeros(len(codes), dtype=np.int64)
        np.add.at(n, at, np.concatenate([n for _, n in parts]))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])


def quantile(scores: DataFrame, q: float, cells: int = 1 << 16) -> float | None:
    """The q-quantile of all rows' score (0 to 1), between two scores as F.percentile has it; None if there is no row.

    Scores are counted by cells, and those of the one or two cells that the quantile lies in once more, each distinct one:
    the driver gets `cells` + 1 rows and these few, as scores are fractions of at most `top` different denominators.
    """
    cell = F.floor(F.col("score") * cells)
    by = scores.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).orderBy("cell").collect()
    if not by:
        return None
    ends = np.cumsum([r.n for r in by])
    at = q * (int(ends[-1]) - 1)
    places = [math.floor(at), math.ceil(at)]
    first, last = np.searchsorted(ends, places, "right").tolist()
    near = scores.where(cell.between(by[first].cell, by[last].cell)).groupBy("score").agg(F.count("*").alias("n")).orderBy("score").collect()
    ends = int(ends[first]) - by[first].n + np.cumsum([r.n for r in near])
    low, high = (near[i].score for i in np.searchsorted(ends, places, "right").tolist())
    return low if low == high else (places[1] - at) * low + (at - places[0]) * high


def predictions(docs: DataFrame, profiles: Profiles, *carry: str) -> DataFrame:
    """The columns in carry, and lang_pred and score, as the struct quern_lang, of each row; carry must have text."""
    known = docs.sparkSession.sparkContext.broadcast(profiles)
    df = docs.select(*[F.col(f"`{c}`") for c in carry])
    names, text = [*df.columns, "quern_lang"], df.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            found = [known.value.predict(t) for t in part.column(text).to_pylist()]
            pred = pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([*part.columns, pred], names=names)

    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.mapInArrow(lean(each), T.StructType([*df.schema.fields, T.StructField("quern_lang", kind)]))


def language_id(docs: DataFrame, mod: int = 5, rest: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text, lang), repeated rows alike.

    Null texts and texts without a letter are und with score 0, as is everything if no row can be learned from.
    """
    df = predictions(docs.select("doc_id", "text"), learn(docs, mod, rest), "doc_id", "text")
    return df.select("doc_id", remainder_is("doc_id", mod, rest).alias("held_out"), "quern_lang.lang_pred", "quern_lang.score")


def accepted(docs: DataFrame) -> DataFrame:
    """docs without the rows that language ID rejects: und, or a score too low for any known language.

    What is too low is learned: below SHARE of the QUANTILE of the scores of all texts that the profiles come from.

    Where no labelled text has a letter, no language is learned and nothing tells against a text: all with a letter stay.
    """
    profiles = learn(docs)
    if not profiles.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]  # no name of theirs can clash so
    df = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, own, strict=True)], _learnable().alias("learnable"))
    df = materialize(predictions(df, profiles, *own, "learnable"), "language-scores")  # two passes read the scores
    score = F.col("quern_lang.score")
    least = quantile(df.where(F.col("learnable") & (score > 0)).select(score.alias("score")), QUANTILE)
    known = (F.col("quern_lang.lang_pred") != "und") & (score > 0) & (score >= SHARE * (least or 0.0))
    return df.where(known).select(*own).toDF(*docs.columns)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
