"""Toxicity: class-conditional Kneser-Ney models of toxic and ordinary texts over shared backoff counts.

Three orders are compared: letters (each letter of a word after the word's own beginning), words, and words after the
word before. In each, a class counts the labelled texts that hold an n-gram, discounts them absolutely, and gives what
the discount frees to a backoff distribution that both classes share: interpolated Kneser-Ney counts over *all* documents
(for letters, over the labelled texts of both classes). So a rare expression, of which neither class has more texts than
the discount, is as likely in one as in the other and says nothing, and only what texts of one class repeat tells.

A text's differences of log-likelihood, toxic less ordinary, are normalised by length: their mean over the text, and over
its most toxic stretch of 1, 3 and 8 words, for each order. A logistic regression whose weights can't be negative, fitted
to differences of texts that weren't among those counted, makes one score of them.

Labelled texts are a bounded sample, counted on the driver; the shared counts are one pass over all documents, of the
n-grams that the sample keeps; scoring is one narrow pass with both broadcast, all of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import labelled_sample, remainder_is, slices, table

#: Labelled texts of each class, at most (about), and the characters that a text may have to be one of them.
MAX_LABELLED, MAX_CHARS = 4000, 32_768
#: Texts taken off each count, and texts' worth of the shared distribution that each context has besides; chosen by
#: two-fold cross-validation within the learnable rows of sf0.1, as were orders and stretches.
DISCOUNT, BACKOFF = 3.0, 10.0
#: Letters of a word that are compared, its end included; words of a stretch.
LETTERS, STRETCHES = 12, (1, 3, 8)
#: Parts of the sample; the terms of each are taken by what the others count, so that the regression sees unseen texts.
FOLDS = 8
N_TERMS = 3 * (1 + len(STRETCHES)) + 1
#: The ids of words that aren't known and of the place before a text's first word.
OTHER, START = 0, 1
_WORD = re.compile(r"\w+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def beginnings(words: Sequence[str]) -> np.ndarray:
    """64-bit hashes of each word's beginnings of 1 to LETTERS letters, the word's end counting as one; 0 beyond it."""
    c = np.frombuffer("".join((w[:LETTERS] + "\x02")[:LETTERS].ljust(LETTERS, "\0") for w in words).encode("utf-32-le", "replace"), dtype=np.uint32).reshape(-1, LETTERS)
    h, out = np.full(len(c), 7, dtype=np.uint64), np.zeros((len(c), LETTERS), dtype=np.uint64)
    for k in range(LETTERS):
        h = (h + c[:, k]) * _MUL
        h ^= h >> np.uint64(29)
        out[:, k] = np.where(c[:, k] > 0, h | np.uint64(1), np.uint64(0))
    return out


def _at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each of wanted is among sorted keys; of others, len(keys)."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, len(keys)) if len(keys) else np.zeros(len(wanted), dtype=np.int64)


def difference(own: np.ndarray, left: np.ndarray, total: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """log P(toxic) - log P(ordinary) of n-grams: own (discounted counts), left (freed mass) and total of their contexts,
    each a line for ordinary and one for toxic, and the shared probability."""
    p = (own + (left + BACKOFF) * shared) / (total + BACKOFF)
    return np.log(np.maximum(p[1], 1e-300)) - np.log(np.maximum(p[0], 1e-300))


class Vocabulary:
    """The words, pairs of words and beginnings of words that more labelled texts hold than the discount takes off."""

    def __init__(self, words: Sequence[str], docs: list[np.ndarray], discount: float):
        """docs: texts as numbers of words."""
        self.discount = discount
        count = np.zeros(len(words), dtype=np.int64)
        for d in docs:
            count[np.unique(d)] += 1
        keep = np.flatnonzero(count > discount)
        self.known = {words[i]: k for k, i in enumerate(keep, 2)}
        self.n = len(keep) + 2
        ids = np.zeros(len(words), dtype=np.int64)
        ids[keep] = np.arange(2, self.n)
        code, n = np.unique(np.concatenate([self.distinct(ids[d])[1] for d in docs] or [np.empty(0, np.int64)]), return_counts=True)
        self.pairs = code[n > discount]
        codes = beginnings(words)
        every, at = np.unique(codes, return_inverse=True)
        at, n = at.reshape(codes.shape), np.zeros(len(every), dtype=np.int64)
        for d in docs:
            n[np.unique(at[np.unique(d)])] += 1
        self.starts = every[(n > discount) & (every > 0)]
        self._ready()

    def _ready(self) -> None:
        self.seen = np.zeros(1 << 20, dtype=bool)  # tells of most pairs that they aren't kept
        self.seen[self._mixed(self.pairs)] = True

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    @staticmethod
    def _mixed(pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * _MUL) >> np.uint64(44)).astype(np.int64)

    def ids(self, words: Sequence[str]) -> np.ndarray:
        get = self.known.get
        return np.fromiter((get(w, OTHER) for w in words), dtype=np.int64, count=len(words))

    def distinct(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A text's distinct words, and its distinct pairs as context * n + word."""
        return np.unique(ids), np.unique(np.concatenate([[START], ids[:-1]])[: len(ids)] * self.n + ids)

    def pair_at(self, pairs: np.ndarray) -> np.ndarray:
        """Where pairs are among those kept; of others, len(self.pairs)."""
        out = np.full(len(pairs), len(self.pairs), dtype=np.int64)
        maybe = np.flatnonzero(self.seen[self._mixed(pairs)])
        out[maybe] = _at(self.pairs, pairs[maybe])
        return out


@dataclass
class Counts:
    """In how many texts each word, kept pair and kept beginning is, and how many words and pairs each context has."""

    texts: float
    words: np.ndarray
    pairs: np.ndarray
    after: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(vocabulary: Vocabulary, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Counts:
        """docs: each text's distinct words, pairs and places of kept beginnings."""
        join = lambda k: np.concatenate([d[k] for d in docs] or [np.empty(0, np.int64)]).astype(np.int64)
        pairs = join(1)
        kept = vocabulary.pair_at(pairs)
        return Counts(
            len(docs), np.bincount(join(0), minlength=vocabulary.n).astype(float), np.bincount(kept, minlength=len(vocabulary.pairs) + 1)[:-1].astype(float),
            np.bincount(pairs // vocabulary.n, minlength=vocabulary.n).astype(float), np.bincount(join(2), minlength=len(vocabulary.starts)).astype(float),
        )


class Differences:
    """log P(toxic) - log P(ordinary) of every kept word, pair and beginning, and of pairs that aren't kept by context."""

    def __init__(self, vocabulary: Vocabulary, classes: tuple[Counts, Counts], shared: Counts, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels: beginnings by length, and where those one letter shorter are (-1: none)."""
        off = lambda n: np.maximum(n - vocabulary.discount, 0)
        both = lambda name: np.stack([getattr(c, name) for c in classes])
        words, total = both("words"), both("words").sum(1)[:, None]
        all_ = max(1.0, shared.words.sum())
        p1 = (off(shared.words) + (all_ - off(shared.words).sum()) / vocabulary.n) / all_
        self.words = difference(off(words), total - off(words).sum(1)[:, None], total, p1)
        h, w = vocabulary.pairs // vocabulary.n, vocabulary.pairs % vocabulary.n
        by_context = lambda n: np.bincount(h, weights=n, minlength=vocabulary.n)
        pairs, after = off(both("pairs")), both("after")
        left = after - np.stack([by_context(p) for p in pairs])
        shared_left = shared.after - by_context(off(shared.pairs))
        p2 = np.where(shared.after[h] > 0, (off(shared.pairs) + shared_left[h] * p1[w]) / np.maximum(shared.after[h], 1), p1[w])
        self.pairs = difference(pairs, left[:, h], after[:, h], p2)
        self.context = difference(np.zeros_like(after), left, after, np.ones(vocabulary.n))  # the shared probability cancels out
        starts, texts = both("starts"), np.array([[c.texts] for c in classes])
        self.starts = np.zeros(starts.shape[1])
        for own, shorter in levels:
            n, before = starts[:, own], np.where(shorter < 0, texts, starts[:, shorter])
            r = difference(off(n), np.minimum(n, vocabulary.discount), before, n.sum(0) / np.maximum(before.sum(0), 1))
            self.starts[own] = r + np.where(shorter < 0, 0.0, self.starts[shorter])  # a word's letters add up


class Model:
    """What is sent to the executors: vocabulary, differences and the weights of the terms."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.differences: Differences | None = None
        self.calibration: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self._reset()

    def _reset(self) -> None:
        self.row: dict[str, int] = {}
        self.ids, self.letters = np.empty(0, np.int64), np.empty(0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("row", "ids", "letters")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def spelt(self, words: Sequence[str]) -> np.ndarray:
        """Each word's difference by letters: that of its longest kept beginning."""
        at = _at(self.vocabulary.starts, beginnings(words).ravel()).reshape(-1, LETTERS)
        kept = at < len(self.vocabulary.starts)
        last = kept.sum(1) - 1  # whatever is kept, its beginnings are
        return np.where(last >= 0, np.append(self.differences.starts, 0.0)[at[np.arange(len(at)), np.maximum(last, 0)]], 0.0)

    def learn_words(self, words: set[str]) -> None:
        """Ids and letters of words not met before; the table starts anew when it holds 200,000."""
        new = list(words - self.row.keys())
        if len(self.row) + len(new) > 200_000:
            self._reset()
            new = list(words)
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, self.vocabulary.ids(new)])
            self.letters = np.concatenate([self.letters, self.spelt(new)])

    def terms(self, texts: Sequence[list[str]]) -> np.ndarray:
        """terms_at of texts as words."""
        self.learn_words(set().union(*texts))
        get = self.row.__getitem__
        return self.terms_at([np.fromiter(map(get, t), dtype=np.int64, count=len(t)) for t in texts])

    def terms_at(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """For each text (places of its words in self.ids), by letters, words and pairs: the mean difference, and that of
        its most toxic stretches; then log(1 + words). A text without a word has no evidence, 0 throughout."""
        out = np.zeros((len(texts), N_TERMS))
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        some = np.flatnonzero(lengths)
        if not len(some):
            return out
        at, n = np.concatenate(texts), lengths[some]
        first = np.cumsum(n) - n
        ids = self.ids[at]
        before = np.concatenate([[START], ids[:-1]])
        before[first] = START
        kept = self.vocabulary.pair_at(before * self.vocabulary.n + ids)
        d, end, here = self.differences, np.repeat(first + n, n), np.arange(len(at))
        for k, r in enumerate((self.letters[at], d.words[ids], np.where(kept < len(d.pairs), np.append(d.pairs, 0.0)[kept], d.context[before]))):
            total = np.concatenate([[0.0], np.cumsum(r)])
            column = k * (1 + len(STRETCHES))
            out[some, column] = (total[first + n] - total[first]) / n
            for j, m in enumerate(STRETCHES, 1):
                stop, whole = np.minimum(here + m, end), np.minimum(n, m)  # a text of fewer words is one stretch
                sums = np.where(stop - here == np.repeat(whole, n), total[stop] - total[:-1], -np.inf)
                out[some, column + j] = np.maximum.reduceat(sums, first) / whole
        out[:, -1] = np.log1p(lengths)
        return out

    def scores(self, texts: Sequence[list[str]]) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(texts), 0.5)
        mean, deviation, weights = self.calibration
        z = (self.terms(texts) - mean) / deviation
        return 1 / (1 + np.exp(-np.clip(z @ weights[:-1] + weights[-1], -30, 30)))


def calibrated(x: np.ndarray, y: np.ndarray, share: np.ndarray, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and weights of a logistic regression by projected Newton steps; only the weights of the text's
    length and the bias may be negative, so that more toxic evidence never lowers a score."""
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / deviation, np.ones(len(x))])
    w, share = np.zeros(z.shape[1]), share / share.sum()
    least = np.append(np.zeros(z.shape[1] - 2), [-np.inf, -np.inf])
    ridge = l2 * np.append(np.ones(z.shape[1] - 1), 1e-6)

    def loss(w: np.ndarray) -> float:
        return float((share * (np.logaddexp(0, z @ w) - y * (z @ w))).sum() + (ridge * w * w).sum() / 2)

    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (share * (p - y)) + ridge * w
        free = (w > least) | (grad < 0)
        step = np.zeros_like(w)
        step[free] = np.linalg.solve((z[:, free] * (share * p * (1 - p))[:, None]).T @ z[:, free] + np.diag(ridge[free]), grad[free])
        size = 1.0
        while size > 1e-6 and loss(np.maximum(w - size * step, least)) >= now:
            size /= 2
        if size <= 1e-6:
            break
        w = np.maximum(w - size * step, least)
        before, now = now, loss(w)
        if before - now < 1e-9:
            break
    return mean, deviation, w


def shared_counts(docs: DataFrame, vocabulary: Vocabulary) -> Counts:
    """Of every document: the number of texts with each known word and kept pair, and of pairs after each word."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        n = [np.zeros(k, dtype=np.int64) for k in (v.n, len(v.pairs) + 1, v.n)]
        for part in slices(batches):
            found = [v.distinct(v.ids(words)) for words in map(words_of, part.column(0).to_pylist()) if words]
            if found:
                pairs = np.concatenate([f[1] for f in found])
                n[0] += np.bincount(np.concatenate([f[0] for f in found]), minlength=v.n)
                n[1] += np.bincount(v.pair_at(pairs), minlength=len(v.pairs) + 1)
                n[2] += np.bincount(pairs // v.n, minlength=v.n)
        for kind, own in enumerate(n):
            at = np.flatnonzero(own)
            for a in range(0, len(at), 50_000):
                yield pa.record_batch({"kind": pa.array(np.full(len(at[a : a + 50_000]), kind, np.int32)), "at": pa.array(at[a : a + 50_000]), "n": pa.array(own[at[a : a + 50_000]])})

    rows = docs.where("text is not null").select("text").mapInArrow(each, "kind int, at long, n long")
    found = rows.groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas()  # no more rows than the vocabulary has
    out = []
    for kind, size in enumerate((vocabulary.n, len(vocabulary.pairs) + 1, vocabulary.n)):
        own, dense = found[found["kind"] == kind], np.zeros(size)
        dense[own["at"].to_numpy()] = own["n"].to_numpy()
        out.append(dense)
    sent.unpersist()
    return Counts(0, out[0], out[1][:-1], out[2], np.empty(0))


class Sample:
    """Labelled texts counted under one discount."""

    def __init__(self, texts: Iterable[list[str]], y: np.ndarray, discount: float):
        self.y, seen = y, {}
        self.numbers = [np.fromiter((seen.setdefault(w, len(seen)) for w in t), dtype=np.int32, count=len(t)) for t in texts]
        self.words = list(seen)
        del seen
        self.vocabulary = v = Vocabulary(self.words, self.numbers, discount)
        ids, at, none = v.ids(self.words), _at(v.starts, beginnings(self.words).ravel()).reshape(-1, LETTERS), len(v.starts)
        self.docs = []
        for d in self.numbers:
            starts = np.unique(at[np.unique(d)])
            words, pairs = v.distinct(ids[d])
            self.docs.append((words.astype(np.int32), pairs, starts[starts < none].astype(np.int32)))
        self.levels = []
        for k in range(LETTERS):
            own, first = np.unique(at[:, k], return_index=True)
            own, first = own[own < none], first[: np.count_nonzero(own < none)]
            self.levels.append((own, at[first, k - 1] if k else np.full(len(own), -1)))

    def differences(self, rows: np.ndarray, shared: Counts) -> Differences:
        return Differences(self.vocabulary, tuple(Counts.of(self.vocabulary, [self.docs[i] for i in rows if self.y[i] == label]) for label in (0, 1)), shared, self.levels)

    def terms(self, shared: Counts) -> np.ndarray:
        """Each text's terms by the counts of the other folds."""
        fold, x, model = np.zeros(len(self.y), dtype=int), np.zeros((len(self.y), N_TERMS)), Model(self.vocabulary)
        for label in (0, 1):  # all folds get as many of each class
            own = np.flatnonzero(self.y == label)
            fold[own] = np.arange(len(own)) % FOLDS
        for k in range(FOLDS):
            own = np.flatnonzero(fold == k)
            model.differences = self.differences(np.flatnonzero(fold != k), shared)
            model.ids, model.letters = self.vocabulary.ids(self.words), model.spelt(self.words)
            for a in range(0, len(own), 200):
                x[own[a : a + 200]] = model.terms_at([self.numbers[i] for i in own[a : a + 200]])
        return x


def fitted(texts: Iterable[list[str]], y: np.ndarray, weight: Sequence[float], shared=None, discount: float = DISCOUNT) -> Model:
    """The model of labelled texts, as words. weight: rows that a text of either label stands for. shared: gives the
    Counts of all documents for a Vocabulary; without it, those of the texts themselves."""
    sample = Sample(texts, y, discount)
    model = Model(sample.vocabulary)
    everything = shared(sample.vocabulary) if shared else Counts.of(sample.vocabulary, sample.docs)
    if len(set(y)) == 2:
        model.calibration = calibrated(sample.terms(everything), y, np.asarray(weight, dtype=float)[y])
    model.differences = sample.differences(np.arange(len(y)), everything)
    return model


def fit(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, max_labelled: int = MAX_LABELLED, max_chars: int = MAX_CHARS) -> Model:
    """The model of docs (doc_id, text) and labels (doc_id, toxic). Texts of more than max_chars characters aren't learned from."""
    learn = ~remainder_is("doc_id", mod, rest)
    n = {r.toxic: r.n for r in labels.where(learn & F.col("toxic").isin(0, 1)).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = labelled_sample(docs.where(F.length("text") <= max_chars), labels, "toxic", learn, max_labelled).toPandas().sort_values(["doc_id", "text"], kind="stable")
    y = rows.pop("y").to_numpy().astype(int)
    weight = [n.get(k, 1) / max(1, (y == k).sum()) for k in (0, 1)]
    return fitted(map(words_of, rows.pop("text").tolist()), y, weight, lambda v: shared_counts(docs, v))


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs; equal texts score alike.

    Null and empty texts, and texts without a word, are scored as having no evidence: what the calibration says of them.
    Rows whose crc32 remainder is `rest`, or whose doc_id or label is null or contrary, teach nothing. Without both
    labels every score is 0.5. Other columns of docs aren't read, so their names don't matter.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, mod, rest))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            scores = model.value.scores([words_of(t) for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=["doc_id", "score"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, score double")
    return df.select("doc_id", remainder_is("doc_id", mod, rest).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
