"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its 5-word shingles, each labelled with its occurrence. A sketch takes the few smallest
labelled shingles under one hash and keeps them in text order; texts of high edit similarity share sketches. Equal word
sequences are one class from the start (an aggregation by a 128-bit key), so no group of copies is ever expanded. For
each sketch every member is compared with one leader; the links make components; where a bucket still holds several, its
members are dealt again by longer sketches, and only what these leave in several components is compared outright: the
members outside the largest component with the rest. So a linked pair is lost only if it shares no sketch, and no bucket's
pairs are all emitted. Texts of few shingles have too few for that and are linked exactly: two of them are alike only if
they are equal but for a shingle of each or two of one, so they meet by what is left without these. Components are found by hooking and pointer jumping over written edge tables; nothing
about documents, links or components reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import lean, materialize, release, slices, table

WORDS, SIMILAR = 5, 0.8
#: (sketches, shingles in each): for every text, and for those whose buckets one leader couldn't resolve. Texts of 0.8
#: share a short sketch with odds of 0.9998 and a long one with 0.9999; texts of 0.45, a long one with 0.03. Long ones take
#: nearly all shingles of a text of less than 20 and are middle ones there; up to 24 have both, so that all pairs can meet.
SHORT, MIDDLE, LONG = (16, 4), (96, 6), (96, 10)
MIDDLE_BELOW, LONG_FROM = 25, 20
#: Texts of so many shingles at most are linked to each other exactly.
FEW = 12
#: So many keys of 16 bytes (so 4 MB), or of 24, are sent to where the texts are, which then needn't be shuffled; more are joined.
SENT = 250_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(6).integers(1, 1 << 63, 128).astype(np.uint64)


class _WordHashes(dict):
    """64-bit hashes of words, remembered; emptied when 65,536 are held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 65_536:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MUL
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the shingles of a sequence of word hashes; fewer than WORDS words make one shingle."""
    n = len(words) - WORDS + 1
    if n < 1:
        words, n = np.concatenate([words, np.zeros(WORDS - len(words), words.dtype)]), 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        h = _scrambled(h + words[k : n + k].astype(np.uint64) + np.uint64(k + 1))
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence mixed in, from the second on."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    if not same.any():
        return h
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(s))))
    out = h.copy()
    out[order] = np.where(same, _scrambled(s + (np.arange(len(s)) - start).astype(np.uint64)), s)
    return out


def sketches(h: np.ndarray, many: int, length: int) -> np.ndarray:
    """Order MinHash sketches of labelled shingles, as 64-bit hashes of the `length` chosen ones in text order."""
    out = _SEEDS[:many] * np.uint64(2 * length + 1)
    step = max(1, 4_000_000 // len(h))
    for a in range(0, many, step):  # very long texts take few sketches at a time
        seeds = _SEEDS[a : min(many, a + step)]
        v = (h[None, :] ^ seeds[:, None]) * _MUL
        v ^= v >> np.uint64(32)
        at = np.sort(np.argpartition(v, length - 1, axis=1)[:, :length], axis=1) if len(h) > length else np.tile(np.arange(len(h)), (len(seeds), 1))
        for k in range(at.shape[1]):
            out[a : a + step] = _scrambled(out[a : a + step] + h[at[:, k]])
    return out


def alike(x: np.ndarray, y: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether the aligned shingles of two word sequences are `least` of all: c / (a + b - c) >= least.

    c is the longest common subsequence of shingles, by bit-parallel alignment of a band: at that similarity at most
    (a + b) (1 - least) / (1 + least) shingles are out of line, so no alignment that could pass leaves the band. Only the
    band's rows are held, as one number that slides along the diagonal.
    """
    a, b = shingles(x), shingles(y)
    na, nb = len(a), len(b)
    if min(na, nb) < least * max(na, nb):
        return False
    need = least / (1 + least) * (na + nb) - 1e-9
    m = min(na, nb)
    differ = a[:m] != b[:m]
    head = int(differ.argmax()) if differ.any() else m
    differ = a[::-1][: m - head] != b[::-1][: m - head]
    tail = int(differ.argmax()) if differ.any() else m - head
    a, b, common = a[head : na - tail], b[head : nb - tail], head + tail
    if common >= need:
        return True
    codes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = both[: len(a)], both[len(a) :]
    most = np.minimum(np.bincount(ia, minlength=len(codes)), np.bincount(ib, minlength=len(codes))).sum()
    if common + most < need:
        return False
    band = int((na + nb) * (1 - least) / (1 + least)) + 1
    return common + _in_band(ia, ib, band) >= need


def _in_band(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The longest common subsequence of two sequences of small integers whose places differ by `band` at most.

    Bit i of v tells of row base + i; a 0 is where the subsequence grows. Rows below the band can't change any more and
    are counted as they leave it; rows above are all 1.
    """
    order = np.argsort(a, kind="stable")
    first = np.searchsorted(a[order], b)
    last = np.searchsorted(a[order], b, "right")
    order = order.tolist()
    v = window = (1 << (2 * band + 1)) - 1
    base, grown = -band, 0
    for j in np.flatnonzero(last > first).tolist():
        hit = 0
        for i in order[first[j] : last[j]]:
            if -band <= i - j <= band:
                hit |= 1 << (i - j + band)
        if not hit:
            continue
        step = j - band - base  # rows that have left the band since the last hit
        if step:
            grown += step - (v & ((1 << step) - 1)).bit_count() if step <= 2 * band else 2 * band + 1 - v.bit_count()
            v = (v >> step) | (window ^ (window >> step)) if step <= 2 * band else window
            base += step
        u = v & hit
        v = ((v + u) | (v - u)) & window
    return grown + 2 * band + 1 - v.bit_count()


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and, of texts with a word, node (128-bit key of the words), n (shingles), short sketches, words (32-bit hashes)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for part in slices(batches, 2):
            rows = []
            for text in part.column(2).to_pylist():
                words = (text or "").encode("utf-8", "replace").split()
                if not words:
                    rows.append((None, 0, None, None))
                    continue
                h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
                # shingles are made of the 32-bit hashes, so that sketches and alignment see the same
                own = (h >> np.uint64(32)).astype(np.uint32)
                rows.append((xxhash.xxh3_128_digest(h.tobytes()), max(1, len(words) - WORDS + 1), sketches(labelled(shingles(own)), *SHORT).view(np.int64), own.tobytes()))
            node, n, sk, own = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(sk, pa.list_(pa.int64())), pa.array(own, pa.binary())],
                names=["doc_id", "text_key", "node", "n", "sketches", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("text_key"), "text")
    return rows.mapInArrow(lean(each), "doc_id long, text_key binary, node binary, n long, sketches array<long>, words binary")


def _sent(keys: DataFrame, most: int) -> DataFrame:
    """keys, a written table, to be broadcast if it has `most` rows at most."""
    return F.broadcast(keys) if keys.count() <= most else keys


def _words_of(ends: DataFrame, described: DataFrame, most: int = SENT) -> DataFrame:
    """node, words of the nodes in ends, written. Up to `most` nodes are sent to where the words are."""
    ends = materialize(ends.distinct(), "near-ends")
    words = materialize(described.join(_sent(ends, most), "node", "left_semi").groupBy("node").agg(F.first("words").alias("words")), "near-words")
    release(ends)
    return words


def _verified(pairs: DataFrame, described: DataFrame) -> DataFrame:
    """Those pairs (a, b) that are alike, written."""
    pairs = materialize(pairs, "near-pairs")
    words = _words_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), described)
    met = pairs.join(words.withColumnsRenamed({"node": "a", "words": "x"}), "a").join(words.withColumnsRenamed({"node": "b", "words": "y"}), "b")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            yield pdf.loc[keep, ["a", "b"]]

    links = materialize(met.select("a", "b", "x", "y").mapInPandas(lean(each), "a binary, b binary"), "near-links")
    release(pairs, words)
    return links


def _shared(nodes: DataFrame) -> DataFrame:
    """node, n, s, words of nodes (node, words) that can have a link among them at all, written.

    s is how many of a text's n labelled shingles any other of the texts has: no alignment can count more, so where
    s < 0.8 n there is no link, and two texts link only if the smaller s reaches 0.8 of what the pair has.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for node, x in zip(pdf["node"], pdf["words"], strict=True):
                h = labelled(shingles(np.frombuffer(x, np.uint32))).view(np.int64)
                yield pd.DataFrame({"h": h, "node": [node] * len(h)})

    own = nodes.mapInPandas(lean(each), "h long, node binary").groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    alone = materialize(own.groupBy("node").agg(F.count("*").alias("alone")), "near-alone")
    df = nodes.join(alone, "node", "left").withColumn("n", F.greatest(F.length("words") / 4 - (WORDS - 1), F.lit(1)).cast("long"))
    df = df.select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s"), "words").where(F.col("s") >= SIMILAR * F.col("n") - 1e-6)
    return materialize(df, "near-shared")


def long_keys(h: np.ndarray) -> np.ndarray:
    """The long sketches of labelled shingles, the middle ones of few shingles, or both."""
    kinds = [MIDDLE] * (len(h) < MIDDLE_BELOW) + [LONG] * (len(h) >= LONG_FROM)
    return np.concatenate([sketches(h, *kind) for kind in kinds])


def _long_sketches(nodes: DataFrame) -> DataFrame:
    """key, node, n, s: the long (or middle) sketches of nodes (node, n, s, words)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [long_keys(labelled(shingles(np.frombuffer(x, np.uint32)))).view(np.int64) for x in pdf["words"]]
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys)} | {c: np.repeat(pdf[c].to_numpy(), [len(k) for k in keys]) for c in ("node", "n", "s")})

    return nodes.mapInPandas(lean(each), "key long, node binary, n long, s long")


def few_keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a few shingles in order, of all but one and (from 10 on) of all but two; and how many each key holds."""
    n, keys, left = len(h), [], []
    for r in range(n, n - (3 if n >= 10 else 2), -1):
        at = np.array(list(combinations(range(n), r)))
        key = np.full(len(at), r, dtype=np.uint64)
        for k in range(r):
            key = _scrambled(key + h[at[:, k]])
        keys.append(np.unique(key))
        left.append(np.full(len(keys[-1]), r))
    return np.concatenate(keys), np.concatenate(left)


def _few_links(described: DataFrame) -> DataFrame:
    """Links (a, b) that connect all texts of FEW shingles at most that are alike.

    Up to FEW, texts of 0.8 have all shingles but one of each, or but two of the longer, in common. Texts that share a key
    of r are alike if r is 0.8 of what they have; if any two of a key are, all that are alike to any are so to the shortest.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [few_keys(shingles(np.frombuffer(x, np.uint32))) for x in pdf["words"]]
            if found:
                many = [len(k) for k, _ in found]
                yield pd.DataFrame({"key": np.concatenate([k for k, _ in found]).view(np.int64), "r": np.concatenate([r for _, r in found])} | {c: np.repeat(pdf[c].to_numpy(), many) for c in ("node", "n")})

    nodes = described.where(F.col("node").isNotNull() & F.col("n").between(4, FEW)).groupBy("node").agg(F.first("n").alias("n"), F.first("words").alias("words"))
    rows = materialize(nodes.mapInPandas(lean(each), "key long, r long, node binary, n long"), "near-few")
    first = rows.groupBy("key", "r").agg(F.min(F.struct("n", "node")).alias("l"), F.count("*").alias("size")).where("size > 1").select("key", "r", "l")
    met = rows.join(first, ["key", "r"]).where((F.col("node") != F.col("l.node")) & (F.col("r") >= SIMILAR * (F.col("n") + F.col("l.n") - F.col("r")) - 1e-9))
    return met.select(F.col("l.node").alias("a"), F.col("node").alias("b"))


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, component of every node that a link (a, b) has; component is the same for all that are connected.

    known holds what earlier links came to (node, component) and is taken over. Each round every node hooks to its
    smallest neighbour, chains are jumped, and links are contracted; the rounds' maps are put together at the end. Node
    keys are hashes, so chains are short and rounds grow with the logarithm of a component's size.
    """
    links = links.select("a", "b")
    if known is not None:
        for c in ("a", "b"):
            links = links.join(known.toDF("known", "now"), F.col(c) == F.col("known"), "left").withColumn(c, F.coalesce("now", c)).select("a", "b")
    links = materialize(links.where("a <> b").distinct(), "links")
    nodes, maps = links.select(F.col("a").alias("node")).union(links.select("b")).distinct(), []
    while not links.isEmpty():
        up = links.union(links.select("b", "a")).groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b"))
        up = materialize(up.alias("u").join(up.alias("t"), F.col("u.b") == F.col("t.a")).select("u.a", F.col("t.b").alias("b")), "up")
        maps.append(up)
        links = links.join(up.toDF("a", "a2"), "a").join(up.toDF("b", "b2"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        links = materialize(links.where("a <> b").distinct(), "links")
    labels = nodes.select("node", F.col("node").alias("component"))
    if known is not None:
        labels = known.union(labels.join(known, "node", "left_anti"))
    for up in maps:
        labels = labels.join(up, labels["component"] == up["a"], "left").select("node", F.coalesce("b", "component").alias("component"))
    return materialize(labels, "labels")


def _mixed(rows: DataFrame) -> DataFrame:
    """Of rows (key, node, n, s, component), those of keys with several components, with the key's leader and main component.

    Keys that only texts of few shingles have are left out, as these are linked to each other already.
    The leader is the member of the main component with fewest shingles of its own, as most are alike to that one.
    """
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("size"), F.max("n").alias("longest"), F.min(F.struct(F.expr("n - s").alias("alone"), F.xxhash64("node", "key"), "node", "n", "s")).alias("l"))
    by = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("size", "component", "l")).alias("m"), F.max("longest").alias("longest")).where((F.col("parts") > 1) & (F.col("longest") > FEW))
    by = materialize(by.selectExpr("key", "m.component AS main", "m.l.node AS leader", "m.l.n AS leader_n", "m.l.s AS leader_s"), "near-leaders")
    mixed = materialize(rows.join(by, "key"), "near-mixed")
    release(by)
    return mixed


def _relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.select("key", "node", "n", "s").join(labels, "node", "left").select("key", "node", "n", "s", F.coalesce("component", "node").alias("component"))


def _can_link(n: str, s: str, m: str, t: str) -> Column:
    """Whether texts of n and m shingles, of which s and t can be shared, can be alike and aren't linked as both of few shingles."""
    return (F.greatest(n, m) > FEW) & (F.least(s, t) >= SIMILAR / (1 + SIMILAR) * (F.col(n) + F.col(m)) - 1e-6)


def _parities(nodes: DataFrame) -> DataFrame:
    """node, p0 to p15 of nodes (node, words): whether the labelled shingles of each of 1024 hash values are odd in number.

    Two texts differ in as many shingles at least as their parities in bits, so that most pairs that aren't alike are
    known without alignment, and none that is gets lost.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = [np.bincount((_scrambled(labelled(shingles(np.frombuffer(x, np.uint32)))) >> np.uint64(54)).astype(np.int64), minlength=1024) & 1 for x in pdf["words"]]
            p = np.packbits(np.array(bits, dtype=np.uint8).reshape(-1, 1024), axis=1).view(np.int64)
            yield pd.DataFrame({"node": pdf["node"]} | {f"p{k}": p[:, k] for k in range(16)})

    return nodes.select("node", "words").mapInPandas(lean(each), "node binary, " + ", ".join(f"p{k} long" for k in range(16)))


def _with_leaders(mixed: DataFrame) -> DataFrame:
    """Pairs of each key's leader, of its main component, and the members of others."""
    rows = mixed.where((F.col("component") != F.col("main")) & _can_link("n", "s", "leader_n", "leader_s"))
    return rows.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _classes(described: DataFrame) -> DataFrame:
    """node, component of the nodes that have a near copy of other words.

    Texts of few shingles are linked first. Keys are the short sketches then, whose members meet a leader. Texts of keys that still hold several components, if
    enough of their shingles are shared, are keyed by their long or middle sketches: leaders again, and then all members outside
    the main component against all others that they can link to.
    """
    nodes = described.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    labels = components(_few_links(described))
    nodes = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = materialize(nodes.select(F.explode("sketches").alias("key"), "node", "n", F.col("n").alias("s"), "component"), "near-sketches")
    mixed = _mixed(rows)
    release(rows)
    links = _verified(_with_leaders(mixed), described)
    labels = components(links, labels)
    left = _mixed(_relabelled(mixed, labels))
    found = _words_of(left.select("node"), described)
    words = _shared(found)
    release(mixed, left, found)
    rows = materialize(_long_sketches(words), "near-long-sketches")
    mixed = _mixed(_relabelled(rows, labels))
    release(rows)
    links = _verified(_with_leaders(mixed), words)
    labels = components(links, labels)
    rest = _mixed(_relabelled(mixed, labels))
    rest = materialize(rest.join(_parities(words.join(rest.select("node").distinct(), "node", "left_semi")), "node"), "near-rest")
    x, y = rest.where("component <> main").alias("x"), rest.alias("y")
    apart = sum((F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}"))) for k in range(1, 16)), F.bit_count(F.col("x.p0").bitwiseXOR(F.col("y.p0"))))
    differ = apart <= (1 - SIMILAR) / (1 + SIMILAR) * (F.col("x.n") + F.col("y.n")) + 1e-6
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & _can_link("x.n", "x.s", "y.n", "y.s") & differ)
    found = _verified(more.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), words)
    return labels if found.isEmpty() else components(found, labels)


def _resolved(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, class_id of each row of docs (doc_id, text)."""
    described = materialize(_described(docs), "near-described")
    labels = _classes(described.select("node", "n", "sketches", "words"))
    rows = described.select("doc_id", "text_key", "node").join(labels, "node", "left").withColumn("own", F.coalesce("component", "node"))
    rows = materialize(rows.select("doc_id", "text_key", "own"), "near-rows")
    release(described)  # the largest table
    least = rows.where("own is not null").groupBy("own").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size")).where("size > 1")
    least = materialize(least.withColumnRenamed("own", "o"), "near-classes")
    return rows.join(least, F.col("own") == F.col("o"), "left").select("doc_id", "text_key", F.when(F.col("o").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept of each row of docs (doc_id, text): class_id is the least doc_id of the row's class.

    Classes are connected by equal word sequences and by links of a shingle alignment of 0.8 or more. Texts without a
    word (null, empty) are alone in their class. kept is true for the document that gives its class the id, and for rows
    without a doc_id whose class has none.
    """
    return _resolved(docs).select("doc_id", "class_id", F.col("class_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, most: int = SENT) -> DataFrame:
    """The rows of docs that near_duplicates keeps, one for each class: equal rows of one doc_id are made one too.

    The ids of up to `most` rows that go are sent to where the texts are.
    """
    rows = materialize(_resolved(docs.select("doc_id", "text")), "near-resolved")
    key = F.unhex(F.md5("text"))
    gone = materialize(rows.where(~F.col("class_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "near-gone")
    df = docs.join(_sent(gone, most), F.col("doc_id").eqNullSafe(F.col("gone_id")) & key.eqNullSafe(F.col("gone_key")), "left_anti")
    again = rows.where(F.col("class_id").eqNullSafe(F.col("doc_id")) & F.col("text_key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id", "text_key").count().where("count > 1")
    once = again.isEmpty()
    release(rows)
    return df if once else df.dropDuplicates(["doc_id", "text"])


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
