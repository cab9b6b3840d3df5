"""Packing along a space-filling curve: documents of like content are neighbours, and share sequences.

A document's token ids are hashed into a vector, projected to a few dimensions and given a Hilbert key; documents are
range-sorted by it, laid end to end and cut every max_tokens. Each text is tokenised once: its ids (two bytes each) are
written to the shared folder, so that a lost executor doesn't tokenise again. Ranges are stretches of the curve of an
equal number of tokens, whatever the table's size, told from a count by cells of the curve (65,536 at most); a cell of
more tokens, as a third of all rows being copies of one text makes it, is dealt to several ranges by a hash of document
and ids. Ranges depend on the documents alone, so reruns cut alike; a task holds one sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import lean, materialize, slices, table

#: Ids of a range (two bytes each); bits of a cell of the curve.
RANGE_TOKENS, CELL_BITS = 8_000_000, 16
HASHED, DIMS, BITS, END = 256, 4, 8, 1
_TOKENIZERS: dict[str, object] = {}


def tokenizer(ranks: str | None = None):
    """Text to ids, as byte_bpe_50k.json gives them: the same vocabulary and pattern by a faster library.

    ranks: the .tiktoken file; by default public_tokenizers.path("byte_bpe_50k.tiktoken").
    """
    import base64

    import public_tokenizers
    import tiktoken

    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _TOKENIZERS:
        with open(path, "rb") as lines:
            table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={"<|endoftext|>": 50256})
        _TOKENIZERS[path] = lambda text: own.encode(text, allowed_special="all")
    return _TOKENIZERS[path]


def hilbert(at: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys along the Hilbert curve of points (n, d) of integers below 2 ** bits, d * bits <= 62."""
    x = at.astype(np.int64).T.copy()
    d, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo the turns of each level
        p = q - 1
        for i in range(d):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curve:
    """The projection of hashed token vectors, of a fixed seed; not learned, so that a document's key is its own."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.bucket = rng.integers(0, HASHED, 1 << 16)
        self.project = rng.normal(size=(HASHED, DIMS))

    def point(self, ids: np.ndarray) -> np.ndarray:
        vector = np.bincount(self.bucket[ids], minlength=HASHED)
        return 1 / (1 + np.exp(-4 * (vector @ self.project) / np.sqrt((vector * vector).sum()))) * (1 << BITS)


def tokenized(docs: DataFrame, ranks: str | None = None, seed: int = 0) -> DataFrame:
    """doc_id, key, tokens (with the end id), ids (unsigned 16-bit, little-endian) of each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, curve = tokenizer(ranks), Curve(seed)
        for part in slices(batches, 1):
            ids = [np.array([*encode(t or ""), END], dtype="<u2") for t in part.column(1).to_pylist()]
            at = np.minimum(np.array([curve.point(x) for x in ids]).astype(np.int64), (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hilbert(at)), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "key", "tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(each), "doc_id long, key long, tokens long, ids binary")


class _Sequences:
    """Fills sequences with pieces and hands them out as they are full."""

    def __init__(self, size: int, first: int):
        self.size, self.id, self.used = size, first, 0
        self.open: list[tuple] = []
        self.done: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            take = min(len(ids) - start, self.size - self.used)
            self.open.append((doc_id, start, ids[start : start + take], len(ids)))
            self.used += take
            start += take
            if self.used == self.size:
                self._close()

    def _close(self) -> None:
        offset = 0
        for doc_id, start, ids, tokens in self.open:
            self.done.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), tokens, self.id, offset))
            offset += len(ids)
        self.open, self.used = [], 0
        self.id += 1

    def finish(self) -> None:
        """The rest, as sequences of powers of two, which need no padding."""
        rest, self.open, left = self.open, [], self.used
        self.used = 0
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            while want:
                doc_id, start, ids, tokens = rest.pop(0)
                take = min(want, len(ids))
                self.open.append((doc_id, start, ids[:take], tokens))
                if take < len(ids):
                    rest.insert(0, (doc_id, start + take, ids[take:], tokens))
                want -= take
            self._close()

    def take(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def _ranged(tokens: DataFrame, range_tokens: int) -> DataFrame:
    """range, doc_id, ids: each document's range along the curve, in a partition of its own and in order."""
    cell = F.shiftright("key", DIMS * BITS - CELL_BITS)
    cells = tokens.groupBy(cell.alias("cell")).agg(F.sum("tokens").alias("tokens")).orderBy("cell").toPandas()  # 2 ** CELL_BITS rows at most
    rows, done, last = [], 0, 0
    for c, n in zip(cells["cell"].tolist(), cells["tokens"].tolist(), strict=True):
        first, done = done // range_tokens, done + n
        last = max(first, (done - 1) // range_tokens)
        rows.append((c, first, last - first + 1))
    dealt = F.broadcast(tokens.sparkSession.createDataFrame(rows, "cell long, first int, parts int"))
    part = F.col("first") + F.pmod(F.xxhash64("doc_id", "ids"), F.col("parts")).cast("int")
    df = tokens.withColumn("cell", cell).join(dealt, "cell").select(part.alias("range"), "key", "doc_id", "ids")
    return df.repartitionById(last + 1, "range").sortWithinPartitions("range", "key", "doc_id", F.crc32("ids"), "ids").select("range", "doc_id", "ids")


def pack(docs: DataFrame, max_tokens: int = 2048, ranks: str | None = None, seed: int = 0, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """Pieces: doc_id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset.

    docs has doc_id and text, and other columns aren't read; null texts are empty and have the end id alone, and repeated
    rows are packed each. Ties on the curve go by doc_id, then by ids. Sequences are full but for the last of each range
    (range_tokens ids), which is cut into powers of two, so nothing is padded. sequence_id names the range in its upper
    bits. An empty table has no sequence.
    """
    tokens = materialize(tokenized(docs, ranks, seed), "packing-tokens")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = None, None
        for batch in batches:
            for own, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if own != now:
                    if out:
                        out.finish()
                        yield out.take()
                    out, now = _Sequences(max_tokens, own << 40), own
                out.add(doc_id, np.frombuffer(ids.as_buffer(), dtype="<u2"))
                if len(out.done) >= 2000:
                    yield out.take()
        if out:
            out.finish()
            yield out.take()

    return _ranged(tokens, range_tokens).mapInArrow(lean(cut), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
