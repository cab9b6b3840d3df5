"""Key/value jobs with opaque callbacks, for what column expressions can't say."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators.aggregates import combine
from quern.operators.joins import union_all
from quern.sources.binary import read_binary, write_binary
from quern.sources.text import read_lines, write_text

Rows = Iterable[tuple]


_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _batches(rows: Iterator[tuple], names: list[str], size: int = 10_000, whole: tuple[str, ...] = ()) -> Iterator[pd.DataFrame]:
    """Frames of rows; nulls in the columns of whole leave other rows' integers exact."""
    held: list[tuple] = []

    def frame() -> pd.DataFrame:
        pdf = pd.DataFrame(held, columns=names)
        rounded = [c for c in whole if pdf[c].dtype.kind == "f"]
        return pdf.assign(**{c: pd.Series([r[names.index(c)] for r in held], dtype=object) for c in rounded})

    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield frame()
            held = []
    if held:
        yield frame()


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(",")]


def _whole(schema: str) -> tuple[str, ...]:
    """The integer columns of a schema."""
    kinds = {f.split()[0]: f.split()[1].lower() for f in schema.split(",") if len(f.split()) > 1}
    return tuple(c for c, kind in kinds.items() if kind in (*_INTEGERS, "byte", "short", "integer", "long"))


class Database(Protocol):
    """Where a user keeps records."""

    def put(self, record: tuple) -> None: ...

    def close(self) -> None: ...


@dataclass(frozen=True)
class KVDataset:
    """An immutable set of records; each step gives another. keys names the columns that records are grouped by."""

    df: DataFrame
    keys: tuple[str, ...] = ()
    pending: tuple[DataFrame, ...] = field(default=())

    @staticmethod
    def from_files(spark: SparkSession, *paths: str) -> KVDataset:
        return KVDataset(read_lines(spark, paths))

    @staticmethod
    def generate(spark: SparkSession, fn: Callable[[int], Rows], schema: str, parts: int, keys: tuple[str, ...] = ()) -> KVDataset:
        """Records of fn(part), called once for each of parts without input."""
        names = _names(schema)

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part in pdf["id"]:
                    yield from _batches(iter(fn(int(part))), names)

        return KVDataset(spark.range(0, parts, 1, parts).mapInPandas(each, schema), keys)

    def including(self, *others: KVDataset) -> KVDataset:
        """With the records of others as input of the next map alone."""
        return KVDataset(self.df, self.keys, tuple(o.df for o in others))

    def map(self, fn: Callable[[Iterator[tuple]], Rows], schema: str, keys: tuple[str, ...] = (), shuffle: bool = True, partitioner: Column | None = None, parts: int | None = None) -> KVDataset:
        """Records of fn over each partition's records. With shuffle, dealt by key, or by partitioner into parts."""
        names = _names(schema)
        source = union_all(self.df, *self.pending) if self.pending else self.df

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from _batches(iter(fn(r for pdf in batches for r in pdf.itertuples(index=False, name=None))), names)

        df = source.mapInPandas(each, schema)
        if partitioner is not None:
            n = parts or df.sparkSession.sparkContext.defaultParallelism
            df = df.repartitionById(n, F.pmod(partitioner, F.lit(n)).cast("int"))
        elif shuffle and keys:
            df = df.repartition(parts, *keys) if parts else df.repartition(*keys)
        return KVDataset(df, keys)

    def combine(self, fn: Callable[[tuple, tuple], tuple]) -> KVDataset:
        """One record for each key: values merged by fn, which must be associative and commutative.

        Each partition merges what it can hold (a million keys at a time) before the shuffle; then records come sorted
        by key and are merged as they pass, so that no key's values are ever held together.
        """
        keys, schema = list(self.keys), self.df.schema
        values = [c for c in self.df.columns if c not in keys]
        names = keys + values
        k = len(keys)

        def before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple, tuple] = {}
            for pdf in batches:
                for r in pdf[names].itertuples(index=False, name=None):
                    held[r[:k]] = fn(held[r[:k]], r[k:]) if r[:k] in held else r[k:]
                if len(held) > 1_000_000:
                    yield from _batches((a + b for a, b in held.items()), names)
                    held = {}
            yield from _batches((a + b for a, b in held.items()), names)

        def after(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def merged() -> Iterator[tuple]:
                at: tuple | None = None
                for pdf in batches:
                    for r in pdf[names].itertuples(index=False, name=None):
                        if at is not None and at[:k] == r[:k]:
                            at = at[:k] + fn(at[k:], r[k:])
                        else:
                            if at is not None:
                                yield at
                            at = r
                if at is not None:
                    yield at

            yield from _batches(merged(), names)

        ordered = self.df.select(*names).schema
        df = self.df.mapInPandas(before, ordered).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(after, ordered)
        return KVDataset(df.select(*schema.names), self.keys)

    def reduce(self, fn: Callable[[tuple, list[tuple]], Rows], schema: str, keys: tuple[str, ...] = ()) -> KVDataset:
        """Records of fn(key, values) for each key; values can be passed over as often as wanted.

        A key's values are held in one task for that: for keys of unbounded size use column aggregates, or combine.
        Rows come to Python sorted by key, many keys in a batch, with each key's first row marked in the JVM. A null
        number is NaN, and a key's integers are floats beside it, as in pandas.
        """
        own, names = list(self.keys), _names(schema)
        values = [c for c in self.df.columns if c not in own]
        kinds = dict(self.df.dtypes)
        whole = {c for c, kind in kinds.items() if kind in _INTEGERS}
        numbers = [j for j, c in enumerate(values) if c in whole]

        def tuples(pdf: pd.DataFrame, columns: list[str]) -> list[tuple]:
            """Rows of columns; null integers are None, so that those of other keys stay exact."""
            null = {c: pdf[f"quern_null_{c}"] for c in columns if c in whole}
            pdf = pdf[columns].assign(**{c: pdf[c].astype(object).mask(n, None) for c, n in null.items() if n.any()})
            return list(pdf.itertuples(index=False, name=None))

        def given(held: list[tuple]) -> list[tuple]:
            floats = {j for j in numbers if any(r[j] is None for r in held)}
            if not floats:
                return held
            return [tuple((float("nan") if v is None else float(v)) if j in floats else v for j, v in enumerate(r)) for r in held]

        def records(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
            key: tuple | None = None
            held: list[tuple] = []
            for pdf in batches:
                rows = tuples(pdf, values)
                starts = pdf["quern_first"].to_numpy().nonzero()[0].tolist()
                heads = tuples(pdf.iloc[starts], own) if own else [()] * len(starts)
                held += rows[: starts[0] if starts else len(rows)]
                for head, a, b in zip(heads, starts, [*starts[1:], len(rows)]):
                    if key is not None:
                        yield from fn(key, given(held))
                    key, held = tuple(float("nan") if v is None and c in whole else v for c, v in zip(own, head)), rows[a:b]
            if key is not None:
                yield from fn(key, given(held))

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from _batches(records(batches), names, whole=_whole(schema))

        columns = {c: F.col(f"`{c}`") for c in own + values}
        by = [columns[c] for c in own]
        sent = [F.coalesce(x, F.lit(0).cast(kinds[c])).alias(c) if c in whole else x for c, x in columns.items()]
        null = [columns[c].isNull().alias(f"quern_null_{c}") for c in whole]
        first = (F.row_number().over(Window.partitionBy(*by).orderBy(*(by or [F.lit(0)]))) == 1).alias("quern_first")
        return KVDataset(self.df.select(*columns.values(), first).select(*sent, *null, "quern_first").mapInPandas(each, schema), keys)

    def union(self, *others: KVDataset) -> KVDataset:
        return KVDataset(union_all(self.df, *(o.df for o in others)), self.keys)

    def combine_columns(self, **values: Column) -> KVDataset:
        """combine where column aggregates can say it: partial before the shuffle, and all in the JVM."""
        return KVDataset(combine(self.df, list(self.keys), **values), self.keys)

    def scan(self, fn: Callable[[tuple], None]) -> None:
        """fn for each record, where it lies; the set stays as it is."""
        self.df.foreachPartition(lambda rows: [fn(tuple(r)) for r in rows] and None)

    def count(self) -> int:
        return self.df.count()

    def into(self, open_database: Callable[[int], Database]) -> None:
        """All records into a database of the user's: opened for each partition where it lies, given record by record,
        and closed, also after an error. A task may run again, so put should overwrite or the partition be replaced."""

        def each(rows: Iterator[tuple]) -> None:
            database = open_database(TaskContext.get().partitionId())
            try:
                for r in rows:
                    database.put(tuple(r))
            finally:
                database.close()

        self.df.foreachPartition(each)

    def output(self, path: str, form: str = "text") -> None:
        """Records as lines of text, as raw binary records, or in any of Spark's forms."""
        if form == "text":
            write_text(self.df, path)
        elif form == "binary":
            write_binary(self.df, path)
        else:
            self.df.write.format(form).save(path)

    def scan_output(self, path: str, fn: Callable[[tuple], None], form: str = "text") -> None:
        """fn for each record of what output has written: (line,) of text, records of this set's columns of other forms."""
        spark = self.df.sparkSession
        if form == "text":
            KVDataset(read_lines(spark, path)).scan(fn)
        elif form == "binary":
            KVDataset(read_binary(spark, path, ", ".join(f"{n} {t}" for n, t in self.df.dtypes))).scan(fn)
        else:
            KVDataset(spark.read.format(form).schema(self.df.schema).load(path)).scan(fn)

    def __enter__(self) -> KVDataset:
        """Keeps the records, in memory or on executors' disks, until the block ends."""
        return KVDataset(self.df.persist(), self.keys, self.pending)

    def __exit__(self, *error: object) -> None:
        self.df.unpersist()
