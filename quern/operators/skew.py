"""What is uneven about keys."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, key: str, parts: int, share: float = 0.8) -> DataFrame:
    """key, cnt of the keys of which one part of `parts` would hold too many: cnt * parts > share * all rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("cnt"))
    total = df.count()
    return counts.where(F.col("cnt") * F.lit(parts) > F.lit(share * total)).select(key, "cnt")


def scan_split_keys(df: DataFrame, key: str, parts: int, fn: Callable[[object, int], None], share: float = 0.8) -> int:
    """fn(key, count) on the driver for each heavy key; returns how many there are. There are fewer than parts / share."""
    found = heavy_keys(df, key, parts, share).collect()
    for k, n in found:
        fn(k, n)
    return len(found)


def skew_report(df: DataFrame, part: Column, factor: float = 1.5, least: int = 1024) -> DataFrame:
    """min_cnt, max_cnt, imbalanced over the parts: over `factor` times the smallest, unless the largest is below `least`."""
    by = df.groupBy(part.alias("part")).agg(F.count("*").alias("cnt"))
    return by.agg(F.min("cnt").alias("min_cnt"), F.max("cnt").alias("max_cnt")).select(
        "min_cnt", "max_cnt", ((F.col("max_cnt") >= least) & (F.col("max_cnt") > factor * F.col("min_cnt"))).alias("imbalanced"))


def block_of(index: Column, n: int, parts: int) -> Column:
    """The part of an index in [0, n) when parts get n // parts each, and the first n % parts of them one more."""
    each, extra = divmod(n, parts)
    edge = (each + 1) * extra
    rest = F.lit(extra) + F.floor((index - edge) / F.lit(max(each, 1)))
    return F.when(index < edge, F.floor(index / F.lit(each + 1))).otherwise(rest).cast("int")


def dealt_by(df: DataFrame, part: Column, parts: int) -> DataFrame:
    """df with each row in the partition that part (mod parts) names; it holds until the next shuffle."""
    return df.repartitionById(parts, F.pmod(part, F.lit(parts)).cast("int"))


def bin_of(key: Column, bins: int) -> Column:
    """The virtual bin of a key: many more than parts, so that load can be moved between parts bin by bin."""
    return F.pmod(F.xxhash64(key), F.lit(bins)).cast("int")


def redirected(loads: Mapping[int, int], parts: int, within: float = 0.01) -> dict[int, int]:
    """The part of each bin (bin: rows). Bins start at bin mod parts; the smallest that helps go from the fullest part to
    the emptiest, until none is more than `within` above the mean or no bin fits."""
    of = {b: b % parts for b in loads}
    own: list[list[int]] = [sorted((b for b in loads if b % parts == p), key=lambda b: (loads[b], b)) for p in range(parts)]
    total = [sum(loads[b] for b in x) for x in own]
    most = (1 + within) * sum(total) / parts
    while max(total) > most:
        full, empty = total.index(max(total)), total.index(min(total))
        spare = (total[full] - total[empty]) / 2
        at = bisect_right(own[full], spare, key=loads.__getitem__) - 1  # the largest that doesn't turn the two about
        if at < 0 or loads[own[full][at]] == 0:
            break
        b = own[full].pop(at)
        insort(own[empty], b, key=loads.__getitem__)
        total[full] -= loads[b]
        total[empty] += loads[b]
        of[b] = empty
    return of


def balanced(df: DataFrame, key: str, parts: int, per_part: int = 1000) -> DataFrame:
    """df dealt by key to parts of about equal size: rows are counted by virtual bin (parts * per_part counts come to the
    driver), and bins redirected before anything is moved. A key stays whole; keys too heavy for a part need split()."""
    bin_ = bin_of(F.col(f"`{key}`"), parts * per_part)
    loads = {r.b: r.n for r in df.groupBy(bin_.alias("b")).agg(F.count("*").alias("n")).collect()}
    to = F.broadcast(df.sparkSession.createDataFrame(list(redirected(loads, parts).items()), "quern_bin int, quern_part int"))
    return df.withColumn("quern_bin", bin_).join(to, "quern_bin").repartitionById(parts, "quern_part").drop("quern_bin", "quern_part")
