"""Quality rules: counts in each text, failures by host, shrunk host rates, and verdicts joined back. DataFrame only.

Counting is one narrow pass: windows of words are hashed, and only texts in which a hash comes twice sort their own
windows, so no window is ever shuffled. The counts (a few numbers a document) are written once; hosts are summed from
them with a map-side combine, and the verdicts, written too, are joined back as a broadcast if their size is under
spark.sql.autoBroadcastJoinThreshold, else by a sort-merge join whose hot hosts adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import materialize, table

SYMBOLS = "#*$%&|<>"

_REPEATED = """
  CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
    aggregate(
      transform(array(sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
        sort_array(transform(
          filter(s, (e, k) -> (k > 0 AND get(s, k - 1).x = e.x) OR (k + 1 < size(s) AND get(s, k + 1).x = e.x)),
          e -> e.i)))[0],
      struct(-3 AS last, 0L AS n), (acc, i) -> struct(i AS last, acc.n + least(3, i - acc.last) AS n), acc -> acc.n)
  END"""


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed for each row.

    Null and empty texts count 0 throughout, and so fail (fewer than 50 words). Windows are equal if their 64-bit
    hashes are: within one text of n words the odds of a false repeat are below n * n / 2**65. Other columns aren't read.
    """
    df = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t"))
    df = df.selectExpr(
        "doc_id", "source", "t",
        r"filter(split(t, '[\\x20\\x09-\\x0D]+'), x -> x <> '') AS w",
        r"filter(split(t, '\n'), x -> length(translate(x, ' \t\n\u000b\u000c\r', '')) > 0) AS l",
    )
    df = df.selectExpr(
        "doc_id", "source", "t", "size(w) AS n", "size(l) AS n_lines", "size(l) - size(array_distinct(l)) AS dup",
        "CASE WHEN size(w) < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))) END AS h",
    )
    df = df.selectExpr(
        "doc_id", "source", "cast(n AS bigint) AS n_words",
        r"cast(length(translate(t, ' \t\n\u000b\u000c\r', '')) AS bigint) AS word_chars",
        f"cast(length(t) - length(translate(t, '{SYMBOLS}', '')) AS bigint) AS n_symbols",
        "cast(dup AS bigint) AS n_dup_lines", f"{_REPEATED} AS n_repeat_words", "cast(n_lines AS bigint) AS n_lines",
    )
    return df.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def hosts(counted: DataFrame) -> DataFrame:
    """source, n, failed, by host; a null source is a host of its own.

    A document fails if it fails the base rules, is over a tenth symbols, or repeats over three tenths of its lines.
    """
    fails = F.expr("base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines")
    return counted.groupBy("source").agg(F.count("*").alias("n"), F.sum(fails.cast("long")).alias("failed"))


def host_verdicts(by_host: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """source, host_kept: false where the failure rate, shrunk to the hosts' own beta prior, is over max_rate.

    The prior is fitted by moments to all hosts' rates: mean m and variance v give m and 1 - m times m (1 - m) / v - 1,
    held within 1 and 1,000,000 pseudo-documents. So a host of few documents keeps near the common rate.
    """
    m, v = by_host.agg(F.avg(F.col("failed") / F.col("n")), F.var_pop(F.col("failed") / F.col("n"))).first()
    m = m or 0.0
    k = min(1e6, max(1.0, m * (1 - m) / v - 1)) if v else 1e6
    return by_host.select("source", ((F.col("failed") + F.lit(m * k)) / (F.col("n") + F.lit(k)) <= max_rate).alias("host_kept"))


def quality_rules(docs: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """One row for each row of docs: the counts, base_failed, kept and host_kept. Empty tables give empty results."""
    counted = materialize(counts(docs), "quality-counts")
    verdicts = materialize(host_verdicts(materialize(hosts(counted), "quality-hosts"), max_rate), "quality-verdicts")
    df = counted.join(verdicts.withColumnRenamed("source", "host"), F.col("source").eqNullSafe(F.col("host")))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "host_kept",
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, t FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
gg AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM gg WHERE c > 1) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
c AS (SELECT d.doc_id, d.source, len(w.w)::BIGINT AS n_words, length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l.l)::BIGINT AS n_lines
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, sum((base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines)::INT) AS failed FROM b GROUP BY source),
p AS (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v FROM h),
k AS (SELECT m, CASE WHEN v > 0 THEN least(1e6, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1e6 END AS k FROM p),
v AS (SELECT source, (failed + m * k) / (n + k) <= 0.5 AS host_kept FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept, host_kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
