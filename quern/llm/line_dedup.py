"""Line dedup: lines found on many distinct sites are boilerplate and leave every text. DataFrame only.

Each line's md5 gets a HyperLogLog sketch of the sites it is on, merged by aggregation; lines whose estimate is near the
threshold are counted exactly. Copies of one text say nothing of its lines, so a text counts once, on the smallest of its
sites. Sketches bound the state of a line that a third of all rows hold, and partial aggregation merges them before the
shuffle. Texts themselves aren't exploded into the shuffle: only (line, site) pairs are, and what is joined back is a
list of line numbers for each text that has boilerplate, broadcast only if it is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import materialize, release, table

MIN_SITES, LG_K = 5, 12


def _lines(docs: DataFrame) -> DataFrame:
    """text_key, site, pos, line of every line with a word in it."""
    df = docs.where("text is not null").selectExpr("source AS site", "unhex(md5(text)) AS text_key", r"split(text, '\n') AS l")
    df = df.selectExpr("site", "text_key", r"filter(transform(l, (x, i) -> struct(i AS pos, CASE WHEN length(translate(x, ' \t\n\u000b\u000c\r', '')) > 0 THEN unhex(md5(x)) END AS line)), x -> x.line IS NOT NULL) AS l")
    return df.selectExpr("text_key", "site", "explode(l) AS x").selectExpr("text_key", "site", "x.pos AS pos", "x.line AS line")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """The md5 (line) of each line on min_sites distinct sites at least, counting each text on its smallest site alone.

    Null sites count as no site. Sketches of 2 ** lg_k registers err by 1.04 / 2 ** (lg_k / 2) in the mean: an estimate
    within four times that (and one) of the threshold is near, and is replaced by the exact count.
    """
    band = 4 * 1.04 / 2 ** (lg_k / 2)
    texts = lines.groupBy("text_key", "line").agg(F.min("site").alias("site"))
    found = texts.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites")).where(F.col("sites") >= min_sites * (1 - band) - 1)
    found = materialize(found, "line-spread")
    near = F.col("sites") < min_sites * (1 + band) + 1
    exact = texts.join(found.where(near).select("line"), "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("s")).where(F.col("s") >= min_sites)
    return found.where(~near).select("line").unionByName(exact.select("line"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, counts: bool = True) -> DataFrame:
    """docs with boilerplate lines gone from text, plus (with counts) n_lines and n_removed (long).

    Lines are what lies between newlines; blank lines stay and are never boilerplate. Null texts stay null (0 lines).
    Repeated rows are treated alike, and count as one. A text all of whose lines go becomes empty. Columns of docs may
    have any names; with counts, one named n_lines or n_removed is replaced.
    """
    kept = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    lines = materialize(_lines(docs.select("source", "text")), "lines")
    flagged = materialize(boilerplate(lines, min_sites), "line-flags")
    gone = lines.join(flagged, "line", "left_semi").groupBy("text_key").agg(F.collect_set("pos").alias("gone"))
    gone = materialize(gone, "line-gone").alias("g")
    release(lines, flagged)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("text").alias("t"), F.unhex(F.md5("text")).alias("key")).alias("d")
    df = df.join(gone, F.col("d.key") == F.col("g.text_key"), "left").select("row", "t", "gone")
    left = F.expr(r"array_join(filter(split(t, '\n'), (x, i) -> NOT array_contains(gone, i)), '\n')")
    columns = [F.when(F.col("gone").isNull(), F.col("t")).otherwise(left).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in kept]
    if counts:
        columns.append(F.coalesce(F.when(F.col("t").isNotNull(), F.size(F.split("t", "\n"))), F.lit(0)).cast("long").alias("n_lines"))
        columns.append(F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    return df.select(*columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


#: Lines of a text, and the lines that go: shared by the query's SQL and the pipeline's. {docs} has doc_id, text, source.
ORACLE_PARTS = r"""
ld_d AS (SELECT row_number() OVER () AS r, * FROM {docs}),
ld_l AS (SELECT r, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM ld_d),
ld_k AS (SELECT md5(d.text) AS k, source, md5(x) AS line FROM ld_l JOIN ld_d d USING (r) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
ld_t AS (SELECT line, k, min(source) AS site FROM ld_k GROUP BY line, k),
ld_b AS (SELECT line FROM ld_t GROUP BY line HAVING count(DISTINCT site) >= 5),
ld_g AS (SELECT r, string_agg(x, chr(10) ORDER BY i) AS text, count(*) AS n FROM ld_l
  WHERE NOT regexp_matches(x, '[^\x20\x09-\x0D]') OR md5(x) NOT IN (SELECT line FROM ld_b) GROUP BY r),
ld AS (SELECT ld_d.* REPLACE (CASE WHEN ld_d.text IS NULL THEN NULL ELSE coalesce(ld_g.text, '') END AS text),
  coalesce(len(string_split(ld_d.text, chr(10))), 0)::BIGINT AS n_lines,
  (coalesce(len(string_split(ld_d.text, chr(10))), 0) - coalesce(ld_g.n, 0))::BIGINT AS n_removed FROM ld_d LEFT JOIN ld_g USING (r))
"""
ORACLE = "WITH " + ORACLE_PARTS.format(docs="documents") + " SELECT doc_id, n_lines, n_removed, text FROM ld"
