"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import language_id, line_dedup, mixing, near_dedup, neighbours, packing, quality_classifier, quality_rules, toxicity, url_filters

LONG = "word " * 200_000
TEXTS = [None, "", " \n\t ", "one two three four five six", "one two three four five six", "ééé ÄÖ 中文 \x00 tab\there", "!!! ???", LONG, "a\n\nb\na"]
#: Names that the operators use inside or return.
CLASHES = "score key node n s shard size words held_out n_lines gone mix_key tokens line component lang_pred".split()


def documents(spark, empty=False):
    rows = [] if empty else [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, len(t or ""), *["x"] * len(CLASHES)) for i, t in enumerate(TEXTS)]
    if not empty:
        rows += [rows[3], (None, None, None, None, None, *[None] * len(CLASHES)), (None, "one two three four five seven", "en", "s1", None, *[None] * len(CLASHES))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(3)


def labels(spark, column, empty=False):
    return spark.createDataFrame([] if empty else [(1, 0), (3, 1), (3, 1), (5, 1), (5, 0), (None, 1), (7, None), (8, 0), (8, 0)], f"doc_id long, {column} int")


OPS = {
    "quality": lambda s, d, e: quality_classifier.quality(d, labels(s, "quality", e)),
    "language": lambda s, d, e: language_id.language_id(d),
    "lines": lambda s, d, e: line_dedup.line_dedup(d),
    "near": lambda s, d, e: near_dedup.near_duplicates(d),
    "rules": lambda s, d, e: quality_rules.quality_rules(d),
    "toxicity": lambda s, d, e: toxicity.toxicity(d, labels(s, "toxic", e)),
    "mix": lambda s, d, e: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPS)
def test_one_row_for_each_row(spark, name):
    docs = documents(spark)
    got = OPS[name](spark, docs, False)
    rows = got.collect()
    assert len(rows) == len(TEXTS) + 3
    assert len(got.columns) == len(set(got.columns))
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in rows) == sorted([-1, -1, 3, *range(len(TEXTS))])
    if "score" in got.columns and name != "lines":
        assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, name):
    assert OPS[name](spark, documents(spark, True), True).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, stage, empty):
    docs = documents(spark, empty)
    got = stage(spark, docs, "")
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    rows = got.collect()
    assert bool(rows) is not empty


def test_no_labels_teach_nothing(spark):
    docs = documents(spark)
    assert {r.score for r in quality_classifier.quality(docs, labels(spark, "quality", True)).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity(docs, labels(spark, "toxic", True)).collect()} == {0.5}
    unknown = language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}
    assert language_id.accepted(docs.withColumn("lang", F.lit(None).cast("string"))).count() == language_id.accepted(docs).count() > 0


def test_und(spark):
    got = {r.doc_id: r for r in language_id.language_id(documents(spark)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 6))
    assert got[3].lang_pred == "en"
    signs = spark.createDataFrame([(1, "² ½ ³", None), (2, "Ⅷ Ⅸ", None), (3, "٣ _ 4", None), (4, "² x", None), (5, "one two three", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language_id.language_id(signs.union(signs)).collect()} == {1: "und", 2: "und", 3: "und", 4: "en", 5: "en"}


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (None, "http://A.com/x"), (5, "http://A.com/x"), (5, "http://A.com/x"), (6, "http://x/" + "y" * 100_000)]
    got = url_filters.judge(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, host string"), [0.0] * 65).collect()
    assert len(got) == len(rows)
    assert all(r.host == "" and r.path == "" and r.rule is None for r in got if r.page_id in (1, 2, 3))
    assert {(r.host, r.path, r.rule, r.verdict) for r in got if r.page_id == 5} == {("a.com", "/x", "com/", "allow")}
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string"), [0.0] * 65).count() == 0
    assert url_filters.train(spark, spark.createDataFrame([], "url string, label int"), dims=8) == [0.0] * 9


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, id string")
    got = neighbours.nearest(df, lambda i: i % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, 0.0)]
    assert neighbours.nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0
    assert neighbours.nearest(df.where("vec_id > 0"), lambda i: i % 50 == 0).count() == 0


def test_packing_of_nulls(spark):
    got = packing.pack(documents(spark)).where("length > 0").groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"), F.countDistinct("start").alias("k")).collect()
    at = {r.doc_id: r for r in got}
    assert at[0].n == at[1].n == 1 and at[7].n == at[7].t > 200_000
    assert packing.pack(documents(spark, True)).count() == 0
