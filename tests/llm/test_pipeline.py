"""The pipeline: every stage against brute force on its own input, and the whole run."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from millrace.llm import decontamination, mixing, quality
from millrace.llm.frames import prepared, written
from millrace.sources.tables import Tables
from tests.llm.odd import TEXTS, no_docs, odd_docs
from tests.llm.test_encoding_and_files import collected, expected
from tests.llm.test_encoding_and_files import whole  # noqa: F401
from tests.llm.test_mixing import naive_size
from tests.llm.test_simhash import naive

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = Tables(prepared(spark), SF_DIR).documents
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF_DIR), "stage"))
    return out


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_the_stages_keep_the_columns(outputs):
    assert [n for n, _ in pipeline.STAGES][0] == "quality classifier" and len(pipeline.STAGES) == 5
    for df in outputs[1:-1]:
        assert df.dtypes == outputs[0].dtypes


def test_quality_keeps_what_the_classifier_accepts(spark, outputs):
    scores = quality.score(outputs[0], Tables(spark, SF_DIR).labels).filter("predicted = 1")
    assert rows(outputs[1]) == rows(outputs[0].join(scores, "doc_id"))
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    good = outputs[0].join(labels.filter("quality = 1"), "doc_id")
    assert good.join(outputs[1].select("doc_id"), "doc_id").count() >= 0.97 * good.count()


def test_one_document_of_each_group_stays(outputs):
    before = rows(outputs[1])
    want = {c for _, _, c in naive(before)}
    assert [d for d, _ in rows(outputs[2])] == sorted(want)


def test_copies_of_items_go(spark, outputs):
    items = pq.read_table(f"{SF_DIR}/benchmark.parquet").to_pylist()
    from tests.llm.test_decontamination import words

    number = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in words(t)], np.int64)
    coded_items = [coded(i["text"]) for i in items]
    want = [
        (d, t) for d, t in rows(outputs[2])
        if not any(decontamination.align(coded(t), i)[0] >= decontamination.THRESHOLD * 2 * len(i) for i in coded_items)
    ]
    assert rows(outputs[3]) == want


def test_documents_are_repeated_as_the_mix_says(outputs):
    source = {r["doc_id"]: r["source"] for r in outputs[3].collect()}
    before, after = rows(outputs[3]), rows(outputs[4])
    sizes, taken = {}, {}
    for d, t in before:
        sizes[source[d]] = sizes.get(source[d], 0) + naive_size(t)
        assert after.count((d, t)) <= 2
    for d, t in after:
        taken[source[d]] = taken.get(source[d], 0) + naive_size(t)
    target = mixing.capped_targets(sizes)
    for s in sizes:
        longest = max(naive_size(t) for d, t in before if source[d] == s)
        assert abs(taken.get(s, 0) - target[s]) <= longest / 2 + 1


def test_tokens_of_what_is_left(outputs, whole):  # noqa: F811
    assert collected(outputs[5]) == expected(whole, rows(outputs[4]))


def test_the_query_gives_the_stages_rows(spark, outputs):
    assert collected(contract.queries()["pipeline"](spark, SF_DIR)) == collected(outputs[5])


def test_odd_documents_pass_through(spark):
    prepared(spark)
    odd = odd_docs(spark)
    for _, stage in pipeline.STAGES[:-1]:
        after = written(stage(spark, odd, SF_DIR), "odd")
        assert after.columns == odd.columns
        assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in odd.collect()}
    kept = pipeline.simhash_near_dedup(spark, odd, SF_DIR).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(3) == 2 and 13 not in ids and ids.count(None) == 1  # another text under an id is another document
    assert {r["text"] for r in kept if r["doc_id"] == 3} == {TEXTS[0][1], "another text under the same id"}
    assert ids.count(7) == 1 and 8 not in ids and 9 not in ids  # null, empty and blank texts are one group, ids first
    assert {3, 13} & {r["doc_id"] for r in pipeline.benchmark_decontamination(spark, odd, SF_DIR).collect()} == {3, 13}


def test_repeated_ids_are_mixed_row_by_row(spark):
    prepared(spark)
    docs = odd_docs(spark).filter("doc_id = 3").withColumn("source", F.lit("s"))
    out = pipeline.source_mixing(spark, docs, SF_DIR)
    total = docs.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(sum(naive_size(t) for _, t in rows(out)) - 1.5 * total) <= 7


def test_nothing_passes_through(spark):
    prepared(spark)
    docs = no_docs(spark)
    for name, stage in pipeline.STAGES:
        after = stage(spark, docs, SF_DIR)
        assert after.count() == 0


def test_benchmark_copies_go_by_row(spark):
    prepared(spark)
    item = Tables(spark, SF_DIR).benchmark.first()["text"]
    docs = spark.createDataFrame([(1, item), (1, "clean text under the same id"), (None, item), (None, "clean text without an id"), (2, None)], "doc_id bigint, text string")
    kept = pipeline.benchmark_decontamination(spark, docs, SF_DIR).collect()
    assert {(r["doc_id"], r["text"]) for r in kept} == {(1, "clean text under the same id"), (None, "clean text without an id"), (2, None)}


A, B, C, D = (" ".join(f"{w}{k}" for k in range(60)) for w in ("alpha", "beta", "gamma", "delta"))


def test_near_duplicates_go_by_row(spark):
    prepared(spark)
    docs = spark.createDataFrame(
        [(1, A, "x"), (1, B, "x"), (2, C, "x"), (0, A, "x"), (None, D, "x"), (None, D, "x"), (None, D, "y"), (None, C, "x")], "doc_id bigint, text string, lang string"
    )
    kept = [tuple(r) for r in pipeline.simhash_near_dedup(spark, docs, SF_DIR).collect()]
    assert sorted(kept, key=str) == sorted([(0, A, "x"), (1, B, "x"), (2, C, "x"), (None, D, "x")], key=str)


def test_a_third_without_ids_and_a_third_alike(spark):
    """No task has all rows of an id: the stages that deal rows out by range or hash have more than one with rows."""
    prepared(spark)
    text = "concat('word', id % 97, ' of ', id, ' in ', id * 7 % 1009)"
    docs = spark.range(3000).selectExpr("CASE WHEN id >= 1000 AND id < 2000 THEN 7 WHEN id >= 2000 THEN id END AS doc_id",
        f"CASE WHEN id >= 1000 AND id < 2000 THEN 'one text of six words here' ELSE {text} END AS text", "'en' AS lang", "'s' AS source", "id AS n_chars")
    mixed = pipeline.source_mixing(spark, docs, SF_DIR)
    total = docs.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(mixed.agg(F.sum(F.size(F.split("text", " ")))).first()[0] - 1.5 * total) <= 6
    copies = mixed.groupBy("n_chars").count().agg(F.max("count"), F.count("*")).first()
    assert copies[0] == 2
    kept = pipeline.simhash_near_dedup(spark, docs, SF_DIR)
    assert kept.filter("doc_id = 7").count() == 1


def test_mixing_decides_like_the_operator(spark, outputs):
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(outputs[3], F.array("source")).collect()}
    found = {r["doc_id"]: r["count"] for r in outputs[4].groupBy("doc_id").count().collect()}
    assert found == {d: c for d, c in taken.items() if c}
