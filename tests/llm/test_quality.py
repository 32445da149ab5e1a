"""The quality classifier (operator 4): held-out accuracy, calibration, and what it may learn from."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from millrace.llm import quality
from millrace.llm.frames import prepared
from tests.llm.odd import TEXTS, no_docs, odd_docs

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    found = contract.queries()["op4_quality"](spark, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", F.col("quality").alias("truth"))
    return found.join(labels, "doc_id", "left").toPandas()


def test_every_document_is_scored(spark, scored):
    assert len(scored) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert scored.score.between(0, 1).all()
    assert (scored.predicted == (scored.score >= 0.3)).all()
    assert (scored.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in scored.doc_id]).all()


def test_held_out_documents_are_told_apart(scored):
    rows = scored[scored.held_out & scored.truth.notna()]
    good, bad = (rows.score[rows.truth == t].to_numpy() for t in (1, 0))
    wins = (good[:, None] > bad[None, :]).mean()
    assert wins > 0.97
    assert (rows.predicted == rows.truth).mean() > 0.95
    assert rows.predicted[rows.truth == 1].mean() > 0.98


def test_labels_held_out_change_nothing(spark, scored):
    prepared(spark)
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{n}.parquet") for n in ("documents", "labels"))
    hidden = quality.held_out(F.col("doc_id"))
    flipped = labels.withColumn("quality", F.when(hidden, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.score(docs.withColumn("lang", F.lit("x")), flipped).toPandas().set_index("doc_id").score
    assert np.allclose(again.loc[scored.doc_id].to_numpy(), scored.score.to_numpy(), atol=1e-9)


def test_units():
    import pyarrow as pa

    (got,) = quality.units(pa.array(["The the OWL!! it it", None, "", "éa EA"]))
    first, counts, bucket = got
    assert first == 0 and counts.tolist() == [6, 0, 0, 2]
    assert bucket[1] == 5 and bucket[2] == 3 and bucket[5] == 5  # repeated, capitals, repeated
    assert bucket[7] == 3


def test_temperature_makes_outputs_probabilities():
    rng = np.random.default_rng(0)
    p = rng.uniform(0.05, 0.95, 4000)
    y = (rng.random(4000) < p).astype(float)
    z = np.log(p / (1 - p))
    assert quality._temperature(4 * z, y) == pytest.approx(4, rel=0.1)


def test_odd_documents(spark):
    prepared(spark)
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (7, 0, 0), (None, 0, 0), (8, None, 0), (13, 1, 1), (9, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.score(odd_docs(spark), labels).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == sorted(d or 0 for d, _ in TEXTS)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    kept = quality.accepted(odd_docs(spark), labels)
    assert kept.columns == odd_docs(spark).columns and kept.count() == sum(r["predicted"] for r in rows)
    none = quality.score(odd_docs(spark), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score(no_docs(spark), labels).count() == 0
