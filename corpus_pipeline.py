"""From raw documents to token files: quality, near-duplicates, benchmark copies, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns
of ``documents``, the last one the index of the token files. ``run`` writes every stage's result as
Parquet in the shared folder and reads it again, so a stage that fails can be repeated alone.

Every stage decides by row, so repeated and missing ids change nothing: of a group of near copies one row stays,
that with the smallest id (rows without an id last), and where rows are alike in id and text, the first by the
other columns. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import decontamination, mixing, quality, simhash, token_files
from millrace.llm.frames import fresh, prepared, written
from millrace.sources.tables import Tables

REMEMBERED_PIECES = 200_000  # less than the encoder's own: the workers stay for the other stages


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.accepted(docs, Tables(prepared(spark), sf_dir).labels)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies."""
    prepared(spark)
    key = [fresh("row"), fresh("check")]  # 128 bits: rows alike in both have one id and text
    hashes = (F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "text", "doc_id"))
    keyed = docs.withColumns(dict(zip(key, hashes, strict=True)))
    groups = simhash.grouped(keyed, shingle=3, radius=3, carried=key)
    first = F.min_by(F.struct(*key), F.struct(F.isnull("doc_id"), "doc_id", *key))
    stay = groups.groupBy("root").agg(first.alias("first")).select("first.*")
    place = fresh("place")
    order = Window.partitionBy(*key).orderBy(*(c for c in docs.columns if c not in ("doc_id", "text")), "doc_id")
    return keyed.join(stay, key, "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    row = fresh("row")
    docs_by_row = docs.withColumn(row, F.xxhash64("doc_id", "text"))  # rows alike in both have one decision
    texts = docs_by_row.select(F.col(row).alias("doc_id"), "text")
    found = decontamination.contaminated(texts, Tables(prepared(spark), sf_dir).benchmark)
    return docs_by_row.join(found.select(F.col("doc_id").alias(row)), row, "left_anti").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    prepared(spark)
    return mixing.repeated(docs, F.array("source"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the bit-packed token files, read back from them."""
    prepared(spark)
    return token_files.document_index(token_files.write_tokens(docs, remembered=REMEMBERED_PIECES))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(prepared(spark), sf_dir).documents
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].replace("/", "-"))
    return docs


# A trained network and hashed seeds are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
