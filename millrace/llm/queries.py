"""The operators applied to the given tables: name -> query, and the SQL some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontamination, licenses, merkle, mixing, neighbours, periodic, pii, quality, quality_rules, secret_scan, simhash, token_counts, token_files
from millrace.llm.frames import prepared
from millrace.sources.tables import Tables

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def _query(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(Tables(prepared(spark), sf_dir))

    run.__name__, run.__doc__ = plan.__name__, plan.__doc__
    QUERIES[plan.__name__] = run
    return plan

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


@_query
def op1_token_files(t: Tables) -> DataFrame:
    """Every document's place, length and checksum in the bit-packed shard files."""
    return token_files.document_index(token_files.write_tokens(t.documents))


@_query
def op8_decontamination(t: Tables) -> DataFrame:
    """Documents that hold copies of benchmark items, with the items and alignment scores."""
    return decontamination.matches(t.documents, t.benchmark)


@_query
def op9_simhash_near_dedup(t: Tables) -> DataFrame:
    """Every document's SimHash fingerprint and component of near copies."""
    return simhash.near_duplicates(t.documents, shingle=3, radius=3)


@_query
def op5_mixing(t: Tables) -> DataFrame:
    """How many words of every document a mix of the sources takes."""
    mixed = mixing.mix(t.documents, F.array("source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op4_quality(t: Tables) -> DataFrame:
    """Every document's quality score and decision."""
    return quality.score(t.documents, t.labels)


@_query
def op6_neighbours(t: Tables) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return neighbours.search(neighbours.build_index(t.embeddings), F.expr("vec_id % 50 = 0"))


@_query
def op10_licenses(t: Tables) -> DataFrame:
    """Licence phrases, labels and strictness of every document."""
    return licenses.digest(licenses.licences(t.documents))


@_query
def op3_token_counts(t: Tables) -> DataFrame:
    """Tokens of every field of every document, by section."""
    return token_counts.token_counts(t.documents)


@_query
def op7_secrets(t: Tables) -> DataFrame:
    """Secrets in all documents, without the findings a forest takes for false."""
    return secret_scan.secrets(t.documents)


@_query
def op2_personal_data(t: Tables) -> DataFrame:
    """Personal data in every document: base spans and those the tagger adds."""
    return pii.digest(pii.personal_data(t.documents))


@_query
def op11_merkle_manifest(t: Tables) -> DataFrame:
    """Every document's place in a Merkle tree over all, and whether it verifies after some were changed."""
    return merkle.audit(t.documents)


ORACLES["op11_merkle_manifest"] = merkle.audit_sql()


@_query
def op12_quality_rules(t: Tables) -> DataFrame:
    """Base figures of every document, its score against trusted documents, and whether it is kept."""
    return quality_rules.judged(t.documents, t.labels)


@_query
def op13_periodic_runs(t: Tables) -> DataFrame:
    """Runs of repeating words in every document, a tenth of which is made periodic first."""
    return periodic.digest(periodic.periodic_runs(periodic.with_tails(t.documents)))
