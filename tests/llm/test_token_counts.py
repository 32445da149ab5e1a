"""Tokens by field and section (operator 3) against whole encodings and a rule applied one by one."""

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
from millrace.llm import encoding
from millrace.llm.frames import prepared
from millrace.llm.token_counts import token_counts
from tests.llm.odd import no_docs, odd_docs

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(encoding.default_vocabulary())


def expected(whole, fields, values):
    values = [v or "" for v in values]
    text, bounds, owner = "\n".join(values), [], []
    at = 0
    for k, v in enumerate(values):
        lines = [line + "\n" * (i < v.count("\n")) for i, line in enumerate(v.split("\n"))]
        if len(lines) > 1 and not lines[-1]:
            lines.pop()
        for line in lines:
            bounds.append(at)
            owner.append(k)
            at += len(line)
        at += k < len(values) - 1
    bounds.append(at)
    counts, crossing = [0] * len(owner), [0] * len(fields)
    for a, b in whole.encode(text, add_special_tokens=False).offsets:
        share = [max(0, min(b, bounds[i + 1]) - max(a, bounds[i])) for i in range(len(owner))]
        best = share.index(max(share)) if max(share) else max(i for i in range(len(owner)) if bounds[i] <= a)
        counts[best] += 1
        crossing[owner[best]] += sum(s > 0 for s in share) > 1
    return [
        (f, sum(c for c, o in zip(counts, owner, strict=True) if o == k), crossing[k], [c for c, o in zip(counts, owner, strict=True) if o == k])
        for k, f in enumerate(fields)
    ]


FIELDS = ("source", "lang", "text")


def compare(spark, whole, docs):
    rows = docs.select("doc_id", *FIELDS).collect()
    want = sorted(((r["doc_id"] or 0, *e) for r in rows for e in expected(whole, FIELDS, r[1:])), key=str)
    got = sorted(((r[0] or 0, *r[1:]) for r in token_counts(docs).collect()), key=str)
    assert got == want


def test_awkward_sections(spark, whole):
    prepared(spark)
    texts = ["\n\n\n a b\n\n", "", "x\n", "\n\n\n\n\n\n  hello\n\n\n\nw", "a\n \n  \n\n b", "\n", "é\n中\n\n😀", "a<|endoftext|>\nb", "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, t[:2], None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    compare(spark, whole, docs)


def test_odd_documents(spark, whole):
    prepared(spark)
    compare(spark, whole, odd_docs(spark).filter("doc_id IS NULL OR doc_id <> 12"))
    found = {r["field"]: r for r in token_counts(odd_docs(spark).filter("doc_id = 12")).collect()}
    assert found["text"]["n_tokens"] > 50_000
    assert token_counts(no_docs(spark)).count() == 0


def test_query_adds_up_to_the_documents(spark, whole):
    found = contract.queries()["op3_token_counts"](spark, SF_DIR).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(found) == 3 * len(docs)
    total = {}
    for r in found:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        assert r["n_tokens"] == sum(r["section_tokens"])
    for doc_id, r in docs.items():
        text = "\n".join((r["source"] or "", r["lang"] or "", r["text"] or ""))
        assert total[doc_id] == len(whole.encode(text, add_special_tokens=False).ids)
