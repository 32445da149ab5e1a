"""Quality rules (operator 12): figures and ratios against plain Python, verdicts on labelled documents apart."""

import math
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from millrace.llm import quality_rules as rules
from millrace.llm import words
from millrace.llm.frames import prepared
from tests.llm.odd import TEXTS, no_docs, odd_docs

SF_DIR = "/root/testdata/sf0.01"
MASK = (1 << 64) - 1
GOOD = [(k, 1, 0) for k in (3, 10, 12)] + [(None, 1, 0), (3, 1, 0), (14, 0, None), (15, None, 0)]


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def buckets(text):
    raw = (text or "").encode()
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw)
    units = re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff \t-\r]+", lowered)
    hashes = [mixed(sum(b * pow(words._BASE, i, 1 << 64) for i, b in enumerate(u)) & MASK) for u in units]
    pairs = [mixed((a * words._BASE + b) & MASK) for a, b in zip(hashes, hashes[1:])]
    return [h >> (64 - rules.BITS) for h in hashes + pairs]


def figures(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(found, found[1:], found[2:]))
    inside = {k + j for k in range(len(found) - 2) if windows[tuple(found[k : k + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in lines:
        again += line in seen
        seen.add(line)
    failed = len(found) < 50 or 100 * len(inside) > 50 * len(found)
    return len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), again, len(inside), failed


def expected(docs, trusted):
    grams = [Counter(buckets(t)) for _, t in docs]
    raw, target = Counter(), Counter()
    for (i, _), g in zip(docs, grams):
        raw += g
        target += g if i in trusted else Counter()
    size, n, m = 1 << rules.BITS, sum(raw.values()), sum(target.values())
    out = []
    for (i, text), g in zip(docs, grams):
        total = 0
        for b, times in g.items():
            p = (raw[b] + 1) / (n + size)
            total += times * round(1e6 * math.log((target[b] + rules.PRIOR * p) / (m + rules.PRIOR) / p))
        count, own = sum(g.values()), figures(text)
        kept = not own[5] and total >= round(1e6 * rules.KEEP_FROM) * count
        out.append((i, *own, kept, total / count / 1e6 if count else 0.0))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def compare(rows, want):
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept score".split()
    got = sorted((tuple(r[c] for c in names) for r in rows), key=key)
    want = sorted(want, key=key)
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert [g[-1] for g in got] == pytest.approx([w[-1] for w in want], abs=2e-6)


def test_query_against_plain_python(spark):
    docs = [tuple(d.values()) for d in pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    labels = pq.read_table(f"{SF_DIR}/labels.parquet").to_pylist()
    rows = contract.queries()["op12_quality_rules"](spark, SF_DIR).collect()
    compare(rows, expected(docs, {r["doc_id"] for r in labels if r["quality"] == 1}))


def test_odd_documents(spark):
    prepared(spark)
    labels = spark.createDataFrame(GOOD, "doc_id bigint, quality int, toxic int")
    compare(rules.judged(odd_docs(spark), labels).collect(), expected(TEXTS, {3, 10, 12}))
    assert rules.judged(no_docs(spark), labels).count() == 0
    none = rules.judged(odd_docs(spark), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0} and all(r["kept"] != r["base_failed"] for r in none)


@pytest.mark.parametrize("text", [
    "a b c a b c", "a b c d a b", "a\nb\na\n\n \n \na", "x\r\nx\r\n", "é é é é", "a b", "a a a a", "#*$%&|<> ##", "a\x1cb\x0bc", "ß\n ß\nß",
])
def test_figures(text):
    for texts in ([text], ["a b c", text, "a b c", text]):
        assert [tuple(f) for f in rules.base_figures([t.encode() for t in texts])] == [figures(t)[:5] for t in texts]


def test_verdict_on_documents_not_learned_from(spark):
    """Trusted: four fifths of the good documents of sf0.1; the others and the bad ones are judged."""
    prepared(spark)
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    apart = "crc32(cast(doc_id AS string)) % 5 = 0"
    found = rules.judged(docs, labels.filter(f"NOT {apart}")).filter(f"NOT base_failed AND {apart}")
    shares = found.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share"))
    share = {r["quality"]: r["share"] for r in shares.collect()}
    assert share[1] >= 0.99 and share[0] <= 0.1
