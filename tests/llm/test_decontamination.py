"""Copies of test items (operator 8) against a plain alignment of every pair."""

import random
import re

import numpy as np
import pyarrow.parquet as pq

import __spark_entry__ as contract
from millrace.llm import decontamination as dec
from millrace.llm.frames import prepared
from tests.llm.odd import no_docs, odd_docs

SF_DIR = "/root/testdata/sf0.001"


def naive_align(a, b):
    best, row = 0, [0] * (len(a) + 1)
    for y in b:
        new = [0]
        for j, x in enumerate(a):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row = new
        best = max(best, *row)
    return best


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(1, 25)) for _ in range(2))
        assert dec.align(a, b)[0] == naive_align(a.tolist(), b.tolist())


def test_query_against_every_pair(spark):
    docs = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    items = pq.read_table(f"{SF_DIR}/benchmark.parquet").to_pylist()
    number = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in words(t)], np.int64)
    want = set()
    for i in items:
        item = coded(i["text"])
        for d in docs:
            score = dec.align(coded(d["text"]), item)[0] / (2 * len(item))
            if score >= dec.THRESHOLD:
                want.add((d["doc_id"], i["item_id"], round(score, 9)))
    found = contract.queries()["op8_decontamination"](spark, SF_DIR)
    assert {(r["doc_id"], r["item_id"], round(r["score"], 9)) for r in found.collect()} == want
    assert want


def planted(spark, n_copies=40):
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(3000)]
    common = ["the", "of", "and", "to", "in"]
    text = lambda n: [rng.choice(vocabulary if rng.random() < 0.6 else common) for _ in range(n)]
    items = [text(40) for _ in range(8)]
    items[1] = items[0][:20] + text(20)  # shares half with another
    docs, dirty = [], {}
    for k in range(n_copies):
        item = list(items[k % 8])
        edits = (0, 3, 6)[k % 3]
        for _ in range(edits):
            at = rng.randrange(len(item))
            if rng.random() < 0.5:
                item[at] = rng.choice(vocabulary)
            else:
                del item[at]
        docs.append((k, " ".join(text(rng.randrange(200)) + [w.upper() for w in item] + text(rng.randrange(200)))))
        dirty[k] = k % 8
    docs += [(1000 + k, " ".join(text(rng.randrange(400)))) for k in range(60)]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame([(k, ", ".join(i)) for k, i in enumerate(items)], "item_id bigint, text string"), dirty,
    )


def test_edited_copies_are_found_and_clean_documents_left(spark):
    prepared(spark)
    docs, items, dirty = planted(spark)
    found = {(r["doc_id"], r["item_id"]) for r in dec.matches(docs, items).collect()}
    assert set(dirty.items()) <= found
    assert {d for d, _ in found} == set(dirty)


def test_a_passage_in_most_documents_is_found_in_all(spark):
    prepared(spark)
    docs, items, _ = planted(spark)
    passage = items.filter("item_id = 3").first()["text"]
    many = docs.selectExpr("doc_id + 5000 AS doc_id", f"concat(text, ' {passage}') AS text")
    found = {r["doc_id"] for r in dec.matches(docs.unionByName(many), items).filter("item_id = 3").collect()}
    assert {r["doc_id"] for r in many.collect()} <= found


def test_every_edit_pattern_above_the_threshold_is_found(spark):
    prepared(spark)
    rng = random.Random(8)
    text = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(n)]
    items = [text(n) for n in (3, 4, 5, 16, 17, 38, 59)]
    docs, want = [], {}
    for k, item in enumerate(items):
        edited = [list(item)]  # the exact copy makes the item's own grams common
        for every in range(3, 10):
            kept = [(i + 1) % every != 0 for i in range(len(item))]
            edited.append([w if keep else "other%d" % rng.randrange(99) for w, keep in zip(item, kept, strict=True)])
            edited.append([w for w, keep in zip(item, kept, strict=True) if keep])
        for gap in (1, 2, 3):
            edited.append([x for i, w in enumerate(item) for x in (["more%d" % rng.randrange(99), w] if i % gap == 0 else [w])])
        for e in edited:
            docs.append((len(docs), " ".join(text(rng.randrange(80)) + e + text(rng.randrange(80)))))
            for j, other in enumerate(items):
                score = naive_align(words(docs[-1][1]), other) / (2 * len(other))
                if score >= dec.THRESHOLD:
                    want[docs[-1][0], j] = round(score, 9)
    assert len(want) > 100
    frames = (spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in dec.matches(*frames).collect()} == want


def test_odd_inputs(spark):
    prepared(spark)
    items = spark.createDataFrame(
        [(1, "brown fox jumps over the lazy dog"), (1, "brown fox jumps over the lazy dog"), (2, "one two"), (3, None), (4, " ?! "), (None, "text without an id")],
        "item_id bigint, text string",
    )
    found = {(r["doc_id"], r["item_id"]) for r in dec.matches(odd_docs(spark), items).collect()}
    assert {(3, 1), (13, 1), (11, 2), (None, None)} <= found
    assert {d for d, i in found if i == 1} == {3, 13}
    assert dec.matches(no_docs(spark), items).count() == 0
    assert dec.matches(odd_docs(spark), items.limit(0)).count() == 0


def _written(monkeypatch):
    tables = {}
    write = dec.written

    def record(df, label):
        tables[label] = write(df, label)
        return tables[label]

    monkeypatch.setattr(dec, "written", record)
    return tables


def test_a_very_long_item_widens_no_other_segment(spark, monkeypatch):
    prepared(spark)
    docs, items, dirty = planted(spark)
    rng = random.Random(4)
    book = [f"b{rng.randrange(5000)}" for _ in range(20_000)]
    long = items.unionByName(spark.createDataFrame([(99, " ".join(book))], "item_id bigint, text string"))
    plain = _written(monkeypatch)
    want = {(r["doc_id"], r["item_id"]) for r in dec.matches(docs, items).collect()}
    monkeypatch.undo()
    with_book = _written(monkeypatch)
    assert {(r["doc_id"], r["item_id"]) for r in dec.matches(docs, long).collect()} == want
    own = dec.layer(len(book), dec.THRESHOLD)
    lengths = [sorted(r[0] for r in t["segments"].filter(f"layer <> {own}").selectExpr("size(words)").collect()) for t in (plain, with_book)]
    assert lengths[0] == lengths[1] and with_book["segments"].filter(f"layer = {own}").count() == 0
    monkeypatch.undo()
    copied = docs.limit(1).selectExpr("7777 AS doc_id", f"'{' '.join(book[:14_000])}' AS text")
    assert [(r["doc_id"], r["item_id"]) for r in dec.matches(copied, long).collect()] == [(7777, 99)]


def test_items_of_common_words_make_few_candidates(spark, monkeypatch):
    """Word pairs that every document has join everywhere, but only documents that share many places are aligned."""
    prepared(spark)
    rng = random.Random(6)
    common = ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on"]
    item = [rng.choice(common) for _ in range(40)]
    texts = [" ".join(x for _ in range(16) for x in (rng.choice(common), f"w{rng.randrange(9999)}")) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate([*texts, " ".join(item)])), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    aligned = []
    align = dec._align
    monkeypatch.setattr(dec, "_align", lambda threshold: aligned.append(threshold) or align(threshold))
    tables = _written(monkeypatch)
    found = dec.matches(docs, items)
    assert [(r["doc_id"], r["score"]) for r in found.collect()] == [(200, 1.0)]
    need = tables["grams"].first()["need"]
    seeds = {r["gram"]: set() for r in tables["seeds"].collect()}
    for r in tables["seeds"].collect():
        seeds[r["gram"]].add(r["at"])
    shared = [len(set().union(*(seeds.get(g, ()) for g in r["grams"]))) for r in tables["segments"].collect()]
    assert need == 10 and sum(n >= need for n in shared) < len(shared) / 2


def test_bitmap_has_the_leading_bits_of_every_gram(spark):
    rng = np.random.default_rng(2)
    grams = rng.integers(-(2**63), 2**63, 3000)
    bits = dec.gram_bitmap(spark.createDataFrame([(int(g),) for g in grams], "gram bigint"), least=18, most=18)
    want = np.zeros(8 * len(bits), bool)
    want[(grams.view(np.uint64) >> np.uint64(64 - 18)).astype(np.int64)] = True
    assert len(bits) == 1 << 15 and (np.unpackbits(bits, bitorder="little").astype(bool) == want).all()
