"""Whole-text encodings piece by piece, bit packing, and the token files (operator 1)."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
from millrace.llm import bitpack, encoding, token_files
from millrace.llm.frames import prepared
from tests.llm.odd import TEXTS, no_docs, odd_docs

SF_DIR = "/root/testdata/sf0.001"
ALPHABET = " \n\t ab'sl1,.é̀½²Ⅷªß× 中‍\x1c\r"
END = "<|endoftext|>"
ADDED = [END, f"{END} a {END}", f"hello {END} world", f"a{END}b", f"{END}{END}", f"the end {END}", "<|endoftext|", f"é {END}\u00a0x", f" {END} "]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(encoding.default_vocabulary())


def test_pieces_give_the_ids_and_offsets_of_the_whole(whole):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [t or "" for _, t in TEXTS] + ADDED + ["'s 'll don't"]
    plain, spans = (encoding.Encoder(encoding.default_vocabulary(), o) for o in (False, True))
    ids, n = plain(texts)
    ids2, n2, begin, end = spans(texts)
    want = [whole.encode(t, add_special_tokens=False) for t in texts]
    assert ids.tolist() == ids2.tolist() == [i for w in want for i in w.ids]
    assert n.tolist() == n2.tolist() == [len(w.ids) for w in want]
    assert list(zip(begin.tolist(), end.tolist(), strict=True)) == [o for w in want for o in w.offsets]


def test_forgetting_changes_nothing(whole, monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED_PIECES", 3)
    encoder = encoding.Encoder(encoding.default_vocabulary())
    for text in ("a b c d e f", "g h a b", "", "a b c"):
        assert encoder([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_a_caller_may_bound_what_is_remembered(whole):
    encoder = encoding.encoder(encoding.default_vocabulary(), remembered=3)
    for text in ("a b c d e f", "g h a b", "", "a b c"):
        assert encoder([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) <= 3 + 6
    assert encoding.encoder(encoding.default_vocabulary()) is not encoder


@pytest.mark.parametrize("at_once", [1, 5, 40])
def test_pieces_of_few_texts_are_held(monkeypatch, at_once):
    """However many texts a batch has, those that are cut together are few, and the results are those of one go."""
    texts = ["", "a b c d", "hello world " * 9, "", *(t or "" for _, t in TEXTS), *ADDED, ""]
    for offsets in (False, True):
        want = encoding.Encoder(encoding.default_vocabulary(), offsets)(texts)
        monkeypatch.setattr(encoding, "CUT_CHARACTERS", at_once)
        encoder, held = encoding.Encoder(encoding.default_vocabulary(), offsets), []
        encoded = encoder._encoded
        monkeypatch.setattr(encoder, "_encoded", lambda part, encoded=encoded, held=held: held.append(part) or encoded(part))
        found = encoder(texts)
        monkeypatch.undo()
        assert [t for part in held for t in part] == texts and len(held) > 1
        assert all(sum(map(len, part[1:])) <= at_once for part in held)
        assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(found, want, strict=True))
        assert [x.tolist() for x in encoder([])] == [[] for _ in want]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_images_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=80)), np.uint32)
    assert bitpack.unpack(bitpack.pack(ids, bits), bits, len(ids)).tolist() == ids.tolist()
    image = bitpack.Image(bitpack.image(ids, bits, block_ids=7))
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert image.read(a, b).tolist() == ids[a:b].tolist()


def test_bits_and_refusals():
    assert [bitpack.bits_for(v) for v in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    assert len(bitpack.pack(np.zeros(8, np.uint32), 5)) == 5
    with pytest.raises(ValueError):
        bitpack.pack(np.array([32]), 5)
    with pytest.raises(ValueError):
        bitpack.Image(b"nonsense" * 9)


def in_order(rows):
    def tie(text):
        return 42 if text is None else int(np.uint64(xxhash.xxh64_intdigest(text.encode(), seed=42)).astype(np.int64))

    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))


def expected(whole, rows):
    out, start = [], 0
    for doc_id, text in in_order(rows):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def collected(df):
    rows = [tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    return sorted(rows, key=lambda r: r[1])


def test_query_against_brute_force(spark, whole):
    rows = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    found = contract.queries()["op1_token_files"](spark, SF_DIR)
    assert dict(found.dtypes)["start"] == dict(found.dtypes)["ids_crc32"] == "bigint"
    assert collected(found) == expected(whole, [(r["doc_id"], r["text"]) for r in rows])


def test_odd_documents_and_small_images(spark, whole, monkeypatch):
    prepared(spark)
    monkeypatch.setattr(token_files, "IMAGE_IDS", 5)
    images = token_files.write_tokens(odd_docs(spark))
    assert collected(token_files.document_index(images)) == expected(whole, TEXTS)
    stored = [bitpack.Image(r["data"]) for r in images.orderBy("shard", "image").collect()]
    ids = np.concatenate([i.read(0, i.n_ids) for i in stored])
    texts = [t for _, t in in_order(TEXTS)]
    assert ids.tolist() == [i for t in texts for i in [*whole.encode(t or "", add_special_tokens=False).ids, 2]]


def test_added_tokens_inside_texts(spark, whole):
    """Their ids are the library's, and every later document starts where it does there."""
    prepared(spark)
    rows = list(enumerate(ADDED + ["after"]))
    found = token_files.document_index(token_files.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert collected(found) == expected(whole, rows)
    assert whole.encode(ADDED[2], add_special_tokens=False).ids == [31373, 220, 50256, 995]


def test_rows_of_one_id_are_in_several_shards(spark, whole):
    """A third of all rows without an id, a third alike in id and text."""
    prepared(spark)
    rows = [(None, f"text {k}") for k in range(300)] + [(5, "the same")] * 300 + [(k, f"other {k}") for k in range(10, 310)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be one piece
    images = token_files.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6))
    prepared(spark)
    assert collected(token_files.document_index(images)) == expected(whole, rows)
    shards = images.select("shard", F.explode("doc_ids").alias("doc_id")).groupBy("doc_id").agg(F.count_distinct("shard").alias("n"))
    assert {r["n"] > 1 for r in shards.filter("doc_id IS NULL OR doc_id = 5").collect()} == {True}


def test_no_documents(spark):
    prepared(spark)
    assert token_files.document_index(token_files.write_tokens(no_docs(spark))).count() == 0
