"""SimHash near-duplicates (operator 9) and components against brute force."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

import __spark_entry__ as contract
from millrace.llm import simhash
from millrace.llm.components import components
from millrace.llm.frames import prepared
from tests.llm.odd import TEXTS, no_docs, odd_docs

SF_DIR = "/root/testdata/sf0.001"


def naive_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def naive_parts(nodes, linked):
    """Node -> smallest node it reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def naive(rows):
    fps = [naive_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    part = naive_parts(range(len(rows)), pairs)
    ids = {}
    for k, (doc_id, _) in enumerate(rows):
        known = [d for d in (ids.get(part[k]), doc_id) if d is not None]
        ids[part[k]] = min(known, default=None)
    return sorted(((rows[k][0], f"{fps[k]:016x}", ids[part[k]]) for k in range(len(rows))), key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_query_against_brute_force(spark):
    rows = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    found = contract.queries()["op9_simhash_near_dedup"](spark, SF_DIR)
    assert collected(found) == naive([(r["doc_id"], r["text"]) for r in rows])


def test_odd_documents(spark):
    prepared(spark)
    assert collected(simhash.near_duplicates(odd_docs(spark))) == naive(TEXTS)
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


def near_group(seed, centres, copies, flips):
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 2**64, centres, dtype=np.uint64)
    for _ in range(copies):
        out = np.concatenate((out, rng.choice(out, centres) ^ (np.uint64(1) << rng.integers(0, 64, centres, dtype=np.uint64)) if flips else out))
    return np.unique(out)


@pytest.mark.parametrize("tile, chunk", [(2048, 64), (16, 2)])
def test_links_join_what_pairs_join(spark, monkeypatch, tile, chunk):
    prepared(spark)
    monkeypatch.setattr(simhash, "CHUNK_TILES", chunk)
    fps = np.concatenate((near_group(1, 40, 12, True), near_group(2, 1, 300, True), np.random.default_rng(4).integers(0, 2**64, 300, dtype=np.uint64)))
    fps = np.unique(fps)
    signed = fps.view(np.int64).tolist()
    linked = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), 3, tile)
    got = {r["u"]: r["root"] for r in components(linked).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    want = naive_parts(signed, [(signed[i], signed[j]) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    assert {f: got.get(f, f) for f in signed} == want


def test_a_large_group_costs_a_row_a_member():
    fps = np.arange(512, dtype=np.uint64)  # many within three bits of each other
    u, v = simhash.tile_links(fps, fps, 3)
    assert len(u) == 511 and set(v.tolist()) == {0}


def test_components_of_random_graphs(spark):
    prepared(spark)
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(5000, 5040)]
    star = [(9000, i) for i in range(9001, 9300)]
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + chain + star
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = naive_parts({n for e in edges for n in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
