"""Personal data (operator 2): base patterns against plain regular expressions, and the tagger."""

import hashlib
import time
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as contract
from millrace.llm import pii
from millrace.llm.frames import prepared
from millrace.llm.tagger import Tagger
from tests.llm.odd import TEXTS, no_docs, odd_docs

SF_DIR = "/root/testdata/sf0.001"


def naive(text):
    text, out = text or "", []
    out += [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits[::-1])]
        if 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0125.@a_-+ (é٣Z", max_size=40))
def test_base_spans_are_the_plain_matches(text):
    assert pii.base_spans(text) == naive(text)


def test_long_runs_take_no_longer_than_their_length():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "a@" * 100_000, "+1" + "1" * 300_000, "+1(" * 50_000):
        assert isinstance(pii.base_spans(text), list)


def test_gradients_against_differences():
    tagger, rng = Tagger.fresh(6, 2, 3, 1), np.random.default_rng(0)
    x, y = rng.integers(0, 6, (4, 7)), np.zeros((4, 7), int)
    y[0, 2], y[0, 3], y[1, 1] = 1, 2, 3
    _, grads = tagger.gradients(x, y)
    for k, w in enumerate(tagger.weights):
        at = tuple(int(rng.integers(0, s)) for s in w.shape)
        w[at] += 1e-5
        above = tagger.gradients(x, y)[0]
        w[at] -= 2e-5
        below = tagger.gradients(x, y)[0]
        w[at] += 1e-5
        assert (above - below) / 2e-5 == pytest.approx(grads[k][at], abs=1e-5)


def test_decoding_is_the_best_path():
    import itertools

    tagger, rng = Tagger.fresh(6, 1, 3, 1), np.random.default_rng(0)
    tagger.weights[8] = rng.normal(size=(3, 3))
    from millrace.llm.tagger import allowed

    moves = tagger.weights[8] + allowed(1)
    e, lengths = rng.normal(size=(5, 6, 3)), np.array([6, 1, 3, 5, 2])
    got = tagger.decode(e, lengths)
    for row, n in enumerate(lengths):
        score = lambda p, row=row: e[row, range(len(p)), p].sum() + sum(moves[a, b] for a, b in itertools.pairwise(p))
        paths = [p for p in itertools.product(range(3), repeat=int(n)) if p[0] != 2]
        assert tuple(got[row, :n]) == max(paths, key=score)


@pytest.fixture(scope="module")
def tagger():
    return pii.train()


def test_held_out_windows(tagger):
    drawn = list(pii.labelled_windows(500, seed=321))
    got = pii.tag([t for t, _ in drawn], tagger)
    right = sum(len(set(a) & set(b)) for (_, a), b in zip(drawn, got, strict=True))
    assert right / sum(map(len, got)) > 0.88 and right / sum(len(a) for _, a in drawn) > 0.88


def test_what_the_patterns_miss(tagger):
    texts = ["call (487) 555-7209 now", "write to josé.garcía@exämple.com please", "nothing here but 12 words", "no sign of anything"]
    kinds = [[s[2] for s in both if s not in base] for base, both in pii.all_spans(texts, tagger)]
    assert kinds == [["phone"], ["email"], [], []]


def test_long_addresses_are_read_whole(tagger):
    for text in ("write to post@müller-lüdenscheidt-verwaltungsgesellschaft.example please", "to josé.garcía.fernández.de.la.vega.y.montoya@exämple.com now"):
        ((_, both),) = pii.all_spans([text], tagger)
        word = next(w for w in text.split() if "@" in w)
        assert [text[a:b] for a, b, k in both if k == "email"] == [word]


def test_a_stretch_longer_than_a_window_is_reconciled(tagger):
    text = " ".join(f"+1 ({k:03d}) 555-0100 word" for k in range(100, 160))
    (spans,) = pii.tag([text], tagger)
    found = {(a, b) for a, b, k in spans if k == "phone"}
    want = {m.span() for m in re.finditer(r"\+1 \(\d+\) 555-0100", text)}
    assert len(found & want) > 0.9 * len(want)


def test_query_holds_the_base_spans(spark):
    docs = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = {r["doc_id"]: r for r in contract.queries()["op2_personal_data"](spark, SF_DIR).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        compare(rows[d["doc_id"]], d["text"])


def compare(row, text):
    said = [f"{k}:{a}:{b}" for a, b, k in naive(text)]
    for kind in pii.KINDS:
        assert row[f"n_{kind}"] == sum(s.startswith(kind + ":") for s in said)
    assert row["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
    spans = row["spans"].split(",") if row["spans"] else []
    assert set(said) <= set(spans)
    order = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in spans]
    assert order == sorted(order)
    # Added spans meet no base span, but for longer ones of its kind around it.
    for extra in set(spans) - set(said):
        kind, a, b = extra.split(":")
        assert all(pii._beside((int(a), int(b), kind), other) for other in naive(text))


FORMS = {
    "phone": ["0151 2345678", "06 12 34 56 78", "020 7946 0958", "(487) 555-7209", "487-555-7209", "487.555.7209", "030 1234567", "+49 (151) 234-5678"],
    "card": ["4111/1111/1111/1111", "4111.1111.1111.1111", "5500 0000 0000 0004", "3400 0000 0000 009"],
    "email": ["josé.garcía@correo.example", "müller@web.example", "anna@münchen.example", "çelik.öz@posta.example"],
}
CONTEXTS = ["call {} now", "{}", "please write to {}, thanks.", "Kontakt: {}\nmehr text hier", "my details are {} and nothing else is here today", "(see {})"]


@pytest.mark.parametrize("kind", FORMS)
def test_forms_written_by_hand(tagger, kind):
    for form in FORMS[kind]:
        texts = [c.format(form) for c in CONTEXTS]
        found = [any(t[a:b] == form and k == kind for a, b, k in both) for t, (_, both) in zip(texts, pii.all_spans(texts, tagger), strict=True)]
        assert sum(found) >= 5, (form, found)


def test_numbers_of_other_kinds(tagger):
    values = ["GPS 48.8566 2.3522", "order 123 456 7890", "Invoice: 020 7946 0958", "2024-01-05 10:22", "version 1.2.3", "price 12.50 and 13.75 or 99.10", "pi is 3.14159265358979"]
    assert all(both == base == [] for base, both in pii.all_spans([f"see {v} there" for v in values], tagger))


def test_longer_address_stays_beside_its_base_span(tagger):
    text = "to josé.garcía@correo.example please"
    ((base, both),) = pii.all_spans([text], tagger)
    assert [text[a:b] for a, b, _ in base] == ["a@correo.example"]
    assert [text[a:b] for a, b, _ in both] == ["josé.garcía@correo.example", "a@correo.example"]


def test_stretches_lose_nothing_of_whole_texts(tagger, monkeypatch):
    """Every text of sf0.01 read whole in overlapping windows gives the same spans."""
    texts = [t or "" for t in pq.read_table(f"{SF_DIR}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    texts += [c.format(f) for forms in FORMS.values() for f in forms for c in CONTEXTS]
    found = pii.all_spans(texts, tagger)
    assert sum(len(both) > len(base) for base, both in found) > 50
    monkeypatch.setattr(pii, "stretches", lambda text: iter([(0, len(text))] if text else []))
    assert pii.all_spans(texts, tagger) == found


def test_no_span_lies_where_there_is_no_sign():
    rng = random.Random(3)
    parts = ["12", "555", "1234567890", "9" * 20, "4111", " ", " ", "-", ".", "/", "(", ")", "+", "a", "@x.y", "b@c.d", "1.2.3.4", "_", "é"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        a = rng.randrange(len(text))
        b = rng.randint(a + 1, len(text))
        signs = pii.signs(text)
        for kind in pii.KINDS:
            span = pii.checked(text, a, b, kind)
            if span:
                assert any(s < span[1] and span[0] < e for s, e in signs), (text, span, signs)


def test_long_pieces_are_decoded_in_sections(tagger, monkeypatch):
    text = " ".join(f"+1 ({k:03d}) 555-0100 word {k}.5" for k in range(100, 400))
    found = pii.tag([text, "call 0151 2345678", text[:1500]], tagger)
    monkeypatch.setattr(pii, "SECTION", 1 << 30)
    assert pii.tag([text, "call 0151 2345678", text[:1500]], tagger) == found


def test_time_on_text_full_of_digits(tagger):
    rng = random.Random(1)
    base64 = "".join(rng.choice("ABCDEFabcdefghij0123456789+/") for _ in range(200_000))
    log = "\n".join(f"2024-01-05 10:22:{k % 60:02d} GET /x/{k} 200 {k * 7}" for k in range(4000))
    for text in (base64, "7" * 1_000_000, log):
        start = time.process_time()
        pii.all_spans([text], tagger)
        assert time.process_time() - start < 20


def test_odd_documents(spark):
    prepared(spark)
    rows = pii.digest(pii.personal_data(odd_docs(spark), examples=96)).collect()
    left = sorted(TEXTS, key=lambda r: (r[0] or 0, r[1] or ""))
    for row, (doc_id, text) in zip(sorted(rows, key=lambda r: (r["doc_id"] or 0)), left, strict=True):
        assert row["doc_id"] == doc_id
        if doc_id not in (3, None):
            compare(row, text)
    assert pii.personal_data(no_docs(spark), examples=48).count() == 0
