"""Licence scans (operator 10): places against a plain search, expressions against their meaning."""

import random
import re

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract
from millrace.llm import licenses
from millrace.llm.frames import prepared
from tests.llm.odd import TEXTS, no_docs, odd_docs

SF_DIR = "/root/testdata/sf0.01"


def naive(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = [
        (k, label) for phrase, label in licenses.BASE.items() for k in range(len(words))
        if words[k : k + phrase.count(" ") + 1] == phrase.split()
    ]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def compare(rows, texts):
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows), key=str)
    assert got == sorted(((d or 0, *naive(t)) for d, t in texts), key=str)
    for r in rows:
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(filter(None, r["base_labels"].split(","))) <= set(labels)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)


def test_query_against_a_plain_search(spark):
    docs = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = contract.queries()["op10_licenses"](spark, SF_DIR).collect()
    compare(rows, [(d["doc_id"], d["text"]) for d in docs])
    assert any(r["n_base"] for r in rows)


def test_odd_documents(spark):
    prepared(spark)
    compare(licenses.digest(licenses.licences(odd_docs(spark))).collect(), TEXTS)
    assert licenses.licences(no_docs(spark)).count() == 0


@pytest.mark.parametrize("text", ["cc by cc by", "CC-BY", "accc by", "cc  by\ncc", "cc é by", "all rights reserved all rights reserved", "gnu general public license general public license", "ccby cc by4"])
def test_places(text):
    n, base, labels, _, _ = licenses.scan(text)
    places = [k for k, _ in base]
    assert (n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base}))) == naive(text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("MIT", ["MIT"]), ("MIT OR Apache-2.0 AND ISC", ["MIT", "Apache-2.0", "ISC", "and", "or"]),
        ("(MIT or Apache-2.0) AND ISC */", ["MIT", "Apache-2.0", "or", "ISC", "and"]),
        ("GPL-2.0 WITH x-exception AND MIT", ["GPL-2.0", "x-exception", "with", "MIT", "and"]),
        ("MIT and", None), ("or MIT", None), ("(MIT", None), ("", None), ("MIT) OR ISC", ["MIT"]), ("MIT for all", ["MIT"]),
        ("A-1 OR B-1 OR C-1", ["A-1", "B-1", "or", "C-1", "or"]), ("see the file", None), ("MIT or whatever", None), (" : ", None),
        ("MIT OR\n# GPL-2.0", ["MIT", "GPL-2.0", "or"]), ("(MIT\r\n * AND ISC)\nBSD-1", ["MIT", "ISC", "and"]), ("\nMIT", None), ("MIT\nOR ISC", ["MIT"]),
        ("LicenseRef-x.", ["LicenseRef-x"]), ("MIT -- all of it", ["MIT"]), ("- MIT", None),
    ],
)
def test_postfix(text, want):
    assert licenses.postfix(text) == want


def test_evaluation():
    level = lambda t: licenses.evaluate(licenses.postfix(t))
    assert level("MIT OR GPL-3.0-only") == ({"mit", "gpl-3.0-only"}, licenses.PERMISSIVE)
    assert level("MIT AND GPL-3.0-or-later")[1] == licenses.COPYLEFT
    assert level("GPL-2.0+ WITH Classpath-exception-2.0") == ({"gpl-2.0+"}, licenses.WEAK)
    assert level("(MIT OR GPL-2.0) AND CC-BY-NC-4.0")[1] == licenses.NO_COMMERCE
    assert level("Unheard-Of-1.0")[1] == licenses.UNKNOWN
    assert [licenses.strictness(x) for x in ("BSL-1.0", "OFL-1.1", "EUPL-1.2", "BUSL-1.1", "none")] == [licenses.PERMISSIVE] * 2 + [licenses.WEAK, licenses.NO_COMMERCE, 1.0]


def test_tags_add_labels():
    _, _, labels, expressions, score = licenses.scan("x\n# SPDX-License-Identifier: (MIT AND BSD-3-Clause)\n")
    assert labels == {"mit", "bsd-3-clause"} and expressions == ["MIT BSD-3-Clause and"] and score == licenses.PERMISSIVE
    assert licenses.scan("SPDX-License-Identifier: AND")[2] == set()
    assert licenses.scan("This is free and unencumbered software. Apache License, Version 2.0")[2] == {"unlicense", "apache", "apache-2.0"}


def test_every_tag_of_a_line_is_read():
    _, _, labels, expressions, score = licenses.scan("SPDX-License-Identifier: MIT */ x(); /* SPDX-License-Identifier: GPL-3.0-only */")
    assert labels == {"mit", "gpl-3.0-only"} and expressions == ["MIT", "GPL-3.0-only"] and score == licenses.COPYLEFT
    many = licenses.scan(" ".join(f"License-Expression: A{k} OR B{k}" for k in range(500)))
    assert many[3] == [f"A{k} B{k} or" for k in range(500)]
    assert licenses.scan("SPDX-License-Identifier:\nMIT SPDX-License-Identifier: ISC\rBSD")[3] == ["ISC"]


MARKS = ["", " ", "-", "_", "  ", "\t", "\n", ". ", " (", ", ", "/", " - ", ": ", "é", "\r\n# ", "\x1f", "😀"]


@pytest.mark.parametrize("mark", MARKS)
def test_tag_words_parted_by_any_mark(mark):
    """A tag has spaces, tabs, hyphens and underscores between its words; whatever else is there, no tag and no failure."""
    text = f"a SPDX{mark}License{mark}Identifier: MIT b"
    tagged = bool(re.fullmatch(r"[-_ \t]+", mark))
    assert licenses.scan(text)[2:4] == (({"mit"}, ["MIT"]) if tagged else (set(), []))


@pytest.mark.parametrize("text", ["free software license. Expression of interest welcome", "license (expression)", "A license expression is a string", "SPDX-License-Identifier: see the file", "license expression", "license expression:", "license-expression = ", "license expression is: MIT"])
def test_words_of_a_tag_that_are_none(text):
    assert licenses.scan(text)[2:] == (set(), [], 0.0)


def test_drawn_texts_of_tag_words_and_marks():
    rng = random.Random(7)
    words = ["SPDX", "license", "License", "identifier", "Expression", "MIT", "or", "AND", "with", "(", ")", "GPL-2.0+", ":", "=", "see", "all rights reserved", "cc by"]
    for _ in range(10_000):
        text = "".join(rng.choice(words) + rng.choice(MARKS) for _ in range(rng.randint(1, 14)))
        n, base, labels, expressions, score = licenses.scan(text)
        places = [k for k, _ in base]
        assert (n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base}))) == naive(text)
        behind = r"(?i)(?<![0-9a-z\x80-\U0010ffff])(?:spdx[-_ \t]+license[-_ \t]+identifier|license[-_ \t]+expression)[ \t]*[:=]"
        assert len(expressions) <= len(re.findall(behind, text)) and (labels or not score)


def test_many_tags_in_one_long_line():
    text = "license expression: MIT or (" * 20_000
    assert licenses.scan(text)[3] == []
    assert len(licenses.scan("license-expression: MIT " * 20_000)[3]) == 20_000
