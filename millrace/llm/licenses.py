"""Operator 10: licence notices and identifier tags in texts, and what their expressions allow.

A text's words are its runs of ASCII letters and digits and of anything outside ASCII, with A-Z
lower-cased. One Aho-Corasick automaton finds every place of every phrase, word by word. A tag is a place of
a tag phrase whose words are parted by spaces, tabs, hyphens or underscores only, with ``:`` or ``=`` behind it. The
expression behind a tag, up to the next tag phrase, is turned into postfix by a shunting-yard parser (``with`` binds
closest, then ``and``, then ``or``) and evaluated: ``and`` is as strict as its stricter side, ``or`` as its milder,
an exception lowers copyleft by one step. An expression ends with its line, unless an operator or an open bracket waits
for more. ``score`` is the strictness of the strictest notice or expression of the text, 0 without any.

An identifier is a name of ``STRICTNESS``, with or without a version, or a name with a digit or a hyphen. One that is not
known counts as ``UNKNOWN``: terms that nobody here has read, between weak and full copyleft. A malformed expression and one
with any other word for an operand (``License-Expression: see the file``) are skipped.

Null and empty texts have no words and no labels. Repeated rows are scanned each. Empty tables
give no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import WORD_BYTES

# Strictness: free 0.1, permissive 0.25, weak copyleft 0.5, unknown 0.6, copyleft 0.75, no commercial use 0.9, reserved 1.
FREE, PERMISSIVE, WEAK, UNKNOWN, COPYLEFT, NO_COMMERCE, RESERVED = 0.1, 0.25, 0.5, 0.6, 0.75, 0.9, 1.0

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

PHRASES = {
    "apache license": "apache", "apache license version 2 0": "apache-2.0", "mit license": "mit",
    "permission is hereby granted free of charge": "mit", "bsd license": "bsd", "isc license": "isc",
    "redistribution and use in source and binary forms": "bsd", "mozilla public license": "mpl",
    "eclipse public license": "epl", "lesser general public license": "lgpl",
    "affero general public license": "agpl", "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0", "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd", "cc0": "cc0", "public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
}
TAGS = ("spdx license identifier", "license expression")

# Public licence identifiers without their versions, by what they ask.
_NAMES = {
    FREE: "0bsd cc0 public-domain unlicense wtfpl mit-0 blessing",
    PERMISSIVE: (
        "afl apache artistic beerware blueoak bsd bsl cc-by curl fsfap ftl hpnd ijg isc libpng libtiff mit mit-cmu ncsa"
        " ofl openssl php postgresql psf python sgi-b tcl unicode unicode-dfs upl vim w3c x11 zlib zpl"
    ),
    WEAK: "apsl cddl cecill-c cpl epl eupl ipl lgpl lgpllr lppl mpl ms-rl",
    COPYLEFT: "agpl cc-by-sa cecill copyleft-next gfdl gpl odbl osl qpl rpl sleepycat sspl",
    NO_COMMERCE: "cc-by-nc cc-by-nc-sa cc-by-nc-nd cc-by-nd busl elastic",
    RESERVED: "reserved proprietary unlicensed none",
}
STRICTNESS = {name: level for level, names in _NAMES.items() for name in names.split()}

_SPACED = bytes(b if WORD_BYTES[b] else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[-_ \t]+")
_BEHIND_TAG = re.compile(rb"[ \t]*[:=]")
_PART = re.compile(r"[\r\n]|[()]|[A-Za-z0-9.+_-]+")
_VERSION = re.compile(r"-(?:\d+(?:\.\d+)*|\d+-clause)(?:-only|-or-later)?\+?$")
_BINDS = {"or": 1, "and": 2, "with": 3}


def strictness(identifier: str) -> float | None:
    """Of a licence identifier, with or without its version; None when it is not known."""
    name = identifier.lower().rstrip("+")
    return STRICTNESS.get(name, STRICTNESS.get(_VERSION.sub("", name)))


def is_identifier(name: str) -> bool:
    """Whether an operand can name a licence or an exception."""
    return strictness(name) is not None or any(c.isdigit() or c == "-" for c in name.strip("-"))


def postfix(text: str) -> list[str] | None:
    """The expression at the start of ``text`` in postfix order; None when it is malformed."""
    out: list[str] = []
    waiting: list[str] = []
    operand = False  # whether the part before is an operand
    for found in _PART.finditer(text):
        part = found[0]
        low = part.lower()
        if part in "\r\n":
            if "(" not in waiting and (operand or not waiting):
                break
        elif low in _BINDS:
            if not operand:
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = False
        elif part == "(":
            if operand:
                break
            waiting.append(part)
        elif part == ")":
            if not operand or "(" not in waiting:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        else:
            if operand:
                break  # the expression has ended
            name = part.rstrip(".-_")
            if not name and waiting:
                continue  # a mark of the line, such as that of a comment
            if not is_identifier(name):
                return None
            out.append(name)
            operand = True
    if not operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(parts: list[str]) -> tuple[set[str], float]:
    """The licences an expression names, and how strict it is."""
    stack: list[tuple[set[str], float]] = []
    for k, part in enumerate(parts):
        if part not in _BINDS:
            # An exception behind ``with`` is no licence; it is dropped when its operator comes.
            level = strictness(part)
            stack.append(({part.lower()}, UNKNOWN if level is None else level))
            continue
        (names, right), (others, left) = stack.pop(), stack.pop()
        if part == "with":
            stack.append((others, WEAK if left == COPYLEFT else left))
        else:
            stack.append((names | others, max(left, right) if part == "and" else min(left, right)))
    return stack[0]


def _compiled():
    return _automaton(tuple(sorted(PHRASES.items())))


@lru_cache(maxsize=1)
def _automaton(phrases: tuple):
    import ahocorasick

    found = ahocorasick.Automaton()
    labels: dict[str, tuple[list[str], list[str], int]] = {}  # base labels, others, words of a tag
    for phrase, label in BASE.items():
        labels.setdefault(phrase, ([], [], 0))[0].append(label)
    for phrase, label in phrases:
        labels.setdefault(phrase, ([], [], 0))[1].append(label)
    for phrase in TAGS:
        labels[phrase] = ([], [], phrase.count(" ") + 1)
    for phrase, (base, more, tag) in labels.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, base, more, tag))
    found.make_automaton()
    return found


def _tags(raw: bytes, places: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Where the expression behind each tag begins and where the next tag phrase does, in bytes.

    ``places``: first word and number of words of every place of a tag phrase.
    """
    spans = [m.span() for m in _WORD.finditer(raw)]
    nexts = [spans[first][0] for first, _ in places[1:]] + [len(raw)]
    for (first, n), end in zip(places, nexts, strict=True):
        own = spans[first : first + n]
        behind = _BEHIND_TAG.match(raw, own[-1][1])
        if behind and all(_GAP.fullmatch(raw, a[1], b[0]) for a, b in zip(own, own[1:], strict=False)):
            yield behind.end(), max(end, behind.end())


def scan(text: str | None) -> tuple[int, list[tuple[int, str]], set[str], list[str], float]:
    """Number of words; first word and label of every base place; all labels; expressions; score."""
    if not text:
        return 0, [], set(), [], 0.0
    raw = text.encode()
    words = raw.lower().translate(_SPACED).split()
    joined = f" {b' '.join(words).decode()} "
    base, labels, tags = [], set(), []
    at, before = 0, 0  # words that begin before position ``at`` of ``joined``
    for last, (size, own, more, tag) in _compiled().iter(joined):
        labels.update(own, more)
        if own or tag:
            first = last - size + 1
            if first >= at:
                before += joined.count(" ", at, first)
            else:  # a longer phrase that began earlier ends later
                before -= joined.count(" ", first, at)
            at = first
            base += [(before, label) for label in own]
            if tag:
                tags.append((before, tag))
    levels = [strictness(label) or UNKNOWN for label in labels]
    expressions = []
    for begin, end in _tags(raw, tags) if tags else ():
        parts = postfix(raw[begin:end].decode())
        if parts:
            names, level = evaluate(parts)
            labels |= names
            levels.append(level)
            expressions.append(" ".join(parts))
    return len(words), sorted(base), labels, expressions, max(levels, default=0.0)


_FOUND = (
    "doc_id bigint, n_words bigint, base array<struct<start: bigint, label: string>>,"
    " labels array<string>, expressions array<string>, score double"
)
_PLACE = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [scan(t) for t in batch.column("text").to_pylist()]
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "n_words": pa.array([f[0] for f in found], pa.int64()),
            "base": pa.array([[{"start": s, "label": x} for s, x in f[1]] for f in found], _PLACE),
            "labels": pa.array([sorted(f[2]) for f in found], pa.list_(pa.string())),
            "expressions": pa.array([f[3] for f in found], pa.list_(pa.string())),
            "score": pa.array([f[4] for f in found], pa.float64()),
        })


def licences(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, base, labels, expressions, score`` of every row of ``docs`` (``doc_id``, ``text``).

    ``base`` has every place of the base phrases, ``labels`` theirs and those the method adds,
    ``expressions`` the expressions behind tags in postfix order.
    """
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_scan, _FOUND)


def digest(found: DataFrame) -> DataFrame:
    """The places in numbers and the labels in strings."""
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )
