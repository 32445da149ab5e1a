"""Operator 7: secrets in texts, with a random forest that removes false findings.

Candidates are runs of at least 16 letters, digits and ``+/=_.-`` of more than one kind of
character, and values of at least 8 characters assigned to a name such as password or api_key. A run
ends before an assigned value and at an ``=`` that is no padding, so a name is no part of its value.
A forest judges each by its length, the characters it is made of, how likely the corpus's
character transitions make it, how much of it frequent words of the corpus cover, the path of
its document, and the words and marks around it. Candidates scored below ``threshold`` go.

Both statistics are counted over all texts in tables of fixed size, summed a task and then in
blocks. The forest is fitted on ``findings`` labelled findings: by default drawn by rule and seed, with
credentials of common shapes on one side, and names, paths, digests, numbers, place-holders and long words that
follow the corpus's own transitions on the other.

Null and empty texts have no findings, a null path is an empty one, repeated rows are scanned each.
Empty tables give no rows. Columns other than ``doc_id``, ``text`` and the path are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import forest, words
from millrace.llm.frames import flat_texts, slices
from millrace.llm.sums import summed

THRESHOLD, FINDINGS, SEED = 0.5, 4000, 5
WORD_BUCKETS, FREQUENT = 1 << 18, 16  # a frequent word's bucket has so many times the mean
_KINDS = 28  # letters, digits as one, anything else as one

_RUN = re.compile(r"[A-Za-z0-9+/=_.-]{16,}")
_ASSIGNED = re.compile(
    r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)\w{0,12}"
    r"[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"']?([^\s\"'<>]{8,})"
)
_JOINT = re.compile(r"=(?=[^=])")  # not padding
_QUERY = re.compile(r"[?&][\w.-]*$")
_SECRET_WORD = re.compile(r"(?i)passw|pwd|secret|token|key|credential|auth|bearer|private|login")
_OTHER_WORD = re.compile(r"(?i)sha\d|hash|commit|checksum|digest|integrity|uuid|guid|version|example|sample|url|href|src|path|file|order|invoice|isbn")
_BENIGN_PATH = re.compile(r"(?i)test|example|sample|doc|fixture|mock|vendor|lock|\.md\b|\.svg\b")
_CODE_PATH = re.compile(r"(?i)\.env|config|secret|credential|\.ya?ml|\.pem|\.ini|\.properties|settings")
_HOLDER = re.compile(r"(?i)your|xxx|changeme|example|placeholder|dummy|<|\$\{|\*\*\*|0123456|1234567|abcdef")
_LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_CODE = np.full(256, 27, np.int64)
_CODE[48:58] = 26
_CODE[65:91] = _CODE[97:123] = np.arange(26)


@dataclass
class Statistics:
    """Log probability of a third character kind after two, and which word buckets are frequent."""

    transitions: np.ndarray
    frequent: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Statistics:
        triples = counts[: _KINDS**3].reshape(_KINDS, _KINDS, _KINDS) + 0.5
        buckets = counts[_KINDS**3 :]
        mean = max(buckets.mean(), 1e-9)
        return cls(np.log(triples / triples.sum(axis=2, keepdims=True)), buckets >= max(FREQUENT * mean, 2))


_SIZE = _KINDS**3 + WORD_BUCKETS


def _count(counts: np.ndarray, batch: pa.RecordBatch) -> None:
    data, offsets = flat_texts(batch.column("text"))
    for first, last in slices(offsets, words.SLICE_BYTES):
        code = _CODE[data[offsets[first] : offsets[last]]]
        if len(code) > 2:
            triples = (code[:-2] * _KINDS + code[1:-1]) * _KINDS + code[2:]
            counts[: _KINDS**3] += np.bincount(triples, minlength=_KINDS**3)
    for w in words.scan(batch.column("text")):
        np.add.at(counts, _KINDS**3 + (w.hashes >> np.uint64(46)).astype(np.int64), 1)


def statistics(docs: DataFrame) -> Statistics:
    """From all texts."""
    return Statistics.of(summed(docs.select(F.col("text").cast("string")), _SIZE, _count))


def _assigned(text: str) -> Iterator[tuple[int, int, int]]:
    """First character of the name, and span of the value; one in a query of a URL ends with its part."""
    for m in _ASSIGNED.finditer(text) if "=" in text or ":" in text else ():
        start, end = m.span(1)
        if _QUERY.search(text, max(0, m.start() - 32), m.start()):
            part = re.match("[^&#]*", m[1]).end()
            end = start + part if part >= 8 else end
        yield m.start(), start, end


def _run(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The span without marks at its end, if it is long enough and of more than one kind of character."""
    while end > start and text[end - 1] in ".-":
        end -= 1
    run = text[start:end]
    kinds = (not run.isupper() and not run.islower() and any(c.isalpha() for c in run)) + any(c.isdigit() for c in run)
    return [(start, end)] if len(run) >= 16 and kinds else []


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans, in order: assigned values, and what of the runs is outside of them and their names."""
    values = list(_assigned(text))
    out, k = [(start, end) for _, start, end in values], 0
    for m in _RUN.finditer(text):
        at, pieces = m.start(), []
        while k < len(values) and values[k][2] <= at:
            k += 1
        inside = k
        while inside < len(values) and values[inside][1] < m.end():
            name, _, end = values[inside]
            pieces.append((at, max(at, name)))
            at, inside = max(at, end), inside + 1
        pieces.append((at, max(at, m.end())))
        for a, b in pieces:
            cuts = [a, *(j.end() for j in _JOINT.finditer(text, a, b)), b + 1]
            parts = [s for x, y in itertools.pairwise(cuts) for s in _run(text, x, y - 1)]
            out += parts or _run(text, a, b)
    return sorted(out)


def features(text: str, start: int, end: int, path: str, known: Statistics) -> list[float]:
    value, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 16]
    n = len(value)
    code = _CODE[np.frombuffer(value.encode("ascii", "replace"), np.uint8)]
    likely = float(known.transitions[code[:-2], code[1:-1], code[2:]].mean()) if n > 2 else 0.0
    covered = 0
    for part in _LETTERS.findall(value):
        if len(part) >= 3:
            (w,) = words.scan(pa.array([part]))
            covered += len(part) * bool(known.frequent[int(w.hashes[0] >> np.uint64(46))])
    share = [sum(map(test, value)) / n for test in (str.isdigit, str.isupper, str.islower)]
    counts = np.unique(np.frombuffer(value.encode("utf-8"), np.uint8), return_counts=True)[1]
    p = counts / counts.sum()
    marks = sum(not c.isalnum() for c in value) / n
    hexadecimal = all(c in string.hexdigits for c in value)
    return [
        n, likely, covered / n, *share, marks, float(-(p * np.log2(p)).sum()), len(counts) / n, hexadecimal,
        sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:], strict=False)) / n,
        bool(_SECRET_WORD.search(before)), bool(_OTHER_WORD.search(before)),
        bool(re.search(r"[=:]\s*[\"']?$", before)), before[-1:] in "\"'" and after[:1] in "\"'" and before != "",
        bool(_HOLDER.search(value)), value.count("/") + value.count("."),
        bool(_BENIGN_PATH.search(path)), bool(_CODE_PATH.search(path)),
    ]


def _long_word(rng: np.random.Generator, known: Statistics, n: int) -> str:
    """``n`` letters that follow the corpus's transitions."""
    out = [int(rng.integers(26)), int(rng.integers(26))]
    while len(out) < n:
        p = np.exp(known.transitions[out[-2], out[-1], :26])
        out.append(int(rng.choice(26, p=p / p.sum())))
    return "".join(string.ascii_lowercase[c] for c in out)


def labelled_findings(known: Statistics, count: int, seed: int = SEED) -> Iterator[tuple[str, int, int, str, bool]]:
    """Text, span, path and label of ``count`` findings of either kind, drawn by rule."""
    rng = np.random.default_rng(seed)
    lower, digits = string.ascii_lowercase, string.digits

    def some(alphabet: str, n: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def word() -> str:
        return _long_word(rng, known, int(rng.integers(3, 11)))

    def phrase() -> str:
        return " ".join(word() for _ in range(int(rng.integers(1, 4))))

    for k in range(count):
        if k % 2:
            mixed = string.ascii_letters + digits
            value = pick(
                lambda: some("0123456789abcdef", pick(32, 40, 48, 64)), lambda: "AKIA" + some(string.ascii_uppercase + digits, 16),
                lambda: pick("ghp_", "gho_", "sk_live_", "xoxb-", "glpat-") + some(mixed, pick(24, 36)),
                lambda: some(mixed, int(rng.integers(20, 48))), lambda: some(mixed + "+/", int(rng.integers(28, 64))) + pick("", "=", "=="),
                lambda: f"eyJ{some(mixed, 30)}.{some(mixed, 60)}.{some(mixed + '_-', 43)}",
            )()
            name = pick("token", "secret", "api_key", "apiKey", "password", "access_token", "AUTH_TOKEN", "client_secret", "key")
            before, after = pick((f'{name} = "', '"'), (f"{name}=", ""), (f"{name}: ", ""), (f"'{name}': '", "'"), ("Bearer ", ""), (f'{name} "', '"'),
                (f"export {pick('X', 'DB', 'APP')}_{name.upper()}=", ""), (f"?{name}=", pick("", "&page=2")), ("", ""), ('"', '"'), ("(", ")"), (f"{word()}=", ""), (f"{word()}: ", ""))
            path = pick("src0", "src12", "app/config.yml", ".env", "src/main.py", "", "web")
        else:
            value, before, after = pick(
                lambda: (_long_word(rng, known, int(rng.integers(16, 28))).capitalize(), " ", " "),
                lambda: ("".join(word().capitalize() for _ in range(4)), " ", "("), lambda: ("_".join(word() for _ in range(4)) + "2", "key ", " "),
                lambda: ("/".join(word() for _ in range(4)) + ".Html", "path: ", ""), lambda: (some("0123456789abcdef", 40), pick("commit ", "sha1: ", "checksum = "), ""),
                lambda: (some("0123456789abcdef", 64), pick("sha256:", "digest: ", "hash="), ""), lambda: (some(digits, int(rng.integers(16, 22))), pick("order ", "isbn ", " "), " "),
                lambda: (pick("your_api_key_here_1", "xxxxxxxxxxxxxxxxxxx1", "CHANGEME_changeme_1", "0123456789abcdef0123", "example-token-1234"), pick('token = "', "key: "), pick('"', "")),
                lambda: ("-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), pick("uuid: ", "id=", "guid "), ""),
                lambda: (f"{some(digits, 4)}-{some(digits, 2)}-{some(digits, 2)}T{some(digits, 6)}.{some(digits, 3)}Z", "at ", " "),
                lambda: (pick("a", "=", "-", "0") * 18 + "1A", " ", " "),
                lambda: (f"{word()}.{some(digits, 2)}-mail{some(digits, 1)}.example.com", " ", " "),
                lambda: (f"{word()}{word()}" + pick("()", ";", "[0]"), pick("token = ", "password: ", "auth = "), ""),
            )()
            path = pick("src0", "src12", "docs/index.md", "tests/test_a.py", "package.lock", "", "src/main.py", "web")
        text = f"{phrase()} {before}"
        yield f"{text}{value}{after} {phrase()}", len(text), len(text) + len(value), path, bool(k % 2)


def train(known: Statistics, findings: int = FINDINGS, seed: int = SEED) -> forest.Forest:
    rows = list(labelled_findings(known, findings, seed))
    x = np.array([features(t, a, b, p, known) for t, a, b, p, _ in rows], np.float64)
    return forest.fit(x, np.array([y for *_, y in rows]), seed=seed)


def secrets(docs: DataFrame, path: str = "source", threshold: float = THRESHOLD, findings: int = FINDINGS) -> DataFrame:
    """``doc_id, start, end, score, digest``: the findings the forest leaves in ``docs`` (``doc_id``, ``text``, ``path``).

    Spans are in code points; ``digest`` is the SHA-256 of the value, which is not repeated.
    """
    known = statistics(docs)
    context = docs.sparkSession.sparkContext
    model = context.broadcast((known, train(known, findings)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, trees = model.value
        for batch in batches:
            rows, found, x, digests = [], [], [], []
            paths = batch.column("path").to_pylist()
            for row, text in enumerate(batch.column("text").to_pylist()):
                for start, end in candidates(text or ""):
                    rows.append(row)
                    found.append((start, end))
                    x.append(features(text, start, end, paths[row] or "", stats))
                    digests.append(hashlib.sha256(text[start:end].encode()).hexdigest())
            scores = trees.predict(np.array(x, np.float64))
            keep = np.flatnonzero(scores >= threshold)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(pa.array([rows[k] for k in keep], pa.int64())),
                "start": pa.array([found[k][0] for k in keep], pa.int64()), "end": pa.array([found[k][1] for k in keep], pa.int64()),
                "score": pa.array(scores[keep], pa.float64()), "digest": pa.array([digests[k] for k in keep], pa.string()),
            })

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col(path).cast("string").alias("path"))
    return narrow.mapInArrow(run, "doc_id bigint, start bigint, `end` bigint, score double, digest string")
