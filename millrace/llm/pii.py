"""Operator 2: personal data in texts: exact patterns and a character tagger.

Base spans are the leftmost non-overlapping matches of four patterns that pass their checks: email
addresses, IP addresses, card numbers and phone numbers. Each is found in time that grows with the text, however
long its runs of digits or letters are.

The method adds what the patterns miss (numbers without a plus sign, other separators, addresses with
letters outside ASCII) by a bidirectional LSTM with CRF transitions over characters. A span that is added must pass an
exact check of its kind, so it holds an ``@`` between word characters with a host of several parts behind it, four numbers
with dots, or a run of digits and marks with nine digits. The tagger reads every such sign with ``MARGIN`` characters
around it, and on to the ends of the words between white space that this would cut, in windows of ``WINDOW`` characters
that overlap by half; what no sign is near cannot hold a span. A number behind a word that
names another kind (``order``, ``invoice``, …) is none of them. A character's scores are the mean over its windows, weighted by how far
inside each it stands, and one decoding of the whole stretch reconciles the windows (one of more than ``SECTION`` characters
is decoded in sections that overlap by more than a span is long). A tagged span counts when it passes its check and
meets no base span, or is of one's kind and longer, with all of it inside: base spans stay beside it.

The tagger is trained on ``examples`` windows with labelled spans, by default drawn by rule and seed.

Null and empty texts have no spans. Repeated rows are tagged each. Empty tables give no rows. Other columns
are not read. Positions are in code points, ends exclusive.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tagger import Tagger

KINDS = ("email", "ip", "card", "phone")
WINDOW, MARGIN = 64, 24
SECTION, OVERLAP = 1024, 128
EXAMPLES, HIDDEN, EPOCHS, SEED = 2400, 20, 10, 17

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT_OR_AT = re.compile(r"[0-9@]")
# What the check of every kind asks for: an address, four numbers with dots, or nine digits among marks.
_ADDRESS = re.compile(r"[\w.%+-]@[\w-]+\.[\w-]|[0-9]++(?:\.[0-9]++){3}")
_RUN = re.compile(r"[0-9][0-9 ()./-]{7,}[0-9]")
_GROUP = re.compile(r"[0-9]+")
# Words that name a number of another kind.
_OTHER_NUMBER = re.compile(r"(?i)(?<![a-z])(?:order|invoice|item|ref|id|case|gps|isbn|version|no|nr)[.:#]{0,2}\s{0,2}$")
_SPACE = re.compile(r"\s")

Span = tuple[int, int, str]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")  # matches and their first parts lie behind ``free``
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end(), "email"
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def _ips(text: str) -> Iterator[Span]:
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, at + size, "ip"
            at += size + 1


def base_spans(text: str) -> list[Span]:
    """By start, then kind in the order of ``KINDS``."""
    spans = list(_emails(text)) + list(_ips(text))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            spans.append((*m.span(), "card"))
    if "+" in text:
        spans += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


# Character numbers: digits, marks of their own, letters by kind, the rest.
_MARKS = "@.-+() _%/:=\"',;\n"
_PAD = 0
_N_CHARACTERS = 2 + len(_MARKS) + 7


def _numbers() -> np.ndarray:
    table = np.full(128, 2 + len(_MARKS) + 6, np.uint8)
    table[[ord(c) for c in string.digits]] = 1
    for k, c in enumerate(_MARKS):
        table[ord(c)] = 2 + k
    for k, letters in enumerate(("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")):
        table[[ord(c) for c in letters]] = 2 + len(_MARKS) + k
    return table


_NUMBERS = _numbers()


def characters(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where(code < 128, _NUMBERS[np.minimum(code, 127)], 2 + len(_MARKS) + 4).astype(np.uint8)


def labelled_windows(count: int, seed: int = SEED) -> Iterator[tuple[str, list[Span]]]:
    """Texts of at most ``WINDOW`` characters and their spans, drawn by rule."""
    rng = np.random.default_rng(seed)

    def some(alphabet: str, low: int, high: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), int(rng.integers(low, high + 1))))

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    letters = string.ascii_lowercase
    wide = letters + "éèüöñçàß"

    def word() -> str:
        w = some(pick(letters, wide), 1, 9)
        return pick(w, w, w, w.capitalize(), w.upper()) + pick("", "", "", "", ",", ".", ".\n", "!!", "***")

    def n(low: int, high: int) -> str:
        return some(string.digits, low, high)

    def card() -> str:
        d = n(11, 18)
        d += next(c for c in string.digits if luhn(d + c))
        mark = pick("", "", " ", "-", ".", "/")
        return mark.join(d[i : i + 4] for i in range(0, len(d), 4))

    def email() -> str:
        host = ".".join(some(pick(letters, letters + string.digits, wide), 2, 8) for _ in range(pick(1, 2, 2, 3)))
        return some(pick(letters, letters + string.digits, wide), 1, 8) + pick("", "", "." + some(letters, 1, 5), "." + n(2, 2), "_" + n(1, 3)) + "@" + host

    def ip() -> str:
        return ".".join(str(int(rng.integers(0, 256))) for _ in range(4))

    def phone() -> str:
        a, b, c = n(3, 3), n(3, 3), n(4, 4)
        if rng.random() < 0.45:  # with a leading zero
            return pick(f"0{n(3, 3)} {n(6, 7)}", f"0{n(2, 2)} {n(7, 8)}", "0" + " ".join([n(1, 1), *(n(2, 2) for _ in range(4))]), f"0{n(2, 2)} {n(4, 4)} {n(4, 4)}")
        return pick(f"+{n(1, 2)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{n(2, 2)} {a} {b} {c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"+{n(10, 13)}")

    def other() -> str:
        return pick(
            n(1, 6), n(7, 11), f"{n(1, 3)}.{n(1, 2)}", f"v{n(1, 1)}.{n(1, 2)}.{n(1, 2)}", f"{n(4, 4)}-{n(2, 2)}-{n(2, 2)}", f"{n(2, 2)}:{n(2, 2)}",
            f"${n(1, 4)}.{n(2, 2)}", f'token = "{some("0123456789abcdef", 20, 40)}"', some(letters + string.digits, 6, 20), f"@{some(letters, 3, 8)}", f"{n(1, 2)} @ {n(1, 2)}",
            f"{n(1, 3)},{n(3, 3)},{n(3, 3)}", f"version {n(1, 1)}.{n(1, 1)}", f"#{n(2, 5)}", f"{n(2, 2)}/{n(2, 2)}/{n(4, 4)}", f"{n(20, 26)}", f"{n(1, 2)} {n(1, 2)} {n(1, 2)}",
            f"{n(1, 2)}.{n(4, 5)} {n(1, 3)}.{n(4, 5)}", f"{n(1, 2)}.{n(4, 5)}, {n(1, 3)}.{n(4, 5)}", f"{n(4, 4)}-{n(2, 2)}-{n(2, 2)} {n(2, 2)}:{n(2, 2)}",
        )

    for _ in range(count):
        if rng.random() < 0.08:  # a text that ends with its one value
            kind, value = pick(("email", email), ("ip", ip), ("card", card), ("phone", phone), ("phone", phone))
            before, value = pick("", "", "(", word() + " "), value()
            yield (before + value)[:WINDOW], [(len(before), min(WINDOW, len(before) + len(value)), kind)]
            continue
        text, spans = "", []
        while len(text) < WINDOW:
            draw = rng.random()
            if draw < 0.3:
                kind, value = pick(("email", email), ("ip", ip), ("card", card), ("phone", phone), ("phone", phone))
                value = value()
                spans.append((len(text), len(text) + len(value), kind))
                text += value + pick("", "", ",", ".", "\n", ")", "###", "%%%")
            else:
                text += other() if draw < 0.5 else word()
            text += " " if text[-1] != "\n" else ""
        # The window begins and ends anywhere, also inside a span: what is cut is still of its kind.
        shift = int(rng.integers(0, len(text) - WINDOW + 1))
        inside = [(max(0, a - shift), min(WINDOW, b - shift), k) for a, b, k in spans if b > shift and a < shift + WINDOW]
        yield text[shift : shift + WINDOW], inside


def states(spans: list[Span]) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    for start, end, kind in spans:
        out[start:end] = 2 + 2 * KINDS.index(kind)
        out[start] -= 1
    return out


def train(examples: int = EXAMPLES, seed: int = SEED) -> Tagger:
    drawn = list(labelled_windows(examples, seed))
    x = np.array([np.pad(characters(t), (0, WINDOW - len(t)), constant_values=_PAD) for t, _ in drawn])
    y = np.array([states(s) for _, s in drawn])
    tagger = Tagger.fresh(_N_CHARACTERS, len(KINDS), HIDDEN, seed)
    return tagger.fit(x, y, EPOCHS, batch=48, rate=0.02, seed=seed).compact()


def signs(text: str) -> list[tuple[int, int]]:
    """Where a span can be: no span that passes its check lies elsewhere."""
    found = [m.span() for m in _ADDRESS.finditer(text)] if "@" in text or "." in text else []
    for m in _RUN.finditer(text):
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in _GROUP.finditer(m[0])]
        # A group beside a letter is part of a longer word; no span has as many as twenty digits in a row.
        if text[max(0, m.start() - 1) : m.start()].isalnum():
            groups[0] = (groups[0][0], groups[0][0] + 20)
        if text[m.end() : m.end() + 1].isalnum():
            groups[-1] = (groups[-1][1] - 20, groups[-1][1])
        digits, first = 0, None
        for a, b in [*groups, (0, 20)]:
            if b - a < 20:
                first = a if first is None else first
                digits, last = digits + b - a, b
                continue
            if digits >= 9:
                found.append((first, last))
            digits, first = 0, None
    return sorted(found)


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Where the tagger reads: ``MARGIN`` characters around every sign of a span, and the whole of words at the edges."""
    start = end = -1
    for first, last in signs(text):
        a, b = max(0, first - MARGIN), min(len(text), last + MARGIN)
        if b <= end:
            continue
        while a > max(0, end) and not text[a - 1].isspace() and not text[a].isspace():
            a -= 1
        if b < len(text) and not text[b - 1].isspace():
            space = _SPACE.search(text, b)
            b = space.start() if space else len(text)
        if a > end:
            if start >= 0:
                yield start, end
            start = a
        end = b
    if start >= 0:
        yield start, end


def _window_starts(n: int) -> list[int]:
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, WINDOW // 2), n - WINDOW]


_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
_WINDOWS = 512  # windows scored at once
_CELLS = 1 << 18  # characters decoded at once, about


def tag(pieces: list[str], tagger: Tagger) -> list[list[Span]]:
    """Spans of each piece, from overlapping windows of it decoded as one."""
    if not pieces:
        return []
    lengths = np.array([len(p) for p in pieces])
    base = np.concatenate(([0], np.cumsum(lengths)))
    flat = np.concatenate([characters(p) for p in pieces] + [np.full(WINDOW, _PAD, np.uint8)])
    first, size = [], []
    for k, n in enumerate(lengths.tolist()):
        for s in _window_starts(n):
            first.append(base[k] + s)
            size.append(min(WINDOW, n))
    first, size = np.array(first), np.array(size)
    sums = np.zeros((len(flat), 1 + 2 * len(KINDS)), np.float32)
    weights = np.zeros(len(flat), np.float32)
    for i in range(0, len(first), _WINDOWS):
        at = first[i : i + _WINDOWS, None] + np.arange(WINDOW)
        inside = np.arange(WINDOW) < size[i : i + _WINDOWS, None]
        scores = tagger.emissions(np.where(inside, flat[np.minimum(at, len(flat) - 1)], _PAD))
        spread = np.broadcast_to(_WEIGHT, at.shape)[inside]
        np.add.at(sums, at[inside], scores[inside] * spread[:, None])
        np.add.at(weights, at[inside], spread)
    sums /= np.maximum(weights, 1e-9)[:, None]
    states = np.zeros(int(base[-1]), np.int8)
    starts, ends, keep, keep_end = _sections(base)
    size = ends - starts
    order, i = np.argsort(size, kind="stable"), 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * size[order[j]] <= _CELLS:
            j += 1
        some = order[i:j]
        at = starts[some][:, None] + np.minimum(np.arange(int(size[some[-1]])), size[some][:, None] - 1)
        for k, row in zip(some.tolist(), tagger.decode(sums[at], size[some]), strict=True):
            states[keep[k] : keep_end[k]] = row[keep[k] - starts[k] : keep_end[k] - starts[k]]
        i = j
    return [_spans(states[a:b]) for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def _sections(base: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where decodings begin and end, and which part of each counts: whole pieces, or sections of long ones."""
    found = []
    for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True):
        for start in range(a, b, SECTION):
            end = min(b, start + SECTION)
            found.append((max(a, start - OVERLAP), min(b, end + OVERLAP), start, end))
    return tuple(np.array(found, np.int64).reshape(-1, 4).T)


def _spans(row: np.ndarray) -> list[Span]:
    spans, start = [], -1
    for t, state in enumerate([*row.tolist(), 0]):
        if start >= 0 and (state == 0 or state % 2 == 1):
            spans.append((start, t, KINDS[(int(row[start]) - 1) // 2]))
            start = -1
        if state % 2 == 1:
            start = t
    return spans


def checked(text: str, start: int, end: int, kind: str) -> Span | None:
    """The span without marks at its ends, if it can be of its kind and is no part of a longer word or number."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    value = text[start:end]
    if text[max(0, start - 1) : start].isalnum() or text[end : end + 1].isalnum():
        return None
    if kind in ("card", "phone") and _OTHER_NUMBER.search(text[max(0, start - 16) : start]):
        return None
    digits = _digits(value)
    if kind == "email":
        local, at, host = value.partition("@")
        fits = bool(at and re.fullmatch(r"[\w.%+-]+", local) and re.fullmatch(r"[\w-]+(?:\.[\w-]+)+", host))
    elif kind == "ip":
        parts = value.split(".")
        fits = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    elif kind == "card":
        fits = 12 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9]+(?:[ ./-][0-9]+)*", value) is not None
    else:
        groups = re.findall("[0-9]+", value)
        fits = 9 <= len(digits) <= 15 and re.fullmatch(r"[+(]?[0-9][ ().0-9-]*", value) is not None and (value[0] in "+(" or 3 <= len(groups) <= 5 or len(groups) == 2 and value[0] == "0")
    return (start, end, kind) if fits else None


def _beside(span: Span, base: Span) -> bool:
    """Whether a span may be added to a base span: apart from it, or longer, of its kind and around it."""
    apart = span[1] <= base[0] or base[1] <= span[0]
    around = span[2] == base[2] and span[0] <= base[0] and base[1] <= span[1] and span[:2] != base[:2]
    return apart or around


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and base and added ones, of every text."""
    base = [base_spans(t) if _DIGIT_OR_AT.search(t) else [] for t in texts]
    places = [(k, a, b) for k, t in enumerate(texts) for a, b in stretches(t)]
    tagged = tag([texts[k][a:b] for k, a, b in places], tagger)
    added: list[list[Span]] = [[] for _ in texts]
    for (k, a, _), spans in zip(places, tagged, strict=True):
        for start, end, kind in spans:
            span = checked(texts[k], a + start, a + end, kind)
            if span and all(_beside(span, other) for other in base[k]):
                added[k].append(span)
    order = lambda s: (s[0], KINDS.index(s[2]))
    return [(b, sorted(b + more, key=order)) for b, more in zip(base, added, strict=True)]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))


def personal_data(docs: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """``doc_id, spans`` of every row of ``docs`` (``doc_id``, ``text``): start, end, kind, and whether a base span."""
    model = docs.sparkSession.sparkContext.broadcast(train(examples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = all_spans([t or "" for t in batch.column("text").to_pylist()], model.value)
            rows = [[{"start": a, "end": b, "kind": k, "base": (a, b, k) in base} for a, b, k in both] for base, both in found]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "spans": pa.array(rows, _SPAN)})

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id bigint, spans array<struct<start: bigint, `end`: bigint, kind: string, base: boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, a checksum of them, and all spans as a string."""
    base = F.filter("spans", lambda s: s["base"])
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
    )
