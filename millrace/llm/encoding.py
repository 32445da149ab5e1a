"""Ids and character offsets of whole texts by a tokenizer of the tokenizers library.

The byte-level pre-tokenizer matches from left to right and looks only ahead. None of
its tokens runs from a character that is not white space into one that is, or from a letter
into an ASCII character that is no letter. So a text may be cut at those places, and the ids
of the pieces, one after the other, are the ids of the whole. Most pieces repeat, and a worker
encodes each distinct one once while it remembers it. A text with white space outside ASCII or with the string
of an added token, and any text under another pre-tokenizer, is encoded uncut; added tokens' strings give their ids, as in
the library.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import regex

from millrace.llm.frames import ragged

_SPACE, _LETTER = r" \t\n\r\f\v", "A-Za-zÀ-ÖØ-öø-ÿ"
_PIECE = re.compile(rf"[{_SPACE}]*(?:[{_LETTER}]+(?=[\x00-@\[-`{{-\x7f]|\Z)|[^{_SPACE}]+)|[{_SPACE}]+")
_OTHER_SPACE = re.compile(rf"[^\S{_SPACE}]")

# Fixed value: the byte-level pre-tokenizer's pattern.
_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

# Pieces and ids a worker remembers before it starts afresh; a bound on memory only.
REMEMBERED_PIECES = 800_000
REMEMBERED_IDS = 8_000_000
CUT_CHARACTERS = 1 << 19  # of the texts whose pieces are held at once


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: itself where it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str):
    """The tokenizer as the library reads it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _can_cut(tokenizer) -> bool:
    made = json.loads(tokenizer.to_str())
    before = made["pre_tokenizer"] or {}
    return (
        made["normalizer"] is None and made["post_processor"] is None and made["model"]["type"] == "BPE"
        and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
    )


class _Growing:
    """A numpy array that grows by doubling."""

    def __init__(self, kind):
        self.values, self.used = np.empty(1 << 16, kind), 0

    def extend(self, more) -> None:
        need = self.used + len(more)
        if need > len(self.values):
            larger = np.empty(max(need, 2 * len(self.values)), self.values.dtype)
            larger[: self.used] = self.values[: self.used]
            self.values = larger
        self.values[self.used : need] = more
        self.used = need


class _Known(dict):
    """Piece -> number; a piece not seen before gets the next number and is noted as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = k = len(self)
        return k


class Encoder:
    """Encodes lists of texts; with ``offsets`` also tells where each token stands."""

    def __init__(self, path: str, offsets: bool = False, remembered: int | None = None):
        self.tokenizer, self.offsets, self.remembered = load(path), offsets, remembered
        self.cut, self.model = _can_cut(self.tokenizer), self.tokenizer.model
        self.added = [t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]]
        self._forget()

    def _forget(self) -> None:
        self.known = _Known()
        self.first, self.count, self.size = _Growing(np.int64), _Growing(np.int32), _Growing(np.int32)
        self.ids, self.begin, self.end = _Growing(np.uint32), _Growing(np.int32), _Growing(np.int32)

    def _has_added(self, text: str) -> bool:
        return any(token in text for token in self.added)

    def _ids(self, piece: str) -> list[int]:
        if self._has_added(piece):  # a text that was not cut
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        ids = []
        for word in _TOKEN.findall(piece):
            letters = word.encode().decode("latin-1").translate(_LETTERS)
            ids += [t.id for t in self.model.tokenize(letters)]
        return ids

    def _learn(self, pieces: list[str]) -> None:
        if self.cut and not self.offsets:
            ids = list(map(self._ids, pieces))
        else:
            encoded = self.tokenizer.encode_batch(pieces, add_special_tokens=False)
            ids = [e.ids for e in encoded]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(counts.sum())
        self.first.extend(self.ids.used + np.cumsum(counts) - counts)
        self.count.extend(counts)
        self.ids.extend(np.fromiter(chain.from_iterable(ids), np.uint32, total))
        if self.offsets:
            self.size.extend(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            spans = [e.offsets for e in encoded]
            flat = np.fromiter(chain.from_iterable(chain.from_iterable(spans)), np.int32, 2 * total)
            self.begin.extend(flat[::2])
            self.end.extend(flat[1::2])

    def __call__(self, texts: list[str]):
        """Ids of all texts in a row and each text's number of ids; with offsets, also where each
        token begins and ends in its text, in code points.

        Texts of about ``CUT_CHARACTERS`` are cut at a time: their pieces, many times their size, are gone before
        the next ones are made."""
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        last = np.flatnonzero(np.diff(ends // CUT_CHARACTERS)) + 1
        parts = [self._encoded(texts[a:b]) for a, b in zip([0, *last.tolist()], [*last.tolist(), len(texts)], strict=True)]
        return tuple(map(np.concatenate, zip(*parts, strict=True))) if len(parts) > 1 else parts[0]

    def _encoded(self, texts: list[str]):
        if len(self.known) > (self.remembered or REMEMBERED_PIECES) or self.ids.used > REMEMBERED_IDS:
            self._forget()
        whole = [
            not self.cut or not t.isascii() and _OTHER_SPACE.search(t) is not None or self._has_added(t) for t in texts
        ]
        cut = [[t] if w else _PIECE.findall(t) for t, w in zip(texts, whole, strict=True)]
        per_text = np.fromiter(map(len, cut), np.int64, len(cut))
        k = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(per_text.sum()))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        counts = self.count.values[k].astype(np.int64)
        at = ragged(self.first.values[k], counts)
        ids = self.ids.values[at]
        ends = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(per_text)))]
        n_ids = np.diff(ends)
        if not self.offsets:
            return ids, n_ids
        sizes = self.size.values[k].astype(np.int64)
        before = np.concatenate(([0], np.cumsum(sizes)))
        shift = np.repeat(before[:-1] - np.repeat(before[np.cumsum(per_text) - per_text], per_text), counts)
        return ids, n_ids, self.begin.values[at] + shift, self.end.values[at] + shift


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, offsets: bool = False, remembered: int | None = None) -> Encoder:
    """This worker's encoder: what it remembers serves its later tasks too."""
    key = path, offsets, remembered
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
