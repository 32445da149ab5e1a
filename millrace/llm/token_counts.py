"""Operator 3: tokens of each field and section of documents, each document encoded once and whole.

A document's fields are joined by a separator, which counts with the field before it, and encoded
as one text. The tokens' character spans are joined to the spans of the sections (the lines of each
field, a line break counting with the line it ends) by binary search over the sections' starts. A token that
crosses a boundary goes, whole, to the section that holds most of its characters, to the earliest on a
tie; one without characters goes where it begins. So the sections' tokens add up to the document's.

Null fields are empty and keep their place. An empty field has one empty section. Repeated rows are counted each.
Empty tables give no rows. Only ``doc_id`` and the named fields are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.encoding import default_vocabulary, encoder
from millrace.llm.frames import list_column

_COUNTS = "doc_id bigint, field string, n_tokens bigint, n_crossing bigint, section_tokens array<bigint>"


def section_starts(fields: Sequence[str], separator: str) -> tuple[str, list[int], list[int]]:
    """The joined text, where each section starts, and how many sections each field has."""
    starts, counts, at = [], [], 0
    for k, value in enumerate(fields):
        here = [at]
        found = value.find("\n")
        while 0 <= found < len(value) - 1:
            here.append(at + found + 1)
            found = value.find("\n", found + 1)
        starts += here
        counts.append(len(here))
        at += len(value) + (len(separator) if k < len(fields) - 1 else 0)
    return separator.join(fields), starts, counts


def attribute(begin: np.ndarray, end: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's section by the rule of the module, and whether it crosses a boundary. ``starts`` ascend."""
    # Of sections that start at one place all but the last are empty, and hold no characters.
    first = np.searchsorted(starts, begin, side="right") - 1
    last = np.maximum(first, np.searchsorted(starts, end - 1, side="right") - 1)
    owner = first.copy()
    for t in np.flatnonzero(last > first):
        edges = np.clip(starts[first[t] : last[t] + 2], begin[t], end[t])
        if last[t] + 1 == len(starts):
            edges = np.append(edges, end[t])
        owner[t] += int(np.argmax(np.diff(edges)))
    return owner, last > first


def token_counts(
    docs: DataFrame, fields: Sequence[str] = ("source", "lang", "text"), separator: str = "\n", vocabulary: str | None = None
) -> DataFrame:
    """``doc_id, field, n_tokens, n_crossing, section_tokens``: a row for each field of each row of ``docs``.

    ``n_crossing`` counts the field's tokens that cross a section's boundary.
    """
    vocabulary, names = vocabulary or default_vocabulary(), list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, offsets=True)
        for batch in batches:
            columns = [[v or "" for v in batch.column(f"f{k}").to_pylist()] for k in range(len(names))]
            texts, starts, counts, size = [], [], [], 0
            for values in zip(*columns, strict=True):
                text, own, n = section_starts(values, separator)
                texts.append(text)
                starts.append(np.array(own, np.int64) + size)
                counts += n
                size += len(text) + 1  # texts lie one after the other, a place apart
            if not texts:
                continue
            _, n_ids, begin, end = encode(texts)
            base = np.repeat([s[0] for s in starts], n_ids)
            all_starts, n_sections = np.concatenate(starts), np.array(counts, np.int64)
            owner, crosses = attribute(begin + base, end + base, all_starts)
            tokens = np.bincount(owner, minlength=len(all_starts))
            crossing = np.bincount(owner[crosses], minlength=len(all_starts))
            firsts = np.cumsum(n_sections) - n_sections
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(texts)), len(names)))),
                "field": pa.array(names * len(texts)),
                "n_tokens": pa.array(np.add.reduceat(tokens, firsts)),
                "n_crossing": pa.array(np.add.reduceat(crossing, firsts)),
                "section_tokens": list_column(tokens, n_sections, pa.int64()),
            })

    narrow = docs.select(
        F.col("doc_id").cast("bigint"), *[F.col(name).cast("string").alias(f"f{k}") for k, name in enumerate(names)]
    )
    return narrow.mapInArrow(run, _COUNTS)
