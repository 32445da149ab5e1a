"""Awkward documents that every operator must bear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size int, h string,"
    " pattern string, slice int, gram string, fp string, words string, path string, copies int, sources string"
)
LONG = "lorem ipsum dolor sit amet " * 9000 + "9" * 3000 + " " + "a" * 5000
TEXTS = [
    (3, "The quick brown fox jumps over the lazy dog near the old mill"), (3, "The quick brown fox jumps over the lazy dog near the old mill"),
    (3, "another text under the same id"), (None, "a text without an id"), (None, None), (7, None), (8, ""), (9, " \n\t "),
    (10, "one"), (11, "one two"), (12, LONG), (-5, "négatif ÉTÉ 中文 😀 İ"), (13, "The quick brown fox jumps over the lazy dog near the old mill"),
    (14, "mail josé@x.org, bob@example.com +1 (555) 010-2030 4111 1111 1111 1111 10.0.0.256 1.2.3.4"),
    (15, 'All rights reserved. CC-BY cc by\nSPDX-License-Identifier: MIT OR GPL-2.0-only\ntoken = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'),
]


def odd_docs(spark: SparkSession) -> DataFrame:
    rows = [
        (i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None, 1.0, 1, "h", "p", 1, "g", "f", "w", "q", 1, "z")
        for k, (i, t) in enumerate(TEXTS)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
