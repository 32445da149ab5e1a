"""Operator 13: stretches of a text's words that repeat with a period, from an enhanced suffix array.

A run is a maximal stretch of consecutive words whose smallest period is ``q`` and whose length is
at least ``min_words`` and ``min_exponent * q``. Texts are worked off together, about a megabyte at a time:

1. Every distinct word of a text is a symbol of its own, so suffixes of two texts share nothing. Prefix
   doubling sorts all suffixes; only those not yet told apart are sorted again. The ranks after each doubling
   are kept: equal ranks at level ``t`` mean ``2 ** t`` equal words.
2. Longest common prefixes of neighbours follow from those ranks. Every place of the array where neighbours share
   ``d`` words parts an interval of depth ``d`` in two children, whose ends are the nearest places that share less;
   no tree is built.
3. Suffixes ``i`` of the smaller child look up the ranks of ``i + d`` and ``i - d``: if one lies in the other
   child, a square of period ``d`` that no word extends to the right begins there. Each suffix is in the smaller
   child at most log(n) times.
4. Squares that reach far enough to the left are rotated to the left as far as their period holds. Those that end up
   as the same stretch are one run, with the smallest of their periods.

Words are what stands between ASCII white space, compared exactly. Null and empty texts have no words and no runs;
repeated rows and null ids are worked off each; empty tables give no rows. Other columns are not read.
A text needs about ``4 log2(n) + 100`` bytes a word while it is worked on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import ragged
from millrace.llm.words import groups, symbols

MIN_WORDS, MIN_EXPONENT = 6, 4
# Suffixes of smaller children looked up at a time; a bound on memory only.
LOOKED_UP = 1 << 20


@dataclass
class SuffixArray:
    """Suffixes of all texts in order; ``ranks[t]`` orders them by their first ``2 ** t`` words."""

    ends: np.ndarray  # of the text of each word
    order: np.ndarray
    rank: np.ndarray
    ranks: np.ndarray

    @property
    def levels(self) -> int:
        return len(self.ranks)

    def equal(self, t, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether ``2 ** t`` words from ``a`` and from ``b`` on are the same (``a`` and ``b`` differ)."""
        return self.ranks[t, a] == self.ranks[t, b]


def suffix_array(symbol: np.ndarray, ends: np.ndarray) -> SuffixArray:
    n = len(symbol)
    sizes = np.bincount(symbol) if n else np.zeros(0, np.int64)
    rank = (np.cumsum(sizes) - sizes)[symbol]
    open_ = np.flatnonzero(sizes[symbol] > 1)
    ranks, step = [], 1
    while len(open_):
        ranks.append(rank.astype(np.int32))
        after = open_ + step
        inside = after < ends[open_]
        after[~inside] = 0
        key = rank[open_] * (n + 1) + np.where(inside, rank[after] + 1, 0)
        by_key = np.argsort(key, kind="stable")
        key, open_ = key[by_key], open_[by_key]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        old = key[starts] // (n + 1)  # the rank of the group each new group is cut from
        first = np.ones(len(old), bool)
        first[1:] = old[1:] != old[:-1]
        group_start = starts[np.flatnonzero(first)][np.cumsum(first) - 1]
        sizes = np.diff(np.append(starts, len(key)))
        rank[open_] = np.repeat(old + starts - group_start, sizes)
        open_ = np.sort(open_[np.repeat(sizes > 1, sizes)])
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return SuffixArray(ends, order, rank, np.array(ranks, np.int32).reshape(len(ranks), n))


def common_prefixes(sa: SuffixArray) -> np.ndarray:
    """Words that each suffix shares with the one before it in the order."""
    n = len(sa.order)
    common = np.zeros(n, np.int64)
    if not sa.levels:
        return common
    before, own = sa.order[:-1], sa.order[1:]
    at = np.flatnonzero(sa.equal(0, before, own))
    shared, climbing = [], at
    for t in range(sa.levels):  # those that share 2 ** t words, fewer at each level
        climbing = climbing[sa.equal(t, before[climbing], own[climbing])]
        shared.append(climbing)
    for t in reversed(range(sa.levels)):
        # Words known to be shared so far are a multiple of 2 ** (t + 1), none where fewer than 2 ** t are.
        at = shared[t]
        a, b = before[at] + common[at + 1], own[at] + common[at + 1]
        inside = np.maximum(a, b) < sa.ends[own[at]]
        at, a, b = at[inside], a[inside], b[inside]
        common[at[sa.equal(t, a, b)] + 1] += 1 << t
    return common


def _least(common: np.ndarray, reach: int) -> list[np.ndarray]:
    """Smallest value of the ``2 ** t`` values from each place on, for every ``2 ** t`` up to ``reach``."""
    out = [common]
    while (1 << len(out)) <= reach:
        half = 1 << (len(out) - 1)
        low = out[-1].copy()
        low[:-half] = np.minimum(low[:-half], out[-1][half:])
        out.append(low)
    return out


def child_ends(common: np.ndarray, places: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the children left and right of ``places`` begin and end: the nearest place before that shares no
    more words, and the nearest behind that shares fewer. ``reach``: suffixes of the longest text."""
    padded = np.append(common, -1)
    low = _least(padded, reach)
    depth = common[places]
    begin, stop = places.copy(), places + 1
    for t in reversed(range(len(low))):
        size = 1 << t
        far = np.flatnonzero(begin >= size)
        far = far[low[t][begin[far] - size] > depth[far]]
        begin[far] -= size
        near = np.flatnonzero(stop + size <= len(padded))
        near = near[low[t][stop[near]] >= depth[near]]
        stop[near] += size
    return begin - 1, stop


def _branching(sa: SuffixArray, common: np.ndarray, min_words: int, min_exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First word and period of squares that no word extends to the right, in texts long enough for a run."""
    starts = np.zeros(len(sa.ends), np.int64)  # of the text of each word
    change = np.flatnonzero(np.diff(sa.ends)) + 1
    starts[change] = change
    starts = np.maximum.accumulate(starts)
    length = sa.ends - starts
    of = sa.order
    places = np.flatnonzero((common > 0) & (np.maximum(min_exponent * common, min_words) <= length[of]))
    if not len(places):
        return
    begin, stop = child_ends(common, places, int(length.max()))
    left = places - begin <= stop - places
    small, size = np.where(left, begin, places), np.where(left, places - begin, stop - places)
    other, other_end = np.where(left, places, begin), np.where(left, stop, places)
    ends = np.cumsum(size)
    first = 0
    while first < len(places):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + LOOKED_UP, side="right")))
        part, first = slice(first, last), last
        n = size[part]
        i = of[ragged(small[part], n)]
        d, low, high = (np.repeat(v[part], n) for v in (common[places], other, other_end))
        for shift in (0, -1):  # the suffix is the first half of the square, or the second
            start = i + shift * d
            there = i + d if shift == 0 else start
            known = (there >= 0) & (there < len(of))
            at = sa.rank[np.where(known, there, 0)]
            found = known & (at >= low) & (at < high)
            yield start[found], d[found]


def runs(symbol: np.ndarray, ends: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT):
    """First word, length and period of every run, by first word and period; words are counted over all texts.

    ``symbol``: a number for every word, no two texts sharing any; ``ends``: the end of each word's text.
    """
    sa = suffix_array(symbol, ends)
    none = np.zeros(0, np.int64)
    found = [(none, none, none)]
    if sa.levels:
        for start, d in _branching(sa, common_prefixes(sa), min_words, min_exponent):
            found.append(_rotated(sa, start, d, min_words, min_exponent))
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    one = np.ones(len(by), bool)  # of the squares of one stretch, that with the smallest period
    one[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, length, period = start[one], (end - start)[one], period[one]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _rotated(sa: SuffixArray, start: np.ndarray, d: np.ndarray, min_words: int, min_exponent: int):
    """First word, end and period of the stretches that squares reach to the left, those long enough."""
    end = start + 2 * d
    first = end - min_exponent * d
    inside = first >= 0
    inside[inside] = sa.ends[first[inside]] == sa.ends[start[inside]]
    first, end, d = first[inside], end[inside], d[inside]
    # ``same`` words must repeat after ``d``: two blocks of 2 ** t words cover them.
    same = (min_exponent - 1) * d
    t = np.frexp(same)[1].astype(np.int64) - 1
    low = t < sa.levels
    first, end, d, same, t = first[low], end[low], d[low], same[low], t[low]
    tail = first + same - (1 << t)
    holds = sa.equal(t, first, first + d) & sa.equal(t, tail, tail + d)
    first, end, d = first[holds], end[holds], d[holds]
    for t in reversed(range(sa.levels)):
        back = first - (1 << t)
        can = back >= 0
        can[can] = sa.ends[back[can]] == sa.ends[first[can]]
        can[can] = sa.equal(t, back[can], back[can] + d[can])
        first[can] = back[can]
    long = end - first >= np.maximum(min_words, min_exponent * d)
    return first[long], end[long], d[long]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_FOUND = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def scan(texts: list[bytes], min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT):
    """Of each text: its number of words, its runs, and its words without the repeats of runs, joined by spaces."""
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    text_ends = np.cumsum(counts)
    start, length, period = runs(symbols(words), np.repeat(text_ends, counts), min_words, min_exponent)
    covered = np.zeros(int(counts.sum()) + 1, np.int64)
    np.add.at(covered, start + period, 1)
    np.add.at(covered, start + length, -1)
    kept = np.cumsum(covered)[:-1] == 0
    edges = np.searchsorted(start, np.concatenate((text_ends - counts, text_ends[-1:])))
    out = []
    for k, (own, begin) in enumerate(zip(words, (text_ends - counts).tolist(), strict=True)):
        a, b = edges[k], edges[k + 1]
        found = list(zip((start[a:b] - begin).tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))
        if found:
            own = [own[i] for i in np.flatnonzero(kept[begin : begin + len(own)]).tolist()]
        out.append((int(counts[k]), found, b" ".join(own)))
    return out


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs`` (``doc_id``, ``text``).

    ``runs`` by start, then period; ``collapsed`` has the words that no run covers after its first period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            found = list(chain.from_iterable(scan(group, min_words, min_exponent) for group in groups(texts)))
            named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in f[1]] for f in found]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_words": pa.array([f[0] for f in found], pa.int64()),
                "runs": pa.array(named, _RUNS), "collapsed": pa.array([f[2].decode() for f in found], pa.string()),
            })

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, _FOUND)


def with_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of ``docs``, the words of every tenth document made periodic from some word on.

    The place and the period follow from the crc32 of the id; rows without an id stay as they are.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumn("words", F.when(h % 10 == 0, F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")))
    n, g = F.size("words").cast("bigint"), F.expr("crc32(cast(doc_id AS string)) div 10")
    placed = chosen.withColumns({"n": n, "a": F.when(n > 0, g % n), "g": g})
    placed = placed.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    unit = F.expr("slice(words, cast(a + 1 AS int), cast(p AS int))")
    times = F.expr("cast((n - a) div p + 1 AS int)")
    head, tail = F.expr("slice(words, 1, cast(a AS int))"), F.flatten(F.array_repeat(unit, times))
    periodic = F.array_join(F.slice(F.concat(head, tail), F.lit(1), F.col("n").cast("int")), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


def _stronger(a: Column, b: Column) -> Column:
    """-1 where run ``a`` repeats more often than ``b``, exactly; ties by start, then period."""
    difference = b["length"] * a["period"] - a["length"] * b["period"]
    by = F.when(difference != 0, difference).when(a["start"] != b["start"], a["start"] - b["start"])
    return F.signum(by.otherwise(a["period"] - b["period"])).cast("int")


def digest(found: DataFrame) -> DataFrame:
    """The number of runs, the one that repeats most often, and checksums of runs and collapsed text."""
    best = F.get(F.array_sort("runs", _stronger), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit("\n"))), "")
    named = found.withColumns({"best": best, "runs_text": text})
    return named.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("runs_text", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
