"""Operator 11: a Merkle tree over a dataset, with the proof of every row, by DataFrame functions alone.

A row's leaf is the digest of its fields, each with its length. Within a part (a source), leaves ascend by id;
while several nodes remain, every ``FANOUT`` consecutive ones become the digest of theirs. The last one is the part's
subroot, and the subroots, ordered by part, make the dataset's root in the same way.

1. Leaves are written, sorted by range and numbered: a row's rank is its place in its piece and the rows of its part in
   earlier pieces, so no part is in one task, however large.
2. Ranks are split in digits. Within blocks of ``FANOUT ** DIGITS`` leaves the digit columns are grouped away, one
   after the other: children become an array in a struct of their parent, next to its digest. All groupings of a
   block follow one exchange, and a block never holds more than its leaves. The digests of the blocks are the leaves
   of the next tier, until every part has one block.
3. From the top tier down, a block's row and the row of its own proof meet in one grouping, and its nested arrays
   are unnested level by level: each child gets what stands left and right of it among its siblings.

Ids that repeat are ordered by leaf, rows alike in all fields are leaves of their own. Null fields have a mark of their
own, null ids come first, rows without a part are a part, ordered first. Null and empty texts differ. Empty
tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import numbered, written

FANOUT, DIGITS = 16, 2
BLOCK = FANOUT**DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of texts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: Sequence[Column]) -> Column:
    texts = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def blocks(nodes: DataFrame) -> DataFrame:
    """``part, size, block, kids, hash`` of every block of ``nodes`` (``part, size, rank, hash`` and what a leaf carries)."""
    carried = [c for c in nodes.columns if c not in ("part", "size", "rank", "hash")]
    digits = [f"digit{k}" for k in range(DIGITS)]
    split = {f"digit{k}": F.expr(f"rank div {FANOUT**k} % {FANOUT}") for k in range(DIGITS)}
    rows = nodes.withColumns(split | {"block": F.expr(f"rank div {BLOCK}")}).repartition("part", "block")
    for k, digit in enumerate(digits):
        kid = F.struct(F.col(digit).alias("digit"), "hash", *(carried if k == 0 else ["kids"]))
        rows = rows.groupBy("part", "size", "block", *digits[k + 1 :]).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        joined = digest(F.array_join("kids.hash", ""))
        rows = rows.withColumn("hash", F.when(F.col("size") > FANOUT**k, joined).otherwise(F.get("kids.hash", F.lit(0))))
    return rows


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """The written blocks of ``nodes``, the blocks of those, and so on; in the last one every part has one."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    found = [written(blocks(nodes), "merkle-blocks")]
    while largest > BLOCK:
        largest = -(-largest // BLOCK)
        size = F.expr(f"(size + {BLOCK - 1}) div {BLOCK}")
        above = found[-1].select("part", size.alias("size"), F.col("block").alias("rank"), "hash")
        found.append(written(blocks(above), "merkle-blocks"))
    return found


_BESIDE = "array<struct<left: string, right: string>>"


def proven(found: list[DataFrame], paths: DataFrame) -> DataFrame:
    """``part, rank, kid, path`` of every leaf below ``found``, and the other columns of ``paths``.

    ``paths``: ``part``, ``path`` (what stands beside the part's last node, level by level) and more.
    """
    more = [c for c in paths.columns if c not in ("part", "path")]
    paths = paths.withColumn("rank", F.lit(0).cast("bigint"))
    for tier in reversed(found):
        known = paths.select("part", F.col("rank").alias("block"), F.struct("path", *more).alias("above"))
        both = tier.select("part", "block", F.struct("size", "kids").alias("below"))
        both = both.unionByName(known, allowMissingColumns=True)
        met = both.groupBy("part", "block").agg(F.first("below", True).alias("below"), F.first("above", True).alias("above"))
        rows = met.select("part", F.col("block").alias("rank"), "below.size", "below.kids", "above.*")
        for k in reversed(range(DIGITS)):
            beside = F.struct(
                F.array_join(F.slice("hashes", 1, F.col("pos")), "").alias("left"),
                F.array_join(F.slice("hashes", F.col("pos") + 2, FANOUT), "").alias("right"),
            )
            rows = rows.select("part", "rank", "size", "path", *more, F.col("kids.hash").alias("hashes"), F.posexplode("kids").alias("pos", "kid"))
            path = F.when(F.col("size") > FANOUT**k, F.concat(F.array(beside), "path")).otherwise(F.col("path"))
            rank = F.col("rank") * FANOUT + F.col("kid.digit")
            rows = rows.select("part", rank.alias("rank"), "size", path.alias("path"), *more, *(["kid.kids"] if k else ["kid"]))
        paths = rows.drop("size")
    return paths


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and what stands beside it on its way up."""
    return F.aggregate(path, leaf, lambda below, p: digest(p["left"], below, p["right"]))


def _part(source: Column) -> Column:
    """A part's name that is never null and sorts as the parts do, null first."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_: str = "doc_id", part: str = "source", **carried: Column) -> DataFrame:
    """``id, part, leaf, subroot, root, path`` of every row, and ``carried``, other columns worked out of ``docs``.

    ``path`` has what stands left and right of the row's node on every level, from its leaf to the root.
    """
    made = {"id": F.col(id_), "part": _part(F.col(part)), "hash": leaf([F.col(f) for f in fields])} | carried
    leaves = written(docs.select(*(c.alias(name) for name, c in made.items())), "merkle-leaves")
    lower = tiers(numbered(leaves, "part", ["id", "hash"]))
    subroots = lower[-1].select(F.lit("").alias("part"), "hash", F.col("part").alias("name"))
    upper = tiers(numbered(subroots, "part", ["name"]))
    top = upper[-1].select("part", F.array().cast(_BESIDE).alias("path"), F.col("hash").alias("root"))
    parts = proven(upper, top).select(F.col("kid.name").alias("part"), "path", "root", F.col("kid.hash").alias("subroot"))
    rows = proven(lower, parts)
    source = F.when(F.col("part") != "", F.expr("substring(part, 2)"))
    return rows.select("kid.id", source.alias("part"), F.col("kid.hash").alias("leaf"), "subroot", "root", "path", *(f"kid.{c}" for c in carried))


def tampered(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def audit(docs: DataFrame) -> DataFrame:
    """Every row's place in the tree, and whether it still verifies once every fifth id's text has lost its capitals."""
    named = {"doc_id": "bigint", "source": "string", "lang": "string", "n_chars": "bigint", "text": "string"}
    docs = docs.select(*(F.col(c).cast(kind) for c, kind in named.items()))
    touched = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = leaf([tampered(F.col(f)) if f == "text" else F.col(f) for f in FIELDS])
    rows = manifest(docs, changed=F.when(touched, changed))
    beside = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    now = F.coalesce("changed", "leaf")
    found = rows.withColumns({"proof_sha256": F.sha2(beside, 256), "folded_root": folded(now, F.col("path"))})
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _tree_sql(name: str, levels: int) -> list[str]:
    """Levels of a tree over ``{name}0`` (``k, n, r, h``), what stands beside each node, and the last node of each part."""
    parts = []
    for j in range(levels):
        size = FANOUT**j
        if j:
            parts.append(
                f"{name}{j} AS (SELECT k, n, r // {FANOUT} AS r, sha256(string_agg(h, '' ORDER BY r)) AS h"
                f" FROM {name}{j - 1} WHERE n > {size // FANOUT} GROUP BY k, n, r // {FANOUT})"
            )
        sides = [
            f"coalesce(string_agg(h, '') OVER (PARTITION BY k, r // {FANOUT} ORDER BY r ROWS BETWEEN {rows}), '') AS {side}"
            for side, rows in (("lft", "UNBOUNDED PRECEDING AND 1 PRECEDING"), ("rgt", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))
        ]
        parts.append(f"{name}{j}s AS (SELECT k, r, {', '.join(sides)} FROM {name}{j} WHERE n > {size})")
    last = " UNION ALL ".join(
        f"SELECT k, h FROM {name}{j} WHERE n <= {FANOUT**j}" + (f" AND n > {FANOUT ** (j - 1)}" if j else "") for j in range(levels)
    )
    return [*parts, f"{name}_last AS ({last})"]


def _climb_sql(name: str, levels: int, start: str) -> list[str]:
    """``{start}`` (``k, r, proof, fold``) carried up the tree of ``name``, level by level; the last is ``{start}{levels}``."""
    parts = [f"{start}0 AS (SELECT * FROM {start})"]
    for j in range(levels):
        parts.append(
            f"{start}{j + 1} AS (SELECT a.* EXCLUDE (proof, fold), proof || coalesce(lft || rgt, '') AS proof,"
            f" CASE WHEN lft IS NULL THEN fold ELSE sha256(lft || fold || rgt) END AS fold"
            f" FROM {start}{j} a LEFT JOIN {name}{j}s s ON a.k IS NOT DISTINCT FROM s.k AND a.r // {FANOUT**j} = s.r)"
        )
    return parts


def audit_sql(levels: int = 7) -> str:
    """DuckDB SQL for the rows of ``audit``, for parts of up to ``FANOUT ** (levels - 1)`` rows."""

    def leaf_sql(text: str) -> str:
        fields = [f"CAST({f} AS VARCHAR)" for f in FIELDS[:-1]] + [text]
        return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"

    # Bit by bit: a digit is mixed in, then eight shifts (marked -1), each with the polynomial if a one falls out.
    steps = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda c, x: {step}), 4294967295)"
    lowered = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    parts = [
        f"leaves AS (SELECT doc_id, source, {leaf_sql('text')} AS leaf,"
        f" CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf_sql(lowered)} END AS changed FROM documents)",
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,"
        " count(*) OVER (PARTITION BY source) AS n FROM leaves)",
        "d0 AS (SELECT source AS k, n, r, leaf AS h FROM numbered)",
        *_tree_sql("d", levels),
        "u0 AS (SELECT 0 AS k, count(*) OVER () AS n, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS r, h, k AS source FROM d_last)",
        *_tree_sql("u", levels),
        "low AS (SELECT doc_id, leaf, source AS k, r, '' AS proof, coalesce(changed, leaf) AS fold FROM numbered)",
        *_climb_sql("d", levels, "low"),
        f"high AS (SELECT doc_id, leaf, 0 AS k, u0.r, u0.h AS subroot, proof, fold FROM low{levels} a JOIN u0 ON a.k IS NOT DISTINCT FROM u0.source)",
        *_climb_sql("u", levels, "high"),
    ]
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root,"
        f" fold = h AS verified FROM high{levels}, u_last"
    )
