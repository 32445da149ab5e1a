"""``ROW FORMAT DELIMITED`` text: nested values flattened with their own separators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class RowFormat:
    """The clauses of ROW FORMAT DELIMITED with their usual defaults."""

    fields: str = "\x01"
    escape: str = "\\"
    items: str = "\x02"
    keys: str = "\x03"
    lines: str = "\n"
    null: str = "\\N"


# Behind the escape character: a line separator inside a value, and a list without items.
_LINE, _NONE = "l", "e"


def _escaped(text: Column, fmt: RowFormat) -> Column:
    """Escape the escape character and every separator inside a value.

    A reader splits lines before it knows of escapes, so a line separator is not
    written inside a value at all but as a letter behind the escape character.
    """
    specials = [fmt.escape, fmt.fields, fmt.items, fmt.keys]
    for char in dict.fromkeys(specials):
        text = F.replace(text, F.lit(char), F.lit(fmt.escape + char))
    return F.replace(text, F.lit(fmt.lines), F.lit(fmt.escape + _LINE))


def _scalar(value: Column, fmt: RowFormat) -> Column:
    return F.coalesce(_escaped(value.cast("string"), fmt), F.lit(fmt.null))


def _listed(parts: Column, fmt: RowFormat) -> Column:
    """Items in a row; none at all are told from one empty item."""
    joined = F.when(F.size(parts) == 0, F.lit(fmt.escape + _NONE)).otherwise(F.array_join(parts, fmt.items))
    return F.when(parts.isNull(), F.lit(fmt.null)).otherwise(joined)


def _flat(value: Column, kind: T.DataType, fmt: RowFormat) -> Column:
    if isinstance(kind, T.ArrayType):
        parts = F.transform(value, lambda v: _scalar(v, fmt))
        return _listed(parts, fmt)
    if isinstance(kind, T.MapType):
        pairs = F.transform(
            F.map_entries(value),
            lambda e: F.concat(_scalar(e["key"], fmt), F.lit(fmt.keys), _scalar(e["value"], fmt)),
        )
        return _listed(F.sort_array(pairs), fmt)
    return _scalar(value, fmt)


def write_delimited(df: DataFrame, path: str, fmt: RowFormat = RowFormat()) -> None:
    """``INSERT OVERWRITE DIRECTORY path ROW FORMAT DELIMITED …``.

    Arrays and maps of plain values are supported, one level deep; map entries are
    written in sorted order so that the file is reproducible.
    """
    columns = [_flat(F.col(f.name), f.dataType, fmt) for f in df.schema]
    line = F.concat_ws(fmt.fields, *columns)
    df.select(line.alias("value")).write.mode("overwrite").option("lineSep", fmt.lines).text(path)


def read_delimited(spark, path: str, schema: T.StructType, fmt: RowFormat = RowFormat()) -> DataFrame:
    """Read such files back into ``schema``."""
    raw = spark.read.option("lineSep", fmt.lines).text(path)
    cells = _split(F.col("value"), fmt.fields, fmt)
    return raw.select(cells.alias("c")).select(
        *[_value(F.get("c", F.lit(i)), f.dataType, fmt).alias(f.name) for i, f in enumerate(schema)]
    )


def _quoted(text: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in text)


def _split(text: Column, separator: str, fmt: RowFormat) -> Column:
    """Split on separators that are not escaped.

    An escaped separator has an odd run of escape characters before it; the
    pattern consumes whole cells rather than looking back over such a run.
    """
    escape, mark = _quoted(fmt.escape), _quoted(separator)
    # Possessive, so that matching a long cell neither backtracks nor recurses.
    cell = f"((?:[^{escape}{mark}]++|{escape}[\\s\\S])*+)(?:{mark}|$)"
    cells = F.regexp_extract_all(F.concat(text, F.lit(separator)), F.lit(cell), F.lit(1))
    # The pattern matches once more, empty, at the very end of the text.
    return F.slice(cells, F.lit(1), F.size(cells) - 1)


def _unescaped(text: Column, fmt: RowFormat) -> Column:
    """Each escaped character as itself, but for the letter that stands for the line separator."""
    escape = _quoted(fmt.escape)
    # Cut behind every escaped pair, so that a letter behind an escaped escape stays a letter.
    pieces = F.regexp_extract_all(text, F.lit(f"([^{escape}]++|{escape}[\\s\\S])"), F.lit(1))
    plain = F.transform(
        pieces,
        lambda p: F.when(p == fmt.escape + _LINE, F.lit(fmt.lines)).otherwise(
            F.when(p.startswith(fmt.escape), F.substring(p, len(fmt.escape) + 1, 1 << 30)).otherwise(p)
        ),
    )
    return F.when(F.contains(text, F.lit(fmt.escape)), F.array_join(plain, "")).otherwise(text)


def _value(text: Column, kind: T.DataType, fmt: RowFormat) -> Column:
    present = text != F.lit(fmt.null)
    if isinstance(kind, T.ArrayType):
        items = F.when(text == fmt.escape + _NONE, F.array().cast("array<string>")).otherwise(
            _split(text, fmt.items, fmt)
        )
        return F.when(present, F.transform(items, lambda v: _value(v, kind.elementType, fmt)))
    if isinstance(kind, T.MapType):
        items = F.when(text == fmt.escape + _NONE, F.array().cast("array<string>")).otherwise(
            _split(text, fmt.items, fmt)
        )
        pairs = F.transform(items, lambda p: _split(p, fmt.keys, fmt))
        entries = F.transform(
            pairs,
            lambda p: F.struct(
                _value(F.get(p, F.lit(0)), kind.keyType, fmt).alias("key"),
                _value(F.get(p, F.lit(1)), kind.valueType, fmt).alias("value"),
            ),
        )
        return F.when(present, F.map_from_entries(entries))
    return F.when(present, _unescaped(text, fmt)).cast(kind)
