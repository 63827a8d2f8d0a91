"""Named conversions: column to column, by the short names that users bind to keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from hanweave.functions import charsets, convert, markup
from hanweave.operators.dictionary import Compiled

Action = Callable[[Column], Column]

#: (written as, read as) of the plain transcoders; None is the default charset.  Fixed values.
TRANSCODERS = {
    "zb1": ("gbk", None), "zb2": ("big5", None), "zb3": ("shift-jis", None),
    "zb4": (None, "gbk"), "zb5": (None, "big5"), "zb6": (None, "shift-jis"),
    "zc1": ("gbk", "shift-jis"), "zc2": ("big5", "shift-jis"), "zc3": ("shift-jis", "gbk"), "zc4": ("shift-jis", "big5"),
    "zd1": ("gbk", "hz-gb-2312"), "zd2": ("big5", "hz-gb-2312"), "zd3": ("hz-gb-2312", "gbk"), "zd4": ("hz-gb-2312", "big5"),
}


def registry(words_s2t: Compiled | None = None, words_t2s: Compiled | None = None, default: str = "big5") -> dict[str, Action]:
    """All actions; vocabularies and the default charset are arguments, not global state."""
    found: dict[str, Action] = {
        "0": lambda c: c,
        "a1": lambda c: convert.convert_between(c, "gbk", "big5", convert.TO_TRADITIONAL, words_s2t),
        "a2": lambda c: convert.convert_between(c, "big5", "gbk", convert.TO_SIMPLIFIED, words_t2s),
        "a3": lambda c: convert.convert(c, convert.TO_TRADITIONAL, words_s2t),
        "a4": lambda c: convert.convert(c, convert.TO_SIMPLIFIED, words_t2s),
        "za1": markup.decimal_references,
        "za2": markup.hex_references,
        "za3": markup.decoded_references,
        "ze1": convert.full_width,
        "ze2": convert.half_width,
    }
    for name, (a, b) in TRANSCODERS.items():
        found[name] = lambda c, a=a, b=b: charsets.reinterpret(c, a or default, b or default)
    return found


def apply(rows: DataFrame, name: str, column: str, **options) -> DataFrame:
    """``rows`` with one column converted by a named action."""
    known = registry(**options)
    if name not in known:
        raise ValueError(f"unknown action: {name}")
    return rows.withColumn(column, known[name](rows[column]))
