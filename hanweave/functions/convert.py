"""Simplified and Traditional conversion of text columns."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hanweave.functions import charsets, tables
from hanweave.functions.binding import bind
from hanweave.operators.dictionary import Compiled, marked_replaced, quoted, replace_words, token_pattern

NONE, TO_TRADITIONAL, TO_SIMPLIFIED = 0, 1, 2


def sinified(text: Column) -> Column:
    """Latin letters as Chinese characters, to make Chinese test data from any text."""
    return F.translate(F.lower(text), tables.LATIN, tables.SINIFIED)


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"[^\s\u0085   -     　]")


#: Noncharacters that stand for reserved words while characters are mapped.
_HELD = [chr(0x10FFFE - 0x10000 * i + j) for i in range(16) for j in range(2)] + [chr(c) for c in range(0xFDD3, 0xFDF0)]


def _mapped(text: Column, pairs: tuple[str, str], reserved: Sequence[str]) -> Column:
    """Characters by table; reserved words, found in one pass, are held as one sign each meanwhile."""
    if not reserved:
        return F.translate(text, *pairs)
    kept = F.array(*[F.lit(w) for w in reserved])
    signs = _HELD[: len(reserved)]

    def by_token(t: Column) -> Column:
        tokens = F.regexp_extract_all(t, F.lit(token_pattern(reserved)), F.lit(1))
        return F.array_join(F.transform(tokens, lambda x: F.when(F.array_contains(kept, x), x).otherwise(F.translate(x, *pairs))), "")

    def either(t: Column) -> Column:
        held = F.translate(marked_replaced(t, list(zip(reserved, signs))), *pairs)
        for word, sign in zip(reserved, signs):
            held = F.replace(held, F.lit(sign), F.lit(word))
        taken = functools.reduce(operator.or_, [F.contains(t, F.lit(sign)) for sign in signs])
        return F.when(taken, by_token(t)).otherwise(held)

    return bind(text, either if len(reserved) <= len(_HELD) else by_token)


def to_traditional(text: Column, reserved: Sequence[str] = ()) -> Column:
    """Character by character, of the same length; reserved words stay."""
    return _mapped(text, tables.simplified_to_traditional(), reserved)


def to_simplified(text: Column, reserved: Sequence[str] = ()) -> Column:
    return _mapped(text, tables.traditional_to_simplified(), reserved)


def convert(text: Column, direction: int, words: Compiled | None = None) -> Column:
    """Vocabulary first where one is given, then characters; blank text stays as it is."""
    if direction == NONE:
        return text
    reserved = words.reserved if words else ()

    def whole(t: Column) -> Column:
        out = replace_words(t, words) if words else t
        return to_traditional(out, reserved) if direction == TO_TRADITIONAL else to_simplified(out, reserved)

    if words is None:
        return F.when(blank(text), text).otherwise(whole(text))
    return bind(text, lambda t: F.when(blank(t), t).otherwise(whole(t)))


def convert_between(text: Column, source: str, target: str, direction: int, words: Compiled | None = None) -> Column:
    """Conversion and re-reading in another charset; to Traditional the re-reading comes first."""
    read = lambda c: charsets.reinterpret(c, target, source)
    out = convert(read(text), direction, words) if direction == TO_TRADITIONAL else read(convert(text, direction, words))
    return F.when(blank(text), text).otherwise(out)


def convert_file(text: Column, source: str, target: str, direction: int, words: Compiled | None = None, default: str = "big5") -> Column:
    """Text of a file for a target charset.

    Without a direction, characters that the target can't hold become Traditional first.
    A Unicode target, the source's own charset or the default needs no re-reading.
    """
    if direction == NONE:
        pairs = tables.simplified_to_traditional()
        kept = F.transform(F.split(text, ""), lambda c: F.when(charsets.round_trips(c, target), c).otherwise(F.translate(c, *pairs)))
        text = F.when(blank(text), text).otherwise(F.array_join(kept, ""))
    plain = {"UTF-8", "UTF-16LE", "UTF-16BE", charsets.canonical(default), charsets.canonical(source)}
    if charsets.canonical(target) in plain:
        return convert(text, direction, words)
    return convert_between(text, default, target, direction, words)


def full_width(text: Column) -> Column:
    return F.translate(text, tables.HALF, tables.FULL)


def half_width(text: Column) -> Column:
    return F.translate(text, tables.FULL, tables.HALF)


def replaced_in_order(text: Column, before: Sequence[tuple[str, str]], after: Sequence[tuple[str, str]], protect: Sequence[str], inner) -> Column:
    """``inner`` between two lists of replacements, with protected words left as they are by all three.

    Each list is one pass in its own order.  Protected words stand apart: what is between
    them is converted by itself.
    """

    def whole(t: Column) -> Column:
        out = marked_replaced(t, list(before)) if before else t
        out = inner(out)
        return marked_replaced(out, list(after)) if after else out

    if not protect:
        return whole(text)
    words = sorted(protect, key=lambda w: -len(w))
    tokens = F.regexp_extract_all(text, F.lit(f"(?s)({'|'.join(map(quoted, words))}|(?:(?!{'|'.join(map(quoted, words))}).)+)"), F.lit(1))
    kept = F.array(*[F.lit(w) for w in words])
    return F.array_join(F.transform(tokens, lambda t: F.when(F.array_contains(kept, t), t).otherwise(whole(t))), "")
