"""Legacy charsets: aliases, encoding and decoding, transcoding chains, mojibake repair.

``session.with_charsets`` must have been called on the session that runs the plan.
Characters that a charset can't hold become ``?``, malformed bytes U+FFFD.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names as users give them to names the JVM has.
ALIASES = {
    "utf-8": "UTF-8",
    "big5": "x-windows-950",
    "gbk": "GBK",
    "gb2312": "GBK",
    "shift-jis": "windows-31j",
    "shift_jis": "windows-31j",
    "unicode": "UTF-16LE",
    "utf-16le": "UTF-16LE",
    "unicodefffe": "UTF-16BE",
    "utf-16be": "UTF-16BE",
    "iso-2022-jp": "ISO-2022-JP",
    "euc-jp": "EUC-JP",
    "iso-8859-1": "ISO-8859-1",
    "latin1": "ISO-8859-1",
}
#: The one charset that the JVM lacks: GB2312 in seven bits, between ``~{`` and ``~}``.
HZ = "hz-gb-2312"
#: Bytes of GB2312 as Latin-1 signs, and the same without their highest bit.
_HIGH = "".join(map(chr, range(0xA1, 0xFF)))
_SEVEN = "".join(map(chr, range(0x21, 0x7F)))


def canonical(name: str) -> str:
    low = name.lower()
    if low in (HZ, "hz"):
        return HZ
    if low not in ALIASES:
        raise ValueError(f"unknown charset: {name}")
    return ALIASES[low]


def _hz_encode(text: Column) -> Column:
    data = F.decode(F.encode(F.replace(text, F.lit("~"), F.lit("~~")), "GB2312"), "ISO-8859-1")
    return F.encode(F.translate(F.regexp_replace(data, "([¡-þ]+)", "~{$1~}"), _HIGH, _SEVEN), "ISO-8859-1")


def _hz_decode(data: Column) -> Column:
    """A stretch ends with ``~}`` or the text; ``~~`` is a tilde, ``~`` before a line feed nothing, and all else malformed."""

    def one(t: Column) -> Column:
        inner = F.regexp_replace(t, r"^~\{|~\}\z", "")
        pairs = F.decode(F.encode(F.translate(inner, _SEVEN, _HIGH), "ISO-8859-1"), "GB2312")
        plain = F.regexp_replace(t, "[\x80-ÿ]", "\ufffd")
        return F.when(F.startswith(t, F.lit("~{")), pairs).when(t == "~~", "~").when(t == "~\n", "").when(t == "~", "\ufffd").otherwise(plain)

    signs = F.decode(data, "ISO-8859-1")
    tokens = F.regexp_extract_all(signs, F.lit(r"(?s)(~\{(?:[!-}][!-~]|(?!~\}).)*+(?:~\}|\z)|~~|~\n|[^~]+|~)"), F.lit(1))
    plain = F.regexp_replace(signs, "[\x80-ÿ]", "\ufffd")
    return F.when(F.contains(signs, F.lit("~")), F.array_join(F.transform(tokens, one), "")).otherwise(plain)


def encode(text: Column, charset: str) -> Column:
    name = canonical(charset)
    return _hz_encode(text) if name == HZ else F.encode(text, name)


def decode(data: Column, charset: str) -> Column:
    name = canonical(charset)
    return _hz_decode(data) if name == HZ else F.decode(data, name)


def reinterpret(text: Column, written_as: str, read_as: str) -> Column:
    """The text whose bytes in one charset are these characters' bytes in another."""
    return decode(encode(text, written_as), read_as)


def round_trips(char: Column, charset: str) -> Column:
    """Whether a character survives encoding."""
    return reinterpret(char, charset, charset) == char


def transfer(text: Column, source: str, target: str) -> Column:
    """Keep only what both charsets hold: to bytes of one, converted to the other, and read back."""
    return reinterpret(reinterpret(text, source, source), target, target)


#: U+00A1..U+00FF without the soft hyphen.
_LATIN1 = "[^¡-¬®-ÿ]"


def latin1_density(text: Column) -> Column:
    """Share of Latin-1 letters and signs; 0 for an empty text."""
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(text, _LATIN1, "")) / F.length(text))


def repair_latin1(text: Column, charset: str, over: float = 0.2) -> Column:
    """Read again, as ``charset``, a text that was read as Latin-1, if it looks like one."""
    return F.when(latin1_density(text) > F.lit(over), reinterpret(text, "iso-8859-1", charset)).otherwise(text)
