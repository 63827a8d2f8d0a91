"""Character tables: Simplified and Traditional Chinese, and half- and full-width signs."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession

#: ASCII signs whose full-width form is 0xFEE0 above them.  Fixed values.
SHIFTED = ",~!#$%&*-+{};|?()[]:@<>="
#: Signs with a full-width form of their own.  Fixed values.
OWN_FORM = {"^": "︿", " ": "　", ".": "。", '"': "、", "“": "「", "”": "」", "‘": "『", "’": "』"}

HALF = SHIFTED + "".join(OWN_FORM)
FULL = "".join(chr(ord(c) + 0xFEE0) for c in SHIFTED) + "".join(OWN_FORM.values())

#: Stand-ins for a..z that make test text Chinese; each has a Traditional form of its own.
LATIN = "abcdefghijklmnopqrstuvwxyz"
SINIFIED = "软体电脑头发计机网络数库语转换简汉国学经济东门马鸟鱼"

_HAN = (0x3400, 0xA000)


@lru_cache(maxsize=2)
def _mapping(transliterator: str) -> tuple[str, str]:
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    icu = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance(transliterator)
    source = [chr(c) for c in range(*_HAN)]
    # one character a line: the transliterator knows words, the wanted table doesn't
    target = icu.transliterate("\n".join(source)).split("\n")
    pairs = [(s, t) for s, t in zip(source, target, strict=True) if s != t and len(t) == 1]
    return "".join(s for s, _ in pairs), "".join(t for _, t in pairs)


def simplified_to_traditional() -> tuple[str, str]:
    """Two aligned strings for ``translate``, from the ICU data that Spark ships."""
    return _mapping("Simplified-Traditional")


def traditional_to_simplified() -> tuple[str, str]:
    return _mapping("Traditional-Simplified")
