"""Which legacy charset a text was written in, from byte statistics.

Bytes are read as Latin-1, a sign a byte, and split by regular expressions: a lead byte
takes the next byte with it, valid or not; a lead byte at the end and other high bytes
don't count.  One pass keeps the pairs alone, so text that is mostly ASCII costs little
more than that pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hanweave.functions import charsets
from hanweave.functions.binding import bind

#: Lead bytes.
BIG5_LEAD = "\x80-\xfe"
GBK_LEAD = "\xa1-\xf7"
_BIG5_TRAIL = "[@-~\xa1-\xfe]"
_GBK_TRAIL = "[\xa1-\xfe]"
#: Areas of two-byte characters: signs, common, rare.
BIG5_AREAS = (
    f"[\xa1\xa2]{_BIG5_TRAIL}|\xa3[@-~\xa1-\xbf]",
    f"[\xa4-\xc5]{_BIG5_TRAIL}|\xc6[@-~]",
    f"[\xc9-\xf8]{_BIG5_TRAIL}|\xf9[@-~\xa1-\xd5]",
)
GBK_AREAS = (f"[\xa1-\xa9]{_GBK_TRAIL}", f"[\xb0-\xd7]{_GBK_TRAIL}", f"[\xd8-\xf7]{_GBK_TRAIL}")


def _report(data: Column, lead: str, areas: tuple[str, str, str]) -> Column:
    """Counts of signs and pairs by area, and the share that speaks against the charset."""

    def kept(signs: Column) -> Column:
        pairs = F.regexp_replace(signs, f"(?s)([{lead}].)|[^{lead}]+|[{lead}]", "$1")
        plain = F.regexp_replace(signs, f"(?s)[{lead}].|[\x80-\xff]", "")
        return F.struct(pairs.alias("pairs"), F.length(plain).alias("ascii"))

    def counted(r: Column) -> Column:
        count = lambda area: (F.length(F.regexp_replace(r["pairs"], f"(?s)({area})|..", "$1")) / 2).cast("int")
        found = [F.when(r["pairs"] == "", 0).otherwise(count(a)) for a in areas]
        return F.struct(r["ascii"].alias("ascii"), *[c.alias(n) for c, n in zip(found, ("symbol", "common", "rare"))], (F.length(r["pairs"]) / 2).cast("int").alias("pairs"))

    def scored(r: Column) -> Column:
        unknown = r["pairs"] - r["symbol"] - r["common"] - r["rare"]
        total = r["ascii"] + r["pairs"]
        bad = F.when(total == 0, F.lit(0.0)).otherwise((r["rare"] + 3 * unknown) / total).cast("float")
        return F.struct(*[r[n].alias(n) for n in ("ascii", "symbol", "common", "rare")], unknown.alias("unknown"), bad.alias("bad_smell"))

    return bind(bind(bind(F.decode(data, "ISO-8859-1"), kept), counted), scored)


def big5_report(data: Column) -> Column:
    """Counts of ASCII, signs, common, rare and unknown characters by Big5's areas."""
    return _report(data, BIG5_LEAD, BIG5_AREAS)


def gbk_report(data: Column) -> Column:
    return _report(data, GBK_LEAD, GBK_AREAS)


def best(scores: Column) -> Column:
    """Index of the first smallest score; -1 if all are 0."""
    def first(s: Column) -> Column:
        total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x.cast("double"))
        return F.when(total == 0, F.lit(-1)).otherwise((F.array_position(s, F.array_min(s)) - 1).cast("int"))

    return bind(scores, first)


def sniffed(text: Column) -> Column:
    """0 or 1: Big5, 2 or 3: GBK, -1: can't tell.  Text is tried in both charsets."""
    both = F.struct(charsets.encode(text, "big5").alias("big5"), charsets.encode(text, "gbk").alias("gbk"))

    def scored(b: Column) -> Column:
        reports = [big5_report(b["big5"]), big5_report(b["gbk"]), gbk_report(b["big5"]), gbk_report(b["gbk"])]
        return best(F.array(*[r["bad_smell"] for r in reports]))

    return bind(both, scored)


def sniffed_bytes(data: Column) -> Column:
    """The same for bytes: 0 if Big5's rules fit no worse than GBK's, 2 if GBK's fit better, -1: can't tell."""
    found = best(F.array(big5_report(data)["bad_smell"], gbk_report(data)["bad_smell"]))
    return bind(found, lambda x: F.when(x == 1, F.lit(2)).otherwise(x))


def decoded_by_sniffing(data: Column, default: str = "big5") -> Column:
    """Bytes as text in the charset that their statistics speak for; ``default`` where they can't tell."""
    kind = sniffed_bytes(data)
    big5, gbk, other = (charsets.decode(data, c) for c in ("big5", "gbk", default))
    return F.when(kind == 0, big5).when(kind == 2, gbk).otherwise(other)


def unless_already(text: Column, target: str, converted: Column) -> Column:
    """``converted``, but the text itself where it seems to be in the target charset (big5 or gbk) already."""
    there = (0, 1) if charsets.canonical(target) == charsets.canonical("big5") else (2, 3)
    return F.when(sniffed(text).isin(*there), text).otherwise(converted)
