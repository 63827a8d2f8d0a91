"""The user vocabulary: rows, compiled tables, ordered replacement, search and sorting.

Columns: ln (file order), enable, type, simplified, simplified_priority, traditional,
traditional_priority.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hanweave.functions.binding import bind
from hanweave.operators.ranks import ranked_by

SCHEMA = "ln long, enable boolean, type string, simplified string, simplified_priority int, traditional string, traditional_priority int"
RESERVED_PRIORITY = 9999
#: Most words that a plan holds as literals; larger vocabularies are joined (``replace_by_table``).
MOST_LITERALS = 2000
#: Noncharacters that mark words while they are replaced.
_OPEN, _CLOSE = "\ufdd1", "\ufdd2"


@dataclass(frozen=True)
class Compiled:
    """Words in match order with their replacements, and words that conversion leaves alone."""

    pairs: tuple[tuple[str, str], ...]
    reserved: tuple[str, ...]


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def first_rows(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each key in file order; disabled rows count, so they hide later ones."""
    order = Window.partitionBy(key).orderBy("ln")
    return rows.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def _enabled_words(rows: DataFrame, to_traditional: bool) -> DataFrame:
    key, value = ("simplified", "traditional") if to_traditional else ("traditional", "simplified")
    kept = first_rows(rows, key).filter("enable").withColumn("length", utf16_length(F.col(key)))
    same = (F.col("simplified_priority") == RESERVED_PRIORITY) & (F.col("traditional_priority") == RESERVED_PRIORITY) & (F.col("simplified") == F.col("traditional"))
    return kept.select(F.col(key).alias("word"), F.col(value).alias("replacement"), F.col(f"{key}_priority").alias("priority"), "length", "ln", same.alias("reserved"))


def compiled_table(rows: DataFrame, to_traditional: bool = True) -> DataFrame:
    """Enabled words of one direction: word, replacement, priority, ln, rank, reserved.

    Rank is the match order: priority, then length, both falling, then file order.
    """
    return ranked_by(_enabled_words(rows, to_traditional), F.struct(-F.col("priority"), -F.col("length"), F.col("ln")))


def compile_words(rows: DataFrame, to_traditional: bool = True, most: int = MOST_LITERALS) -> Compiled:
    """The vocabulary on the driver, for use as literals; reserved words come from the Traditional side.

    A vocabulary of over ``most`` rows is an error, found before anything is collected.
    """
    n = rows.limit(most + 1).count()
    if n > most:
        raise ValueError(f"over {most} words are too many for literals; use replace_by_table")

    def ordered(found: DataFrame) -> list:
        return sorted((r for r in found.collect() if r.word), key=lambda r: (-r.priority, -r.length, r.ln))

    pairs = [(r.word, r.replacement) for r in ordered(_enabled_words(rows, to_traditional))]
    reserved = [r.word for r in ordered(_enabled_words(rows, False).filter("reserved"))]
    return Compiled(tuple(pairs), tuple(sorted(reserved, key=lambda w: -len(w))))


def quoted(word: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", word)


def token_pattern(words: Sequence[str]) -> str:
    """One group that matches a word (the first in order), a run without first letters, or a character."""
    heads = "".join(sorted({re.sub(r"([\\^\[\]&\-])", r"\\\1", w[0]) for w in words}))
    return "(?s)(" + "|".join(map(quoted, words)) + f"|[^{heads}]+|.)"


def word_pattern(words: Sequence[str]) -> str:
    """Any of the words, the first in order; of many words a look at the first letter spares most places the alternatives."""
    any_ = "(?:" + "|".join(map(quoted, words)) + ")"
    if len(words) <= 32:
        return any_
    heads = "".join(sorted({re.sub(r"([\\^\[\]&\-])", r"\\\1", w[0]) for w in words}))
    return f"(?=[{heads}]){any_}"


def marked_replaced(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Words in one pass: an expression marks them, then each marked word is replaced as a plain string.

    Marks are noncharacters, so no replacement can make a marked word; text that holds one
    goes token by token (``_by_tokens``).
    """
    first = dict(reversed(pairs))  # of a repeated word the first counts
    pattern = word_pattern(list(dict.fromkeys(w for w, _ in pairs)))

    def either(t: Column) -> Column:
        out = F.regexp_replace(t, pattern, f"{_OPEN}$0{_CLOSE}")
        for word, value in first.items():
            out = F.replace(out, F.lit(_OPEN + word + _CLOSE), F.lit(value))
        return F.when(F.contains(t, F.lit(_OPEN)) | F.contains(t, F.lit(_CLOSE)), _by_tokens(t, pairs)).otherwise(out)

    return bind(text, either)


def _by_tokens(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in dict(reversed(pairs)).items() for x in pair])
    tokens = F.regexp_extract_all(text, F.lit(token_pattern([w for w, _ in pairs])), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t)), "")


def replace_words(text: Column, words: Compiled) -> Column:
    """All words in one pass, leftmost first, at each place the first in match order; no cascading."""
    return marked_replaced(text, words.pairs) if words.pairs else text


def replace_by_table(rows: DataFrame, table: DataFrame, text: str = "text", out: str = "replaced") -> DataFrame:
    """The same for a vocabulary of any size: ``table`` has word, replacement and rank (match order).

    Stretches of a text that begin with a word's first letter and have the length of a word
    with that letter are joined with the table; of what is found the leftmost, then first
    in order, is taken, and so on behind it.  Rows need an ``id``; a null text stays null.
    """
    words = table.filter("word <> ''").select("word", "replacement", "rank")
    most = words.agg(F.max(F.length("word"))).first()[0] or 0
    # a row for each first letter, with the lengths of its words
    heads = words.groupBy(F.substring("word", 1, 1).alias("head")).agg(F.collect_set(F.length("word")).alias("lengths"))

    def stretches(signs: Column) -> Column:
        return F.transform(signs, lambda c, i: F.struct(i.alias("at"), c.alias("head"), F.array_join(F.slice(signs, i + 1, most), "").alias("s")))

    every = F.get(F.transform(F.array(F.split(text, "")), stretches), F.lit(0))
    letters = rows.select("id", F.explode(every).alias("x")).select("id", "x.*")
    asked = letters.join(heads, "head").select("id", "at", F.explode(F.transform("lengths", lambda n: F.substr("s", F.lit(1), n))).alias("word"))
    best = asked.join(words, "word").groupBy("id", "at").agg(F.min(F.struct("rank", "word", "replacement")).alias("m"))
    found = best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", F.length("m.word").alias("n"), F.col("m.replacement").alias("value")))).alias("_found"))
    joined = rows.join(found, "id", "left")
    start = F.struct(F.lit(0).alias("upto"), F.lit("").alias("done"))

    def step(s, w):
        taken = F.struct((w["at"] + w["n"]).alias("upto"), F.concat(s["done"], F.substr(F.col(text), s["upto"] + 1, w["at"] - s["upto"]), w["value"]).alias("done"))
        return F.when(w["at"] >= s["upto"], taken).otherwise(s)

    whole = F.aggregate("_found", start, step, lambda s: F.concat(s["done"], F.substr(F.col(text), s["upto"] + 1, F.length(text))))
    return joined.withColumn(out, F.coalesce(whole, F.col(text))).drop("_found")


def replace_by_join(rows: DataFrame, tokens: str, table: DataFrame) -> DataFrame:
    """Token lookup for a table too large for literals: ``rows`` with ``tokens`` replaced, others as they are.

    ``table`` has word and replacement; rows need an ``id``.
    """
    spread = rows.select("id", F.posexplode(tokens).alias("pos", "token"))
    found = spread.join(table.select(F.col("word").alias("token"), "replacement"), "token", "left")
    item = F.struct("pos", F.coalesce("replacement", "token").alias("t"))
    joined = found.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), "").alias("replaced"))
    return rows.join(joined, "id", "left").withColumn("replaced", F.coalesce("replaced", F.lit("")))


def search(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose words or type contain the text, letter case aside; all rows for an empty one."""
    low = F.lit(text.lower())
    hit = F.lit(False)
    for c in ("simplified", "traditional", "type"):
        hit = hit | F.contains(F.lower(F.col(c)), low)
    return rows.filter(hit) if text else rows


def editor_ranked(rows: DataFrame, side: str = "simplified") -> DataFrame:
    """Rows with their place in the editor: priority, length, text, all falling."""
    return ranked_by(rows, F.struct(F.col(f"{side}_priority"), utf16_length(F.col(side)), F.col(side), -F.col("ln")), descending=True)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Dictionary rows of (ln, value) lines: six fields between tabs, others are dropped.

    A priority that is no number fails the whole load.
    """
    parts = lines.filter("value <> ''").select("ln", F.split("value", "\t", -1).alias("f")).filter(F.size("f") == 6)
    f = lambda i: F.col("f")[i]
    return parts.select("ln", (f(0) == "True").alias("enable"), f(1).alias("type"), f(2).alias("simplified"), f(3).cast("int").alias("simplified_priority"), f(4).alias("traditional"), f(5).cast("int").alias("traditional_priority"))


def print_lines(rows: DataFrame) -> DataFrame:
    """(ln, value) lines of dictionary rows that have any word."""
    kept = rows.filter((F.coalesce("simplified", F.lit("")) != "") | (F.coalesce("traditional", F.lit("")) != ""))
    flag = F.when(F.col("enable"), "True").otherwise("False")
    text = [flag, F.coalesce("type", F.lit("Default")), "simplified", F.col("simplified_priority").cast("string"), "traditional", F.col("traditional_priority").cast("string")]
    return kept.select("ln", F.concat_ws("\t", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in text]).alias("value"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Read a dictionary file: UTF-8, lines end in CR LF, no header, no quoting."""
    lines = spark.read.option("lineSep", "\r\n").text(path)
    return parse_lines(lines.withColumn("ln", F.monotonically_increasing_id()))


def save(rows: DataFrame, path: str) -> None:
    """Write a dictionary folder in file order; reading it back gives the same words."""
    print_lines(rows).orderBy("ln").select("value").write.mode("overwrite").option("lineSep", "\r\n").text(path)
