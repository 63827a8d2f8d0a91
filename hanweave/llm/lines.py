"""Line deduplication over windows of three consecutive lines, in DataFrame operations only.

Rows get keys of their own in a table in the shared folder, so a row's place decides ties.
Every line gets a 128-bit hash, every ``span`` consecutive lines a 128-bit hash of
those.  A grouped minimum finds, for each window that occurs at least twice, its first
occurrence by (doc_id, row, position); it combines within tasks, so a window that a third
of the corpus shares costs each task one row.  All other occurrences are joined back,
their positions merged per row, and the covered lines removed.  The two sides of that
join are plain tables, which Spark can split where a hash is hot.

Occurrences are judged on the input, and may overlap: of ``A A A A`` only the first
line stays.

Defined cases
-------------
* Lines are what ``\\n`` separates; texts of fewer than ``span`` lines have no window
  and stay as they are.  A null text stays null, with 0 lines; an empty one has one line.
* Every row is a document of its own.  Null doc_ids come before all others; rows that
  share a doc_id are ordered by their place in the table, so of equal rows one stays whole.
* Very long texts: work is linear in the lines of a text; a text is one row of one task.
* Other columns of the input pass through whatever their names; the output appends
  n_lines and n_removed (replacing columns of those names; other names can be given).  An empty table gives an
  empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanweave.llm.storage import free_name, materialise, scope


def _hashed(value: Column) -> Column:
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit("second"), value).alias("b"))


def windows(docs: DataFrame, key: str, span: int = 3) -> DataFrame:
    """A row for each window: d (doc_id), r (row key), pos, a and b (its hash)."""
    hashed = docs.filter(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("d"), F.col(key).alias("r"), F.transform(F.split("text", "\n", -1), _hashed).alias("h")
    )
    several = hashed.filter(F.size("h") >= span)

    def one(i: Column) -> Column:
        part = [F.element_at("h", (i + j).cast("int")) for j in range(span)]
        return F.struct((i - 1).cast("int").alias("pos"), F.xxhash64(*[p["a"] for p in part]).alias("a"), F.xxhash64(*[p["b"] for p in part]).alias("b"))

    every = F.transform(F.sequence(F.lit(1), F.size("h") - (span - 1)), one)
    return several.select("d", "r", F.explode(every).alias("w")).select("d", "r", "w.*")


def _trimmed(text: Column, starts: Column, span: int) -> Column:
    """``(text, n_lines, n_removed)`` without the windows at ``starts``; lines are split once."""
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (span - 1)))))

    def cut(x: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(x["l"]) - 1), x["c"])
        kept = F.array_join(F.transform(places, lambda i: F.element_at(x["l"], i + 1)), "\n")
        return F.struct(kept.alias("text"), F.size(x["l"]).cast("long").alias("n_lines"), F.size(x["c"]).cast("long").alias("n_removed"))

    # a lambda's variable is a value, where an expression would be computed again for each kept line
    return F.get(F.transform(F.array(F.struct(F.split(text, "\n", -1).alias("l"), covered.alias("c"))), cut), F.lit(0))


def dedup_lines(docs: DataFrame, span: int = 3, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` with the lines of later window occurrences taken out of ``text``, and two counts."""
    with scope(docs.sparkSession) as made:
        kept = [c for c in docs.columns if c not in (n_lines, n_removed)]
        docs = docs.select(*kept).withColumn("text", F.col("text").cast("string"))
        key, row, starts, out = (free_name(docs, n) for n in ("line_key", "line_row", "line_starts", "line_out"))
        docs = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "lines-docs")
        found = windows(docs.select("doc_id", "text", key), key, span)
        place = F.struct("d", "r", "pos")
        first = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        repeated = materialise(first.filter("first <> last").select("a", "b", "first"), "lines-repeated")
        later = found.join(repeated, ["a", "b"]).filter(place != F.col("first"))
        gone = later.groupBy("r").agg(F.collect_set("pos").alias("starts")).select(F.col("r").alias(row), F.col("starts").alias(starts))
        gone = materialise(gone, "lines-covered")
        made.keep(docs, gone)
    # a merge join at every size: a broadcast that only small inputs get would hide what the shuffle of texts costs
    joined = docs.join(gone.hint("merge"), F.col(key) == F.col(row), "left")
    whole = F.struct(F.col("text"), F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    done = joined.withColumn(out, F.when(F.col(starts).isNull(), whole).otherwise(_trimmed(F.col("text"), F.col(starts), span)))
    value = lambda c, name: F.col(out)[c].alias(name)
    return done.select(*[value(c, c) if c == "text" else F.col(c) for c in kept], value("n_lines", n_lines), value("n_removed", n_removed))
