"""File lists: extension filters, ordering, conflicts, rename plans, trees."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanweave.operators.ranks import ranked_by


def extension_pattern(wildcard: str) -> str:
    """``*.txt`` as an expression on the end of a name; case counts, other signs keep their meaning."""
    return wildcard.strip().replace(".", "\\.").replace("*", ".*?") + "$"


def matches_extension(name: Column, wildcards: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in wildcards:
        out = out | name.rlike(extension_pattern(w))
    return out


def parse_filters(spec: str) -> list[tuple[str, list[str]]]:
    """``<label|*.a;*.b>/<label|*.c>`` as (label, wildcards) pairs."""
    found = []
    for part in spec.split("/"):
        inner = re.search("<(.*)>", part)
        if inner and "|" in inner[1]:
            label, _, wildcards = inner[1].partition("|")
            found.append((label, wildcards.split(";")))
    return found


def filter_table(specs: DataFrame, column: str = "spec") -> DataFrame:
    """The same on a column: a row for each wildcard, with label, pos and wildcard."""
    parts = specs.select("*", F.posexplode(F.split(column, "/")).alias("filter", "part"))
    inner = parts.withColumn("inner", F.regexp_extract("part", "<(.*)>", 1)).filter(F.contains("inner", F.lit("|")))
    label = F.substring_index("inner", "|", 1)
    wildcards = F.split(F.substr("inner", F.length(label) + 2), ";")
    return inner.select(*specs.columns, "filter", label.alias("label"), F.posexplode(wildcards).alias("pos", "wildcard"))


def refined(rows: DataFrame, wildcards: Sequence[str], name: str = "name") -> DataFrame:
    """Rows that match any wildcard, once each, with the first that did: pattern_pos, the major order."""
    pos = F.lit(None).cast("int")
    for i, w in reversed(list(enumerate(wildcards))):
        pos = F.when(F.col(name).rlike(extension_pattern(w)), F.lit(i)).otherwise(pos)
    return rows.withColumn("pattern_pos", pos).filter("pattern_pos IS NOT NULL")


def ranked(rows: DataFrame) -> DataFrame:
    """File lists in the order (path, is_file, name), as a rank."""
    return ranked_by(rows, F.struct("path", "is_file", "name", "id"))


def resolve_conflicts(rows: DataFrame, existing: DataFrame, policy: str, target: str = "target") -> DataFrame:
    """Which rows are written: ``replace`` all, ``skip`` those whose target exists, or ``cancel`` from the first on.

    ``existing`` has the column ``target``; the output adds target_exists and is_replace.
    """
    there = existing.select(target).distinct().withColumn("target_exists", F.lit(True))
    out = rows.join(there, target, "left").withColumn("target_exists", F.coalesce("target_exists", F.lit(False)))
    if policy == "replace":
        return out.withColumn("is_replace", F.lit(True))
    if policy == "skip":
        return out.withColumn("is_replace", ~F.col("target_exists"))
    if policy == "cancel":
        first = out.filter("target_exists").agg(F.min("id").alias("first"))
        return out.join(F.broadcast(first)).withColumn("is_replace", F.col("first").isNull() | (F.col("id") < F.col("first"))).drop("first")
    raise ValueError(f"unknown policy: {policy}")


def writable(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("is_checked") & F.col("is_replace"))


def rename_plan(paths: DataFrame, convert) -> DataFrame:
    """old_path, new_path for every path whose names change; deepest first, so parents move last."""
    parts = F.split("path", "/")
    new = F.array_join(F.transform(parts, convert), "/")
    moved = paths.select(F.col("path").alias("old_path"), new.alias("new_path"), F.size(parts).alias("depth")).filter("old_path <> new_path")
    return ranked_by(moved, F.struct(-F.col("depth"), F.col("old_path")), "step")


def tree_rows(paths: DataFrame) -> DataFrame:
    """The nodes above and including each file path: path, parent, depth (root 1), is_file."""
    parts = F.split("path", "/")
    nodes = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), i.alias("depth"), (i == F.size(parts)).alias("is_file")))).alias("n"))
    rows = nodes.select("n.*").groupBy("path", "depth").agg(F.max("is_file").alias("is_file"))
    parent = F.when(F.col("depth") > 1, F.expr("substr(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)"))
    return rows.select("path", parent.alias("parent"), "depth", "is_file", F.lit(True).alias("is_checked"))


def post_order(nodes: DataFrame) -> DataFrame:
    """Tree nodes with their place in the reversed post-order walk: a node comes before all below it.

    The walk takes folders before files, each by name, and what is below a node before the
    node; reversed, a node's files come first, then its folders, names falling.
    """
    parts = F.split("path", "/")
    # folders sort below files, and the highest sign puts a node behind all below it
    flags = F.transform(parts, lambda name, i: F.concat(F.when((i == F.size(parts) - 1) & F.col("is_file"), "1").otherwise("0"), name))
    return ranked_by(nodes, F.struct(F.concat(flags, F.array(F.lit("\U0010ffff"))).alias("walk")), "walk", descending=True)
