"""Lookups between small keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def fallback(rows: DataFrame, other: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Rows with ``value`` from the first matching row of ``other`` where their own is missing, else empty."""
    right = first_per_key(other, keys, order).select(*keys, F.col(value).alias("_other"))
    return rows.join(right, keys, "left").withColumn(value, F.coalesce(value, "_other", F.lit(""))).drop("_other")


def strict_lookup(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Every row's value by key; a key without one is an error."""
    found = rows.join(table.select(key, F.col(value).alias("_v")), key, "left")
    message = F.concat(F.lit("no entry for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return found.withColumn(value, F.when(F.col("_v").isNull(), F.raise_error(message).cast(found.schema["_v"].dataType)).otherwise(F.col("_v"))).drop("_v")


def with_missing(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows plus one for each name that they lack, its other columns null."""
    return rows.unionByName(names.select(key).distinct().join(rows.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: str, value: str, replace: bool) -> DataFrame:
    """All keys of both; for keys of both the new value if ``replace``, else the old one."""
    a, b = old.select(key, F.col(value).alias("_old")), new.select(key, F.col(value).alias("_new"))
    order = ("_new", "_old") if replace else ("_old", "_new")
    return a.join(b, key, "full_outer").select(key, F.coalesce(*order).alias(value))


def without_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def inverted(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A map from values to keys; the first key in order wins."""
    return rows.groupBy(value).agg(F.min_by(key, order).alias(key))


def unique_match(rows: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """The one matching value, the default for none; several are an error."""
    counted = table.groupBy(key).agg(F.count("*").alias("_n"), F.min(value).alias("_v"))
    found = rows.join(counted, key, "left")
    several = F.raise_error(F.lit("more than one match")).cast(counted.schema["_v"].dataType)
    return found.withColumn(value, F.when(F.col("_n") > 1, several).otherwise(F.coalesce("_v", F.lit(default)))).drop("_n", "_v")


def string_properties(rows: DataFrame, id_col: str) -> DataFrame:
    """A row (id, tag_name, value) for each string column that isn't null."""
    names = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string" and f.name != id_col]
    return rows.unpivot([id_col], names, "tag_name", "value").filter("value IS NOT NULL")


def converted_together(rows: DataFrame, group: str, order: str, value: str, convert) -> DataFrame:
    """Values of a group joined by line, converted at once and split again.

    A conversion that changes the number of lines is an error.  Returns group, order and
    value as converted.
    """
    lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    joined = rows.groupBy(group).agg(lines.alias("l")).withColumn("_text", convert(F.array_join(F.transform("l", lambda x: x["v"]), "\r\n")))
    parts = joined.withColumn("_parts", F.split("_text", "\r\n", -1))
    checked = parts.withColumn("_parts", F.when(F.size("_parts") != F.size("l"), F.raise_error(F.lit("line count changed")).cast("array<string>")).otherwise(F.col("_parts")))
    spread = checked.select(group, F.explode(F.arrays_zip(F.transform("l", lambda x: x["o"]).alias("o"), F.col("_parts").alias("p"))).alias("z"))
    return spread.select(group, F.col("z.o").alias(order), F.col("z.p").alias(value))
