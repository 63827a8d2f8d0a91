"""Places in a total order without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked_by(rows: DataFrame, key: Column, name: str = "rank", descending: bool = False, buckets: int = 64, sample: int = 4096) -> DataFrame:
    """``rows`` with their place from 1 in the order of ``key`` (a struct, which should tell all rows apart).

    The keys that hash lowest, at most ``sample`` of them, give the cuts between buckets; they
    only deal the rows.  Each bucket is sorted by itself, and the counts of the buckets before
    it, at most ``buckets`` numbers, are added.  Keys and cuts are the same in every run.
    """
    keyed = rows.withColumn("_key", key)
    picked = keyed.select("_key").orderBy(F.xxhash64("_key"), "_key").limit(sample)
    cuts = picked.agg(F.sort_array(F.collect_list("_key")).alias("k"))
    step = F.greatest(F.lit(1), F.ceil(F.size("k") / buckets).cast("int"))
    cuts = cuts.select(F.filter("k", lambda _, i: (i > 0) & (i % step == 0)).alias("_cuts"))
    bucket = F.size(F.filter("_cuts", lambda c: c <= F.col("_key")))
    dealt = keyed.join(F.broadcast(cuts)).withColumn("_bucket", bucket).drop("_cuts")
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_bucket", before.alias("_before"), F.sum("_n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    place = F.col("_before") + inside
    if descending:
        place = F.col("_all") + 1 - place
    placed = dealt.join(F.broadcast(offsets), "_bucket").withColumn(name, place.cast("int"))
    return placed.select(*[c for c in rows.columns if c != name], name)
