"""Exact top-k inner-product search by distributed histogram selection.

Every (query, candidate) pair is scored in blocks.  Rounds of global score
histograms narrow, for each query, the interval that holds its k-th best score;
a last pass keeps what lies on or above it and ranks that by score, then id.

Vectors are quantised once, into a table that every scan reads.  Queries go to the
executors in blocks of at most ``query_block`` rows, so what is broadcast has a fixed
bound.  In a round each partition reports only the bins on or above its own k-th best,
since the global k-th best can't lie below; Spark sums them, finds the bin of each
query's k-th best, and sends one row a query to the driver.  In the last pass a partition
gives at most ``k`` rows a query, because none can contribute more.  A vector that many
rows share therefore costs no more than any other.

Defined cases
-------------
* Vectors that are null or hold a null or non-finite component, and rows whose id
  is null, take no part.
* A query meets candidates of its own dimension only; rows with the query's own id
  are no candidates.  Repeated query ids give one query (the smallest vector);
  repeated candidate rows stay separate candidates.
* Scores beyond the range of a long are clamped to it.
* Equal scores go to the smaller id, and of equal ids each row counts.
* Only the two named columns are read, so other columns can't clash.
* No vectors or no queries: no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hanweave.llm.storage import fresh_dir, materialise, scope

LONG = 2**63 - 1
EXACT = float(2**53)


def quantised(vector: Column, scale: int = 1024) -> Column:
    """Each component x as floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _blocks(batch, queries: int, cells: int = 1 << 20):
    """``(ids, matrix)`` blocks of equal dimension from an Arrow batch of (id, vec); a block has about ``cells`` scores."""
    rows = max(16, cells // max(queries, 1))
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    vectors = batch.column(1)
    offsets = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for lo in range(0, len(at), rows):
            part = at[lo : lo + rows]
            yield int(size), ids[part], flat[offsets[part][:, None] + np.arange(size)]


def _scores(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in floating point where that is exact."""
    if queries.size == 0 or block.size == 0:
        return np.zeros((len(queries), len(block)), np.int64)
    width = queries.shape[1]
    most = float(np.abs(queries.astype(np.float64)).max()) * float(np.abs(block.astype(np.float64)).max()) * width
    if most < EXACT:
        return (queries.astype(np.float64) @ block.astype(np.float64).T).astype(np.int64)
    if most < LONG / 2:
        return queries @ block.T
    wide = queries.astype(object) @ block.astype(object).T
    return np.array([[max(-LONG, min(LONG, int(x))) for x in row] for row in wide], np.int64).reshape(wide.shape)


def _grouped(chunk) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries by dimension: positions in the chunk, ids, matrix."""
    by: dict[int, list[int]] = {}
    for i, row in enumerate(chunk):
        by.setdefault(len(row[1]), []).append(i)
    return {
        size: (np.array(at), np.array([chunk[i][0] for i in at], np.int64), np.array([chunk[i][1] for i in at], np.int64).reshape(len(at), size))
        for size, at in by.items()
    }


def _histogram(shared, k: int, bins: int):
    """Task: counts by (query, bin) over the intervals in ``shared``, pruned below the local k-th best."""

    def run(batches):
        import pyarrow as pa

        groups, low, width, going = shared.value
        counts = np.zeros((len(low), bins + 1), np.int64)  # the last bin: above the interval
        for batch in batches:
            for size, ids, block in _blocks(batch, len(low)):
                if size not in groups:
                    continue
                at, own, matrix = groups[size]
                open_ = going[at]
                if not open_.any():
                    continue
                at, own, matrix = at[open_], own[open_], matrix[open_]
                s = _scores(matrix, block)
                # differences of longs may exceed a long; both bounds are compared first
                lo, wd = low[at][:, None], width[at][:, None]
                offset = np.where(s >= lo, (s - lo).view(np.uint64) // wd.astype(np.uint64), 0)
                place = np.minimum(offset, np.uint64(bins)).astype(np.int64)
                keep = (s >= lo) & (ids[None, :] != own[:, None])
                flat = (at[:, None] * (bins + 1) + place)[keep]
                counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < k))
        yield pa.record_batch([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[q, b])], names=["q", "bin", "n"])

    return run


def _select(shared, k: int):
    """Task: for each query its k best rows on or above the located bound."""

    def run(batches):
        import pyarrow as pa

        groups, low, _, _ = shared.value
        best: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def cut(q: int) -> None:
            s, i = (np.concatenate(x) for x in zip(*best[q]))
            order = np.lexsort((i, -s))[:k]
            best[q] = [(s[order], i[order])]

        for batch in batches:
            for size, ids, block in _blocks(batch, len(low)):
                if size not in groups:
                    continue
                at, own, matrix = groups[size]
                s = _scores(matrix, block)
                hit = (s >= low[at][:, None]) & (ids[None, :] != own[:, None])
                for row in np.flatnonzero(hit.any(axis=1)):
                    cols = np.flatnonzero(hit[row])
                    best.setdefault(int(at[row]), []).append((s[row, cols], ids[cols]))
                    if sum(len(x[0]) for x in best[int(at[row])]) > 8 * k:
                        cut(int(at[row]))
        names = {int(p): int(i) for at, own, _ in groups.values() for p, i in zip(at, own)}
        rows: list[tuple[int, int, int]] = []
        for q in best:
            cut(q)
            rows += [(names[q], int(i), int(s)) for s, i in zip(*best[q][0])]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.record_batch([pa.array(list(c), pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    query_block: int = 4096,
    bins: int = 512,
) -> DataFrame:
    """The ``k`` best candidates of each query: query_id, rank, vec_id, score.

    ``queries`` has the columns of ``vectors``; ``query_block`` bounds what one pass
    broadcasts, and the table of quantised vectors is scanned a few times a block.
    """
    spark = vectors.sparkSession

    def prepared(df: DataFrame) -> DataFrame:
        kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
        return kept.filter(F.col("id").isNotNull() & usable(F.col("v"))).select("id", quantised(F.col("v"), scale).alias("v"))

    with scope(spark) as made:
        asked = materialise(prepared(queries).groupBy("id").agg(F.min("v").alias("v")), "topk-queries")
        total = asked.count()
        if not total:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        candidates = materialise(prepared(vectors), "topk-vectors")
        most = candidates.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()[0] or 0.0
        chunks = -(-total // query_block)
        out, schema = fresh_dir(spark, "topk-found"), "query_id long, vec_id long, score long"
        for chunk in range(chunks):
            mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == chunk).orderBy("id").collect()
            if mine:
                shared = spark.sparkContext.broadcast(_located(candidates, mine, most, k, bins))
                candidates.mapInArrow(_select(shared, k), schema).write.mode("append").parquet(out)
                shared.unpersist()
        made.keep(out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = spark.read.schema(schema).parquet(out).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _located(candidates: DataFrame, mine: list, most: float, k: int, bins: int) -> tuple:
    """A block of queries with a bound for each on or above which its k best scores lie."""
    spark = candidates.sparkSession
    groups = _grouped(mine)
    sums = [sum(abs(x) for x in row[1]) for row in mine]
    bound = [min(LONG // 2 - bins - 1, int(s * (most + 1)) + 1) for s in sums]
    low = np.array([-b for b in bound], np.int64)
    if most * max([0, *sums]) * 2 >= LONG // 2:
        low[:] = -LONG  # scores may be clamped: one interval over all longs
    width = np.array([-(-(min(LONG, 2 * b + 1)) // bins) for b in bound], np.int64)
    going = np.ones(len(mine), bool)
    down = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    while going.any():
        shared = spark.sparkContext.broadcast((groups, low, width, going))
        counts = candidates.mapInArrow(_histogram(shared, k, bins), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        # the highest bin with at least k rows on or above it, a row a query; bins pruned by a task lie below it
        found = counts.withColumn("down", down).filter(F.col("down") >= k).groupBy("q").agg(F.max(F.struct("bin", "down")).alias("m")).select("q", "m.*").collect()
        again = np.zeros(len(mine), bool)  # a query without such a bin has fewer than k candidates: every one stays
        for q, place, n in found:
            low[q] = min(LONG, int(low[q]) + place * int(width[q]))
            if place < bins and width[q] > 1 and n > 4 * k:
                again[q] = True
                width[q] = -(-int(width[q]) // bins)
        going &= again
        shared.unpersist()
    return groups, low, width, going
