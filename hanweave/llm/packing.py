"""Bound-certified best-fit packing of token sequences.

Documents are tokenised once; only those longer than a sequence are cut, into pieces of
full length but for the first.  Pieces (their lengths, not their ids) are dealt evenly
to partitions of bounded size and packed by best-fit decreasing.  Lower bounds from dual
feasible functions certify the number of sequences, of a partition and of all together.
Where a partition has a gap to its bound, or the total to its own, the pieces in the
sequences that are not full are pooled across partitions, dealt anew, and packed again,
until the bound is met or a round saves no sequence.

Defined cases
-------------
* A null or empty text has no ids but the end id, and so is a piece of length 1.
* Every row is a document of its own, repeated ids too.  A null doc_id stays null.
* Ties of length keep the order of (doc_id, piece, start), ties of room go to any sequence.
* Very long texts are encoded in stretches and cut into as many pieces as they need.
* Only doc_id and text are read, so other columns can't clash.
* An empty table packs into nothing.  Lengths lie between 1 and the capacity.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanweave.llm import tokenise
from hanweave.llm.storage import materialise, scope

MOST_PARTS = 16384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    """Task: documents to pieces."""

    def run(batches):
        import pyarrow as pa

        model = tokenise.encoder(path)
        for doc_id, texts in tokenise.text_groups(batches, ("doc_id", "text")):
            ids, sizes = model.encode(texts)
            rows: list[tuple] = []
            at = 0
            end = np.array([end_id], "<u4")
            for d, n in zip(doc_id, sizes.tolist()):
                own = np.concatenate([ids[at : at + n].astype("<u4"), end])
                at += n
                first = len(own) % capacity or capacity
                lo, piece = 0, 0
                while lo < len(own):
                    hi = first if lo == 0 else lo + capacity
                    part = own[lo:hi]
                    rows.append((d, piece, lo, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32).tolist() if with_ids else None))
                    lo, piece = hi, piece + 1
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            upto = 6 if with_ids else 5
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols[:upto], kinds)], names=names[:upto])

    return run


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents (doc_id, text), with their ids if asked for."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pieces(path, end_id, capacity, with_ids), PIECES + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: ``(bin of each item, place in it, fill of each bin)``.

    A bit set over residual capacities finds the tightest bin that still fits.
    """
    order = np.argsort(-lengths, kind="stable")
    which = np.zeros(len(lengths), np.int64)
    place = np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    mask = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            rest = n + (fits & -fits).bit_length() - 1
            b = free[rest].pop()
            if not free[rest]:
                mask &= ~(1 << rest)
        else:
            b, rest = len(fill), capacity
            fill.append(0)
        which[i], place[i] = b, fill[b]
        fill[b] += n
        if rest > n:
            free[rest - n].append(b)
            mask |= 1 << (rest - n)
    return which, place, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound on the number of bins over a family of dual feasible functions.

    For each t up to half the capacity: lengths over capacity - t count as full bins,
    lengths below t not at all, and others as they are, or, for each k, rounded to
    k-ths: x counts floor((k + 1) x / capacity) / k, or x / capacity if that is whole.
    """
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of(count: np.ndarray, capacity: int) -> int:
    """The same from the number of items of each length."""
    size = np.arange(capacity + 1)
    total = np.cumsum(count * size)
    number = np.cumsum(count)
    t = np.arange(0, capacity // 2 + 1)
    upper = capacity - t
    below = np.where(t > 0, t - 1, 0)
    middle = total[upper] - np.where(t > 0, total[below], 0)
    best = int((number[-1] - number[upper] + -(-middle // capacity)).max())
    for k in range(1, 101):
        scaled = (k + 1) * size
        # in units of 1 / (k * capacity)
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _pack(capacity: int, round_: int, most: int):
    """Task: a partition's pieces, up to ``most`` at once, by best-fit decreasing, with their count of sequences and its bound."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base = (round_ << 48) + (TaskContext.get().partitionId() << 24)

        def packed(kept: list):
            held = pa.Table.from_batches(kept)
            held = held.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")]).combine_chunks()
            lengths = held["length"].to_numpy()
            which, place, fill = best_fit(lengths, capacity)
            n, bound = len(fill), lower_bound(lengths, capacity)
            out = [held[c].combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            out = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in out]
            out += [pa.array(base + which), pa.array(place), pa.array(fill[which]), pa.array(np.full(len(which), n)), pa.array(np.full(len(which), bound))]
            return pa.record_batch(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill", "bins", "bound"]), n

        kept, size = [], 0
        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                size += batch.num_rows
            if size >= most:
                done, n = packed(kept)
                yield done
                base, kept, size = base + n, [], 0
        if kept:
            yield packed(kept)[0]

    return run


PACKED = PIECES + ", sequence_id long, offset long, fill long, bins long, bound long"


def pack(rows: DataFrame, capacity: int = 2048, partition_pieces: int = 65536) -> DataFrame:
    """Place pieces: their columns, sequence_id, offset, and the certificate columns.

    fill is the sequence's length, bins and bound the number of sequences of the
    partition that packed it and the lower bound on that number.
    """
    columns = [x.split()[0] for x in PIECES.split(", ")]
    with scope(rows.sparkSession) as made:
        pool = materialise(rows.select(*columns), "pack-pieces")
        # at most one row a length: the histogram's size is bound by the capacity
        count = np.zeros(capacity + 1, np.int64)
        for row in pool.groupBy("length").count().collect():
            count[row.length] = row["count"]
        least, n, total, before, round_ = bound_of(count, capacity), int(count.sum()), 0, None, 0
        settled: list[DataFrame] = []
        while n:
            parts = min(-(-n // partition_pieces), MOST_PARTS)
            # groups are a little larger than an even share, so that a partition is one group where it can be
            packed = materialise(pool.select(*columns).repartition(parts).mapInArrow(_pack(capacity, round_, 2 * partition_pieces), PACKED), "pack-packed")
            used = packed.filter("offset = 0").count()
            if before is not None and used >= before:
                break  # a round that saves nothing: the pool stays as the round before had placed it
            made.keep(packed)
            total += used - (before or 0)
            open_ = (F.col("fill") < capacity) & ((F.col("bins") > F.col("bound")) | F.lit(total > least))
            settled.append(packed.filter(~open_))
            pool = packed.filter(open_)
            n, before, round_ = pool.count(), pool.filter("offset = 0").count(), round_ + 1
        if not settled:
            return rows.sparkSession.createDataFrame([], PACKED)
    out = settled[0]
    for more in [*settled[1:], pool]:
        out = out.unionByName(more)
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from placed pieces that carry ids: sequence_id, ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
