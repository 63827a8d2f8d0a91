"""Token-id files: canonical length-limited Huffman codes from global counts.

Documents are tokenised once.  Global counts of ids give one length-limited code
(package-merge), sent to all tasks; its size is bound by the vocabulary.  Documents are
then coded, dealt by ranges of (doc_id, a hash of their bits) to one partition each, and
written in ascending order, so ids that many rows share are dealt too.

File: ``HWID`` magic, the code lengths of all ids, then independent blocks.  A block has
its documents' ids and numbers of ids, a bit offset for every ``STRIDE`` ids of a
document (checkpoints), and the bits; each document begins on a byte.  A reader decodes
all stretches between checkpoints of a block at the same time through one table of
``2^max_bits`` entries.

Defined cases
-------------
* A null or empty text holds the end id only.
* Every row is a document of its own: repeated doc_ids, equal rows too, ordered by a hash
  of their bits, then their bits.  Null doc_ids come first.
* Very long texts are encoded in stretches and held whole as coded bits, in one block.
* Only doc_id and text are read, so other columns can't clash.
* An empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hanweave.llm import storage, tokenise

MAGIC = b"HWID0001"
STRIDE = 256
NO_ID = -(2**63)


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); 0 for counts of 0."""
    used = np.flatnonzero(counts)
    n = len(used)
    out = np.zeros(len(counts), np.uint8)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids don't fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    lists = [np.ones(n, bool)]
    now = leaf
    for _ in range(max_bits - 1):
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, pairs])
        place = np.argsort(both, kind="stable")
        lists.append(place < n)
        now = both[place]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for flags in reversed(lists):
        leaves = int(flags[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    size = lengths[order].astype(np.int64)
    code, last = 0, 0
    if len(order):
        # the code of each length's first id; within a length codes count up
        for bits in range(1, int(size[-1]) + 1):
            code <<= 1
            at = np.flatnonzero(size == bits)
            if len(at):
                codes[order[at]] = code + np.arange(len(at))
                code += len(at)
            last = bits
    assert code <= 1 << max(last, 1)
    return codes


def coded(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """``(bits of all documents, byte bounds of each, bit position of each id in its document)``."""
    own = lengths[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(own)])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    bits = ends[bounds[1:]] - ends[bounds[:-1]]
    at = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    inside = ends[:-1] - np.repeat(ends[bounds[:-1]], sizes)
    place = inside + np.repeat(at[:-1] * 8, sizes)
    words = np.zeros(int(at[-1]) // 4 + 3, np.uint32)
    if len(ids):
        word = place >> 5
        value = codes[ids].astype(np.uint64) << (64 - own - (place & 31)).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.bitwise_or.reduceat(value >> np.uint64(32), first).astype(np.uint32)
        words[word[first] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first).astype(np.uint32)
    return words.astype(">u4").tobytes()[: int(at[-1])], at, inside


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=1)))
        codes, used = canonical(lengths), np.flatnonzero(lengths)
        self.table = np.zeros(1 << self.bits, np.uint32)
        span = np.int64(1) << (self.bits - lengths[used].astype(np.int64))
        first = codes[used].astype(np.int64) * span
        order = np.argsort(first)
        fill = np.repeat(used[order].astype(np.uint32) << np.uint32(6) | lengths[used][order].astype(np.uint32), span[order])
        self.table[: len(fill)] = fill

    def decode(self, data: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of all stretches, one after another: ``counts[i]`` ids from bit ``starts[i]``."""
        raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
        wide = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        order = np.argsort(-counts, kind="stable")
        pos, left = starts[order].copy(), counts[order]
        to = (np.cumsum(counts) - counts)[order]
        out = np.zeros(int(counts.sum()), np.uint32)
        # stretches in falling order of length: those that go on are always the first ones
        going = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")
        down = np.uint32(32 - self.bits)
        for step, n in enumerate(going.tolist()):
            p = pos[:n]
            entry = self.table[(wide[p >> 3] << (p & 7).astype(np.uint32)) >> down]
            out[to[:n] + step] = entry >> np.uint32(6)
            p += (entry & np.uint32(63)).astype(np.int64)
        return out


def _tokenise(path: str, end_id: int):
    """Task: documents to groups of ids; the task's counts go with its last row."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        model = tokenise.encoder(path)
        total = np.zeros(0, np.int64)

        def batch(doc_id, sizes, blob, counts):
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array([x], k) for x, k in zip((doc_id, sizes, blob, counts), kinds)], names=["doc_ids", "sizes", "planes", "counts"])

        for doc_id, texts in tokenise.text_groups(batches, ("doc_id", "text")):
            ids, sizes = model.encode(texts)
            whole = np.insert(ids, np.cumsum(sizes), np.uint32(end_id))
            seen = np.bincount(whole)
            if len(seen) > len(total):
                total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
            total[: len(seen)] += seen
            planes = whole.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            yield batch(doc_id, (sizes + 1).tolist(), press.compress(planes), None)
        if len(total):
            yield batch(None, None, None, press.compress(total.astype("<i8").tobytes()))

    return run


def _opened(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _counts(batches):
    import pyarrow as pa
    import zstandard

    total = np.zeros(0, np.int64)
    for b in batches:
        for blob in b.column(0).to_pylist():
            seen = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8")
            if len(seen) > len(total):
                total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
            total[: len(seen)] += seen
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["id", "n"])


def dealt(ids: np.ndarray, mark: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The part of each id among sorted cuts; an id that is cut several times is dealt by its mark (32 bits)."""
    lo, hi = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
    # between two cuts an id has one part; from the first to the last of equal cuts it has several
    return np.where(hi - lo > 1, lo + 1 + ((mark * (hi - lo - 1)) >> 32), hi)


def _encode(shared):
    """Task: groups of ids to coded documents, each with the file that its id falls to."""

    def run(batches):
        import pyarrow as pa

        lengths, cuts = shared.value
        codes = canonical(lengths)
        for b in batches:
            for doc_ids, sizes, blob in zip(*(b.column(n).to_pylist() for n in ("doc_ids", "sizes", "planes"))):
                ids, sizes = _opened(blob), np.array(sizes, np.int64)
                data, at, inside = coded(ids, sizes, lengths, codes)
                first = np.cumsum(sizes) - sizes
                marks = [inside[f : f + n : STRIDE].astype("<i8").tobytes() for f, n in zip(first.tolist(), sizes.tolist())]
                bits = [data[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                mark = np.array([zlib.crc32(x) for x in bits], np.int64)
                yield pa.record_batch(
                    [
                        pa.array(dealt(np.array([NO_ID if d is None else d for d in doc_ids], np.int64), mark, cuts).astype(np.int32)),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(mark),
                        pa.array(sizes),
                        pa.array(marks, pa.binary()),
                        pa.array(bits, pa.binary()),
                    ],
                    names=["part", "doc_id", "mark", "n", "marks", "bits"],
                )

    return run


def block(docs: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
    """One independent block of (doc_id, number of ids, checkpoints, bits)."""
    null = np.array([d is None for d, *_ in docs], np.uint8).tobytes()
    ids = np.array([d or 0 for d, *_ in docs], "<i8").tobytes()
    sizes = np.array([n for _, n, _, _ in docs], "<i8").tobytes()
    spans = np.array([len(x) for *_, x in docs], "<i8")
    # checkpoints as bits since the one before, so that they stay small
    marks = np.concatenate([np.diff(np.frombuffer(m, "<i8"), prepend=0) for _, _, m, _ in docs]).astype("<u2").tobytes()
    body = null + ids + sizes + spans.tobytes() + marks + b"".join(x for *_, x in docs)
    return struct.pack("<qqq", len(docs), len(marks) // 2, len(body)) + body


def header(lengths: np.ndarray) -> bytes:
    import zstandard

    table = zstandard.ZstdCompressor(level=9).compress(lengths.astype(np.uint8).tobytes())
    return MAGIC + struct.pack("<q", len(table)) + table


def read_blocks(data: bytes):
    """``(doc_ids, numbers of ids, ids)`` of each block of a file."""
    import zstandard

    if data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    (n,) = struct.unpack_from("<q", data, 8)
    decoder = Decoder(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[16 : 16 + n]), np.uint8))
    at = 16 + n
    while at < len(data):
        docs, n_marks, size = struct.unpack_from("<qqq", data, at)
        at += 24
        null = np.frombuffer(data, np.uint8, docs, at)
        ids, sizes, spans = (np.frombuffer(data, "<i8", docs, at + docs + 8 * docs * i) for i in range(3))
        low = at + docs * 25
        steps = np.frombuffer(data, "<u2", n_marks, low).astype(np.int64)
        body = data[low + 2 * n_marks : at + size]
        at += size
        per = -(-sizes // STRIDE)
        first = np.cumsum(per) - per
        total = np.cumsum(steps)
        marks = total - np.repeat(total[first] - steps[first], per)
        starts = marks + np.repeat((np.cumsum(spans) - spans) * 8, per)
        counts = np.full(n_marks, STRIDE, np.int64)
        counts[first + per - 1] = sizes - (per - 1) * STRIDE
        yield [None if z else int(i) for i, z in zip(ids, null)], sizes, decoder.decode(body, starts, counts)


def _write(shared, folder: str, file_ids: int, block_ids: int):
    """Task: a part's coded documents in order to files of about ``file_ids`` ids; a row for each file."""

    def run(batches):
        import pyarrow as pa

        lengths, _ = shared.value
        head = header(lengths)
        out: list[bytes] = []
        held: list[tuple] = []
        state = {"part": None, "file": 0, "ids": 0, "docs": 0, "block": 0}

        def close():
            if held:
                out.append(block(held))
                held.clear()
            uri = storage.write_file(folder, f"part-{state['part']:06d}", b"".join(out))
            row = [[state["part"]], [state["file"]], [uri], [state["docs"]], [state["ids"]]]
            out.clear()
            return pa.record_batch([pa.array(x, k) for x, k in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "place", "file", "docs", "ids"])

        for b in batches:
            for part, doc_id, _, n, marks, bits in zip(*(c.to_pylist() for c in b.columns)):
                if part != state["part"] or state["ids"] >= file_ids:
                    if state["part"] is not None:
                        yield close()
                    place = state["file"] + 1 if part == state["part"] else 0
                    state |= {"part": part, "file": place, "ids": 0, "docs": 0, "block": 0}
                    out.append(head)
                held.append((doc_id, n, marks, bits))
                state["ids"] += n
                state["docs"] += 1
                state["block"] += n
                if state["block"] >= block_ids:
                    out.append(block(held))
                    held.clear()
                    state["block"] = 0
        if state["part"] is not None:
            yield close()

    return run


def write_ids(docs: DataFrame, path: str, end_id: int = 2, max_bits: int = 18, file_ids: int = 8 << 20, block_ids: int = 1 << 19, most_parts: int = 16384) -> DataFrame:
    """Write all documents (doc_id, text) to token-id files in the shared folder.

    Returns the manifest in the files' order: part, place (in the part), file, docs, ids.
    A part is one partition of the shuffle, of about ``file_ids`` ids, or of more where that
    would make over ``most_parts``; it is written to as many files as it needs.
    """
    spark = docs.sparkSession
    manifest = "part int, place int, file string, docs long, ids long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with storage.scope(spark) as made:
        groups = storage.materialise(rows.mapInArrow(_tokenise(path, end_id), "doc_ids array<long>, sizes array<long>, planes binary, counts binary"), "ids-groups", "uncompressed")
        # at most one row an id of the vocabulary
        found = groups.filter("counts IS NOT NULL").select("counts").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
        if not found:
            return spark.createDataFrame([], manifest)
        counts = np.zeros(max(r.id for r in found) + 1, np.int64)
        for r in found:
            counts[r.id] = r.n
        lengths = code_lengths(counts, max_bits)
        parts = min(-(-int(counts.sum()) // file_ids), most_parts)
        marks = [i / parts for i in range(1, parts)]
        ids = groups.filter("planes IS NOT NULL").select(F.explode("doc_ids").alias("d")).select(F.coalesce("d", F.lit(NO_ID)).alias("d"))
        cuts = ids.select(F.percentile_approx("d", marks, min(100 * parts, 1_000_000))).first()[0] if marks else []
        # equal cuts mark ids that fill several parts
        shared = spark.sparkContext.broadcast((lengths, np.array(sorted(cuts), np.int64)))
        folder = storage.fresh_dir(spark, "ids")
        storage.make_dir(spark, folder)
        done = groups.filter("planes IS NOT NULL").select("doc_ids", "sizes", "planes").mapInArrow(_encode(shared), "part int, doc_id long, mark long, n long, marks binary, bits binary")
        spread = done.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "mark", "bits")
        out = storage.materialise(spread.mapInArrow(_write(shared, folder, file_ids, block_ids), manifest), "ids-manifest")
        made.keep(folder, out)
    return out


def _read(batches):
    """Task: files to a row for each document."""
    import pyarrow as pa

    for b in batches:
        for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            at = base
            for doc_ids, sizes, ids in read_blocks(storage.read_file(uri)):
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(at + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                at += int(ends[-1])


def read_digests(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    base = F.coalesce(F.sum("ids").over(Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    placed = manifest.select("file", base.alias("base")).repartition(max(1, min(manifest.count(), 64 * spark.sparkContext.defaultParallelism)))
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
