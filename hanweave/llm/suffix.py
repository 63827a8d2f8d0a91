"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of ``span`` bytes that covers it also starts earlier: in a
document with a smaller doc_id, or earlier in the same one.  Suffixes can't be sorted in
one place, so they are dealt to tasks such that equal strings of ``span`` bytes meet:

1. Every window of ``span`` bytes is owned by its smallest gram of ``GRAM`` bytes (by
   hash, leftmost at ties); equal windows have equal owners at equal offsets.  Only
   owners whose gram occurs at least twice in the corpus matter further.
2. The windows of one owner form a unit, a stretch of text.  Equal units are one place of
   the suffix order with several positions: all positions but the first have an earlier
   match of at least ``span`` bytes.  A grouped minimum with combining in tasks finds the
   first, whatever their number, and the later ones go.
3. The windows of distinct units around the same gram are put into suffix order together,
   with the lengths of the common prefixes of neighbours.  The previous and the next place
   in that order that hold a smaller text position give each window its longest previous
   factor (``previous_factors``); common prefixes are cut at ``span``, since a factor
   counts from there on.  Windows whose factor has ``span`` bytes go.
4. Where a gram has over ``group`` distinct units, they are halved by the windows'
   offset to the owner, equal halves meet in step 2 again, and so on down to single
   windows; so no task gets an unbounded group.

Tables hold the texts in chunks of whole documents; what tasks need to know about a chunk
is a file named by it in the shared folder, so texts are never shuffled.  Every chunk has
such a file, an empty one if there is nothing to know: an absent file is an error.

Defined cases
-------------
* A null or empty text has no bytes.  Texts shorter than ``span`` lose nothing.
* Null doc_ids come before all others.  Of rows that share a doc_id, the one that comes
  first in the chunk table counts as earlier; so of equal rows one stays whole.
* Very long texts make a chunk of their own, which is worked on in segments of 256 KB.
* Only doc_id and text of the input are read, so other columns can't clash.
* Every row gives a row; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanweave.llm import ragged, storage
from hanweave.llm.storage import materialise

GRAM = 32
FIRST_KEY = -(2**63)
CHUNKS = "chunk long, doc_ids array<long>, tags array<long>, sizes array<long>, data binary"
UNITS = "covered boolean, chunk long, di int, start long, end long, okey long, tag long, anchor long, key long, lo int, hi int, a long, b long, bytes binary"
CONTESTED = "key long, okey long, tag long, chunk long, di int, start long, end long, anchor long, lo int, hi int, bytes binary, n long"
WANTED = ("key", "di", "start", "end", "anchor", "lo", "hi", "n")
SPANS = "chunk long, di int, start long, end long"
_M = (ragged.M1, ragged.M2)
_INVERSE = tuple(np.uint64(pow(int(m), -1, 1 << 64)) for m in _M)
SEGMENT = 1 << 18
MOST_PARTS = 16384


def _chunk(chunk_bytes: int):
    """Task: documents to chunks."""

    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=1)
        base = TaskContext.get().partitionId()
        ids: list = []
        texts: list[bytes] = []
        n_chunks = n_rows = 0

        def flush():
            data = press.compress(b"".join(texts))
            tags = [base << 36 | (n_rows - len(ids) + i) for i in range(len(ids))]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            row = [base << 24 | n_chunks, list(ids), tags, [len(t) for t in texts], data]
            return pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds)], names=["chunk", "doc_ids", "tags", "sizes", "data"])

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode()
                if ids and size + len(data) > chunk_bytes:
                    yield flush()
                    n_chunks += 1
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(data)
                n_rows += 1
                size += len(data)
        if ids:
            yield flush()

    return run


def _opened(batch):
    """``(chunk, doc_ids, tags, bounds, bytes)`` of each row of the chunk table."""
    import zstandard

    for chunk, doc_ids, tags, sizes, data in zip(*(batch.column(n).to_pylist() for n in ("chunk", "doc_ids", "tags", "sizes", "data"))):
        raw = zstandard.ZstdDecompressor().decompress(data)
        yield chunk, doc_ids, np.array(tags, np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.frombuffer(raw, np.uint8)


class Rolling:
    """Hashes of any stretch of a segment in constant time."""

    _powers: dict = {}

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if Rolling._powers.get("n", 0) < n:
            size = max(n, SEGMENT + 256)
            Rolling._powers = {"n": size, "up": [ragged.powers(size, m) for m in _M], "down": [ragged.powers(size, m) for m in _INVERSE]}
        value = ragged._BYTE[data]
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[: len(data)], dtype=np.uint64)]) for up in Rolling._powers["up"]]

    def of(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        return ragged.mix((s[ends] - s[starts]) * Rolling._powers["down"][which][starts] + (ends - starts).astype(np.uint64))

    def grams(self, g: int) -> np.ndarray:
        s = self.sums[0]
        n = max(len(s) - g, 0)
        return ragged.mix((s[g : g + n] - s[:n]) * Rolling._powers["down"][0][:n])


def _segments(bounds: np.ndarray, data: np.ndarray, span: int):
    """``(offset, bytes, valid window starts, gram hashes, owners, rolling)`` of each stretch of a chunk."""
    for lo in range(0, max(len(data) - span + 1, 0), SEGMENT - span):
        part = data[lo : lo + SEGMENT - 1]
        n = min(len(part) - span + 1, SEGMENT - span)
        if n <= 0:
            continue
        rolling = Rolling(part)
        grams = rolling.grams(GRAM)
        packed = grams >> np.uint64(20) << np.uint64(20) | np.arange(len(grams), dtype=np.uint64)
        owner = (ragged.window_min(packed, span - GRAM + 1)[:n] & np.uint64((1 << 20) - 1)).astype(np.int64)
        starts = np.arange(n)
        doc = np.searchsorted(bounds, starts + lo, "right") - 1
        inside = starts + lo + span <= bounds[doc + 1]
        yield lo, part, starts[inside], doc[inside], grams, owner[inside], rolling


def _owners(span: int, buckets: int):
    """Task: chunks to the distinct gram hashes of their windows' owners, by bucket."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for chunk, _, _, bounds, data in _opened(batch):
                found = [grams[np.unique(owner)] for _, _, _, _, grams, owner, _ in _segments(bounds, data, span)]
                if not found:
                    continue
                # segments share no window, but may share an owner: that is no second occurrence
                hashes, count = np.unique(np.concatenate(found), return_counts=True)
                place = (hashes >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(place, kind="stable")
                cut = np.searchsorted(place[order], np.arange(buckets + 1))
                rows = []
                for i in range(buckets):
                    own = order[cut[i] : cut[i + 1]]
                    if len(own):
                        rows.append((i, chunk, hashes[own].tobytes(), (count[own] > 1).tobytes()))
                cols = list(zip(*rows))
                yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["bucket", "chunk", "hashes", "several"])

    return run


def _repeated(batches):
    """Task: rows ordered by bucket; each bucket's hashes to those that occur twice, for each chunk that has them."""
    import pyarrow as pa

    def solve(chunks: list, hashes: list, several: list):
        every = np.concatenate(hashes)
        owner = np.repeat(np.arange(len(chunks)), [len(h) for h in hashes])
        order = np.argsort(every, kind="stable")
        h, o, s = every[order], owner[order], np.concatenate(several)[order]
        run = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
        keep = (np.bincount(run) > 1)[run] | (np.bincount(run, s) > 0)[run]
        h, o = h[keep], o[keep]
        order = np.argsort(o, kind="stable")
        cut = np.searchsorted(o[order], np.arange(len(chunks) + 1))
        found = [(chunk, h[order[x:y]].tobytes()) for chunk, x, y in zip(chunks, cut[:-1], cut[1:]) if y > x]
        return pa.record_batch([pa.array([c for c, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["chunk", "blob"])

    at, chunks, hashes, several = None, [], [], []
    for batch in batches:
        for bucket, chunk, h, s in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != at:
                if chunks:
                    yield solve(chunks, hashes, several)
                at, chunks, hashes, several = bucket, [], [], []
            hashes.append(np.frombuffer(h, np.uint64))
            several.append(np.frombuffer(s, bool))
            chunks.append(chunk)
    if chunks:
        yield solve(chunks, hashes, several)


def _side(folder: str):
    """Task: rows ordered by chunk to one file a chunk; its contents depend on the rows alone."""

    def run(batches):
        import pyarrow as pa

        held: list[bytes] = []
        at = None
        n = 0

        def close():
            uri = storage.write_file(folder, "new", b"".join(sorted(held)))
            system, path = storage.file_system(uri)
            system.move(path, storage.file_system(f"{folder}/{at}")[1])

        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if chunk != at:
                    if at is not None:
                        close()
                    at, held, n = chunk, [], n + 1
                held.append(blob)
        if at is not None:
            close()
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    return run


def _side_files(rows: DataFrame, chunks: DataFrame, name: str) -> str:
    """Write (chunk, blob) rows as one file for every chunk, empty where it has none, and return the folder."""
    spark = rows.sparkSession
    folder = storage.fresh_dir(spark, name)
    storage.make_dir(spark, folder)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = rows.unionByName(chunks.select("chunk", F.lit(b"").alias("blob")))
    every.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(_side(folder), "n long").agg(F.sum("n")).collect()
    return folder


def _side_file(folder: str, chunk: int) -> bytes:
    return storage.read_file(f"{folder}/{chunk}")


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching stretches of the same document as one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    step = np.int64(max(int(end.max()), 1) + 2)
    most = np.maximum.accumulate(end + doc * step)
    new = np.concatenate([[True], (start + doc * step)[1:] > most[:-1]])
    first = np.flatnonzero(new)
    return doc[first], start[first], most[np.append(first[1:], len(doc)) - 1] - doc[first] * step


def _unit_batch(covered, rows: dict):
    import pyarrow as pa

    n = len(rows["chunk"])
    kinds = {"chunk": pa.int64(), "di": pa.int32(), "start": pa.int64(), "end": pa.int64(), "okey": pa.int64(), "tag": pa.int64(), "anchor": pa.int64(), "key": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "a": pa.int64(), "b": pa.int64(), "bytes": pa.binary()}
    arrays = [pa.array(np.full(n, covered))]
    arrays += [pa.array(rows[k], k_) if k in rows else pa.nulls(n, k_) for k, k_ in kinds.items()]
    return pa.record_batch(arrays, names=["covered", *kinds])


def _units(span: int, folder: str):
    """Task: chunks to units around repeated grams; copies within the chunk are covered at once."""

    def run(batches):
        for batch in batches:
            for chunk, doc_ids, tags, bounds, data in _opened(batch):
                flagged = np.unique(np.frombuffer(_side_file(folder, chunk), np.uint64))
                if not len(flagged):
                    continue
                okeys = np.array([FIRST_KEY if d is None else d for d in doc_ids], np.int64)
                gone = [np.zeros(0, np.int64)] * 3
                kept: list[dict] = []
                for lo, part, starts, doc, grams, owner, rolling in _segments(bounds, data, span):
                    spots, back = np.unique(owner, return_inverse=True)
                    keep = np.isin(grams[spots], flagged)[back]
                    s, d, o = starts[keep], doc[keep], owner[keep]
                    if not len(s):
                        continue
                    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1] + 1) | (o[1:] != o[:-1])]))
                    last = np.append(new[1:], len(s)) - 1
                    a0, e0, own, di = s[new], s[last] + span, o[new], d[new]
                    tail = (own - a0).astype(np.uint64)
                    unit = {
                        "chunk": np.full(len(a0), chunk), "di": di, "start": a0 + lo - bounds[di], "end": e0 + lo - bounds[di], "okey": okeys[di], "tag": tags[di],
                        "anchor": own + lo - bounds[di], "key": grams[own].view(np.int64), "lo": np.zeros(len(a0), np.int32), "hi": np.full(len(a0), span - GRAM, np.int32),
                        "a": ragged.mix(rolling.of(a0, e0, 0) + tail * ragged.M2).view(np.int64), "b": ragged.mix(rolling.of(a0, e0, 1) + tail * ragged.M1).view(np.int64),
                    }
                    order = np.lexsort((unit["start"], unit["tag"], unit["okey"], unit["b"], unit["a"]))
                    first = np.concatenate([[True], (unit["a"][order][1:] != unit["a"][order][:-1]) | (unit["b"][order][1:] != unit["b"][order][:-1])])
                    more = order[~first]
                    gone = [np.concatenate([g, x]) for g, x in zip(gone, (unit["di"][more], unit["start"][more], unit["end"][more]))]
                    mine = np.sort(order[first])
                    kept.append({k: v[mine] for k, v in unit.items()})
                di, start, end = merged(*gone)
                if len(di):
                    yield _unit_batch(True, {"chunk": np.full(len(di), chunk), "di": di.astype(np.int32), "start": start, "end": end})
                for unit in kept:
                    unit["di"] = unit["di"].astype(np.int32)
                    yield _unit_batch(False, unit)

    return run


def _wanted(batches):
    """Task: contested units to blobs by chunk."""
    import pyarrow as pa

    for batch in batches:
        rows = np.stack([batch.column(n).to_numpy().astype("<i8") for n in ("chunk", *WANTED)], 1)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        names, first = np.unique(rows[:, 0], return_index=True)
        cut = np.append(first, len(rows))
        yield pa.record_batch([pa.array(names), pa.array([rows[x:y, 1:].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())], names=["chunk", "blob"])


def _fetch(folder: str):
    """Task: chunks to the contested units in them, with their bytes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for chunk, doc_ids, tags, bounds, data in _opened(batch):
                rows = np.frombuffer(_side_file(folder, chunk), "<i8").reshape(-1, len(WANTED))
                if not len(rows):
                    continue
                at = {n: rows[:, i] for i, n in enumerate(WANTED)}
                okeys = np.array([FIRST_KEY if d is None else d for d in doc_ids], np.int64)
                raw = data.tobytes()
                lo, hi = at["start"] + bounds[at["di"]], at["end"] + bounds[at["di"]]
                out = at | {"okey": okeys[at["di"]], "tag": tags[at["di"]], "chunk": np.full(len(rows), chunk), "bytes": [raw[x:y] for x, y in zip(lo.tolist(), hi.tolist())]}
                kinds = [(n.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[n.split()[1]]) for n in CONTESTED.split(", ")]
                yield pa.record_batch([pa.array(out[n] if n == "bytes" else out[n].astype(k.to_pandas_dtype()), k) for n, k in kinds], names=[n for n, _ in kinds])

    return run


def _halved(span: int):
    """Task: units to their two halves by the windows' offset to the owner."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("chunk", "di", "start", "end", "okey", "tag", "anchor", "key", "lo", "hi", "a", "b", "bytes")}
            names = ["chunk", "di", "start", "end", "okey", "tag", "anchor", "key", "lo", "hi", "bytes"]
            spans, blobs, cores = [], [], []
            for chunk, di, start, end, okey, tag, anchor, key, lo, hi, raw in zip(*(batch.column(n).to_pylist() for n in names)):
                mid = (lo + hi) // 2
                for x, y in ((lo, mid), (mid + 1, hi)):
                    s, e = max(start, anchor - y), min(end - span, anchor - x) + span
                    if x > y or e - s < span:
                        continue
                    for k, v in zip(names, (chunk, di, s, e, okey, tag, anchor, key, x, y, raw[s - start : e - start])):
                        out[k].append(v)
                    blobs.append(raw[s - start : e - start])
                    core = raw[max(anchor - x - start, 0) : anchor - y + span - start]
                    cores.append(core)
                    spans.append(anchor - s)
            if not blobs:
                continue
            for which, name in enumerate(("a", "b")):
                out[name] = _hash(blobs, spans, which)
            turn = np.array(out["lo"], np.uint64) * np.uint64(span) + np.array(out["hi"], np.uint64)
            out["key"] = ragged.mix(np.array(out["key"], np.int64).view(np.uint64) + _hash(cores, turn, 0).view(np.uint64)).view(np.int64)
            yield _unit_batch(False, out)

    return run


def _hash(blobs: list[bytes], more, which: int) -> np.ndarray:
    sizes = np.array([len(x) for x in blobs], np.int64)
    data = np.frombuffer(b"".join(blobs), np.uint8)
    h = ragged.run_hashes(data, np.cumsum(sizes) - sizes, sizes, _M[which])
    return ragged.mix(h + np.asarray(more).astype(np.uint64) * _M[1 - which]).view(np.int64)


def suffix_order(text: np.ndarray, starts: np.ndarray, group: np.ndarray, rank: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, common)``: suffixes by group and their first ``span`` bytes, ties by rank.

    ``common[i]`` is the length of the common prefix, cut at ``span``, of places i - 1 and
    i; 0 where a group begins.
    """
    width = -(-span // 8)
    window = np.zeros((len(starts), width * 8), np.uint8)
    window[:, :span] = text[starts[:, None] + np.arange(span)]
    words = window.view(">u8").astype(np.uint64)
    order = np.lexsort((rank, *(words[:, i] for i in reversed(range(width))), group))
    words, group = words[order], group[order]
    common = np.zeros(len(starts), np.int64)
    if len(starts) > 1:
        differ = words[1:] ^ words[:-1]
        first = np.argmax(differ != 0, axis=1)
        word = differ[np.arange(len(first)), first]
        # zero bytes before the first byte that differs, in a word whose first byte is its highest
        same = 8 * first
        for cut in range(1, 8):
            same += word >> np.uint64(64 - 8 * cut) == 0
        common[1:] = np.where(word == 0, span, np.minimum(same, span)) * (group[1:] == group[:-1])
    return order, common


def smaller_neighbours(rank: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(places, common prefixes)`` of the previous smaller rank of each place; -1 and 0 for none.

    All places between a place and its candidate have a larger rank, and so has what lies
    between the candidate and its own; so a candidate of a larger rank is replaced by its
    own candidate, and distances double.  A common prefix of 0 can't grow again: such a
    place has no factor on that side.
    """
    n = len(rank)
    near = np.arange(-1, n - 1)
    low = common.copy()
    near[low == 0] = -1
    going = np.flatnonzero(near >= 0)
    while len(going):
        going = going[rank[near[going]] > rank[going]]
        at = near[going]
        least, to = np.minimum(low[going], low[at]), near[at]
        none = (least == 0) | (to < 0)
        low[going], near[going] = np.where(none, 0, least), np.where(none, -1, to)
        going = going[~none]
    return near, low


def previous_factors(text: np.ndarray, starts: np.ndarray, group: np.ndarray, rank: np.ndarray, span: int) -> np.ndarray:
    """Each suffix's longest previous factor in its group, cut at ``span``.

    ``rank`` orders the suffixes by where they start in the corpus.  The longest match with
    an earlier start lies at the nearest smaller rank before or after in suffix order.
    """
    order, common = suffix_order(text, starts, group, rank, span)
    place = rank[order]
    _, before = smaller_neighbours(place, common)
    # the same from the other end: what place i shares with i + 1 is common[i + 1]
    _, after = smaller_neighbours(place[::-1], np.append(common[1:], 0)[::-1])
    out = np.zeros(len(starts), np.int64)
    out[order] = np.maximum(before, after[::-1])
    return out


def _factors(span: int, windows: int = 50_000):
    """Task: rows ordered by key to the stretches of windows with an earlier match."""

    def solve(rows: list[tuple]):
        keys, okey, tag, start, size = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2, 5, 7))
        text = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
        base = np.cumsum(size) - size
        n = size - span + 1
        owner = np.repeat(np.arange(len(rows)), n)
        at = ragged.ranges(base, n)
        place = at - base[owner] + start[owner]
        rank = np.zeros(len(at), np.int64)
        rank[np.lexsort((place, tag[owner], okey[owner]))] = np.arange(len(at))
        hit = np.flatnonzero(previous_factors(text, at, keys[owner], rank, span) >= span)
        chunk, di = (np.array([r[i] for r in rows], np.int64)[owner[hit]] for i in (3, 4))
        names, doc = np.unique(np.stack([chunk, di], 1), axis=0, return_inverse=True) if len(hit) else (np.zeros((0, 2), np.int64), hit)
        doc, lo, hi = merged(doc.ravel(), place[hit], place[hit] + span)
        return names[doc, 0], names[doc, 1], lo, hi

    def run(batches):
        import pyarrow as pa

        held: list[tuple] = []
        amount = 0

        def flush():
            chunk, di, lo, hi = solve(held)
            return pa.record_batch([pa.array(chunk), pa.array(di.astype(np.int32)), pa.array(lo), pa.array(hi)], names=["chunk", "di", "start", "end"])

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("key", "okey", "tag", "chunk", "di", "start", "bytes"))):
                if amount > windows and held[-1][0] != row[0]:
                    yield flush()
                    held, amount = [], 0
                held.append((*row, len(row[6])))
                amount += len(row[6]) - span + 1
        if held:
            yield flush()

    return run


def _spans(batches):
    """Task: covered stretches to blobs by chunk, merged within the batch."""
    import pyarrow as pa

    for batch in batches:
        chunk, di, start, end = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
        order = np.argsort(chunk, kind="stable")
        chunk, di, start, end = chunk[order], di[order], start[order], end[order]
        names, first = np.unique(chunk, return_index=True)
        cut = np.append(first, len(chunk))
        blobs = [np.stack(merged(di[x:y], start[x:y], end[x:y]), 1).astype("<i8").tobytes() for x, y in zip(cut[:-1], cut[1:])]
        yield pa.record_batch([pa.array(names), pa.array(blobs, pa.binary())], names=["chunk", "blob"])


def _cut(folder: str):
    """Task: chunks to documents without the covered bytes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for chunk, doc_ids, _, bounds, data in _opened(batch):
                found = np.frombuffer(_side_file(folder, chunk), "<i8").reshape(-1, 3)
                di, start, end = merged(found[:, 0], found[:, 1], found[:, 2])
                step = np.zeros(len(data) + 1, np.int64)
                np.add.at(step, start + bounds[di], 1)
                np.add.at(step, end + bounds[di], -1)
                keep = np.cumsum(step[:-1]) == 0
                sums = np.concatenate([[0], np.cumsum(keep)])
                left = data[keep].tobytes()
                n_spans = np.bincount(di, minlength=len(doc_ids))
                sizes = np.diff(bounds)
                kept = sums[bounds]
                yield pa.record_batch(
                    [
                        pa.array(doc_ids, pa.int64()), pa.array(sizes), pa.array(sizes - np.diff(kept)), pa.array(n_spans.astype(np.int64)),
                        pa.array([left[x:y] for x, y in zip(kept[:-1].tolist(), kept[1:].tolist())], pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, span: int = 100, chunk_bytes: int = 1 << 20, group: int = 128) -> DataFrame:
    """Per document (row of doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (bytes)."""
    if span <= GRAM:
        raise ValueError(f"span must be over {GRAM}")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with storage.scope(spark) as made:
        chunks = materialise(rows.mapInArrow(_chunk(chunk_bytes), CHUNKS), "suffix-chunks", "uncompressed")
        n_chunks = chunks.count()
        if not n_chunks:
            return spark.createDataFrame([], "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
        with storage.scope(spark) as work:
            gone = _side_files(_covered(chunks, n_chunks, span, chunk_bytes, group).mapInArrow(_spans, "chunk long, blob binary"), chunks, "suffix-spans")
            work.keep(gone)
        made.keep(chunks, gone)
    return chunks.mapInArrow(_cut(gone), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _covered(chunks: DataFrame, n_chunks: int, span: int, chunk_bytes: int, group: int) -> DataFrame:
    """All stretches (chunk, di, start, end) that windows with an earlier start cover."""
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a bucket holds the hashes of about 32 MB of text, at least 64 buckets
    buckets = max(64, n_chunks * chunk_bytes >> 25)
    owners = chunks.mapInArrow(_owners(span, buckets), "bucket int, chunk long, hashes binary, several binary")
    # a task takes its buckets one after another, so their number doesn't set that of the partitions
    dealt = owners.repartition(min(buckets, MOST_PARTS), "bucket").sortWithinPartitions("bucket")
    repeated = dealt.mapInArrow(_repeated, "chunk long, blob binary")
    flags = _side_files(repeated, chunks, "suffix-flags")
    units = materialise(chunks.mapInArrow(_units(span, flags), UNITS), "suffix-units")
    covered = [units.filter("covered").select("chunk", "di", "start", "end")]
    now = units.filter("NOT covered")
    first = True
    while True:
        # of equal units all but the first are covered
        place = F.struct("okey", "tag", "start")
        firsts = now.groupBy("key", "a", "b").agg(F.min(place).alias("f"), F.count("*").alias("n")).filter("n > 1").select("key", "a", "b", "f")
        firsts = materialise(firsts, "suffix-firsts")
        later = F.coalesce(place != F.col("f"), F.lit(False))
        columns = ["key", "okey", "tag", "chunk", "di", "start", "end", "anchor", "lo", "hi"]
        judged = now.join(firsts.hint("merge"), ["key", "a", "b"], "left").select(*columns, later.alias("later"), F.when(~later, F.col("bytes")).alias("bytes"))
        judged = materialise(judged, "suffix-judged")
        covered.append(judged.filter("later").select("chunk", "di", "start", "end"))
        left = judged.filter("NOT later").drop("later")
        several = materialise(left.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-several")
        contested = left.join(several.hint("merge"), "key").select(*[c.split()[0] for c in CONTESTED.split(", ")])
        if first:  # only now are bytes needed, and of these units alone
            wanted = _side_files(contested.mapInArrow(_wanted, "chunk long, blob binary"), chunks, "suffix-wanted")
            contested, first = chunks.mapInArrow(_fetch(wanted), CONTESTED), False
        contested = materialise(contested, "suffix-contested")
        small = contested.filter(F.col("n") <= group).drop("n").repartition(parts, "key").sortWithinPartitions("key")
        covered.append(materialise(small.mapInArrow(_factors(span), SPANS), "suffix-factors"))
        large = contested.filter(F.col("n") > group)
        if large.isEmpty():
            break
        now = materialise(large.mapInArrow(_halved(span), UNITS), "suffix-halves")
    every = covered[0]
    for part in covered[1:]:
        every = every.unionByName(part)
    return every
