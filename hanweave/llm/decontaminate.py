"""Benchmark decontamination by winnowing.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing
A-Z, found on UTF-8 bytes.  A benchmark item's windows are its runs of ``span``
words; an item of fewer words is one window as a whole.  A document word inside any
occurrence of a window is hit.

Fingerprints: of every ``span - k + 1`` consecutive k-gram hashes the smallest are
kept, in items and documents alike, so each shared span of ``span`` words shares a
fingerprint.  Around a document's fingerprint that the benchmark has too, the hit is
extended window by window: each of the ``span - k + 1`` windows that hold the gram is
looked up among the benchmark's windows (two 64-bit hashes), which finds all of them and
no others.  Windows are grouped beforehand: a window that very many items share is one
entry with a list of items, so a passage common to many items and many documents costs
each document one lookup a window, and never a pair an item.  Items shorter than ``span``
have their whole text as their only gram and window.

Windows of the benchmark are sent to all executors where it has at most
``broadcast_words`` words, a checked and fixed bound; beyond it both sides'
fingerprints, then windows, are joined through shuffles, and the results are the same.

Defined cases
-------------
* A null or empty text has no words: nothing is hit.  Items without words have no
  windows.  An empty benchmark hits nothing; empty documents give no rows.
* Every row of documents gives a row, repeated ids too (each with its own text);
  null ids stay null.  Rows of the benchmark with one id count as one item, with the
  windows of all its rows; a null id is written as ``null``.
* Ties of gram hashes in a window keep all their places, on both sides alike.
* Very long texts: tasks take about 256 KB of text at once, a longer text by itself, whole.
* ``decontaminate`` reads doc_id and text alone, so other columns can't clash;
  ``keep_clean`` returns all columns of its input and no others.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanweave.llm import ragged
from hanweave.llm.storage import free_name, materialise, scope

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)``: hashes of all words, and where each text's words begin."""
    low = _LOWER[data]
    is_word = _WORD[low]
    before = np.concatenate([[False], is_word[:-1]]) if len(is_word) else is_word
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start = is_word & ~before
    start[inner] = is_word[inner]
    stop = np.concatenate([~is_word[1:], [True]]) & is_word if len(is_word) else is_word
    stop[inner - 1] = is_word[inner - 1]
    starts = np.flatnonzero(start)
    sizes = np.flatnonzero(stop) + 1 - starts
    return ragged.run_hashes(low, starts, sizes), np.searchsorted(starts, offsets)


def _marks(hashes: np.ndarray, bounds: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all texts: ``(positions, gram hashes)``; no gram crosses a text."""
    grams = ragged.gram_hashes(hashes, k)
    if not len(grams):
        return np.zeros(0, np.int64), grams
    valid = np.ones(len(grams), bool)
    for j in range(1, k):  # starts whose gram would run over a text's end
        at = bounds[1:] - j
        valid[at[(at >= 0) & (at < len(grams))]] = False
    # texts are set apart by w - 1 highest values, and too short texts keep all grams' minima
    top = np.uint64(2**64 - 1)
    order = np.where(valid, np.minimum(grams, top - np.uint64(1)), top)
    pos = ragged.local_minima(order, w)
    # windows across a boundary only add fingerprints on the side that they overlap
    pos = pos[valid[pos]]
    return pos, grams[pos]


def window_hashes(hashes: np.ndarray, starts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the ``m`` words from each start."""
    out = [np.zeros(len(starts), np.uint64) for _ in range(2)]
    for j in range(m):
        own = hashes[starts + j]
        for h, by in zip(out, (ragged.M1, ragged.M2)):
            h *= by
            h += own
    return ragged.mix(out[0]), ragged.mix(out[1] + np.uint64(m))


def _around(at: np.ndarray, first: np.ndarray, stop: np.ndarray, reach: int, span: int) -> np.ndarray:
    """Starts of all windows of ``span`` words, within their text, that hold the gram at ``at``."""
    starts = (at[:, None] - np.arange(reach + 1)).ravel()
    first, stop = np.repeat(first, reach + 1), np.repeat(stop, reach + 1)
    return np.unique(starts[(starts >= first) & (starts + span <= stop)])


class Index:
    """A benchmark's fingerprints and windows, each window once with the list of its items."""

    def __init__(self, items: list[tuple[str, bytes]], span: int, k: int):
        self.span, self.k = span, k
        self.names = [name for name, _ in items]
        data = np.frombuffer(b"".join(text for _, text in items), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(text) for _, text in items])]).astype(np.int64)
        hashes, bounds = words(data, offsets)
        sizes = np.diff(bounds)
        owner = np.repeat(np.arange(len(items)), sizes)
        #: by length of the gram (0: k-grams of long items): marks; windows' length, two hashes and list
        self.tables: dict[int, tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]] = {}
        #: places of the distinct lists in ``members``
        self.first, self.members = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self._known: dict[tuple[int, int, int], int] = {}
        pos, marks = _marks(hashes, bounds, k, span - k + 1)
        long_ = sizes >= span
        keep = long_[owner[pos]] if len(pos) else np.zeros(0, bool)
        starts = np.flatnonzero(long_[owner]) if len(owner) else np.zeros(0, np.int64)
        starts = starts[starts + span <= bounds[1:][owner[starts]]] if len(starts) else starts
        self._add(0, span, marks[keep], hashes, starts, owner)
        for m in np.unique(sizes[(sizes > 0) & ~long_]):
            at = bounds[:-1][sizes == m]
            self._add(int(m), int(m), ragged.gram_hashes(hashes, int(m))[at], hashes, at, owner)

    def _add(self, m: int, size: int, marks: np.ndarray, hashes: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> None:
        if not len(starts):
            return
        a, b = window_hashes(hashes, starts, size)
        item = owner[starts]
        order = np.lexsort((item, b, a))
        a, b, item = a[order], b[order], item[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        one = new | np.concatenate([[True], item[1:] != item[:-1]])  # an item once a window
        a, b, item, new = a[one], b[one], item[one], new[one]
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(item)))
        signs = [np.add.reduceat(ragged.mix(item.astype(np.uint64) * by + ragged.M1), at) for by in (ragged.M1, ragged.M2)]
        lists = np.zeros(len(at), np.int64)
        members = [self.members]
        first = list(self.first)
        for i, key in enumerate(zip(count.tolist(), signs[0].tolist(), signs[1].tolist())):
            if key not in self._known:
                self._known[key] = len(first) - 1
                members.append(item[at[i] : at[i] + count[i]])
                first.append(first[-1] + count[i])
            lists[i] = self._known[key]
        self.first, self.members = np.array(first, np.int64), np.concatenate(members)
        self.tables[m] = (np.unique(marks), size, a[at], b[at], lists)

    def items_of(self, lists) -> list[str]:
        """Names of all items of some lists, sorted, each once."""
        places = np.unique(np.concatenate([self.members[self.first[i] : self.first[i + 1]] for i in lists]))
        return sorted({self.names[i] for i in places.tolist()})


def _hits(hashes: np.ndarray, bounds: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a batch of documents that the benchmark has: begin, end (word positions), list of items."""
    begins, ends, lists = [], [], []
    sizes = np.diff(bounds)
    stop, first = np.repeat(bounds[1:], sizes), np.repeat(bounds[:-1], sizes)
    reach = index.span - index.k
    for m, (known, size, a, b, own) in index.tables.items():
        if m == 0:
            at, marks = _marks(hashes, bounds, index.k, reach + 1)
        else:
            marks = ragged.gram_hashes(hashes, m)
            at = np.arange(len(marks))
            inside = at + m <= stop[at] if len(at) else np.zeros(0, bool)
            at, marks = at[inside], marks[inside]
        at = at[known[np.minimum(np.searchsorted(known, marks), len(known) - 1)] == marks]
        starts = _around(at, first[at], stop[at], reach, size) if m == 0 else at
        x, y = window_hashes(hashes, starts, size)
        near = np.minimum(np.searchsorted(a, x), len(a) - 1)
        # windows of equal first hashes are next to each other; more than one is next to impossible
        while True:
            more = (a[near] == x) & (b[near] < y) & (near + 1 < len(a))
            more[more] = a[near[more] + 1] == x[more]
            if not more.any():
                break
            near[more] += 1
        same = (a[near] == x) & (b[near] == y)
        begins.append(starts[same])
        ends.append(starts[same] + size)
        lists.append(own[near[same]])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in (begins, ends, lists))


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


NONE = digest([])


def _scan(shared):
    """Task: every document against the broadcast index."""

    def run(batches):
        import pyarrow as pa

        index: Index = shared.value
        met: dict[tuple, tuple[int, str]] = {}  # lists of items that documents have met, to their number and digest
        for batch in batches:
            for part in ragged.slices(batch):
                hashes, bounds = words(*ragged.text_bytes(part.column(1)))
                begin, end, lists = _hits(hashes, bounds, index)
                step = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(step, begin, 1)
                np.add.at(step, end, -1)
                covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
                n_hit = covered[bounds[1:]] - covered[bounds[:-1]]
                doc = np.searchsorted(bounds, begin, "right") - 1
                own: dict[int, list[int]] = {}
                for d, i in np.unique(np.stack([doc, lists], 1), axis=0).tolist():
                    own.setdefault(d, []).append(i)
                found = [(0, NONE)] * part.num_rows
                for d, key in own.items():
                    key = tuple(key)
                    if key not in met:
                        if len(met) > 10_000:
                            met.clear()
                        names = index.items_of(key)
                        met[key] = (len(names), digest(names))
                    found[d] = met[key]
                yield pa.record_batch(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array(np.diff(bounds)),
                        pa.array(n_hit),
                        pa.array([n for n, _ in found], pa.int64()),
                        pa.array([x for _, x in found], pa.string()),
                        pa.array(n_hit > 0),
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return run


WINDOWS = "array<struct<pos: long, a: long, b: long>>"


def _emit(span: int, k: int, whole: bool, lengths: tuple[int, ...]):
    """Task for the shuffled path: a row for each fingerprint, with the windows around it.

    ``whole``: benchmark rows, whose short items are one gram; else documents, which
    emit the grams of all short lengths that the benchmark has.
    """
    reach = span - k

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in ragged.slices(batch):
                hashes, bounds = words(*ragged.text_bytes(part.column(1)))
                sizes = np.diff(bounds)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                jobs = [(0, *_marks(hashes, bounds, k, reach + 1))]
                if whole and len(owner):
                    keep = sizes[owner[jobs[0][1]]] >= span
                    jobs[0] = (0, jobs[0][1][keep], jobs[0][2][keep])
                for m in lengths:
                    grams = ragged.gram_hashes(hashes, m)
                    at = np.arange(len(grams))
                    at = bounds[:-1][sizes == m] if whole else at[at + m <= bounds[1:][owner[at]]]
                    jobs.append((m, at, grams[at]))
                for m, at, marks in jobs:
                    own = owner[at] if len(at) else np.zeros(0, np.int64)
                    size, more = (span, reach + 1) if m == 0 else (m, 1)
                    starts = at[:, None] - np.arange(more)
                    inside = (starts >= bounds[:-1][own][:, None]) & (starts + size <= bounds[1:][own][:, None])
                    starts = starts[inside]
                    a, b = window_hashes(hashes, starts, size)
                    pos = starts - np.repeat(bounds[:-1][own], inside.sum(axis=1))
                    items = pa.StructArray.from_arrays([pa.array(pos), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["pos", "a", "b"])
                    cut = np.concatenate([[0], np.cumsum(inside.sum(axis=1))]).astype(np.int32)
                    yield pa.record_batch(
                        [pa.array(np.full(len(at), m, np.int32)), pa.array(marks.view(np.int64)), part.column(0).take(pa.array(own)), pa.ListArray.from_arrays(pa.array(cut), items)],
                        names=["m", "mark", "id", "windows"],
                    )

    return run


def _count_words(batches):
    import pyarrow as pa

    for batch in batches:
        for part in ragged.slices(batch):
            _, bounds = words(*ragged.text_bytes(part.column(1)))
            yield pa.record_batch([part.column(0), pa.array(np.diff(bounds))], names=["id", "n"])


def _met(rows: DataFrame, items: DataFrame, span: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Windows of ``rows`` (row, text) that the benchmark has, and the lists of items.

    The first is (row, begin, end, list), the second (list, item).  Neither join has more
    than one match a row, so Spark's skew join can split a hot fingerprint or window.
    """
    size = items.mapInArrow(_count_words, "id string, n long").filter((F.col("n") > 0) & (F.col("n") < span))
    lengths = tuple(r.n for r in size.select("n").distinct().orderBy("n").collect())  # at most span - 1 values
    schema = "m int, mark long, id {}, windows " + WINDOWS
    known = materialise(items.mapInArrow(_emit(span, k, True, lengths), schema.format("string")), "decon-items")
    spread = known.select("m", F.col("id").alias("item"), F.explode("windows").alias("w")).select("m", "w.a", "w.b", "item").distinct()
    pairs = materialise(spread, "decon-windows")
    # equal lists of items are one: told apart by their number and two sums of hashes
    sums = [F.sum(F.xxhash64(F.lit(i), "item").cast("decimal(38,0)")).alias(n) for i, n in enumerate("xy")]
    signed = pairs.groupBy("m", "a", "b").agg(F.count("*").alias("n"), *sums)
    windows = materialise(signed.select("m", "a", "b", F.sha2(F.concat_ws(",", "n", "x", "y"), 256).alias("list")), "decon-lists")
    named = windows.groupBy("list").agg(F.min(F.struct("m", "a", "b")).alias("w")).select("list", "w.*")
    members = materialise(pairs.join(named.hint("merge"), ["m", "a", "b"]).select("list", "item"), "decon-members")
    marks = rows.mapInArrow(_emit(span, k, False, lengths), schema.format("long")).join(known.select("m", "mark").distinct(), ["m", "mark"], "left_semi")
    around = marks.select("m", F.col("id").alias("row"), F.explode("windows").alias("w")).select("m", "row", "w.*").distinct()
    end = F.col("pos") + F.when(F.col("m") == 0, F.lit(span)).otherwise(F.col("m"))
    hits = around.join(windows, ["m", "a", "b"]).select("row", F.col("pos").alias("begin"), end.alias("end"), "list")
    return materialise(hits, "decon-hits"), members


def _joined(docs: DataFrame, items: DataFrame, span: int, k: int) -> DataFrame:
    """The shuffled path of ``decontaminate``."""
    with scope(docs.sparkSession) as made:
        rows = materialise(docs.withColumn("row", F.monotonically_increasing_id()), "decon-docs")
        hits, members = _met(rows.select("row", "text"), items, span, k)
        runs = F.sort_array(F.collect_set(F.struct("begin", "end")))
        per = hits.groupBy("row").agg(runs.alias("runs"), F.sort_array(F.collect_set("list")).alias("lists"))
        # words in the union of the windows, in order of their beginnings
        start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))

        def add(s, w):
            return F.struct(F.greatest(s["upto"], w["end"]).alias("upto"), (s["n"] + F.greatest(w["end"] - F.greatest(s["upto"], w["begin"]), F.lit(0))).alias("n"))

        per = materialise(per.select("row", F.aggregate("runs", start, add)["n"].alias("n_hit"), "lists", F.sha2(F.concat_ws(",", "lists"), 256).alias("sign")), "decon-rows")
        # documents that meet the same lists share one union of items
        signs = per.groupBy("sign").agg(F.min("lists").alias("lists")).select("sign", F.explode("lists").alias("list"))
        named = signs.join(members, "list").groupBy("sign").agg(F.sort_array(F.collect_set("item")).alias("items"))
        named = materialise(named.select("sign", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")), "decon-named")
        counted = materialise(rows.select("row", "text").mapInArrow(_count_words, "row long, n_words long"), "decon-words")
        found = materialise(per.select("row", "n_hit", "sign").join(named, "sign").drop("sign"), "decon-found")
        made.keep(rows, counted, found)
    out = rows.select("row", "doc_id").join(counted, "row").join(found, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.lit(NONE)).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def named_items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def bounded_items(benchmark: DataFrame, broadcast_words: int) -> list[tuple[str, bytes]] | None:
    """The benchmark's items on the driver, or None if they may have more words than that."""
    items = named_items(benchmark)
    size, most = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    # a word has a byte of its own and one beside it, so bytes bound the words
    if (most or 0) / 2 + size > broadcast_words:
        return None
    return [(r.id, r.text.encode()) for r in items.orderBy("id", "text").collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, broadcast_words: int = 4_000_000) -> DataFrame:
    """Per document: words, hit words, items met, and whether any word is hit.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = bounded_items(benchmark, broadcast_words)
    if rows is None:
        return _joined(docs, named_items(benchmark), span, k)
    return docs.mapInArrow(_scan(spark.sparkContext.broadcast(Index(rows, span, k))), SCHEMA)


def _clean(shared):
    """Task: whole rows of documents without a hit."""

    def run(batches):
        import pyarrow as pa

        index: Index = shared.value
        for batch in batches:
            for part in ragged.slices(batch):
                hashes, bounds = words(*ragged.text_bytes(part.column(part.schema.get_field_index("text"))))
                begin, _, _ = _hits(hashes, bounds, index)
                hit = np.zeros(part.num_rows, bool)
                hit[np.searchsorted(bounds, begin, "right") - 1] = True
                yield part.filter(pa.array(~hit))

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, broadcast_words: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` that meet no window of the benchmark, with all their columns."""
    spark = docs.sparkSession
    rows = bounded_items(benchmark, broadcast_words)
    if rows is None:
        with scope(spark) as made:
            # ids may be null or repeated, so rows are told apart by keys of their own
            key = free_name(docs, "row_key")
            keyed = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "decon-docs")
            texts = keyed.select(F.col(key).alias("row"), F.col("text").cast("string").alias("text"))
            hits, _ = _met(texts, named_items(benchmark), span, k)
            hit = materialise(hits.select(F.col("row").alias(key)).distinct(), "decon-found")
            made.keep(keyed, hit)
        return keyed.join(hit, key, "left_anti").select(*docs.columns)
    return docs.mapInArrow(_clean(spark.sparkContext.broadcast(Index(rows, span, k))), docs.schema)
