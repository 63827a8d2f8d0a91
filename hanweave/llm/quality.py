"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Each passage gets a vector of
frequencies of pairs of byte classes, hashed frequencies of its words, and the shape and
repetition of its words, and is encoded by a dense layer; gated attention, learnt from the
documents' labels alone, weighs the passages, and a logistic layer scores their weighted
sum.  A bad passage in an otherwise good document so gets the weight that its label asks
for.

The model is fitted on the driver on at most ``max_train_docs`` labelled documents (a
documented bound on rows; those whose id hashes lowest), on every passage of each.  Tasks
write the features of ``BATCH`` documents to one file in the shared folder; the driver
reads a file, and of that ``BLOCK`` passages, at a time.  Every whole text is scored, in
batches, on the executors.  Labels, language, source and id are no inputs.

Defined cases
-------------
* A null or empty text is one passage without words.
* Very long texts are scored and learnt from whole.  A word without end is one word of one
  passage: lengths enter as logarithms or cut, so all features and scores are finite.
* Labels that are null, or whose id is null, teach nothing; of repeated labels of an id
  the mean counts, rounded to nearest (ties to 1).  Without labels of both kinds all
  scores are the share of label 1, or 0.5 without any.
* Every row of documents gives a row; equal texts have equal scores, and equal labelled
  rows count as often as they occur.  Other columns pass through ``score`` whatever their
  names, but for one named score, which it replaces.  An empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hanweave.llm import ragged, storage
from hanweave.llm.simjoin import word_hashes
from hanweave.llm.storage import materialise

PASSAGE = 64
BATCH = 64  # documents of a step of training
BLOCK = 1 << 14  # passages whose features training takes at once
CLASSES = 16
HASHED = 256
EXTRA = 14
WIDTH = CLASSES * CLASSES + HASHED + EXTRA
_CLASS = np.full(256, 15, np.uint8)  # other signs
_CLASS[0x61:0x7B] = 0
for _c in b"aeiouy":
    _CLASS[_c] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[[9, 32]] = 4
_CLASS[[10, 13]] = 5
for _i, _signs in enumerate((b".", b",;:", b"!?", b"'\"()[]{}", b"#$%&*@^~", b"-_/\\+=", b"|<>")):
    _CLASS[list(_signs)] = 6 + _i
_CLASS[0x80:0xC0] = 13  # continuation bytes
_CLASS[0xC0:] = 14


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(features, bounds)``: a row for each passage of all texts, at least one a text."""
    hashes, bounds = word_hashes(data, offsets)
    n_words = np.diff(bounds)
    n_docs = len(n_words)
    per = np.maximum(1, -(-n_words // PASSAGE))
    ends = np.concatenate([[0], np.cumsum(per)])
    total = int(ends[-1])
    doc = np.repeat(np.arange(n_docs), n_words)
    inside = np.arange(len(hashes)) - np.repeat(bounds[:-1], n_words)
    at = ends[:-1][doc] + inside // PASSAGE if len(hashes) else np.zeros(0, np.int64)
    # bytes belong to the passage of the word that began last
    space = np.isin(data, (9, 10, 11, 12, 13, 32))
    start = ~space
    start[1:] &= space[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start[inner] = ~space[inner]
    word_at = np.flatnonzero(start)
    stop = ~space
    stop[:-1] &= space[1:]
    stop[inner - 1] = ~space[inner - 1]
    word_end = np.flatnonzero(stop) + 1
    first = np.repeat(offsets[:-1], per)
    later = np.flatnonzero((inside % PASSAGE == 0) & (inside > 0))
    first[at[later]] = word_at[later]
    size = np.diff(np.append(first, offsets[-1]))
    owner = np.repeat(np.arange(total), size)
    kind = _CLASS[data].astype(np.int64)
    out = np.zeros((total, WIDTH), np.float32)
    if len(data) > 1:
        pair = kind[:-1] * CLASSES + kind[1:]
        same = np.ones(len(pair), bool)
        same[inner - 1] = False
        count = np.bincount((owner[:-1] * (CLASSES * CLASSES) + pair)[same], minlength=total * CLASSES * CLASSES)
        out[:, : CLASSES * CLASSES] = np.sqrt(count.reshape(total, -1) / np.maximum(size, 1)[:, None])
    words = np.bincount(at, minlength=total).astype(np.float64)
    some = np.maximum(words, 1)
    if len(hashes):
        bucket = (hashes >> np.uint64(40)).astype(np.int64) % HASHED
        count = np.bincount(at * HASHED + bucket, minlength=total * HASHED)
        out[:, CLASSES * CLASSES : CLASSES * CLASSES + HASHED] = np.sqrt(count.reshape(total, -1) / some[:, None])

    def share(flags: np.ndarray, where: np.ndarray = at) -> np.ndarray:
        return np.bincount(where, flags.astype(np.float64), total) / some

    extra = np.zeros((total, EXTRA))
    extra[:, 0] = np.log1p(words)
    extra[:, 1] = np.log1p(size)
    extra[:, 2] = np.log1p(size / some)
    if len(hashes):
        length = word_end - word_at
        extra[:, 3] = np.sqrt(np.maximum(share(np.minimum(length, 100) ** 2) - share(np.minimum(length, 100)) ** 2, 0))
        extra[:, 4] = share(length > 20)
        for j, lag in enumerate((1, 2, 3)):
            again = np.zeros(len(hashes), bool)
            again[lag:] = (hashes[lag:] == hashes[:-lag]) & (doc[lag:] == doc[:-lag])
            extra[:, 5 + j] = share(again)
        _, one = np.unique(ragged.mix(hashes + at.astype(np.uint64) * ragged.M2), return_index=True)
        extra[:, 8] = np.bincount(at[one], minlength=total) / some
        tri = ragged.gram_hashes(hashes, 3)
        whole = np.flatnonzero(doc[: len(tri)] == doc[len(doc) - len(tri) :])  # not across texts
        if len(whole):
            key = ragged.mix(tri[whole] + doc[whole].astype(np.uint64) * ragged.M2)
            _, back, n = np.unique(key, return_inverse=True, return_counts=True)
            extra[:, 9] = share(n[back] > 1, at[whole])
        head, tail = kind[word_at], kind[word_end - 1]
        extra[:, 10] = share(head == 2)
        extra[:, 11] = share(tail >= 6)
    for j, c in enumerate((2, 10)):
        extra[:, 12 + j] = np.bincount(owner, kind == c, total) / np.maximum(size, 1)
    out[:, CLASSES * CLASSES + HASHED :] = extra
    return out, ends


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _blocks(model: dict, x):
    """``(slice, features on the model's scale)``, a block of passages at a time."""
    for lo in range(0, len(x), BLOCK):
        own = x[lo : lo + BLOCK]
        yield slice(lo, lo + len(own)), ((own - model["mean"]) / model["std"]).clip(-8, 8)


def _forward(model: dict, x, bounds: np.ndarray):
    """All layers over the passages ``x``, which ``bounds`` cut into bags."""
    h = np.tanh(np.concatenate([own @ model["W"] for _, own in _blocks(model, x)]) + model["b"])
    t, s = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    e = (t * s) @ model["w"]
    first, sizes = bounds[:-1], np.diff(bounds)
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
    a /= np.repeat(np.add.reduceat(a, first), sizes)
    z = np.add.reduceat(a[:, None] * h, first)
    return h, t, s, a, z, z @ model["c"] + model["o"]


def scores(model: dict, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if "share" in model:
        return np.full(len(bounds) - 1, model["share"])
    return _sigmoid(_forward(model, x, bounds)[-1].astype(np.float64))


def gradients(model: dict, x, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Of the mean logistic loss by each weight of the model, through the gated attention."""
    sizes = np.diff(bounds)
    h, t, s, a, z, logit = _forward(model, x, bounds)
    d = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(h.dtype)
    dz = np.repeat(d[:, None] * model["c"], sizes, axis=0)
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, bounds[:-1]), sizes))
    dt = de[:, None] * model["w"] * s * (1 - t * t)
    ds = de[:, None] * model["w"] * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ model["V"].T + ds @ model["U"].T) * (1 - h * h)
    return {
        "W": sum(own.T @ dh[part] for part, own in _blocks(model, x)), "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds,
        "w": (de[:, None] * t * s).sum(0), "c": z.T @ d, "o": d.sum(),
    }


def fit(bags: list[tuple], hidden: int = 32, gate: int = 16, epochs: int = 30, rate: float = 2e-3, decay: float = 1e-4) -> dict:
    """A model by Adam; each of ``bags`` is a step: (passages, bounds, labels, weights).

    Passages may be any array that can be sliced; a block of them is held at a time.
    """
    y = np.concatenate([np.zeros(0), *(own for _, _, own, _ in bags)])
    weight = np.concatenate([np.zeros(0), *(own for _, _, _, own in bags)])
    if len(np.unique(y)) < 2:
        return {"share": float((y * weight).sum() / weight.sum()) if len(y) else 0.5}
    rng = np.random.default_rng(7)
    cuts = [(x, lo) for x, *_ in bags for lo in range(0, len(x), BLOCK)]
    total = sum(len(x) for x, *_ in bags)
    mean = sum(x[lo : lo + BLOCK].sum(0, dtype=np.float64) for x, lo in cuts) / total
    spread = sum(((x[lo : lo + BLOCK] - mean) ** 2).sum(0) for x, lo in cuts) / total
    f = len(mean)
    model = {
        "mean": mean,
        "std": np.sqrt(spread) + 1e-3,
        "W": rng.normal(0, 1 / np.sqrt(f), (f, hidden)),
        "b": np.zeros(hidden),
        "V": rng.normal(0, 1 / np.sqrt(hidden), (hidden, gate)),
        "U": rng.normal(0, 1 / np.sqrt(hidden), (hidden, gate)),
        "w": rng.normal(0, 1 / np.sqrt(gate), gate),
        "c": rng.normal(0, 1 / np.sqrt(hidden), hidden),
        "o": np.zeros(()),
    }
    model = {k: v.astype(np.float32) for k, v in model.items()}
    names = ["W", "b", "V", "U", "w", "c", "o"]
    m1, m2 = ({k: np.zeros_like(model[k]) for k in names} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        now = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(bags)):
            grad = gradients(model, *bags[i])
            step += 1
            for k in names:
                g = grad[k] + decay * model[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                model[k] = (model[k] - now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    if not all(np.isfinite(v).all() for v in model.values()):
        raise ArithmeticError("the model has weights that aren't finite")
    return model


class Stored:
    """Passages' features in a file of the shared folder, read a slice at a time; the last slice stays."""

    def __init__(self, uri: str, n: int):
        self.uri, self.n = uri, n
        self.at, self.held = None, None

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, part: slice) -> np.ndarray:
        lo, hi, _ = part.indices(self.n)
        if self.at != (lo, hi):
            self.held = np.frombuffer(storage.read_part(self.uri, lo * WIDTH * 4, (hi - lo) * WIDTH * 4), "<f4").reshape(-1, WIDTH)
            self.at = (lo, hi)
        return self.held


def _features(rows: int = 4096):
    """Task: labelled documents to their passages' features, in rows of at most so many passages."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in ragged.slices(batch):
                x, ends = passages(*ragged.text_bytes(part.column(part.schema.get_field_index("text"))))
                for i, (place, label, n) in enumerate(zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("place", "label", "n")))):
                    for k, lo in enumerate(range(ends[i], ends[i + 1], rows)):
                        own = x[lo : min(lo + rows, ends[i + 1])]
                        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                        yield pa.record_batch([pa.array([v], t) for v, t in zip((place, k, label, n, len(own), own.astype("<f4").tobytes()), kinds)], names=["place", "k", "label", "n", "size", "data"])

    return run


def _batched(folder: str):
    """Task: features ordered by (place, k) to one file for each ``BATCH`` places; a row for each file."""

    def run(batches):
        import pyarrow as pa

        def files():
            at, row, out, close = None, None, None, None
            for batch in batches:
                for place, _, label, n, size, data in zip(*(c.to_pylist() for c in batch.columns)):
                    if place // BATCH != at:
                        if row:
                            close.__exit__(None, None, None)
                            yield row
                        at, close = place // BATCH, storage.new_file(folder, "features")
                        uri, out = close.__enter__()
                        row = {"batch": at, "uri": uri, "places": [], "sizes": [], "labels": [], "weights": []}
                    if not row["places"] or row["places"][-1] != place:
                        for k, v in (("places", place), ("sizes", 0), ("labels", label), ("weights", n)):
                            row[k].append(v)
                    row["sizes"][-1] += size
                    out.write(data)
            if row:
                close.__exit__(None, None, None)
                yield row

        for row in files():
            kinds = [pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3]
            yield pa.record_batch([pa.array([row[k]], t) for k, t in zip(("batch", "uri", "sizes", "labels", "weights"), kinds)], names=["batch", "uri", "sizes", "labels", "weights"])

    return run


def _score(shared, name: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in ragged.slices(batch):
                x, ends = passages(*ragged.text_bytes(part.column(part.schema.get_field_index("text"))))
                yield pa.record_batch([*part.columns, pa.array(scores(shared.value, x, ends), pa.float64())], names=[*part.schema.names, name])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id's text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = 6000, label_col: str = "quality") -> dict:
    """A model from labels of rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    spark = docs.sparkSession
    with storage.scope(spark):
        # at most max_train_docs rows of two numbers: small enough to broadcast, whatever the input
        sample = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs), "quality-sample")
        text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        own = materialise(text.join(F.broadcast(sample), "doc_id").withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary"))), "quality-texts")
        # a repeated id has several texts; equal rows are encoded once and count n times
        order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("digest")]
        first = own.select("doc_id", "digest").orderBy(*order).limit(max_train_docs)
        picked = first.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
        # one window over at most max_train_docs rows of ids
        picked = materialise(picked.withColumn("place", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")), "quality-picked")
        once = own.join(F.broadcast(picked), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
        folder = storage.fresh_dir(spark, "quality-features")
        storage.make_dir(spark, folder)
        rows = once.mapInArrow(_features(), "place long, k long, label int, n long, size long, data binary")
        steps = math.ceil(max_train_docs / BATCH)
        dealt = rows.repartition(steps, F.floor(F.col("place") / BATCH)).sortWithinPartitions("place", "k")
        manifest = materialise(dealt.mapInArrow(_batched(folder), "batch long, uri string, sizes array<long>, labels array<long>, weights array<long>"), "quality-manifest")
        # a row for each step, of at most BATCH documents' numbers, without their features
        bags = []
        for r in manifest.orderBy("batch").collect():
            bounds = np.concatenate([[0], np.cumsum(r.sizes)]).astype(np.int64)
            bags.append((Stored(r.uri, int(bounds[-1])), bounds, np.array(r.labels, np.float64), np.array(r.weights, np.float64)))
        return fit(bags)


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the probability of label 1 of every whole text."""
    columns = [c for c in docs.columns if c != name]
    schema = docs.select(*columns).schema.add(name, "double")
    return docs.select(*columns).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), name), schema)


def classify(docs: DataFrame, labels: DataFrame, max_train_docs: int = 6000) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, max_train_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = score(rows, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
