"""Near-duplicate documents by a chosen-path similarity join on word shingles.

Words are runs of bytes other than ASCII white space; a document's set holds its
shingles of ``width`` words (all words as one shingle where they are fewer).  Two
documents are linked if the Jaccard similarity of their sets is at least ``num / den``.

Rows with equal word sequences are one set with a multiplicity.  Each of several runs
splits the sets on the shared token that a random order puts first (a minhash); buckets
over ``leaf_rows`` sets whose members share little are split again on ``branch`` further
sampled tokens, down to ``depth`` levels.  Small buckets are compared by brute force, and
so are large ones of truly similar sets or of the last level, in pairs of blocks that
bound every task in rows and in shingles.  The number of runs follows from ``recall``:
with about that probability a pair at the threshold meets in some leaf (the estimate takes
tokens as independent; the tests measure it on planted pairs).  What meets is checked on
the whole sets (48-bit shingle hashes), so no link is wrong, and pairs that meet in
several leaves count in the first of them only.

Large groups of near copies: Jaccard distances obey the triangle inequality, so sets that
differ from one pivot by at most half the allowed distance are all linked with each other.
Of the largest leaves (at most ``PIVOTS``, a fixed bound) a middle set is taken as a pivot;
one more pass over the texts finds the sets around each, its core.  Links inside a core are
counted without comparing, and a leaf's most frequent core is compared with the leaf's other
sets only.  Which pivots are taken changes the work, not the links.

Links are kept as counts and as a spanning forest of each leaf, never as all pairs;
classes come from alternating large-star and small-star rounds over those edges.

Defined cases
-------------
* A null, empty or blank text has no words: no links, a class of its own.
* Every row is a document; repeated rows are copies of one another, and a repeated or null
  doc_id names no document: texts are found again by (doc_id, hash of the text).  A class
  is named by its smallest non-null doc_id (null if it has none).
* Ties: ``keep_one`` keeps the row with the smallest id, then the first in the input.
* Very long texts: tasks take about 256 KB of text at once, a longer text by itself, whole;
  its set is held whole, and leaves of large sets are dealt into more blocks.
* ``near_duplicates`` reads doc_id and text alone, so other columns can't clash;
  ``keep_one`` returns all columns of its input and no others.
* An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hanweave.llm import ragged
from hanweave.llm.storage import free_name, materialise, scope

TOKENS = 32
PIVOTS = 128
PIVOT_SHINGLES = 1 << 15  # pivots are no larger, so what is broadcast has a fixed bound
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = ragged.mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * ragged.M2) | np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes of all words, where each text's words begin)``."""
    word = ~_SPACE[data]
    start, stop = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start[inner] = word[inner]
    stop[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(start)
    return ragged.run_hashes(data, starts, np.flatnonzero(stop) + 1 - starts), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(shingle hashes, bounds)`` of all texts; short texts have one shingle, empty ones none."""
    sizes = np.diff(bounds)
    n = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    grams = ragged.gram_hashes(hashes, width) if len(hashes) >= width else np.zeros(0, np.uint64)
    at = ragged.ranges(bounds[:-1], n)
    out = grams[np.minimum(at, max(len(grams) - 1, 0))] if len(grams) else np.zeros(len(at), np.uint64)
    ends = np.concatenate([[0], np.cumsum(n)])
    for i in np.flatnonzero((sizes > 0) & (sizes < width)):
        own = hashes[bounds[i] : bounds[i + 1]]
        out[ends[i]] = ragged.gram_hashes(own, len(own))[0] ^ np.uint64(len(own))
    return out, ends


def identities(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's sequence of words."""
    sizes = np.diff(bounds)
    full = sizes > 0
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], sizes)
    out = []
    for m in (ragged.M1, ragged.M2):
        h = np.zeros(len(sizes), np.uint64)
        if len(hashes):
            h[full] = np.add.reduceat(hashes * ragged.powers(int(sizes.max()) + 1, m)[place], bounds[:-1][full])
        out.append(ragged.mix(h + sizes.astype(np.uint64)))
    return tuple(out)


def _tokens(grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sampled tokens of each set: for each of ``TOKENS`` random orders the first shingle's hash; 0 for empty sets."""
    full = np.diff(ends) > 0
    tokens = np.zeros((len(full), TOKENS), np.int32)
    if len(grams):
        for t in range(TOKENS):
            low = np.minimum.reduceat(grams * _ODD[t], ends[:-1][full])
            tokens[full, t] = ragged.mix(low).astype(np.uint32).view(np.int32)
    return tokens


def _sketch(width: int):
    """Task: documents (doc_id, text, others) to identity hashes, sampled tokens and the others."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in ragged.slices(batch):
                hashes, bounds = word_hashes(*ragged.text_bytes(part.column(1)))
                grams, ends = shingles(hashes, bounds, width)
                a, b = identities(hashes, bounds)
                full = np.diff(ends) > 0
                tokens = _tokens(grams, ends)
                held = pa.FixedSizeListArray.from_arrays(pa.array(tokens.ravel()), TOKENS).cast(pa.list_(pa.int32()))
                none = ~full
                yield pa.record_batch(
                    [part.column(0), pa.array(a.view(np.int64), mask=none), pa.array(b.view(np.int64), mask=none), held, pa.array(np.diff(ends)), *part.columns[2:]],
                    names=["doc_id", "a", "b", "tokens", "size", *part.schema.names[2:]],
                )

    return run


def _own_sets(width: int):
    """Task: texts (sid, a, b, text) to their whole sets."""

    def run(batches):
        import pyarrow as pa

        for part in (part for batch in batches for part in ragged.slices(batch)):
            hashes, bounds = word_hashes(*ragged.text_bytes(part.column(part.schema.get_field_index("text"))))
            grams, ends = shingles(hashes, bounds, width)
            grams &= np.uint64((1 << 48) - 1)
            blobs = [np.unique(grams[x:y]).astype("<u8").tobytes() for x, y in zip(ends[:-1], ends[1:])]
            yield pa.record_batch([part.column(part.schema.get_field_index("sid")), pa.array(blobs, pa.binary())], names=["sid", "grams"])

    return run


def _cores(shared, width: int, num: int, den: int):
    """Task: texts to (a, b, core) where a set is within half the allowed distance of a pivot."""

    def run(batches):
        import pyarrow as pa

        names, tokens, sets = shared.value
        sizes = np.array([len(x) for x in sets])
        for part in (part for batch in batches for part in ragged.slices(batch)):
            hashes, bounds = word_hashes(*ragged.text_bytes(part.column(part.schema.get_field_index("text"))))
            grams, ends = shingles(hashes, bounds, width)
            n = np.diff(ends)
            # shingles may repeat in a text, so their number only bounds the set's size from above
            some = np.flatnonzero(n >= sizes.min() * num / den)
            if not len(some):
                continue
            grams, ends = grams[ragged.ranges(ends[:-1][some], n[some])], np.concatenate([[0], np.cumsum(n[some])])
            own = _tokens(grams, ends)
            alike = np.stack([(own == t).sum(axis=1) for t in tokens], 1)
            best = alike.argmax(axis=1)
            asked = np.flatnonzero(alike[np.arange(len(best)), best] >= TOKENS // 2)
            grams &= np.uint64((1 << 48) - 1)
            found = []
            for i in asked.tolist():
                one, pivot = np.unique(grams[ends[i] : ends[i + 1]]), sets[best[i]]
                common = len(np.intersect1d(one, pivot, assume_unique=True))
                # similarity of at least (1 + num / den) / 2
                if common * 2 * den >= (num + den) * (len(one) + len(pivot) - common):
                    found.append((int(some[i]), names[best[i]]))
            if found:
                a, b = identities(hashes, bounds)
                at = np.array([i for i, _ in found])
                yield pa.record_batch([pa.array(a[at].view(np.int64)), pa.array(b[at].view(np.int64)), pa.array([c for _, c in found], pa.int64())], names=["a", "b", "core"])

    return run


def _middles(rows: list) -> list:
    """Of sampled rows (leaf, sid, tokens, ...) by leaf the one that shares most tokens with the others, if it is unlike those before."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.leaf, []).append(r)
    chosen: list = []
    for _, own in sorted(by.items(), key=lambda x: (-x[1][0].n, x[0])):
        tokens = np.array([r.tokens for r in own])
        share = [(tokens == t).mean() for t in tokens]
        middle = own[int(np.argmax(share))]
        if all(np.mean(np.array(middle.tokens) == np.array(c.tokens)) < 0.95 for c in chosen):
            chosen.append(middle)
    return chosen


def cores(rows: DataFrame, sets: DataFrame, members: DataFrame, kept: DataFrame, width: int, num: int, den: int, least: int) -> tuple[DataFrame, DataFrame] | None:
    """Sets (sid, core) in the cores of the largest leaves, and those leaves; None if none has over ``least`` sets."""
    spark = rows.sparkSession
    top = kept.filter(F.col("n") > least).orderBy(F.desc("n"), "leaf").limit(PIVOTS).select("leaf", "n").collect()
    if not top:
        return None
    top = F.broadcast(spark.createDataFrame(top, "leaf long, n long"))  # at most PIVOTS rows
    # about 32 sets of each leaf, of which one is to be its pivot: a sample that decides about work only
    picked = members.select("leaf", "sid").join(top, "leaf").filter(F.pmod(F.xxhash64("sid", "leaf"), F.ceil(F.col("n") / 32)) == 0).limit(128 * PIVOTS)
    known = sets.select("sid", "tokens", "size", "low", "t").filter(F.col("size") <= PIVOT_SHINGLES)
    chosen = _middles(known.join(F.broadcast(picked), "sid").collect())
    if not chosen:
        return None
    wanted = spark.createDataFrame([(r.sid, r.low, r.t) for r in chosen], "sid long, low long, low_t long")
    texts = rows.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("t") == F.col("low_t")))
    # at most PIVOTS sets of at most PIVOT_SHINGLES shingles
    found = {r.sid: np.frombuffer(r.grams, "<u8") for r in texts.dropDuplicates(["sid"]).select("sid", "text").mapInArrow(_own_sets(width), "sid long, grams binary").collect()}
    chosen = [r for r in chosen if r.sid in found]
    shared = spark.sparkContext.broadcast(([r.sid for r in chosen], np.array([r.tokens for r in chosen], np.int32), [found[r.sid] for r in chosen]))
    near = rows.select("text").mapInArrow(_cores(shared, width, num, den), "a long, b long, core long").groupBy("a", "b").agg(F.min("core").alias("core"))
    return materialise(near.join(sets.select("a", "b", "sid"), ["a", "b"]).select("sid", "core"), "join-cores"), top


def _spread(width: int):
    """Task: texts of representatives to their whole sets (48-bit hashes), a row for each place to compare them at."""

    def run(batches):
        import pyarrow as pa

        names = ["leaf", "pair", "side", "sid", "copies", "core", "grams", "leaves"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        last = None  # equal rows come one after another from the merge join: one of them is enough
        for part in (part for batch in batches for part in ragged.slices(batch)):
            sids = part.column(part.schema.get_field_index("sid")).to_numpy()
            new = sids != np.concatenate([[-1 if last is None else last], sids[:-1]])
            last = int(sids[-1])
            part = part.filter(pa.array(new))
            if part.num_rows:
                hashes, bounds = word_hashes(*ragged.text_bytes(part.column(part.schema.get_field_index("text"))))
                grams, ends = shingles(hashes, bounds, width)
                a, b = identities(hashes, bounds)
                right = (a.view(np.int64) == part.column("a").to_numpy()) & (b.view(np.int64) == part.column("b").to_numpy())
                grams &= np.uint64((1 << 48) - 1)
                rows, amount = [], 0
                own = zip(*(part.column(n).to_pylist() for n in ("sid", "copies", "core", "places")))
                for x, y, ok, (sid, copies, core, places) in zip(ends[:-1], ends[1:], right, own):
                    if not ok:
                        continue
                    one = np.unique(grams[x:y])
                    blob = one.astype("<u4").tobytes() + (one >> np.uint64(32)).astype("<u2").tobytes()
                    leaves = sorted({p["leaf"] for p in places})
                    for p in places:
                        rows.append((p["leaf"], p["pair"], p["side"], sid, copies, core, blob, leaves))
                        amount += len(blob) + 8 * len(leaves)
                        if amount > 8 << 20:  # a set of many blocks goes out bit by bit
                            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, amount = [], 0
                if rows:
                    yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _opened(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return np.frombuffer(blob, "<u4", n).astype(np.uint64) | np.frombuffer(blob, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def _common(sets: list[np.ndarray], cells: int = 8 << 20) -> np.ndarray:
    """Sizes of all pairwise intersections, through products of 0/1 matrices."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.int64)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    token = np.cumsum(new) - 1
    count = np.bincount(token)
    shared = count[token] >= 2
    names, column = np.unique(token[shared], return_inverse=True)
    owner = owner[shared]
    out = np.zeros((n, n), np.float64)
    step = max(1, cells // n)
    for lo in range(0, len(names), step):
        at = (column >= lo) & (column < lo + step)
        m = np.zeros((n, min(step, len(names) - lo)), np.float32)
        m[owner[at], column[at] - lo] = 1
        out += m @ m.T
    out[np.arange(n), np.arange(n)] = sizes
    return np.rint(out).astype(np.int64)


def _verify(num: int, den: int):
    """Task: rows ordered by (leaf, pair of blocks) to counts of links and forest edges."""

    def compare(leaf: int, side: np.ndarray, rows: list[tuple]):
        sets = [_opened(r[3]) for r in rows]
        sizes = np.array([len(s) for s in sets], np.int64)
        common = _common(sets)
        linked = common * (den + num) >= num * (sizes[:, None] + sizes[None, :])
        linked &= common > 0
        cross = side.max() > side.min()
        linked &= (side[:, None] != side[None, :]) if cross else ~np.eye(len(rows), dtype=bool)
        core = np.array([r[2] for r in rows], np.int64)
        linked &= (core[:, None] != core[None, :]) | (core < 0)[:, None]  # links inside a core are counted already
        i, j = np.nonzero(np.triu(linked, 1))
        if not len(i):
            return
        # a pair counts in the first leaf that both sets are in
        earlier = [np.array([x for x in r[4] if x < leaf], np.int64) for r in rows]
        names, place = np.unique(np.concatenate(earlier), return_inverse=True)
        if len(names):
            m = np.zeros((len(rows), len(names)), np.float32)
            m[np.repeat(np.arange(len(rows)), [len(e) for e in earlier]), place] = 1
            keep = (m @ m.T)[i, j] < 0.5
            i, j = i[keep], j[keep]
        copies = np.array([r[1] for r in rows], np.int64)
        links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        sid = np.array([r[0] for r in rows], np.int64)
        root = np.arange(len(rows))
        while len(i):  # smallest sid of each component, by pointer jumping
            low = np.minimum(sid[root[i]], sid[root[j]])
            best = sid[root]
            np.minimum.at(best, i, low)
            np.minimum.at(best, j, low)
            spot = {int(s): k for k, s in enumerate(sid)}
            new = np.array([spot[int(s)] for s in best])
            new = new[new]
            if (new == root).all():
                break
            root = new
        for k in np.flatnonzero(links > 0):
            yield int(sid[k]), int(sid[root[k]]), int(round(links[k]))

    def run(batches):
        import pyarrow as pa

        def out(found):
            cols = list(zip(*found)) or [(), (), ()]
            return pa.record_batch([pa.array(list(c), pa.int64()) for c in cols], names=["sid", "root", "links"])

        held: list[tuple] = []
        side: list[int] = []
        at = None
        found: list[tuple] = []
        for batch in batches:
            for leaf, pair, s, sid, copies, core, grams, leaves in zip(*(c.to_pylist() for c in batch.columns)):
                if (leaf, pair) != at:
                    if len(held) > 1:
                        found += compare(at[0], np.array(side), held)
                    held, side, at = [], [], (leaf, pair)
                if held and held[-1][0] == sid:
                    continue  # a repeated row of the representative
                held.append((sid, copies, core, grams, leaves))
                side.append(s)
            if len(found) > 10_000:
                yield out(found)
                found = []
        if len(held) > 1:
            found += compare(at[0], np.array(side), held)
        yield out(found)

    return run


def runs_for(recall: float, similarity: float, branch: int, depth: int) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``."""
    later = (1 - (1 - similarity) ** branch) ** (depth - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity * later)))


def leaves(sets: DataFrame, runs: int, branch: int, depth: int, leaf_rows: int) -> DataFrame:
    """Buckets to compare by brute force: leaf, sid, size (of the set), at least two sets each."""
    level = sets.select("sid", "tokens", F.posexplode(F.slice("tokens", 1, runs)).alias("run", "token"))
    level = level.select("sid", "tokens", "run", F.xxhash64("run", "token").alias("node"))
    parts = []
    for d in range(1, depth + 1):
        sizes = level.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        sizes = materialise(sizes, "join-sizes")
        if d == 1:
            level = materialise(level.select("sid", "run", "node"), "join-level")
        members = level.join(sizes, "node")
        large = sizes.filter(F.col("n") > leaf_rows)
        if d == depth or large.isEmpty():
            parts.append(members.select(F.col("node").alias("leaf"), "sid", "n"))
            break
        # children by further tokens; a node whose sets agree on most of them is dense and stays a leaf
        inner = members.filter(F.col("n") > leaf_rows).join(sets.select("sid", "tokens"), "sid")
        picks = F.transform(F.sequence(F.lit(0), F.lit(branch - 1)), lambda j: (F.lit(runs + 1) + (F.col("run") * branch + j + (d - 1) * 7) % (TOKENS - runs)).cast("int"))
        split = inner.select("sid", "run", "node", "n", F.explode(F.transform(picks, lambda p: F.struct(p.alias("p"), F.element_at("tokens", p).alias("t")))).alias("c"))
        split = materialise(split.select("sid", "run", "node", "n", F.xxhash64("node", "c.p", "c.t").alias("child"), F.col("c.p").alias("p")), "join-children")
        kids = split.groupBy("node", "p", "child").agg(F.count("*").alias("k"), F.first("n").alias("n"))
        share = kids.groupBy("node").agg((F.sum(F.col("k").cast("double") * F.col("k")) / F.first("n") / F.first("n") / branch).alias("agree"))
        dense = materialise(share.filter(F.col("agree") >= 0.35).select("node"), "join-dense")
        small = members.filter(F.col("n") <= leaf_rows).select(F.col("node").alias("leaf"), "sid", "n")
        parts += [small, members.filter(F.col("n") > leaf_rows).join(dense, "node", "left_semi").select(F.col("node").alias("leaf"), "sid", "n")]
        level = materialise(split.join(dense, "node", "left_anti").select("sid", "run", F.col("child").alias("node")).distinct(), "join-level")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return materialise(every.select("leaf", "sid").join(sets.select("sid", "size"), "sid"), "join-leaves")


def components(edges: DataFrame) -> DataFrame:
    """Classes of the graph: v, root (the smallest vertex of its class), by star rounds."""
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "cc")
    state = None
    while True:
        # large star: every larger neighbour links to the smallest vertex around
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        now = materialise(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "cc")
        # small star: the smaller neighbours and the vertex itself link to the smallest
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        moved = now.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialise(moved.filter("u <> v").distinct(), "cc")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            return now.select(F.col("u").alias("sid"), F.col("v").alias("root"))
        state = tuple(new)


def dealt(members: DataFrame, found: tuple[DataFrame, DataFrame] | None, leaf_rows: int, block_rows: int, block_shingles: int) -> DataFrame:
    """Where each set of each leaf is compared: of members (leaf, sid, n, weight, size) sid, core and an array ``p`` of places.

    A small leaf is one place.  A large one, of many sets or of large ones, is dealt into
    blocks, and each pair of blocks is a place.  In the largest leaves the most frequent core
    has blocks of its own, and two of those are no place, since their links are known.
    """
    big = (F.col("n") > leaf_rows) | (F.col("weight") > block_shingles)
    if found is None:
        at = members.select("*", F.lit(None).cast("long").alias("core"), F.lit(None).cast("long").alias("main"), F.lit(0).alias("k"), F.lit(0).alias("w"))
    else:
        inside, top = found
        cored = members.join(inside, "sid", "left")
        per = cored.filter("core IS NOT NULL").join(top.select("leaf"), "leaf").groupBy("leaf", "core").agg(F.count("*").alias("k"), F.sum("size").alias("w"))
        main = per.groupBy("leaf").agg(F.max(F.struct("k", "core", "w")).alias("m")).select("leaf", F.col("m.core").alias("main"), F.col("m.k").alias("k"), F.col("m.w").alias("w"))
        at = cored.join(F.broadcast(main), "leaf", "left")  # a row for each of the largest leaves
    number = lambda k, w: F.greatest(F.ceil(k / block_rows), F.ceil(w / block_shingles)).cast("int")
    k, w = F.coalesce("k", F.lit(0)), F.coalesce("w", F.lit(0))
    at = at.withColumn("first", F.when(big, number(k, w)).otherwise(0))
    at = at.withColumn("others", F.when(big, number(F.col("n") - k, F.col("weight") - w)).otherwise(1))
    inner = F.coalesce(F.col("main") == F.col("core"), F.lit(False)) & big
    hashed = F.xxhash64("sid", "leaf")
    block = F.when(inner, F.pmod(hashed, F.greatest("first", F.lit(1)))).otherwise(F.col("first") + F.pmod(hashed, F.greatest("others", F.lit(1)))).cast("int")
    at = at.withColumn("inner", inner).withColumn("block", block).withColumn("blocks", F.col("first") + F.col("others"))
    # a set of the core meets the others' blocks, any other set meets all
    met = F.when(F.col("others") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.when(F.col("inner"), F.col("first")).otherwise(0), F.col("blocks") - 1))
    place = F.transform(
        met,
        lambda j: F.struct("leaf", (F.least("block", j).cast("long") * F.col("blocks") + F.greatest("block", j)).alias("pair"), F.when(F.col("block") <= j, 0).otherwise(1).alias("side")),
    )
    return at.select("sid", "core", place.alias("p"))


def _core_links(inside: DataFrame, sets: DataFrame) -> DataFrame:
    """(sid, root, links) of the links inside cores."""
    own = inside.join(sets.select("sid", "copies"), "sid")
    whole = own.groupBy("core").agg(F.sum("copies").alias("all"), F.min("sid").alias("root"))
    return own.join(whole, "core").select("sid", "root", (F.col("all") - F.col("copies")).alias("links"))


def _classes(
    docs: DataFrame, key: str | None = None, num: int = 4, den: int = 5, width: int = 5, recall: float = 0.99999, branch: int = 3, depth: int = 4,
    leaf_rows: int = 512, block_rows: int = 768, block_shingles: int = 1 << 20, core_rows: int = 1024,
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, a, b, rid) and sets (a, b, sid, low, copies, links, root; with a ``key`` of rows best, too).

    ``rid`` is the row's ``key`` if there is one, and ``best`` then the set's first row by id.
    """
    runs = runs_for(recall, num / den, branch, depth)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    schema = "doc_id long, a long, b long, tokens array<int>, size long, t long"
    with scope(spark) as made:
        if key is None:
            sketched = rows.mapInArrow(_sketch(width), schema).withColumn("rid", F.monotonically_increasing_id())
            best = []
        else:
            keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col(key).alias("rid"))
            sketched = keyed.mapInArrow(_sketch(width), schema + ", rid long")
            best = [F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")).alias("best")]
        sketched = materialise(sketched, "join-rows")
        # where a set's text is found again: its smallest id, and the hash of a text with that id
        where = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t")).alias("at")
        grouped = sketched.filter("a IS NOT NULL").groupBy("a", "b").agg(F.min("rid").alias("sid"), where, F.min("tokens").alias("tokens"), F.max("size").alias("size"), F.count("*").alias("copies"), *best)
        sets = materialise(grouped.select("a", "b", "sid", F.col("at.doc_id").alias("low"), F.col("at.t").alias("t"), "tokens", "size", "copies", *(["best"] if best else [])), "join-sets")
        buckets = leaves(sets.select("sid", "tokens", "size"), runs, branch, depth, leaf_rows)
        # buckets of the same sets need one comparison
        h = F.xxhash64("sid").cast("decimal(38,0)")
        alike = buckets.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(h).alias("x"), F.sum(F.xxhash64(F.lit(1), "sid").cast("decimal(38,0)")).alias("y"), F.sum("size").alias("weight"))
        kept = materialise(alike.groupBy("n", "x", "y", "weight").agg(F.min("leaf").alias("leaf")).select("leaf", "n", "weight"), "join-kept")
        members = materialise(buckets.join(kept, "leaf"), "join-members")
        centred = cores(rows, sets, members, kept, width, num, den, core_rows)
        placed = dealt(members, centred, leaf_rows, block_rows, block_shingles)
        own = placed.groupBy("sid").agg(F.flatten(F.collect_list("p")).alias("places"), F.first("core").alias("core"))
        needed = materialise(sets.join(own.filter(F.size("places") > 0), "sid").select("sid", "low", F.col("t").alias("low_t"), "a", "b", "copies", F.coalesce("core", F.lit(-1)).cast("long").alias("core"), "places"), "join-needed")
        found_again = F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("t") == F.col("low_t"))
        texts = rows.join(needed.hint("merge"), found_again).select("sid", "copies", "core", "a", "b", "places", "text")
        joined = texts.mapInArrow(_spread(width), "leaf long, pair long, side int, sid long, copies long, core long, grams binary, leaves array<long>")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        compared = joined.repartition(parts, "leaf", "pair").sortWithinPartitions("leaf", "pair", "side", "sid")
        found = compared.mapInArrow(_verify(num, den), "sid long, root long, links long")
        found = materialise(found if centred is None else found.unionByName(_core_links(centred[0], sets)), "join-found")
        links = found.groupBy("sid").agg(F.sum("links").alias("links"))
        classes = components(found.select(F.col("sid").alias("u"), F.col("root").alias("v")))
        named = sets.drop("tokens").join(links, "sid", "left").join(classes, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        named = materialise(named, "join-named")
        made.keep(sketched, named)
    return sketched, named


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per document (row of doc_id, text): doc_id, class_id, n_links."""
    with scope(docs.sparkSession) as made:
        sketched, named = _classes(docs, **options)
        lowest = materialise(named.groupBy("root").agg(F.min("low").alias("class_id")), "join-lowest")
        resolved = materialise(named.join(lowest, "root").select("a", "b", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "join-resolved")
        made.keep(sketched, resolved)
    out = sketched.select("doc_id", "a", "b").join(resolved, ["a", "b"], "left")
    return out.select("doc_id", F.when(F.col("a").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: the first in the input of those with the smallest id."""
    with scope(docs.sparkSession) as made:
        key = free_name(docs, "kept_key")
        keyed = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "join-docs")
        sketched, named = _classes(keyed, key, **options)
        first = named.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.rid").alias(key))
        blank = sketched.filter("a IS NULL").select(F.col("rid").alias(key))
        kept = materialise(first.unionByName(blank), "join-chosen")
        made.keep(keyed, kept)
    return keyed.join(kept.hint("merge"), key, "left_semi").select(*docs.columns)
