"""Every operator on tiny tables with nulls, empty texts, repeated rows and odd columns."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from hanweave.llm import chat, decontaminate, idfile, lines, packing, quality, simjoin, storage, suffix, tokenise, topk, warc
from hanweave.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, rid string, hit string, t string, kept_id string, starts string"
EXTRA = ["rid", "hit", "t", "kept_id", "starts"]
WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", None, "t", None, "s") for i, t in rows], DOCS)


ODD = [(None, "null id"), (1, None), (2, ""), (3, "  \n "), (4, "one"), (5, "same text here for all"), (5, "same text here for all"), (6, "日本語 \U00020000 \x00 x"), (7, "word " * 3000)]


def model(name):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_file(name))
    found.encode_special_tokens = True
    return found


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_tokeniser_is_exact(name):
    rng = random.Random(2)
    plain = model(name)
    own = tokenise.Encoder(tokenizer_file(name), keep=300)
    texts = ["", "a", "'s's 's", "é. “q”", "x\x1cy", "a b", "<|endoftext|> a", "a" * 3000, "≮ ≠b"]
    texts += ["".join(rng.choices("aB1 .,'\n\t-é́ß 日s", k=rng.randint(0, 40))) for _ in range(500)]
    odd = "".join(map(chr, [*tokenise.ASCII_ODD, *tokenise._WIDE_ODD.tolist()]))
    texts += ["".join(rng.choices("aB1 .'\n\tés\r" + "".join(rng.sample(odd, 3)), k=rng.randint(0, 40))) for _ in range(1500)]
    for _ in range(2):
        ids, sizes = own.encode(texts)
        assert ids.tolist() == [i for t in texts for i in plain.encode(t, add_special_tokens=False).ids]
        again, parts = own.encode(texts, long=8)
        assert again.tolist() == ids.tolist() and parts.tolist() == sizes.tolist()
        assert sizes.tolist() == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]


def test_tokeniser_of_one_long_text_with_odd_space():
    """Cut into stretches though it holds a no-break space and a form feed, and exact after a clash of hashes."""
    own, plain = tokenise.Encoder(tokenizer_file(BYTE)), model(BYTE)
    text = "some words\u00a0 and\x0c more, don't " * 300
    seen = []
    inner = own._encode
    own._encode = lambda texts: seen.append(max(map(len, texts))) or inner(texts)
    ids, _ = own.encode([text], long=1000)
    assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids and max(seen) < 400
    own = tokenise.Encoder(tokenizer_file(BYTE))

    def clash(*_):
        raise tokenise.Clash

    own._cut = clash
    assert own.encode([text, "a b"])[0].tolist() == plain.encode(text + "", add_special_tokens=False).ids + plain.encode("a b", add_special_tokens=False).ids


def test_warc(spark):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(3, "u%\n", big), (1, None, big), (2, "u", big), (1, "again", big), (4, "v", None), (5, "w", "short"), (6, "w", "short"), (None, "n", big), (7, "u", "é" * 60)]
    pages = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "page_id long, url string, html string, digest int, payload int, first int, refers_to int")
    manifest = warc.write_archives(pages, archive_bytes=600)
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows) and manifest.count() > 1
    for r in got:
        html = next((h or "") for i, u, h in rows if i == r.page_id and (u or "") == r.url)
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        revisit = html == big and r.page_id != 1
        assert (r.record_type, r.refers_to) == (("revisit", 1) if revisit else ("response", None))
    empty = warc.read_archives(warc.write_archives(pages.limit(0)))
    assert empty.count() == 0


def test_warc_pack():
    records = [warc.record(i, "u", bytes([65 + i % 20]) * (i * 50), "d", None) for i in range(50)]
    data, offsets = warc.pack(records, sample_bytes=20000)
    assert [(o, r) for o, r in warc.unpack(data)] == list(zip(offsets, records))


def test_warc_dictionary_of_few_large_records(monkeypatch):
    import zstandard

    seen = []
    train = zstandard.train_dictionary
    monkeypatch.setattr(zstandard, "train_dictionary", lambda size, samples, **o: seen.append(samples) or train(size, samples, **o))
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefgh<>/", k=9)).encode() for _ in range(400)]
    records = [b" ".join(rng.choices(vocab, k=60_000)) for _ in range(5)]
    words = warc.dictionary(records, 64 << 10, 1 << 20)
    samples = seen[0]
    assert len(samples) >= 8 and words[:4] == b"\x37\xa4\x30\xec"
    assert sum(map(len, samples)) <= (1 << 20) + (128 << 10)
    assert any(s not in r[: 128 << 10] for s in samples for r in records if s in r)  # beyond a record's beginning
    data, offsets = warc.pack(records, sample_bytes=1 << 20)
    assert [r for _, r in warc.unpack(data)] == records


def test_long_pages_and_ties(spark):
    """A payload over an archive's size, and equal payloads with equal, null and smaller ids."""
    huge, big = "<b>" + "x y " * 500_000, "z" * 100
    rows = [(2, huge), (None, huge), (2, big), (2, big), (None, big), (9, "z" * 99), (8, "z" * 99), (7, ""), (6, None)]
    got = warc.read_archives(warc.write_archives(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string"), archive_bytes=1000)).collect()
    found = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in got)
    n = len(huge)
    assert found == sorted([("2", n, "response", "None"), ("None", n, "revisit", "2"), ("2", 100, "response", "None"), ("2", 100, "response", "None"), ("None", 100, "revisit", "2"), ("9", 99, "response", "None"), ("8", 99, "response", "None"), ("7", 0, "response", "None"), ("6", 0, "response", "None")])


def folders(spark):
    folder = storage.shared_dir(spark).removeprefix("file://") + "/hanweave"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_tables_go_with_their_operator(spark):
    """What remains is what the lazy result reads, and nothing after an error."""
    rows = docs(spark, [(i, f"a\nb\nc\n{i}") for i in range(9)])
    before = folders(spark)
    for run, kept in ((lambda: lines.dedup_lines(rows), 2), (lambda: simjoin.near_duplicates(rows), 2), (lambda: suffix.remove_repeats(rows), 2), (lambda: simjoin.keep_one(rows), 2)):
        result = run()
        assert result.count() > 0 and len(folders(spark) - before) == kept
        before = folders(spark)
    with pytest.raises(ZeroDivisionError), storage.scope(spark) as made:
        made.keep(storage.materialise(rows, "kept"))
        raise ZeroDivisionError
    with storage.scope(spark) as outer:
        with storage.scope(spark) as inner:
            one, two = (storage.materialise(rows, n) for n in "xy")
            inner.keep(one)
        assert one.count() == 9 and not any(n.startswith("y-") for n in folders(spark))
    assert folders(spark) == before and outer.kept == set() and two is not one


def test_schemes(monkeypatch):
    seen = []

    class Fake:
        FileSystem = type("F", (), {"from_uri": staticmethod(seen.append)})

    monkeypatch.setattr(pyarrow, "fs", Fake)
    for uri in ("s3a://b/x", "s3n://b/x", "s3://b/x", "hdfs://h/x", "/x", "file:/x", "file:///x"):
        storage.file_system(uri)
    assert seen == ["s3://b/x", "s3://b/x", "s3://b/x", "hdfs://h/x", "file:///x", "file:///x", "file:///x"]


def test_code_lengths():
    rng = np.random.default_rng(0)
    for n, bits in ((1, 5), (2, 1), (5, 3), (300, 9), (300, 18)):
        counts = (1.7 ** rng.integers(0, 40, n)).astype(np.int64)
        lengths = idfile.code_lengths(counts, bits)
        assert lengths.max() <= bits and (n == 1 or abs(sum(2.0 ** -x for x in lengths.tolist()) - 1) < 1e-9)
    assert idfile.code_lengths(np.array([0, 0]), 4).tolist() == [0, 0]
    with pytest.raises(ValueError):
        idfile.code_lengths(np.ones(5, int), 2)


def test_token_files(spark):
    plain = model(WORD)
    got = idfile.read_digests(idfile.write_ids(docs(spark, ODD), tokenizer_file(WORD), block_ids=1000)).collect()
    want = sorted(((-1 if i is None else i, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in ODD), key=lambda r: r[0])  # equal ids have equal texts here
    start = 0
    for r, (i, ids) in zip(sorted(got, key=lambda r: r.start), want):
        assert (-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens) == (i, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(got) == len(want)
    assert idfile.read_digests(idfile.write_ids(docs(spark, []), tokenizer_file(WORD))).count() == 0


def test_dealing_of_ids():
    cuts, mark = np.array([5, 9, 9, 9, 20]), np.arange(0, 1 << 32, 1 << 28)
    parts = [idfile.dealt(np.full(16, i), mark, cuts) for i in (-3, 5, 7, 9, 10, 20, 30)]
    assert [sorted(set(p.tolist())) for p in parts] == [[0], [1], [1], [2, 3], [4], [5], [5]]
    assert all((np.diff(p) >= 0).all() for p in parts)  # marks in order, parts in order


def test_token_files_of_one_hot_id(spark):
    rows = [(None if i % 3 else 7, f"w{i} " * (i % 5)) for i in range(300)] + [(i, "x y") for i in range(20)]
    manifest = idfile.write_ids(docs(spark, rows), tokenizer_file(WORD), file_ids=150, block_ids=40)
    assert manifest.count() > 8 and max(r.ids for r in manifest.collect()) < 400
    few = idfile.write_ids(docs(spark, rows), tokenizer_file(WORD), file_ids=100, block_ids=40, most_parts=3)
    assert {r.part for r in few.collect()} <= {0, 1, 2} and few.count() > 8
    assert sorted(map(str, idfile.read_digests(few).collect())) == sorted(map(str, idfile.read_digests(manifest).collect()))
    got = sorted(idfile.read_digests(manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(-1 if i is None else i for i, _ in rows)
    plain = model(WORD)
    crc = lambda t: zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((i, r.ids_crc32) for i, r in zip(ids, got)) == sorted((-1 if i is None else i, crc(t)) for i, t in rows)


def brute_lines(rows, span=3):
    seen, out = set(), []
    for i, t in rows:
        if t is None:
            out.append((i, t, 0, 0))
            continue
        own = t.split("\n")
        gone = set()
        for k in range(len(own) - span + 1):
            w = tuple(own[k : k + span])
            if w in seen:
                gone |= set(range(k, k + span))
            seen.add(w)
        out.append((i, "\n".join(x for k, x in enumerate(own) if k not in gone), len(own), len(gone)))
    return out


def test_lines(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choices("abc", k=rng.randint(0, 12)))) for i in range(60)] + [(99, None), (100, ""), (101, "\n\n\n\n")]
    got = lines.dedup_lines(docs(spark, rows))
    assert got.columns == ["doc_id", "text", *EXTRA, "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect() if r.text is not None) == sorted(r for r in brute_lines(rows) if r[1] is not None)
    twice = lines.dedup_lines(docs(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc\nd"), (None, "a\nb\nc")]))
    assert sorted(r.n_removed for r in twice.collect()) == [0, 3, 3, 3]
    equal = lines.dedup_lines(docs(spark, [(2, "x\ny\nz"), (2, "x\ny\nz"), (None, "p\nq\nr"), (None, "p\nq\nr"), (0, "p\nq\nr")]))
    assert sorted((str(r.doc_id), r.text) for r in equal.collect()) == [("0", ""), ("2", ""), ("2", "x\ny\nz"), ("None", ""), ("None", "p\nq\nr")]
    assert lines.dedup_lines(docs(spark, [])).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_lines_in_one_text(spark):
    """Linear work: splitting again for each kept line would take hours here."""
    text = "\n".join(f"line {i % 50_000}" for i in range(200_000))
    r = lines.dedup_lines(docs(spark, [(1, text)])).first()
    assert (r.n_lines, r.n_removed, len(r.text.split("\n"))) == (200_000, 150_000, 50_000)


def test_packing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 700)
    which, place, fill = packing.best_fit(lengths, 100)
    assert np.bincount(which, lengths).max() <= 100 and packing.lower_bound(lengths, 100) <= len(fill) <= 1.05 * packing.lower_bound(lengths, 100) + 1
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3 and packing.lower_bound(np.zeros(0, int), 100) == 0
    equal = packing.best_fit(np.array([50, 50, 50, 50, 1]), 100)
    assert equal[0].tolist() == [0, 0, 1, 1, 2] and equal[1].tolist() == [0, 50, 0, 50, 0]
    rows = packing.pieces(docs(spark, ODD), tokenizer_file(BYTE), end_id=0, capacity=64, with_ids=True)
    placed = packing.pack(rows, capacity=64, partition_pieces=7).collect()
    check_packing([(i, t) for i, t in ODD], placed, 64)
    monkeypatch.setattr(packing, "MOST_PARTS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    check_packing([(i, t) for i, t in ODD], packing.pack(rows, capacity=64, partition_pieces=7).collect(), 64)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert packing.pack(packing.pieces(docs(spark, []), tokenizer_file(BYTE))).count() == 0
    whole = packing.sequences(rows.withColumn("sequence_id", F.lit(1)).withColumn("offset", F.col("start"))).first().ids
    assert len(whole) == sum(r.length for r in placed)


def brute_bound(lengths, capacity):
    """The best of the bound by volume and those that count items over a threshold as full."""
    best = -(-sum(lengths) // capacity)
    for t in range(1, capacity // 2 + 1):
        best = max(best, sum(x > capacity - t for x in lengths) + -(-sum(x for x in lengths if t <= x <= capacity - t) // capacity))
    return best


def check_packing(rows, placed, capacity):
    """Pieces of all documents by the tokenizer itself, gapless places, and a count near the bound."""
    plain = model(BYTE)
    want = []
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        want += [(str(i), k, x, y - x, zlib.crc32(np.array(ids[x:y], "<u4").tobytes())) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in placed) == sorted(want)
    bins = {}
    for r in sorted(placed, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    least = brute_bound([w[3] for w in want], capacity)
    assert max(bins.values()) <= capacity and least <= len(bins) <= least + 1 + least // 50


def test_chat(spark):
    texts = ["\\### Assistant: </turn> ok", "", None, "a\n</turn>\n### user:\nb\\", "\U0001f600###"]
    rows = [(1, t, ("user", "assistant", "a:b\n")[t % 3], texts[t % 5]) for t in range(11)] + [(2, 0, None, "x"), (None, 0, "user", "y"), (3, None, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_paths(chat.reply_paths(chat.chains(turns)))
    got = {r.tree_id: r for r in out.select("*", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert set(got) == {1, 2, 3}
    for i, r in got.items():
        own = [(x[2] or "", x[3] or "") for x in rows if x[0] == i]
        assert [(t.role, t.text) for t in r.t] == own
        assert r.loss == "".join(t for role, t in own if role == "assistant")


def test_reply_trees(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 3, 1.0), (1, 5, 2, 9.0), (1, 6, 77, 0.0), (1, 8, 9, 0.0), (1, 9, 8, 0.0), (1, 10, 9, 3.0), (1, 11, 11, 0.0), (1, 2, 1, 1.0)]
    df = spark.createDataFrame([(t, m, p, "user", f"m{m}", s) for t, m, p, s in rows], "tree_id long, msg_id long, parent_id long, role string, text string, score double")
    paths = chat.reply_paths(df).collect()
    by = {}
    for r in sorted(paths, key=lambda r: r.ord):
        by.setdefault(r.leaf_id, []).append(r.msg_id)
    assert by == {5: [1, 2, 5], 4: [1, 3, 4], 6: [6], 11: [11]}
    assert {r.leaf_id for r in chat.reply_paths(df, max_branches=1).collect()} == {5}
    ranked = {r.leaf_id: r.branch_rank for r in chat.format_paths(chat.reply_paths(df)).collect()}
    assert ranked == {5: 1, 4: 2, 6: 3, 11: 4}
    assert chat.reply_paths(df.limit(0)).count() == 0
    ties = spark.createDataFrame([(5, m, p, "user", "t", 1.0) for m, p in [(1, None), (4, 1), (3, 1), (2, 1), (6, 2)]], df.schema).filter("msg_id <> 6")
    assert {r.leaf_id for r in chat.reply_paths(ties, max_branches=2).collect()} == {2, 3}  # equal scores: smaller leaves


def test_deep_and_wide_reply_trees(spark):
    """Branches by climbing against plain walks, and no Python in the plan."""
    rng = random.Random(3)
    rows = []
    for tree in range(4):
        for m in range(60):
            up = m - 1 if tree == 0 else rng.randrange(max(0, m - 6), m) if m else None
            rows.append((tree, m, up if m else None, "user", f"m{m}", float(rng.randint(0, 3))))
    got = chat.reply_paths(spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double"), max_branches=3)
    up, score = {(t, m): p for t, m, p, *_ in rows}, {(t, m): s for t, m, _, _, _, s in rows}
    want = {}
    for tree in range(4):
        branches = []
        for leaf in {m for m in range(60)} - {p for (t, _), p in up.items() if t == tree}:
            path = [leaf]
            while up[tree, path[-1]] is not None:
                path.append(up[tree, path[-1]])
            branches.append((-sum(score[tree, m] for m in path), leaf, path[::-1]))
        want |= {(tree, leaf): path for _, leaf, path in sorted(branches)[:3]}
    found = {}
    for r in sorted(got.collect(), key=lambda r: r.ord):
        found.setdefault((r.tree_id, r.leaf_id), []).append(r.msg_id)
    assert found == want
    plan = chat.format_paths(got)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_pairs(rows, width=5):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                yield i, j


def brute_links(rows):
    n = [0] * len(rows)
    for i, j in brute_pairs(rows):
        n[i] += 1
        n[j] += 1
    return n


def brute_classes(rows):
    """The smallest id of each id's class."""
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in brute_pairs(rows):
        a, b = top(rows[i][0]), top(rows[j][0])
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in parent}


def test_near_duplicates(spark):
    rng = random.Random(8)
    base = [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(120)]
    rows = list(ODD)
    for i in range(60):
        w = list(base) if i % 2 else [str(rng.random()) for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = str(rng.random())
        rows.append((100 + i, " ".join(w)))
    got = simjoin.near_duplicates(docs(spark, rows), leaf_rows=6).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    assert sorted(((r.doc_id, r.n_links) for r in got), key=key) == sorted(((i, n) for (i, _), n in zip(rows, brute_links(rows))), key=key)
    classes = brute_classes([(i, t) for i, (_, t) in enumerate(rows)])
    named = sorted(str((i, rows[classes[k]][0])) for k, (i, t) in enumerate(rows) if (t or "").split())
    assert sorted(str((r.doc_id, r.class_id)) for r in got if r.doc_id not in (1, 2, 3)) == named
    kept = simjoin.keep_one(docs(spark, rows), leaf_rows=6)
    assert kept.columns == ["doc_id", "text", *EXTRA]
    assert kept.count() == len({r.class_id for r in got})
    assert simjoin.near_duplicates(docs(spark, [])).count() == 0


def test_keep_one_with_null_and_repeated_ids(spark):
    rng = random.Random(12)
    words = lambda: [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(60)]
    one, two, three = words(), words(), words()
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(None, " ".join(one)), (None, near(one)), (None, " ".join(one)), (3, " ".join(two)), (8, near(two)), (None, near(two)), (3, near(three)), (2, " ".join(three)), (5, ""), (5, ""), (None, None)]
    assert len(set(brute_classes([(i, t) for i, (_, t) in enumerate(rows)]).values())) == 3 + 3  # a blank text is a class
    for own in (rows, rows[::-1]):
        kept = simjoin.keep_one(docs(spark, own), leaf_rows=6)
        assert kept.columns == ["doc_id", "text", *EXTRA]
        got = [(r.doc_id, r.text) for r in kept.collect()]
        named = [r for r in got if r[1]]
        assert len(named) == 3 and named.count((3, " ".join(two))) == 1 and named.count((2, " ".join(three))) == 1
        assert sum(i is None and t in (" ".join(one), near(one)) for i, t in named) == 1
        assert sorted(str(r) for r in got if not r[1]) == sorted(str(r) for r in rows[-3:])


def test_recall_of_planted_pairs(spark):
    """Pairs at the threshold meet in a leaf, over all levels of splitting."""
    rng = np.random.default_rng(11)
    n = 3000
    one = rng.integers(0, 3, (n, simjoin.TOKENS))  # a crowd: every bucket is large, two sets agree on a third
    other = np.where(rng.random(one.shape) < 0.8, one, rng.integers(3, 6, one.shape))
    sets = spark.createDataFrame([(i, row.tolist(), 10) for i, row in enumerate(np.concatenate([one, other]))], "sid long, tokens array<int>, size long")
    runs = simjoin.runs_for(0.99999, 0.8, 3, 4)
    found = simjoin.leaves(sets, runs, 3, 4, 40)
    assert found.groupBy("leaf").count().agg(F.max("count")).first()[0] < n
    pairs = found.select("leaf", F.col("sid").alias("x")).join(found.select("leaf", F.col("sid").alias("y")), "leaf").filter(F.col("y") == F.col("x") + n)
    assert pairs.select("x").distinct().count() >= n - 1


@pytest.mark.parametrize("most", [2, 8])
def test_near_duplicates_in_blocks(spark, monkeypatch, most):
    """Dense groups with a core, dealt into pairs of blocks, whose ids are null or repeated."""
    rng = random.Random(most)
    rows = []
    for _ in range(2):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(200)]
        for i in range(60):
            w = list(base)
            for _ in range(rng.randint(0, most)):
                w[rng.randrange(len(w))] = str(rng.random())
            rows.append((rng.choice([None, 1, 2, i]), " ".join(w)))
    rows += rows[:3]
    want = brute_classes([(i, t) for i, (_, t) in enumerate(rows)])
    members = {}
    for i, c in want.items():
        members.setdefault(c, []).append(rows[i][0])
    lowest = {c: min((x for x in own if x is not None), default=None) for c, own in members.items()}
    wanted = sorted(str((rows[i][0], lowest[want[i]], n)) for i, n in enumerate(brute_links(rows)))
    seen, inner = [], simjoin.cores

    def watched(*args):
        seen.append(inner(*args))
        return seen[-1]

    monkeypatch.setattr(simjoin, "cores", watched)
    monkeypatch.setattr(storage, "remove", lambda *_: None)  # for a look at the cores afterwards
    got = simjoin.near_duplicates(docs(spark, rows), leaf_rows=8, block_rows=7, block_shingles=900, core_rows=10).collect()
    assert seen[0][0].count() > 20 and sorted(str((r.doc_id, r.class_id, r.n_links)) for r in got) == wanted
    plain = simjoin.near_duplicates(docs(spark, rows), leaf_rows=8, block_rows=7, core_rows=10**6).collect()
    assert sorted(map(str, plain)) == sorted(map(str, got))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(40)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    got = {r.sid: r.root for r in simjoin.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    assert all(got.get(x, x) == top(x) for x in parent)


def test_quality(spark):
    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 300)))
    bad = lambda: " ".join(["spam!!"] * rng.randint(5, 30) + good().split() * rng.randint(0, 1) + ["SPAM!!"] * 40)
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs(spark, rows + ODD), labels).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and 10 < r.doc_id < 300]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    none = quality.classify(docs(spark, ODD), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score(docs(spark, ODD), {"share": 0.25}).columns == ["doc_id", "text", *EXTRA, "score"]


def test_quality_with_very_long_words(spark):
    rng = random.Random(5)
    good = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(60))
    own = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, good() if i % 2 else "SPAM!! " * 60) for i in own]
    rows[0], rows[1] = (own[0], "x" * 100_000), (own[1], " " * 100_000)
    labels = spark.createDataFrame([(i, i % 2) for i in own], "doc_id long, quality int")
    got = quality.classify(docs(spark, rows), labels).collect()
    assert len(got) == len(own) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == r.doc_id % 2 for r in got if r.doc_id not in own[:2]]) > 0.95


def test_training_sees_every_passage(spark, monkeypatch):
    own = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, " ".join(f"w{j}" for j in range(64 * 600 if i == own[0] else 64 * 2))) for i in own]
    rows += [(own[1], "another text"), (own[2], rows[2][1])]
    labels = spark.createDataFrame([(i, i % 2) for i in own], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "BATCH", 16)

    def look(bags):
        seen.extend((x[0 : len(x)].copy(), *more) for x, *more in bags)
        return {"share": 0.5}

    monkeypatch.setattr(quality, "fit", look)
    quality.train(docs(spark, rows), labels)
    sizes = np.concatenate([np.diff(bounds) for _, bounds, _, _ in seen])
    weights = np.concatenate([w for *_, w in seen])
    assert sorted(sizes.tolist()) == sorted([600, 1, *[2] * (len(own) - 1)]) and sorted(weights.tolist()) == [*[1] * len(own), 2]
    x, bounds = next((x, bounds) for x, bounds, *_ in seen if np.diff(bounds).max() == 600)
    long = int(np.argmax(np.diff(bounds)))
    text = rows[0][1].encode()
    assert np.array_equal(x[bounds[long] : bounds[long + 1]], quality.passages(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0])


def toy_bags(rng, n=10, width=6):
    """Bags of 9 passages, in which one passage tells the label."""
    bags = []
    for _ in range(n):
        x, bounds, y = rng.normal(size=(90, width)).astype(np.float32), np.arange(0, 91, 9), np.tile([0.0, 1.0], 5)
        x[bounds[:-1][y == 1]] += 4
        bags.append((x, bounds, y, np.ones(10)))
    return bags


def test_blocks_do_not_change_the_model(monkeypatch):
    bags = toy_bags(np.random.default_rng(1), 2)
    whole = quality.fit(bags, hidden=8, gate=4, epochs=5)
    monkeypatch.setattr(quality, "BLOCK", 7)
    cut = quality.fit(bags, hidden=8, gate=4, epochs=5)
    assert all(np.allclose(whole[k], cut[k], atol=1e-3) for k in whole)


def test_features_are_the_text_alone():
    texts = [(t or "").encode() for _, t in ODD] + [b" lead", b"trail ", b"one two three one two three", "é!! ü??".encode()]

    def features(own):
        return quality.passages(np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in own])]).astype(np.int64))

    every, ends = features(texts)
    for i, t in enumerate(texts):
        assert np.array_equal(every[ends[i] : ends[i + 1]], features([t])[0]), t


def double(model_):
    return {k: np.array(v, np.float64) for k, v in model_.items()}


def test_forward_is_gated_attention():
    """Scores against loops over passages."""
    import math

    rng = np.random.default_rng(3)
    x, bounds = rng.normal(size=(11, 5)), np.array([0, 1, 4, 11])
    m = double(quality.fit([(x, bounds, np.array([0.0, 1.0, 0.0]), np.ones(3))], hidden=4, gate=3, epochs=2))
    for i, found in enumerate(quality.scores(m, x, bounds)):
        encoded, energy = [], []
        for row in x[bounds[i] : bounds[i + 1]]:
            f = [min(8, max(-8, (v - a) / s)) for v, a, s in zip(row, m["mean"], m["std"])]
            h = [math.tanh(sum(f[j] * m["W"][j][k] for j in range(5)) + m["b"][k]) for k in range(4)]
            gated = [math.tanh(sum(h[k] * m["V"][k][g] for k in range(4))) / (1 + math.exp(-sum(h[k] * m["U"][k][g] for k in range(4)))) for g in range(3)]
            encoded.append(h)
            energy.append(math.exp(sum(v * w for v, w in zip(gated, m["w"]))))
        z = [sum(e * h[k] for e, h in zip(energy, encoded)) / sum(energy) for k in range(4)]
        assert abs(found - 1 / (1 + math.exp(-sum(v * c for v, c in zip(z, m["c"])) - m["o"]))) < 1e-9


def test_gradients():
    """Against finite differences of the loss, in every weight of the model."""
    rng = np.random.default_rng(0)
    (x, bounds, y, _), *_ = toy_bags(rng, 1)
    x, weight = x.astype(np.float64), rng.integers(1, 4, 10).astype(np.float64)
    m = double(quality.fit([(x, bounds, y, weight)], hidden=5, gate=3, epochs=3))

    def loss(model_):
        p = quality.scores(model_, x, bounds)
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    for k, found in quality.gradients(m, x, bounds, y, weight).items():
        for at in np.ndindex(np.shape(m[k])):
            up, down = ({**m, k: np.array(m[k])} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - np.asarray(found)[at]) < 1e-6, (k, at)
    bags = toy_bags(rng)
    learnt = quality.fit(bags, hidden=8, gate=4, epochs=40, rate=1e-2)
    assert all(((quality.scores(learnt, x, bounds) >= 0.5) == (y == 1)).all() for x, bounds, y, _ in bags)


def test_quality_of_long_texts(spark):
    rng = random.Random(6)
    good = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))
    own = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, good(60) if i % 2 else "SPAM!! " * 60) for i in own]
    rows[0], rows[1], rows[2] = (own[0], "x" * 70_000), (own[1], good(2_000_000)), (own[2], "")
    labels = spark.createDataFrame([(i, i % 2) for i in own], "doc_id long, quality int")
    assert len(rows[1][1]) > 10_000_000
    assert all(0 <= r.score <= 1 for r in quality.classify(docs(spark, rows), labels).collect())


def brute_hits(docs_, items, span=10):
    import re

    low = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for i, t in docs_:
        w, hit, names = low(t), set(), set()
        for name, text in items:
            b = low(text)
            m = min(span, len(b))
            grams = {tuple(b[k : k + m]) for k in range(len(b) - m + 1)} if m else set()
            for k in range(len(w) - m + 1):
                if m and tuple(w[k : k + m]) in grams:
                    hit |= set(range(k, k + m))
                    names.add(name)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("bound", [10**6, 0])
def test_decontamination(spark, bound):
    rng = random.Random(6)
    vocab = ["Ab", "c", "dé", "e1", "日", "x-y"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(str(i), text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(12)] + [("3", text(12)), ("null", "solo! word"), ("77", "")]
    rows = [(i, text(rng.randint(0, 60))) for i in range(40)] + ODD + [(50, items[0][1] + " solo, WORD"), (51, "... !")]
    bench = spark.createDataFrame([(None if n == "null" else int(n), t) for n, t in items], "item_id long, text string")
    got = decontaminate.decontaminate(docs(spark, rows), bench, broadcast_words=bound).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_hits(rows, items), key=key)
    clean = decontaminate.keep_clean(docs(spark, rows[:40]), bench, broadcast_words=bound)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in brute_hits(rows[:40], items) if not r[5])
    assert decontaminate.decontaminate(docs(spark, rows), bench.limit(0), broadcast_words=bound).filter("contaminated").count() == 0


@pytest.mark.parametrize("bound", [10**6, 0])
def test_a_passage_of_many_items_and_documents(spark, bound):
    """Windows are grouped: 300 items and 300 documents share a passage, some items a part of it."""
    passage = " ".join(f"word{i}" for i in range(40))
    items = [(str(i), f"{passage} own{i}" if i % 3 else f"w{i} {' '.join(passage.split()[5:25])}") for i in range(300)]
    rows = [(i, f"text {i} {passage} end" if i % 2 else " ".join(passage.split()[: i % 40])) for i in range(300)]
    bench = spark.createDataFrame([(int(n), t) for n, t in items], "item_id long, text string")
    got = decontaminate.decontaminate(docs(spark, rows), bench, broadcast_words=bound).collect()
    want = {}
    for i, t in rows:
        if t.replace(f"text {i} ", "") not in want:
            want[t.replace(f"text {i} ", "")] = brute_hits([(i, t)], items)[0][2:]
    assert {r.doc_id: tuple(r)[2:] for r in got} == {i: want[t.replace(f"text {i} ", "")] for i, t in rows}


@pytest.mark.parametrize("bound", [10**6, 0])
def test_clean_rows_with_null_and_repeated_ids(spark, bound):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, item), (None, "null id, clean"), (None, None), (4, "x " + item), (4, "clean four"), (4, "clean four"), (5, ""), (6, item + " y"), (7, "clean seven")]
    clean = decontaminate.keep_clean(docs(spark, rows), bench, broadcast_words=bound)
    assert clean.columns == ["doc_id", "text", *EXTRA]
    assert sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(str(r) for r in rows if item not in (r[1] or ""))


def brute_bytes(rows, span):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - span + 1):
            w = b[s : s + span]
            if w in seen:
                gone[s : s + span] = b"\1" * span
            seen.add(w)
        runs = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out[i] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_longest_previous_factors():
    """Suffix order, common prefixes and factors against their definitions."""
    rng = np.random.default_rng(5)
    for span in (3, 9, 16):
        for signs in (2, 4):
            text = rng.integers(97, 97 + signs, 260).astype(np.uint8)
            starts = rng.permutation(260 - span)
            group = rng.integers(0, 3, len(starts))
            rank = rng.permutation(len(starts))
            own = [bytes(text[s : s + span]) for s in starts]

            def shared(i, j):
                return next((k for k in range(span) if own[i][k] != own[j][k]), span)

            order, common = suffix.suffix_order(text, starts, group, rank, span)
            assert order.tolist() == sorted(range(len(starts)), key=lambda i: (group[i], own[i], rank[i]))
            assert common.tolist() == [0] + [shared(i, j) if group[i] == group[j] else 0 for i, j in zip(order[1:], order[:-1])]
            found = suffix.previous_factors(text, starts, group, rank, span)
            want = [max((shared(i, j) for j in range(len(starts)) if group[i] == group[j] and rank[j] < rank[i]), default=0) for i in range(len(starts))]
            assert found.tolist() == want


def test_a_lost_side_file_is_an_error(spark):
    text = "".join(random.Random(2).choices("abcdefgh ", k=900))
    found = suffix.remove_repeats(docs(spark, [(1, text), (2, text)]))
    before = {f for f in found.sparkSession.sparkContext._jvm.java.io.File(storage.shared_dir(spark).removeprefix("file://") + "/hanweave").list() if "spans" in f}
    for name in before:
        storage.remove(spark, f"{storage.shared_dir(spark)}/hanweave/{name}")
    with pytest.raises(Exception, match="FileNotFoundError"):
        found.count()


def test_suffix(spark, monkeypatch):
    monkeypatch.setattr(suffix, "MOST_PARTS", 3)
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocab, k=60))
    rows = []
    for i in range(80):
        t = " ".join(rng.choices(vocab, k=rng.randint(0, 60)))
        if i % 2:
            t += passage + " ".join(rng.choices(vocab, k=9))
        if i % 7 == 0:
            t = "ab" * rng.randint(0, 150)
        rows.append((i, t if i % 11 else rows[-1][1] if rows else None))
    want = brute_bytes(rows, 100)
    got = suffix.remove_repeats(docs(spark, rows), chunk_bytes=4000, group=6).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want
    odd = suffix.remove_repeats(docs(spark, ODD)).collect()
    assert sorted(r.n_removed for r in odd if r.doc_id == 7) == [14995] and sum(r.n_removed for r in odd) == 14995
    assert len(odd) == len(ODD) and suffix.remove_repeats(docs(spark, [])).count() == 0


def test_long_text_segments(spark):
    rng = random.Random(9)
    block = "".join(rng.choices("abcdefgh ", k=150_000))
    t = block + "".join(rng.choices("ijklmnop ", k=800_000)) + block + "".join(rng.choices("qrst ", k=200_000))
    r = suffix.remove_repeats(docs(spark, [(1, t), (2, block[:500])])).orderBy("doc_id").collect()
    assert (r[0].n_removed, r[0].n_spans, bytes(r[0].kept)) == (150_000, 1, (t[:950_000] + t[1_100_000:]).encode())
    assert (r[1].n_removed, r[1].n_spans) == (500, 1)


def brute_top(rows, k):
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({i: min(w for j, w in good if j == i) for i, _ in good if i % 5 == 0}.items()):
        most = 2**63 - 1
        score = sorted(((-max(-most, min(most, sum(a * b for a, b in zip(v, w)))), i) for i, w in good if i != q and len(w) == len(v)))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(score, 1)]
    return out


@pytest.mark.parametrize("scale", [1.0, 2.0**30])
def test_top_k(spark, scale):
    rng = random.Random(7)
    rows = [(i, [scale * rng.choice([-1.5, 0.25, 1.0, rng.random()]) for _ in range(4)]) for i in range(60)]
    rows += [(100, None), (105, [1.0, None, 2.0, 3.0]), (110, [float("nan")] * 4), (115, [float("inf")] * 4), (None, [1.0] * 4), (120, [1.0, 2.0]), (121, [3.0, 1.0]), (130, [])]
    rows += [(200 + i, [scale] * 4) for i in range(30)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = topk.top_k(df, df.filter("vec_id % 5 = 0"), k=4, query_block=7, bins=16).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute_top(rows, 4)
    assert topk.top_k(df, df.limit(0)).count() == 0
