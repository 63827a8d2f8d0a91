"""Edge rows and properties of the conversion functions."""

import pytest
from pyspark.sql import functions as F

from hanweave.functions import actions, charsets, convert, markup, names, sniff, tables
from hanweave.operators import dictionary, files, lookups
from hanweave.sources import settings, text


def one(spark, value, f):
    df = spark.createDataFrame([(value,)], "c string")
    return df.select(f(F.col("c")).alias("x")).first().x


def vocabulary(spark, rows):
    return spark.createDataFrame(rows, dictionary.SCHEMA)


def words(spark, rows, **k):
    return dictionary.compile_words(vocabulary(spark, rows), **k)


def test_characters(spark):
    for simple, traditional in (("软件", "軟件"), ("电脑", "電腦"), ("头发", "頭發"), ("汉语abc", "漢語abc")):
        assert one(spark, simple, convert.to_traditional) == traditional
    assert one(spark, "電腦軟體", convert.to_simplified) == "电脑软体"
    pairs = tables.simplified_to_traditional()
    assert len(pairs[0]) == len(pairs[1]) > 2000 and len(set(pairs[0])) == len(pairs[0])


def test_blank_and_null_stay(spark):
    for value in ("", "   ", None, "　\n"):
        assert one(spark, value, lambda c: convert.convert(c, convert.TO_TRADITIONAL)) == value
    assert one(spark, "软", lambda c: convert.convert(c, convert.NONE)) == "软"


def test_vocabulary_order(spark):
    row = lambda ln, on, s, p, t: (ln, on, "Default", s, p, t, p)
    assert words(spark, [row(1, False, "X", 1, "A"), row(2, True, "X", 1, "B")]).pairs == ()
    replace = lambda w, v: one(spark, v, lambda c: dictionary.replace_words(c, w))
    assert replace(words(spark, [row(1, True, "ab", 1, "1"), row(2, True, "a", 9, "2")]), "ab") == "2b"
    assert replace(words(spark, [row(1, True, "a", 1, "1"), row(2, True, "ab", 1, "2")]), "ab") == "2"
    assert replace(words(spark, [row(1, True, "a", 1, "b"), row(2, True, "b", 1, "c")]), "a") == "b"
    signs = words(spark, [row(1, True, "a.b*[", 1, "x"), row(2, True, "^-]", 1, "y")])
    assert replace(signs, "a.b*[ axb ^-]\n") == "x axb y\n"


def test_vocabulary_forms_agree(spark):
    """Marks, tokens and the join with a table, on overlapping words of random texts."""
    import random

    rng = random.Random(1)
    rows = [(i, True, "D", "".join(rng.choices("abc1", k=rng.randint(1, 4))), rng.randint(0, 3), f"<{i}>", 0) for i in range(60)]
    table = dictionary.compiled_table(vocabulary(spark, rows))
    w = words(spark, rows)
    assert [p[0] for p in w.pairs] == [r.word for r in table.orderBy("rank").collect()]
    texts = ["".join(rng.choices("abc12 \n𠀀", k=rng.randint(0, 50))) for _ in range(80)] + ["", None, "a\ufdd1b\ufdd2c", "zzz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    by_table = {r.id: r.replaced for r in dictionary.replace_by_table(df, table).collect()}

    def plain(t):
        out, at = "", 0
        while at < len(t):
            hit = next(((x, v) for x, v in w.pairs if t.startswith(x, at)), None)
            out, at = (out + hit[1], at + len(hit[0])) if hit else (out + t[at], at + 1)
        return out

    for r in df.select("id", dictionary.replace_words(F.col("text"), w).alias("a"), dictionary._by_tokens(F.col("text"), w.pairs).alias("b")).collect():
        want = None if texts[r.id] is None else plain(texts[r.id])
        assert (r.a, r.b, by_table[r.id]) == (want, want, want), texts[r.id]


def test_large_vocabulary_is_no_literal(spark):
    rows = vocabulary(spark, [(i, True, "D", f"w{i}", 1, "x", 1) for i in range(12)])
    with pytest.raises(ValueError, match="replace_by_table"):
        dictionary.compile_words(rows, most=10)


def test_protected_lists(spark):
    convert_ = lambda v: one(spark, v, lambda c: convert.replaced_in_order(c, [("aa", "b"), ("a", "c")], [("B", "x")], ["keep a", "keep"], F.upper))
    assert convert_("aaa keep aa") == "xC keep aA".replace("keep aA", "keep aC")
    assert convert_("bkeepb") == "xkeepx" and convert_(None) is None and convert_("") == ""


def test_ranks(spark):
    """Places of a total order over several buckets, with a hot first key."""
    import random

    from hanweave.operators.ranks import ranked_by

    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, rng.randint(0, 9)]), rng.choice([None, "a", "b", str(rng.random())]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "a int, b string, id long")
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
    for down in (False, True):
        got = ranked_by(df, F.struct("a", "b", "id"), descending=down, buckets=7, sample=50).orderBy("rank").collect()
        assert [tuple(r)[:3] for r in got] == (want[::-1] if down else want) and [r.rank for r in got] == list(range(1, 901))
    assert ranked_by(df.limit(0), F.struct("id")).count() == 0
    assert ranked_by(df.limit(1), F.struct("id")).first().rank == 1


def test_tree_walk(spark):
    """Against a recursive walk: folders before files, children before their node, all reversed."""
    paths = ["r/b/x.txt", "r/b/a/1", "r/b/a b/2", "r/z.txt", "r/a.txt", "r/c/d/3", "r/b/y"]
    nodes = files.tree_rows(spark.createDataFrame([(p,) for p in paths], "path string"))
    tree = {}
    for p in paths:
        at = tree
        for part in p.split("/"):
            at = at.setdefault(part, {})

    def walk(prefix, name, below):
        path = f"{prefix}/{name}" if prefix else name
        for child in sorted(below, key=lambda c: (not below[c], c)):
            yield from walk(path, child, below[child])
        yield path

    want = list(walk("", "r", tree["r"]))[::-1]
    assert [r.path for r in files.post_order(nodes).orderBy("walk").collect()] == want


def test_hz_against_the_codec(spark):
    texts = ["abc", "汉字~和 tilde", "~~", "a汉b字\n汉", "", "é汉", "　。"]
    df = spark.createDataFrame([(t, t.encode("hz", "replace")) for t in texts], "t string, d binary")
    for r in df.select("t", "d", charsets.encode(F.col("t"), "hz").alias("e"), charsets.decode(F.col("d"), "hz").alias("back")).collect():
        assert bytes(r.e) == bytes(r.d) and r.back == bytes(r.d).decode("hz")
    odd = spark.createDataFrame([(b"a~\nb",), (b"~{VP",), (b"x\xb9y",), (b"~x",)], "d binary").select(charsets.decode(F.col("d"), "hz").alias("t")).collect()
    assert [r.t for r in odd] == ["ab", "中", "x\ufffdy", "\ufffdx"]
    plan = df.select(charsets.decode(charsets.encode(F.col("t"), "hz"), "hz"))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_references_are_decoded_once(spark):
    for text, want in (("&amp;lt;", "&lt;"), ("&#38;lt;", "&lt;"), ("&amp;#65;", "&#65;"), ("&amp&#59;", "&amp;"), ("&#x26;amp;", "&amp;"), ("&#1114112;", "&#1114112;"), ("&#X1F600;&#;&#x;", "😀&#;&#x;"), ("\ufdd0&amp;\ufdd0", "\ufdd0&\ufdd0"), ("&lt;&gt;&quot;&&&", '<>"&&&')):
        assert one(spark, text, markup.decoded_references) == want, text


def test_sniffed_bytes(spark):
    text = "软体电脑头发计机网络数库语转换简汉国学经济东门"
    df = spark.createDataFrame([(text.encode("gbk"),), (one(spark, text, convert.to_traditional).encode("cp950"),), (b"plain",), (b"",)], "d binary")
    got = df.select(sniff.sniffed_bytes(F.col("d")).alias("k"), sniff.decoded_by_sniffing(F.col("d")).alias("t")).collect()
    assert [r.k for r in got] == [2, 0, -1, -1] and [r.t for r in got] == [text, one(spark, text, convert.to_traditional), "plain", ""]


def test_reserved(spark):
    w = words(spark, [(1, True, "P", "电脑", 9999, "电脑", 9999)])
    assert w.reserved == ("电脑",)
    assert one(spark, "电脑电", lambda c: convert.convert(c, convert.TO_TRADITIONAL, w)) == "电脑電"


def test_dictionary_file(spark, tmp_path):
    rows = [(1, True, "D", "软", 1, '軟"x', 2), (2, False, "E", "电", 3, "電", 4), (3, True, "F", "", 0, "", 0)]
    dictionary.save(vocabulary(spark, rows), str(tmp_path / "d"))
    got = [tuple(r)[1:] for r in dictionary.load(spark, str(tmp_path / "d")).orderBy("ln").collect()]
    assert got == [r[1:] for r in rows[:2]]
    bad = spark.createDataFrame([(1, "True\tD\ta\tx\tb\t1")], "ln long, value string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        dictionary.parse_lines(bad).collect()


def test_references(spark):
    assert one(spark, "\té&<a\r\n", markup.decimal_references) == "&#9;&#233;&amp;&lt;a\r\n"
    assert one(spark, "é\x7f", markup.hex_references) == "&#xE9;&#x7F;"
    text_ = "a&b <日本> \U00020000 &amp; &#65; ;;&#x; &#99999999;"
    for f in (markup.decimal_references, markup.hex_references):
        assert one(spark, text_, lambda c: markup.decoded_references(f(c))) == text_
    assert one(spark, "&#1114112;&#xZ;&&lt;", markup.decoded_references) == "&#1114112;&#xZ;&<"


def test_labels(spark):
    ext = lambda e: (lambda c: markup.relabelled(c, F.lit(e), "gbk"))
    assert one(spark, '<META name="x" charset="utf-8" >', ext("html")) == '<meta name="x" charset="gbk" >'
    assert one(spark, '<meta http-equiv="a" content="text/html; charset=utf-8">', ext("htm")) == '<meta http-equiv="a" content="text/html; charset=gbk">'
    assert one(spark, 'header("Content-Type:text/html; charset=utf-8");', ext("php")) == 'header("Content-Type:text/html; charset=gbk");'
    assert one(spark, '@charset "utf-8"', ext("css")) == '@charset "gbk"'
    assert one(spark, '@charset "utf-8"', ext("txt")) == '@charset "utf-8"'


def test_width_round_trip(spark):
    assert one(spark, tables.HALF, lambda c: convert.half_width(convert.full_width(c))) == tables.HALF
    assert len(set(tables.FULL)) == len(tables.FULL) == 32


def state_machine(data, rules):
    out = dict.fromkeys(("ascii", "symbol", "common", "rare", "unknown"), 0)
    i = 0
    while i < len(data):
        b = data[i]
        if b < 0x80:
            out["ascii"] += 1
            i += 1
        elif (0x80 if rules == "big5" else 0xA1) <= b <= (0xFE if rules == "big5" else 0xF7):
            if i + 1 == len(data):
                break
            t, w = data[i + 1], b << 8 | data[i + 1]
            if rules == "big5":
                good = 0x40 <= t <= 0x7E or 0xA1 <= t <= 0xFE
                kind = "symbol" if 0xA140 <= w <= 0xA3BF else "common" if 0xA440 <= w <= 0xC67E else "rare" if 0xC940 <= w <= 0xF9D5 else "unknown"
            else:
                good = 0xA1 <= t <= 0xFE
                kind = "symbol" if 0xA1 <= b <= 0xA9 else "common" if 0xB0 <= b <= 0xD7 else "rare" if 0xD8 <= b <= 0xF7 else "unknown"
            out[kind if good else "unknown"] += 1
            i += 2
        else:
            i += 1
    return out


def test_sniffer_against_state_machine(spark):
    import random

    rng = random.Random(5)
    rows = [bytes(rng.choices(range(256), k=rng.randint(0, 40))) for _ in range(300)] + [bytes([a, b]) for a in range(0x80, 256) for b in range(0x30, 256, 3)]
    rows += [b"abc", b"A\xa4", b"\xa4\x20A", b"\xff", b""]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(rows)], "i int, d binary")
    got = df.select("i", sniff.big5_report(F.col("d")).alias("big5"), sniff.gbk_report(F.col("d")).alias("gbk")).collect()
    for r in got:
        for rules in ("big5", "gbk"):
            want = state_machine(rows[r.i], rules)
            assert {k: r[rules][k] for k in want} == want, (rules, rows[r.i])


def test_sniffed(spark):
    assert one(spark, "abc", sniff.sniffed) == -1
    assert one(spark, "软体电脑头发计机网络数库语", sniff.sniffed) in (2, 3)
    assert one(spark, "軟體電腦頭髮計機網絡數庫語", sniff.sniffed) in (0, 1)


def test_charsets(spark):
    for name, codec in (("gbk", "gbk"), ("big5", "cp950"), ("shift-jis", "cp932"), ("euc-jp", "euc_jp"), ("hz-gb-2312", "hz"), ("unicode", "utf-16-le")):
        value = "電腦abc" if name == "big5" else "日本abc"
        assert bytes(one(spark, value, lambda c: charsets.encode(c, name))) == value.encode(codec)
        assert one(spark, value, lambda c: charsets.reinterpret(c, name, name)) == value
    broken = "电脑软体".encode("gbk").decode("latin1")
    assert one(spark, broken, lambda c: charsets.repair_latin1(c, "gbk")) == "电脑软体"
    assert one(spark, "éabcd", lambda c: charsets.repair_latin1(c, "gbk")) == "éabcd"
    assert one(spark, "", lambda c: charsets.repair_latin1(c, "gbk")) == ""
    assert one(spark, "\xad", charsets.latin1_density) == 0
    with pytest.raises(ValueError):
        charsets.canonical("nope")


def test_file_conversion_makes_traditional(spark):
    assert one(spark, "体机a", lambda c: convert.convert_file(c, "gbk", "big5", convert.NONE)) == "体机a"
    assert one(spark, "电软", lambda c: convert.convert_file(c, "utf-8", "big5", convert.NONE)) == "電軟"


def test_actions(spark):
    known = actions.registry()
    assert len(known) == 24
    assert one(spark, "a,b", known["ze1"]) == "a，b"
    assert one(spark, "电脑", known["a3"]) == "電腦"
    df = spark.createDataFrame([("电",)], "c string")
    assert actions.apply(df, "a3", "c").first().c == "電"
    with pytest.raises(ValueError):
        actions.apply(df, "zz", "c")


def test_names(spark):
    assert one(spark, "a?.txt..", names.valid_file_name) == "a_.txt"
    assert one(spark, "a/b|c", names.valid_folder_name) == "a/b_c"
    assert one(spark, "...", names.valid_file_name) is None
    assert len(one(spark, "x" * 300, names.valid_file_name)) == 245
    assert one(spark, "in/a.txt", lambda c: names.output_path(c, "in/*.txt", "out/*_t.txt")) == "out/a_t.txt"
    assert one(spark, "in/a.txt", lambda c: names.output_path(c, "in/*.txt", "out/")) == "out/a.txt"
    with pytest.raises(ValueError):
        names.output_path(F.lit("x"), "*/*", "*")
    with pytest.raises(ValueError):
        names.output_path(F.lit("x"), "*", "one.txt")
    assert one(spark, "A; ; B", lambda c: names.joined_group(names.split_group(c))) == "A; B"


def test_filters(spark):
    df = spark.createDataFrame([("a.txt",), ("a.TXT",), ("atxt",)], "name string")
    assert [r.name for r in df.filter(files.matches_extension(F.col("name"), ["*.txt"])).collect()] == ["a.txt"]
    assert files.parse_filters("<A|*.a;*.b>/x/<B|*>") == [("A", ["*.a", "*.b"]), ("B", ["*"])]


def test_lookup_errors(spark):
    a = spark.createDataFrame([(1,), (3,)], "k int")
    t = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, v string")
    with pytest.raises(Exception, match="no entry"):
        lookups.strict_lookup(a, t, "k", "v").collect()
    two = spark.createDataFrame([(2,)], "k int")
    with pytest.raises(Exception, match="more than one"):
        lookups.unique_match(two, t, "k", "v", "d").collect()
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "g int, o int, v string")
    with pytest.raises(Exception, match="line count"):
        lookups.converted_together(rows, "g", "o", "v", lambda c: F.replace(c, F.lit("a"), F.lit("x\r\ny"))).collect()


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("电脑", f"{tmp_path}/out/a.txt"), ("软体", f"{tmp_path}/out/b.log")], "t string, target string")
    done = text.write_files(rows.withColumn("data", text.encoded(F.col("t"), "gbk")))
    assert {r.bytes for r in done.collect()} == {4}
    got = {r.path.rpartition("/")[2]: r.text for r in text.read_text(spark, f"file://{tmp_path}/out", "gbk").collect()}
    assert got == {"a.txt": "电脑", "b.log": "软体"}
    assert [r.name for r in text.listing(spark, f"file://{tmp_path}/out", ["*.txt"]).collect()] == ["a.txt"]
    assert bytes(one(spark, "é", lambda c: text.encoded(c, "utf-8", bom=True))) == b"\xef\xbb\xbf\xc3\xa9"


def test_settings(spark):
    assert one(spark, "{}", settings.parsed).max_length_preview == 6
    assert one(spark, '{"FileConvert":{"TypeFilter":"<A|*.a>"}}', settings.parsed).type_filter == "<A|*.a>"


def test_conflicts(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, target string")
    there = spark.createDataFrame([("b",)], "target string")
    flags = lambda p: [r.is_replace for r in files.resolve_conflicts(rows, there, p).orderBy("id").collect()]
    assert flags("replace") == [True, True] and flags("skip") == [True, False] and flags("cancel") == [True, False]
    with pytest.raises(ValueError):
        flags("other")


def test_tag_groups_keep_every_element(spark, tmp_path):
    from hanweave.plans import queries

    spark.createDataFrame([(1, " ".join(f"n{i}" for i in range(150)), "b"), (2, "", "c")], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    one_, two = queries.QUERIES["tag_groups"](spark, str(tmp_path)).orderBy("p_partkey").collect()
    assert (one_.n, one_.head, one_.rest) == (151, "n0", "; ".join([*(f"n{i}" for i in range(1, 150)), "b"]))
    assert (two.n, two.head, two.rest) == (1, "c", "")
