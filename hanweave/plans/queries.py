"""Registered queries over the driver's tables, with their DuckDB oracles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hanweave.functions import actions, charsets, convert, markup, names, sniff, tables
from hanweave.operators import dictionary, files, lookups
from hanweave.session import with_charsets
from hanweave.sources import settings
from hanweave.sources.text import encoded, listing, preview, read_text, write_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their letters as Simplified characters."""
    return table(spark, sf_dir, "documents").select("doc_id", convert.sinified(F.col("text")).alias("text"))


#: The vocabulary of the queries: overlapping words, a disabled first duplicate, a reserved word.
WORDS = [
    (1, True, "Default", "经机", 5, "經機器", 5),
    (2, True, "Default", "经机头", 5, "那個", 5),
    (3, True, "Default", "头国", 9, "頭國們", 1),
    (4, False, "Default", "网换", 8, "網換", 8),
    (5, True, "Default", "网换", 8, "網路換", 8),
    (6, True, "Default", "软转脑", 7, "和", 7),
    (7, True, "Protect", "换转", 9999, "换转", 9999),
    (8, True, "Tech", "电脑", 3, "電腦機", 3),
    (9, True, "Tech", "网转计", 4, "進行", 4),
    (10, True, "Default", "学学", 2, "學", 2),
    (11, True, "Tech", "发", 1, "髮", 1),
    (12, True, "Default", "頭髮", 6, "發", 6),
]


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WORDS, dictionary.SCHEMA)


# --- pages -----------------------------------------------------------------------------


@query
def meta_charset_rewrite(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", markup.relabelled(F.col("html"), F.lit("html"), "big5").alias("html"))


@query
def page_labels_by_extension(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    ext = markup.extension(F.col("url"))
    return pages.select("page_id", ext.alias("ext"), ext.isin(*markup.LABELLED).alias("labelled"))


PATTERNS = ("*7", "*.com*1", "*/en/*", "*#top")


EXTRA_LABELS = settings.DEFAULT_LABELS + "|.css"


@query
def relabel_by_extension(spark, sf_dir):
    """Pages as web, PHP and style files and one that has no rule: labels follow the settings' list."""
    heads = {"HTML": "", "php": '<?php header("Content-Type:text/html;  charset=utf-8"); ?>', "css": '@charset "utf-8"; ', "txt": '@charset "utf-8"; '}
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("head")) for k, v in heads.items()]))
    rows = table(spark, sf_dir, "pages").select("page_id", "html", kinds.alias("k")).select("page_id", "k.kind", F.concat("k.head", "html").alias("text"))
    named = rows.withColumn("ext", markup.extension(F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit("."), F.col("kind"))))
    labels = F.split(F.lit(EXTRA_LABELS), r"\|")
    text = F.when(markup.has_label_rule(F.col("ext"), labels), markup.relabelled(F.col("text"), F.col("ext"), "big5")).otherwise(F.col("text"))
    return named.select("page_id", "ext", text.alias("text"))


@query
def url_pattern_filter(spark, sf_dir):
    return files.refined(table(spark, sf_dir, "pages").select("page_id", "url"), PATTERNS, "url")


FILTER_SPEC = "<Text|*.txt;*.md>/<Web|*.htm;*.html>/broken/<All|*>"


@query
def filter_spec_parse(spark, sf_dir):
    specs = table(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit(FILTER_SPEC + "/<"), "r_name", F.lit("|*."), F.lower("r_name"), F.lit(">")).alias("spec"))
    return files.filter_table(specs)


@query
def sanitize_names(spark, sf_dir):
    url = F.concat("url", F.lit("..."))
    return table(spark, sf_dir, "pages").select("page_id", names.valid_file_name(url).alias("name"), names.valid_folder_name(url).alias("folder"))


@query
def output_path_template(spark, sf_dir):
    path = F.concat(F.lit("in/"), F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit(".txt"))
    part = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return part.select("p_partkey", names.output_path(F.col("path"), "in/*/*.txt", "out/*_*.big5.txt").alias("target"), names.output_path(F.col("path"), "in/*/*.txt", "flat/").alias("flat"), names.occurrences(F.col("path"), "n").alias("n_count"))


@query
def reroot_path(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("parent", F.concat_ws("/", F.slice(F.split("url", "/"), 1, 3)))
    parts = names.name_parts(F.col("url"))
    return pages.select("page_id", names.rerooted(F.col("url"), F.col("parent"), "/out").alias("target"), parts["depth"].alias("depth"), parts["name"].alias("name"), parts["parent"].alias("folder"))


def _file_list(spark, sf_dir) -> DataFrame:
    path = F.concat(F.lit("root/"), F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit("/"), F.col("p_name"))
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3 != 0).alias("is_checked"), (F.col("p_size") % 2 == 0).alias("is_file"), F.col("p_name").alias("name"), path.alias("path"))


@query
def file_list_rank(spark, sf_dir):
    return files.ranked(_file_list(spark, sf_dir)).select("id", "rank")


def _targets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A file list with target paths, and the paths that exist already."""
    target = lambda c: F.concat(F.lit("out/"), F.col(c).cast("string"))
    return _file_list(spark, sf_dir).withColumn("target", target("id")), table(spark, sf_dir, "part").filter("p_size > 25").select(target("p_partkey").alias("target"))


@query
def conflict_skip(spark, sf_dir):
    rows, there = _targets(spark, sf_dir)
    return files.writable(files.resolve_conflicts(rows, there, "skip")).select("id", "target", "target_exists")


@query
def conflict_replace(spark, sf_dir):
    rows, there = _targets(spark, sf_dir)
    return files.writable(files.resolve_conflicts(rows, there, "replace")).select("id", "target", "target_exists")


@query
def conflict_cancel(spark, sf_dir):
    rows = _file_list(spark, sf_dir).withColumn("target", F.concat(F.lit("out/"), F.col("id").cast("string")))
    there = table(spark, sf_dir, "part").filter("p_partkey % 17 = 16").select(F.concat(F.lit("out/"), F.col("p_partkey").cast("string")).alias("target"))
    return files.resolve_conflicts(rows, there, "cancel").select("id", "is_replace")


@query
def rename_plan(spark, sf_dir):
    paths = _file_list(spark, sf_dir).select("path").distinct()
    return files.rename_plan(paths, lambda c: convert.full_width(names.valid_file_name(F.concat(c, F.lit("."))))).select("old_path", "new_path", "depth", "step")


@query
def tree_listing(spark, sf_dir):
    nodes = files.tree_rows(_file_list(spark, sf_dir).select("path"))
    return files.post_order(nodes)


@query
def distinct_rows(spark, sf_dir):
    """Rows that two lists share, once by their id and once by their values."""
    rows = _file_list(spark, sf_dir).select("id", "name", "is_file")
    twice = rows.unionByName(rows.filter("is_file"))
    by_id = twice.dropDuplicates(["id"]).select(F.lit("id").alias("by"), "id", "name", "is_file")
    return by_id.unionByName(twice.select("name", "is_file").distinct().select(F.lit("value").alias("by"), F.lit(-1).cast("long").alias("id"), "name", "is_file"))


# --- text ------------------------------------------------------------------------------


def _documents(column: Callable[[Column], Column], name: str = "text", source=None) -> Query:
    read = source or (lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lambda spark, sf_dir: read(spark, sf_dir).select("doc_id", column(F.col("text")).alias(name))


QUERIES["fullwidth_symbols"] = _documents(convert.full_width)
QUERIES["halfwidth_symbols"] = _documents(lambda c: convert.half_width(F.concat(convert.full_width(c), F.lit(tables.FULL))))
QUERIES["html_entities_dec"] = _documents(markup.decimal_references)
QUERIES["html_entities_hex"] = _documents(markup.hex_references)
QUERIES["html_decode_roundtrip"] = _documents(lambda c: markup.decoded_references(F.concat(markup.decimal_references(c), markup.hex_references(c))))
QUERIES["text_preview"] = _documents(lambda c: preview(F.concat(c, F.lit("\x00\x00")), 1), "preview")


@query
def latin1_density(spark, sf_dir):
    d = charsets.latin1_density(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.floor(d * 1000).cast("long").alias("permille"), (d > 0.2).alias("looks_latin1"))


def _reports(report) -> Query:
    def run(spark, sf_dir):
        r = report(F.col("text").cast("binary"))
        return table(spark, sf_dir, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.ascii", "r.symbol", "r.common", "r.rare", "r.unknown", F.round(F.col("r.bad_smell").cast("double"), 5).alias("bad_smell"))

    return run


QUERIES["sniff_big5_rules"] = _reports(sniff.big5_report)
QUERIES["sniff_gbk_rules"] = _reports(sniff.gbk_report)


@query
def sniff_score(spark, sf_dir):
    data = F.col("text").cast("binary")
    scores = F.array(sniff.big5_report(data)["bad_smell"], sniff.gbk_report(data)["bad_smell"])
    return table(spark, sf_dir, "documents").select("doc_id", sniff.best(scores).alias("best"))


@query
def sniff_four_scores(spark, sf_dir):
    return chinese(with_charsets(spark), sf_dir).select("doc_id", sniff.sniffed(F.col("text")).alias("simplified"), sniff.sniffed(convert.to_traditional(F.col("text"))).alias("traditional"))


# --- conversion --------------------------------------------------------------------------


@query
def s2t_convert(spark, sf_dir):
    return chinese(spark, sf_dir).select("doc_id", convert.convert(F.col("text"), convert.TO_TRADITIONAL).alias("text"))


@query
def t2s_convert(spark, sf_dir):
    rows = chinese(spark, sf_dir).select("doc_id", F.translate("text", *TRADITIONAL).alias("text"))
    return rows.select("doc_id", convert.convert(F.col("text"), convert.TO_SIMPLIFIED).alias("text"))


#: The Simplified stand-ins for a..z and their Traditional forms, by hand.
TRADITIONAL = (tables.SINIFIED, "軟體電腦頭髮計機網絡數庫語轉換簡漢國學經濟東門馬鳥魚")


@query
def vocab_convert(spark, sf_dir):
    words = dictionary.compile_words(vocabulary(spark))
    return chinese(spark, sf_dir).select("doc_id", dictionary.replace_words(F.col("text"), words).alias("text"))


@query
def reserved_convert(spark, sf_dir):
    words = dictionary.compile_words(vocabulary(spark))
    return chinese(spark, sf_dir).select("doc_id", convert.to_traditional(F.col("text"), words.reserved).alias("text"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary, then characters with reserved words kept, over all documents."""
    words = dictionary.compile_words(vocabulary(spark))
    return chinese(spark, sf_dir).select("doc_id", convert.convert(F.col("text"), convert.TO_TRADITIONAL, words).alias("text"))


QUERIES["vocab_s2t_convert"] = flagship


@query
def vocab_t2s_convert(spark, sf_dir):
    words = dictionary.compile_words(vocabulary(spark), to_traditional=False)
    rows = chinese(spark, sf_dir).select("doc_id", F.translate("text", *TRADITIONAL).alias("text"))
    return rows.select("doc_id", convert.convert(F.col("text"), convert.TO_SIMPLIFIED, words).alias("text"))


@query
def vocab_by_join(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("t"))
    found = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("word"), F.col("n_nationkey").cast("string").alias("replacement"))
    colours = spark.createDataFrame([("red", "赤"), ("green", "青"), ("blue", "藍"), ("small", "小")], "word string, replacement string")
    return dictionary.replace_by_join(rows, "t", found.unionByName(colours)).select("id", "replaced")


@query
def vocab_by_table(spark, sf_dir):
    """The vocabulary as a table that is joined, as one too large for literals would be."""
    rows = chinese(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return dictionary.replace_by_table(rows, dictionary.compiled_table(vocabulary(spark))).select(F.col("id").alias("doc_id"), F.col("replaced").alias("text"))


BEFORE, AFTER, PROTECT = [("license", "licence"), ("the ", "THE "), ("the", "DIE")], [("e,", "E;"), ("THE", "La")], ["and the", "other"]


@query
def replace_lists(spark, sf_dir):
    """Replacements before and after a conversion, with protected words."""
    text = convert.replaced_in_order(F.col("text"), BEFORE, AFTER, PROTECT, convert.full_width)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query
def dictionary_file(spark, sf_dir):
    """The vocabulary saved to a file and loaded again."""
    path = _work_dir(spark, "dictionary")
    dictionary.save(vocabulary(spark), path)
    return dictionary.load(spark, path).drop("ln")


@query
def dict_compile_s2t(spark, sf_dir):
    return dictionary.compiled_table(vocabulary(spark), True)


@query
def dict_compile_t2s(spark, sf_dir):
    return dictionary.compiled_table(vocabulary(spark), False)


@query
def dictionary_search(spark, sf_dir):
    return dictionary.search(vocabulary(spark), "TECH").select("ln", "simplified", "traditional")


@query
def editor_sort_rank(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("ln"), F.lit(True).alias("enable"), F.col("p_brand").alias("type"), F.col("p_name").alias("simplified"), F.col("p_size").alias("simplified_priority"), F.col("p_type").alias("traditional"), F.col("p_size").alias("traditional_priority"))
    return dictionary.editor_ranked(rows).select("ln", "rank")


@query
def dictionary_lines(spark, sf_dir):
    lines = dictionary.print_lines(vocabulary(spark))
    broken = spark.createDataFrame([(90, "True\tDefault\tshort"), (91, ""), (92, "True\ta\tb\t1\tc\t2\textra")], "ln long, value string")
    return dictionary.parse_lines(lines.unionByName(broken))


# --- transcoding -------------------------------------------------------------------------


def _transcoded(name: str) -> Query:
    def run(spark, sf_dir):
        return chinese(with_charsets(spark), sf_dir).select("doc_id", actions.registry()[name](F.col("text")).alias("text"))

    return run


for _name in ("a1", "a2", *actions.TRANSCODERS):
    QUERIES[f"transcode_{_name}"] = _transcoded(_name)


@query
def file_convert_fallback(spark, sf_dir):
    text = convert.convert_file(F.col("text"), "gbk", "big5", convert.NONE)
    return chinese(with_charsets(spark), sf_dir).select("doc_id", text.alias("text"))


@query
def mojibake_repair(spark, sf_dir):
    rows = chinese(with_charsets(spark), sf_dir)
    broken = charsets.reinterpret(F.col("text"), "gbk", "iso-8859-1")
    return rows.select("doc_id", charsets.repair_latin1(broken, "gbk").alias("text"))


def written(spark, sf_dir) -> DataFrame:
    """Documents as bytes of two charsets: Simplified in GBK, or Traditional in Big5, by language."""
    simplified = F.col("lang").isin("en", "fr")
    rows = table(spark, sf_dir, "documents").select("doc_id", convert.sinified(F.col("text")).alias("text"), simplified.alias("simplified"))
    return rows.select("doc_id", F.when(F.col("simplified"), charsets.encode(F.col("text"), "gbk")).otherwise(charsets.encode(F.translate("text", *TRADITIONAL), "big5")).alias("data"))


@query
def decode_by_sniffing(spark, sf_dir):
    """Bytes without a declared charset: sniffed, decoded, and converted to Traditional."""
    text = sniff.decoded_by_sniffing(F.col("data"))
    return written(with_charsets(spark), sf_dir).select("doc_id", sniff.sniffed_bytes(F.col("data")).alias("kind"), convert.convert(text, convert.TO_TRADITIONAL).alias("text"))


@query
def transcode_unless_big5(spark, sf_dir):
    """The re-reading of ``a1``, but only where the text doesn't seem to be Big5 already."""
    rows = table(with_charsets(spark), sf_dir, "documents").select("doc_id", "lang", convert.sinified(F.col("text")).alias("text"))
    rows = rows.select("doc_id", F.when(F.col("lang").isin("en", "fr"), F.col("text")).otherwise(F.translate("text", *TRADITIONAL)).alias("text"))
    return rows.select("doc_id", sniff.unless_already(F.col("text"), "big5", actions.registry()["a1"](F.col("text"))).alias("text"))


@query
def transfer_between(spark, sf_dir):
    return chinese(with_charsets(spark), sf_dir).select("doc_id", charsets.transfer(F.col("text"), "gbk", "big5").alias("text"))


# --- lookups and lists -----------------------------------------------------------------


@query
def batch_convert_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.translate("text", "\r\n", "  ").alias("text"))
    return lookups.converted_together(turns, "conv_id", "turn", "text", convert.full_width)


@query
def tag_fallback(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    old = labels.select("doc_id", F.col("quality").cast("string").alias("value"), F.col("toxic").alias("ord"))
    new = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("value"))
    return lookups.fallback(new, old, ["doc_id"], "value", ["ord", "value"])


@query
def tag_results(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    return lookups.strict_lookup(nation, table(spark, sf_dir, "region"), "r_regionkey", "r_name")


@query
def module_antijoin(spark, sf_dir):
    known = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select("n_name", (F.col("n_regionkey") == 1).alias("enabled"))
    return lookups.with_missing(known, table(spark, sf_dir, "nation").select("n_name"), "n_name")


def _maps(spark, sf_dir):
    """Two overlapping maps that together hold every customer."""
    c = table(spark, sf_dir, "customer")
    pick = lambda m, some: c.filter(some).select(F.col("c_custkey").alias("key"), F.concat(F.col("c_mktsegment"), F.lit(f"-{m}")).alias("value"))
    return pick("old", "c_acctbal >= 1000"), pick("new", "c_acctbal < 4000")


@query
def map_upsert(spark, sf_dir):
    old, new = _maps(spark, sf_dir)
    return lookups.upsert(old, new, "key", "value", True)


@query
def map_insert_missing(spark, sf_dir):
    old, new = _maps(spark, sf_dir)
    return lookups.upsert(old, new, "key", "value", False)


@query
def map_without_keys(spark, sf_dir):
    old, new = _maps(spark, sf_dir)
    return lookups.without_keys(old, new, "key")


@query
def map_inverse(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_type", "p_brand", "p_partkey")
    return lookups.inverted(rows, "p_brand", "p_type", "p_partkey")


@query
def unique_reverse_lookup(spark, sf_dir):
    names_ = table(spark, sf_dir, "nation").select(F.col("n_name"), F.col("n_nationkey").cast("string").alias("id"))
    asked = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("n_name")).unionByName(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name"))
    return lookups.unique_match(asked, names_, "n_name", "id", "0")


@query
def first_order_per_customer(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderkey").alias("first_order"))


@query
def string_properties(spark, sf_dir):
    return lookups.string_properties(table(spark, sf_dir, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))), "c_custkey")


@query
def tag_groups(spark, sf_dir):
    joined = F.concat_ws("; ", F.split("p_name", " "), F.array(F.lit(""), F.col("p_brand")))
    rows = table(spark, sf_dir, "part").select("p_partkey", names.split_group(joined).alias("g"))
    return rows.select("p_partkey", F.size("g").cast("long").alias("n"), names.joined_group(names.with_first(F.col("g"), F.lit("第一"))).alias("joined"), F.get("g", F.lit(0)).alias("head"), names.joined_group(F.slice("g", 2, F.greatest(F.size("g") - 1, F.lit(0)))).alias("rest"))


@query
def label_list(spark, sf_dir):
    doc = F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit('{"MaxLengthPreview": 9, "FileConvert": {"TypeFilter": "none", "FixLabel": ".HTM|.'), F.col("r_name"), F.lit('"}}'))).otherwise("{}")
    s = settings.parsed(doc)
    return table(spark, sf_dir, "region").select("r_regionkey", s["max_length_preview"].alias("chars"), s["type_filter"].alias("type_filter"), F.array_join(s["labels"], "|").alias("labels"), s["add_bom"].alias("add_bom"))


@query
def name_caps(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 245).alias("name"), F.substring("text", 1, 500).alias("line"))


def _work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors see; only a local master may do without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="hanweave-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def files_round_trip(spark, sf_dir):
    """Every page written as two files, UTF-8 with a mark and UTF-16, found by wildcards and read again."""
    base = _work_dir(spark, "files")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("name"), "html")
    rows = pages.select(F.concat(F.lit(f"{base}/a/"), "name", F.lit(".txt")).alias("target"), encoded(F.col("html"), "utf-8", bom=True).alias("data")).unionByName(
        pages.select(F.concat(F.lit(f"{base}/b/"), "name", F.lit(".log")).alias("target"), encoded(F.col("html"), "unicode", bom=True).alias("data"))
    )
    write_files(rows).agg(F.sum("bytes")).collect()
    found = listing(spark, base, ["*.txt", "*.log"]).select("path", "length")
    texts = read_text(spark, f"{base}/a", "utf-8", glob="*.txt").unionByName(read_text(spark, base, "unicode", glob="*.log", recursive=True))
    name = F.element_at(F.split("path", "/"), -1)
    return texts.join(found, "path").select(F.substring_index(name, ".", 1).cast("long").alias("page_id"), markup.extension(name).alias("ext"), "length", "text")


@query
def convert_files(spark, sf_dir):
    """A batch from files to files: found by wildcard, read as GBK, converted, and written as Big5 by a path template."""
    base = _work_dir(with_charsets(spark), "batch")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit(f"{base}/in/"), F.col("page_id").cast("string"), F.lit(".txt")).alias("target"), encoded(convert.sinified(F.col("html")), "gbk").alias("data"))
    write_files(pages).agg(F.sum("bytes")).collect()
    found = read_text(spark, f"{base}/in", "gbk", glob="*.txt")
    path = F.concat(F.lit("in/"), F.element_at(F.split("path", "/"), -1))
    target = F.concat(F.lit(f"{base}/"), names.output_path(path, "in/*.txt", "out/*.big5.txt"))
    text = convert.convert_file(F.col("text"), "gbk", "big5", convert.TO_TRADITIONAL)
    write_files(found.select(target.alias("target"), encoded(text, "big5").alias("data"))).agg(F.sum("bytes")).collect()
    done = read_text(spark, f"{base}/out", "big5", glob="*.big5.txt")
    return done.select(F.substring_index(F.element_at(F.split("path", "/"), -1), ".", 1).cast("long").alias("page_id"), "text")


@query
def stream_convert_events(spark, sf_dir):
    """All events through a file stream into a table, once each."""
    from hanweave.streaming import convert as streaming

    events = table(spark, sf_dir, "events")
    base = _work_dir(spark, "stream")
    stream = streaming.text_stream(spark, sf_dir, events.schema, glob="events.parquet")
    done = streaming.converted(stream.select("event_id", "event_type", "props"), "event_type", convert.sinified)
    streaming.write_available(done, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{base}/out").select("event_id", "event_type", "preview")


@query
def events_by_user(spark, sf_dir):
    """Events of each user with their place and the first one's time, for ordered batch conversion."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(w).cast("long").alias("place"))


def oracle_sql() -> dict[str, str]:
    from hanweave.plans import oracle

    return oracle.statements()
