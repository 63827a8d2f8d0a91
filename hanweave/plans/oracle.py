"""DuckDB statements for the registered queries, written independently of the Spark plans.

The two character tables are the engine's own (ICU data, which DuckDB lacks), so these
statements check how they are used; ``tests/test_functions.py`` checks pairs by hand.
"""

from __future__ import annotations

from hanweave.functions import actions, tables
from hanweave.plans.oracle_charsets import Chain
from hanweave.plans.queries import AFTER, BEFORE, EXTRA_LABELS, PATTERNS, PROTECT, TRADITIONAL, WORDS
from hanweave.sources.settings import DEFAULT_FILTER, DEFAULT_LABELS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _translate(value: str, source: str, target: str) -> str:
    return f"translate({value}, {_text(source)}, {_text(target)})"


def _words() -> str:
    rows = ", ".join(f"({ln}, {str(on).lower()}, {_text(kind)}, {_text(s)}, {sp}, {_text(t)}, {tp})" for ln, on, kind, s, sp, t, tp in WORDS)
    return f"(VALUES {rows}) AS w(ln, enable, type, simplified, simplified_priority, traditional, traditional_priority)"


_SINIFIED = _translate("lower(text)", tables.LATIN, tables.SINIFIED)
_TRADITIONAL = _translate(_SINIFIED, *TRADITIONAL)


def _replaced(value: str, order: list[tuple[str, str]]) -> str:
    pattern = "(?s)(" + "|".join(k for k, _ in order) + "|.)"
    case = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in order)
    return f"array_to_string(list_transform(regexp_extract_all({value}, {_text(pattern)}), lambda t: CASE t {case} ELSE t END), '')"


#: Match order by hand, from the rules: priority, length, file order; first rows only; disabled ones hide.
_S2T = [("换转", "换转"), ("头国", "頭國們"), ("软转脑", "和"), ("頭髮", "發"), ("经机头", "那個"), ("经机", "經機器"), ("网转计", "進行"), ("电脑", "電腦機"), ("学学", "學"), ("发", "髮")]
_T2S = [("换转", "换转"), ("網路換", "网换"), ("和", "软转脑"), ("發", "頭髮"), ("經機器", "经机"), ("那個", "经机头"), ("進行", "网转计"), ("電腦機", "电脑"), ("學", "学学"), ("頭國們", "头国"), ("髮", "发")]


def _reserved_mapped(value: str, pairs: tuple[str, str]) -> str:
    return f"array_to_string(list_transform(string_split({value}, '换转'), lambda t: {_translate('t', *pairs)}), '换转')"


def _blank_kept(value: str, out: str) -> str:
    return f"CASE WHEN regexp_full_match({value}, '[\\s]*') THEN {value} ELSE {out} END"


def _references(number: str) -> str:
    return f"""
SELECT doc_id, coalesce(array_to_string(list_transform(string_split(text, ''), lambda c:
  CASE WHEN c = '&' THEN '&amp;' WHEN c = '<' THEN '&lt;' WHEN c = '>' THEN '&gt;'
       WHEN unicode(c) BETWEEN 32 AND 126 OR unicode(c) IN (10, 13) THEN c ELSE {number} END), ''), '') AS text
FROM documents"""


def _report(tokens: str, symbol: str, common: str, rare: str, trail: str, source: str = "SELECT doc_id, hex(encode(text)) AS v FROM documents") -> str:
    return f"""
SELECT doc_id, len(list_filter(k, lambda t: len(t) = 2 AND t < '80'))::INTEGER AS ascii,
  len(list_filter(k, lambda t: {symbol} AND {trail}))::INTEGER AS symbol,
  len(list_filter(k, lambda t: {common} AND {trail}))::INTEGER AS common,
  len(list_filter(k, lambda t: {rare} AND {trail}))::INTEGER AS rare,
  len(list_filter(k, lambda t: len(t) = 4 AND NOT ({trail} AND ({symbol} OR {common} OR {rare}))))::INTEGER AS unknown
FROM (SELECT doc_id, regexp_extract_all(v, '{tokens}') AS k FROM ({source}))"""


_BIG5_RULES = (
    "(?:[89A-E][0-9A-F]|F[0-9A-E])[0-9A-F]{2}|[0-7][0-9A-F]|[0-9A-F]{2}",
    "(len(t) = 4 AND t BETWEEN 'A140' AND 'A3BF')",
    "(len(t) = 4 AND t BETWEEN 'A440' AND 'C67E')",
    "(len(t) = 4 AND t BETWEEN 'C940' AND 'F9D5')",
    "(t[3:4] BETWEEN '40' AND '7E' OR t[3:4] BETWEEN 'A1' AND 'FE')",
)
_GBK_RULES = (
    "(?:A[1-9A-F]|[B-E][0-9A-F]|F[0-7])[0-9A-F]{2}|[0-7][0-9A-F]|[0-9A-F]{2}",
    "(len(t) = 4 AND t[1:2] BETWEEN 'A1' AND 'A9')",
    "(len(t) = 4 AND t[1:2] BETWEEN 'B0' AND 'D7')",
    "(len(t) = 4 AND t[1:2] BETWEEN 'D8' AND 'F7')",
    "(t[3:4] BETWEEN 'A1' AND 'FE')",
)
_BIG5, _GBK = _report(*_BIG5_RULES), _report(*_GBK_RULES)
_BAD = "CASE WHEN ascii + symbol + common + rare + unknown = 0 THEN 0 ELSE CAST((rare + 3 * unknown) / (ascii + symbol + common + rare + unknown) AS FLOAT) END"

_COMPILED = """
SELECT {key} AS word, {value} AS replacement, {key}_priority AS priority, CAST(length({key}) AS INTEGER) AS length, CAST(ln AS BIGINT) AS ln,
  simplified_priority = 9999 AND traditional_priority = 9999 AND simplified = traditional AS reserved,
  CAST(row_number() OVER (ORDER BY {key}_priority DESC, length({key}) DESC, ln) AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ln) AS rn FROM {words}) WHERE rn = 1 AND enable"""

_LIST = """SELECT p_partkey AS id, p_size % 3 <> 0 AS is_checked, p_size % 2 = 0 AS is_file, p_name AS name,
  'root/' || p_brand || '/' || p_type || '/' || p_name AS path FROM part"""


def _charsets(s2t: tuple[str, str], t2s: tuple[str, str]) -> dict[str, str]:
    """Transcoding, by chains of tables."""
    docs = f"SELECT doc_id, {_SINIFIED} AS v FROM documents"
    found = {}

    def reread(chain: Chain, a: str, b: str) -> Chain:
        return chain.encoded(a).decoded(b)

    names = {"hz-gb-2312": "hz", None: "big5"}
    for name, (a, b) in actions.TRANSCODERS.items():
        found[f"transcode_{name}"] = reread(Chain(docs), names.get(a, a), names.get(b, b)).done()
    guard = "WITH o AS ({}) SELECT d.doc_id AS doc_id, CASE WHEN regexp_full_match(d.v, '[\\s]*') THEN d.v ELSE o.text END AS text FROM ({}) d JOIN o ON d.doc_id = o.doc_id"
    found["transcode_a1"] = guard.format(reread(Chain(docs), "big5", "gbk").map(_translate("v", *s2t)).done(), docs)
    found["transcode_a2"] = guard.format(reread(Chain(docs).map(_translate("v", *t2s)), "gbk", "big5").done(), docs)
    found["file_convert_fallback"] = Chain(docs).unless_held("big5", dict(zip(*s2t))).done()
    found["transfer_between"] = Chain(docs).unless_held("gbk", "?").unless_held("big5", "?").done()
    pages = f"SELECT page_id AS doc_id, {_translate('lower(html)', tables.LATIN, tables.SINIFIED)} AS v FROM pages"
    found["convert_files"] = Chain(pages).encoded("gbk").decoded("gbk").map(_translate("v", *s2t)).encoded("big5").decoded("big5").done("SELECT doc_id AS page_id, v AS text FROM {}")
    broken = Chain(docs).encoded("gbk").decoded("latin1")
    again = Chain("SELECT doc_id, text AS v FROM broken").latin1().decoded("gbk").done()
    dense = "length(text) > 0 AND length(regexp_replace(text, '[^¡-¬®-ÿ]', '', 'g')) / length(text) > 0.2"
    found["mojibake_repair"] = f"WITH broken AS ({broken.done()}), again AS ({again}) SELECT b.doc_id AS doc_id, CASE WHEN {dense.replace('text', 'b.text')} THEN a.text ELSE b.text END AS text FROM broken b JOIN again a ON b.doc_id = a.doc_id"

    def four(source: str) -> str:
        """(doc_id, kind) by the first smallest of four scores."""
        data = {c: Chain(source).encoded(c).done("SELECT doc_id, v FROM {}") for c in ("big5", "gbk")}
        scores = [f"(SELECT doc_id, {_BAD} AS s{i} FROM ({_report(*rules, data[c])}))" for i, (rules, c) in enumerate(((_BIG5_RULES, "big5"), (_BIG5_RULES, "gbk"), (_GBK_RULES, "big5"), (_GBK_RULES, "gbk")))]
        least = "least(s0, s1, s2, s3)"
        joined = f"{scores[0]} " + " ".join(f"JOIN {x} USING (doc_id)" for x in scores[1:])
        return f"SELECT doc_id, CAST(CASE WHEN CAST(s0 AS DOUBLE) + s1 + s2 + s3 = 0 THEN -1 WHEN s0 = {least} THEN 0 WHEN s1 = {least} THEN 1 WHEN s2 = {least} THEN 2 ELSE 3 END AS INTEGER) AS kind FROM {joined}"

    found["sniff_four_scores"] = f"""SELECT a.doc_id AS doc_id, a.kind AS simplified, b.kind AS traditional
FROM ({four(docs)}) a JOIN ({four(f"SELECT doc_id, {_translate(_SINIFIED, *s2t)} AS v FROM documents")}) b ON a.doc_id = b.doc_id"""
    mixed = f"SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN {_SINIFIED} ELSE {_TRADITIONAL} END AS v FROM documents"
    a1 = guard.format(reread(Chain(mixed), "big5", "gbk").map(_translate("v", *s2t)).done(), mixed)
    found["transcode_unless_big5"] = f"SELECT m.doc_id AS doc_id, CASE WHEN k.kind IN (0, 1) THEN m.v ELSE a.text END AS text FROM ({mixed}) m JOIN ({four(mixed)}) k ON m.doc_id = k.doc_id JOIN ({a1}) a ON m.doc_id = a.doc_id"
    gbk, big5 = (Chain(f"{mixed} WHERE (lang IN ('en', 'fr')) = {some}").encoded(c).done("SELECT doc_id, v FROM {}") for some, c in (("true", "gbk"), ("false", "big5")))
    data = f"({gbk}) UNION ALL ({big5})"
    kinds = f"SELECT doc_id, CASE WHEN a + b = 0 THEN -1 WHEN a <= b THEN 0 ELSE 2 END AS kind FROM (SELECT doc_id, {_BAD} AS a FROM ({_report(*_BIG5_RULES, 'SELECT * FROM data')})) JOIN (SELECT doc_id, {_BAD} AS b FROM ({_report(*_GBK_RULES, 'SELECT * FROM data')})) USING (doc_id)"
    texts = [Chain("SELECT doc_id, v FROM data").decoded(c).done() for c in ("big5", "gbk")]
    found["decode_by_sniffing"] = f"""WITH data AS ({data}), k AS ({kinds}), b AS ({texts[0]}), g AS ({texts[1]})
SELECT k.doc_id AS doc_id, CAST(kind AS INTEGER) AS kind, {_blank_kept("x", _translate("x", *s2t))} AS text
FROM (SELECT k.doc_id, kind, CASE WHEN kind = 2 THEN g.text ELSE b.text END AS x FROM k JOIN b ON k.doc_id = b.doc_id JOIN g ON k.doc_id = g.doc_id) k"""
    return found


def _in_order(value: str, pairs: list[tuple[str, str]]) -> str:
    pattern = "(?s)(" + "|".join(k for k, _ in pairs) + "|.)"
    case = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in pairs)
    return f"array_to_string(list_transform(regexp_extract_all({value}, {_text(pattern)}), lambda u: CASE u {case} ELSE u END), '')"


def _protected() -> str:
    """Words are cut out, what is between them goes through both lists and the signs' table."""
    apart = "regexp_replace(text, '(" + "|".join(sorted(PROTECT, key=lambda w: -len(w))) + ")', chr(1) || chr(2) || '\\1' || chr(1), 'g')"
    one = _in_order(_translate(_in_order("t", BEFORE), tables.HALF, tables.FULL), AFTER)
    return f"SELECT doc_id, array_to_string(list_transform(string_split({apart}, chr(1)), lambda t: CASE WHEN starts_with(t, chr(2)) THEN t[2:] ELSE {one} END), '') AS text FROM documents"


def statements() -> dict[str, str]:
    s2t, t2s = tables.simplified_to_traditional(), tables.traditional_to_simplified()
    like = [p.replace(".", "\\.").replace("*", ".*?") + "$" for p in PATTERNS]
    first = "CASE " + " ".join(f"WHEN regexp_matches(url, {_text(p)}) THEN {i}" for i, p in enumerate(like)) + " END"
    label5 = "regexp_replace(html, '<meta(\\s+.*?)charset=\"(.*?)\"(.*?)>', '<meta\\1charset=\"big5\"\\3>', 'gi')"
    # the labels' expressions are fixed values, as in functions/markup.py
    label4 = f"regexp_replace({label5}, '<meta\\s+(.*?)content=\"(.*?)charset=(.*?)\"(.*?)>', '<meta \\1content=\"\\2charset=big5\"\\4>', 'gi')"
    full = _translate("text", tables.HALF, tables.FULL)
    found = {
        "meta_charset_rewrite": f"SELECT page_id, {label4} AS html FROM pages",
        "page_labels_by_extension": """
SELECT page_id, ext, ext IN ('htm', 'html', 'shtm', 'shtml', 'asp', 'aspx', 'php', 'css') AS labelled
FROM (SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)(?:[?#][^/]*)?$', 1)) AS ext FROM pages)""",
        "url_pattern_filter": f"SELECT page_id, url, CAST({first} AS INTEGER) AS pattern_pos FROM pages WHERE {first} IS NOT NULL",
        "filter_spec_parse": """
WITH s AS (SELECT r_regionkey, '<Text|*.txt;*.md>/<Web|*.htm;*.html>/broken/<All|*>/<' || r_name || '|*.' || lower(r_name) || '>' AS spec FROM region),
p AS (SELECT *, unnest(string_split(spec, '/')) AS part, unnest(range(0, len(string_split(spec, '/')))) AS filter FROM s),
i AS (SELECT *, regexp_extract(part, '<(.*)>', 1) AS inner_ FROM p),
k AS (SELECT *, string_split(substr(inner_, instr(inner_, '|') + 1), ';') AS l FROM i WHERE contains(inner_, '|'))
SELECT r_regionkey, spec, CAST(filter AS INTEGER) AS filter, split_part(inner_, '|', 1) AS label, CAST(unnest(range(0, len(l))) AS INTEGER) AS pos, unnest(l) AS wildcard FROM k""",
        "sanitize_names": """
SELECT page_id, nullif(regexp_replace(substr(regexp_replace(url || '...', '\\.+$', ''), 1, 245), '[\\x00-\\x1F"<>|:*?\\\\/]', '_', 'g'), '') AS name,
  nullif(regexp_replace(substr(regexp_replace(url || '...', '\\.+$', ''), 1, 245), '[\\x00-\\x1F"<>|]', '_', 'g'), '') AS folder FROM pages""",
        "output_path_template": """
SELECT p_partkey, 'out/' || p_brand || '_' || p_name || '.big5.txt' AS target, 'flat/' || p_name || '.txt' AS flat,
  CAST(len(list_filter(string_split('in/' || p_brand || '/' || p_name || '.txt', ''), lambda c: c = 'n')) AS INTEGER) AS n_count FROM part""",
        "reroot_path": """
WITH p AS (SELECT page_id, url, string_split(url, '/') AS s FROM pages)
SELECT page_id, '/out/' || array_to_string(s[4:], '/') AS target, CAST(len(s) AS INTEGER) AS depth, s[-1] AS name, array_to_string(s[:len(s) - 1], '/') AS folder FROM p""",
        "file_list_rank": f"SELECT id, CAST(row_number() OVER (ORDER BY path, is_file, name, id) AS INTEGER) AS rank FROM ({_LIST})",
        "conflict_skip": "SELECT p_partkey AS id, 'out/' || p_partkey AS target, false AS target_exists FROM part WHERE p_size % 3 <> 0 AND p_size <= 25",
        "conflict_replace": "SELECT p_partkey AS id, 'out/' || p_partkey AS target, p_size > 25 AS target_exists FROM part WHERE p_size % 3 <> 0",
        "conflict_cancel": f"""
SELECT id, id < (SELECT min(p_partkey) FROM part WHERE p_partkey % 17 = 16) AS is_replace FROM ({_LIST})""",
        "rename_plan": f"""
WITH d AS (SELECT DISTINCT path FROM ({_LIST})),
n AS (SELECT path AS old_path, {_translate("path", tables.HALF, tables.FULL)} AS new_path, CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM d)
SELECT *, CAST(row_number() OVER (ORDER BY depth DESC, old_path) AS INTEGER) AS step FROM n WHERE old_path <> new_path""",
        "tree_listing": f"""
WITH s AS (SELECT string_split(path, '/') AS s FROM ({_LIST})),
n AS (SELECT s, unnest(range(1, len(s) + 1)) AS depth FROM s),
g AS (SELECT array_to_string(s[:depth], '/') AS path, CAST(depth AS INTEGER) AS depth, max(depth = len(s)) AS is_file FROM n GROUP BY 1, 2)
SELECT path, CASE WHEN depth > 1 THEN array_to_string(string_split(path, '/')[:depth - 1], '/') END AS parent, depth, is_file, true AS is_checked,
  CAST(row_number() OVER (ORDER BY list_transform(string_split(path, '/'), lambda c, i: CASE WHEN i = depth AND is_file THEN '1' ELSE '0' END || c) || [chr(1114111)] DESC) AS INTEGER) AS walk FROM g""",
        "distinct_rows": """
SELECT 'id' AS by, p_partkey AS id, p_name AS name, p_size % 2 = 0 AS is_file FROM part
UNION ALL SELECT 'value', -1, name, is_file FROM (SELECT DISTINCT p_name AS name, p_size % 2 = 0 AS is_file FROM part)""",
        "fullwidth_symbols": f"SELECT doc_id, {full} AS text FROM documents",
        "halfwidth_symbols": f"SELECT doc_id, {_translate(full + ' || ' + _text(tables.FULL), tables.FULL, tables.HALF)} AS text FROM documents",
        "html_entities_dec": _references("'&#' || unicode(c) || ';'"),
        "html_entities_hex": _references("'&#x' || upper(to_hex(unicode(c))) || ';'"),
        "html_decode_roundtrip": "SELECT doc_id, text || text AS text FROM documents",
        "text_preview": "SELECT doc_id, regexp_replace(substr(text || chr(0) || chr(0), 1, 1000), '\\x00+$', '') AS preview FROM documents",
        "latin1_density": """
WITH d AS (SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE length(regexp_replace(text, '[^¡-¬®-ÿ]', '', 'g')) / length(text) END AS d FROM documents)
SELECT doc_id, CAST(floor(d * 1000) AS BIGINT) AS permille, d > 0.2 AS looks_latin1 FROM d""",
        "sniff_big5_rules": f"SELECT *, round(CAST({_BAD} AS DOUBLE), 5) AS bad_smell FROM ({_BIG5})",
        "sniff_gbk_rules": f"SELECT *, round(CAST({_BAD} AS DOUBLE), 5) AS bad_smell FROM ({_GBK})",
        "sniff_score": f"""
SELECT doc_id, CAST(CASE WHEN a + b = 0 THEN -1 WHEN a <= b THEN 0 ELSE 1 END AS INTEGER) AS best
FROM (SELECT doc_id, {_BAD} AS a FROM ({_BIG5})) JOIN (SELECT doc_id, {_BAD} AS b FROM ({_GBK})) USING (doc_id)""",
        "s2t_convert": f"SELECT doc_id, {_translate(_SINIFIED, *s2t)} AS text FROM documents",
        "t2s_convert": f"SELECT doc_id, {_translate(_TRADITIONAL, *t2s)} AS text FROM documents",
        "vocab_convert": f"SELECT doc_id, {_replaced(_SINIFIED, _S2T)} AS text FROM documents",
        "reserved_convert": f"SELECT doc_id, {_reserved_mapped(_SINIFIED, s2t)} AS text FROM documents",
        "vocab_s2t_convert": f"SELECT doc_id, {_blank_kept(_SINIFIED, _reserved_mapped(_replaced(_SINIFIED, _S2T), s2t))} AS text FROM documents",
        "vocab_t2s_convert": f"SELECT doc_id, {_blank_kept(_TRADITIONAL, _reserved_mapped(_replaced(_TRADITIONAL, _T2S), t2s))} AS text FROM documents",
        "vocab_by_join": """
WITH m AS (SELECT lower(n_name) AS word, CAST(n_nationkey AS VARCHAR) AS r FROM nation UNION ALL VALUES ('red', '赤'), ('green', '青'), ('blue', '藍'), ('small', '小')),
t AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS t, unnest(range(0, len(string_split(p_name, ' ')))) AS pos FROM part)
SELECT id, string_agg(coalesce(r, t), '' ORDER BY pos) AS replaced FROM t LEFT JOIN m ON t = word GROUP BY id""",
        "dict_compile_s2t": _COMPILED.format(key="simplified", value="traditional", words=_words()),
        "dict_compile_t2s": _COMPILED.format(key="traditional", value="simplified", words=_words()),
        "dictionary_search": f"SELECT CAST(ln AS BIGINT) AS ln, simplified, traditional FROM {_words()} WHERE lower(simplified) LIKE '%tech%' OR lower(traditional) LIKE '%tech%' OR lower(type) LIKE '%tech%'",
        "editor_sort_rank": "SELECT p_partkey AS ln, CAST(row_number() OVER (ORDER BY p_size DESC, length(p_name) DESC, p_name DESC, p_partkey) AS INTEGER) AS rank FROM part",
        "dictionary_lines": f"SELECT CAST(ln AS BIGINT) AS ln, enable, type, simplified, simplified_priority, traditional, traditional_priority FROM {_words()}",
        "batch_convert_conversations": f"SELECT conv_id, turn, {_translate('translate(text, chr(13) || chr(10), chr(32) || chr(32))', tables.HALF, tables.FULL)} AS text FROM conversations",
        "tag_fallback": """
WITH o AS (SELECT doc_id, CAST(quality AS VARCHAR) AS v, row_number() OVER (PARTITION BY doc_id ORDER BY toxic, CAST(quality AS VARCHAR)) AS rn FROM labels)
SELECT d.doc_id AS doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN lang END, o.v, '') AS value FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id AND rn = 1""",
        "tag_results": "SELECT r_regionkey, n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
        "module_antijoin": "SELECT n_name, CASE WHEN n_regionkey < 3 THEN n_regionkey = 1 END AS enabled FROM nation",
        "map_upsert": "SELECT c_custkey AS key, c_mktsegment || CASE WHEN c_acctbal < 4000 THEN '-new' ELSE '-old' END AS value FROM customer",
        "map_insert_missing": "SELECT c_custkey AS key, c_mktsegment || CASE WHEN c_acctbal >= 1000 THEN '-old' ELSE '-new' END AS value FROM customer",
        "map_without_keys": "SELECT c_custkey AS key, c_mktsegment || '-old' AS value FROM customer WHERE c_acctbal >= 4000",
        "map_inverse": "SELECT p_type, min_by(p_brand, p_partkey) AS p_brand FROM part GROUP BY p_type",
        "unique_reverse_lookup": """
SELECT q.n_name AS n_name, r_regionkey, coalesce(CAST(n.n_nationkey AS VARCHAR), '0') AS id
FROM (SELECT r_regionkey, r_name AS n_name FROM region UNION ALL SELECT n_regionkey, n_name FROM nation) q LEFT JOIN nation n ON q.n_name = n.n_name""",
        "first_order_per_customer": "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey",
        "string_properties": """
SELECT c_custkey, 'c_name' AS tag_name, c_name AS value FROM customer WHERE c_custkey % 5 <> 0 AND c_name IS NOT NULL
UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL""",
        "tag_groups": """
WITH g AS (SELECT p_partkey, list_filter(string_split(p_name, ' ') || [p_brand], lambda x: x <> '') AS g FROM part)
SELECT p_partkey, CAST(len(g) AS BIGINT) AS n, array_to_string(['第一'] || g[2:], '; ') AS joined, g[1] AS head, array_to_string(g[2:], '; ') AS rest FROM g""",
        "label_list": f"""
SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 9 ELSE 6 END AS chars, {_text(DEFAULT_FILTER)} AS type_filter,
  CASE WHEN r_regionkey % 2 = 0 THEN lower('.HTM|.' || r_name) ELSE {_text(DEFAULT_LABELS)} END AS labels, false AS add_bom FROM region""",
        "vocab_by_table": f"SELECT doc_id, {_replaced(_SINIFIED, _S2T)} AS text FROM documents",
        "replace_lists": _protected(),
        "dictionary_file": f"SELECT enable, type, simplified, simplified_priority, traditional, traditional_priority FROM {_words()}",
        "files_round_trip": """
SELECT page_id, 'txt' AS ext, CAST(strlen(html) + 3 AS BIGINT) AS length, html AS text FROM pages
UNION ALL SELECT page_id, 'log', CAST(2 * (length(html) + len(list_filter(string_split(html, ''), lambda c: unicode(c) > 65535))) AS BIGINT), html FROM pages""",
        # the labels' expressions and replacements are fixed values, as in functions/markup.py
        "relabel_by_extension": f"""
WITH k(ext, head) AS (VALUES ('html', ''), ('php', '<?php header("Content-Type:text/html;  charset=utf-8"); ?>'), ('css', '@charset "utf-8"; '), ('txt', '@charset "utf-8"; ')),
r AS (SELECT page_id, ext, head || html AS html, contains('|' || {_text(EXTRA_LABELS)} || '|', '|.' || ext || '|') AS listed FROM pages, k),
l AS (SELECT *, {label4} AS web FROM r)
SELECT page_id, ext, CASE WHEN NOT listed THEN html WHEN ext = 'html' THEN web WHEN ext = 'css' THEN regexp_replace(html, '@charset "(.*?)"', '@charset "big5"', 'gi')
  ELSE regexp_replace(web, 'header\\("Content-Type:text/html;\\s*charset=(.*?)"\\);', 'header("Content-Type:text/html; charset=big5");', 'gi') END AS text FROM l""",
        "name_caps": "SELECT doc_id, substr(text, 1, 245) AS name, substr(text, 1, 500) AS line FROM documents",
        "stream_convert_events": f"SELECT event_id, event_type, {_translate('lower(event_type)', tables.LATIN, tables.SINIFIED)} AS preview FROM events",
        "events_by_user": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events",
    }
    return found | _charsets(s2t, t2s)
