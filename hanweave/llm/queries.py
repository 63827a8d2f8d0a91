"""Registered queries of the training-data operators, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanweave.llm import chat, decontaminate, idfile, lines, packing, quality, simjoin, suffix, topk, warc
from hanweave.llm.storage import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that a 100-byte string with an earlier start covers."""
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"), span=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best inner products of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through dictionary-compressed WARC archives and back."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of later three-line windows."""
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through Huffman-coded token-id files and back."""
    manifest = idfile.write_ids(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)
    return idfile.read_digests(manifest)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 byte-BPE tokens."""
    rows = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=2048)
    placed = packing.pack(rows, capacity=2048)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


PROBE = r"\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the written output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    paths = chat.reply_paths(chat.chains(rows.unionByName(probe)), max_branches=1)
    out = materialise(chat.format_paths(paths), "chat-formatted")
    read = out.select(F.col("tree_id").alias("conv_id"), "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of near duplicates of every document."""
    return simjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by attention over its passages."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of 10 words of the benchmark."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_token_ids": op2_token_ids,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_chat_format": op5_chat_format,
    "op6_ngram_join": op6_ngram_join,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_topk": op10_topk,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h) AS n, sha256(h) AS digest FROM p
), g AS (
  SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest HAVING count(*) > 1
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN g ON d.digest = g.digest
""",
    "op3_line_dedup": """
WITH l AS (
  SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, i, s[i] || chr(10) || s[i + 1] || chr(10) || s[i + 2] AS g
  FROM (SELECT doc_id, s, unnest(range(1, len(s) - 1)) AS i FROM l WHERE len(s) >= 3)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS rn FROM w) WHERE rn > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM later
), n AS (
  SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id
), kept AS (
  SELECT x.doc_id AS doc_id, string_agg(line, chr(10) ORDER BY x.i) AS text
  FROM (SELECT doc_id, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS i FROM l) x
  ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i
  GROUP BY x.doc_id
)
SELECT d.doc_id AS doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, lang, source, n_chars,
  CAST(coalesce(len(l.s), 0) AS BIGINT) AS n_lines, CAST(coalesce(n.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
""",
    "op5_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), c AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ord
  FROM rows WHERE conv_id IS NOT NULL
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY ord) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""",
    "op6_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\t\n\x0B\x0C\r ]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * c >= 4 * (nx.n + ny.n - c)
), reach AS (
  SELECT x, y FROM l UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x
), lowest AS (
  SELECT x, min(y) AS y FROM reach GROUP BY x
), links AS (
  SELECT x, count(*) AS n FROM l GROUP BY x
)
SELECT d.doc_id AS doc_id, least(d.doc_id, coalesce(lowest.y, d.doc_id)) AS class_id, CAST(coalesce(links.n, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN lowest ON lowest.x = d.doc_id LEFT JOIN links ON links.x = d.doc_id
""",
    "op8_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), ms AS (
  SELECT DISTINCT m FROM bw
), dw AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)
), h AS (
  SELECT doc_id, item_id, i, dw.m AS m FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g
), hw AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id
), hi AS (
  SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS l FROM h GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
""",
    "op9_suffix_dedup": """
WITH b AS (
  SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents
), w AS (
  SELECT doc_id, i, t[i : i + 99] AS g
  FROM (SELECT doc_id, t, unnest(range(1, octet_length(t) - 98)) AS i FROM b WHERE octet_length(t) >= 100)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS rn FROM w) WHERE rn > 1
), marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM later
), runs AS (
  SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi
  FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run
), cuts AS (
  SELECT doc_id, lo, hi FROM runs UNION ALL SELECT doc_id, octet_length(t) + 1, NULL FROM b
), gaps AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS x, lo AS y FROM cuts
), kept AS (
  SELECT b.doc_id AS doc_id, string_agg(CASE WHEN y > x THEN hex(t[x : y - 1]) ELSE '' END, '' ORDER BY x) AS k
  FROM b JOIN gaps ON b.doc_id = gaps.doc_id GROUP BY b.doc_id
), n AS (
  SELECT doc_id, sum(hi - lo) AS n, count(*) AS s FROM runs GROUP BY doc_id
)
SELECT b.doc_id AS doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s, 0) AS BIGINT) AS n_spans,
  sha256(from_hex(k)) AS kept_sha256
FROM b JOIN kept ON b.doc_id = kept.doc_id LEFT JOIN n ON b.doc_id = n.doc_id
""",
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""",
}
