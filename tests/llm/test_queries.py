"""Registered queries against DuckDB on the smallest tables, and the pipeline's stages."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from hanweave.llm import quality, storage
from hanweave.llm.queries import ORACLE_SQL, QUERIES, table
from tests.llm.test_small import BYTE, WORD, brute_classes, brute_hits, brute_lines, check_packing, model

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are missing")


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found, wanted = QUERIES[name](spark, DIR).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    rows = lambda frame: sorted(repr([None if str(x) in ("None", "<NA>", "nan") else x.item() if hasattr(x, "item") else x for x in r]) for r in frame[columns].itertuples(index=False))
    assert rows(found) == rows(wanted)


def test_token_ids_query(spark):
    """Against the tokenizer itself, over the whole table."""
    plain, start = model(WORD), 0
    texts = sorted((r.doc_id, r.text) for r in table(spark, DIR, "documents").collect())
    got = sorted(map(tuple, QUERIES["op2_token_ids"](spark, DIR).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    want = []
    for i, t in texts:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_packing_query(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, DIR, "documents").collect()]
    check_packing(rows, QUERIES["op4_packing"](spark, DIR).collect(), 2048)


def test_quality_query(spark):
    """Every document, bounds of the score, and the accuracy on labels that it hasn't seen."""
    large = DIR.replace("0.001", "0.01")
    got = {r.doc_id: r for r in QUERIES["op7_quality"](spark, large).collect()}
    assert set(got) == {r.doc_id for r in table(spark, large, "documents").select("doc_id").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    unseen = [(got[r.doc_id].predicted, r.quality) for r in table(spark, large, "labels").collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert len(unseen) > 80 and np.mean([p == q for p, q in unseen]) > 0.95


def test_stages_on_odd_rows(spark):
    """Null ids and texts, empty and long texts, equal rows, and columns with the operators' own names."""
    names = ["score", "n_lines", "n_removed", "line_key", "row_key", "kept_key", "rid", "a", "t", "embedding"]
    docs = table(spark, DIR, "documents")
    own = [(None, None), (None, ""), (None, "null id"), (-1, "twice here"), (-1, "twice here"), (-1, "twice, otherwise"), (-2, "word " * 40_000), (-3, " \n\n \n")]
    odd = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in own], docs.schema)
    rows = docs.unionByName(odd).select("*", *[F.lit(n).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, storage.materialise(stage(spark, rows, DIR), name)
        if name == "best_fit_packing":
            assert rows.filter("doc_id IS NULL").count() == before.filter("doc_id IS NULL").count()
            assert {r.d for r in before.selectExpr("doc_id d").collect()} == {r.d for r in rows.selectExpr("doc_id d").collect()}
            break
        assert rows.columns == before.columns and all(rows.filter(f"{n} <> '{n}' OR {n} IS NULL").count() == 0 for n in names)
        if name == "quality_classifier":  # go on with all odd rows, whatever the classifier says of them
            rows = rows.filter("doc_id >= 0").unionByName(before.filter("doc_id < 0 OR doc_id IS NULL"))
    kept = sorted(str((r.doc_id, r.text)) for r in before.filter("doc_id < 0 OR doc_id IS NULL").collect())
    # one of two equal rows goes as a near duplicate; blank texts are nobody's duplicates
    assert kept == sorted(str(x) for x in [*own[:4], own[5], own[6], own[7]])


def test_pipeline(spark):
    """Each stage against brute force over what its predecessor kept."""
    docs = table(spark, DIR, "documents")
    columns = docs.columns
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = texts(docs)
        docs = storage.materialise(stage(spark, docs, DIR), name)
        if name == "best_fit_packing":
            break
        assert docs.columns == columns
        after = texts(docs)
        assert docs.count() == len(after)
        rows = sorted(before.items())
        if name == "quality_classifier":
            found = quality.classify(table(spark, DIR, "documents"), table(spark, DIR, "labels")).collect()
            assert after == {i: t for i, t in rows if i in {r.doc_id for r in found if r.predicted}}
            assert 0.7 * len(before) < len(after) < len(before)
        if name == "line_dedup":
            assert after == {i: t for i, t, _, _ in brute_lines(rows)}
        if name == "ngram_jaccard_join":
            classes = brute_classes(rows)
            assert after == {i: t for i, t in rows if classes[i] == i}
        if name == "benchmark_decontamination":
            items = [(str(r.item_id), r.text) for r in table(spark, DIR, "benchmark").collect()]
            assert after == {r[0]: before[r[0]] for r in brute_hits(rows, items) if not r[5]}
    plain = model(BYTE)
    sizes = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in before.items()}
    got, bins = {}, {}
    for r in docs.orderBy("sequence_id", "offset").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert got == sizes and max(bins.values()) <= 2048 and len(bins) <= -(-sum(sizes.values()) // 2048) + 1


def test_pipeline_run(spark):
    whole = corpus_pipeline.run(spark, DIR)
    assert whole.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and whole.count() > 100
    empty = table(spark, DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DIR).count() == 0
