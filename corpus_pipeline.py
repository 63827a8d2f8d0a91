"""The corpus pipeline: five stages over the documents table, each written and read again.

A stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.  All
but the last return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanweave.llm import decontaminate, lines, packing, quality, simjoin, storage
from hanweave.llm.queries import table, tokenizer_file


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null, empty and very long texts are scored like others (a blank one by its shape); equal
    texts share their fate, whatever their ids; ties (a score of exactly 0.5) stay.  Other
    columns pass through whatever their names.  An empty table gives an empty one.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    name = storage.free_name(docs, "score")
    return quality.score(docs, model, name).filter(F.col(name) >= 0.5).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later three-line windows; n_chars follows the text.

    A null text stays null, an empty one empty, and a document that loses all lines stays
    with an empty text.  Of equal rows the first in the table stays whole; null ids come
    first.  Very long texts cost work in proportion to their lines.  Columns that documents
    may have beyond its own pass through.  An empty table gives an empty one.
    """
    n_lines, n_removed = (storage.free_name(docs, n) for n in ("n_lines", "n_removed"))
    kept = lines.dedup_lines(docs, n_lines=n_lines, n_removed=n_removed)
    n_chars = F.when(F.col(n_removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates.

    It is the row with the smallest id, of equal or null ids the first in the table.  Null,
    empty and blank texts are duplicates of nothing and all stay.  Very long texts are
    compared whole.  Other columns pass through.  An empty table gives an empty one.
    """
    return simjoin.keep_one(docs).select(*docs.columns)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word inside a window of the benchmark.

    Rows are judged one by one, equal or null ids or not, and on their whole texts, however
    long; null and empty texts have no words and stay.  Other columns pass through.  An
    empty table gives an empty one, an empty benchmark leaves all.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, a row a piece.

    A null or empty text is one piece of its end id; very long ones are cut into as many
    pieces as they need; every row is a document of its own, equal or null ids or not.  Ties
    of length go by id.  Other columns of documents are left out.  An empty table gives none.
    """
    rows = packing.pieces(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=2048)
    return packing.pack(rows, capacity=2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard),
    ("benchmark_decontamination", benchmark_filter),
    ("best_fit_packing", pack_sequences),
]

#: The classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    What a stage has read goes as soon as its result is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with storage.scope(spark) as made:
            docs = storage.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.keep(docs)
        if before is not None:
            storage.drop(before)
        before = docs
    packed = STAGES[-1][1](spark, docs, sf_dir)
    storage.drop(docs)  # the last stage has its own tables of pieces
    return packed
