"""Text files in any charset: reading, previews, writing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hanweave.functions import charsets
from hanweave.operators.files import matches_extension


#: Schemes of Hadoop's connectors that Arrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def read_text(spark: SparkSession, path: str, charset: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """Whole files as (path, text), decoded as declared; a byte-order mark isn't looked at, but dropped."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = F.regexp_replace(charsets.decode(F.col("content"), charset), "^﻿", "")
    return reader.load(path).select("path", text.alias("text"))


def listing(spark: SparkSession, path: str, wildcards: list[str], recursive: bool = True) -> DataFrame:
    """Files below a folder that match any wildcard: path, name, length; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), "length").filter(matches_extension(F.col("name"), wildcards))


def preview(text: Column, thousands: int = 6) -> Column:
    """The first characters, without zero characters at the end."""
    return F.regexp_replace(F.substring(text, 1, thousands * 1000), "\\x00+$", "")


def encoded(text: Column, charset: str, bom: bool = False) -> Column:
    """Bytes of a text for writing; only UTF-8 gets a byte-order mark."""
    data = charsets.encode(text, charset)
    return F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), data) if bom and charsets.canonical(charset) == "UTF-8" else data


def write_files(rows: DataFrame, target: str = "target", data: str = "data") -> DataFrame:
    """Write each row's bytes to its own path (any store that Arrow knows); returns target and bytes.

    A file appears under its name only when whole, and writing it again gives the same file.
    """

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            sizes = []
            for uri, content in zip(*(c.to_pylist() for c in batch.columns)):
                scheme, mark, rest = uri.partition("://")
                system, path = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}" if mark else f"file://{uri.removeprefix('file:')}")
                system.create_dir(path.rpartition("/")[0], recursive=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content or b"")
                system.move(part, path)
                sizes.append(len(content or b""))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], names=["target", "bytes"])

    return rows.select(F.col(target).alias("target"), F.col(data).alias("data")).mapInArrow(write, "target string, bytes long")
