"""WARC archives compressed record by record with an embedded Zstandard dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary
trained on the archive's own records; each record follows as one frame compressed
with it, so any record can be read by itself.  A task gathers up to
``archive_bytes`` of records, trains, writes the archive, and goes on.

Payloads of at least ``min_revisit`` bytes that are equal are stored once: the record
with the smallest id is a response, the others are revisits that name it.  Equal
payloads are found by digest with a grouped minimum, so a payload shared by very many
rows costs each task one row; only digests that occur twice or more are joined back, by a
merge join at every size: whole payloads are shuffled once, and a broadcast that only
small inputs get doesn't hide it.  Spark's skew join splits a hot digest's rows.

Defined cases
-------------
* A null payload is empty.  A null URL is written as an empty header value.
* Rows with the smallest id of an equal group are responses, repeated ids too.  Rows
  whose id is null are revisits where some row with an id has the payload.
* Very long payloads: a record is held whole by the task that writes or reads it; archives
  end with the record that reaches ``archive_bytes``.  An empty payload is a response.
* Only page_id, url and html are read, so other columns can't clash.
* An empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import random
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanweave.llm import storage

MAGIC = 0x184D2A5D
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _safe(value: str) -> str:
    """A header value on one line, reversibly."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unsafe(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP headers and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_safe(url or '')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields: headers in lower case, and its HTTP head and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    if lines[0] != "WARC/1.1" or rest[int(fields["content-length"]) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    length = next(int(x.partition(":")[2]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
    return fields | {"http_length": length, "payload": payload}


def dictionary(records: list[bytes], size: int, sample_bytes: int) -> bytes:
    """A dictionary from stretches spread evenly over all records, about ``sample_bytes`` in all.

    A stretch is at most 128 KiB, and short enough that there are 8 of them wherever the
    records have 8 bytes.  Where those are too little to train on, the last ``size`` bytes
    of the samples are the dictionary.
    """
    import zstandard

    total = sum(map(len, records))
    length = max(1, min(128 << 10, total // 8))
    stretches = [(r, at) for r in records for at in range(0, len(r), length)]
    step = max(1, min(-(-total // sample_bytes), len(stretches) // 8))
    # one of every step at a random place, so that no place within records is always left out
    rng = random.Random(7)
    picks = [min(k + rng.randrange(step), len(stretches) - 1) for k in range(0, len(stretches), step)]
    samples = [r[at : at + length] for r, at in (stretches[k] for k in picks)]
    if len(samples) >= 8:
        try:
            return zstandard.train_dictionary(size, samples, level=3).as_bytes()
        except zstandard.ZstdError:
            pass  # too little to train on: the records' own bytes serve
    return b"".join(samples)[-size:].ljust(8, b"\0")


def pack(records: list[bytes], dictionary_bytes: int = 64 << 10, sample_bytes: int = 4 << 20, level: int = 3) -> tuple[bytes, list[int]]:
    """``(archive, offset of each record's frame)``."""
    import zstandard

    words = dictionary(records, dictionary_bytes, sample_bytes)
    trained = zstandard.ZstdCompressionDict(words)
    trained.precompute_compress(level)
    press = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
    out, offsets, at = [struct.pack("<II", MAGIC, len(words)), words], [], 8 + len(words)
    for r in records:
        out.append(press.compress(r))
        offsets.append(at)
        at += len(out[-1])
    return b"".join(out), offsets


def frame_size(data: memoryview) -> int:
    """Length of the Zstandard frame at the beginning of ``data``, from its block headers."""
    import zstandard

    at = zstandard.frame_header_size(bytes(data[:18]))
    checksum = zstandard.get_frame_parameters(bytes(data[:18])).has_checksum
    while True:
        word = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if (word >> 1) & 3 == 1 else word >> 3)
        if word & 1:
            return at + 4 * checksum


def unpack(data: bytes):
    """``(offset, record)`` of every record of an archive."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("the archive has no dictionary frame")
    opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    view, at = memoryview(data), 8 + size
    while at < len(data):
        n = frame_size(view[at:])
        yield at, opened.decompress(view[at : at + n])
        at += n


def _write(folder: str, archive_bytes: int):
    """Task: rows to archives; a row for each archive."""

    def run(batches):
        import pyarrow as pa

        held: list[bytes] = []
        size = 0

        def flush():
            data, _ = pack(held)
            uri = storage.write_file(folder, "part", data)
            return pa.record_batch([pa.array([uri]), pa.array([len(data)], pa.int64()), pa.array([len(held)], pa.int64())], names=["archive", "bytes", "records"])

        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "payload", "digest", "refers_to")]
            for page_id, url, payload, digest, refers_to in zip(*columns):
                held.append(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py()))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return run


def _read(batches):
    """Task: archives to a row for each record, the digest of a stored payload checked."""
    import pyarrow as pa

    def number(urn: str) -> int | None:
        value = urn[len("<urn:page:") : -1]
        return int(value) if value else None

    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows = []
            for at, data in unpack(storage.read_file(uri)):
                f = parse(data)
                digest = f["warc-payload-digest"].removeprefix("sha256:")
                if f["warc-type"] == "response" and (hashlib.sha256(f["payload"]).hexdigest() != digest or len(f["payload"]) != f["http_length"]):
                    raise ValueError(f"damaged record at {at} in {uri}")
                refers = number(f["warc-refers-to"]) if "warc-refers-to" in f else None
                rows.append((number(f["warc-record-id"]), f["http_length"], digest, f["warc-type"], refers, _unsafe(f["warc-target-uri"]), uri, at))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


def write_archives(pages: DataFrame, min_revisit: int = 100, archive_bytes: int = 16 << 20) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder.

    Returns the manifest, a row for each archive: archive, bytes, records.
    """
    spark = pages.sparkSession
    with storage.scope(spark) as made:
        folder = storage.fresh_dir(spark, "warc")
        storage.make_dir(spark, folder)
        payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
        rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
        shared = rows.filter(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        firsts = storage.materialise(shared.filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "warc-firsts")
        refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None).cast("long")).otherwise(F.col("first"))
        whole = rows.join(firsts.hint("merge"), "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
        out = storage.materialise(whole.mapInArrow(_write(folder, archive_bytes), "archive string, bytes long, records long"), "warc-manifest")
        made.keep(folder, out)
    return out


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record of the archives that the manifest lists; see SCHEMA."""
    spark = manifest.sparkSession
    spread = manifest.select("archive").repartition(max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism)))
    return spread.mapInArrow(_read, SCHEMA)
