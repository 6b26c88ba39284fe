"""WARC archives of individually compressed records with an embedded dictionary.

Writing: the response of equal payloads (at least ``MIN_REVISIT_BYTES``) is the
one with the smallest id, the others become revisit records without a payload.
A Zstandard dictionary is trained on a bounded hash sample of whole records.  Each
archive starts with the dictionary in a skippable frame, as the WARC-zstd
convention has it, and every record is a Zstandard frame of its own, so records
can be read one by one from their offsets.

Spark's own text writer puts the archives into the output folder, one file a
task, through the session's file systems and its commit protocol: a lost
executor leaves no half archive.  The line separator is an empty skippable
frame, which readers of Zstandard pass over.

Reading: archives come as binary files, records are decompressed one by one,
and every payload is checked against its digest.

Only the digests are shuffled for finding duplicates, and only those that occur
more than once come back to the rows.

Edge cases: a null html is an empty payload, a null url an empty target.
Payloads below the limit are always responses.  Rows with a null id are written
like others; they refer only to ids, and where all copies lack an id, all are
responses.  Repeated rows with one id: one of the smallest url is the response,
the others revisit it.  A payload of any length is one record.  Extra columns are
ignored, whatever their names.  An empty table writes no record.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from larder.llm.common import bound_batches, cut, scratch_dir, small_side

MIN_REVISIT_BYTES = 100
DICTIONARY_BYTES, SAMPLE_BYTES, LARGEST_SAMPLE = 65_536, 8_000_000, 262_144
DICTIONARY_MAGIC, EMPTY_MAGIC = 0x184D2A5D, 0x184D2A50
#: An empty skippable frame; all its bytes are ASCII, so it can be a line separator.
SEPARATOR = struct.pack("<II", EMPTY_MAGIC, 0).decode("ascii")
LEVEL = 3
ARCHIVE_BYTES = 32_000_000
FEED_BYTES = 16_384
DATE = "1970-01-01T00:00:00Z"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record; the payload's length is kept in a header, as revisits have none."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head.append(f"WARC-Target-URI: {target}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = b"" if revisit else payload
    head.append(f"Content-Length: {len(body)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    named = lambda key: fields[key][len("<urn:page:") : -1] if key in fields else ""
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and hashlib.sha256(body).hexdigest() != digest:
        raise ValueError(f"record {named('WARC-Record-ID')}: payload and digest differ")
    return {"page_id": named("WARC-Record-ID") or None, "url": fields["WARC-Target-URI"], "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": named("WARC-Refers-To") or None, "payload": body}


def records_of(archive: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each frame; skippable frames are passed, the first may hold the dictionary."""
    at, reader, view = 0, zstandard.ZstdDecompressor(), memoryview(archive)
    while at < len(archive):
        magic, size = struct.unpack_from("<II", archive, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if magic == DICTIONARY_MAGIC and at == 0:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size]))
            at += 8 + size
            continue
        one, parts, end = reader.decompressobj(), [], at
        while not one.eof:
            if end >= len(archive):
                raise ValueError(f"the record at {at} is cut off")
            parts.append(one.decompress(view[end : end + FEED_BYTES]))
            end = min(end + FEED_BYTES, len(archive))
        end -= len(one.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def train_dictionary(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> bytes:
    """A dictionary from whole records of distinct pages drawn by a hash of the page, at most about SAMPLE_BYTES in all; empty if there are too few.

    Records above LARGEST_SAMPLE bytes are not drawn; they are compressed like all others.
    """
    size = F.octet_length(html_col)
    rows = pages.where(size <= LARGEST_SAMPLE).select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("h")), F.lit(0))).first()[0]
    share = min(1.0, SAMPLE_BYTES / max(total, 1))
    drawn = rows.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.groupBy("h").agg(F.min(F.struct("i", "u")).alias("first")).select("h", "first.i", "first.u").orderBy(F.xxhash64("h"), "i").collect()
    samples = []
    for r in drawn:
        payload = r.h.encode("utf-8", "surrogatepass")
        samples.append(record_bytes(r.i, r.u, payload, hashlib.sha256(payload).hexdigest(), None, False))
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # samples too small or too alike
        return b""


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses)."""
    html = F.coalesce(html_col, F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("n"))
    groups = rows.where(F.col("n") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("page_id").alias("first"))
    groups = groups.where("copies > 1 and first is not null").select("digest", "first")
    rows = rows.join(small_side(cut(groups)), "digest", "left")
    link = F.coalesce("url", F.lit(""))
    twins = rows.where(F.col("page_id") == F.col("first")).groupBy("digest").agg(F.count(F.lit(1)).alias("c"), F.min(link).alias("least_url")).where("c > 1").select("digest", "least_url")
    rows = rows.join(small_side(cut(twins)), "digest", "left")
    # several rows may have the first id: one of them stays the response; equal ones are counted, not sorted
    own = F.coalesce((F.col("page_id") == F.col("first")) & F.col("least_url").isNotNull(), F.lit(False))
    plain = rows.where(~own).withColumn("turn", F.lit(1))
    equal = rows.where(own).groupBy("page_id", "url", "digest", "first", "least_url").agg(F.first("html").alias("html"), F.count(F.lit(1)).alias("times"))
    equal = equal.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).withColumn("turn", F.when(link == F.col("least_url"), F.col("turn")).otherwise(2))
    response = F.col("first").isNull() | ((F.col("page_id") == F.col("first")) & (F.col("turn") == 1))
    out = [*(F.col(c) for c in ("page_id", "url", "html", "digest")), F.when(~F.coalesce(response, F.lit(False)), F.col("first")).alias("refers_to")]
    return plain.select(*out).unionByName(equal.select(*out))


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archives: int | None = None) -> str:
    """Writes the archives into the folder ``path`` and returns it."""
    bound_batches(pages.sparkSession)
    rows = mark_revisits(pages, id_col, url_col, html_col)
    dictionary = train_dictionary(pages, id_col, url_col, html_col)
    if archives is None:
        total = pages.agg(F.coalesce(F.sum(F.octet_length(html_col)), F.lit(0))).first()[0]
        archives = max(8, -(-total // ARCHIVE_BYTES))
    rows = rows.repartition(archives, F.xxhash64("page_id", "url", "digest"))

    def compress(batches):
        packer, begun = None, False
        for batch in batches:
            if packer is None:
                packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
            out = []
            if dictionary and not begun:
                out.append(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
            begun = True
            for page_id, url, html, digest, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                payload = html.as_buffer().to_pybytes()
                out.append(packer.compress(record_bytes(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers.as_py(), refers.is_valid)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    frames = rows.mapInArrow(compress, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("lineSep", SEPARATOR).text(path)
    return path


def read_archives(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """Every record of the archives below ``path``: headers, payload, and its place (file, offset, length)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    ddl = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary, file string, offset long, length long"
    names = [x.split(" ")[0] for x in ddl.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64()]

    def unpack(batches):
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                for at, used, raw in records_of(content.as_buffer().to_pybytes()):
                    rows.append(parse_record(raw) | {"file": file.as_py(), "offset": at, "length": used})
                    size += len(raw)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip(names, types, strict=True))))
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip(names, types, strict=True))))

    found = files.mapInArrow(unpack, ddl)
    kind = id_type or T.LongType()
    return found.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = write_archives(pages, scratch_dir(spark))
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.first_id IS NULL OR g.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.first_id IS NOT NULL AND g.first_id <> p.page_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest
"""
