"""WARC archives in Zstandard with a dictionary, written and read back by Spark.

An archive begins with a skippable frame that holds the dictionary; each record is a
frame of its own. Spark's text writer puts the frames in place through its own file
systems and commit protocol: a row is a run of whole frames, and its line separator is an
empty skippable frame, which decoders pass over. So an archive can lie wherever Spark
can write, and a lost task leaves no half archive.

Cases: a null page is an empty payload; rows with equal payloads of ``min_revisit``
bytes or more keep one response, that of the greatest page id, and more than one only where
rows repeat that id; rows that repeat a page id keep their own records; rows with a null
page id are written and read with null, and revisit the page with the greatest id, or, where
no page of their payload has an id, are responses; an empty table makes no records. Columns besides id, url and payload are ignored; url may
be null.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import saved, shared_dir

#: Magic numbers of the formats, little endian.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
ZSTD_FRAME = 0xFD2FB528
#: An empty skippable frame, all ASCII: the text writer's line separator.
EMPTY_FRAME = b"P*M\x18\x00\x00\x00\x00"
DICTIONARY_BYTES = 64 << 10
#: Compressed bytes of a row of the text writer, and rows of an archive: about 16 MB.
RUN_BYTES, RUNS = 1 << 20, 16
#: The record id of a row whose page id is null; other ids are percent-encoded after ``urn:page:``.
NO_PAGE = "<urn:no-page>"


class BadArchive(ValueError):
    """An archive or record that breaks its format."""


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sample records; raw content where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def skippable_frame(content: bytes, magic: int = DICTIONARY_FRAME) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def frame_end(data: bytes, start: int) -> int:
    """Where the Zstandard frame at ``start`` ends, from its header and block headers."""
    try:
        if struct.unpack_from("<I", data, start)[0] != ZSTD_FRAME:
            raise BadArchive(f"no frame at byte {start}")
        flags = data[start + 4]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        at = start + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single if not flags >> 6 else 1 << (flags >> 6))
        last = False
        while not last:
            head = int.from_bytes(data[at : at + 3], "little")
            if at + 3 > len(data):
                raise BadArchive("a block header is cut off")
            last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
            if kind == 3:
                raise BadArchive(f"reserved block at byte {at}")
            at += 3 + (1 if kind == 1 else size)
        at += 4 * checksum
    except (IndexError, struct.error) as cut:
        raise BadArchive(f"the frame at byte {start} is cut off") from cut
    if at > len(data):
        raise BadArchive(f"the frame at byte {start} is cut off")
    return at


def record_bytes(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    """One WARC 1.1 record; a revisit carries the HTTP header only, with the payload's length."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    name = lambda i: NO_PAGE if i is None else f"<urn:page:{quote(str(i), safe='')}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        *([f"WARC-Target-URI: {target}"] if target else []),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"] if revisit else []),
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[str | None, str, int, str, str | None, str | None]:
    """(page id, type, payload bytes, hex digest, refers to, url), with headers, lengths and digest validated."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise BadArchive("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise BadArchive(f"bad header line {line!r}")
        fields[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - fields.keys()
    if missing:
        raise BadArchive(f"no {sorted(missing)}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadArchive(f"the block has {len(rest) - 4} bytes, not {length}")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise BadArchive("no HTTP header")
    size = next((int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), -1)
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    name = lambda urn: None if urn == NO_PAGE else unquote(urn.removeprefix("<urn:page:").removesuffix(">"))
    if kind == "response":
        if size != len(payload):
            raise BadArchive(f"the payload has {len(payload)} bytes, not {size}")
        if hashlib.sha1(payload).hexdigest() != digest:
            raise BadArchive("the payload's digest differs")
    elif kind != "revisit" or payload or size < 0 or "warc-refers-to" not in fields:
        raise BadArchive(f"bad record of type {kind}")
    refers = fields.get("warc-refers-to")
    return name(fields["warc-record-id"]), kind, size, digest, refers and name(refers), fields.get("warc-target-uri")


def read_frames(data: bytes) -> Iterator[bytes]:
    """The decoded records of an archive, one frame each."""
    at, decoder = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise BadArchive("a frame header is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise BadArchive("a skippable frame is cut off")
            if magic == DICTIONARY_FRAME and not at:
                content = data[8 : 8 + size]
                if content[:4] == struct.pack("<I", ZSTD_FRAME):
                    content = zstandard.ZstdDecompressor().decompress(content)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            at += 8 + size
            continue
        end = frame_end(data, at)
        try:
            yield decoder.decompress(data[at:end])
        except zstandard.ZstdError as bad:
            raise BadArchive(f"the frame at byte {at} does not decode: {bad}") from bad
        at = end


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 1000, dictionary_samples: int = 200,
) -> None:
    """Write a record per row as ``.warc.zst`` text parts under ``path``.

    Payload digests find the responses by a partial aggregation of (digest, length,
    greatest id); payloads move once, to the revisits of their id and digest, in a join whose hot
    ids Spark can split. A task writes as many archives, of about RUNS * RUN_BYTES, as its rows need. The
    dictionary is trained on a bounded sample, ``dictionary_samples`` pages of at most
    100,000 characters.
    """
    spark = pages.sparkSession
    text = F.coalesce(F.col(payload_col), F.lit(""))
    digest = F.sha1(F.encode("payload", "UTF-8"))
    full = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text.alias("payload"))
    large = full.select("id", digest.alias("digest"), F.octet_length("payload").cast("long").alias("size")).where(F.col("size") >= min_revisit)
    large = saved(large)
    first = large.groupBy("digest", "size").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # a null id is less than any other; pages without any id have none that they could refer to
    revisit = large.join(saved(first), ["digest", "size"]).where(F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")))
    revisit = saved(revisit.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "response").distinct())
    samples = [r[0].encode() for r in full.select(F.substring("payload", 1, 100_000)).limit(dictionary_samples).collect()]
    dictionary = spark.sparkContext.broadcast(train_dictionary([s for s in samples if s]))
    full = full.withColumn("digest", digest)
    dealt = full.join(revisit, full["id"].eqNullSafe(revisit["_id"]) & (full["digest"] == revisit["_digest"]), "left").select("id", "url", "payload", "response")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = dictionary.value
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content) if content else None, write_checksum=True, write_content_size=True)
        pack = lambda parts: pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["frames"])
        head = skippable_frame(content) if content else b""
        parts, size, runs = [], 0, 0
        for batch in batches:
            for page_id, url, payload, response in zip(*(c.to_pylist() for c in batch.columns)):
                raw = payload.encode()
                parts.append(coder.compress(record_bytes(page_id, url, raw, hashlib.sha1(raw).hexdigest(), response)))
                size += len(parts[-1])
                if size >= RUN_BYTES:
                    # the writer begins a new archive after every RUNS rows of a task
                    yield pack([head, *parts] if runs % RUNS == 0 else parts)
                    parts, size, runs = [], 0, runs + 1
        if parts:
            yield pack([head, *parts] if runs % RUNS == 0 else parts)

    frames = dealt.mapInArrow(run, "frames binary").select(F.col("frames").cast("string"))
    frames.write.option("lineSep", EMPTY_FRAME.decode()).option("maxRecordsPerFile", RUNS).text(path)


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to of every record under ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = [parse_record(r) for r in read_frames(data.as_py())]
                page, kind, size, digest, refers, url = map(list, zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(page, pa.string()), pa.array(url, pa.string()), pa.array(kind, pa.string()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(refers, pa.string())],
                    ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"],
                )

    # an archive is a few tens of MB, and one batch holds few of them
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    parsed = files.mapInArrow(run, "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string")
    return parsed.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 1000) -> DataFrame:
    """Write all rows to archives in the shared folder and return what reading them gives."""
    spark = pages.sparkSession
    path = shared_dir(spark)
    write_archives(pages, path, id_col, url_col, payload_col, min_revisit)
    back = read_archives(spark, path, pages.schema[id_col].dataType.simpleString())
    return back.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
