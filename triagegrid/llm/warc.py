"""WARC archives compressed record by record with one Zstandard dictionary.

The dictionary is built from a sample of the records and stands in a skippable frame at the head of every archive, as the .warc.zst format asks; each record is a
frame of its own.  Archives are written by Spark's own committer, so that a lost executor leaves no half archive: every record's frame is followed by the
header of a one-byte skippable frame, whose byte is the line end that the text writer adds.
"""
from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.llm.tables import stash

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = 0x184D2A50
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: The dictionary's size; records that it is built from, stretches of a record and their bytes.
DICTIONARY_BYTES, SAMPLE_RECORDS, STRETCHES, STRETCH_BYTES = 65536, 800, 3, 4096
#: Parts that the pages of one payload are dealt to.
PARTS = 16
LEAST_SHARED = 100
DATE = "2000-01-01T00:00:00Z"


def repeated_payloads(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(digest, first): the smallest page_id of every payload of at least ``least`` bytes that several rows have."""
    rows = pages.select("page_id", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload")).where(F.length("payload") >= least)
    each = rows.select("page_id", F.sha2("payload", 256).alias("digest"))
    return each.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")


def with_record_types(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to names the page that a revisit repeats, else it is null.  ``repeated``: see ``repeated_payloads``."""
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    # The rows of a payload that repeats very often are dealt to parts; what names its first page is small and goes to all of them.
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)))
    parts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(PARTS)])).alias("part")
    rows = rows.join(repeated.select("digest", "first", parts), ["digest", "part"], "left")
    repeats = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "payload", "digest", F.when(repeats, F.col("first")).alias("refers_to"))


def stretches_of(record: bytes, stretches: int = STRETCHES, size: int = STRETCH_BYTES) -> list[bytes]:
    """The whole record if it is short, else its head, its end and stretches between them at even distances."""
    if len(record) <= stretches * size:
        return [record]
    room = len(record) - size
    return [record[at : at + size] for at in (room * i // max(1, stretches - 1) for i in range(stretches))]


def build_dictionary(pages: DataFrame, repeated: DataFrame, size: int = DICTIONARY_BYTES, records: int = SAMPLE_RECORDS, stretches: int = STRETCHES, stretch_bytes: int = STRETCH_BYTES) -> bytes:
    """A dictionary from stretches of the records that are archived for ``pages``; empty if there are none.

    A bounded sample: at most ``records`` records, those whose pages have the least hashes, and of each at most ``stretches`` stretches of ``stretch_bytes`` bytes, from
    its head to its end.  Records are made, and cut, on the executors.
    """
    spot = F.xxhash64("page_id", "url", "html")
    share = min(1.0, 2 * records / max(1, pages.count()))
    some = pages.where(F.pmod(spot, F.lit(1 << 30)) <= share * (1 << 30)).select("page_id", "url", "html").distinct()
    some = some.orderBy(F.pmod(spot, F.lit(1 << 30)), "page_id", "url").limit(records)

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in zip(*[batch.column(c) for c in range(5)]):
                yield pa.RecordBatch.from_arrays([pa.array(stretches_of(warc_record(*[x.as_py() for x in row]), stretches, stretch_bytes), pa.binary())], ["stretch"])

    samples = sorted(bytes(r["stretch"]) for r in with_record_types(some, repeated).mapInArrow(cut, "stretch binary").collect())
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        # Too few or too short for training: the samples themselves are the dictionary.
        return b"".join(samples)[-size:]


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def warc_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    fields = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("Page-Id", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("Refers-To-Page-Id", str(refers_to)), ("Payload-Length", str(len(payload)))]
        payload = b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, least: int = LEAST_SHARED, level: int = 3) -> None:
    """Archive every row of ``pages`` (page_id, url, html) below ``path``, one archive for each task.

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest page_id is a response and the others revisit it; rows that tie on that page_id
    are all responses.  A null html is an empty payload; a null page_id is never the one revisited while there is another; a null url is left out.  Other columns are ignored.  No rows:
    no archive.
    """
    repeated = stash(repeated_payloads(pages, least), "repeated")
    dictionary = build_dictionary(pages, repeated)

    def compress(batches: Iterator[pa.RecordBatch]):
        packer = zstandard.ZstdCompressor(level=level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        line_end = struct.pack("<II", SKIPPABLE_MAGIC, 1)
        head = [struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary + line_end]
        for batch in batches:
            frames, ready = head if batch.num_rows else [], 0
            for row in zip(*[batch.column(c) for c in range(5)]):
                frame = packer.compress(warc_record(*[x.as_py() for x in row])) + line_end
                frames.append(frame)
                head, ready = [], ready + len(frame)
                if ready > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["value"])
                    frames, ready = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["value"])

    rows = with_record_types(pages, repeated).mapInArrow(compress, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def frames(archive: bytes | memoryview) -> Iterator[tuple[int, memoryview]]:
    """(magic, bytes) of every frame; a skippable frame without its header."""
    archive = memoryview(archive)
    at = 0
    while at < len(archive):
        (magic,) = struct.unpack_from("<I", archive, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            (size,) = struct.unpack_from("<I", archive, at + 4)
            yield magic, archive[at + 8 : at + 8 + size]
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no Zstandard frame at byte {at}")
        end = at + zstandard.frame_header_size(bytes(archive[at : at + 18]))
        last = False
        while not last:
            block = int.from_bytes(archive[end : end + 3], "little")
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            end += 3 + (1 if kind == 1 else size)
        end += 4 if archive[at + 4] & 4 else 0
        yield magic, archive[at:end]
        at = end


def _parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of every record below ``path``.

    A response's length and digest are those of the payload read; a revisit has no payload, and the length and digest that it states.  Page ids are strings.
    """

    def unpack(batches: Iterator[pa.RecordBatch]):
        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        for batch in batches:
            for archive in batch.column("content"):
                reader, rows, ready = zstandard.ZstdDecompressor(), [], 0
                for magic, body in frames(archive.as_buffer()):
                    if magic == DICTIONARY_MAGIC and len(body):
                        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(body)))
                    if magic != FRAME_MAGIC:
                        continue
                    fields, payload = _parsed(reader.decompress(body))
                    response = fields["WARC-Type"] == "response"
                    size = len(payload) if response else int(fields["Payload-Length"])
                    digest = hashlib.sha256(payload).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    rows.append((fields.get("Page-Id"), fields.get("WARC-Target-URI"), fields["WARC-Type"], payload if response else None, size, digest, fields.get("Refers-To-Page-Id")))
                    ready += len(payload)
                    if ready > 1 << 22:
                        yield made(rows)
                        rows, ready = [], 0
                yield made(rows)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return found.mapInArrow(unpack, "page_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string")
