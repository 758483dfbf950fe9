"""A dictionary-compressed WARC writer and its reader.

Each archive starts with a skippable frame that holds a Zstandard dictionary, built from the
archive's own records; each record is a frame of its own. Archives are written by Spark's text
sink, so they go wherever Spark can write: a row is a frame, and the line separator is an empty
skippable frame, which decoders pass over.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.arrow import freed
from wayfold.storage import new_path

# Magic numbers of a dictionary frame, of other skippable frames and of a data frame.
DICT_MAGIC = 0x184D2A5D
SKIP_MAGIC = 0x184D2A50
FRAME = b"\x28\xb5\x2f\xfd"

SEPARATOR = struct.pack("<II", SKIP_MAGIC, 0).decode("ascii")
LEAST_REVISIT = 1000
ARCHIVE_BYTES = 32 << 20
TRAIN_BYTES = 4 << 20
DICT_BYTES = 64 << 10
SALTS = 16
STEP = 16 << 10
DATE = "1970-01-01T00:00:00Z"


def decided(pages: DataFrame, page_id: str, url: str, html: str, archives: int, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to names the response of a revisit, null for a response.

    Of equal payloads of at least ``least`` bytes the row with the greatest id is the response (rows that share that id
    too); among null ids alone, all are. Pages are dealt by digest and salt into one partition for each archive, so
    copies of one page spread over archives, and the one shuffle of payloads serves the join and the writer.
    """
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.length("payload") >= least)
    again = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = again.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).repartition(archives, "digest", "_salt")
    rows = rows.join(again.hint("shuffle_hash"), ["digest", "_salt"], "left").drop("_salt")
    other = ~F.col("response").eqNullSafe(F.col("page_id")) & F.col("response").isNotNull()
    return rows.select("page_id", "url", "payload", "digest", F.when(other, F.col("response")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. Ids are urns of the page ids; the length of a revisit's payload has a field of its own."""
    urn = lambda x: f"<urn:page:{'none' if x is None else x}>"
    body = b"" if refers_to is not None else payload
    clean = "".join(c for c in (url or "") if c > " ")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records; if they are too few or too short for that, made of their own beginnings."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, records)
    except zstandard.ZstdError:
        raw = b"".join(x[:4096] for x in records[:8])[-DICT_BYTES:] or b"\0" * 8
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def dictionary_frame(d: zstandard.ZstdCompressionDict) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(d.as_bytes())) + d.as_bytes()


def write(rows: DataFrame, path: str, level: int = 6) -> None:
    """Write decided rows, one archive for each partition. A task holds its first TRAIN_BYTES of records, then streams."""
    @freed
    def frames(batches):
        held, size, squeeze = [], 0, None

        def begin():
            d = dictionary(held)
            z = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True, write_checksum=True)
            return z.compress, [dictionary_frame(d), *map(z.compress, held)]

        for batch in batches:
            out = []
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for a in range(0, batch.num_rows, 256):
                for row in zip(*(c.slice(a, 256).to_pylist() for c in columns)):
                    one = record(*row)
                    if squeeze:
                        out.append(squeeze(one))
                        continue
                    held.append(one)
                    size += len(one)
                    if size >= TRAIN_BYTES:
                        squeeze, first = begin()
                        out += first
                        held = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(begin()[1], pa.binary())], ["frame"])

    framed = rows.mapInArrow(frames, "frame binary")
    framed.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).text(path)


def archive_records(content: bytes):
    """(header lines, body) of each record of one archive, in order."""
    at, d, end = 0, None, len(content)
    view = memoryview(content)
    z = None
    while at < end:
        if content[at:at + 4] == FRAME:
            if z is None:
                z = zstandard.ZstdDecompressor(dict_data=d) if d is not None else zstandard.ZstdDecompressor()
            one, parts = z.decompressobj(), []
            while not one.eof:          # in steps: what follows the frame comes back as a copy
                if at >= end:
                    raise ValueError("cut frame")
                parts.append(one.decompress(view[at:at + STEP]))
                at = min(at + STEP, end)
            at -= len(one.unused_data)
            raw = b"".join(parts)
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            body = rest[:int(fields["Content-Length"])]
            if rest[len(body):] != b"\r\n\r\n":
                raise ValueError("record doesn't end where it says")
            yield fields, body
            continue
        magic, size = struct.unpack("<II", content[at:at + 8])
        if magic == DICT_MAGIC:
            d, z = dict_of(content[at + 8:at + 8 + size]), None
        elif magic & ~0xF != SKIP_MAGIC:
            raise ValueError("no frame here")
        at += 8 + size


def dict_of(raw: bytes) -> zstandard.ZstdCompressionDict:
    full = raw[:4] == struct.pack("<I", 0xEC30A437)
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in a folder, see ``RECORDS``; bodies of responses are held against their digests."""
    @freed
    def parse(batches):
        number = lambda x: None if x.endswith(":none>") else int(x[len("<urn:page:"):-1])
        for batch in batches:
            for i in range(batch.num_rows):
                out, size = [], 0
                for f, body in archive_records(batch.column("content")[i].as_py()):
                    kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"digest of {f['WARC-Record-ID']} differs")
                    refers = number(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None
                    out.append((number(f["WARC-Record-ID"]), f["WARC-Target-URI"], int(f["X-Payload-Length"]), digest, kind, refers, body if kind == "response" else None))
                    size += len(body)
                    if size > 8 << 20:
                        yield batch_of(out)
                        out, size = [], 0
                yield batch_of(out)

    def batch_of(rows):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, RECORDS)


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row, as read back from the archives.

    Null html is an empty payload. Null ids and repeated rows have a record each; other columns are ignored. An empty
    table gives no rows. Archives hold about ``archive_bytes`` of payload each.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, f"warc-{uuid.uuid4().hex[:8]}")
    total = pages.agg(F.sum(F.octet_length(F.col(html)))).first()[0] or 0
    write(decided(pages, page_id, url, html, max(1, -(-total // archive_bytes))), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
