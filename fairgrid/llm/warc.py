"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends in a skippable frame with the seek table of the
Zstandard seekable format (compressed and decompressed size of each frame), so any frame can be read alone. An index
table maps each record to its bundle, frame and offset inside the frame. Bundles are files in a shared folder, one
for each task; they are written under a hidden name and moved to one fixed by their number, so a task run again replaces
its own file, what a lost task leaves is never read, and the archives are read back through Spark. Ids are kept
as integers of 64 bits throughout.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairgrid.llm.common import materialise, new_path

#: Fixed values of the Zstandard seekable format: skippable-frame and seek-table magic numbers.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTROL_BYTES = re.compile(r"[\x00-\x1f\x7f-\x9f]")
#: Payloads below this many bytes are always written whole.
LEAST_REVISIT = 100


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but the full payload's digest and length.

    Control characters of a url are escaped in its header; the url itself follows in JSON.
    """
    payload = row["payload"] if row["record_type"] == "response" else b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    url = CONTROL_BYTES.sub(lambda c: f"%{ord(c[0]):02X}", row["url"])
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {record_urn(row['page_id'])}",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"X-Payload-Bytes: {row['payload_bytes']}",
        f"X-Page-ID: {row['page_id']}",
    ]
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_urn(row['refers_to'])}", f"X-Refers-To-Page-ID: {row['refers_to']}"]
    if url != row["url"]:
        head.append(f"X-Target-URI-JSON: {json.dumps(row['url'])}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def record_urn(page_id: int) -> str:
    """A record id that follows from the page id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page-{page_id}')}>"


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    if "X-Target-URI-JSON" in head:
        head["WARC-Target-URI"] = json.loads(head["X-Target-URI-JSON"])
    begin = end + 4
    block = data[begin : begin + int(head["Content-Length"])]
    return head | {"payload": block[block.index(b"\r\n\r\n") + 4 :]}, begin + len(block) + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer frame: (compressed, decompressed) bytes of each frame."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(bundle: bytes | pa.Buffer) -> list[tuple[int, int]]:
    """(offset, compressed bytes) of each frame, from the bundle's end."""
    end = len(bundle)
    frames, _, magic = struct.unpack("<IBI", bundle[end - 9 :])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    table = bundle[end - 9 - 8 * frames : end - 9]
    out, at = [], 0
    for k in range(frames):
        size = struct.unpack_from("<I", table, 8 * k)[0]
        out.append((at, size))
        at += size
    return out


def plan_records(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, bundle_key``.

    Of equal payloads of LEAST_REVISIT bytes or more, the smallest page_id is the response and others revisit it.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    firsts = materialise(
        rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "warc-firsts"
    )
    total = F.lit(pages.count())
    hot = firsts.where(F.col("_n") * 1000 >= total).select("payload_digest", F.col("_first").alias("_hot"))  # 1000 rows at most
    marked = rows.join(F.broadcast(hot), "payload_digest", "left")
    rest = marked.where("_hot is null").drop("_hot").join(firsts.where(F.col("_n") * 1000 < total).select("payload_digest", "_first"), "payload_digest", "left")
    both = marked.where("_hot is not null").withColumnRenamed("_hot", "_first").unionByName(rest)
    revisit = F.coalesce(F.col("_first") < F.col("page_id"), F.lit(False))
    return both.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def write_bundles(pages: DataFrame, folder: str, bundles: int, frame_bytes: int = 1 << 20, level: int = 3) -> DataFrame:
    """Write ``pages`` as ``bundles`` files under ``folder``; the index: ``page_id, bundle, frame, frame_offset, inside, n_bytes``.

    Pages are dealt to bundles by a hash of their id and sorted in them, so a task run again writes the same bytes.
    Payloads of revisits are not sent to the writers. ``html`` null is an empty payload, a url may hold any
    characters; a null page_id is written as the text ``None``; repeated rows are records of their own; very long
    payloads are a frame each; no pages give no files; other columns are not read.
    """
    planned = plan_records(pages)
    dealt = planned.select(
        F.pmod(F.xxhash64("page_id", "payload_digest"), F.lit(bundles)).cast("int").alias("bundle"), "page_id", "url",
        F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", "record_type", "refers_to",
    )

    fields = [("page_id", pa.int64()), ("bundle", pa.int32()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("inside", pa.int64()), ("n_bytes", pa.int64())]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        bundle: Bundle | None = None
        try:
            for batch in batches:
                index = []
                for row in batch.to_pylist():
                    if bundle is None or bundle.number != row["bundle"]:
                        if bundle:
                            bundle.close()
                        bundle = Bundle(store, root, row["bundle"], frame_bytes, level)
                    index.append((row["page_id"], row["bundle"], *bundle.add(record_bytes(row))))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*index, strict=True), fields, strict=True)], names=[n for n, _ in fields])
            if bundle:
                bundle.close()
        except BaseException:
            if bundle:
                bundle.drop()
            raise

    together = dealt.repartitionById(bundles, "bundle").sortWithinPartitions("bundle", "page_id", "payload_digest", "url", "record_type")
    index = together.mapInArrow(write, "page_id long, bundle int, frame int, frame_offset long, inside long, n_bytes long")
    return materialise(index, "warc-index")


class Bundle:
    """One file being written: a buffer of records, flushed as a frame when it is full."""

    def __init__(self, store: pyarrow.fs.FileSystem, root: str, number: int, frame_bytes: int, level: int):
        self.store, self.number, self.frame_bytes = store, number, frame_bytes
        self.path, self.temporary = f"{root}/bundle-{number:06d}.warc.zst", f"{root}/.{uuid.uuid4().hex}"
        self.out, self.packer = store.open_output_stream(self.temporary), zstandard.ZstdCompressor(level=level)
        self.sizes: list[tuple[int, int]] = []
        self.buffer: list[bytes] = []
        self.held = self.at = 0

    def add(self, record: bytes) -> tuple[int, int, int, int]:
        """Frame, its offset, the record's place in it and its length."""
        if self.held + len(record) > self.frame_bytes:
            self.flush()
        place = (len(self.sizes), self.at, self.held, len(record))
        self.buffer.append(record)
        self.held += len(record)
        return place

    def flush(self) -> None:
        if self.buffer:
            packed = self.packer.compress(b"".join(self.buffer))
            self.out.write(packed)
            self.sizes.append((len(packed), self.held))
            self.at += len(packed)
            self.buffer, self.held = [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(seek_table(self.sizes))
        self.out.close()
        if self.store.get_file_info(self.path).type != pyarrow.fs.FileType.NotFound:
            self.store.delete_file(self.path)  # of an attempt before
        self.store.move(self.temporary, self.path)

    def drop(self) -> None:
        """Leave nothing behind."""
        self.out.close()
        if self.store.get_file_info(self.temporary).type != pyarrow.fs.FileType.NotFound:
            self.store.delete_file(self.temporary)


def _headers(frame: bytes, bundle: int) -> Iterator[tuple]:
    at = 0
    while at < len(frame):
        head, at = parse_record(frame, at)
        whole = head["WARC-Type"] == "response"
        if whole and (len(head["payload"]) != int(head["X-Payload-Bytes"]) or "sha256:" + hashlib.sha256(head["payload"]).hexdigest() != head["WARC-Payload-Digest"]):
            raise ValueError(f"record {head['WARC-Record-ID']} of bundle {bundle} is damaged")
        number = lambda x: None if x in (None, "None") else int(x)
        yield number(head["X-Page-ID"]), head["WARC-Target-URI"], int(head["X-Payload-Bytes"]), head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"], number(head.get("X-Refers-To-Page-ID")), head["payload"] if whole else None


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """All records: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``, frame by frame.

    Digests and lengths of whole payloads are checked on the bytes read.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = content.as_buffer()
                for at, size in read_seek_table(held):
                    rows = list(_headers(unpacker.decompress(held[at : at + size]), path))
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "bundle-*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def read_records(folder: str, entries: list[dict]) -> list[dict]:
    """A few records by their index entries: one ranged read and one frame each."""
    store, root = pyarrow.fs.FileSystem.from_uri(folder)
    out = []
    for entry in entries:
        with store.open_input_file(f"{root}/bundle-{entry['bundle']:06d}.warc.zst") as source:
            size = source.size()
            source.seek(size - 9)
            frames = struct.unpack("<IBI", source.read(9))[0]
            source.seek(size - 9 - 8 * frames)
            table = source.read(8 * frames)
            source.seek(entry["frame_offset"])
            data = zstandard.ZstdDecompressor().decompress(source.read(struct.unpack_from("<I", table, 8 * entry["frame"])[0]))
        out.append(parse_record(data, entry["inside"])[0])
    return out


#: Bytes of payload in a bundle, about.
BUNDLE_BYTES = 16 << 20


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: write all ``pages`` to bundles and read the archives back; no pages give no rows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    held = pages.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 600)).first()[0]
    if held is None:  # no pages: no archives, and the empty result has the same columns
        digest = F.lit("").alias("payload_digest")
        return pages.select("page_id", F.lit(0).cast("long").alias("payload_bytes"), digest, F.lit("").alias("record_type"), F.col("page_id").alias("refers_to"))
    folder = new_path(spark, "warc")
    write_bundles(pages, folder, bundles=1 + held // BUNDLE_BYTES)
    return read_bundles(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""
