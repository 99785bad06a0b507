"""WARC archives with Zstandard dictionaries in a leading skippable frame (operator 8)."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import shared_dir, with_group, written

#: Fixed values of the Zstandard-WARC format: magic numbers of the dictionary's skippable frame and of a dictionary.
SKIPPABLE_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bounds of what the dictionary is built from: pages, and bytes of one page; and its size.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 600, 1 << 16, 64 << 10
LEVEL = 3
#: An archive is closed when it has this many bytes, so that a reader's task holds a bounded file.
ARCHIVE_BYTES = 8 << 20
#: Bytes given to the decompressor at a time; what lies beyond a record's end is copied back.
FEED_BYTES = 1 << 13
#: No date of the crawl is in the table, and equal input shall give equal archives.
DATE = "1970-01-01T00:00:00Z"

MANIFEST = "archive string, bytes long, records long"
RECORD = "archive string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload string"


def payload_digest(payload: bytes) -> str:
    """Base32 of the SHA-1, in capitals."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_dictionary(pages: DataFrame, html_col: str = "html") -> bytes:
    """A dictionary from a bounded sample of the payloads (b'' where there is too little to build one)."""
    html = F.col(html_col)
    some = pages.filter(html.isNotNull() & F.octet_length(html).between(1, SAMPLE_BYTES)).select(html.alias("html"), F.xxhash64(html).alias("hash"))
    # The least hashes are found first, without the pages; equal pages have one. coalesce keeps the sorting off the driver.
    chosen = some.select("hash").distinct().orderBy("hash").limit(SAMPLE_PAGES).coalesce(1)
    rows = some.join(F.broadcast(chosen), "hash").groupBy("hash").agg(F.min("html").alias("html")).orderBy("hash").collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.html.encode("utf-8", "surrogatepass") for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    name = "null" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the block of a record; ValueError if the lengths disagree."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(fields["content-length"])
    if not found or lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    return fields, rest[:size]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of one archive. Its dictionary is the content of the leading skippable frame."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no dictionary frame")
    dictionary = bytes(data[8 : 8 + size])
    held = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        one, parts = held.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(view[at : at + FEED_BYTES]))
            at = min(at + FEED_BYTES, len(data))
        at -= len(one.unused_data)
        yield b"".join(parts)


def with_revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html and refers_to: of equal payloads of at least `least_bytes`, the largest page_id, null for that one itself.

    Payloads are compared by SHA-256. Groups are counted before any shuffle of rows and joined back without a hot key.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    narrow = rows.filter(F.octet_length("html") >= least_bytes).select("page_id", "digest")
    groups = written(narrow.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "payloads")
    joined = with_group(rows, groups, "digest", "n", F.xxhash64("page_id"))
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Write rows (page_id, url, html, refers_to) as .warc.zst archives in a shared folder; the manifest of what was written.

    Every task writes archives of its own, named by partition and attempt; only those of attempts that
    ended are in the manifest, so a lost executor's task can run again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=True).compress
        task = TaskContext.get()
        stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        parts, size, records, done = [], 0, 0, []

        def close() -> None:
            nonlocal parts, size, records
            name = f"{stem}-{len(done):04d}.warc.zst"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(dictionary_frame(dictionary))
                for p in parts:
                    out.write(p)
            done.append((name, size, records))
            parts, size, records = [], 0, 0

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (c[i].as_py() for c in columns)
                parts.append(compress(record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)))
                size += len(parts[-1])
                records += 1
                if size >= ARCHIVE_BYTES:
                    close()
        if parts:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "bytes", "records"])

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, MANIFEST)


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The records of the manifest's archives: archive, page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload.

    A response's payload is held against its digest and length. payload is null for a revisit.
    """

    def number(field: str | None) -> int | None:
        found = (field or "").removeprefix("<urn:page:").removesuffix(">")
        return int(found) if found.removeprefix("-").isdigit() else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    data = f.read()
                rows = []
                for record in read_archive(data):
                    fields, payload = parse_record(record)
                    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                    response = fields["warc-type"] == "response"
                    if response and (payload_digest(payload) != digest or len(payload) != size):
                        raise ValueError(f"payload of {fields['warc-record-id']} in {name} is not what was written")
                    rows.append((name, number(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], digest, size, number(fields.get("warc-refers-to")), payload.decode("utf-8", "surrogatepass") if response else None))
                    if len(rows) == 500:
                        yield _records(rows)
                        rows = []
                yield _records(rows)

    return manifest.select("archive").mapInArrow(read, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    names = [x.split() for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(names)], [n for n, _ in names])


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write every page to archives in the shared folder and read them back: one row per page as `read_archives` gives.

    Null html counts as empty; a null page_id comes back as null and never is the one referred to unless its
    group has no other; repeated rows are each archived; other columns are ignored; an empty table writes nothing.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    dictionary = build_dictionary(pages)
    manifest = written(write_archives(with_revisits(pages, least_bytes), folder, dictionary), "manifest")
    files = manifest.count()
    return read_archives(spark, folder, manifest.repartition(max(1, files), "archive"))
