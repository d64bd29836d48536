"""WARC archives compressed record by record with a Zstandard dictionary.

An archive file starts with a skippable frame that holds the dictionary, as the
Zstandard profile of WARC describes, and goes on with one frame per record. Pages
with equal payloads of at least ``MIN_REVISIT`` bytes are stored once, under
their smallest page_id; the others become revisit records. Archives go to a
folder that all executors share; a list of finished files is committed by Spark,
so files of lost or repeated tasks are never read.

A null html is an empty payload, a null url leaves its header out. Rows with the
page_id of the stored response and its payload are responses too. A null page_id
is written as an empty id, and is never the one that others refer to unless all
ids of a payload are null; then all are responses. Without enough pages to build
a dictionary from, archives have no such frame.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feefloor.llm.common import bounded_sample, map_arrow, over_batches, table
from feefloor.session import cut_lineage, shared_dir

MIN_REVISIT = 100
#: Dictionary: at most so many pages, of at most so many bytes each, make so large a one.
SAMPLE_PAGES = 1000
SAMPLE_BYTES = 1 << 18
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
ARCHIVE_BYTES = 64 << 20

# Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

WRITTEN = "path string, n_records long, n_bytes long"
READ = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long")


# --- records --------------------------------------------------------------

def record(page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """One response or revisit record. A revisit keeps the response's headers only."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{_shown(page_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
        if refers_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_one_line(refers_url)}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}",
              "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _shown(page_id: int | None) -> str:
    return "" if page_id is None else str(page_id)


def _one_line(url: str) -> str:
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)


def parse(data: bytes) -> dict:
    """The fields of ``READ`` from one record's bytes, checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = fields["warc-payload-digest"].partition(":")[2], fields["warc-type"]
    size = int(_headers(http)["content-length"])
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if found != digest or len(payload) != size:
            raise ValueError(f"{fields['warc-record-id']}: payload and digest differ")
    return {"page_id": _page(fields["warc-record-id"]), "payload_bytes": size,
            "payload_digest": digest, "record_type": kind,
            "refers_to": _page(fields.get("warc-refers-to", "")), "payload": payload}


def _headers(block: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in block.decode().split("\r\n")[1:])
    return {name.lower(): value for name, value in pairs}


def _page(urn: str) -> int | None:
    number = urn.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


# --- archives ---------------------------------------------------------------

def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def train(samples: list[bytes]) -> bytes:
    """A dictionary for records like ``samples``, or b"" if they are too few."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def read_archive(stream) -> Iterator[bytes]:
    """Every record of an archive, a frame at a time."""
    head, dictionary, data = stream.read(8), None, b""
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
        dictionary = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", head)[1]))
    else:
        data = head
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data or (data := stream.read(1 << 20)):
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            data = frame.unused_data
            if frame.eof:
                break
            if not (data := stream.read(1 << 20)):
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def build_dictionary(pages: DataFrame) -> bytes:
    """Trained in one task on a bounded sample of pages, chosen by hash."""
    sample = bounded_sample(
        pages.where(F.octet_length("html").between(1, SAMPLE_BYTES))
        .select("page_id", "url", "html"), SAMPLE_PAGES, "page_id", "url")

    def learn(batches):
        records = [record(p, u, h.encode(), hashlib.sha256(h.encode()).hexdigest())
                   for b in batches for p, u, h in zip(*(b.column(c).to_pylist() for c in (
                       "page_id", "url", "html")))]
        yield pa.RecordBatch.from_arrays([pa.array([train(records)], pa.binary())], ["d"])

    made = map_arrow(sample.coalesce(1), learn, "d binary").collect()
    return bytes(made[0]["d"]) if made else b""


def with_originals(pages: DataFrame) -> DataFrame:
    """Pages with ``digest``, and for revisits the page and url they refer to."""
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                         payload.alias("html")).withColumn("digest", F.sha2("html", 256))
    shared = (pages.where(F.octet_length("html") >= MIN_REVISIT)
              .groupBy("digest").agg(
                  F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
                  .alias("first"), F.count("*").alias("n"))
              .where("n > 1").select("digest", F.col("first.page_id").alias("original"),
                                     F.col("first.url").alias("original_url")))
    again = (pages.select("page_id", "digest").join(shared, "digest")
             .where("original IS NOT NULL AND NOT page_id <=> original")
             .select(F.col("page_id").alias("p"), F.col("digest").alias("d"),
                     F.col("original").alias("refers_to"),
                     F.col("original_url").alias("refers_url")).distinct())
    return (pages.join(again, F.col("page_id").eqNullSafe(F.col("p"))
                       & (F.col("digest") == F.col("d")), "left").drop("p", "d"))


def write_archives(pages: DataFrame, folder: str, dictionary: bytes = b"") -> DataFrame:
    """Write all pages (of ``with_originals``) under ``folder``; one row per archive."""

    def write(batches):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if known:
            known.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
        out, path, records, size = None, "", 0, 0

        def finished():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [records],
                                               "n_bytes": [size]})

        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "html", "digest",
                                                 "refers_to", "refers_url"))
            for row in zip(*columns):
                page, url, html, digest, refers, refers_url = (v.as_py() for v in row)
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    out, records = system.open_output_stream(path), 0
                    size = out.write(dictionary_frame(dictionary)) if dictionary else 0
                size += out.write(packer.compress(
                    record(page, url, html.encode(), digest, refers, refers_url)))
                records += 1
                if size >= ARCHIVE_BYTES:
                    yield finished()
                    out = None
        if out is not None:
            yield finished()

    return cut_lineage(map_arrow(pages, write, WRITTEN), "warc-files")


def read_archives(spark: SparkSession, written: DataFrame, folder: str) -> DataFrame:
    """Every record of the listed archives, a task per group of files."""

    def run(batch):
        system, _ = fs.FileSystem.from_uri(folder)
        for path in batch.column("path").to_pylist():
            with system.open_input_stream(path) as stream:
                rows: list[dict] = []
                for data in read_archive(stream):
                    rows.append(parse(data))
                    rows[-1].pop("payload")
                    if len(rows) == 10_000:
                        yield _columns(rows)
                        rows = []
                yield _columns(rows)

    return over_batches(written.select("path"), run, READ)


def _columns(rows: list[dict]) -> dict[str, pa.Array]:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.int64()}
    return {name: pa.array([r[name] for r in rows], kind) for name, kind in kinds.items()}


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if folder.startswith("/"):
        folder = f"file://{folder}"
    pages = table(spark, sf_dir, "pages")
    written = write_archives(with_originals(pages), folder, build_dictionary(pages))
    return read_archives(spark, written, folder)


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> original THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> original THEN original END AS refers_to
FROM m"""
