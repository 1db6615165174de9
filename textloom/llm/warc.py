"""WARC archives with dictionary-compressed records.

Each archive starts with a skippable frame that holds a Zstandard dictionary built from the archive's own
records; every record follows as a frame of its own, so any record can be read with the dictionary alone.
Records whose payload equals that of another record are revisits without a body.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, text_bytes, written

SKIPPABLE = 0x184D2A5D
DICT_BYTES, LEVEL = 32 << 10, 3
#: An archive's dictionary is built from pieces of its records: at most so many, each of at most so many bytes.
TRAIN_RECORDS, TRAIN_BYTES = 256, 16 << 10
#: A new archive is begun beyond so many uncompressed bytes.
ARCHIVE_BYTES = 64 << 20
MIN_REVISIT_BYTES = 0
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_URN = "<urn:textloom:page:{}>"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit carries the payload's length and digest but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = "".join(c if c > " " else "%%%02X" % ord(c) for c in url or "")
    head = [
        "WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        "WARC-Record-ID: " + _URN.format("" if page_id is None else page_id), f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Refers-To: " + _URN.format(refers_to), f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (empty for a revisit); raises ValueError when lengths or digest don't agree."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record of the wrong length")
    if fields["WARC-Type"] == "response" and (f"sha1:{digest(payload)}" != fields["WARC-Payload-Digest"] or len(payload) != int(fields["WARC-Payload-Length"])):
        raise ValueError("payload doesn't match its digest")
    return fields, payload


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or the records' own content where there is too little to train on.

    At most TRAIN_RECORDS pieces of at most TRAIN_BYTES are read, spread over all records and over their length. The bound concerns compression only.
    """
    # Records at even steps through the whole archive, and of each a piece at a place that moves on from record to record.
    n = min(len(records), TRAIN_RECORDS)
    chosen = [records[k * len(records) // n] for k in range(n)]
    samples = [r[(at := (k * TRAIN_BYTES) % max(1, len(r) - TRAIN_BYTES + 1)) : at + TRAIN_BYTES] for k, r in enumerate(chosen)]
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 8 * DICT_BYTES:
        try:
            return zstandard.train_dictionary(DICT_BYTES, samples, k=512, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:DICT_BYTES].ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _write_archive(folder: str, name: str, records: list[bytes]) -> None:
    """Writes an archive. Its name is of one attempt of a task, so a lost or repeated task meets no file of another; only archives that the table names are read."""
    fs, base = _filesystem(folder)
    dictionary = build_dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
    content = dictionary.as_bytes()
    with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
        for r in records:
            out.write(packer.compress(r))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload binary, refers_to) -> archives in ``folder``; returns (archive, records), the committed ones.

    A null payload counts as empty, a null url or page_id is empty in the header; no rows give no archive.
    """
    spark = records.sparkSession
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop_path)
    target = _uri(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        attempt = uuid.uuid4().hex[:8]

        def close() -> pd.DataFrame:
            name = f"part-{part:06d}-{k:05d}-{attempt}.warc.zst"
            _write_archive(target, name, held)
            return pd.DataFrame({"archive": [name], "records": [len(held)]})

        for batch in batches:
            for page_id, url, payload, refers in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"], strict=True):
                r = encode_record(None if pd.isna(page_id) else int(page_id), url, payload or b"", None if pd.isna(refers) else int(refers))
                if held and size + len(r) > ARCHIVE_BYTES:
                    yield close()
                    k, held, size = k + 1, [], 0
                held.append(r)
                size += len(r)
        if held:
            yield close()

    return written(records.select("page_id", "url", "payload", "refers_to").mapInPandas(run, "archive string, records long"), "archives")


def _frames(content) -> Iterator[bytes]:
    """Records of one archive, from the skippable frame and the frames alone."""
    magic, size = struct.unpack("<II", content[:8])
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    data = bytes(content[8 : 8 + size])
    trained = data[:4] == b"\x37\xa4\x30\xec"
    dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    opener = zstandard.ZstdDecompressor(dict_data=dictionary)
    at, view = 8 + size, memoryview(content)
    while at < len(view):
        frame, parts, step = opener.decompressobj(), [], 1 << 14
        while not frame.eof:
            if at >= len(view):
                raise ValueError("archive ends inside a record")
            parts.append(frame.decompress(view[at : at + step]))
            at += min(step, len(view) - at)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def read_archives(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """(archive) names -> one row a record: RECORD's columns, url, and payload (empty for revisits). Every payload is tested against its digest."""
    target = _uri(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _filesystem(target)
        number = lambda urn: int(urn.rsplit(":", 1)[1][:-1]) if urn and urn.rsplit(":", 1)[1] != ">" else None
        for batch in batches:
            for name in batch["archive"]:
                with fs.open_input_file(f"{base}/{name}") as file:
                    content = file.read()
                rows: list[tuple] = []
                for record in _frames(content):
                    f, payload = decode_record(record)
                    rows.append((number(f["WARC-Record-ID"]), int(f["WARC-Payload-Length"]), f["WARC-Payload-Digest"][5:], f["WARC-Type"], number(f.get("WARC-Refers-To")), f["WARC-Target-URI"], payload))
                    if len(rows) == 512:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    names = archives.select("archive").repartition(max(1, min(archives.count(), 100_000)))
    return names.mapInPandas(run, f"{RECORD}, url string, payload binary")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def to_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages -> (page_id, url, payload, refers_to). Of equal payloads of at least ``min_revisit_bytes`` bytes, that with
    the largest page_id is the response; the others refer to it. A null html is an empty payload. Rows without page_id
    are responses, and no row refers to them; of rows that repeat the largest page_id each is a response."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    narrow = rows.filter("page_id is not null").select("page_id", F.octet_length("payload").alias("size"), F.sha2("payload", 256).alias("sha"))
    keyed = written(narrow.filter(F.col("size") >= min_revisit_bytes), "payloads")
    largest = keyed.groupBy("sha", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).filter("least < refers_to").drop("least")
    # A page_id that repeats with unlike payloads would find other rows' target: the payload's hash stays part of the key.
    marked = keyed.join(largest, ["sha", "size"]).filter("page_id < refers_to").select(F.col("page_id").alias("r_id"), F.col("sha").alias("r_sha"), F.col("refers_to")).distinct()
    return rows.withColumn("sha", F.sha2("payload", 256)).join(marked, (F.col("page_id") == F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left").select("page_id", "url", "payload", "refers_to")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes a record for each row of ``pages``, reads all archives again, and returns RECORD's columns for each.

    An empty table gives no archives and no rows.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    archives = write_archives(to_records(pages), folder)
    return read_archives(spark, archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
