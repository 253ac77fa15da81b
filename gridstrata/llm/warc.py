"""WARC archives: one gzip member per record, written and read by Spark tasks in a folder that all of them share.

write_archives() finds the first page of each payload with an aggregate on the payload's SHA-1, joins it back, and lets
each task write its rows as archives of bounded size. A file is written under an attempt's own name and then renamed, so a
task that runs twice leaves one whole archive. read_archives() streams each archive in blocks: incremental zlib
decompression, framing by Content-Length, and both digests of every record verified. No archive is held in memory whole.

Null html: the empty payload. Null url: the record's own id. Rows that repeat a page_id and a payload are all
responses where that id is the payload's smallest; a row with null id revisits the smallest non-null id, if any.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes after which a task begins another archive, that a reader takes at once, and that it decompresses at once.
ARCHIVE_BYTES, BLOCK_BYTES, PIECE_BYTES = 64 << 20, 1 << 20, 16 << 10
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    tail = (record_id or "none>")[:-1].rpartition(":")[2]
    return None if tail == "none" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own. A revisit holds the HTTP head only, as the profile asks."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", "WARC-Date: 2020-01-01T00:00:00Z"]
    lines.append(f"WARC-Target-URI: {_record_id(page_id)[1:-1] if url is None else quote(url, safe=chr(37) + ':/?#[]@!$&()*+,;=~' + chr(39))}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(source) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time, from blocks of BLOCK_BYTES, of which the decompressor gets a
    piece at a time: what it hands back after a member's end is short."""
    data, at, unpacker, parts = source.read(BLOCK_BYTES), 0, None, []
    while data:
        unpacker = unpacker or zlib.decompressobj(31)
        piece = data[at : at + PIECE_BYTES]
        parts.append(unpacker.decompress(piece))
        at += len(piece) - len(unpacker.unused_data)
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = None, []
        if at == len(data):
            data, at = source.read(BLOCK_BYTES), 0
    if unpacker is not None:
        raise EOFError("the archive ends within a record")


def parse(member: bytes) -> dict:
    """A record's columns; raises if its framing or a digest is wrong."""
    head, _, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    length = int(fields["content-length"])
    block = rest[:length]
    if not first.startswith("WARC/1.") or len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("broken record")
    if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError(f"block digest of {fields['warc-record-id']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest != sha1_base32(payload)):
        raise ValueError(f"payload digest of {fields['warc-record-id']}")
    return {
        "page_id": _page_id(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": kind, "refers_to": _page_id(fields.get("warc-refers-to")),
        "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


def with_first_page(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to: the smallest page_id of an equal payload, if that is not the row's own.

    The counts are pre-aggregated by task; only payloads that occur twice or more are joined back, and a hot payload's
    rows are split by the adaptive skew join.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("_digest", F.unhex(F.sha1("payload")))
    first = rows.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    other = F.coalesce(F.col("_first") != F.col("page_id"), F.col("_first").isNotNull())
    return rows.join(first, "_digest", "left").select("page_id", "url", "payload", F.when(other, F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives in a shared folder (a URI); returns their manifest, itself a table there."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(top)
        task, done, out, own = TaskContext.get(), [], None, ""

        def close() -> None:
            out.close()
            name = f"{top}/part-{task.partitionId():05d}-{len(done):04d}.warc.gz"
            store.move(own, name)
            done.append([name, count, size])

        for batch in batches:
            for page_id, url, payload, refers_to in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"], strict=True):
                if out is None:
                    own, count, size = f"{top}/.{uuid.uuid4().hex}", 0, 0
                    out = store.open_output_stream(own, compression=None)
                raw = record(None if pd.isna(page_id) else int(page_id), url, bytes(payload), None if pd.isna(refers_to) else int(refers_to))
                out.write(raw)
                count, size = count + 1, size + len(raw)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "n_records", "n_bytes"])

    # ids as decimal text, which unlike pandas' floats stays exact beside nulls
    rows = with_first_page(pages).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    manifest = f"{folder}/manifest"
    rows.mapInPandas(write, MANIFEST).write.parquet(manifest)
    return pages.sparkSession.read.schema(MANIFEST).parquet(manifest)


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of a manifest's archives, as RECORDS; a revisit has no payload of its own."""
    names = RECORDS if with_payload else RECORDS.rpartition(",")[0]
    columns = [x.split()[0] for x in names.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
        for batch in batches:
            for path in batch["path"]:
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for member in members(source):
                        rows.append(parse(member))
                        held += len(member)
                        if held >= 16 * BLOCK_BYTES or len(rows) >= 5000:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows)
        return out.assign(page_id=out["page_id"].astype("Int64"), refers_to=out["refers_to"].astype("Int64"))[columns]

    spark: SparkSession = manifest.sparkSession
    each = manifest.repartition(spark.sparkContext.defaultParallelism * 4, "path") if spark.sparkContext.defaultParallelism > 1 else manifest
    return each.mapInPandas(read, names)
