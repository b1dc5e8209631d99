"""WARC archives: one gzip member per record, read back sequentially with every digest verified."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm._shared import join_by_key
from quayside.workspace import new_path, written

MIN_SHARED_BYTES = 100
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 64 << 10
MAX_HEADER_BYTES = 1 << 20
DATE = "2020-01-01T00:00:00Z"
HTTP_END = b"\r\n\r\n"
# Names and texts of the WARC format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, records bigint, bytes bigint"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. The block is an HTTP response; a revisit's has no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + HTTP_END
    if not revisit:
        block += payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).digest())}"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        head += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text + block + HTTP_END) + packer.flush()


class Members:
    """The gzip members of a stream, inflated piece by piece: at most READ_BYTES more than asked for are held."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.raw, self.held = stream, b"", b""
        self.inflate: zlib._Decompress | None = None

    def next_member(self) -> bool:
        """Go on to the next member; False at the end of the stream."""
        if self.inflate is not None:
            if self.held or self.read(1):
                raise ValueError("a record is longer than its content length says")
            self.raw = self.inflate.unused_data
        self.raw = self.raw or self.stream.read(READ_BYTES)
        self.inflate, self.held = zlib.decompressobj(31), b""
        return bool(self.raw)

    def _more(self) -> bool:
        while not self.inflate.eof:
            piece = self.inflate.decompress(self.inflate.unconsumed_tail or self.raw, READ_BYTES)
            self.raw = b""
            if not piece and not self.inflate.unconsumed_tail and not self.inflate.eof:
                self.raw = self.stream.read(READ_BYTES)
                if not self.raw:
                    raise ValueError("the archive ends inside a record")
            if piece:
                self.held += piece
                return True
        return False

    def until(self, end: bytes) -> bytes:
        while (at := self.held.find(end)) < 0:
            if len(self.held) > MAX_HEADER_BYTES or not self._more():
                raise ValueError("a header without an end")
        out, self.held = self.held[:at], self.held[at + len(end) :]
        return out

    def read(self, most: int) -> bytes:
        """Up to `most` bytes, none at the end of the member."""
        if not self.held:
            self._more()
        out, self.held = self.held[:most], self.held[most:]
        return out


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode().split("\r\n")[1:])}


def read_records(stream: BinaryIO, keep_payload: bool = False) -> Iterator[dict]:
    """The records of an archive in order; each digest and length is verified, or ValueError is raised."""
    members = Members(stream)
    while members.next_member():
        raw = members.until(HTTP_END)
        if not raw.startswith(VERSION + b"\r\n"):
            raise ValueError("no WARC record")
        head = _headers(raw)
        left = int(head["content-length"])
        block, payload, kept = hashlib.sha1(), hashlib.sha256(), []
        http = members.until(HTTP_END)
        left -= len(http) + len(HTTP_END)
        block.update(http + HTTP_END)
        stated, size = int(_headers(http)["content-length"]), 0
        while left > 0:
            piece = members.read(left)
            if not piece:
                raise ValueError("a record is shorter than its content length says")
            block.update(piece)
            payload.update(piece)
            size, left = size + len(piece), left - len(piece)
            if keep_payload:
                kept.append(piece)
        trailer = b""
        while len(trailer) < len(HTTP_END) and (piece := members.read(len(HTTP_END) - len(trailer))):
            trailer += piece
        if left or trailer != HTTP_END:
            raise ValueError("a record does not end where its content length says")
        if head["warc-block-digest"] != "sha1:" + _base32(block.digest()):
            raise ValueError("wrong block digest")
        digest = head["warc-payload-digest"].removeprefix("sha256:")
        revisit = head["warc-type"] == "revisit"
        if not revisit and (digest != payload.hexdigest() or size != stated) or revisit and size:
            raise ValueError("wrong payload digest or length")
        record = {
            "page_id": _page(head["warc-record-id"]),
            "url": head.get("warc-target-uri"),
            "payload_bytes": stated,
            "payload_digest": digest,
            "record_type": head["warc-type"],
            "refers_to": _page(head.get("warc-refers-to")),
        }
        yield record | {"payload": b"".join(kept)} if keep_payload else record


def write_archives(pages: DataFrame, folder: str | None = None, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of `pages(page_id, url, html, ...)`; the manifest: `archive, records, bytes`.

    Archives go to `folder`, by default a new one in the shared folder, which every executor has to
    reach. A task starts a new archive after `archive_bytes`; it writes under a name of its own
    and the manifest, a written table, names only archives of tasks that ended, so a task that is
    run again does no harm. Of rows with equal payloads of MIN_SHARED_BYTES and more, those with
    the smallest page_id are responses and the others revisits of it. Digests are grouped with
    partial aggregation and handed back by `join_by_key`, so thousands of equal pages are no hot key.

    A null html is an empty payload. A group of equal payloads without any page_id has no one to
    refer to: all its rows are responses. Repeated rows with the smallest page_id are all
    responses. A null url is left out; line breaks in a url are percent-encoded. Other columns are ignored.
    """
    spark = pages.sparkSession
    root = folder or new_path(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("_html"), F.sha2(html, 256).alias("_digest"))
    firsts = written(
        rows.where(F.octet_length("_html") >= MIN_SHARED_BYTES)
        .groupBy("_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 and _first is not null"),
        "first_pages",
    )
    marked = join_by_key(rows, firsts, "_digest", "_n", F.col("page_id")).select("page_id", "url", "_html", "_digest", "_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(root)
        store.create_dir(top, recursive=True)
        out, name, n, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{root}/{name}"], "records": [n], "bytes": [size]})

        for batch in batches:
            for row in batch.to_pylist():
                first = row["_first"]
                revisit = first is not None and row["page_id"] != first
                data = record_bytes(row["page_id"], row["url"], row["_html"].encode(), row["_digest"], first, revisit)
                if out is not None and size + len(data) > archive_bytes:
                    yield closed()
                    out = None
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            yield closed()

    return written(marked.mapInArrow(run, MANIFEST), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of all archives: `page_id, url, payload_bytes, payload_digest, record_type, refers_to`.

    An archive is read by one task, in pieces of READ_BYTES; of a revisit the length and the digest
    are those of the payload that it stands for. An archive that lacks a record that the
    manifest counts raises an error.
    """
    archives = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split(" ")[0] for part in RECORD.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                store, path = pafs.FileSystem.from_uri(row["archive"])
                with store.open_input_stream(path, compression=None) as stream:
                    records = list(read_records(stream))
                if len(records) != row["records"]:
                    raise ValueError(f"{row['archive']} has {len(records)} records, not {row['records']}")
                types = [pa.string() if n in ("url", "payload_digest", "record_type") else pa.int64() for n in names]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], t) for n, t in zip(names, types)], names=names)

    return manifest.repartition(max(1, archives), F.xxhash64("archive")).mapInArrow(run, RECORD)
