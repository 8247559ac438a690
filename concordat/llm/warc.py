"""WARC records in seekable Zstandard bundles.

A bundle is a row of concatenated Zstandard frames: each frame holds a run of whole WARC records, compressed on its own,
and a last, skippable frame is the seek table (the public Zstandard seekable format: compressed and decompressed size
of every frame, then the number of frames, a descriptor and a magic number). Any Zstandard tool reads a bundle from its
start; a reader of one record needs the footer and one frame. An index maps each record to bundle, frame and the
offset in the decompressed frame.

Bundles are cells of a Parquet table in the shared folder, so that they lie in any store that Spark can write, commit
with the job, and are neither lost nor doubled when executors die. write_files() puts them out as .warc.zst files.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.exact import exact_duplicates
from concordat.llm.stage import materialise, small_batches
from concordat.llm.text import buffers

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 23
LEVEL = 3
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: Fixed value: the date of records, as pages carry none.
WARC_DATE = "1970-01-01T00:00:00Z"

BUNDLE_SCHEMA = "bundle_id long, bundle binary, page_ids array<long>, frames array<int>, offsets array<int>, lengths array<int>"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the digest and the length of its payload, but not the payload."""
    body = payload if kind == "response" else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {''.join(c for c in url or 'about:blank' if c > ' ')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        lines[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of the record that data is."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


class Bundle:
    """Gathers records into frames and frames into a bundle."""

    def __init__(self, frame_bytes: int, level: int):
        import zstandard

        self._codec, self._frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self._frames, self._sizes, self._open, self._held = [], [], [], 0
        self.index: list[tuple] = []
        self.raw = 0

    def add(self, page_id: int | None, data: bytes) -> None:
        if self._held and self._held + len(data) > self._frame_bytes:
            self._flush()
        self.index.append((page_id, len(self._frames), self._held, len(data)))
        self._open.append(data)
        self._held += len(data)
        self.raw += len(data)

    def _flush(self) -> None:
        if self._open:
            self._frames.append(self._codec.compress(b"".join(self._open)))
            self._sizes.append((len(self._frames[-1]), self._held))
            self._open, self._held = [], 0

    def close(self) -> bytes:
        self._flush()
        table = b"".join(struct.pack("<II", *x) for x in self._sizes) + struct.pack("<IBI", len(self._sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self._frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, read from the footer."""
    frames, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    at, out = 0, []
    for a, b in struct.iter_unpack("<II", bundle[-9 - 8 * frames : -9]):
        out.append((at, a, b))
        at += a
    return out


def read_frame(bundle: bytes, frame: tuple[int, int, int]) -> bytes:
    import zstandard

    at, size, full = frame
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + size], max_output_size=full)


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write one record a row of pages; the table of bundles (BUNDLE_SCHEMA), read back from the shared folder.

    Of records with equal payloads, empty ones too, the one with the largest id is the response and the others are
    revisits of it; of rows equal in payload and id one is the response. A null html is an empty payload, a null id is
    smaller than any other and stays null, a null or missing url is about:blank; other columns are not read. Only
    pages whose payload may be repeated are shuffled. A bundle is closed at bundle_bytes, so a task holds one bundle
    and one batch of pages; a longer page is a frame of its own. An empty table gives an empty table.
    """
    small_batches(pages.sparkSession)
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), F.col(html_col).cast("string").alias("html"))
    judged = exact_duplicates(rows, "id", "html", fold=False).select("id", "url", "html", "_keep_id", "_kept")

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = Bundle(frame_bytes, level)

        def closed() -> pa.RecordBatch:
            ids, frames, offsets, lengths = (list(x) for x in zip(*open_.index))
            number = int.from_bytes(hashlib.sha1(repr(open_.index).encode()).digest()[:8], "little", signed=True)
            values = [[number], [open_.close()], [ids], [frames], [offsets], [lengths]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], ["bundle_id", "bundle", "page_ids", "frames", "offsets", "lengths"])

        whole = pa.list_(pa.int32())
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), whole, whole, whole]
        for batch in batches:
            raw, off = buffers(batch.column(2))
            data, off = raw.tobytes(), off.tolist()
            for i, (page_id, where, keep, kept) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)))):
                payload = data[off[i] : off[i + 1]]
                open_.add(page_id, record(page_id, where, payload, base32_sha1(payload), "response" if kept else "revisit", keep))
                if open_.raw >= bundle_bytes:
                    yield closed()
                    open_ = Bundle(frame_bytes, level)
        if open_.raw:
            yield closed()

    return materialise(judged.mapInArrow(bundles, BUNDLE_SCHEMA), "warc")


def record_index(bundles: DataFrame) -> DataFrame:
    """Where each record lies: page_id, bundle_id, frame, offset in the decompressed frame, length."""
    return bundles.select("bundle_id", F.explode(F.arrays_zip("page_ids", "frames", "offsets", "lengths")).alias("r")).select(
        F.col("r.page_ids").alias("page_id"), "bundle_id", F.col("r.frames").alias("frame"), F.col("r.offsets").alias("offset"), F.col("r.lengths").alias("length")
    )


def read_records(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, found by its index entry and parsed from the archive's bytes.

    page_id, payload_bytes, payload_digest, record_type, refers_to and body; a revisit's body is empty and its payload
    columns are what its headers say of the payload. The digest of each response's body is checked against its header.
    """

    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                bundle = batch.column(0)[i].as_py()
                table, current, frame = seek_table(bundle), -1, b""
                out: list[list] = [[] for _ in kinds]
                for at, offset, length in zip(*(batch.column(k)[i].as_py() for k in (1, 2, 3))):
                    if at != current:
                        current, frame = at, read_frame(bundle, table[at])
                    headers, body = parse_record(frame[offset : offset + length])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if headers["WARC-Type"] == "response" and base32_sha1(body) != digest:
                        raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
                    row = (number(headers["WARC-Record-ID"]), int(headers["X-Payload-Length"]), digest, headers["WARC-Type"], number(headers.get("WARC-Refers-To")), body)
                    for column, value in zip(out, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "body"])

    return bundles.select("bundle", "frames", "offsets", "lengths").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, body binary")


def write_files(bundles: DataFrame, folder: str) -> DataFrame:
    """Put each bundle into folder, which all executors must share, as <bundle_id>.warc.zst; the names and sizes.

    A file is written beside its name and renamed, so a task that runs twice leaves one whole file.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names, sizes = [], []
            for number, bundle in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                name = f"{number & (1 << 64) - 1:016x}.warc.zst"
                part = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(bundle)
                os.replace(part, os.path.join(folder, name))
                names.append(name)
                sizes.append(len(bundle))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], ["file", "bytes"])

    return bundles.select("bundle_id", "bundle").mapInArrow(put, "file string, bytes long")
