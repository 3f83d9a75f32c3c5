"""Media columns: content-addressed payloads in tar shards, and metadata columns from header-only range reads.

A payload's SHA-256 is its name in a shard, and each different payload is stored once. Rows carry the digest, shard file,
offset and length. Payloads are deflated one by one, so that a read of a payload's first bytes is enough for
its header. Metadata columns are filled by such reads, in order of shard and offset; a read grows while the header goes on,
to the payload's end if need be.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, only, shared_dir, written

#: A shard holds about so many bytes of stored payloads.
SHARD_BYTES = 256 * 1024 * 1024
#: Header reads take so many stored bytes first, and as many as they have again while a header isn't complete.
HEADER = 1024
#: Whether a payload of no known kind is text is told by so many first bytes, as in the WHATWG's MIME sniffing.
SNIFFED = 1445
#: Payloads go to one of so many cells by digest; those of cells with a repeated digest are brought together.
CELLS = 1 << 24
LEVEL = 1
STORED = "digest string, file string, offset long, length long, raw_length long"
METADATA = "mime string, width int, height int, channels int, sample_rate int, language string, charset string, title string"
NAMES = [x.split()[0] for x in METADATA.split(", ")]


class Short(Exception):
    """More of the payload is needed."""


def need(data: bytes, n: int, whole: bool) -> bool:
    """Whether the n first bytes are there; Short if they may come yet."""
    if len(data) >= n:
        return True
    if whole:
        return False
    raise Short


def metadata(data: bytes, whole: bool) -> dict:
    """Columns of METADATA from a payload's first bytes; Short if more are needed. What isn't known is left out."""
    if not data:
        return {"mime": "application/x-empty"} if whole else need(data, 1, whole) or {}
    need(data, 32, whole)
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 26:
        return {"mime": "image/png", "width": int.from_bytes(data[16:20], "big"), "height": int.from_bytes(data[20:24], "big"), "channels": {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(data[25])}
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        w, h = struct.unpack("<HH", data[6:10])
        return {"mime": "image/gif", "width": w, "height": h, "channels": 1}
    if data[:2] == b"BM" and len(data) >= 30:
        w, h, _, bits = struct.unpack("<iiHH", data[18:30])
        return {"mime": "image/bmp", "width": w, "height": abs(h), "channels": max(1, bits // 8)}
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        at = 12
        while need(data, at + 8, whole):
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at : at + 4] == b"fmt ":
                if not need(data, at + 16, whole):
                    break
                channels, rate = struct.unpack("<HI", data[at + 10 : at + 16])
                return {"mime": "audio/wav", "channels": channels, "sample_rate": rate}
            at += 8 + size + size % 2
        return {"mime": "audio/wav"}
    if data[:3] == b"\xff\xd8\xff":
        at = 2
        while need(data, at + 10, whole):
            if data[at] != 0xFF:
                break
            if data[at + 1] in (*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                h, w, c = struct.unpack(">HHB", data[at + 5 : at + 10])
                return {"mime": "image/jpeg", "width": w, "height": h, "channels": c}
            at += 1 if data[at + 1] == 0xFF else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        return {"mime": "image/jpeg"}
    if is_html(data, whole):
        end = re.search(rb"</head\s*>|<body\b", data, re.I)
        if not end and not whole:
            raise Short
        text = data[: end.end() if end else len(data)].decode("utf-8", "replace")

        def first(pattern: str) -> str | None:
            m = re.search(pattern, text, re.I | re.S)
            return next((x for x in m.groups() if x is not None), None) if m else None

        title = first(r"<title[^>]*>(.*?)</title\s*>")
        return {"mime": "text/html", "language": first(r"<html\b[^>]*?\blang\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"), "charset": first(r"<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([^\s\"'/>;]+)"), "title": None if title is None else entities.unescape(title).strip()}
    need(data, SNIFFED, whole)
    start = data[:SNIFFED]
    try:
        start.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(start) - 3:
            return {"mime": "application/octet-stream"}
    return {"mime": "application/octet-stream" if b"\x00" in start else "text/plain"}


def is_html(data: bytes, whole: bool) -> bool:
    """Whether HTML begins behind white space, comments, declarations and a byte order mark; Short if that can't be told yet."""
    at = 3 if data[:3] == b"\xef\xbb\xbf" else 0
    while True:
        at = re.compile(rb"\s*").match(data, at).end()
        for opening, closing in ((b"<!--", b"-->"), (b"<?", b"?>")):
            if data.startswith(opening, at):
                end = data.find(closing, at + len(opening))
                if end < 0 and not whole:
                    raise Short
                at = len(data) if end < 0 else end + len(closing)
                break
        else:
            break
    if len(data) - at < 64 and not whole and data[at : at + 1] in (b"", b"<"):
        raise Short
    return re.compile(rb"<(?:!doctype\s+html|html|head|body)\b", re.I).match(data, at) is not None


def entry(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size, info.mode = size, 0o644
    return info.tobuf(tarfile.USTAR_FORMAT)


def store(payloads: DataFrame, at: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the different payloads of (payload: binary) to tar shards below `at`, as the table STORED.

    Payloads of cells without a repeated digest are written by the tasks that read them, without a shuffle; only the other
    cells are brought together first. A task writes shards under names of its own and reports them, so a repeated task
    leaves files that no row points to, never a broken one. Nulls are not stored.
    """
    keyed = payloads.where("payload is not null").select(F.sha2("payload", 256).alias("digest"), "payload")
    cell = F.conv(F.substring("digest", 1, 6), 16, 10).cast("int")
    shared = keyed.groupBy("digest").count().where("count > 1").select(cell.alias("cell")).distinct().toArrow()["cell"]  # CELLS at most
    bitmap = np.zeros(CELLS, bool)
    bitmap[shared.to_numpy()] = True
    marked = keyed.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def chosen(repeated: bool):
        def run(batches):
            bits = np.unpackbits(marked.value).view(bool)
            for b in batches:
                at = np.array([int(x[:6], 16) for x in b.column(0).to_pylist()], np.int64)
                yield b.filter(pa.array(bits[at] == repeated))

        return keyed.mapInArrow(run, "digest string, payload binary")

    once, many = chosen(False), chosen(True).groupBy("digest").agg(F.first("payload").alias("payload"))

    def write(batches):
        fs, path = filesystem(f"{at}/tar")
        fs.create_dir(path, recursive=True)
        out, name, offset = None, None, 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                rows = []
                for digest, data in zip(*(b.column(k).slice(lo, 256).to_pylist() for k in range(2))):
                    if out is not None and offset >= shard_bytes:
                        out.write(b"\x00" * 1024)
                        out.close()
                        out = None
                    if out is None:
                        name, offset = f"{uuid.uuid4().hex}.tar", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    size, data = len(data), zlib.compress(data, LEVEL)
                    out.write(entry(digest, len(data)))
                    out.write(data + b"\x00" * (-len(data) % 512))
                    rows.append((digest, f"{at}/tar/{name}", offset + 512, len(data), size))
                    offset += 512 + len(data) + -len(data) % 512
                types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["digest", "file", "offset", "length", "raw_length"])
        if out is not None:
            out.write(b"\x00" * 1024)
            out.close()

    return written(once.unionByName(many).mapInArrow(write, STORED), f"{at}/stored")


def header(f, offset: int, length: int) -> dict:
    """Metadata of the payload stored there, from as few of its first bytes as hold the header."""
    d, data, at = zlib.decompressobj(), bytearray(), 0
    while True:
        size = min(max(HEADER, at), length - at)
        data += d.decompress(f.read_at(size, offset + at))
        at += size
        try:
            return metadata(bytes(data), at >= length)
        except Short:
            pass


def headers(stored: DataFrame) -> DataFrame:
    """STORED's rows with the METADATA columns, by header-only reads in order of file and offset."""

    def run(batches):
        for b in batches:
            files, offsets, lengths = (b.schema.get_field_index(x) for x in ("file", "offset", "length"))
            rows, last, f = [], None, None
            for uri, offset, length in zip(*(b.column(k).to_pylist() for k in (files, offsets, lengths))):
                if uri != last:
                    if f is not None:
                        f.close()
                    fs, path = filesystem(uri)
                    f, last = fs.open_input_file(path), uri
                rows.append(header(f, offset, length))
            if f is not None:
                f.close()
            types = [pa.string(), *[pa.int32()] * 4, *[pa.string()] * 3]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r.get(n) for r in rows], t) for n, t in zip(NAMES, types))], [*b.schema.names, *NAMES])

    ordered = stored.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, f"{STORED}, {METADATA}")


def payload(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """digest, payload of rows with (digest, file, offset, length): whole payloads, checked against their digests."""

    def run(batches):
        for b in batches:
            out = []
            for digest, uri, offset, length in zip(*(b.column(k).to_pylist() for k in range(4))):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as f:
                    data = zlib.decompress(f.read_at(length, offset))
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"payload {digest} is damaged")
                out.append(data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["digest", "payload"])

    return rows.select("digest", "file", "offset", "length").mapInArrow(run, "digest string, payload binary")


def media_columns(rows: DataFrame, id_col: str = "page_id", payload_col: str = "html", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for every row: its id, where its payload is stored, and the metadata columns of the payload's header.

    Equal payloads are stored once and have one place. A null payload has nulls; an empty one is stored like any other.
    Ids may be null and may repeat; they are cast to long. An empty table gives none, and no shard. A header that never
    ends is read to the payload's end. HTML may begin behind comments of any length.
    """
    at = shared_dir(rows.sparkSession)
    src = only(rows, page_id=id_col, payload=payload_col).select(F.col("page_id").cast("long").alias("page_id"), F.col("payload").cast("binary").alias("payload"))
    found = written(headers(store(src.select("payload"), at, shard_bytes)), f"{at}/headers")
    keyed = src.select("page_id", F.sha2("payload", 256).alias("digest"))
    return keyed.join(found, "digest", "left").select("page_id", "digest", "file", "offset", "length", "raw_length", *NAMES)

