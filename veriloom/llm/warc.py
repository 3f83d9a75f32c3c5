"""WARC files, index first: an index of every record, and coalesced byte-range reads of the records selected from it.

Files hold one gzip member for each record, so that any record can be read by its offset and length alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, only, shared_dir, steps, written

#: Ranges of a file with a gap of at most so many bytes are read as one, up to so many bytes at a time.
GAP, MOST_AT_ONCE = 64 * 1024, 8 * 1024 * 1024
LEVEL = 3
INDEX = "file string, offset long, length long, type string, record_id string, url string, date string, digest string, payload_bytes long"
RECORD = "record_id string, url string, date string, digest string, verified boolean, payload binary"
#: Marks a target URI that is percent-encoded here.
ESCAPED = "x-escaped-target-uri"
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return "sha256:" + hashlib.sha256(payload).hexdigest()


def verified(payload: bytes, label: str | None) -> bool | None:
    """Whether a payload has the digest `algorithm:value`, hexadecimal or base32; None if that can't be told."""
    name, _, value = (label or "").partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512") or not value:
        return None
    want = hashlib.new(name, payload).digest()
    return value.lower() == want.hex() or value.upper().rstrip("=") == base64.b32encode(want).decode().rstrip("=")


def escaped(x: str) -> str | None:
    """x percent-encoded, if it can't stand in a header line as it is: for line ends, or blanks at its ends; else None."""
    return quote(x, safe="") if "\r" in x or "\n" in x or x != x.strip(" \t") or not x else None


def url_of(headers: dict[str, str]) -> str | None:
    """The target URI as it was written: percent-encoding is undone only where member() marked its own."""
    url = headers.get("warc-target-uri")
    return unquote(url) if url is not None and ESCAPED in headers else url


def member(record_id: str, url: str | None, payload: bytes | None, date: str = DATE) -> bytes:
    """A gzip member with one resource record. A null payload is marked by a header of its own, apart from an empty one."""
    body = payload or b""
    lines = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        other = escaped(url)
        lines += [f"WARC-Target-URI: {url if other is None else other}", *["X-Escaped-Target-URI: 1"] * (other is not None)]
    lines += ["X-Null-Payload: 1"] * (payload is None)
    lines += [f"WARC-Payload-Digest: {digest(body)}", "Content-Type: text/html", f"Content-Length: {len(body)}"]
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n") + c.flush()


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of one record; ValueError if it is none.

    The payload of a record of an HTTP message is the message's body, as it was transferred.
    """
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers: dict[str, str] = {}
    for x in lines[1:]:
        k, _, v = x.partition(":")
        headers.setdefault(k.strip().lower(), v.strip(" \t"))
    body = rest[: int(headers["content-length"])]
    if headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        body = body.partition(b"\r\n\r\n")[2]
    return headers, body


def write(docs: DataFrame, at: str, id_col: str, url_col: str, html_col: str) -> list[str]:
    """One WARC file for each partition of docs, below `at`; returns their URIs. Null ids get the nil UUID.

    A task writes its file under a name of its own and reports it when complete, so that a repeated task leaves no
    broken file behind in the list.
    """
    src = only(docs, id=id_col, url=url_col, html=html_col)
    src = src.select(F.col("id").cast("string").alias("id"), F.col("html").cast("binary").alias("html"), F.col("url").cast("string").alias("url"))

    def run(batches):
        fs, path = filesystem(at)
        fs.create_dir(path, recursive=True)
        name, out, n = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in steps(batches):
            out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
            for i, payload, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                out.write(member(f"urn:x-row:{i}" if i is not None else "urn:uuid:00000000-0000-0000-0000-000000000000", url, payload))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{at}/{name}"]), pa.array([n])], ["file", "records"])

    return sorted(r["file"] for r in src.mapInArrow(run, "file string, records long").collect())  # one small row for each file


def members(f, size: int = 1 << 20):
    """(offset, length, record) of every gzip member of an open file."""
    at, d, parts, start = 0, zlib.decompressobj(31), [], 0
    while chunk := f.read(size):
        while chunk:
            parts.append(d.decompress(chunk))
            used = len(chunk) - len(d.unused_data)
            at += used
            chunk = d.unused_data
            if d.eof:
                yield start, at - start, b"".join(parts)
                d, parts, start = zlib.decompressobj(31), [], at
            elif not used:
                break
    if parts and any(parts):
        raise ValueError(f"the member at {start} is cut off")


def index(spark: SparkSession, files: list[str]) -> DataFrame:
    """A row for every record of the gzip WARC files: where it is, its URL and payload digest. No payload is kept.

    A file without records gives no row; a member that is no record, or is cut off, is an error.
    """

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = filesystem(uri)
                rows = []
                with fs.open_input_stream(path, compression=None) as f:
                    for offset, length, record in members(f):
                        h, payload = parse(record)
                        rows.append((uri, offset, length, h.get("warc-type"), h.get("warc-record-id", "").strip("<>"), url_of(h), h.get("warc-date"), h.get("warc-payload-digest") or digest(payload), None if "x-null-payload" in h else len(payload)))
                if rows:
                    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["file", "offset", "length", "type", "record_id", "url", "date", "digest", "payload_bytes"])

    listed = spark.createDataFrame([(x,) for x in files], "file string")
    return listed.repartition(max(1, len(files))).mapInArrow(run, INDEX)


def coalesced(ranges: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """(begin, end, places in `ranges`) of the reads that cover sorted (offset, length) ranges."""
    out: list[tuple[int, int, list[int]]] = []
    for k, (offset, length) in enumerate(ranges):
        if out and offset - out[-1][1] <= GAP and max(out[-1][1], offset + length) - out[-1][0] <= MOST_AT_ONCE:
            begin, end, own = out.pop()
            out.append((begin, max(end, offset + length), [*own, k]))
        else:
            out.append((offset, offset + length, [k]))
    return out


def fetch(selected: DataFrame) -> DataFrame:
    """The records of index rows (file, offset, length, digest), by sorted, coalesced reads of their files.

    Rows are brought together by file and place in it, not through one task for each file. verified says whether the
    payload has its digest, null if the digest is of an unknown kind. Repeated rows are read once and returned as often as they are given.
    """
    rows = selected.select("file", "offset", "length", "digest").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def run(batches):
        for b in batches:
            files, offsets, lengths, digests = (b.column(k).to_pylist() for k in range(4))
            lo = 0
            while lo < len(files):
                hi = lo
                while hi < len(files) and files[hi] == files[lo]:
                    hi += 1
                fs, path = filesystem(files[lo])
                with fs.open_input_file(path) as f:
                    for begin, end, own in coalesced(list(zip(offsets[lo:hi], lengths[lo:hi]))):
                        data = f.read_at(end - begin, begin)
                        out = []
                        for k in own:
                            o = offsets[lo + k] - begin
                            h, payload = parse(zlib.decompress(data[o : o + lengths[lo + k]], 31))
                            ok = verified(payload, digests[lo + k])
                            out.append((h.get("warc-record-id", "").strip("<>"), url_of(h), h.get("warc-date"), digests[lo + k], ok, None if "x-null-payload" in h else payload))
                        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["record_id", "url", "date", "digest", "verified", "payload"])
                lo = hi

    return rows.mapInArrow(run, RECORD)


def through_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", where: Column | None = None) -> DataFrame:
    """pages written as WARC files, indexed, selected by `where` over the index (all by default), and read back by ranges.

    page_id, url, digest, verified, html: null ids, URLs and payloads come back null, empty ones empty, rows as often as
    they were. An empty table gives none. URLs come back as they were, with any signs in them; ids are cast to long.
    """
    spark = pages.sparkSession
    at = shared_dir(spark)
    files = write(pages, f"{at}/warc", id_col, url_col, html_col)
    found = written(index(spark, files), f"{at}/index") if files else spark.createDataFrame([], INDEX)
    got = fetch(found if where is None else found.where(where))
    return got.select(F.regexp_extract("record_id", "^urn:x-row:(-?[0-9]+)$", 1).try_cast("long").alias("page_id"), "url", "digest", "verified", F.decode("payload", "UTF-8").alias("html"))


SQL = """
SELECT page_id, url, 'sha256:' || sha256(coalesce(html, '')) AS digest, true AS verified, html FROM pages
"""
