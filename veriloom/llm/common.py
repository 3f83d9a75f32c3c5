"""What the operators share: shared storage, bounded Arrow slices, and tokens as codes of distinct words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Characters that one numpy step works on at a time; a longer single text is a step of its own.
STEP_CHARS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """A fresh URI below the folder that all executors share (spark.checkpoint.dir).

    Only in local mode, where driver and executors are one process, a temporary folder is used if none is set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="veriloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    if "://" not in at and not at.startswith("file:"):
        at = "file://" + at
    return f"{at.rstrip('/')}/veriloom/{uuid.uuid4().hex}"


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI, usable on driver and executors alike."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def written(df: DataFrame, at: str) -> DataFrame:
    """df as a table in shared storage: lineage ends here, and a lost executor costs nothing that was written."""
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def files_of(uri: str) -> list[str]:
    """The data files of a written table, in order."""
    from pyarrow import fs

    at, path = filesystem(uri)
    found = at.get_file_info(fs.FileSelector(path))
    return sorted(f"{uri}/{x.base_name}" for x in found if x.type == fs.FileType.File and x.base_name.startswith("part-"))


def dropped(uri: str) -> None:
    """Delete a table in shared storage that nothing reads any more."""
    at, path = filesystem(uri)
    at.delete_dir(path)


def steps(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the text column of each holds about `size` bytes at most (or one row)."""
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(n) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Whitespace-separated words of each text: (offsets by text, code by word, distinct words). A null text has no words."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_string(texts.type) and (pc.sum(pc.binary_length(texts)).as_py() or 0) > 1 << 30:
        texts = texts.cast(pa.large_string())
    lists = pc.utf8_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return offsets - offsets[0], words.indices.to_numpy(zero_copy_only=False), words.dictionary


def cleaned(words: pa.Array) -> pa.Array:
    """Words in lower case without the signs around and in them; '' where nothing is left."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}\p{N}]+", "")


def raw(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all strings in a row, offsets by string). Null counts as empty only if its slot is."""
    kind = np.int64 if pa.types.is_large_string(words.type) or pa.types.is_large_binary(words.type) else np.int32
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = words.buffers()
    at = np.frombuffer(at, kind)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def codepoints(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words in a row, offsets by word)."""
    data, at = raw(words)
    first = (data & 0xC0) != 0x80
    lead = np.flatnonzero(first)
    head = data[lead].astype(np.uint32)
    points = head.copy()
    wide = np.flatnonzero(head >= 0xC0)
    if len(wide):
        size = 2 + (head[wide] >= 0xE0) + (head[wide] >= 0xF0)
        value = head[wide] & (0x7F >> size)
        for k in range(1, 4):
            more = np.flatnonzero(size > k)
            value[more] = (value[more] << 6) | (data[lead[wide[more]] + k] & 0x3F)
        points[wide] = value
    count = np.concatenate(([0], np.cumsum(first)))
    return points, count[at].astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process; 0 for ''."""
    points, at = raw(words)
    if not len(words):
        return np.zeros(0, np.uint64)
    place = np.arange(len(points)) - np.repeat(at[:-1], np.diff(at))
    with np.errstate(over="ignore"):
        terms = mix((points.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        out = mix(total[at[1:]] - total[at[:-1]])
    out[np.diff(at) == 0] = 0
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def array_of_lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def numbered(df: DataFrame) -> DataFrame:
    """df with columns _0, _1, ...: names that clash, even but for case, can then be told apart."""
    return df.toDF(*[f"_{k}" for k in range(len(df.columns))])


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under plain names, whatever else df holds: exact case goes first, then the first in any case."""
    have, low = df.columns, [c.lower() for c in df.columns]
    for c in columns.values():
        if c.lower() not in low:
            raise ValueError(f"no column {c!r} in {have}")
    place = {k: have.index(c) if c in have else low.index(c.lower()) for k, c in columns.items()}
    plain = numbered(df)
    return plain.select(*[plain[f"_{p}"].alias(k) for k, p in place.items()])


def filtered(docs: DataFrame, text_col: str, decide) -> DataFrame:
    """The rows of docs whose text `decide` (texts -> booleans) keeps, with all columns, without a shuffle."""
    place = docs.columns.index(text_col)

    def run(batches):
        for b in steps(batches, place):
            yield b.filter(pa.array(np.asarray(decide(b.column(place).cast(pa.string())), bool)))

    plain = numbered(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def worded(texts: pa.Array) -> np.ndarray:
    """Whether each text has anything but white space."""
    return pc.fill_null(pc.not_equal(pc.utf8_trim_whitespace(texts), ""), False).to_numpy(zero_copy_only=False)
