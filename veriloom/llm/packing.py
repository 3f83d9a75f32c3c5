"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

Documents are encoded by the tasks that read them. One longer than a sequence is cut into full sequences and a rest. Every
task writes its pieces to a file in shared storage and reports how many it has of each length. Only these counts matter for
the plan, so the plan is made on the driver from a histogram of at most CAPACITY lengths, whatever the data's size: the
reduction fixes sets of up to three pieces that dominate every alternative for their largest piece, and best-fit decreasing
packs the rest. The pieces of a length are numbered file by file, which gives each its place in the plan without a shuffle;
then the pieces of a sequence come together. Full sequences never move.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spm
from .common import array_of_lists, filesystem, only, shared_dir, steps, written

#: Tokens of a sequence.
CAPACITY = 2048
PIECE = "bin_offset int, doc_id long, piece int, start long, n_tokens int, ids binary"
SEQUENCES = "bin_id long, n_tokens int, fixed boolean, doc_ids array<long>, pieces array<int>, starts array<long>, lengths array<int>, ids array<int>"


class Instance:
    """Lengths with counts, and the placements decided so far.

    A placement (length, rank, items, bin, each, offset, fixed): `items` pieces of the length, from that rank on, fill
    bins from `bin` on, `each` of them in a bin, one behind the other from `offset`.
    """

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.left = capacity, counts.astype(np.int64).copy()
        self.rank, self.bins, self.placed = np.zeros(len(counts), np.int64), 0, []

    def place(self, length: int, items: int, first: int, each: int, offset: int, fixed: bool) -> None:
        self.placed.append((length, int(self.rank[length]), items, first, each, offset, fixed))
        self.rank[length] += items
        self.left[length] -= items

    def fix(self, lengths: list[int], times: int) -> None:
        """`times` bins, each with one piece of every length listed (a length may be listed twice)."""
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            k = lengths.count(x)
            self.place(x, times * k, self.bins, k, offset, True)
            offset += k * x
        self.bins += times


def dominating(left: np.ndarray, j: int, capacity: int) -> list[int] | None:
    """A set with a piece of length j that dominates every other feasible set with one, by sets of up to three; or None.

    A set dominates another if the pieces of the other can be put into groups, each no longer than a different piece of
    the first. {j} does if nothing fits beside it; {j, k} if k is the longest that fits and no two pieces that fit are
    longer in sum than k; {j, a, b} if a is the longest that fits, b the longest that fits then, no three fit, and every
    two that fit are at most a in sum, or the shorter of them at most b.
    """
    rest = left.copy()
    rest[j] -= 1
    room = capacity - j
    here = np.flatnonzero(rest[: room + 1])
    if not len(here):
        return [j]
    longest = int(here[-1])
    low = np.repeat(here[:3], np.minimum(rest[here[:3]], 3))[:3]
    if longest == room or len(low) < 2 or low[:2].sum() > room:
        return [j, longest]
    before = np.full(room + 1, -1)
    before[here] = here
    before = np.maximum.accumulate(before)
    x = here
    y = before[np.minimum(room - x, x)]  # the longest partner that is no longer than x
    single = (y == x) & (rest[x] < 2)
    y = np.where(single, np.where(x > 0, before[np.maximum(x - 1, 0)], -1), y)
    ok = y > 0
    sums = (x + y)[ok]
    if not ok.any() or sums.max() <= longest:
        return [j, longest] if len(low) < 3 or low.sum() > room or sums.max(initial=0) == room == longest else None
    if len(low) >= 3 and low.sum() <= room:
        return None
    rest[longest] -= 1
    third = np.flatnonzero(rest[: room - longest + 1])
    if not len(third):
        return None
    b = int(third[-1])
    over = ok & (x + y > longest) & (y > b)
    return None if over.any() else [j, longest, b]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """(placements, bins) for counts[length], lengths 1 to capacity."""
    it = Instance(counts, capacity)
    changed = True
    while changed:  # a fixed set shrinks the instance, which may let others dominate
        changed = False
        for j in range(capacity, 0, -1):
            while it.left[j]:
                found = dominating(it.left, j, capacity)
                if not found:
                    break
                uses = {x: found.count(x) for x in found}
                times = min(int(it.left[x]) // k for x, k in uses.items())
                # each later copy of the set is decided alike only while the lengths present stay the same
                scarce = [x for x in uses if it.left[x] <= 3 + 2 * uses[x]]
                times = 1 if scarce else max(1, min((int(it.left[x]) - 3 - uses[x]) // k for x, k in uses.items()))
                it.fix(found, times)
                changed = True
    best_fit(it)
    return it.placed, it.bins


def best_fit(it: Instance) -> None:
    """Best-fit decreasing of what is left: each piece goes to the fullest open bin that has room."""
    open_at: dict[int, list[tuple[int, int]]] = {}  # room left: [(first bin, number of bins)]
    for length in np.flatnonzero(it.left)[::-1].tolist():
        room = length
        while it.left[length]:
            fitting = [r for r in open_at if r >= room]
            if not fitting:
                each, n = it.capacity // length, int(it.left[length])
                full = n // each
                for bins, k in ((full, each), (1 if n % each else 0, n % each)):
                    if bins:
                        it.place(length, bins * k, it.bins, k, 0, False)
                        open_at.setdefault(it.capacity - k * length, []).append((it.bins, bins))
                        it.bins += bins
                break
            room = min(fitting)
            first, bins = open_at[room].pop(0)
            if not open_at[room]:
                del open_at[room]
            each, n = room // length, int(it.left[length])
            full = min(bins, n // each)
            if full:
                it.place(length, full * each, first, each, it.capacity - room, False)
                open_at.setdefault(room - each * length, []).append((first, full))
            if full < bins:
                k = n - full * each if n < bins * each else 0
                if 0 < k < each:
                    it.place(length, k, first + full, k, it.capacity - room, False)
                    open_at.setdefault(room - k * length, []).append((first + full, 1))
                    full += 1
                if full < bins:
                    open_at.setdefault(room, []).insert(0, (first + full, bins - full))
            room = length


def cut(docs: DataFrame, at: str, model_file: str, capacity: int) -> DataFrame:
    """(part, file, counts): the pieces of docs (doc_id, text), written by every task to a file of its own below `at`.

    A file's rows are (doc_id, piece, start, n_tokens, ids); counts[n] of them have n tokens. A repeated task leaves a file
    that no row points to, never a broken one.
    """

    def run(batches):
        from pyarrow import parquet as pq
        from pyspark import TaskContext

        v, m = spm.vocabulary(model_file), spm.merges(model_file)
        kind, known = id_type(v), spm.Known()
        fs, path = filesystem(at)
        name, out, counts = f"{uuid.uuid4().hex}.parquet", None, np.zeros(capacity + 1, np.int64)
        for b in steps(batches, size=spm.STEP_BYTES):
            ids, offsets = spm.encode(b.column(1), v, m, known)
            n = np.diff(offsets)
            many = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            size = np.minimum(capacity, n[doc] - start)
            counts += np.bincount(size, minlength=capacity + 1)
            ends = np.concatenate(([0], np.cumsum(size))) * kind.itemsize  # pieces lie one behind the other
            data = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype(kind))])
            batch = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size.astype(np.int32)), data], ["doc_id", "piece", "start", "n_tokens", "ids"])
            if out is None:
                fs.create_dir(path, recursive=True)
                out = pq.ParquetWriter(f"{path}/{name}", batch.schema, filesystem=fs, compression="zstd", use_dictionary=False)
            out.write_batch(batch)
        pa.default_memory_pool().release_unused()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([f"{at}/{name}"]), pa.array([counts.tolist()], pa.list_(pa.int64()))], ["part", "file", "counts"])

    return docs.mapInArrow(run, "part int, file string, counts array<long>")


def id_type(v: spm.Vocabulary) -> np.dtype:
    return np.dtype(np.uint16 if len(v.starts) <= 1 << 16 else np.int32)


def packed(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for every sequence: its token ids, and of each piece in it, in order, document, number, start there and length.

    Lengths and starts count tokens of spm.encode: the ids of a document's pieces, by start, are the ids of its text, and
    decode to it. fixed: dominance fixed the sequence. Null and empty texts have no piece. Rows that repeat, or have a null
    id, are packed each. Very long texts are cut, none is cut short. Pieces of one length go in the order of the input.
    Ids are cast to long. An empty table gives no sequence. The model file must be at the same path on every executor.
    """
    spark = docs.sparkSession
    at = shared_dir(spark)
    src = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    files = written(cut(src, f"{at}/pieces", model_file, capacity), f"{at}/files")  # a row for every task
    counts = files.select("part", F.posexplode("counts").alias("n", "c")).where("c > 0")
    tally = counts.groupBy("n").agg(F.sum("c").alias("c")).toPandas()  # at most `capacity` rows
    table = np.zeros(capacity + 1, np.int64)
    table[tally["n"]] = tally["c"]
    slots = np.array(sorted(plan(table, capacity)[0]), np.int64).reshape(-1, 7)
    shared = spark.sparkContext.broadcast(slots)  # bounded by the capacity, not by the data
    before = F.coalesce(F.sum("c").over(Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.withColumn("base", before).groupBy("part").agg(F.collect_list("n").alias("lengths"), F.collect_list("base").alias("bases"))
    todo = bases.join(files.select("part", "file"), "part").select("part", "file", "lengths", "bases").repartitionByRange(max(1, files.count()), "part")

    def put(full: bool):
        def run(batches):
            from pyarrow import parquet as pq

            slots, far = shared.value, np.int64(1) << np.int64(44)
            keys = slots[:, 0] * far + slots[:, 1]
            for row in (r for b in batches for r in b.to_pylist()):
                rank = np.zeros(capacity + 1, np.int64)
                rank[row["lengths"]] = row["bases"]
                fs, path = filesystem(row["file"])
                with fs.open_input_file(path) as f:
                    for b in pq.ParquetFile(f).iter_batches(512):
                        n = b.column(3).to_numpy().astype(np.int64)
                        b = b.filter(pa.array((n == capacity) == full))
                        n = n[(n == capacity) == full]
                        order = np.argsort(n, kind="stable")
                        nth = np.empty(len(n), np.int64)
                        nth[order] = np.arange(len(n)) - np.searchsorted(n[order], n[order])
                        own = rank[n] + nth
                        rank += np.bincount(n, minlength=capacity + 1)
                        s = slots[np.searchsorted(keys, n * far + own, "right") - 1]
                        k = own - s[:, 1]
                        where = s[:, 5] + (k % s[:, 4]) * n
                        yield pa.RecordBatch.from_arrays([pa.array(s[:, 3] + k // s[:, 4]), pa.array(s[:, 6] > 0), pa.array(where.astype(np.int32)), *b.columns[:4], b.column(4).cast(pa.binary())], ["bin_id", "fixed", "bin_offset", "doc_id", "piece", "start", "n_tokens", "ids"])

        placed = todo.mapInArrow(run, f"bin_id long, fixed boolean, {PIECE}")
        return placed.select("bin_id", "fixed", F.struct(*(x.split()[0] for x in PIECE.split(", "))).alias("x"))

    together = put(False).groupBy("bin_id").agg(F.first("fixed").alias("fixed"), F.sort_array(F.collect_list("x")).alias("parts"))  # at most `capacity` tokens
    alone = put(True).select("bin_id", "fixed", F.array("x").alias("parts"))

    def assemble(batches):
        kind = id_type(spm.vocabulary(model_file))
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                lists = b.column(2)
                cuts = lists.offsets.to_numpy().astype(np.int64)
                cuts, x = cuts - cuts[0], lists.flatten()
                _, doc, piece, start, n, ids = x.flatten()
                tokens = np.concatenate(([0], np.cumsum(n.to_numpy())))[cuts]
                flat = np.frombuffer(b"".join(ids.to_pylist()), kind).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(tokens).astype(np.int32)), b.column(1), *(array_of_lists(y, cuts) for y in (doc, piece, start, n)), array_of_lists(pa.array(flat), tokens)], ["bin_id", "n_tokens", "fixed", "doc_ids", "pieces", "starts", "lengths", "ids"])

    return alone.unionByName(together).mapInArrow(assemble, SEQUENCES)
