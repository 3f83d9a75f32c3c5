"""Exact top-k by bit-sliced indexes: queries are rows of the table, scored by their inner products with all other rows.

The index holds blocks of rows. In each block every attribute (dimension) is quantised, and kept as bit slices: one bitmap
over the block's rows for each bit. Slices are made once a block and written; the tasks of the search, each with a group of
queries and a strip of blocks, only read them. A query's score bits are the sum of its attributes' slices, shifted by the bits of the
query's quantised weights, added by carry-save bitmap arithmetic. Going down from the most significant slice gives the
rows of the highest quantised scores; the bound of what quantising can hide says which rows below may still belong, and
those are scored exactly in double precision.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, filesystem, only, shared_dir, written

TOP, BITS, WEIGHT_BITS = 10, 7, 5
#: Rows of an index block; a task searches a strip of so many blocks for so many queries.
BLOCK, STRIP, QUERIES = 32_768, 8, 64
#: The queries of a search are the rows whose id is divisible by this.
EVERY = 100


def packed_bits(flags: np.ndarray) -> np.ndarray:
    """Bitmaps over the last axis, as 64-bit words."""
    n = flags.shape[-1]
    wide = np.zeros((*flags.shape[:-1], -(-n // 64) * 64), bool)
    wide[..., :n] = flags
    return np.ascontiguousarray(np.packbits(wide, axis=-1, bitorder="little")).view(np.uint64)


def rows_of(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n])


def signed_digits(weights: np.ndarray) -> list[np.ndarray]:
    """Digits -1, 0, 1 by place, least first, no two in a row of one weight."""
    left, out = weights.astype(np.int64), []
    while left.any():
        digit = np.where(left & 1, 2 - (left & 3), 0)
        left = (left - digit) >> 1
        out.append(digit)
    return out


class Block:
    """The slices of a block of rows. vectors: rows x dimensions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.n = ids, vectors.astype(np.float64), len(ids)
        low, high = (self.vectors.min(0), self.vectors.max(0)) if self.n else (np.zeros(vectors.shape[1]),) * 2
        self.low, self.step = low, max(float((high - low).max(initial=0)) / (2**BITS - 1), 1e-300)
        code = np.clip(np.rint((self.vectors - low) / self.step), 0, 2**BITS - 1).astype(np.uint8)
        # slices of each attribute and of its complement, which stands for negative weights
        both = np.stack((code, (2**BITS - 1) - code)) if self.n else np.zeros((2, *vectors.shape), np.uint8)
        self.slices = np.stack([packed_bits((both >> b & 1).astype(bool).transpose(0, 2, 1)) for b in range(BITS)], 2)
        lost = self.vectors - (low + code * self.step)
        self.lost = float(np.linalg.norm(lost, axis=1).max(initial=0))  # the most that quantising a row hides
        self.far = np.abs(self.vectors).max(0, initial=0)

    def save(self, file) -> None:
        np.savez(file, ids=self.ids, vectors=self.vectors, low=self.low, step=self.step, slices=self.slices, lost=self.lost, far=self.far)

    @classmethod
    def load(cls, file) -> Block:
        self = cls.__new__(cls)
        with np.load(file) as got:
            self.ids, self.vectors, self.low, self.slices, self.far = (got[x] for x in ("ids", "vectors", "low", "slices", "far"))
            self.step, self.lost, self.n = float(got["step"]), float(got["lost"]), len(got["ids"])
        return self

    def score_slices(self, weights: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the bits of the sum of weight * attribute plus a constant, least first.

        Weights are taken in signed digits, the fewest there are; an attribute counts by its complement where a digit is -1.
        """
        level: list[list[np.ndarray]] = [[] for _ in range(BITS + WEIGHT_BITS + len(weights).bit_length() + 2)]
        for w, digit in enumerate(signed_digits(weights)):
            dims = np.flatnonzero(digit)
            if len(dims):
                part = self.slices[(digit[dims] < 0).astype(int), dims]  # dims x bits x words
                for b in range(BITS):
                    level[w + b].append(part[:, b])
        out = []
        for k in range(len(level)):
            here = np.concatenate(level[k]) if level[k] else np.zeros((0, self.slices.shape[-1]), np.uint64)
            while len(here) > 1:
                m = len(here) // 3
                if m:
                    a, b, c = here[:m], here[m : 2 * m], here[2 * m : 3 * m]
                    x = a ^ b
                    carry = (a & b) | (c & x)
                    here = np.concatenate((x ^ c, here[3 * m :]))
                else:
                    a, b = here
                    carry, here = (a & b)[None], (a ^ b)[None]
                if k + 1 < len(level):
                    level[k + 1].append(carry)
            out.append(here[0] if len(here) else np.zeros(self.slices.shape[-1], np.uint64))
        return out

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows among which the k best of the block are for certain."""
        if self.n <= k:
            return np.arange(self.n)
        unit = max(float(np.abs(query).max()) / (2**WEIGHT_BITS - 1), 1e-300)
        weights = np.rint(query / unit).astype(np.int64)
        slices = self.score_slices(weights)
        # |exact and rounded - quantised| for any row: the weights' own error, and the error of the rows, by Cauchy-Schwarz and by sum
        weight_error = np.abs(query - weights * unit)
        rows_error = min(float(np.abs(weights).sum()) * unit * self.step / 2, float(np.linalg.norm(weights * unit)) * self.lost)
        slack = int(np.ceil(2 * (float(weight_error @ self.far) + rows_error + 1e-6) / (unit * self.step))) + 1
        everyone = packed_bits(np.ones(self.n, bool))
        threshold, taken, open_rows = 0, 0, everyone
        for b in range(len(slices) - 1, -1, -1):  # the k-th largest quantised score, bit by bit
            ones = open_rows & slices[b]
            count = int(np.bitwise_count(ones).sum())
            if taken + count >= k:
                open_rows, threshold = ones, threshold | 1 << b
            else:
                taken, open_rows = taken + count, open_rows & ~slices[b]
        least = max(0, threshold - slack)
        above, equal = np.zeros_like(everyone), everyone
        for b in range(len(slices) - 1, -1, -1):  # rows of at least `least`
            if least >> b & 1:
                equal = equal & slices[b]
            else:
                above |= equal & slices[b]
                equal = equal & ~slices[b]
        return rows_of(above | equal, self.n)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the block's k best rows whose id is not `own`; ties go to the smaller id."""
        rows = self.candidates(query, k + 1)
        rows = rows[self.ids[rows] != own]
        score = np.round((self.vectors[rows] * query).sum(1), 6) + 0.0
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def built(src: DataFrame, at: str, blocks: int) -> list[str]:
    """Files of the index over (vec_id, v), block by block; a task writes a file under a name of its own and reports it."""
    src.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).repartition(blocks, "b").write.partitionBy("b").parquet(f"{at}/rows")

    def run(batches):
        fs, path = filesystem(f"{at}/rows")
        out, to = filesystem(f"{at}/slices")
        for b in (x for batch in batches for x in batch.column(0).to_pylist()):
            if fs.get_file_info(f"{path}/b={b}").type != FileType.Directory:
                continue  # no row fell into it
            rows = pq.read_table(f"{path}/b={b}", filesystem=fs, columns=["vec_id", "v"], partitioning=None).sort_by("vec_id").combine_chunks()
            index, name = Block(rows["vec_id"].to_numpy(), rows["v"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)), f"{b}-{uuid.uuid4().hex}.npz"
            held = io.BytesIO()
            index.save(held)
            out.create_dir(to, recursive=True)
            with out.open_output_stream(f"{to}/{name}", compression=None) as f:
                f.write(held.getbuffer())
            yield pa.RecordBatch.from_arrays([pa.array([f"{at}/slices/{name}"])], ["file"])

    files = src.sparkSession.range(0, blocks, 1, blocks).mapInArrow(run, "file string").collect()  # a name for every BLOCK rows
    dropped(f"{at}/rows")
    return sorted(r["file"] for r in files)


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, block: int = BLOCK, every: int = EVERY) -> DataFrame:
    """A row for each of the k best other rows of every query: vec_id, rank, neighbor_id, score rounded to 6 digits.

    Queries are the rows whose id is divisible by `every`; each is held against all rows. Rows with a null id or vector, or
    a null, NaN or infinite element, are left out. Of rows that share an id the least vector counts. All vectors must have
    one length. Ties go to the smaller id. Fewer than k others give fewer rows; an empty table gives none. Ids are cast to
    long.
    """
    spark = vectors.sparkSession
    at = shared_dir(spark)
    src = only(vectors, vec_id=id_col, v=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    src = src.where("vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    src = written(src.groupBy("vec_id").agg(F.min("v").alias("v")), f"{at}/distinct")
    asked = F.col("vec_id") % every == 0
    counted = src.agg(F.count("*").alias("n"), F.count_if(asked).alias("asked"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if counted["n"] and counted["least"] != counted["most"]:
        raise ValueError("vectors must have one length")
    files, strip = built(src, at, max(1, -(-counted["n"] // block))), STRIP

    def search(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            firsts, every_id, flat = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            every_query = flat.flatten().to_numpy().reshape(len(every_id), -1)
            for first in np.unique(firsts).tolist():
                ids, queries = every_id[firsts == first], every_query[firsts == first]
                best: list[list] = [[] for _ in ids]
                for name in files[first : first + strip]:
                    fs, path = filesystem(name)
                    with fs.open_input_file(path) as f:
                        index = Block.load(io.BytesIO(f.read()))
                    for q in range(len(ids)):
                        best[q].append(index.top(queries[q], ids[q], k))
                out = []
                for q, parts in enumerate(best):
                    near, score = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
                    o = np.lexsort((near, -score))[:k]
                    out.append((np.full(len(o), ids[q]), near[o], score[o]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["vec_id", "neighbor_id", "score"])

    firsts = F.explode(F.sequence(F.lit(0), F.lit(max(0, len(files) - 1)), F.lit(strip))).alias("first")
    groups = max(1, -(-counted["asked"] // QUERIES))
    work = src.where(asked).select(firsts, "vec_id", "v").withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    work = work.repartitionByRange(groups * max(1, -(-len(files) // strip)), "first", "g").select("first", "vec_id", "v")
    found = work.mapInArrow(search, "vec_id long, neighbor_id long, score double")  # k rows a query and strip
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbor_id"))
    return found.select("vec_id", rank.alias("rank"), "neighbor_id", "score").where(F.col("rank") <= k)


def brute_force(ids: np.ndarray, vectors: np.ndarray, k: int = TOP, every: int = EVERY) -> list[tuple[int, int, int, float]]:
    """The same rows by scoring every pair."""
    out = []
    for q in np.flatnonzero(ids % every == 0):
        score = np.round((vectors * vectors[q]).sum(1), 6) + 0.0
        rows = np.flatnonzero(ids != ids[q])
        best = rows[np.lexsort((ids[rows], -score[rows]))[:k]]
        out += [(int(ids[q]), r + 1, int(ids[x]), float(score[x])) for r, x in enumerate(best)]
    return out


SQL = f"""
WITH s AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id,
         round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS INTEGER) AS rank FROM s
)
SELECT vec_id, rank, neighbor_id, score FROM r WHERE rank <= {TOP}
"""
