"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

A key goes to the first virtual node clockwise of its position whose shard is not full; a shard is full at
ceil((1 + SLACK) * keys / shards). Keys enter in order of their position on the ring. How many keys of an arc overflow
depends only on how many keys each arc has, so the overflow is worked out on the driver from one count per virtual node,
whatever the number of keys, and Spark numbers the keys within their arcs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, shared_dir, written

SHARDS, VIRTUAL_NODES, SLACK = 64, 128, 0.05
PLACED = "doc_id long, position long, home int, shard int, hops int"


def position(key: str) -> int:
    """A place on the ring: the first 52 bits of the key's MD5."""
    return int(hashlib.md5(key.encode()).hexdigest()[:13], 16)


def position_of(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("long")


def ring(shards: list[str], virtual_nodes: int = VIRTUAL_NODES) -> tuple[np.ndarray, np.ndarray]:
    """(positions, shard by position) of all virtual nodes, in clockwise order. A node depends on its shard's name alone."""
    nodes = sorted((position(f"{name}#{k}"), s) for s, name in enumerate(shards) for k in range(virtual_nodes))
    return np.array([p for p, _ in nodes], np.int64), np.array([s for _, s in nodes], np.int32)


def spread(counts: np.ndarray, owner: np.ndarray, shards: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, shard, hops): where the keys of each arc go, from that rank in the arc on.

    Arcs fill in clockwise order. hops counts the virtual nodes passed because their shard was full.
    """
    left, out = np.full(shards, capacity, np.int64), []
    open_shards = shards
    for arc in np.flatnonzero(counts).tolist():
        rest, rank, node = int(counts[arc]), 0, arc
        while rest:
            if not open_shards:
                raise ValueError("the shards cannot hold the keys")
            s = owner[node % len(owner)]
            take = min(rest, int(left[s]))
            if take:
                out.append((arc, rank, int(s), node - arc))
                left[s] -= take
                open_shards -= left[s] == 0
                rest, rank = rest - take, rank + take
            node += 1
    return out


def sharded(docs: DataFrame, id_col: str = "doc_id", shards: int | list[str] = SHARDS, virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK) -> DataFrame:
    """A row for every key of docs: its position, home shard, shard, and virtual nodes passed.

    Rows that repeat a key are one key and one row. Rows with a null key are left out. An empty table gives none. No shard
    has more than ceil((1 + slack) * keys / shards) keys.
    """
    names = [f"shard-{k}" for k in range(shards)] if isinstance(shards, int) else list(shards)
    if not names or len(set(names)) < len(names) or virtual_nodes < 1 or slack < 0:
        raise ValueError("shards must have distinct names, virtual nodes be 1 at least, and slack not negative")
    spark = docs.sparkSession
    at, owner = ring(names, virtual_nodes)
    shared = spark.sparkContext.broadcast((at, owner))  # fixed in size by shards and virtual nodes

    def arcs(batches):
        at, _ = shared.value
        for b in batches:
            arc = np.searchsorted(at, b.column(1).to_numpy()) % len(at)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(arc.astype(np.int32))], ["doc_id", "position", "arc"])

    keys = only(docs, doc_id=id_col).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    keys = written(keys.select("doc_id", position_of(F.col("doc_id")).alias("position")).mapInArrow(arcs, "doc_id long, position long, arc int"), f"{shared_dir(spark)}/keys")
    tally = keys.groupBy("arc").count().toPandas()  # at most one row for each virtual node
    counts = np.zeros(len(at), np.int64)
    counts[tally["arc"]] = tally["count"]
    capacity = -(-int(counts.sum() * (1 + slack) * 1_000_000) // (1_000_000 * len(names)))
    moves = spark.sparkContext.broadcast(np.array(spread(counts, owner, len(names), capacity), np.int64).reshape(-1, 4))

    def put(batches):
        _, owner = shared.value
        m = moves.value
        far = np.int64(1) << np.int64(44)
        starts = m[:, 0] * far + m[:, 1]
        for b in batches:
            arc, row = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            x = m[np.searchsorted(starts, arc * far + row - 1, "right") - 1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(owner[arc]), pa.array(x[:, 2].astype(np.int32)), pa.array(x[:, 3].astype(np.int32))], ["doc_id", "position", "home", "shard", "hops"])

    numbered = keys.withColumn("row", F.row_number().over(Window.partitionBy("arc").orderBy(F.col("position") < int(at[0]), "position", "doc_id")))
    return numbered.mapInArrow(put, PLACED)
