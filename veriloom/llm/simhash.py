"""SimHash near-duplicates, found by vantage-point trees.

A document's fingerprint has 256 bits over the set of its words and word pairs. The distance of two documents is the
Hamming distance of their fingerprints, a metric, so the triangle inequality holds for it. A vantage-point tree over that
metric orders the fingerprints by leaf, and they are cut in that order into shards of SHARD_ROWS, however many there are.
STRIP shards are a strip; every strip is compared with itself and with the strips before it, and of a visiting shard only
those rows take part whose ball of the radius overlaps a leaf of the home strip. Two strips meet once for every key: by the
pigeonhole principle (see `places`) a pair within the radius is close in one of four words, and there in one of the word's
four quarters. So a task takes one quarter as key, compares each row with those rows only whose key is close, first by the
key's word and then by all four. No pair is lost, no task holds more than two strips, and its work is bounded whatever the
table's size. Pairs are exact in the metric; tasks emit only edges to the smallest member, which keep the groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cleaned, dropped, files_of, filesystem, gather, mix, numbered, only, raw, shared_dir, steps, tokens, word_hashes, written

BITS, BUCKETS = 256, 8192
#: Near duplicates: at most RADIUS of the 256 bits differ.
RADIUS = 56
#: The tree's shape is taken from so many fingerprints, LEAF_SAMPLE of them a leaf; every fingerprint is routed through it.
TREE_SAMPLE, LEAF_SAMPLE = 8192, 16
#: A shard has about so many rows, a strip so many shards; a task compares two strips.
SHARD_ROWS, STRIP = 8192, 128
#: Tables of at most so many different fingerprints are compared without keys, which would leave out next to nothing.
FEW = 16_384
#: A key has at most so many bits (a quarter of a word), and fewer as long as a key would have fewer rows than these.
KEY_BITS, KEY_ROWS = 16, 16
#: Tasks of the comparison: beyond so many a task takes several strips, one after the other.
MOST_TASKS = 20_000

FINGERPRINT = "doc_id long, fp binary, n_features int"


def planes() -> np.ndarray:
    return np.random.default_rng(20240229).choice(np.array([-1, 1], np.float32), (BUCKETS, BITS))


def sketch(texts: pa.Array, signs: np.ndarray, rows: int = 192) -> tuple[list[bytes], np.ndarray]:
    """(fingerprint, number of features) of each text. A text without words has fingerprint zero and no features."""
    offsets, codes, words = tokens(texts)
    hashed = word_hashes(cleaned(words))
    h = hashed[codes] if len(codes) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    kept = h != 0
    h, doc = h[kept], doc[kept]
    with np.errstate(over="ignore"):
        pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    same = doc[:-1] == doc[1:]
    feature, owner = np.concatenate((h, pairs[same])), np.concatenate((doc, doc[:-1][same]))
    order = np.argsort(owner, kind="stable")
    feature, owner = feature[order], owner[order]
    bucket, sign = (feature >> np.uint64(11)).astype(np.int64) % BUCKETS, 1.0 - 2.0 * (feature & np.uint64(1)).astype(np.float64)
    at = np.searchsorted(owner, np.arange(len(offsets)))
    fps, sizes = [], np.zeros(len(offsets) - 1, np.int32)
    for lo in range(0, len(sizes), rows):
        hi = min(lo + rows, len(sizes))
        part = slice(at[lo], at[hi])
        key = (owner[part] - lo) * BUCKETS + bucket[part]
        cells = (hi - lo) * BUCKETS
        sums = np.sign(np.bincount(key, sign[part], cells)).astype(np.float32).reshape(hi - lo, BUCKETS)
        sizes[lo:hi] = np.count_nonzero(sums, axis=1)
        bits = (sums @ signs > 0) & (sizes[lo:hi, None] > 0)
        fps += [x.tobytes() for x in np.packbits(bits, axis=1)]
    return fps, sizes


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (32 bytes), n_features. Null and empty texts: zero bits, 0 features. Null ids stay null."""

    def run(batches):
        signs = planes()
        for b in steps(batches):
            fps, sizes = sketch(b.column(1), signs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), pa.array(sizes)], ["doc_id", "fp", "n_features"])

    src = only(docs, doc_id=id_col, text=text_col)
    return src.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FINGERPRINT)


def words64(fps) -> np.ndarray:
    return np.frombuffer(b"".join(fps), np.uint64).reshape(-1, BITS // 64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits between rows of a and one row b (or rows of the same number)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def grow(fp: np.ndarray, leaf_rows: int = LEAF_SAMPLE) -> list | int:
    """A vantage-point tree as nested lists [vantage, threshold, inside, outside]; a leaf is its number, from the left.

    The vantage point is the one farthest from the least member, the threshold the median distance from it.
    """
    leaf = iter(range(1 << 30))

    def build(rows: np.ndarray):
        if len(rows) < 2 * leaf_rows:
            return next(leaf)
        first = rows[np.lexsort(fp[rows].T)[0]]
        v = rows[np.argmax(distance(fp[rows], fp[first]))]
        d = distance(fp[rows], fp[v])
        mu = float(np.median(d))
        near = d <= mu
        if near.all():
            return next(leaf)
        return [fp[v].tobytes(), mu, build(rows[near]), build(rows[~near])]

    return build(np.arange(len(fp)))


def leaves(tree, fp: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    out = np.zeros(len(fp), np.int32)

    def walk(node, rows: np.ndarray):
        if not isinstance(node, list):
            out[rows] = node
            return
        near = distance(fp[rows], np.frombuffer(node[0], np.uint64)) <= node[1]
        walk(node[2], rows[near])
        walk(node[3], rows[~near])

    walk(tree, np.arange(len(fp)))
    return out


def reaching(tree, lo: int, hi: int, fp: np.ndarray, r: float) -> np.ndarray:
    """Whether the ball of radius r about each row overlaps one of the leaves lo to hi, by the triangle inequality."""
    out = np.zeros(len(fp), bool)
    last = lambda node: last(node[3]) if isinstance(node, list) else node

    def walk(node, least: int, rows: np.ndarray):
        rows = rows[~out[rows]]
        if not len(rows) or least > hi or last(node) < lo:
            return
        if not isinstance(node, list):
            out[rows] = True
            return
        d = distance(fp[rows], np.frombuffer(node[0], np.uint64))
        walk(node[2], least, rows[d - r <= node[1]])
        walk(node[3], last(node[2]) + 1, rows[d + r > node[1]])

    walk(tree, 0, np.arange(len(fp)))
    return out


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the groups of i and j in place; a group's label is its smallest index."""
    while len(i):
        a, b = label[i], label[j]
        while ((x := label[a]) != a).any():
            a = x
        while ((x := label[b]) != b).any():
            b = x
        label[i], label[j] = a, b
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def pairs_within(a: np.ndarray, b: np.ndarray, r: int, same: bool = False, block: int = 16, width: int = 4096):
    """Blocks (i, j) of the pairs of rows of a and b within r; if a and b are the same rows, those with i < j."""
    *rows, row = (np.ascontiguousarray(a[:, k]) for k in range(a.shape[1]))
    *cols, col = (np.ascontiguousarray(b[:, k]) for k in range(b.shape[1]))
    d = None
    for lo in range(0, len(a), block):
        hi = min(lo + block, len(a))
        for c in range(lo // width * width if same else 0, len(b), width):
            e = min(c + width, len(b))
            if d is None or d.shape != (hi - lo, e - c):
                x, p, d = (np.empty((hi - lo, e - c), t) for t in (np.uint64, np.uint8, np.uint8))
            for k, (u, v) in enumerate(zip(rows, cols)):
                np.bitwise_xor(u[lo:hi, None], v[None, c:e], out=x)
                np.bitwise_count(x, out=p if k else d)
                if k:
                    d += p
            near = np.flatnonzero(d <= r)
            if len(near):
                i, j = lo + near // (e - c), c + near % (e - c)
                close = d.ravel()[near].astype(np.int64) + np.bitwise_count(row[i] ^ col[j]) <= r
                if same:
                    close &= i < j
                if close.any():
                    yield i[close], j[close]


def places(r: int) -> list[tuple[int, int, int, int]]:
    """(word, quarter, most, apart): rows within r differ in at most `most` bits of one such word and `apart` of its quarter.

    r + 1 is dealt out over the words, and a word's share over its quarters. If a row differed from another in as many bits
    as its share in each word, they would be r + 1 apart; so in some word it differs in fewer, and there in some quarter.
    """
    dealt = lambda n: [n // 4 + (k < n % 4) for k in range(4)]
    found = [(w, q, word - 1, quarter - 1) for w, word in enumerate(dealt(r + 1)) for q, quarter in enumerate(dealt(word)) if quarter]
    return sorted(found, key=lambda x: -x[3])  # most work first


def keyed(fp: np.ndarray, word: int, quarter: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one word of each row, row number, start by key), in the order of the key: the quarter's upper bits."""
    w = np.ascontiguousarray(fp[:, word])
    key = ((w >> np.uint64(16 * quarter) & np.uint64(0xFFFF)) >> np.uint64(16 - bits)).astype(np.uint16)
    order = np.argsort(key, kind="stable")
    return w[order], order, np.concatenate(([0], np.cumsum(np.bincount(key, minlength=1 << bits))))


def pairs_by_key(a: np.ndarray, b: np.ndarray, r: int, place: tuple[int, int, int, int], label_a: np.ndarray, label_b: np.ndarray, same: bool = False, bits: int | None = None, cells: int = 1 << 16, width: int = 8192):
    """Blocks (i, j) of the pairs of rows of a and b within r that are close at a place; if a and b are the same rows, each once.

    Pairs whose labels are equal when they meet are in one group already and left out; the caller changes the labels.
    """
    word, quarter, most, apart = place
    if bits is None:
        bits = min(KEY_BITS, max(0, round(np.log2(max(len(a), 1) / KEY_ROWS))))
    words_a, row_a, start_a = keyed(a, word, quarter, bits)
    words_b, row_b, start_b = (words_a, row_a, start_a) if same else keyed(b, word, quarter, bits)
    close, count = np.flatnonzero(np.bitwise_count(np.arange(1 << bits)) <= apart), np.diff(start_b)
    x, d = np.empty(cells, np.uint64), np.empty(cells, np.uint8)
    for key in np.flatnonzero(np.diff(start_a)).tolist():
        others = close ^ key
        if same:
            others = others[others >= key]
        at = gather(start_b[others], count[others])
        cols, lo, hi, dense = words_b[at], int(start_a[key]), int(start_a[key + 1]), False
        while lo < hi and len(cols):
            e = min(hi, lo + max(1, cells // min(len(cols), width)))
            group = label_a[row_a[lo:e]]
            if dense and (group == group[0]).all():  # rows of one large group needn't meet the rest of it
                rest = label_b[row_b[at]] != group[0]
                at, cols, kept = at[rest], cols[rest], (at, cols)
            else:
                kept = (at, cols)
            hits = 0
            for c in range(0, len(cols), width):
                part = cols[c : c + width]
                n = (e - lo) * len(part)
                np.bitwise_xor(words_a[lo:e, None], part, out=x[:n].reshape(e - lo, -1))
                near = np.flatnonzero(np.bitwise_count(x[:n], out=d[:n]) <= most)
                if not len(near):
                    continue
                hits += len(near)
                p, q = lo + near // len(part), at[c + near % len(part)]
                i, j = row_a[p], row_b[q]
                new = label_a[i] != label_b[j]
                if same:
                    new &= p < q
                i, j = i[new], j[new]
                new = distance(a[i], b[j]) <= r
                if new.any():
                    yield i[new], j[new]
            at, cols = kept
            dense, lo = hits > len(cols), e


def read_shard(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, fingerprints, leaves) of a shard's file."""
    import pyarrow.parquet as pq

    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        t = pq.read_table(f, columns=["rep", "fp", "leaf"])
    fp = raw(t["fp"].combine_chunks())[0] if len(t) else np.zeros(0, np.uint8)
    return t["rep"].to_numpy(), fp.view(np.uint64).reshape(-1, BITS // 64), t["leaf"].to_numpy()


def strip_edges(home: list[str], others: list[str], tree, r: int, place: tuple[int, int, int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) from each member of a group within two strips of shards to the group's smallest id.

    If the strips are the same, its own pairs are compared. With a place, the pairs are those that are close there.
    """
    ids, fp, leaf = (np.concatenate(x) for x in zip(*map(read_shard, home)))
    if not len(ids):
        return ids, ids
    same, n, members, visitors = others == home, len(ids), [ids], [fp[:0]]
    for other in [] if same else others:
        ids2, fp2, _ = read_shard(other)
        visit = reaching(tree, int(leaf.min()), int(leaf.max()), fp2, r)
        members.append(ids2[visit])
        visitors.append(fp2[visit])
    ids, fp2, start = np.concatenate(members), fp if same else np.concatenate(visitors), 0 if same else n
    label = np.arange(len(ids))
    found = pairs_within(fp, fp2, r, same) if place is None else pairs_by_key(fp, fp2, r, place, label[:n], label[start:], same)
    for i, j in found:
        unite(label, i, j + start)
        while len(i) > 4096 and ((x := label[label]) != label).any():
            label[:] = x
    while ((x := label[label]) != label).any():
        label = x
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    to = least[label]
    moved = to != ids
    return ids[moved], to[moved]


def edges_within(exact: DataFrame, at: str, radius: int, count: int) -> DataFrame:
    """(a, b) edges that join the groups of fingerprints (rep, fp) within the radius, from all pairs of strips."""
    spark = exact.sparkSession
    taken = exact.orderBy(F.xxhash64("rep"), "rep").limit(TREE_SAMPLE).select("fp").toArrow()["fp"].to_pylist()
    tree = grow(words64(taken))  # TREE_SAMPLE rows, whatever the table's size

    def place(batches):
        for b in batches:
            fp = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), fp, pa.array(leaves(tree, words64(fp.to_pylist())))], ["rep", "fp", "leaf"])

    shards = max(1, -(-count // SHARD_ROWS))
    placed = exact.select("rep", "fp").mapInArrow(place, "rep long, fp binary, leaf int")
    placed.repartitionByRange(shards, "leaf", "rep").write.mode("overwrite").parquet(f"{at}/shards")
    names = files_of(f"{at}/shards")  # a name for every SHARD_ROWS rows
    strips = [names[k : k + STRIP] for k in range(0, len(names), STRIP)]
    keys = places(radius) if count > FEW else [None]
    pairs = len(strips) * (len(strips) + 1) // 2

    def compare(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                nth, pair = divmod(k, pairs)
                home = (math.isqrt(8 * pair + 1) - 1) // 2  # each strip with those up to itself
                a, to = strip_edges(strips[home], strips[pair - home * (home + 1) // 2], tree, radius, keys[nth])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(to)], ["a", "b"])

    total = pairs * len(keys)
    return spark.range(0, total, 1, max(1, min(total, MOST_TASKS))).mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, at: str) -> DataFrame:
    """(id, label): each id of edges (a, b) with the smallest id connected to it, by large-star and small-star steps.

    Every step is a table in shared storage; the number of steps grows with the logarithm of the largest group.
    """
    cur, k = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{at}/star0"), 0
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select("b", "m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        k += 1
        new = written(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), f"{at}/star{k}")
        total = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total(new) == total(cur):
            dropped(f"{at}/star{k - 1}")
            return new.select(F.col("a").alias("id"), F.col("b").alias("label"))
        dropped(f"{at}/star{k - 1}")
        cur = new


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, group_id (the smallest id of its group), n_features, keep (the group's one document that stays).

    Documents are in one group if a chain of pairs within `radius` joins them. Rows with a null id are left out. Of rows
    that share an id, that of the least fingerprint counts, and the result has one row of that id. Texts without words
    are no duplicates of anything, and stay; short and very long ones are compared like all others, by their whole texts.
    Ids are cast to long. An empty table gives none. Comparisons grow with the square of the different fingerprints, of which
    the keys leave about a seventh in large tables.
    """
    at = shared_dir(docs.sparkSession)
    fps = fingerprints(docs, id_col, text_col).where("doc_id is not null")
    fps = written(fps.groupBy("doc_id").agg(F.min(F.struct("fp", "n_features")).alias("x")).select("doc_id", "x.*"), f"{at}/fp")
    worded = fps.where("n_features > 0")
    exact = written(worded.groupBy("fp").agg(F.min("doc_id").alias("rep")), f"{at}/exact")
    label = components(edges_within(exact, at, radius, exact.count()), at)
    dropped(f"{at}/shards")
    groups = worded.join(exact, "fp").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    groups = groups.select("doc_id", F.coalesce("label", "rep").alias("group_id"), "n_features")
    groups = groups.unionByName(fps.where("n_features = 0").select("doc_id", F.col("doc_id").alias("group_id"), "n_features"))
    return groups.withColumn("keep", F.col("doc_id") == F.col("group_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The documents that stay, with all their columns: the smallest id of each group. Rows with a null id stay as they are.

    Rows that repeat an id repeat in the result if that id stays.
    """
    found = near_duplicates(docs, id_col, text_col, radius).where("not keep").select(F.col("doc_id").alias("__gone"))
    gone = written(found, f"{shared_dir(docs.sparkSession)}/gone")
    plain = numbered(docs)
    return plain.join(gone, plain[f"_{docs.columns.index(id_col)}"].cast("long") == gone["__gone"], "left_anti").toDF(*docs.columns)
