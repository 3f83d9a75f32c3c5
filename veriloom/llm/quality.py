"""Quality by nearest neighbours: labelled documents in a latent-semantic space vote, weighted by similarity.

Toxicity has a space of its own, of the features that speak for it, weighted by their log odds over the class prior, so
that a word of a language with few toxic documents counts as much as one of many.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cleaned, filtered, only, steps, tokens, word_hashes, worded

#: The model is fitted on at most this many labelled documents, those of least hash; every document is scored.
MOST_LABELLED = 6000
#: The feature of a word that repeats the word before it.
REPEAT = np.uint64(0x5EED0FACADE)
FEATURES, DIMS, NEIGHBOURS = 3000, 96, 15
#: Of toxicity's own space: its features, and the weight of the axis that all documents share, against a weight of 1 of the
#: most telling feature. It keeps documents with little that is toxic beside those with nothing.
TOXIC_FEATURES, SHARED = 300, 0.3
#: Documents are compared with the labelled ones in blocks of this many.
BLOCK = 2048
REJECT_BELOW = 0.5
#: Cosines are rounded to one of so many steps, so that equal documents tie wherever they stand in a block.
STEPS = np.float32(1 << 20)
SCORES = "doc_id long, quality_score double, toxic_score double, keep boolean"


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each distinct word: of its cleaned form (0: none), and of its shape, letters and digits made one."""
    shape = pc.replace_substring_regex(words, r"\p{Lu}+", "X")
    shape = pc.replace_substring_regex(shape, r"\p{L}+", "x")
    shape = pc.replace_substring_regex(pc.replace_substring_regex(shape, "[xX]+x", "x"), r"\p{N}+", "9")
    return word_hashes(cleaned(words)), word_hashes(pc.binary_join_element_wise("shape", shape, "\t"))


def counts(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, count) of every feature of every text; with `known`, sorted hashes, features are places in it."""
    offsets, codes, words = tokens(texts)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64 if known is None else np.int64), np.zeros(0)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    again = doc[1:][(codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])]
    if known is None:
        feature = np.concatenate([*(f[codes] for f in features(words)), np.full(len(again), REPEAT)])
        doc = np.concatenate((doc, doc, again))
        real = feature != 0
        every, place = np.unique(feature[real], return_inverse=True)
        key, n = np.unique(doc[real] * len(every) + place, return_counts=True)
        return key // len(every), every[key % len(every)], n.astype(float)
    at = int(np.searchsorted(known, REPEAT))
    keys = [again * len(known) + at] if at < len(known) and known[at] == REPEAT else []
    for f in features(words):
        at = np.minimum(np.searchsorted(known, f), len(known) - 1)
        at = np.where((known[at] == f) & (f != 0), at, -1)[codes]
        hit = at >= 0
        keys.append(doc[hit] * len(known) + at[hit])
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key // len(known), key % len(known), n.astype(float)


@dataclass
class Model:
    known: np.ndarray  # sorted hashes of the features
    weight: np.ndarray  # of each feature
    axes: np.ndarray  # features x latent dimensions
    vectors: np.ndarray  # unit vectors of the labelled documents
    quality: np.ndarray
    toxic: np.ndarray
    shared: float = 0.0  # weight of the axis that all documents have, the last row of axes; 0: there is none
    own: Model | None = None  # toxicity's own space; None: no feature speaks for it


def embed(doc: np.ndarray, feature: np.ndarray, n: np.ndarray, rows: int, m: Model) -> np.ndarray:
    """Unit latent vectors; zero for a document that has no known feature."""
    out = np.zeros((rows, m.axes.shape[1]), np.float32)
    for lo in range(0, rows, BLOCK):
        a, b = np.searchsorted(doc, (lo, lo + BLOCK))
        size = min(BLOCK, rows - lo)
        x = np.zeros((size, len(m.axes)), np.float32)
        x[doc[a:b] - lo, feature[a:b]] = (1 + np.log(n[a:b])) * m.weight[feature[a:b]]
        if m.shared:
            x[:, -1] = m.shared
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        out[lo : lo + size] = x @ m.axes
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def train(doc: np.ndarray, feature: np.ndarray, n: np.ndarray, quality: np.ndarray, toxic: np.ndarray) -> Model:
    """Features are those most frequent and those most associated with a label; latent axes are from a truncated SVD."""
    rows = len(quality)
    every, place = np.unique(feature, return_inverse=True)
    place = place.astype(np.int32)
    df = np.bincount(place, minlength=len(every)).astype(float)

    def association(label: np.ndarray) -> np.ndarray:
        both = np.bincount(place, label[doc].astype(float), len(every))
        p = label.sum()
        top = both * rows - df * p
        return top / np.sqrt(np.maximum(df * (rows - df), 1) * max(p * (rows - p), 1))

    phi = np.maximum(np.abs(association(1 - quality)), np.abs(association(toxic)))
    phi[df < 3] = 0
    order = np.argsort(-phi, kind="stable")[: FEATURES // 2]
    chosen = np.union1d(order, np.argsort(-df, kind="stable")[: FEATURES - len(order)])
    known, inside = every[chosen], np.full(len(every), -1)
    inside[chosen] = np.arange(len(chosen))
    weight = ((1 + np.log(rows / np.maximum(df[chosen], 1))) * (0.02 + phi[chosen])).astype(np.float32)
    kept = inside[place] >= 0
    d, f, c = doc[kept], inside[place[kept]], n[kept]
    x = np.zeros((rows, len(known)), np.float32)
    x[d, f] = (1 + np.log(c)) * weight[f]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    dims = min(DIMS, len(known), rows)
    q = np.linalg.qr(x.T @ np.random.default_rng(7).standard_normal((rows, dims + 16)).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    m = Model(known, weight, (q @ vt.T)[:, :dims].astype(np.float32), np.zeros((0, dims), np.float32), quality, toxic)
    m.vectors = embed(d, f, c, rows, m)
    m.own = train_toxic(doc, place, every, df, association(toxic), quality, toxic)
    return m


def train_toxic(doc: np.ndarray, place: np.ndarray, every: np.ndarray, df: np.ndarray, phi: np.ndarray, quality: np.ndarray, toxic: np.ndarray) -> Model | None:
    """Toxicity's own space: a document has a feature or not, however often."""
    rows, p = len(toxic), toxic.sum()
    both = np.bincount(place, toxic[doc].astype(float), len(every))
    odds = np.log((both + 0.5) / (df - both + 0.5) * (rows - p + 0.5) / (p + 0.5))
    able = np.flatnonzero((df >= 3) & (phi > 0) & (odds > 0))
    if not len(able):
        return None
    chosen = np.sort(able[np.argsort(-phi[able], kind="stable")[:TOXIC_FEATURES]])
    inside = np.full(len(every), -1)
    inside[chosen] = np.arange(len(chosen))
    kept = inside[place] >= 0
    d, f = doc[kept], inside[place[kept]]
    weight = (odds[chosen] / odds[chosen].max()).astype(np.float32)
    x = np.zeros((rows, len(chosen) + 1), np.float32)
    x[d, f] = weight[f]
    x[:, -1] = SHARED
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :DIMS]
    m = Model(every[chosen], weight, np.ascontiguousarray(axes, np.float32), np.zeros((0, axes.shape[1]), np.float32), quality, toxic, SHARED)
    m.vectors = embed(d, f, np.ones(len(d)), rows, m)
    return m


def vote(vectors: np.ndarray, m: Model, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
    """Similarity-weighted labels of the k nearest labelled documents, by exact cosines in blocks.

    Cosines count to STEPS of one; of equal ones at the boundary the first labelled documents (of least id) are taken.
    """
    quality, toxic = np.full(len(vectors), 0.0), np.full(len(vectors), 0.0)
    k = min(k, len(m.vectors))
    for lo in range(0, len(vectors), BLOCK // 4):
        cos = vectors[lo : lo + BLOCK // 4] @ m.vectors.T
        cos *= STEPS
        np.rint(cos, out=cos)
        top = np.argpartition(cos, len(m.vectors) - k, axis=1)[:, -k:]
        least = np.take_along_axis(cos, top[:, :1], 1)  # the k-th largest
        for row in np.flatnonzero(np.count_nonzero(cos >= least, axis=1) > k):
            over, equal = np.flatnonzero(cos[row] > least[row]), np.flatnonzero(cos[row] == least[row])
            top[row] = np.concatenate((over, equal[: k - len(over)]))
        w = np.maximum(np.take_along_axis(cos, top, 1) / STEPS, 0).astype(float) ** 4 + 1e-9
        quality[lo : lo + len(cos)] = (w * m.quality[top]).sum(1) / w.sum(1)
        toxic[lo : lo + len(cos)] = (w * m.toxic[top]).sum(1) / w.sum(1)
    return quality, toxic


def score(texts: pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(quality, toxicity) of each text, 0 to 1. A text without any word has quality 0 and toxicity 0."""
    known = m.known if m.own is None else np.union1d(m.known, m.own.known)
    doc, feature, n = counts(texts, known)

    def within(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.full(len(known), -1)
        at[np.searchsorted(known, part)] = np.arange(len(part))
        hit = at[feature] >= 0
        return doc[hit], at[feature[hit]], n[hit]

    vectors = embed(*within(m.known), len(texts), m)
    quality = vote(vectors, m)[0]
    quality[~vectors.any(axis=1)] = 0.0
    toxic = np.zeros(len(texts))
    if m.own is not None:
        at, f, _ = within(m.own.known)
        some, row = np.unique(at, return_inverse=True)
        got = vote(embed(row, f, np.ones(len(f)), len(some) + 1, m.own), m.own)[1]  # the last has no toxic feature
        toxic[np.unique(doc)] = got[-1]
        toxic[some] = got[:-1]
    return quality, toxic


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> Model | None:
    """A model from at most `most` labelled documents (None if there are none). Labels that are null, or whose document

    has no text, are left out; of repeated ids one row counts. Texts are turned into counts on the executors.
    """
    named = only(labels, doc_id=id_col, quality="quality", toxic="toxic").where("doc_id is not null and quality is not null")
    named = named.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).cast("int").alias("toxic"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = only(docs, doc_id=id_col, text=text_col).where("text is not null")
    found = F.broadcast(chosen)  # at most `most` rows
    rows = texts.join(found, "doc_id").select("doc_id", "text", "quality", "toxic")

    def run(batches):
        for b in steps(batches):
            doc, feature, n = counts(b.column(1))
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            listed = lambda x, t: pa.ListArray.from_arrays(pa.array(cut), pa.array(x, t))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), listed(feature.view(np.int64), pa.int64()), listed(n.astype(np.float32), pa.float32())], ["doc_id", "quality", "toxic", "f", "n"])

    got = rows.mapInArrow(run, "doc_id long, quality int, toxic int, f array<long>, n array<float>").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    got = got.take(pc.sort_indices(got["doc_id"]))
    ids = got["doc_id"].to_numpy()
    got = got.filter(pa.array(np.concatenate(([True], ids[1:] != ids[:-1]))))
    f, n = got["f"].combine_chunks(), got["n"].combine_chunks()
    doc = np.repeat(np.arange(got.num_rows, dtype=np.int32), pc.list_value_length(f).to_numpy(zero_copy_only=False))
    return train(doc, f.flatten().to_numpy().view(np.uint64), n.flatten().to_numpy(), got["quality"].to_numpy(), got["toxic"].to_numpy())


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, quality_score, toxic_score, keep, a row for every row of docs.

    keep: quality_score is REJECT_BELOW at least and toxic_score below it. Null, empty and wordless texts have scores 0
    and go. Repeated rows get equal scores. Without any labelled document every text with a word scores 1 and stays. Whole
    texts count, however long. Ids are cast to long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, most))

    def run(batches):
        m = shared.value
        for b in steps(batches):
            if m is None:
                quality, toxic = worded(b.column(1)).astype(float), np.zeros(b.num_rows)
            else:
                quality, toxic = score(b.column(1), m)
            keep = (quality >= REJECT_BELOW) & (toxic < REJECT_BELOW)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(quality), pa.array(toxic), pa.array(keep)], ["doc_id", "quality_score", "toxic_score", "keep"])

    src = only(docs, doc_id=id_col, text=text_col)
    return src.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORES)


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    """The documents that stay, with all their columns. Decided by text: rows with null or repeated ids are each judged."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, most))

    def decide(texts: pa.Array) -> np.ndarray:
        m = shared.value
        if m is None:
            return worded(texts)
        quality, toxic = score(texts, m)
        return (quality >= REJECT_BELOW) & (toxic < REJECT_BELOW)

    return filtered(docs, text_col, decide)
