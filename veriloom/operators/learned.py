"""A learned scorer of Stage II: gated attention over the words of a window, and its training.

Words are hashed to vectors that are learned with the rest. Attention weighs a word by the product of a tanh and a sigmoid
branch, so that a short span can decide about a long window; its weights say which words did. The model is small enough to
be fitted on the driver from a bounded sample, and scores windows in Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .chunks import Windows, windows
from .stage2 import BLOCKS, TOP_TOKENS, UNCERTAIN, WHOLE

#: Word cells, length of a word's vector, width of the attention, words of a window that are read in training steps.
CELLS, DIMS, WIDTH, RATE, EPOCHS = 1 << 14, 24, 16, 0.02, 8
#: The model is fitted on at most this many samples, those of least hash.
MOST_SAMPLES = 4000
_WORD = re.compile(r"[^\W_]+")
_SCORED = pa.struct([("score", pa.float64()), ("tokens", pa.list_(pa.struct([("token", pa.string()), ("weight", pa.float64())])))])


def cells(text: str) -> tuple[list[str], np.ndarray]:
    words = _WORD.findall(text.lower())
    return words, np.array([zlib.crc32(w.encode()) % CELLS for w in words], np.int64)


@dataclass
class Gated:
    table: np.ndarray  # a vector for each cell
    value: np.ndarray  # of the tanh branch
    gate: np.ndarray  # of the sigmoid branch
    weight: np.ndarray  # of the branches' product
    head: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.value, self.gate, self.weight, self.head, self.bias]

    def forward(self, words: np.ndarray):
        h = self.table[words]
        t, g = np.tanh(h @ self.value), 1 / (1 + np.exp(-(h @ self.gate)))
        s = (t * g) @ self.weight
        a = np.exp(s - s.max())
        a /= a.sum()
        z = a @ h
        return h, t, g, a, z, 1 / (1 + np.exp(-float(z @ self.head + self.bias[0])))

    def score(self, text: str) -> tuple[float, list[tuple[str, float]]]:
        """(probability, the words of most attention with their weights); 0 for a text without words."""
        words, at = cells(text)
        if not words:
            return 0.0, []
        *_, a, _, p = self.forward(at)
        best: dict[str, float] = {}
        for w, x in zip(words, a):
            best[w] = best.get(w, 0.0) + float(x)
        return p, sorted(best.items(), key=lambda x: (-x[1], x[0]))[:TOP_TOKENS]

    def gradients(self, words: np.ndarray, label: int) -> tuple[list[np.ndarray], float]:
        """Of the cross entropy of one text, in order of parts(); that of the table by word."""
        h, t, g, a, z, p = self.forward(words)
        d = p - label
        dz = d * self.head
        da = h @ dz
        ds = a * (da - a @ da)
        db = ds[:, None] * self.weight
        dt, dg = db * g * (1 - t * t), db * t * g * (1 - g)
        dh = a[:, None] * dz + dt @ self.value.T + dg @ self.gate.T
        loss = -np.log(max(1e-12, p if label else 1 - p))
        return [dh, h.T @ dt, h.T @ dg, (t * g).T @ ds, d * z, np.array([d])], loss


def fresh(seed: int = 3) -> Gated:
    rng = np.random.default_rng(seed)
    return Gated(rng.normal(0, 0.05, (CELLS, DIMS)), rng.normal(0, 0.3, (DIMS, WIDTH)), rng.normal(0, 0.3, (DIMS, WIDTH)), rng.normal(0, 0.3, WIDTH), rng.normal(0, 0.3, DIMS), np.zeros(1))


def fitted(texts: list[str], labels: list[int], seed: int = 3) -> Gated:
    """Adagrad over shuffled samples; texts without words are left out."""
    m, rng = fresh(seed), np.random.default_rng(seed)
    rows = [(c, y) for t, y in zip(texts, labels) if len(c := cells(t)[1])]
    past = [np.full_like(x, 1e-6) for x in m.parts()]
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            words, y = rows[k]
            grads, _ = m.gradients(words, y)
            at, place = np.unique(words, return_inverse=True)
            g = np.zeros((len(at), DIMS))
            np.add.at(g, place, grads[0])
            past[0][at] += g * g
            m.table[at] -= RATE * 5 * g / np.sqrt(past[0][at])
            for x, s, d in zip(m.parts()[1:], past[1:], grads[1:]):
                s += d * d
                x -= RATE * d / np.sqrt(s)
    return m


def train(samples: DataFrame, most: int = MOST_SAMPLES, seed: int = 3) -> Gated:
    """A model of samples (text, label), whole texts of at most `most` of them."""
    rows = samples.where("text is not null and label is not null").select("text", "label").orderBy(F.xxhash64("text"), "label").limit(most).collect()
    return fitted([r["text"] for r in rows], [r["label"] for r in rows], seed)


def scored(df: DataFrame, model: Gated, id_col: str = "request_id", text_col: str = "text", w: Windows = WHOLE) -> DataFrame:
    """(id, score, span, tokens, should_block, uncertain) of texts: that of the window with the highest score.

    Windows are scored in parallel, wherever they come from; a text's best is found by partial maxima.
    """

    @F.arrow_udf(from_arrow_type(_SCORED))
    def of(texts: pa.Array) -> pa.Array:
        got = [None if t is None else model.score(t) for t in texts.to_pylist()]
        return pa.array([None if x is None else {"score": x[0], "tokens": [{"token": a, "weight": b} for a, b in x[1]]} for x in got], _SCORED)

    rows = df.select(F.col(id_col).alias("id"), F.explode_outer(windows(F.coalesce(F.col(text_col), F.lit("")), w)).alias("w"))
    rows = rows.select("id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), of(F.col("w.text")).alias("s"))
    top = rows.groupBy("id").agg(F.max_by(F.struct("start", "end", "s"), F.struct(F.coalesce("s.score", F.lit(0.0)), -F.col("start"))).alias("t"))
    score = F.coalesce("t.s.score", F.lit(0.0))
    return top.select(
        F.col("id").alias(id_col), score.alias("score"), F.when(F.col("t.start").isNotNull(), F.array("t.start", "t.end")).alias("span"), F.when(score >= UNCERTAIN, F.col("t.s.tokens")).alias("tokens"),
        (score >= BLOCKS).alias("should_block"), ((score >= UNCERTAIN) & (score < BLOCKS)).alias("uncertain"),
    )
