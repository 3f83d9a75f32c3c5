"""Language of every word in code-switched text, by a linear-chain conditional random field.

Emissions sum learned weights of a word's affixes, character n-grams, its own form and its entries in the languages'
lexicons, which are taken from the documents fitted on; transitions between
languages are learned with them. Words are labelled by their marginals from forward-backward, which runs over many
documents at once, one word of each at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import STEP_CHARS, array_of_lists, cleaned, codepoints, filtered, gather, mix, only, steps, tokens, word_hashes

#: Fitted on the whole texts of at most this many documents with a known language, those of least hash of each language in turn.
MOST_LABELLED = 1000
#: Training sequences mix the languages by stretches of so many words.
SPAN = 20
#: A word is in a language's lexicon if the documents fitted on use it so often at least.
LEXICON_LEAST = 2
BUCKETS, EPOCHS, RATE = 1 << 16, 4, 0.4
#: Distinct words whose features are laid out at a time.
WORDS_AT_ONCE = 30_000
#: The label of words of no known language.
OTHER = "und"
#: A document stays if this share of its words, by expectation, is of one known language.
LEAST_SHARE = 0.5
LABELS = "doc_id long, lang string, share double, confidence double, n_words int, switches int, keep boolean, spans array<struct<first:int,words:int,lang:string>>"


@dataclass
class Lexicon:
    keys: np.ndarray  # sorted hashes of words
    at: np.ndarray  # offsets into languages, by key
    languages: np.ndarray  # that use the word


def features(words: pa.Array, lexicon: Lexicon | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets by word) of the features of cleaned words; a word without letters or digits has none."""
    points, at = codepoints(words)
    n = np.diff(at)
    p, out, owner = points.astype(np.uint64), [], []
    word = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(p)) - at[word]
    left = n[word] - place
    with np.errstate(over="ignore"):
        h, before = [np.zeros(len(p), np.uint64)], np.zeros(len(p), np.uint64)
        for k in range(1, 5):  # h[k]: of the k characters that begin here
            x = np.zeros(len(p), np.uint64)
            ok = left >= k
            x[ok] = h[-1][ok] * np.uint64(0x9E3779B97F4A7C15) + p[np.flatnonzero(ok) + k - 1] + np.uint64(1)
            h.append(x)
        for kind, k, where in [*((1, k, place == 0) for k in (1, 2, 3)), *((2, k, left == k) for k in (1, 2, 3, 4)), *((3, k, None) for k in (2, 3))]:
            rows = np.flatnonzero((left >= k) if where is None else where & (left >= k))
            out.append(mix(h[k][rows] * np.uint64(31) + np.uint64(kind * 8 + k)))
            owner.append(word[rows])
        whole = np.flatnonzero(n > 0)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix((p << np.uint64(20)) + place.astype(np.uint64)), dtype=np.uint64)))
        out.append(mix(total[at[1:]] - total[at[:-1]])[whole])
        owner.append(whole)
        if lexicon is not None and len(lexicon.keys):
            key = word_hashes(words)
            entry = np.minimum(np.searchsorted(lexicon.keys, key), len(lexicon.keys) - 1)
            hit = np.flatnonzero((lexicon.keys[entry] == key) & (n > 0))
            many = np.diff(lexicon.at)[entry[hit]]
            out.append(mix(lexicon.languages[gather(lexicon.at[entry[hit]], many)].astype(np.uint64) * np.uint64(8) + np.uint64(1 << 40)))
            owner.append(np.repeat(hit, many))
    bucket, owner = (np.concatenate(out) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(n)))))


def summed(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; zero for an empty run."""
    if not len(rows):
        return np.zeros((len(at) - 1, rows.shape[1]), rows.dtype)
    out = np.add.reduceat(np.concatenate((rows, np.zeros((1, rows.shape[1]), rows.dtype))), at[:-1], axis=0)
    out[np.diff(at) == 0] = 0
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    moves: np.ndarray  # log weights, from x to
    lexicon: Lexicon


def forward_backward(em: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals by word. em: positive emission factors by word; documents are runs (starts, lengths) of words."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    first, size = starts[order], lengths[order]
    alpha, scale = np.empty_like(em), np.exp(moves).astype(em.dtype)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left") if longest else np.zeros(0, int)
    a = None
    for t in range(longest):
        rows = first[: active[t]] + t
        a = em[rows] if a is None else (a[: active[t]] @ scale) * em[rows]
        a /= a.sum(axis=1, keepdims=True)
        alpha[rows] = a
    b = np.ones((0, em.shape[1]), em.dtype)
    for t in range(longest - 1, -1, -1):
        rows = first[: active[t]] + t
        if active[t] > len(b):
            b = np.concatenate((b, np.ones((active[t] - len(b), em.shape[1]), em.dtype)))
        alpha[rows] *= b
        b = (b * em[rows]) @ scale.T
        b /= b.sum(axis=1, keepdims=True)
    alpha /= np.maximum(alpha.sum(axis=1, keepdims=True), 1e-30)
    return alpha


def factors(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -30, 0)).astype(np.float32)


def train(spans: list[tuple[str, list[str]]], seed: int = 5) -> Model | None:
    """From spans of one language each. Spans of different languages are joined into code-switched sequences."""
    languages = sorted({x for x, _ in spans}) + [OTHER]
    if len(languages) == 1:
        return None
    rng = np.random.default_rng(seed)
    blocks = [(0x61, 0x7A)] * 4 + [(0x30, 0x39), (0x410, 0x44F), (0x391, 0x3C9), (0x627, 0x64A), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
    strange = [(OTHER, ["".join(map(chr, rng.integers(lo, hi + 1, rng.integers(2, 12)))) for lo, hi in [blocks[rng.integers(len(blocks))]] * SPAN]) for _ in range(max(8, len(spans) // 10))]
    every = [*spans, *strange]
    order = np.argsort(rng.integers(0, max(1, len(every) // 2), len(every)), kind="stable")
    words = [w for k in order for w in every[k][1]]
    labels = np.array([languages.index(every[k][0]) for k in order for _ in every[k][1]])
    T, K = 3 * SPAN, len(languages)
    rows = max(1, len(words) // T)
    words, labels = words[: rows * T] or words, labels[: rows * T]
    if len(words) < T:
        words, labels = (words * (T // len(words) + 1))[:T], np.resize(labels, T)
    encoded = pa.array(words, pa.string()).dictionary_encode()
    named, code = encoded.dictionary, encoded.indices.to_numpy()
    uses = np.bincount(code.ravel() * K + labels, minlength=len(named) * K).reshape(-1, K)[:, :-1] >= LEXICON_LEAST
    known = np.flatnonzero(uses.any(axis=1))
    keys = word_hashes(named)[known]
    known, keys = known[np.argsort(keys)], np.sort(keys)
    lexicon = Lexicon(keys, np.concatenate(([0], np.cumsum(uses[known].sum(axis=1)))), np.nonzero(uses[known])[1])
    bucket, at = features(named, lexicon)
    code, gold = code.reshape(rows, T), labels.reshape(rows, T)
    w, g2 = np.zeros((BUCKETS, K), np.float32), np.full((BUCKETS, K), 1e-6, np.float32)
    moves, m2 = (np.eye(K) * 2.0), np.full((K, K), 1e-6)
    for _ in range(EPOCHS):
        for rows_now in np.array_split(rng.permutation(rows), max(1, rows // 48)):
            c, y = code[rows_now].ravel(), gold[rows_now]
            n = at[c + 1] - at[c]
            f = bucket[gather(at[c], n)]
            cut = np.concatenate(([0], np.cumsum(n)))
            em = factors(summed(w[f], cut)).astype(np.float64)
            B = len(rows_now)
            alpha, beta = np.empty((T, B, K)), np.empty((T, B, K))
            e, s = em.reshape(B, T, K).transpose(1, 0, 2), np.exp(moves - moves.max())
            for t in range(T):
                alpha[t] = e[0] if t == 0 else (alpha[t - 1] @ s) * e[t]
                alpha[t] /= alpha[t].sum(1, keepdims=True)
            beta[-1] = 1
            for t in range(T - 2, -1, -1):
                beta[t] = (e[t + 1] * beta[t + 1]) @ s.T
                beta[t] /= beta[t].sum(1, keepdims=True)
            post = alpha * beta
            post /= post.sum(2, keepdims=True)
            grad = -post.transpose(1, 0, 2).reshape(-1, K)
            grad[np.arange(len(grad)), y.ravel()] += 1
            pair = alpha[:-1, :, :, None] * s * (e[1:] * beta[1:])[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            gm = -pair.sum((0, 1))
            np.add.at(gm, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            gw = np.stack([np.bincount(f, np.repeat(grad[:, k], n), BUCKETS) for k in range(K)], 1).astype(np.float32) / B
            gm = gm / B
            g2 += gw * gw
            m2 += gm * gm
            w += RATE * gw / np.sqrt(g2) * (g2 > 2e-6)
            moves += 0.1 * gm / np.sqrt(m2)
    return Model(languages, w, moves - moves.max(), lexicon)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_LABELLED) -> Model | None:
    """A model of the languages named in lang_col, from the whole texts of at most `most` documents; None if none names one.

    Of rows that share an id the first by language and text counts.
    """
    src = only(docs, doc_id=id_col, text=text_col, lang=lang_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lower(F.trim("lang")).alias("lang"))
    src = src.where("text is not null and lang is not null and lang not in ('', 'und')")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    one = src.groupBy("doc_id").agg(F.min("lang").alias("lang")).withColumn("h", F.xxhash64("doc_id"))
    chosen = one.withColumn("nth", nth).where(F.col("nth") <= most).orderBy("nth", "h", "doc_id").limit(most).select("doc_id")

    def run(batches):
        for b in steps(batches):
            offsets, codes, words = tokens(b.column(1))
            clean = cleaned(words)
            real = pc.not_equal(clean, "").to_numpy(zero_copy_only=False)[codes]
            n = summed(real[:, None].astype(np.int64), offsets)[:, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), array_of_lists(clean.take(pa.array(codes[real])), np.concatenate(([0], np.cumsum(n))))], ["doc_id", "lang", "words"])

    rows = src.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x"))  # `most` rows
    got = rows.select("doc_id", "x.text", "x.lang").mapInArrow(run, "doc_id long, lang string, words array<string>").toArrow()
    return train([(lang, words[k : k + SPAN]) for _, lang, words in sorted(zip(got["doc_id"].to_pylist(), got["lang"].to_pylist(), got["words"].to_pylist())) for k in range(0, len(words), SPAN)])


def label(texts: pa.Array, m: Model):
    """(offsets by text, marginals by word, whether each word has letters or digits)."""
    offsets, codes, words = tokens(texts)
    clean = cleaned(words)
    scores = np.zeros((len(words), len(m.languages)), np.float32)
    for lo in range(0, len(words), WORDS_AT_ONCE):
        hi = min(lo + WORDS_AT_ONCE, len(words))
        bucket, at = features(clean.slice(lo, hi - lo), m.lexicon)
        scores[lo:hi] = summed(m.weights[bucket], at)
    real = pc.not_equal(clean, "").to_numpy(zero_copy_only=False)
    em = factors(scores)[codes] if len(words) else np.ones((0, len(m.languages)), np.float32)
    post = forward_backward(em, offsets[:-1], np.diff(offsets), m.moves)
    return offsets, post, real[codes] if len(words) else np.zeros(0, bool)


def totals(offsets: np.ndarray, post: np.ndarray, real: np.ndarray):
    """(language, its expected share of the words with letters or digits, number of those) by text; -1 without any."""
    mass = summed(post * real[:, None], offsets)
    n = summed(real[:, None].astype(np.int64), offsets)[:, 0]
    lang = np.where(n > 0, mass.argmax(axis=1), -1) if len(mass) else np.zeros(0, int)
    return lang, mass.max(axis=1, initial=0) / np.maximum(n, 1), n


def kept_of(lang: np.ndarray, share: np.ndarray, m: Model) -> np.ndarray:
    return (lang >= 0) & (lang != len(m.languages) - 1) & (share >= LEAST_SHARE)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_LABELLED) -> DataFrame:
    """A row for every row of docs: its main language and expected share, mean confidence, spans of one language.

    Null, empty and wordless texts: lang null, share 0, no words, and they go. Signs between words take their
    neighbours' language. Without any named language in the table lang is null and every text with a word stays. Ties go
    to the first language by name. Whole texts count, however long; repeated rows are judged alike. Ids are cast to long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, most))
    item = pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])

    def run(batches):
        m = shared.value
        for b in steps(batches, size=2 * STEP_CHARS):
            if m is None:
                offsets, codes, words = tokens(b.column(1))
                real = pc.not_equal(cleaned(words), "").to_numpy(zero_copy_only=False).astype(np.int64)[codes]
                n = summed(real[:, None], offsets)[:, 0]
                none = np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.nulls(b.num_rows, pa.string()), pa.array(none), pa.array(none), pa.array(n.astype(np.int32)), pa.array(none.astype(np.int32)), pa.array(n > 0), array_of_lists(pa.array([], item), np.zeros(b.num_rows + 1))], ["doc_id", "lang", "share", "confidence", "n_words", "switches", "keep", "spans"])
                continue
            names = pa.array(m.languages)
            offsets, post, real = label(b.column(1), m)
            lang, share, n = totals(offsets, post, real)
            sure = summed(post.max(axis=1, keepdims=True), offsets)[:, 0] / np.maximum(np.diff(offsets), 1)
            best = post.argmax(axis=1)
            new = np.ones(len(best), bool)
            new[1:] = best[1:] != best[:-1]
            new[offsets[:-1][offsets[:-1] < len(best)]] = True
            first = np.flatnonzero(new)
            cuts = np.searchsorted(first, offsets)
            doc = np.searchsorted(offsets, first, "right") - 1
            length = np.diff(np.append(first, len(best)))
            spans = pa.StructArray.from_arrays([pa.array((first - offsets[doc]).astype(np.int32)), pa.array(length.astype(np.int32)), names.take(pa.array(best[first]))], fields=list(item))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), names.take(pa.array(lang, mask=lang < 0)), pa.array(np.round(share.astype(float), 6)), pa.array(np.round(sure.astype(float), 6)), pa.array(n.astype(np.int32)), pa.array(np.maximum(np.diff(cuts) - 1, 0).astype(np.int32)), pa.array(kept_of(lang, share, m)), array_of_lists(spans, cuts)],
                ["doc_id", "lang", "share", "confidence", "n_words", "switches", "keep", "spans"],
            )

    src = only(docs, doc_id=id_col, text=text_col)
    return src.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, LABELS)


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_LABELLED) -> DataFrame:
    """The documents mainly in one known language, with all their columns. Each row is judged by its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, most))

    def decide(texts: pa.Array) -> np.ndarray:
        m = shared.value
        if m is None:
            offsets, codes, words = tokens(texts)
            real = pc.not_equal(cleaned(words), "").to_numpy(zero_copy_only=False).astype(np.int64)[codes]
            return summed(real[:, None], offsets)[:, 0] > 0
        offsets, post, real = label(texts, m)
        lang, share, _ = totals(offsets, post, real)
        return kept_of(lang, share, m)

    return filtered(docs, text_col, decide)
