"""SentencePiece encoding and decoding in numpy: batched merges for BPE models, batched Viterbi for unigram models.

A text is cut into words where a space follows something else (no piece crosses such a place), so the best segmentation of
the text is that of its words. The distinct words of a batch are laid out by length and advance together. For Viterbi,
hashes of all substrings probe the sorted hashes of the pieces, and vectorised maxima store the backpointers. For a BPE
model every word joins its best-scored pair of neighbours, the leftmost of equal ones, until none is a piece, as the model
does. Scores are the model's own; characters without a piece become byte pieces, and so does a text's own MARK, which the
model itself would take for a space.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_CHARS, codepoints, gather, only, raw, steps

#: What a character without a piece costs, below the least score, as in unigram decoding.
PENALTY = 10.0
ENCODED = "doc_id long, ids array<int>, n_tokens int, n_bytes long, decodes boolean"
SPACE, MARK = " ", "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words longer than this are encoded one by one.
LONG = 256
#: Bytes of texts that are encoded at a time; a longer single text is encoded alone.
STEP_BYTES = STEP_CHARS
#: A process keeps the ids of so many words, of so many signs at most, from one batch to the next; others are encoded again.
KEPT_WORDS, KEPT_SIGNS = 100_000, 40


@dataclass
class Vocabulary:
    keys: np.ndarray  # sorted hashes of the pieces
    ids: np.ndarray  # of the pieces, by key
    scores: np.ndarray  # by key
    points: np.ndarray  # code points of the pieces, by key, padded with 0
    longest: int
    byte_ids: np.ndarray  # of the 256 byte pieces
    data: np.ndarray  # bytes of all pieces by id, in a row
    starts: np.ndarray  # of each id's bytes
    least: float
    maybe: np.ndarray  # whether any key has these upper bits after mixing: spares most probes
    table: dict  # pieces to (id, score)


def slots(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)


def hashes(points: np.ndarray) -> np.ndarray:
    """Hash of each row's prefixes: column k is of its first k code points."""
    out = np.zeros((len(points), points.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(points.shape[1]):
            out[:, k + 1] = out[:, k] * BASE + points[:, k].astype(np.uint64) + np.uint64(1)
    return out


@lru_cache(maxsize=4)
def vocabulary(model_file: str) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = m.get_piece_size()
    pieces = [m.id_to_piece(k) for k in range(n)]
    usable = [k for k in range(n) if not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k) or m.is_unused(k))]
    byte_ids = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    if not all(m.is_byte(int(k)) for k in byte_ids):
        raise ValueError("the model has no byte pieces, without which not every text can be encoded")
    if any(MARK in pieces[k].lstrip(MARK) for k in usable):
        raise ValueError("a piece crosses words")
    longest = max(len(pieces[k]) for k in usable)
    points = np.zeros((len(usable), longest), np.uint32)
    for row, k in enumerate(usable):  # with plain spaces, so that a text's own MARK stays apart from them
        points[row, : len(pieces[k])] = [ord(c) for c in pieces[k].replace(MARK, SPACE)]
    size = np.array([len(pieces[k]) for k in usable])
    keys = hashes(points)[np.arange(len(usable)), size]
    order = np.argsort(keys)
    if (np.diff(keys[order]) == 0).any():
        raise ValueError("two pieces have one hash")
    shown = [b"" if m.is_control(k) else bytes([int(pieces[k][3:5], 16)]) if m.is_byte(k) else "�".encode() if m.is_unknown(k) else pieces[k].replace(MARK, SPACE).encode() for k in range(n)]
    scores = np.array([m.get_score(k) for k in usable])
    maybe = np.zeros(1 << 20, bool)
    maybe[slots(keys)] = True
    return Vocabulary(keys[order], np.array(usable, np.int32)[order], scores[order], points[order], longest, byte_ids, np.frombuffer(b"".join(shown), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in shown]))), float(scores.min()), maybe, {pieces[k].replace(MARK, SPACE): (k, m.get_score(k)) for k in usable})


@dataclass
class Merges:
    chars: np.ndarray  # sorted code points that are symbols
    char_symbols: np.ndarray  # of each
    keys: np.ndarray  # sorted: left symbol * number of symbols + right symbol
    joined: np.ndarray  # the symbol that each pair makes
    rank: np.ndarray  # of each symbol by score, the greater the sooner
    ids: np.ndarray  # piece of each symbol, -1 for characters that are none
    table: dict  # keys to joined


@lru_cache(maxsize=4)
def merges(model_file: str) -> Merges | None:
    """The pairs that a BPE model joins; None for a model of another kind."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    spec = sentencepiece_model_pb2.ModelProto.FromString(m.serialized_model_proto()).trainer_spec
    if spec.model_type != spec.BPE:
        return None
    usable = [k for k in range(m.get_piece_size()) if not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k))]
    if any(m.is_unused(k) for k in usable):
        raise ValueError("a BPE model with unused pieces")
    symbols = {m.id_to_piece(k).replace(MARK, SPACE): i for i, k in enumerate(usable)}
    scores = [m.get_score(k) for k in usable]
    for piece in list(symbols):
        for c in piece:
            symbols.setdefault(c, len(symbols))
    table = {}
    for piece, i in symbols.items():
        for k in range(1, len(piece)):
            a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
            if a is not None and b is not None:
                table[a * len(symbols) + b] = i
    keys, joined = np.array(list(table), np.int64), np.array(list(table.values()), np.int32)
    order = np.argsort(keys)
    chars = sorted((ord(x), i) for x, i in symbols.items() if len(x) == 1)
    rank = np.zeros(len(symbols), np.int32)
    rank[: len(usable)] = np.unique(scores, return_inverse=True)[1]
    ids = np.full(len(symbols), -1, np.int32)
    ids[: len(usable)] = usable
    return Merges(np.array([c for c, _ in chars], np.uint32), np.array([i for _, i in chars], np.int32), keys[order], joined[order], rank, ids, table)


def merge(points: np.ndarray, v: Vocabulary, m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets by word) of the BPE segmentation of words of one length: rows of code points."""
    rows, length = points.shape
    at = np.minimum(np.searchsorted(m.chars, points), len(m.chars) - 1)
    symbol = np.where(m.chars[at] == points, m.char_symbols[at], -1).astype(np.int32)  # -1: no piece has it; -2: joined to the left

    def probe(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * len(m.ids) + b, -1)
        at = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
        return np.where(m.keys[at] == key, m.joined[at], -1)

    if length > LONG:
        for k in range(rows):
            symbol[k] = merge_long(symbol[k], m)
    else:
        left, right = np.tile(np.arange(length, dtype=np.int32) - 1, (rows, 1)), np.tile(np.arange(length, dtype=np.int32) + 1, (rows, 1))
        to = np.full((rows, length), -1, np.int32)
        to[:, :-1] = probe(symbol[:, :-1], symbol[:, 1:])
        rank = np.where(to >= 0, m.rank[to], -1)
        live = np.arange(rows)
        while len(live):
            k = rank[live].argmax(axis=1)
            some = rank[live, k] >= 0
            live, k = live[some], k[some]
            gone = right[live, k]
            after = right[live, gone]
            symbol[live, k], symbol[live, gone], rank[live, gone], right[live, k] = to[live, k], -2, -1, after
            ends = after >= length
            to[live, k] = np.where(ends, -1, probe(symbol[live, k], symbol[live, np.minimum(after, length - 1)]))
            rank[live, k] = np.where(to[live, k] >= 0, m.rank[to[live, k]], -1)
            left[live[~ends], after[~ends]] = k[~ends]
            before = left[live, k]
            r, b, k = live[before >= 0], before[before >= 0], k[before >= 0]
            to[r, b] = probe(symbol[r, b], symbol[r, k])
            rank[r, b] = np.where(to[r, b] >= 0, m.rank[to[r, b]], -1)
    row, start = np.nonzero(symbol != -2)
    found = symbol[row, start]
    return with_bytes(points, row, start, np.where(found >= 0, m.ids[found], -1).astype(np.int32), v)


def merge_long(symbol: np.ndarray, m: Merges) -> list[int]:
    """The symbols of one word after all joins, -2 where one was joined to the left."""
    s, length, n = symbol.tolist(), len(symbol), len(m.ids)
    left, right, heap = list(range(-1, length - 1)), list(range(1, length + 1)), []

    def offer(a: int, b: int):
        if s[a] >= 0 and s[b] >= 0 and (t := m.table.get(s[a] * n + s[b])) is not None:
            heapq.heappush(heap, (-int(m.rank[t]), a, s[a], b, s[b], t))

    for k in range(length - 1):
        offer(k, k + 1)
    while heap:
        _, a, x, b, y, t = heapq.heappop(heap)
        if s[a] != x or s[b] != y or right[a] != b:
            continue
        s[a], s[b], right[a] = t, -2, right[b]
        if right[a] < length:
            left[right[a]] = a
            offer(a, right[a])
        if left[a] >= 0:
            offer(left[a], a)
    return s


def viterbi(points: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets by word) of the best segmentation of words of one length: rows of code points.

    Of equal scores the segmentation whose last piece is longer is taken. A character without a piece costs least - PENALTY.
    """
    rows, length = points.shape
    if length > LONG:
        return viterbi_long(points, v)
    h = hashes(points)
    best, back, piece = np.full((length + 1, rows), -np.inf), np.zeros((length + 1, rows), np.int32), np.full((length + 1, rows), -1, np.int32)
    best[0] = 0
    power = np.ones(v.longest + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(v.longest):
            power[k + 1] = power[k] * BASE
        for end in range(1, length + 1):
            for size in range(min(end, v.longest), 0, -1):
                start = end - size
                key = h[:, end] - h[:, start] * power[size]
                hit = np.flatnonzero(v.maybe[slots(key)])
                at = np.minimum(np.searchsorted(v.keys, key[hit]), len(v.keys) - 1)
                found = v.keys[at] == key[hit]
                hit, at = hit[found], at[found]
                if len(hit):
                    same = (v.points[at, :size] == points[hit, start:end]).all(axis=1)
                    hit, at = hit[same], at[same]
                    total = best[start, hit] + v.scores[at]
                    better = total > best[end, hit]
                    hit, at = hit[better], at[better]
                    best[end, hit], back[end, hit], piece[end, hit] = total[better], start, v.ids[at]
            total = best[end - 1] + (v.least - PENALTY)
            lone = np.flatnonzero(total > best[end])
            best[end, lone], back[end, lone], piece[end, lone] = total[lone], end - 1, -1
    here, live = np.full(rows, length), np.arange(rows)
    taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        e = here[live]
        taken.append((live, back[e, live], piece[e, live]))
        here[live] = back[e, live]
        live = live[here[live] > 0]
    row, start, ids = (np.concatenate([t[k] for t in taken]) for k in range(3))
    order = np.lexsort((start, row))
    return with_bytes(points, row[order], start[order], ids[order], v)


def viterbi_long(points: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The same for words too long to pay for a step of numpy at every place: one by one, with a table of pieces."""
    rows, length = points.shape
    row, begin, out = [], [], []
    for k in range(rows):
        word = "".join(map(chr, points[k].tolist()))
        best, back, piece = [0.0] + [-np.inf] * length, [0] * (length + 1), [-1] * (length + 1)
        for end in range(1, length + 1):
            top, at, chosen = -np.inf, end - 1, -1
            for start in range(max(0, end - v.longest), end):
                if (found := v.table.get(word[start:end])) is not None and (total := best[start] + found[1]) > top:
                    top, at, chosen = total, start, found[0]
            if (total := best[end - 1] + (v.least - PENALTY)) > top:
                top, at, chosen = total, end - 1, -1
            best[end], back[end], piece[end] = top, at, chosen
        taken, here = [], length
        while here:
            taken.append((back[here], piece[here]))
            here = back[here]
        for start, p in reversed(taken):
            row.append(k), begin.append(start), out.append(p)
    return with_bytes(points, np.array(row), np.array(begin), np.array(out, np.int32), v)


def with_bytes(points: np.ndarray, row: np.ndarray, start: np.ndarray, ids: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets by row) of pieces in order; -1 stands for the character at (row, start) in bytes."""
    rows = len(points)
    lone = np.flatnonzero(ids < 0)
    if len(lone):  # byte pieces, one to four for each character
        c = points[row[lone], start[lone]]
        data, at = raw(pa.array([chr(x) for x in c.tolist()], pa.string()))
        n = np.ones(len(ids), np.int64)
        n[lone] = np.diff(at)
        first = np.cumsum(n) - n
        out = np.repeat(ids, n)
        out[gather(first[lone], n[lone])] = v.byte_ids[data]
        row, ids = np.repeat(row, n), out
    return ids, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows))))


def encode_words(words: pa.Array, v: Vocabulary, cells: int = 1_000_000, m: Merges | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets by word) of distinct words, those of equal length together; by merges if there are any."""
    points, at = codepoints(words)
    n = np.diff(at)
    order = np.argsort(n, kind="stable")
    ids, sizes = [], []
    lo = int(np.searchsorted(n[order], 1))
    while lo < len(order):
        length = int(n[order[lo]])
        hi = min(int(np.searchsorted(n[order], length, "right")), lo + max(1, cells // length))
        rows = order[lo:hi]
        laid = points[at[rows, None] + np.arange(length)]
        got, cut = viterbi(laid, v) if m is None else merge(laid, v, m)
        ids.append(got), sizes.append(np.diff(cut))
        lo = hi
    size = np.zeros(len(words), np.int64)
    size[order[len(order) - sum(map(len, sizes)) :]] = np.concatenate(sizes) if sizes else 0
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    begin = np.zeros(len(words), np.int64)
    begin[order] = np.cumsum(size[order]) - size[order]
    return flat[gather(begin, size)].astype(np.int32), np.concatenate(([0], np.cumsum(size)))


class Known:
    """Ids of words that a process has encoded before, under one vocabulary: those of the word at place[k] are ids[at[k] : at[k + 1]]."""

    def __init__(self):
        self.place, self.ids, self.at = None, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encoded(self, words: pa.Array, v: Vocabulary, m: Merges | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by word) of distinct words; only those not known yet are encoded. Past KEPT_WORDS those of this batch stay."""
        if self.place is None or self.place.type != words.type:
            self.place, self.ids, self.at = pa.array([], words.type), np.zeros(0, np.int32), np.zeros(1, np.int64)
        place = pc.fill_null(pc.index_in(words, value_set=self.place), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        fresh = words.take(pa.array(new))
        ids, cuts = encode_words(fresh, v, m=m)
        place[new] = len(self.at) - 1 + np.arange(len(new))
        every, at = np.concatenate((self.ids, ids)), np.concatenate((self.at, len(self.ids) + cuts[1:]))
        n = np.diff(at)[place]
        out = every[gather(at[place], n)], np.concatenate(([0], np.cumsum(n)))
        short = pc.less_equal(pc.utf8_length(fresh), KEPT_SIGNS).to_numpy(zero_copy_only=False)
        if len(self.place) + short.sum() > KEPT_WORDS:
            keep = np.flatnonzero(pc.less_equal(pc.utf8_length(words), KEPT_SIGNS).to_numpy(zero_copy_only=False))[:KEPT_WORDS]
            self.place, self.ids, self.at = words.take(pa.array(keep)), every[gather(at[place[keep]], n[keep])], np.concatenate(([0], np.cumsum(n[keep])))
        elif short.any():
            kept = new[short]
            self.place = pa.concat_arrays([self.place, words.take(pa.array(kept))])
            self.ids = np.concatenate((self.ids, every[gather(at[place[kept]], n[kept])]))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(n[kept])))
        return out


def encode(texts: pa.Array, v: Vocabulary, m: Merges | None = None, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets by text), by merges if there are any, else of the best total score. A space is put before each text, as the model asks; null and empty texts have no ids."""
    texts = pc.fill_null(texts, "")
    spaced = pc.if_else(pc.not_equal(texts, ""), pc.binary_join_element_wise(SPACE, texts, ""), "")
    cut = next(c for c in map(chr, chain([0], range(0xF0000, 0x110000))) if not pc.any(pc.match_substring(texts, c)).as_py())
    lists = pc.split_pattern(pc.replace_substring_regex(spaced, "([^ ]) ", f"\\1{cut} "), cut)
    at = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    ids, cuts = (known or Known()).encoded(words.dictionary, v, m)
    code = words.indices.to_numpy(zero_copy_only=False)
    n = (cuts[1:] - cuts[:-1])[code] if len(code) else np.zeros(0, np.int64)
    total = np.concatenate(([0], np.cumsum(n)))
    return ids[gather(cuts[code], n)] if len(code) else ids[:0], total[at - at[0]]


def decode(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets by text) of texts of ids, without the space before each."""
    n = (v.starts[1:] - v.starts[:-1])[ids]
    data = v.data[gather(v.starts[ids], n)]
    at = np.concatenate(([0], np.cumsum(n)))[offsets]
    full = np.flatnonzero(np.diff(at) > 0)
    spaced = full[data[at[full]] == 0x20]
    keep = np.ones(len(data), bool)
    keep[at[spaced]] = False
    lost = np.zeros(len(at), np.int64)
    lost[spaced + 1] = 1
    return data[keep], at - np.cumsum(lost)


def tokenized(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every row of docs: its piece ids, their number, the text's bytes, and if the ids decode to the very text.

    A null text has null ids and decodes (to null); an empty one has none. Rows may repeat. Very long texts, and texts
    without any space, are encoded whole. Ids are cast to long. The model file must be at the same path on every executor.
    """

    def run(batches):
        v, m, known = vocabulary(model_file), merges(model_file), Known()
        for b in steps(batches, size=STEP_BYTES):
            text = b.column(1)
            ids, offsets = encode(text, v, m, known)
            data, at = decode(ids, offsets, v)
            was, starts = raw(pc.fill_null(text, ""))
            if np.array_equal(data, was) and np.array_equal(at, starts):
                same = np.ones(b.num_rows, bool)
            else:
                same = np.array([np.array_equal(data[at[k] : at[k + 1]], was[starts[k] : starts[k + 1]]) for k in range(b.num_rows)])
            listed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pc.is_null(text))
            yield pa.RecordBatch.from_arrays([b.column(0), listed, pa.array(np.diff(offsets).astype(np.int32)), pa.array(np.diff(starts)), pa.array(same)], ["doc_id", "ids", "n_tokens", "n_bytes", "decodes"])

    src = only(docs, doc_id=id_col, text=text_col)
    return src.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED)


def detokenized(rows: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of piece ids; null ids give a null text, and bytes that are no UTF-8 give U+FFFD."""

    def run(batches):
        v = vocabulary(model_file)
        for b in batches:
            lists = b.column(1)
            flat, n = lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            data, at = decode(flat, np.concatenate(([0], np.cumsum(n))), v)
            none = pc.is_null(lists).to_pylist()
            texts = [None if none[k] else data[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace") for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    src = only(rows, doc_id=id_col, ids=ids_col)
    return src.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
