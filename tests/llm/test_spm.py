"""Viterbi against plain dynamic programming, exact round trips, and hard rows."""

import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veriloom.llm import queries as Q
from veriloom.llm import spm as P

FILE = Q.TOKENIZER
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary file")


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=FILE)
    return {m.id_to_piece(k).replace(P.MARK, " "): (k, m.get_score(k)) for k in range(m.get_piece_size()) if not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k))}, m


def brute(text, pieces, m):
    """Best score of the whole text, not cut into words, and the ids' score."""
    table, least = pieces[0], P.vocabulary(FILE).least
    text, best = " " + text, [0.0]
    for e in range(1, len(text) + 1):
        top = best[e - 1] + least - P.PENALTY
        for s in range(max(0, e - 48), e):
            if (x := table.get(text[s:e])) is not None:
                top = max(top, best[s] + x[1])
        best.append(top)
    return best[-1]


def score_of(ids, m):
    total, k, least = 0.0, 0, P.vocabulary(FILE).least
    while k < len(ids):
        if m.is_byte(int(ids[k])):
            lead = int(m.id_to_piece(int(ids[k]))[3:5], 16)
            total += least - P.PENALTY
            k += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        else:
            total += m.get_score(int(ids[k]))
            k += 1
    return total


def check(texts, pieces):
    v = P.vocabulary(FILE)
    ids, at = P.encode(pa.array(texts, pa.string()), v)
    data, cut = P.decode(ids, at, v)
    for k, t in enumerate(texts):
        assert data[cut[k] : cut[k + 1]].tobytes() == (t or "").encode()
        if t:
            assert abs(score_of(ids[at[k] : at[k + 1]], pieces[1]) - brute(t, pieces, pieces[1])) < 1e-6
        else:
            assert at[k] == at[k + 1]


def test_best_scores_and_round_trips(pieces):
    check(["hello world", "", None, "  two  blanks ", " ", "\n\ttabs\n", "naïve café 日本 😀 \x00 ▁ ▁▁", "a" * 70, "the " * 50, "Ünïcödé\r\n", "￿𐀀"], pieces)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=24), max_size=6))
def test_any_text(pieces, texts):
    check([t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)], pieces)


def test_query_round_trips(spark, docs):
    rows = P.tokenized(docs, FILE)
    assert rows.where("not decodes").count() == 0 and rows.count() == docs.count()
    back = {r["doc_id"]: r["text"] for r in P.detokenized(rows, FILE).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_hard_rows(hard, empty):
    rows = P.tokenized(hard, FILE).collect()
    assert len(rows) == hard.count() and all(r["decodes"] for r in rows)
    assert all(r["ids"] is None for r in rows if r["doc_id"] == 2) and all(r["ids"] == [] for r in rows if r["doc_id"] == 3)
    assert P.tokenized(empty, FILE).count() == 0 and P.detokenized(P.tokenized(empty, FILE), FILE).count() == 0
    texts = {r["doc_id"]: r["text"] for r in P.detokenized(P.tokenized(hard, FILE), FILE).collect()}
    assert texts[2] is None and texts[3] == "" and texts[7] == "é ▁ \x00 😀 日本語"


def test_words_of_equal_length_advance_together():
    v = P.vocabulary(FILE)
    words = [" the", " cat", " sat", " and"]
    alone = [P.encode_words(pa.array([w]), v)[0].tolist() for w in words]
    ids, at = P.encode_words(pa.array(words), v)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == alone
    assert np.array_equal(at, np.sort(at))


def test_query_gives_the_models_own_ids(spark, docs, pieces):
    odd = ["hello world", "  two  blanks ", " ", " " * 300 + "x", "\n\ttabs\n", "naïve café 日本 😀", "a" * 70, "banana" * 200 + " the", "Ünïcödé\r\n", "￿𐀀"]
    texts = odd + [r["text"] for r in docs.select("text").collect() if r["text"] and P.MARK not in r["text"]]
    rows = P.tokenized(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), FILE).collect()
    assert len(rows) == len(texts) and all(r["decodes"] for r in rows)
    for r in rows:
        assert r["ids"] == pieces[1].encode(texts[r["doc_id"]])


def test_long_words_merge_as_short_ones(monkeypatch):
    words = pa.array([" banana", "ananas", " transformations", "    ", "日本語x"])
    want = P.encode_words(words, P.vocabulary(FILE), m=P.merges(FILE))
    monkeypatch.setattr(P, "LONG", 0)
    got = P.encode_words(words, P.vocabulary(FILE), m=P.merges(FILE))
    assert all(np.array_equal(a, b) for a, b in zip(got, want))


def test_long_words_go_as_short_ones(monkeypatch):
    rng = np.random.default_rng(3)
    words = pa.array(["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in (40, 90, 91, 200)])
    want = P.encode_words(words, P.vocabulary(FILE))
    monkeypatch.setattr(P, "LONG", 30)
    got = P.encode_words(words, P.vocabulary(FILE))
    assert all(np.array_equal(a, b) for a, b in zip(got, want))


@pytest.mark.parametrize("kind", ["merges", "viterbi"])
def test_a_megabyte_without_spaces(kind):
    import time

    v, m = P.vocabulary(FILE), P.merges(FILE) if kind == "merges" else None
    text = "".join(chr(97 + c) for c in np.random.default_rng(0).integers(0, 26, 1 << (20 if m else 18)))
    began = time.perf_counter()
    ids, at = P.encode(pa.array([text]), v, m)
    assert time.perf_counter() - began < 60 and P.decode(ids, at, v)[0].tobytes() == text.encode()


def test_known_words_are_encoded_alike(monkeypatch, docs):
    texts = pa.array([r["text"] for r in docs.select("text").limit(60).collect()])
    v, m = P.vocabulary(FILE), P.merges(FILE)
    want, at = P.encode(texts, v, m)
    for most in (10**6, 300):
        monkeypatch.setattr(P, "KEPT_WORDS", most)
        known, ids = P.Known(), []
        for lo in range(0, 60, 7):
            ids.append(P.encode(texts.slice(lo, 7), v, m, known)[0])
        assert np.array_equal(np.concatenate(ids), want) and len(known.place) <= most
