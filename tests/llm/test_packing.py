"""The plan against piece-by-piece simulation and exact search; every token placed once; hard rows."""

from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veriloom.llm import packing as P
from veriloom.llm import spm
from veriloom.llm.queries import TOKENIZER as FILE


def bins_of(placed):
    out = {}
    for length, rank, items, first, each, offset, fixed in placed:
        for k in range(items):
            out.setdefault(first + k // each, []).append((offset + k % each * length, length))
    return out


def simulated(lengths, capacity):
    room = []
    for x in sorted(lengths, reverse=True):
        fitting = [r for r in room if r >= x]
        if fitting:
            room[room.index(min(fitting))] -= x
        else:
            room.append(capacity - x)
    return sorted(room)


def fewest(lengths, capacity):
    @lru_cache(None)
    def go(rest):
        if not rest:
            return 0
        first, others, best = rest[-1], rest[:-1], len(rest)
        for mask in range(1 << len(others)):
            inside = [others[k] for k in range(len(others)) if mask >> k & 1]
            if first + sum(inside) <= capacity:
                best = min(best, 1 + go(tuple(others[k] for k in range(len(others)) if not mask >> k & 1)))
        return best

    return go(tuple(sorted(lengths)))


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_best_fit_is_piece_by_piece_best_fit(case):
    capacity, lengths = case
    it = P.Instance(np.bincount(lengths, minlength=capacity + 1), capacity)
    P.best_fit(it)
    assert sorted(capacity - sum(x for _, x in b) for b in bins_of(it.placed).values()) == simulated(lengths, capacity)


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_plan_places_everything_once(case):
    capacity, lengths = case
    placed, n = P.plan(np.bincount(lengths, minlength=capacity + 1), capacity)
    bins = bins_of(placed)
    assert len(bins) == n and sorted(x for b in bins.values() for _, x in b) == sorted(lengths)
    for b in bins.values():
        end = 0
        for at, x in sorted(b):
            assert at >= end
            end = at + x
        assert end <= capacity


@settings(max_examples=60, deadline=None)
@given(st.integers(5, 20).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=8))))
def test_fixed_sets_cost_no_bin(case):
    capacity, lengths = case
    counts = np.bincount(lengths, minlength=capacity + 1)
    for j in set(lengths):
        found = P.dominating(counts, j, capacity)
        if found:
            assert sum(found) <= capacity
            rest = list(lengths)
            for x in found:
                rest.remove(x)
            assert 1 + fewest(rest, capacity) == fewest(lengths, capacity)


def texts_of(rows, v):
    """The texts that the sequences' ids decode to, by document; pieces of a document in order."""
    from collections import defaultdict

    parts = defaultdict(dict)
    for r in rows:
        at = 0
        assert sum(r["lengths"]) == r["n_tokens"] == len(r["ids"])
        for doc, piece, start, n in zip(r["doc_ids"], r["pieces"], r["starts"], r["lengths"]):
            parts[doc].setdefault((piece, start), []).append(r["ids"][at : at + n])
            at += n
    out = {}
    for doc, got in parts.items():
        copies = min(map(len, got.values()))
        assert all(len(x) == copies for x in got.values())
        flat, starts = [], []
        for (_, start), x in sorted(got.items()):
            starts.append(start == len(flat))
            flat += x[0]
        assert all(starts)
        data, _ = spm.decode(np.array(flat), np.array([0, len(flat)]), v)
        out[doc] = data.tobytes().decode(), copies
    return out


def test_sequences_decode_to_every_text(spark, docs):
    rows = P.packed(docs, FILE).collect()
    want = {r["doc_id"]: (r["text"], 1) for r in docs.select("doc_id", "text").collect() if r["text"]}
    assert texts_of(rows, spm.vocabulary(FILE)) == want
    ids = {r["doc_id"]: r["n_tokens"] for r in spm.tokenized(docs, FILE).collect()}
    assert sum(r["n_tokens"] for r in rows) == sum(ids.values()) and max(r["n_tokens"] for r in rows) <= P.CAPACITY
    assert len({r["bin_id"] for r in rows}) == len(rows) <= 1.1 * -(-sum(ids.values()) // P.CAPACITY) + 1


def test_sequences_follow_the_plan(spark, docs):
    """The number of sequences, what fills each and which are fixed, against the plan of all lengths."""
    from collections import Counter

    capacity = 200
    lengths = [x for r in spm.tokenized(docs, FILE).collect() for x in [capacity] * (r["n_tokens"] // capacity) + [r["n_tokens"] % capacity] if x]
    placed, n = P.plan(np.bincount(lengths, minlength=capacity + 1), capacity)
    rows = P.packed(docs.repartition(5), FILE, capacity=capacity).collect()
    assert len(rows) == n and any(r["fixed"] for r in rows) and not all(r["fixed"] for r in rows)
    assert Counter(tuple(r["lengths"]) for r in rows) == Counter(tuple(x for _, x in sorted(b)) for b in bins_of(placed).values())
    fixed = {first + k // each for _, _, items, first, each, _, sure in placed for k in range(items) if sure}
    assert {r["bin_id"] for r in rows if r["fixed"]} == fixed


def test_hard_rows(hard, empty):
    rows = P.packed(hard, FILE).collect()
    got = texts_of(rows, spm.vocabulary(FILE))
    assert set(got) == {None, 1, 4, 5, 6, 7, 8} and got[1] == ("plain words of a short text here", 2)
    assert got[5][0] == "the quick word of many words " * 20_000 and got[7][0] == "é ▁ \x00 😀 日本語"
    assert P.packed(empty, FILE).count() == 0


@pytest.mark.parametrize("capacity", [1, 7, 4096])
def test_other_capacities(docs, capacity):
    rows = P.packed(docs.where("n_chars < 400").limit(20), FILE, capacity=capacity).collect()
    assert max(len(r["ids"]) for r in rows) <= capacity
