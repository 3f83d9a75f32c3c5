"""Near duplicates against brute force over all pairs, planted copies, and hard rows."""

import numpy as np
import pyarrow as pa
import pytest

from veriloom.llm import simhash as S
from veriloom.llm.common import shared_dir


def brute_groups(ids, texts):
    """Group by id over all pairs of fingerprints."""
    fps, n = S.sketch(pa.array(texts, pa.string()), S.planes())
    fp, label = S.words64(fps), {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            if n[a] and n[b]:
                if S.distance(fp[a], fp[b]) <= S.RADIUS:
                    x, y = find(ids[a]), find(ids[b])
                    label[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_groups_match_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    want = brute_groups([r[0] for r in rows], [r[1] for r in rows])
    got = {r["doc_id"]: r["group_id"] for r in S.near_duplicates(docs).collect()}
    assert got == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("leaf_rows", [4, 16, 1000])
def test_triangle_bounds_lose_no_pair(leaf_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (60, 4), dtype=np.uint64)
    fp = np.repeat(base, 5, axis=0)
    fp[:, 1] ^= rng.integers(0, 1 << 20, len(fp), dtype=np.uint64)
    tree = S.grow(fp, leaf_rows)
    leaf = S.leaves(tree, fp)
    assert (leaf.max() == 0) == (leaf_rows == 1000)
    for r in (2, 20, S.RADIUS):
        near = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) <= r
        for k in range(leaf.max() + 1):
            assert S.reaching(tree, k, k, fp, r)[near[leaf == k].any(axis=0)].all()
    cut = S.reaching(tree, 0, 0, fp, 2)
    assert cut[leaf == 0].all() and (leaf_rows == 1000 or not cut.all())
    for width in (7, 64):
        got = [p for i, j in S.pairs_within(fp, fp, 20, True, 16, width) for p in zip(i.tolist(), j.tolist())]
        want = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) <= 20
        assert sorted(got) == list(zip(*(x.tolist() for x in np.nonzero(np.triu(want, 1)))))
        got = [p for i, j in S.pairs_within(fp[:40], fp[40:], 20, False, 16, width) for p in zip(i.tolist(), j.tolist())]
        assert sorted(got) == list(zip(*(x.tolist() for x in np.nonzero(want[:40, 40:]))))


def test_many_shards_through_the_query(spark):
    """13,000 different texts, more than a shard holds, a third of the rows copies of one, near copies planted far apart."""
    words = [f"w{k}" for k in range(5000)]
    rng = np.random.default_rng(8)
    texts = [[words[k] for k in row] for row in rng.integers(0, 5000, (13_000, 14))]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    near = {}
    for k in range(0, 13_000, 65):
        near[20_000 + k] = k
        rows.append((20_000 + k, " ".join([*texts[k][:13], "changed"])))
    rows += [(40_000 + k, rows[7][1]) for k in range(6600)]
    fps, _ = S.sketch(pa.array([t for _, t in rows[: 13_000 + len(near)]]), S.planes())
    fp, at = S.words64(fps), [i for i, _ in rows[: 13_000 + len(near)]]
    label = np.arange(len(fp))
    for lo in range(0, len(fp), 500):
        d = sum(np.bitwise_count(fp[lo : lo + 500, None, k] ^ fp[None, :, k]).astype(np.int16) for k in range(4))
        i, j = np.nonzero(d <= S.RADIUS)
        S.unite(label, i + lo, j)
    while (label[label] != label).any():
        label = label[label]
    want = {i: at[k] for i, k in zip(at, label)} | {40_000 + k: at[label[7]] for k in range(6600)}
    got = {r["doc_id"]: r["group_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == want
    assert np.mean([got[a] == got[b] for a, b in near.items()]) > 0.9


def test_short_texts_are_compared(spark):
    rows = [(1, "alpha beta gamma"), (2, "Alpha, beta gamma!"), (3, "delta epsilon zeta"), (4, "alpha"), (5, "Alpha."), (6, "omega"), (7, "one two three four five six seven"), (8, "one two three four five six eight")]
    got = {r["doc_id"]: r["group_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(*zip(*rows))
    assert got[2] == 1 and got[5] == 4 and got[3] == 3 and got[6] == 6 and got[8] == 7


def test_planted_copies_are_found_and_others_left(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(4000)]
    texts = [[vocabulary[k] for k in rng.integers(0, 4000, rng.integers(60, 400))] for _ in range(60)]
    rows, near = [], {}
    for k, words in enumerate(texts):
        rows.append((k, " ".join(words)))
        copy = list(words)
        for at in rng.choice(len(words), max(1, len(words) // 25), replace=False):
            copy[at] = vocabulary[rng.integers(0, 4000)]
        rows.append((1000 + k, " ".join(copy)))
        near[1000 + k] = k
        rows.append((2000 + k, " ".join(words).upper() + "!"))
        near[2000 + k] = k
    got = {r["doc_id"]: r["group_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([got[a] == got[b] for a, b in near.items()]) >= 0.95
    assert all(got[k] == k for k in range(60))


def test_contained_texts_of_other_sizes_are_found(spark):
    rng = np.random.default_rng(5)
    texts = [["w" + str(x) for x in rng.integers(0, 10**6, 400)] for _ in range(20)]
    rows = [(k, " ".join(words)) for k, words in enumerate(texts)] + [(1000 + k, " ".join(words[:300])) for k, words in enumerate(texts)]
    got = {r["doc_id"]: r["group_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 1000 for i in got} and len(got) == 40


def test_strips_group_by_plain_hamming_distance(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "SHARD_ROWS", 12)
    monkeypatch.setattr(S, "STRIP", 3)
    rows = docs.select("doc_id", "text").collect()
    want = brute_groups([r[0] for r in rows], [r[1] for r in rows])
    assert {r["doc_id"]: r["group_id"] for r in S.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("r", [0, 2, 20, S.RADIUS, 130])
def test_keys_lose_no_pair(r):
    """Rows at every distance up to 2 r of some others, whose differing bits lie anywhere or all in one word."""
    rng = np.random.default_rng(r)
    base = rng.integers(0, 1 << 63, (12, 4), dtype=np.uint64)
    fp = np.repeat(base, 12, axis=0)
    for k in range(len(fp)):
        most = 64 if k % 3 == 0 else 256
        for bit in rng.choice(most, min(most, rng.integers(0, 2 * r + 2)), replace=False):
            fp[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) <= r
    apart, cut = np.arange(len(fp)), 60
    for bits in (None, 0, 5, 16):
        for cells, width in ((1 << 16, 8192), (64, 7)):
            same = [p for x in S.places(r) for i, j in S.pairs_by_key(fp, fp, r, x, apart, apart, True, bits, cells, width) for p in zip(i.tolist(), j.tolist())]
            assert {(min(p), max(p)) for p in same} == set(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))
            got = [p for x in S.places(r) for i, j in S.pairs_by_key(fp[:cut], fp[cut:], r, x, apart[:cut], apart[cut:], False, bits, cells, width) for p in zip(i.tolist(), j.tolist())]
            assert set(got) == set(zip(*(x.tolist() for x in np.nonzero(near[:cut, cut:]))))


def test_keys_leave_out_most_pairs(monkeypatch):
    """Of the pairs of 20,000 unlike rows, all places together compare under an eighth."""
    fp, met = np.random.default_rng(4).integers(0, 1 << 63, (20_000, 4), dtype=np.uint64) * np.uint64(2654435761), []
    take = S.gather
    monkeypatch.setattr(S, "gather", lambda starts, lengths: met.append(len(at := take(starts, lengths))) or at)
    for x in S.places(S.RADIUS):
        _, _, start = S.keyed(fp, x[0], x[1], 16)
        rows, since = np.diff(start)[np.diff(start) > 0], len(met)
        apart = np.arange(len(fp))
        assert not list(S.pairs_by_key(fp, fp, S.RADIUS, x, apart, apart, True, 16))
        met[since:] = [sum(n * m for n, m in zip(rows.tolist(), met[since:]))]
    assert sum(met) < len(fp) ** 2 / 2 / 8


def test_large_groups_under_keys(monkeypatch):
    """3000 near copies of one row, and of another: labels leave out what is joined, and join all the same."""
    rng = np.random.default_rng(6)
    fp = np.repeat(rng.integers(0, 1 << 63, (2, 4), dtype=np.uint64), 3000, axis=0)[rng.permutation(6000)]
    fp[:, 3] ^= np.uint64(1) << rng.integers(0, 40, len(fp), dtype=np.uint64)
    label = np.arange(len(fp))
    for i, j in S.pairs_by_key(fp, fp, S.RADIUS, S.places(S.RADIUS)[0], label, label, True, 4):
        S.unite(label, i, j)
        while ((x := label[label]) != label).any():
            label[:] = x
    first = [int(np.flatnonzero(fp[:, 0] == w)[0]) for w in fp[:, 0]]
    assert label.tolist() == first


@pytest.mark.parametrize("shard_rows", [12, 300])
def test_strips_with_keys_match_brute_force(spark, docs, monkeypatch, shard_rows):
    monkeypatch.setattr(S, "FEW", 0)
    monkeypatch.setattr(S, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(S, "STRIP", 5)
    rows = docs.select("doc_id", "text").collect()
    want = brute_groups([r[0] for r in rows], [r[1] for r in rows])
    assert {r["doc_id"]: r["group_id"] for r in S.near_duplicates(docs).collect()} == want


def test_long_chains_are_one_group(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 50), (7, 7)], "a long, b long")
    got = dict(tuple(r) for r in S.components(edges, shared_dir(spark)).collect())
    assert got == {k: 0 for k in range(1, 41)} | {100: 50}


def test_hard_rows(spark, hard, empty):
    rows = {r["doc_id"]: r for r in S.near_duplicates(hard).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6, 7, 8}
    assert rows[8]["group_id"] == 1 and not rows[8]["keep"] and rows[1]["keep"]
    assert all(rows[k]["n_features"] == 0 and rows[k]["keep"] for k in (2, 3, 4, 6))
    stay = S.deduplicated(hard)
    assert stay.columns == hard.columns
    assert sorted(r["doc_id"] or -1 for r in stay.collect()) == [-1, 1, 1, 2, 3, 4, 5, 6, 7]
    assert S.near_duplicates(empty).count() == 0 and S.deduplicated(empty).count() == 0
