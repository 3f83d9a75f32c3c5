"""The learned scorer: gradients by differences, a span found in long texts, windows."""

import numpy as np

from veriloom.operators import learned as L


def rows(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        words = [f"word{x}" for x in rng.integers(0, 400, 60)]
        if k % 2:
            at = rng.integers(0, 55)
            words[at : at + 3] = ["please", "disregard", "rules"]
        out.append((k, " ".join(words), k % 2))
    return out


def test_gradients():
    m, words = L.fresh(), np.array([5, 9, 5, 77])
    grads, _ = m.gradients(words, 1)
    for part, grad in list(zip(m.parts(), grads))[1:]:
        for at in [tuple(x) for x in np.argwhere(np.ones(part.shape))[:4]]:
            old, e = part[at], 1e-5
            part[at] = old + e
            up = m.gradients(words, 1)[1]
            part[at] = old - e
            down = m.gradients(words, 1)[1]
            part[at] = old
            assert abs((up - down) / (2 * e) - grad[at]) < 1e-6
    old, e = m.table[9].copy(), 1e-5
    m.table[9, 0] = old[0] + e
    up = m.gradients(words, 1)[1]
    m.table[9, 0] = old[0] - e
    assert abs((up - m.gradients(words, 1)[1]) / (2 * e) - grads[0][1, 0]) < 1e-6


def test_a_short_span_decides(spark):
    train = spark.createDataFrame(rows(400, 1), "id int, text string, label int")
    m = L.train(train)
    long = [(k, (" ".join(f"word{x % 400}" for x in range(1200)) + " " + t) if k % 3 == 0 else t) for k, t, _ in rows(60, 2)] + [(900, ""), (901, None)]
    got = {r["id"]: r for r in L.scored(spark.createDataFrame(long, "id int, text string"), m, "id").collect()}
    right = [got[k]["should_block"] == bool(k % 2) for k in range(60)]
    assert np.mean(right) > 0.9 and got[900]["score"] == got[901]["score"] == 0
    blocked = [r for k, r in got.items() if k < 900 and k % 2 and r["should_block"]]
    assert np.mean([bool({"please", "disregard", "rules"} & {t["token"] for t in r["tokens"]}) for r in blocked]) > 0.9
    assert got[3]["span"][1] > 4000
