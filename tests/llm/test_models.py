"""Quality and language: held-out accuracy, exact neighbours and marginals by brute force, hard rows."""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veriloom.llm import langid as L
from veriloom.llm import quality as Q
from veriloom.llm.common import only

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fit = labels.where("doc_id % 3 <> 0")
    got = Q.classified(docs, fit).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    said = got.quality_score >= Q.REJECT_BELOW
    assert (said == (got.quality == 1)).mean() > 0.93
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    assert clean.keep.mean() > 0.97


def test_toxic_documents_are_found_in_every_language(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = labels.where("doc_id % 3 = 0")
    asked = docs.join(F.broadcast(held.select("doc_id")), "doc_id")
    m = Q.fit(docs, labels.where("doc_id % 3 <> 0"))
    rows = asked.join(F.broadcast(held), "doc_id").select("text", "lang", "toxic").toPandas()
    said = Q.score(pa.array(rows.text, pa.string()), m)[1] >= Q.REJECT_BELOW
    recall = {g: said[(rows.toxic == 1) & (rows.lang == g)].mean() for g in ("en", "de", "fr", "es")}
    print(recall, said[rows.toxic == 1].sum(), (rows.toxic == 1).sum(), said[rows.toxic == 0].sum(), (rows.toxic == 0).sum())
    assert said[rows.toxic == 1].mean() > 0.8 and min(recall.values()) > 0.5
    assert said[rows.toxic == 0].mean() < 0.01


def test_votes_are_of_the_exact_neighbours():
    rng = np.random.default_rng(0)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    known, asked = unit(rng.standard_normal((300, 8))), unit(rng.standard_normal((700, 8)))
    labels = rng.integers(0, 2, 300)
    m = Q.Model(np.zeros(1, np.uint64), np.zeros(1, np.float32), np.zeros((1, 8), np.float32), known, labels, 1 - labels)
    got, other = Q.vote(asked, m, 9)
    for k in range(0, 700, 13):
        cos = known @ asked[k]
        top = np.argsort(-cos)[:9]
        w = np.maximum(cos[top], 0).astype(float) ** 4 + 1e-9
        assert abs(got[k] - (w * labels[top]).sum() / w.sum()) < 1e-5
        assert abs(got[k] + other[k] - 1) < 1e-9


def test_ties_go_to_the_first_labelled():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 8)).astype(np.float32)
    known = np.repeat(base, 25, axis=0)
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    order = rng.permutation(len(known))
    known, labels = known[order], rng.integers(0, 2, len(known))
    m = Q.Model(np.zeros(1, np.uint64), np.zeros(1, np.float32), np.zeros((1, 8), np.float32), known, labels, 1 - labels)
    asked = np.concatenate((base, rng.standard_normal((60, 8)))).astype(np.float32)
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    got = Q.vote(asked, m, 15)[0]
    for k in range(100):
        cos = np.rint(known.astype(float) @ asked[k] * (1 << 20))
        group = np.argsort(-cos, kind="stable")[:15]
        w = np.maximum(cos[group] / (1 << 20), 0) ** 4 + 1e-9
        assert abs(got[k] - (w * labels[group]).sum() / w.sum()) < 1e-4, k


def plain_counts(text):
    """Counts of the features of one text, word by word."""
    import collections

    words, out = text.split(), collections.Counter()
    for k, w in enumerate(words):
        for h in Q.features(pa.array([w])):
            if h[0]:
                out[int(h[0])] += 1
        out[int(Q.REPEAT)] += k > 0 and w == words[k - 1]
    return out


def plain_vote(m, x, labels):
    x = x / max(np.linalg.norm(x), 1e-12) @ m.axes.astype(float)
    if not x.any():
        return None
    cos = np.rint(m.vectors.astype(float) @ (x / np.linalg.norm(x)) * (1 << 20))
    top = np.argsort(-cos, kind="stable")[: Q.NEIGHBOURS]
    w = np.maximum(cos[top] / (1 << 20), 0) ** 4 + 1e-9
    return (w * labels[top]).sum() / w.sum()


def test_classified_matches_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = Q.fit(docs, labels)
    got = {r["doc_id"]: r for r in Q.classified(docs, labels).collect()}
    off = 0
    for r in docs.where("n_chars < 1500").select("doc_id", "text").limit(15).collect():
        n = plain_counts(r["text"])
        x = np.array([(1 + np.log(n[int(h)])) * w if n[int(h)] else 0.0 for h, w in zip(m.known, m.weight)])
        t = np.array([*(w if n[int(h)] else 0.0 for h, w in zip(m.own.known, m.own.weight)), m.own.shared])
        quality, toxic = plain_vote(m, x, m.quality) or 0.0, plain_vote(m.own, t, m.own.toxic) if n else 0.0
        row = got[r["doc_id"]]
        off += abs(row["quality_score"] - quality) > 1e-3 or abs(row["toxic_score"] - toxic) > 1e-3
        assert row["keep"] == (row["quality_score"] >= Q.REJECT_BELOW and row["toxic_score"] < Q.REJECT_BELOW)
    assert off <= 1  # neighbours whose cosines differ by less than single precision


def test_quality_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 0, 0), (None, 1, 0), (5, None, 1), (99, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    rows = Q.classified(hard, labels).collect()
    assert len(rows) == hard.count()
    assert all(r["keep"] is False and r["quality_score"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    assert Q.classified(empty, labels).count() == 0
    none = Q.classified(hard, labels.limit(0)).collect()
    assert {r["doc_id"] for r in none if r["keep"]} == {1, 5, 6, 7, 8, None}
    assert Q.kept(hard, labels).columns == hard.columns
    assert Q.kept(hard, labels.limit(0)).count() == 7


def test_quality_is_the_same_in_any_partitioning(spark, docs, labels):
    a = Q.classified(docs, labels).orderBy("doc_id").collect()
    b = Q.classified(docs.repartition(7), labels).orderBy("doc_id").collect()
    assert [r["keep"] for r in a] == [r["keep"] for r in b]


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 1, 0, 4, 2])
    starts = np.cumsum(lengths) - lengths
    em, moves = rng.random((10, 3)).astype(np.float32) + 0.05, rng.standard_normal((3, 3))
    got = L.forward_backward(em, starts, lengths, moves)
    for s, n in zip(starts, lengths):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.prod([em[s + t, y] for t, y in enumerate(path)]) * np.exp(sum(moves[a, b] for a, b in zip(path, path[1:])))
            for t, y in enumerate(path):
                want[t, y] += p
        if n:
            assert np.allclose(got[s : s + n], want / want.sum(1, keepdims=True), atol=1e-5)


def test_language_held_out_and_switches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = L.fit(docs.where("doc_id % 2 = 0"))
    test = docs.where("doc_id % 2 = 1").select("text", "lang").toArrow()
    lang, share, n = L.totals(*L.label(test["text"].combine_chunks(), m))
    right = np.array([m.languages[k] for k in lang]) == np.array(test["lang"].to_pylist())
    assert right[n >= 20].mean() > 0.98
    assert L.kept_of(lang, share, m)[n >= 20].mean() > 0.98
    by = {g: docs.where((F.col("lang") == g) & (F.col("doc_id") % 2 == 1)).first()["text"].split()[:20] for g in ("en", "fr", "de")}
    mixed = by["en"] + by["fr"] + by["de"]
    _, post, _ = L.label(pa.array([" ".join(mixed)]), m)
    want = [g for g in ("en", "fr", "de") for _ in by[g]]
    assert np.mean([m.languages[k] == g for k, g in zip(post.argmax(1), want)]) > 0.85
    strange, share, _ = L.totals(*L.label(pa.array(["この文章は日本語で書かれています そして 長い 文章 です", "Это предложение написано на русском языке"]), m))
    assert not L.kept_of(strange, share, m).any()


def test_rare_languages_are_in_the_model(spark):
    rows = [(k, "the words of the text are here", "en") for k in range(2000)] + [(5000, "les mots du texte sont ici", "fr"), (5001, "die worte sind hier", "de")]
    m = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=6)
    assert {"en", "fr", "de"} <= set(m.languages)


def plain_features(word, m):
    """The buckets of one word, by Python's own integers."""
    mask = (1 << 64) - 1
    mix = lambda x: int(L.mix(np.array([x & mask], np.uint64))[0])

    def gram(part):
        h = 0
        for c in part:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & mask
        return h

    n, out = len(word), []
    for kind, sizes, places in ((1, (1, 2, 3), lambda k: [0]), (2, (1, 2, 3, 4), lambda k: [n - k]), (3, (2, 3), lambda k: range(n - k + 1))):
        for k in sizes:
            out += [mix(gram(word[p : p + k]) * 31 + kind * 8 + k) % L.BUCKETS for p in places(k) if n >= k]
    out.append(mix(sum(mix((ord(c) << 20) + p) for p, c in enumerate(word))) % L.BUCKETS)
    key = int(L.word_hashes(pa.array([word]))[0])
    for e in np.flatnonzero(m.lexicon.keys == np.uint64(key)):
        out += [mix(int(g) * 8 + (1 << 40)) % L.BUCKETS for g in m.lexicon.languages[m.lexicon.at[e] : m.lexicon.at[e + 1]]]
    return out


def plain_identified(text, m):
    """(lang, share, spans) of one text, word by word in double precision."""
    words = (text or "").split()
    clean = L.cleaned(pa.array(words, pa.string())).to_pylist()
    if not any(clean):
        return None, 0.0
    scores = [sum((m.weights[f].astype(float) for f in plain_features(w, m)), np.zeros(len(m.languages))) if w else np.zeros(len(m.languages)) for w in clean]
    em = [np.exp(np.clip(s - s.max(), -30, 0)) for s in scores]
    move, alpha, beta = np.exp(m.moves), [], [np.ones(len(m.languages))]
    for t, e in enumerate(em):
        a = e if t == 0 else (alpha[-1] @ move) * e
        alpha.append(a / a.sum())
    for t in range(len(em) - 1, 0, -1):
        b = move @ (em[t] * beta[0])
        beta.insert(0, b / b.sum())
    post = np.array([a * b / (a * b).sum() for a, b in zip(alpha, beta)])
    mass = post[[bool(w) for w in clean]].sum(axis=0)
    return m.languages[int(mass.argmax())], mass.max() / sum(map(bool, clean))


def test_identified_matches_brute_force(spark, docs, hard):
    both = docs.select("doc_id", "text", "lang").where("n_chars < 800").unionByName(only(hard.where("doc_id not in (5, 1)"), doc_id="doc_id", text="text", lang="lang").withColumn("doc_id", -F.col("doc_id")))
    m = L.fit(both)
    got = {(r["doc_id"], r["text"]): r for r in L.identified(both).join(both.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id") == F.col("i")).collect()}
    assert len(got) > 40
    for (_, text), r in got.items():
        if sum(x[1] == text for x in got) == 1:
            lang, share = plain_identified(text, m)
            assert abs(r["share"] - share) < 2e-3 and (r["lang"] == lang or share < 0.51)
            assert r["keep"] == (lang not in (None, L.OTHER) and r["share"] >= L.LEAST_SHARE)


def test_lexicon_holds_the_words_of_its_languages(spark):
    rows = [(k, f"alpha{k % 3} shared common", "en") for k in range(20)] + [(100 + k, f"beta{k % 3} shared rare{k}", "fr") for k in range(20)]
    m = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    of = lambda w: {m.languages[g] for e in np.flatnonzero(m.lexicon.keys == L.word_hashes(pa.array([w]))[0]) for g in m.lexicon.languages[m.lexicon.at[e] : m.lexicon.at[e + 1]]}
    assert of("shared") == {"en", "fr"} and of("alpha1") == {"en"} and of("beta2") == {"fr"} and of("rare5") == set()


def test_fit_reads_whole_texts(spark):
    """Words that only stand late in long texts are known."""
    rows = [(k, "one two three " * 100 + "lateword " * 10, "en") for k in range(3)] + [(10 + k, "un deux trois " * 100 + "motfinal " * 10, "fr") for k in range(3)]
    m = L.fit(spark.createDataFrame([*rows, *rows], "doc_id long, text string, lang string"), most=6)
    known = set(m.lexicon.keys.tolist())
    assert {int(x) for x in L.word_hashes(pa.array(["lateword", "motfinal", "deux"]))} <= known


def test_language_hard_rows(hard, empty):
    rows = L.identified(hard).collect()
    assert len(rows) == hard.count()
    for r in rows:
        assert sum(s["words"] for s in r["spans"]) >= r["n_words"]
        if r["doc_id"] in (2, 3, 4, 6):
            assert r["lang"] is None and not r["keep"] and r["n_words"] == 0
    assert L.identified(empty).count() == 0 and L.kept(empty).count() == 0
    assert L.kept(hard).columns == hard.columns
    unnamed = hard.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in L.identified(unnamed).collect() if r["keep"]} == {1, 5, 7, 8, None}
    assert L.kept(unnamed).count() == 6


def test_spans_cover_every_word(docs):
    for r in L.identified(docs).collect():
        at = 0
        for s in r["spans"]:
            assert s["first"] == at and s["words"] > 0
            at += s["words"]
        assert r["switches"] == max(0, len(r["spans"]) - 1)
