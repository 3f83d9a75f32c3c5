"""The pipeline's stages one by one, and run() against them."""

import numpy as np

import __spark_entry__
import corpus_pipeline
from tests.llm.test_packing import texts_of
from tests.llm.test_simhash import brute_groups
from veriloom.llm import langid, quality, spm
from veriloom.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"


def test_every_query_is_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline_matches_stages_by_hand(spark, docs, labels):
    import pyarrow as pa

    rows = docs.collect()
    m = quality.fit(docs, labels)
    q, t = quality.score(pa.array([r["text"] for r in rows]), m)
    rows = [r for r, a, b in zip(rows, q, t) if a >= quality.REJECT_BELOW and b < quality.REJECT_BELOW]
    kept = spark.createDataFrame(rows, docs.schema)
    stage1 = corpus_pipeline.quality_stage(spark, docs, SF)
    assert sorted(r["doc_id"] for r in stage1.collect()) == sorted(r["doc_id"] for r in rows)
    model = langid.fit(kept)
    lang, share, _ = langid.totals(*langid.label(pa.array([r["text"] for r in rows]), model))
    rows = [r for r, k in zip(rows, langid.kept_of(lang, share, model)) if k]
    groups = brute_groups([r["doc_id"] for r in rows], [r["text"] for r in rows])
    rows = [r for r in rows if groups[r["doc_id"]] == r["doc_id"]]
    got = texts_of(corpus_pipeline.run(spark, SF).collect(), spm.vocabulary(TOKENIZER))
    assert got == {r["doc_id"]: (r["text"], 1) for r in rows if r["text"]}


def test_stages_keep_the_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_clean_documents_stay(spark, docs, labels):
    clean = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()}
    left = corpus_pipeline.language_stage(spark, corpus_pipeline.quality_stage(spark, docs, SF), SF)
    ids = {r["doc_id"] for r in left.collect()}
    assert np.mean([i in ids for i in clean]) > 0.97


def test_pipeline_hard_rows(spark, hard, empty, labels, tmp_path):
    """run() over tables with nulls, repeated ids, very long texts, clashing names, and over empty ones."""
    labels.write.parquet(f"{tmp_path}/hard/labels.parquet")
    renamed = hard.toDF(*[f"c{k}" for k in range(len(hard.columns))])  # Parquet can't hold names that differ by case alone
    names = ["doc_id", "text", "lang", "source", "n_chars", "label", "path", "digest", "keep", "fp", "shard"]
    plain = renamed.toDF(*names)
    plain.write.parquet(f"{tmp_path}/hard/documents.parquet")
    got = texts_of(corpus_pipeline.run(spark, f"{tmp_path}/hard").collect(), spm.vocabulary(TOKENIZER))
    texts = {}
    for r in plain.collect():
        texts.setdefault(r["doc_id"], r["text"])
    assert all(got[k][0] == texts[k] for k in got) and not {2, 3, 4, 6} & set(got)
    m = quality.fit(plain, labels)
    import pyarrow as pa

    q, t = quality.score(pa.array([r["text"] for r in plain.collect()]), m)
    stays = {r["doc_id"] for r, a, b in zip(plain.collect(), q, t) if a >= quality.REJECT_BELOW and b < quality.REJECT_BELOW}
    assert set(got) <= stays
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    plain.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    one = plain.where("doc_id in (1, 8)")
    one.write.parquet(f"{tmp_path}/one/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/one/labels.parquet")
    assert texts_of(corpus_pipeline.run(spark, f"{tmp_path}/one").collect(), spm.vocabulary(TOKENIZER)) == {1: ("plain words of a short text here", 2)}
