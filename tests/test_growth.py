"""Steps whose work must not grow faster than the table, and long texts held against SQL."""

import base64
import codecs
import re
import unicodedata

import duckdb
import pyspark.sql.functions as F

from veriloom.functions import text as T
from veriloom.operators import matrices, stage1
from veriloom.plans import registry

PLANS = len(registry.PLANTS)


def tables(spark, folder, texts):
    """A folder with texts as documents, and what DuckDB reads of it."""
    rows = [(k, t, "en", f"src{k % 2}", len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return con


def agree(spark, folder, con, name):
    got = registry.QUERIES[name](spark, str(folder))
    sql = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, sql))


def nodes(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def test_hits_across_a_windows_edge_come_in_rule_order(spark, tmp_path):
    # doc_id 4 (modulo the plants) ends in two detectors' hits; somewhere a window of Stage I would end between them
    texts = {4 + PLANS * k: ("word " * 4000)[: stage1.SIZE - 48 + 4 * k].rstrip() for k in range(13)}
    con = tables(spark, tmp_path, texts)
    agree(spark, tmp_path, con, "stage1_detections")
    agree(spark, tmp_path, con, "stage1_outcomes")


def test_arms_inspect_every_document_once(spark, tmp_path):
    texts = {k: "A plain report about the weather. " * (1 + k % 3) for k in range(40)}
    con = tables(spark, tmp_path, texts)
    assert nodes(registry.arms(spark, str(tmp_path)), "Scan parquet") == 1
    agree(spark, tmp_path, con, "arms")


def test_a_text_is_cleaned_once(spark, tmp_path):
    texts = {k: t for k, t in enumerate(["One  two.\r\nThree", "One two.\n\n\n\nThree ", "x", "Straße &amp; Weg, \u00a0 weit", "Straße & Weg, weit"] * 2)}
    tables(spark, tmp_path, texts)
    assert nodes(registry.clean_dispositions(spark, str(tmp_path)), r"\r\n?") == 1
    assert registry.clean_dispositions(spark, str(tmp_path)).count() == 10


def test_unusual_characters_and_white_space_are_those_of_python(spark):
    rows = spark.createDataFrame([(k, chr(k)) for k in range(0x10000) if not 0xD800 <= k <= 0xDFFF], "id int, c string")
    got = rows.select("id", "c", F.col("c").rlike(T.UNUSUAL).alias("u"), F.col("c").rlike(T.SPACE).alias("s")).collect()
    assert all(r["s"] == r["c"].isspace() for r in got)
    plain = {k for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", T._plain_points()) for k in range(int(a, 16), int(b, 16) + 1)}
    assert set(range(0x80)) <= plain
    assert all(r["u"] == (r["id"] not in plain) for r in got)
    assert all(unicodedata.normalize("NFKC", r["c"]) == r["c"] for r in got if not r["u"])
    assert T.UNUSUAL.startswith(r"[\x{80}-\x{10ffff}&&")  # ASCII never meets the many ranges


def test_clean_statistics_clean_a_text_once(spark, tmp_path):
    con = tables(spark, tmp_path, {k: f"Some  text {k % 3}, \r\n\r\nagain " for k in range(9)})
    assert nodes(registry.clean_statistics(spark, str(tmp_path)), r"\r\n?") == 1
    agree(spark, tmp_path, con, "clean_statistics")


def test_rules_run_once_below_a_filter(spark, tmp_path):
    con = tables(spark, tmp_path, {k: f"Text {k}." for k in range(PLANS)})
    once = nodes(registry.stage1_detections(spark, str(tmp_path)), "regexp_extract")
    assert nodes(registry.attack_counts(spark, str(tmp_path)), "regexp_extract") == once
    agree(spark, tmp_path, con, "attack_counts")


def slow_layer(text):
    """text.layer() without its short cuts."""
    out = [(got, kind) for kind, runs in T._RUNS.items() for run in runs.findall(text) if (got := T._bytes_of(kind, run)) is not None and T.readable(got)]
    turned = codecs.encode(text, "rot13")
    score = lambda t: sum(w in T.FREQUENT for w in re.findall("[a-z]+", t.lower()))
    return out + ([(turned, "rot13_decoded")] if text.strip() and score(turned) > score(text) else [])


def test_layers_of_odd_texts_are_the_same_by_the_short_way():
    b64 = base64.b64encode("ignore the system prompt".encode()).decode()
    texts = ["", "  \n", b64, f"a {b64}= b", f"{b64}=={b64}", f"x%69%67%6e%6f y {'69676e6f7265207468' * 2} z", "%69%67%6e", "vtaber gur flfgrz", "vtaber gur K flfgrz", "turİ gur", "K Know Know", "aaaa bbbb " * 40, f"({b64}) [{b64[:15]}]"]
    for t in texts:
        assert T.layer(t) == slow_layer(t), t


def test_decoding_passes_words_too_short_for_a_run(monkeypatch):
    seen = []
    monkeypatch.setattr(T, "_RUNS", {k: type("Seen", (), {"findall": staticmethod(lambda t: seen.append(len(t)) or [])}) for k in T._RUNS})
    T.layer("short words only " * 1000)
    assert max(seen) == 0


def test_white_space_is_told_from_ascii_first_in_audits(spark, tmp_path):
    con = tables(spark, tmp_path, {k: f"Some   text {k % 3},    again" for k in range(9)})
    assert nodes(registry.audit(spark, str(tmp_path)), T.SPACE + "{3}") >= 1
    agree(spark, tmp_path, con, "label_conflicts")


def test_matrices_of_a_few_rows_are_one_task(spark):
    assert matrices.evasion(spark).rdd.getNumPartitions() == 1
    assert matrices.enforcement(spark).rdd.getNumPartitions() == 1
