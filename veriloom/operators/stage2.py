"""Stage II: a pluggable scorer over windows; a text scores what its highest window does, a segment what its highest text does."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.text import NONBLANK

from .chunks import Windows, windows

#: Windows of a text; WHOLE has no limit to their number.
WINDOWS, WHOLE = Windows(2_048, 512, 32), Windows(2_048, 512)
UNCERTAIN, BLOCKS, TOP_TOKENS, MOST_MATCH = 0.45, 0.55, 8, 120
#: Words and weights of the keyword scorer, which needs no model, in order.
KEYWORDS = dict(ignore=0.4, disregard=0.4, override=0.4, forget=0.3, instructions=0.3, directives=0.3, prompt=0.2, system=0.2, reveal=0.3, exfiltrate=0.4, jailbreak=0.4, unrestricted=0.3)
_TOKEN = "array<struct<token:string,weight:double>>"
Scorer = Callable[[Column], Column]


def keyword_score(text: Column) -> Column:
    """The weights of the words in a text, in sum 1 at most."""
    total = lambda low: reduce(lambda a, b: a + b, [F.when(low.contains(w), F.lit(x)).otherwise(0.0) for w, x in KEYWORDS.items()])
    return F.transform(F.array(F.lower(text)), lambda low: F.least(F.lit(1.0), total(low)))[0]


def keyword_tokens(text: Column) -> Column:
    """The heaviest words in a text, TOP_TOKENS at most; of equal weights the one named first."""
    table = F.array(*[F.struct(F.lit(-x).alias("w"), F.lit(k).alias("k"), F.lit(w).alias("token")) for k, (w, x) in enumerate(KEYWORDS.items())])
    hits = F.transform(F.array(F.lower(text)), lambda low: F.filter(table, lambda h: F.contains(low, h["token"])))[0]
    return F.transform(F.slice(F.array_sort(hits), 1, TOP_TOKENS), lambda h: F.struct(h["token"].alias("token"), (-h["w"]).alias("weight")))


def scored_each(df: DataFrame, texts: Column, score: Scorer = keyword_score, tokens: Scorer = keyword_tokens, w: Windows = WINDOWS) -> DataFrame:
    """df with stage2: for every array of texts in an array, what scored() gives; null for a null one. One row stays one row."""

    def laid(ts: Column) -> Column:
        return F.transform(F.filter(ts, lambda t: t.rlike(NONBLANK)), lambda t: F.struct(F.length(t).alias("n"), windows(t, w).alias("w")))

    df = df.withColumn("_w", F.transform(texts, laid))
    each = lambda ws: F.flatten(F.transform(ws, lambda t, i: F.transform(t["w"], lambda x: F.struct(score(x["text"]).alias("score"), (-i).alias("i"), (-x["index"]).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))))
    df = df.withColumn("_top", F.transform("_w", lambda ws: F.array_max(each(ws))))

    def summary(ws: Column, g: Column) -> Column:
        top = F.col("_top")[g]
        value = F.coalesce(top["score"], F.lit(0.0))
        cut = F.exists(ws, lambda t: F.coalesce(F.array_max(t["w"]["end"]), F.lit(0)) < t["n"])
        blocks, band = value >= BLOCKS, (value >= UNCERTAIN) & (value < BLOCKS)
        shown = F.format_string("%.2f", value)
        outcome = F.when(blocks, F.concat(F.lit("block_semantic_"), shown)).when(band, F.concat(F.lit("escalate_semantic_"), shown)).when(cut, F.concat(F.lit("pass_truncated_"), shown)).otherwise("pass")
        got = F.struct(
            value.alias("score"),
            top["text"].alias("window"),
            F.when(top.isNotNull(), F.array(top["start"], top["end"])).alias("span"),
            F.coalesce(F.substring(top["text"], 1, MOST_MATCH), F.lit("")).alias("matched_text"),
            F.when(value >= UNCERTAIN, tokens(top["text"])).otherwise(F.array().cast(_TOKEN)).alias("tokens"),
            F.size(F.flatten(ws["w"])).alias("windows"),
            cut.alias("truncated"),
            blocks.alias("should_block"),
            band.alias("uncertain"),
            outcome.alias("outcome"),
        )
        return F.when(ws.isNotNull(), got)

    return df.withColumn("stage2", F.transform("_w", summary)).drop("_w", "_top")


def scored(df: DataFrame, texts: Column, score: Scorer = keyword_score, tokens: Scorer = keyword_tokens, w: Windows = WINDOWS) -> DataFrame:
    """df with stage2: score, window, span, matched_text, tokens, windows, truncated, should_block, uncertain, outcome.

    Only the winning window is attributed, and only if its score reaches the uncertain band. Blank texts score 0. Windows
    beyond w.most are not scored, and stage2.truncated says so; WHOLE scores all of any text.
    """
    out = scored_each(df, F.array(F.coalesce(texts, F.array().cast("array<string>"))), score, tokens, w)
    return out.withColumn("stage2", F.col("stage2")[0])
