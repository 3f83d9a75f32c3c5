"""Enforcement: allow, block, or redact the sentences that carry a payload, and block if none of them can be found."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from veriloom.functions import text as T

from . import cascade
from .plan import settled

MARKER, LEAST_CHARS, BLOCK_STATUS = "[content removed by security filter]", 4, 403
_END = re.compile(r"\n+|[.!?]+(?=\s|$)")
TARGETS = "array<struct<origin:string,source_tag:string,trust:string,text:string>>"


def _target(s: Column, text: Column) -> Column:
    return F.struct(s["origin"].alias("origin"), s["source_tag"].alias("source_tag"), s["trust"].alias("trust"), text.alias("text"))


def stage1_targets(segments: Column) -> Column:
    """Every match of LEAST_CHARS characters or more of the segments that Stage I blocks."""
    guilty = F.filter(segments, lambda s: F.coalesce(s["stage1"]["should_block"], F.lit(False)))
    return F.flatten(F.transform(guilty, lambda s: F.transform(F.filter(s["stage1"]["detections"], lambda d: F.length(d["matched_text"]) >= LEAST_CHARS), lambda d: _target(s, d["matched_text"]))))


def stage2_targets(segments: Column, uncertain: bool) -> Column:
    """The sentences of winning windows that hold an attributed word, or the whole window if none does."""
    use = lambda s: F.coalesce(s["stage2"]["should_block"] | (s["stage2"]["uncertain"] if uncertain else F.lit(False)), F.lit(False))

    def texts(s: Column) -> Column:
        words = F.transform(F.filter(s["stage2"]["tokens"], lambda t: F.length(t["token"]) >= LEAST_CHARS), lambda t: F.lower(t["token"]))
        window = s["stage2"]["window"]
        sentences = F.split(window, r"(?<=[.!?])\s+|\n+")
        chosen = F.filter(sentences, lambda x: x.rlike(T.NONBLANK) & F.exists(words, lambda w: F.lower(x).contains(w)))
        whole = F.when(F.length(window) >= LEAST_CHARS, F.array(window)).otherwise(F.array().cast("array<string>"))
        return F.transform(F.when(F.size(chosen) > 0, chosen).otherwise(whole), lambda x: _target(s, x))

    return F.flatten(F.transform(F.filter(segments, use), texts))


def decided(verdicts: DataFrame, sanitize_untrusted: bool = True, resolve_band_by_trust: bool = True, block_on_flags: bool = False) -> DataFrame:
    """verdicts with decision, reason and targets.

    A segment that only a flag blocks has nothing to redact, and is allowed unless block_on_flags is set.
    """
    none = F.array().cast(TARGETS)
    df = verdicts.withColumn("_sure", F.concat(stage1_targets(F.col("segments")), stage2_targets(F.col("segments"), False)))
    df = df.withColumn("_band", F.filter(stage2_targets(F.col("segments"), True), lambda t: t["trust"] == "untrusted"))
    df = settled(df)
    sure, band = F.size("_sure") > 0, F.col("stage2_uncertain") & F.lit(resolve_band_by_trust)
    direct = F.filter("_sure", lambda t: t["trust"] != "untrusted")
    blocks = sure & ((F.size(direct) > 0) | F.lit(not sanitize_untrusted))
    suspect = F.size("_band") > 0
    decision = (
        F.when(blocks, "block")
        .when(sure, "sanitize")
        .when(band & suspect, "sanitize" if sanitize_untrusted else "block")
        .when(F.lit(block_on_flags) & F.col("stage1_blocked"), "block")
        .otherwise("allow")
    )
    tags = lambda c: F.array_join(F.array_sort(F.array_distinct(c["source_tag"])), ", ")
    by_origin = lambda c: F.array_join(F.array_sort(F.transform(F.array_distinct(F.transform(c, lambda t: F.struct(t["origin"], t["source_tag"].alias("tag")))), lambda x: x["tag"])), ", ")
    guilty = F.when(F.size(direct) > 0, direct).otherwise(F.col("_sure"))
    reason = (
        F.when(blocks, F.concat(F.lit("Blocked: "), F.coalesce("attack_type", F.lit("prompt_injection")), F.lit(" in "), tags(guilty), F.lit(".")))
        .when(sure, F.concat(F.lit("Instructions in untrusted content were removed ("), by_origin(F.col("_sure")), F.lit(").")))
        .when(band & suspect, "Doubtful content in an untrusted segment.")
        .when(band, "Doubtful content from the principal; allowed and logged.")
        .otherwise("")
    )
    targets = F.when(decision == "sanitize", F.when(sure, F.col("_sure")).otherwise(F.col("_band"))).otherwise(none)
    return df.withColumns({"decision": decision, "reason": reason, "targets": targets}).drop("_sure", "_band")


def redacted(text: str, spans: list[str]) -> tuple[str, int]:
    """(text without the sentences that hold a span, how many stretches went).

    A sentence ends at line ends, or at end marks before white space, or just before the span itself.
    """
    if not any(s and s in text for s in spans):
        return text, 0
    regions = []
    ends = [m.end() for m in _END.finditer(text)]
    for span in {s for s in spans if s}:
        at = text.find(span)
        while at >= 0:
            k = bisect_right(ends, at)
            begin = ends[k - 1] if k else 0
            if at and text[at - 1] in ".!?" and begin < at:
                begin = at  # end marks touch the span: to what stands before it, the text ends here
            while begin < at and text[begin].isspace():
                begin += 1
            after = _END.search(text, at + len(span))
            regions.append((begin, after.end() if after else len(text)))
            at = text.find(span, at + len(span))
    merged: list[list[int]] = []
    for lo, hi in sorted(regions):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    parts, at = [], 0
    for lo, hi in merged:
        parts += [text[at:lo], MARKER]
        at = hi
    return re.sub(r"\s{2,}", " ", "".join([*parts, text[at:]])).strip(), len(merged)


_REDACTED = pa.struct([("texts", pa.list_(pa.string())), ("removed", pa.int32())])


@F.arrow_udf(from_arrow_type(_REDACTED))
def _redact_all(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """All of a request's texts, redacted, and the number of stretches that went; null where spans are."""

    def each(ts: list, ss: list) -> dict:
        done = [(None, 0) if t is None else redacted(t, ss) for t in ts]
        return {"texts": [d[0] for d in done], "removed": sum(d[1] for d in done)}

    some = lambda at, n: zip(texts.slice(at, n).to_pylist(), spans.slice(at, n).to_pylist())
    return pa.concat_arrays([pa.array([], _REDACTED), *(pa.array([None if s is None else each(t or [], s) for t, s in some(at, n)], _REDACTED) for at, n in T.sliced(len(texts)))])


def applied(judged: DataFrame, **policy) -> DataFrame:
    """requests with their verdicts, and with decision, action, reason, escalated, spans_removed, redacted_origins, messages,

    response_status. Only requests to be redacted have work for Python. Messages' texts and blocks are rewritten; contexts
    never leave here. A request in which nothing could be removed is blocked. A row stays one row.
    """
    df = settled(decided(judged, **policy))
    sanitize = F.col("decision") == "sanitize"
    flat = F.flatten(F.transform("messages", lambda m: F.concat(F.array(m["content"]), F.coalesce(m["blocks"]["text"], F.array().cast("array<string>")))))
    df = df.withColumn("_r", _redact_all(F.when(sanitize, flat), F.when(sanitize, F.col("targets")["text"])))
    df = df.withColumn("_n", F.transform("messages", lambda m: 1 + F.greatest(F.lit(0), F.coalesce(F.size(m["blocks"]), F.lit(0)))))

    def rewritten(m: Column, i: Column) -> Column:
        base = F.aggregate(F.slice("_n", F.lit(1), i), F.lit(0), lambda a, b: a + b)
        blocks = F.transform(m["blocks"], lambda b, k: F.struct(b["type"].alias("type"), F.element_at("_r.texts", base + k + 2).alias("text")))
        return F.struct(m["role"].alias("role"), F.element_at("_r.texts", base + 1).alias("content"), blocks.alias("blocks"))

    df = df.withColumns({"spans_removed": F.coalesce("_r.removed", F.lit(0)), "_messages": F.when(F.col("_r.removed") > 0, F.transform("messages", rewritten)).otherwise(F.col("messages"))})
    lost = sanitize & (F.col("spans_removed") == 0)
    df = df.withColumns({"escalated": lost, "reason": F.when(lost, "Blocked: a payload was found but could not be located for removal.").otherwise(F.col("reason")), "decision": F.when(lost, "block").otherwise(F.col("decision"))})
    stopped = F.col("decision") == "block"
    return df.withColumns(
        {
            "action": F.upper("decision"),
            "redacted_origins": F.array_sort(F.array_distinct(F.col("targets")["origin"])),
            "messages": F.when(~stopped, F.col("_messages")),
            "response_status": F.when(stopped, BLOCK_STATUS).otherwise(200),
        }
    ).drop("_r", "_n", "_messages", "targets")


ENFORCED = ("request_id", "decision", "action", "reason", "escalated", "spans_removed", "redacted_origins", "messages", "response_status")


def enforced(requests: DataFrame, verdicts: DataFrame, **policy) -> DataFrame:
    """ENFORCED for every request that has a verdict. run() needs no join, where the verdicts aren't at hand yet."""
    return applied(requests.select("request_id", "messages").join(verdicts, "request_id"), **policy).select(*ENFORCED)


def run(requests: DataFrame, config: cascade.Config = cascade.Config(stage2=True), **policy) -> DataFrame:
    """Requests inspected and enforced in one pass: the requests' columns, VERDICT and ENFORCED."""
    return applied(cascade.judged(cascade.inspected(requests, config), config), **policy)
