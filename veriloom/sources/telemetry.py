"""Telemetry: one JSON line for each request, and what is read from it."""

from __future__ import annotations

import dataclasses
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import text as T
from veriloom.operators import cascade, enforce
from veriloom.operators.segments import inspectable_text

SCHEMA = """timestamp string, request_id string, session_id string, source_origin string, attack_type string, severity_level string,
 normalization_flags array<string>, segments_inspected array<string>, injection_class string,
 payload_characteristics struct<char_length:int,token_length:int,language:string,content_sha256:string,content:string>,
 detection_results struct<stage_1_syntactic:string,stage_2_semantic:string,stage_3_arbitration:string,semantic_score:double,semantic_span:array<int>,attributed_tokens:array<string>,session_risk_contribution:double,session_cumulative_risk:double>,
 mitigation_action_applied string, mitigation_detail string, redacted_origins array<string>, spans_redacted int,
 latency struct<stage_1_ms:double,stage_2_ms:double,stage_3_ms:double,inspection_ms:double,upstream_ms:double,total_ms:double>,
 response_status int, target_provider string, target_model string"""


STAGES = ("stage_1", "stage_2", "stage_3", "inspection", "upstream", "total")


def _record(df: DataFrame, latency: dict[str, float] | None) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    ms = lambda stage: F.lit((latency or {}).get(stage)).cast("double").alias(f"{stage}_ms")
    return df.select(
        T.iso_now().alias("timestamp"),
        "request_id",
        "session_id",
        "source_origin",
        "attack_type",
        "severity_level",
        "normalization_flags",
        "segments_inspected",
        "injection_class",
        F.struct(F.col("_p.length").alias("char_length"), F.col("_p.tokens").alias("token_length"), F.col("language"), F.col("_p.sha256").alias("content_sha256"), F.col("_p.content").alias("content")).alias("payload_characteristics"),
        F.struct("stage_1_syntactic", "stage_2_semantic", F.lit("n/a").alias("stage_3_arbitration"), "semantic_score", "semantic_span", "attributed_tokens", null("double").alias("session_risk_contribution"), null("double").alias("session_cumulative_risk")).alias("detection_results"),
        F.col("action").alias("mitigation_action_applied"),
        F.col("reason").alias("mitigation_detail"),
        "redacted_origins",
        F.col("spans_removed").alias("spans_redacted"),
        F.struct(*map(ms, STAGES)).alias("latency"),
        "response_status",
        null("string").alias("target_provider"),
        F.col("model").alias("target_model"),
    )


def _with_payload(requests: DataFrame, include_content: bool) -> DataFrame:
    return requests.withColumn("_p", T.payload(inspectable_text(F.col("context"), F.col("messages")), include_content))


def records(requests: DataFrame, verdicts: DataFrame, enforced: DataFrame, include_content: bool = False, latency: dict[str, float] | None = None) -> DataFrame:
    """Telemetry rows of requests with their verdicts and enforcement, joined. observed() needs no join.

    latency: mean milliseconds by stage, as timings() measures them; else these columns are null.
    """
    df = _with_payload(requests, include_content).select("request_id", "session_id", "model", "_p").join(verdicts, "request_id", "left")
    e = enforced.select("request_id", "action", "reason", "redacted_origins", "spans_removed", "response_status")
    return _record(df.join(e, "request_id", "left"), latency)


def observed(requests: DataFrame, config: cascade.Config = cascade.Config(stage2=True), include_content: bool = False, latency: dict[str, float] | None = None, **policy) -> DataFrame:
    """Telemetry rows of requests, inspected and enforced in the same pass: a row stays one row, in batches and streams."""
    return _record(enforce.run(_with_payload(requests, include_content), config, **policy), latency)


def timings(requests: DataFrame, config: cascade.Config = cascade.Config(stage2=True), **policy) -> dict[str, float]:
    """Mean milliseconds a request by stage, by running ever more of the plan over a batch: the wall clock of the whole batch

    over its rows. A row has no clock of its own in a columnar plan.
    """
    n = max(1, requests.count())

    def seconds(df: DataFrame) -> float:
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return (time.perf_counter() - began) * 1000 / n

    bare = seconds(cascade.inspect(requests, dataclasses.replace(config, stage1=False, stage2=False)))
    first = seconds(cascade.inspect(requests, dataclasses.replace(config, stage2=False)))
    both = seconds(cascade.inspect(requests, config))
    total = seconds(enforce.run(requests, config, **policy))
    return {"stage_1": max(0.0, first - bare), "stage_2": max(0.0, both - first), "inspection": both, "total": max(both, total)}


def write(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def analytics(df: DataFrame) -> DataFrame:
    """One row: requests, blocked ones, how many went to arbitration, and quantiles of inspection time."""
    d, ms = F.col("detection_results"), F.col("latency.inspection_ms")
    return df.agg(
        F.count("*").alias("requests"),
        F.count_if(F.upper("mitigation_action_applied") == "BLOCK").alias("blocked"),
        F.avg(d["stage_2_semantic"].startswith("escalate").cast("double")).alias("escalation_rate"),
        *[F.percentile(ms, F.lit(p)).alias(f"inspection_p{round(p * 100)}") for p in (0.5, 0.95, 0.99)],
    )


def attacks(df: DataFrame) -> DataFrame:
    """(source_origin, attack_type, n) of detections."""
    return df.where("attack_type is not null").groupBy("source_origin", "attack_type").agg(F.count("*").alias("n"))
