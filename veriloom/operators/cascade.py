"""The cascade: segments, normalisation, Stage I, and Stage II only for requests that Stage I has not blocked.

A request stays one row throughout, with its segments in an array: nothing is shuffled, joined or read twice, and a stream
runs the very same plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import text as T

from . import segments as S
from . import stage1, stage2
from .chunks import Windows
from .plan import settled
from .rules import FLAG_RULES, PATTERNS, Rule
from .stage2 import Scorer, keyword_score, keyword_tokens

TRUNCATION_FLAG = "truncated_for_inspection"
WINDOWS1, WINDOWS2 = stage1.WINDOWS, stage2.WINDOWS


@dataclass(frozen=True)
class Config:
    """Which stages run, from which severity Stage I blocks, its rules, what Stage II scores with, and how far texts are read.

    gated: Stage II sees no text of a request that Stage I blocks; without it, both stages judge every request by themselves.
    most_chars, windows1 and windows2 bound what is inspected of one text, and verdicts say when they do; whole() has no
    such bound.
    """

    stage1: bool = True
    stage2: bool = False
    block_severity: str = "high"
    scorer: Scorer = keyword_score
    attributor: Scorer = keyword_tokens
    rules: tuple[Rule, ...] = PATTERNS
    flag_rules: tuple[Rule, ...] = FLAG_RULES
    most_chars: int | None = T.MOST_INSPECTED
    windows1: Windows = WINDOWS1
    windows2: Windows = WINDOWS2
    gated: bool = True


def whole(**options) -> Config:
    """A Config that inspects all of any text."""
    return Config(**({"stage2": True} | options), most_chars=None, windows1=stage1.WHOLE, windows2=stage2.WHOLE)


#: Arms of an evaluation.
CONFIGS = {"baseline": Config(False, False), "stage1": Config(), "stage2": Config(False, True), "stage12": Config(True, True), "full": Config(True, True)}


def inspected(requests: DataFrame, config: Config = Config(stage2=True)) -> DataFrame:
    """requests with `segments`: seg_idx, source_tag, origin, trust, injection_class, flags, script, stage1, stage2 of each.

    A stage that did not run is null; Stage II sees no text of a request that Stage I blocks, if config.gated.
    """
    df = requests.withColumn("_s", S.segment_array(F.col("context"), F.col("messages")))
    df = S.normalised_segments(df, F.col("_s"), config.most_chars)
    df = settled(df.withColumn("_scan", F.transform("norm", lambda n: S.scannable(n["text"], n["variants"]))))
    if config.stage1:
        df = stage1.scanned_each(df, F.col("_scan"), F.col("norm")["flags"], config.block_severity, config.rules, config.flag_rules, config.windows1)
        df, blocked = settled(df), F.exists("stage1", lambda s: s["should_block"]) if config.gated else F.lit(False)
    else:
        df, blocked = df.withColumn("stage1", F.lit(None).cast(f"array<struct<detections:array<{stage1.DETECTION}>,chars:int,windows:int,truncated:boolean,should_block:boolean,outcome:string>>")), F.lit(False)
    shut = F.transform("_scan", lambda _: F.lit(None).cast("array<string>"))
    df = stage2.scored_each(df, F.when(~blocked, F.col("_scan")).otherwise(shut) if config.stage2 else shut, config.scorer, config.attributor, config.windows2)

    def segment(s: Column, i: Column) -> Column:
        n = F.col("norm")[i]
        return F.struct(
            i.alias("seg_idx"), s["source_tag"].alias("source_tag"), s["origin"].alias("origin"), S.trust_of(s["source_tag"]).alias("trust"), S.class_of(s["source_tag"]).alias("injection_class"),
            n["flags"].alias("flags"), n["script"].alias("script"), F.col("stage1")[i].alias("stage1"), F.col("stage2")[i].alias("stage2"),
        )

    return settled(settled(df).withColumn("segments", F.transform("_s", segment)).drop("_s", "norm", "_scan", "stage1", "stage2"))


def first_by(segs: Column, key, when) -> Column:
    """The first segment with the greatest key, of those for which `when` holds; null if there is none."""
    keyed = F.transform(F.filter(segs, when), lambda s: F.struct(key(s).alias("key"), (-s["seg_idx"]).alias("late"), s.alias("s")))
    best = F.array_max(F.transform(keyed, lambda x: F.struct(x["key"].alias("key"), x["late"].alias("late"))))
    return F.try_element_at(F.filter(keyed, lambda x: (x["key"] == best["key"]) & (x["late"] == best["late"])), F.lit(1))["s"]


VERDICT = (
    "request_id", "segments", "normalization_flags", "segments_inspected", "language", "stage_1_syntactic", "stage_2_semantic", "semantic_score", "semantic_span", "attributed_tokens",
    "source_origin", "attack_type", "severity_level", "injection_class", "stage1_blocked", "stage2_blocked", "blocked", "stage2_uncertain", "has_untrusted",
)


def judged(df: DataFrame, config: Config = Config(stage2=True)) -> DataFrame:
    """inspected(...) with the columns of VERDICT: flags, script, outcomes, attribution. A request without segments passes."""
    every = F.col("segments")
    ran2 = F.exists(every, lambda s: s["stage2"].isNotNull())
    hit = first_by(every, lambda s: stage1.rank_of(stage1.highest(s["stage1"]["detections"])["severity"]), lambda s: F.size(s["stage1"]["detections"]) > 0)
    sem = first_by(every, lambda s: s["stage2"]["score"], lambda s: s["stage2"].isNotNull())
    any_of = lambda field, sub: F.exists(every, lambda s: F.coalesce(s[field][sub], F.lit(False)))
    flags = F.array_distinct(F.flatten(every["flags"]))
    cut = any_of("stage1", "truncated")
    df = df.withColumns(
        {
            "normalization_flags": F.when(cut, F.array_distinct(F.array_append(flags, F.lit(TRUNCATION_FLAG)))).otherwise(flags),
            "segments_inspected": every["source_tag"],
            "language": F.try_element_at(F.filter(every["script"], lambda x: x.isNotNull()), F.lit(1)),
            "_hit": hit,
            "_sem": sem,
            "stage1_blocked": any_of("stage1", "should_block"),
            "stage1_truncated": cut,
            "stage2_blocked": any_of("stage2", "should_block"),
            "_band": any_of("stage2", "uncertain"),
        }
    )
    df = settled(df)
    top = stage1.highest(F.col("_hit.stage1.detections"))
    strong = F.col("_sem.stage2.score") >= stage2.UNCERTAIN
    first = F.concat(F.when(F.col("stage1_blocked"), "block_").otherwise("signal_"), top["detector_id"])
    origin = F.when(F.col("_hit").isNotNull(), F.col("_hit.source_tag")).when(strong, F.col("_sem.source_tag"))
    cls = F.when(F.col("_hit").isNotNull(), F.col("_hit.injection_class")).when(strong, F.col("_sem.injection_class"))
    df = df.withColumns(
        {
            "stage_1_syntactic": (F.when(F.col("_hit").isNotNull(), first).when(F.col("stage1_truncated"), "pass_truncated").otherwise("pass") if config.stage1 else F.lit("not_run")),
            "stage_2_semantic": F.when(ran2, F.col("_sem.stage2.outcome")).otherwise("not_run"),
            "semantic_score": F.col("_sem.stage2.score"),
            "semantic_span": F.col("_sem.stage2.span"),
            "attributed_tokens": F.coalesce(F.col("_sem.stage2.tokens.token"), F.array().cast("array<string>")),
            "source_origin": origin,
            "attack_type": top["attack_type"],
            "severity_level": top["severity"],
            "injection_class": F.when(cls != "n/a", cls),
            "blocked": F.col("stage1_blocked") | F.col("stage2_blocked"),
            "stage2_uncertain": ~F.col("stage2_blocked") & F.col("_band"),
            "has_untrusted": F.exists("segments", lambda s: s["trust"] == "untrusted"),
        }
    )
    return settled(df.drop("_hit", "_sem", "_band", "stage1_truncated"))


def inspect(requests: DataFrame, config: Config = Config(stage2=True)) -> DataFrame:
    """VERDICT for every request."""
    return judged(inspected(requests, config), config).select(*VERDICT)


def prediction_of(*outcomes: str) -> Column:
    """1 if any of the stages' outcomes says that it blocks."""
    return F.concat_ws(" ", *outcomes).rlike("(?i)block|unsafe").cast("int")


def predicted(verdict: DataFrame) -> DataFrame:
    """verdict with `prediction`: 1 if any stage's outcome says that it blocks."""
    return verdict.withColumn("prediction", prediction_of("stage_1_syntactic", "stage_2_semantic"))
