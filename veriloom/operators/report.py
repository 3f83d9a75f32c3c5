"""Evaluation runs: an arm's measures, folds and times as JSON, comparisons, and the six hypotheses."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cascade, metrics, segments, stats

#: Hypotheses by measure.
HYPOTHESES = {"accuracy": "H01", "precision": "H02", "recall": "H03", "f1": "H04", "asr": "H05", "mitigation": "H06"}
#: Measures of which less is better.
LESS = ("fpr", "fnr", "asr")
SHOWN = ("accuracy", "precision", "recall", "f1", "fpr", "asr", "mitigation")


@dataclass
class Run:
    arm: str
    measures: dict
    seconds: float
    folds: list[dict] = field(default_factory=list)

    @property
    def samples(self) -> int:
        return sum(self.measures[k] for k in ("tp", "fp", "tn", "fn"))


def predictions(samples: DataFrame, arm: str = "full") -> DataFrame:
    """(ord, label, prediction) of samples under an arm of cascade.CONFIGS."""
    verdict = cascade.predicted(cascade.judged(cascade.inspected(segments.sample_requests(samples), cascade.CONFIGS[arm]), cascade.CONFIGS[arm]))
    return verdict.select("ord", "label", "prediction")


def run(samples: DataFrame, arm: str = "full", folds: int = 1, seed: int = 42, path: str | None = None) -> Run:
    """An arm over samples. Predictions are written (below `path`, if given) once, and measured in all and by fold."""
    began = time.perf_counter()
    got = predictions(samples, arm)
    if path:
        got.write.mode("overwrite").parquet(path)
        got = samples.sparkSession.read.parquet(path)
    else:
        got = got.persist()
    measures = metrics.evaluated(got).first().asDict()
    seconds = time.perf_counter() - began
    parts = [r.asDict() for r in metrics.evaluated(metrics.folded(got, folds, seed), "fold").orderBy("fold").collect()] if folds > 1 else []  # a row for each fold
    if not path:
        got.unpersist()
    return Run(arm, measures, seconds, parts)


def as_json(r: Run) -> str:
    """A run as JSON: measures, mean milliseconds a sample, and mean and deviation over folds."""
    spread = {}
    if len(r.folds) > 1:
        for m in metrics.MEASURES[:5]:
            values = [f[m] for f in r.folds]
            mean = sum(values) / len(values)
            spread[m] = {"mean": mean, "stdev": (sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5}
    return json.dumps({"config": r.arm, "n_samples": r.samples, "metrics": r.measures, "latency_ms": {"mean": 1000 * r.seconds / max(1, r.samples)}, "wall_seconds": r.seconds, "folds": spread}, indent=2)


def write_json(r: Run, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(as_json(r))


def cross_check(df: DataFrame) -> bool:
    """Whether the measures of (label, prediction) are those counted from their pairs by other means: SQL's pivot of a crosstab."""
    row = metrics.evaluated(df).first()
    pairs = {(r["label"], r["prediction"]): r["n"] for r in df.groupBy("label", "prediction").agg(F.count("*").alias("n")).collect()}  # four rows
    hit, said, real = pairs.get((1, 1), 0), sum(n for (_, p), n in pairs.items() if p == 1), sum(n for (y, _), n in pairs.items() if y == 1)
    precision, recall = hit / said if said else 0.0, hit / real if real else 0.0
    f1 = 2 * hit / (said + real) if said + real else 0.0
    return all(abs(a - b) < 1e-9 for a, b in ((row["precision"], precision), (row["recall"], recall), (row["f1"], f1)))


def compare(before: dict, after: dict, names: tuple[str, str] = ("before", "after")) -> str:
    """A text table of two results: each measure, the difference, and whether it is for the better."""
    lines = [f"{'measure':<12}{names[0]:>12}{names[1]:>12}{'delta':>12}"]
    for m in SHOWN:
        d = after[m] - before[m]
        word = "-" if not d else "improved" if (d < 0) == (m in LESS) else "worse"
        lines.append(f"{m:<12}{before[m]:>12.4f}{after[m]:>12.4f}{d:>+12.4f}   {word}")
    return "\n".join(lines)


def hypotheses(before: DataFrame, after: DataFrame) -> list[stats.Paired]:
    """A paired t-test for each of HYPOTHESES over rows of metrics.evaluated(..., 'fold'); measures that are in both."""
    have = [m for m in HYPOTHESES if m in before.columns and m in after.columns]
    long = lambda df, name: df.select("fold", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in have])).alias("x")).select("fold", "x.*")
    return stats.paired_t(long(before, "before").join(long(after, "after"), ["fold", "metric"]))
