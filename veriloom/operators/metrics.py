"""Confusion matrices and what follows from them, folds, and before/after comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import cumulated, draw, ranked

MEASURES = ("accuracy", "precision", "recall", "f1", "fpr", "fnr", "specificity", "asr", "mitigation")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(label: Column, prediction: Column) -> list[Column]:
    """tp, fp, tn, fn; what is none of the first three is a miss."""
    tp, fp, tn = (label == 1) & (prediction == 1), (label == 0) & (prediction == 1), (label == 0) & (prediction == 0)
    known = lambda c: F.coalesce(c, F.lit(False))
    return [F.count_if(known(tp)).alias("tp"), F.count_if(known(fp)).alias("fp"), F.count_if(known(tn)).alias("tn"), F.count_if(~(known(tp) | known(fp) | known(tn))).alias("fn")]


def measured(df: DataFrame, digits: int | None = None) -> DataFrame:
    """df with the measures of its tp, fp, tn, fn columns; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    values = {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, tp + fn),
        "specificity": ratio(tn, fp + tn),
        "asr": ratio(fn, tp + fn),
        "mitigation": recall,
    }
    return df.withColumns({k: F.round(v, digits) if digits is not None else v for k, v in values.items()})


def evaluated(df: DataFrame, *by: str, digits: int | None = None) -> DataFrame:
    """Confusion counts and measures of (label, prediction), by the columns named."""
    return measured(df.groupBy(*by).agg(*confusion(F.col("label"), F.col("prediction"))), digits)


def folded(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """df (with ord) with `fold`: its place in a seeded order, modulo k.

    Places come from ranked(): only ords are ordered, in many tasks, and joined back.
    """
    if k < 2:
        raise ValueError("two folds at least")
    places = ranked(df.select("ord").distinct(), draw(seed, "ord"), "ord").select("ord", F.pmod(F.col("place"), F.lit(k)).cast("int").alias("fold"))
    return df.join(places, "ord")


def fold_summary(folds: DataFrame, measures: tuple[str, ...] = MEASURES[:5]) -> DataFrame:
    """(metric, mean, stdev, folds) over rows of evaluated(..., 'fold'); no row with fewer than two folds."""
    long = folds.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in measures])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("stdev"), F.count("*").alias("folds")).where("folds >= 2")


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of two one-row results."""
    long = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in MEASURES])).alias("x")).select("x.*")
    return long(before, "before").join(long(after, "after"), "metric").withColumn("delta", F.col("after") - F.col("before"))


def latency(df: DataFrame, column: str = "latency_ms") -> DataFrame:
    """One row: mean and sorted[int(n * 0.95)] of a column, over counts of different values in ranges, each in its own task."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    upto = cumulated(n, "v", "n")
    return upto.agg(
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min(F.when(F.col("upto") > F.least(F.floor(F.col("total") * F.lit(0.95)), F.col("total") - 1), F.col("v"))).alias("p95"),
    )


def report(row: dict) -> str:
    """A text table of one result."""
    lines = [f"{'TP':>4} {row['tp']:>8}   {'FP':>4} {row['fp']:>8}", f"{'FN':>4} {row['fn']:>8}   {'TN':>4} {row['tn']:>8}"]
    return "\n".join(lines + [f"{m:<12} {row[m]:.4f}" for m in MEASURES])
