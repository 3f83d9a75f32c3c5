"""Corpus tools over samples (ord, dataset, text, label, source_tag, attack_type): audit, clean, cap, describe, split.

`ord` is the samples' order: the first of equal samples is the one of the least ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import text as T

from .plan import settled

LEAST_CHARS, OVER_LIMIT, CHARS_PER_TOKEN = 10, 2_048, 4
SAMPLE = "ord long, dataset string, text string, label int, source_tag string, attack_type string"


#: Hash cells of a seeded order, and so tasks that may order it: places are counted by cell first.
CELLS = 4096


def ranked(df: DataFrame, key: Column, *ties: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `place`: its place from 0 in the order of a hexadecimal hash (then of `ties`), of all rows or by columns.

    The hash's first digits are a cell; cells are counted, and a row's place is that of its cell plus that in it. So no task
    has more than a cell, however few the groups are, and only the counts, CELLS at most for each group, are ordered in one.
    """
    df = df.withColumn("_key", key)
    df = df.withColumn("_cell", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") / ((1 << 32) // CELLS)).cast("int"))
    sizes = df.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*(by or (F.lit(0),))).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).drop("_n")
    joined = df.join(sizes, [*by, "_cell"]) if by else df.join(sizes, "_cell")
    inside = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy("_key", *ties)) - 1
    return joined.withColumn("place", F.col("_before") + inside).drop("_key", "_cell", "_before")


def cumulated(counts: DataFrame, value: str, n: str, parts: int = 64) -> DataFrame:
    """(value, n) with `upto`, the sum of n up to a number `value`, and `total`: by ranges between quantiles, each in one task."""
    cuts = sorted(set(counts.approxQuantile(value, [k / parts for k in range(1, parts)], 0.005)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(value))) if cuts else F.lit(0)
    counts = counts.withColumn("_part", part)
    sums = counts.groupBy("_part").agg(F.sum(n).alias("_sum"))  # `parts` rows
    every = Window.partitionBy(F.lit(0))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("_sum").over(every)).drop("_sum")
    inside = F.sum(n).over(Window.partitionBy("_part").orderBy(value))
    return counts.join(F.broadcast(sums), "_part").withColumn("upto", F.col("_before") + inside).drop("_part", "_before")


def percentile(values: Column, p: float) -> Column:
    """sorted[min(int(n * p), n - 1)] of a collected array."""
    return F.try_element_at(F.array_sort(values), (F.least(F.floor(F.size(values) * F.lit(p)), F.size(values) - 1) + 1).cast("int"))


def keyed(samples: DataFrame, ascii_only: bool = False) -> DataFrame:
    """samples with the SHA-1 of the text and of its near key."""
    return samples.withColumns({"exact": F.sha1("text"), "near": F.sha1(T.near_key(F.col("text"), ascii_only))})


def audited(samples: DataFrame, ascii_only: bool = False) -> DataFrame:
    """A row for each dataset: counts of samples, classes, artifacts and duplicates, and lengths.

    A duplicate counts for the dataset of the row that repeats; near duplicates include exact ones. Lengths are tallied
    by value first, so the percentiles need one row for each different length, not one for each sample.
    """
    df = keyed(samples, ascii_only).withColumn("n", F.length("text"))
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("ord")) > 1
    df = df.withColumn("exact_dupe", first("exact")).withColumn("near_dupe", first("near"))
    by = df.groupBy("dataset").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") == 0).alias("benign"),
        F.count_if(F.col("label") == 1).alias("malicious"),
        F.count_if(F.col("n") < LEAST_CHARS).alias("empty_or_tiny"),
        F.count_if(F.col("n") > OVER_LIMIT).alias("over_limit"),
        F.count_if(F.col("text").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")).alias("control_chars"),
        F.count_if(F.col("text").rlike(rf"{T.SPACE}{{3}}")).alias("excess_whitespace"),
        F.count_if(F.col("text").rlike(r"&(?:#[0-9]{2,5}|[A-Za-z]{2,10});")).alias("html_entities"),
        F.count_if(F.substring("text", 1, 400).rlike(r"[^\x{0}-\x{24F}]")).alias("non_latin"),
        F.count_if("exact_dupe").alias("exact_dupes"),
        F.count_if("near_dupe").alias("near_dupes"),
        F.max("n").alias("max_chars"),
        F.floor(F.sum("n") / CHARS_PER_TOKEN).alias("est_tokens"),
    )
    tally = df.groupBy("dataset", "n").count()
    w = Window.partitionBy("dataset")
    tally = tally.withColumn("upto", F.sum("count").over(w.orderBy("n"))).withColumn("total", F.sum("count").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("total") * F.lit(p)), F.col("total") - 1), F.col("n")))
    return by.join(tally.groupBy("dataset").agg(at(0.5).alias("median_chars"), at(0.95).alias("p95_chars")), "dataset")


def overlaps(samples: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(kind, a, b, n): rows whose text was first seen in another dataset, by unordered pair of datasets."""
    df = keyed(samples, ascii_only)
    out = None
    for kind in ("exact", "near"):
        x = df.withColumn("first", F.first("dataset").over(Window.partitionBy(kind).orderBy("ord"))).where("first <> dataset")
        x = x.groupBy(F.lit(kind).alias("kind"), F.least("first", "dataset").alias("a"), F.greatest("first", "dataset").alias("b")).agg(F.count("*").alias("n"))
        out = x if out is None else out.unionByName(x)
    return out


def label_conflicts(samples: DataFrame, ascii_only: bool = False) -> DataFrame:
    """One row: how many repeated texts have another label than the first of their kind."""
    first = F.first("label").over(Window.partitionBy("near").orderBy("ord"))
    return keyed(samples, ascii_only).withColumn("first", first).agg(F.count_if(F.col("first") != F.col("label")).alias("label_conflicts"))


def dispositions(samples: DataFrame, drop_conflicts: bool = True, ascii_only: bool = False) -> DataFrame:
    """samples with cleaned text and what becomes of each: tiny, conflict, exact, near or kept. One shuffle, by near key."""
    # settled: else every column made of the cleaned text would clean it again
    df = settled(samples.withColumn("chars_before", F.length("text")).withColumn("text", T.clean_text(F.col("text"), ascii_only)))
    df = df.withColumn("tiny", F.length("text") < LEAST_CHARS)
    df = df.withColumn("near", F.when(~F.col("tiny"), F.sha1(T.near_key(F.col("text"), ascii_only))).otherwise(F.concat(F.lit("tiny"), F.col("ord"))))
    w = Window.partitionBy("near")
    first = w.orderBy("ord")
    df = df.withColumns({"labels": F.max("label").over(w) - F.min("label").over(w), "rn": F.row_number().over(first), "kept_text": F.first(F.sha1("text")).over(first)})
    what = F.when(F.col("tiny"), "tiny")
    if drop_conflicts:
        what = what.when(F.col("labels") > 0, "conflict")
    what = what.when(F.col("rn") == 1, "kept").when(F.sha1("text") == F.col("kept_text"), "exact").otherwise("near")
    return df.withColumn("disposition", what).drop("labels", "rn", "kept_text", "near", "tiny")


def cleaned(samples: DataFrame, drop_conflicts: bool = True, ascii_only: bool = False) -> DataFrame:
    return dispositions(samples, drop_conflicts, ascii_only).where("disposition = 'kept'").drop("disposition", "chars_before")


def clean_stats(disposed: DataFrame) -> DataFrame:
    """One row of counters of dispositions(...), with the share of characters saved."""
    kept = F.col("disposition") == "kept"
    df = disposed.agg(
        F.count("*").alias("read"),
        F.count_if(kept).alias("kept"),
        *[F.count_if(F.col("disposition") == d).alias(f"dropped_{d}") for d in ("tiny", "exact", "near", "conflict")],
        F.coalesce(F.sum("chars_before"), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum(F.when(kept, F.length("text"))), F.lit(0)).alias("chars_after"),
    )
    return df.withColumn("saving", F.round(F.coalesce(F.try_subtract(F.lit(1.0), F.try_divide("chars_after", "chars_before")), F.lit(0.0)), 6))


def parse_caps(items: list[str]) -> dict[str, int | None]:
    """NAME=N overrides; 0 takes the cap away."""
    out: dict[str, int | None] = {}
    for item in items:
        name, eq, value = item.partition("=")
        if not eq or not name.strip() or not value.strip().isdigit():
            raise ValueError(f"a cap is NAME=N, not {item!r}")
        out[name.strip()] = int(value) or None
    return out


def draw(seed: object, *columns: str) -> Column:
    """A reproducible order: the MD5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def subsampled(samples: DataFrame, caps: dict[str, int | None], seed: int = 42) -> DataFrame:
    """At most caps[dataset] samples of each capped dataset, in the dataset's own class ratio; the others stay whole.

    The draw is seeded and independent of partitions. Only ids of capped datasets are ranked, to find the first that is out
    of each class; texts are not shuffled.
    """
    caps = {k: v for k, v in caps.items() if v is not None}
    if not caps:
        return samples
    capped = samples.where(F.col("dataset").isin(*caps))
    cls = (F.col("label") != 0).cast("int")
    sizes = capped.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("b"))
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("dataset")]
    sizes = sizes.withColumn("cap", F.least(cap, "n")).withColumn("m", F.col("n") - F.col("b"))
    want = F.least(F.bround(F.col("cap") * F.col("b") / F.col("n")).cast("long"), "b")
    sizes = sizes.withColumn("bad", F.least(F.col("cap") - want, "m"))
    sizes = sizes.select("dataset", F.least(F.col("cap") - F.col("bad"), "b").alias("q0"), F.col("bad").alias("q1"))
    key = draw(seed, "dataset", "ord")
    ids = ranked(capped.select("dataset", "ord", cls.alias("_cls")), key, "ord", by=("dataset", "_cls")).join(sizes, "dataset")
    limit = ids.where(F.col("place") == F.when(F.col("_cls") == 0, F.col("q0")).otherwise(F.col("q1")))  # the first that is out, a row for each class
    limit = limit.select("dataset", "_cls", F.struct(key.alias("k"), "ord").alias("_limit"))
    chosen = capped.withColumn("_cls", cls).join(limit, ["dataset", "_cls"], "left").where(F.col("_limit").isNull() | (F.struct(key.alias("k"), "ord") < F.col("_limit")))
    rest = samples.where(~F.col("dataset").isin(*caps) | F.col("dataset").isNull())
    return rest.unionByName(chosen.select(samples.columns))


def subsample_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    count = lambda df, name: df.groupBy("dataset").agg(F.count("*").alias(name), F.count_if(F.col("label") == 0).alias(f"{name}_benign"))
    return count(before, "before").join(count(after, "after"), "dataset", "left").fillna(0)


def described(samples: DataFrame) -> DataFrame:
    """A row for each dataset and one for all (dataset null): class counts, balance, and a warning outside 0.3 to 0.7."""
    df = samples.rollup("dataset").agg(F.count_if(F.col("label") == 0).alias("benign"), F.count_if(F.col("label") == 1).alias("malicious"), F.count("*").alias("total"))
    share = F.coalesce(F.try_divide("malicious", "total"), F.lit(0.0))
    return df.withColumn("balance", F.round(share, 6)).withColumn("imbalanced", (share < 0.3) | (share > 0.7))


def split(samples: DataFrame, train: float = 0.8, validation: float = 0.1, seed: int = 42) -> DataFrame:
    """samples with `split`: of each class, floor(n * share) for train and for validation, and the rest for test.

    Only ids are ranked, to find where a class's parts end in the seeded order; texts are not shuffled.
    """
    if not (0 <= train and 0 <= validation and train + validation <= 1):
        raise ValueError("shares must not be negative, nor over 1 together")
    key, label = draw(seed, "ord"), F.coalesce(F.col("label"), F.lit(-1))
    ids = samples.select("ord", label.alias("_label"))
    n = ids.groupBy("_label").agg(F.count("*").alias("_n"))
    ends = ranked(ids, key, "ord", by=("_label",)).join(n, "_label")
    a, b = F.floor(F.col("_n") * F.lit(train) + F.lit(1e-9)), F.floor(F.col("_n") * F.lit(validation) + F.lit(1e-9))
    mark = F.struct(key.alias("k"), "ord")
    ends = ends.groupBy("_label").agg(F.max(F.when(F.col("place") == a, mark)).alias("_a"), F.max(F.when(F.col("place") == a + b, mark)).alias("_b"))  # a row for each label
    df = samples.withColumn("_label", label).join(ends, "_label", "left")
    before = lambda end: F.col(end).isNull() | (mark < F.col(end))
    return df.withColumn("split", F.when(before("_a"), "train").when(before("_b"), "validation").otherwise("test")).select(*samples.columns, "split")


def build_splits(samples: DataFrame, **shares) -> DataFrame:
    """Datasets named ..._train, ..._validation or ..._test keep their split; the others are split by class."""
    own = F.regexp_extract("dataset", "_(train|validation|test)$", 1)
    named = samples.withColumn("split", own).where("split <> ''")
    return named.unionByName(split(samples.where(own == ""), **shares))


def passage_prefixed(c: Column) -> Column:
    return F.concat(F.lit("passage: "), c)


def signals(samples: DataFrame, least_chars: int = 200, limit: int | None = 4_000) -> DataFrame:
    """(checked, matched, head, middle, tail): where in malicious texts Stage I finds its highest detection.

    Over the first `limit` samples in order of ord (None: all, without a sort). A hit that starts before 0.33 of the text
    is at its head, before 0.66 in the middle. checked counts the samples looked at, and one more if the limit cut them off.
    """
    from . import stage1

    df = samples.where((F.col("label") == 1) & (F.length("text") >= least_chars))
    if limit is not None:
        df = df.orderBy("ord").limit(limit + 1)
        df = df.withColumn("_over", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ord")) > limit)  # limit + 1 rows
    else:
        df = df.withColumn("_over", F.lit(False))
    df = stage1.scanned(df, F.array("text"), w=stage1.WINDOWS if limit is not None else stage1.WHOLE)
    hit = F.when(~F.col("_over"), stage1.highest(F.col("stage1.detections"))["matched_text"])
    df = df.withColumn("hit", F.when(hit != "", hit)).withColumn("_share", F.expr("nullif(locate(hit, text), 0) - 1") / F.length("text"))
    share = F.col("_share")
    return df.agg(
        F.count("*").alias("checked"), F.count(share).alias("matched"), F.count_if(share < 0.33).alias("head"), F.count_if((share >= 0.33) & (share < 0.66)).alias("middle"), F.count_if(share >= 0.66).alias("tail")
    )


def signal_position(samples: DataFrame, least_chars: int = 200, limit: int | None = 4_000) -> DataFrame:
    """signals(...) as (bucket, n) for head, middle and tail; a bucket without any sample has no row."""
    parts = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n")) for b in ("head", "middle", "tail")])
    return signals(samples, least_chars, limit).select(F.explode(parts).alias("x")).select("x.*").where("n > 0")
