"""What keeps the optimiser within bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df, of which later expressions only see the columns.

    The optimiser would else write the steps of the cascade into each other, time and again, and not come to an end. A column
    of random numbers, filtered by what always holds, can neither be moved nor merged; columns that nobody needs are still
    pruned below it, and rows stay where they are.
    """
    return df.withColumn("_settled", F.rand(0)).where(F.col("_settled") >= 0).drop("_settled")
