"""Overlapping windows of a text, as columns: closed forms, so no row needs a loop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriloom.functions.text import WS

#: An end moves back to just behind the last white space among so many characters before it.
LOOK_BACK = 64
CHARS_PER_TOKEN = 4


@dataclass(frozen=True)
class Windows:
    size: int
    overlap: int
    most: int | None = None

    def __post_init__(self):
        if self.size < 1 or not 0 <= self.overlap < self.size or (self.most is not None and self.most < 1):
            raise ValueError("windows need a size of 1 at least, a smaller overlap that is not negative, and room for one")

    @property
    def stride(self) -> int:
        return self.size - self.overlap


def count_for(length: int, w: Windows) -> int:
    """Windows that a text of that length has, without the cap."""
    return 0 if length <= 0 else 1 if length <= w.size else 1 + -(-(length - w.size) // w.stride)


def count_of(length: Column, w: Windows) -> Column:
    n = F.when(length <= 0, 0).when(length <= w.size, 1).otherwise(1 + F.ceil((length - w.size) / F.lit(w.stride)))
    n = F.least(n, F.lit(w.most)) if w.most else n
    return F.coalesce(n, F.lit(0)).cast("int")


def tokens_to_chars(tokens: int) -> int:
    return tokens * CHARS_PER_TOKEN


def snapped(text: Column, end: Column) -> Column:
    """Where a window that should end there does end."""
    back = F.substring(text, end - LOOK_BACK + 1, F.lit(LOOK_BACK))
    tail = F.length(F.regexp_extract(back, rf"([^{WS}]*)\z", 1))
    return F.when(end >= F.length(text), F.length(text)).when(tail >= LOOK_BACK, end).otherwise(end - tail)


def windows(text: Column, w: Windows) -> Column:
    """array<struct<index, start, end, text>> of a text's windows; empty for null and ''."""
    n = count_of(F.length(text), w)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def window(k: Column) -> Column:
        start = (k * w.stride).cast("int")
        end = snapped(text, start + w.size).cast("int")
        return F.struct(k.alias("index"), start.alias("start"), end.alias("end"), F.substring(text, start + 1, end - start).alias("text"))

    return F.transform(at, window)


def truncated(text: Column, ws: Column) -> Column:
    """Whether the windows end before the text does."""
    return F.coalesce(F.array_max(ws["end"]) < F.length(text), F.lit(False))
