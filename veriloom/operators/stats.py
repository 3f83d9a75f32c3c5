"""Paired tests over folds: moments come from Spark, tails from published series; a handful of rows reaches the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALPHA = 0.05


@dataclass(frozen=True)
class Paired:
    metric: str
    test: str
    statistic: float
    p: float
    df: int | None = None
    effect: float | None = None
    size: str = ""
    mean_difference: float = 0.0
    interval: tuple[float, float] | None = None

    @property
    def significant(self) -> bool:
        return self.p < ALPHA

    def summary(self) -> str:
        d = "" if self.effect is None else f", d = {self.effect:.3f} ({self.size})"
        return f"{self.metric}: {self.test} {self.statistic:.3f}, p = {self.p:.4f}{d}: {'significant' if self.significant else 'not significant'}"


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


def t_tail(t: float, df: float) -> float:
    """Two-tailed p of Student's t."""
    return beta_share(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_tail(mid, df) > 2 * (1 - p) else (lo, mid)
    return (lo + hi) / 2


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def effect_size(d: float) -> str:
    return next(name for most, name in ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"), (math.inf, "large")) if abs(d) < most)


def moments(pairs: DataFrame) -> DataFrame:
    """(metric, n, mean, sd) of the differences of (metric, before, after)."""
    d = F.col("after") - F.col("before")
    return pairs.groupBy("metric").agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))


def from_moments(metric: str, n: int, mean: float, sd: float | None) -> Paired:
    if n < 2:
        raise ValueError("a paired test needs two pairs at least")
    sd = sd or 0.0
    d = mean / sd if sd else 0.0
    t = mean / (sd / math.sqrt(n)) if sd else (math.copysign(math.inf, mean) if mean else 0.0)
    p = t_tail(t, n - 1) if sd else (0.0 if mean else 1.0)
    half = t_quantile(1 - ALPHA / 2, n - 1) * sd / math.sqrt(n)
    return Paired(metric, "t", t, p, n - 1, d, effect_size(d), mean, (mean - half, mean + half))


def paired_t(pairs: DataFrame) -> list[Paired]:
    """A t-test for every metric of (metric, before, after): one small row for each reaches the driver."""
    return [from_moments(r["metric"], r["n"], r["mean"], r["sd"]) for r in moments(pairs).orderBy("metric").collect()]


def wilcoxon(before: list[float], after: list[float], metric: str = "") -> Paired:
    """Signed ranks of the non-zero differences; exact without ties up to 50 pairs, else the normal approximation."""
    if len(before) != len(after):
        raise ValueError("as many values before as after")
    d = [b - a for a, b in zip(before, after) if b != a]
    n = len(d)
    if not n:
        return Paired(metric, "W", 0.0, 1.0)
    order = sorted(range(n), key=lambda k: abs(d[k]))
    rank, ties, k = [0.0] * n, 0.0, 0
    while k < n:
        e = k
        while e + 1 < n and abs(d[order[e + 1]]) == abs(d[order[k]]):
            e += 1
        for j in range(k, e + 1):
            rank[order[j]] = (k + e) / 2 + 1
        ties += (e - k + 1) ** 3 - (e - k + 1)
        k = e + 1
    plus = sum(r for r, x in zip(rank, d) if x > 0)
    w = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        p = min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    else:
        sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        p = normal_tail((w - n * (n + 1) / 4) / sd) if sd else 1.0
    return Paired(metric, "W", w, p, mean_difference=sum(d) / len(before))


def quantile(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def shapiro_wilk(x: list[float]) -> tuple[float, float] | None:
    """(W, p) by Royston's approximation (1995); None for fewer than 3 or over 5,000 values, or for equal ones."""
    n = len(x)
    if not 3 <= n <= 5000 or max(x) == min(x):
        return None
    x = sorted(x)
    m = [quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm, u = sum(v * v for v in m), 1 / math.sqrt(n)
    poly = lambda c, v: sum(k * v**e for e, k in enumerate(c))
    a = [0.0] * n
    if n == 3:
        a[2] = math.sqrt(0.5)
    else:
        a[-1] = poly((m[-1] / math.sqrt(mm), 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), u)
        if n > 5:
            a[-2] = poly((m[-2] / math.sqrt(mm), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * a[-1] ** 2)
        for i in range(n // 2, n - (2 if n > 5 else 1)):
            a[i] = m[i] / math.sqrt(phi)
    for i in range(n // 2):
        a[i] = -a[n - 1 - i]
    mean = sum(x) / n
    w = min(1.0, sum(p * q for p, q in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w == 1.0:
        return w, 1.0
    y = math.log(1 - w)
    if n <= 11:
        g = poly((-2.273, 0.459), n)
        if y >= g:
            return w, 0.0
        y, mu, sd = -math.log(g - y), poly((0.5440, -0.39978, 0.025054, -6.714e-4), n), math.exp(poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    else:
        k = math.log(n)
        mu, sd = poly((-1.5861, -0.31082, -0.083751, 0.0038915), k), math.exp(poly((-0.4803, -0.082676, 0.0030302), k))
    return w, 0.5 * math.erfc((y - mu) / sd / math.sqrt(2))


def report(results: list[Paired]) -> str:
    return "\n".join(r.summary() for r in results)
