"""Statistics as JVM expressions. All skip nulls; NaN must be turned into null at ingest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, null where den is 0."""
    return c(num) / F.nullif(c(den), F.lit(0))


def adjusted_skew(x: Column | str) -> Column:
    """Bias-corrected sample skewness (aggregate); null under three values or without spread."""
    n = F.count(c(x)).cast("double")
    return F.when((n >= 3) & (F.stddev_samp(c(x)) > 0), F.skewness(c(x)) * F.sqrt(n * (n - 1)) / (n - 2))


def quantile(x: Column | str, q: float) -> Column:
    """Exact quantile with linear interpolation (aggregate)."""
    return F.percentile(c(x), F.lit(q))


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(c(x), F.lit(low)), F.lit(high))


def logit(p: Column | str) -> Column:
    return F.ln(c(p) / (1 - c(p)))


def expit(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-c(x)))


def temperature(p: Column | str, t: Column | float) -> Column:
    """Probability with its log odds divided by t."""
    return expit(logit(clip(p, 1e-7, 1 - 1e-7)) / (F.lit(t) if isinstance(t, (int, float)) else t))


def decay(age: Column | str, half_life: float) -> Column:
    return F.pow(F.lit(0.5), c(age) / F.lit(half_life))


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    """Aggregate: sum(w x) / sum(w) over rows where x is known."""
    return F.sum(c(w) * c(x)) / F.sum(F.when(c(x).isNotNull(), c(w)))


def shrunk_mean(x: Column | str, prior_rows: float, where: Column | None = None) -> Column:
    """Aggregate: sum / (count + prior_rows), of the rows where ``where`` holds."""
    v = c(x) if where is None else F.when(where, c(x))
    return F.coalesce(F.sum(v), F.lit(0.0)) / (F.count(v) + F.lit(float(prior_rows)))


def beta_posterior(wins: Column, games: Column, a: float, b: float) -> Column:
    return (wins + F.lit(float(a))) / (games + F.lit(float(a + b)))


def uniform_hash(*parts: Column | str) -> Column:
    """A reproducible number in [0, 1) from the first twelve hex digits of SHA-256 of the parts joined by colons."""
    h = F.substring(F.sha2(F.concat_ws(":", *[c(p).cast("string") for p in parts]), 256), 1, 12)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(1 << 48))


def brier(p: Column | str = "p", y: Column | str = "y") -> Column:
    return F.avg(F.pow(c(p) - c(y), F.lit(2.0)))


def log_loss(p: Column | str = "p", y: Column | str = "y", eps: float = 1e-15) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.avg(-(c(y) * F.ln(q) + (1 - c(y)) * F.ln(1 - q)))


def probability_bin(p: Column | str, bins: int = 10) -> Column:
    return F.least(F.floor(c(p) * bins), F.lit(bins - 1)).cast("int")
