"""Drift against a baseline, ages and stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.functions import vocab as V


def unpivot(fingerprints: DataFrame, value: str) -> DataFrame:
    return fingerprints.select("locale", F.explode(F.map_from_arrays(F.array(*map(F.lit, V.DRIFT_METRICS)), F.array(*[F.col(m).cast("double") for m in V.DRIFT_METRICS]))).alias("metric", value))


def delta_pct(was: Column, now: Column) -> Column:
    """Per cent of the baseline's size, one place; from zero only zero is measurable."""
    change = F.floor((now - was) / F.abs(was) * 1000.0 + 0.5) / 10.0
    return F.when(was.isNull() | now.isNull(), None).when(was == 0, F.when(now == 0, 0.0)).otherwise(change)


def drift(baseline: DataFrame, current: DataFrame, threshold: float = V.THRESHOLDS["drift_pct"]) -> DataFrame:
    """Locale x metric: both values, change and flag; a locale without baseline has nulls."""
    b, c = unpivot(baseline, "was"), unpivot(current, "now")
    out = c.join(b, ["locale", "metric"], "left").withColumn("delta_pct", delta_pct(F.col("was"), F.col("now")))
    return out.withColumn("flagged", F.coalesce(F.abs("delta_pct") >= threshold, F.lit(False)))


def age_days(then: Column, now: Column) -> Column:
    """Whole days, not negative; null for no date."""
    return F.greatest(F.floor((F.unix_micros(now) - F.unix_micros(then)) / 86400000000).cast("long"), F.lit(0).cast("long"))


def stages(reached: DataFrame) -> DataFrame:
    """The furthest of the reached stages; stages may be skipped."""
    at = None
    for s in reversed(V.STAGES):
        at = F.when(F.col(s), s) if at is None else at.when(F.col(s), s)
    return reached.withColumn("at", at)
