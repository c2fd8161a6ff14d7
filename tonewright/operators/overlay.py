"""Overlay of a speaker's rules over the house's, with locks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_rules(house: DataFrame, overlay: DataFrame, locks: DataFrame) -> DataFrame:
    """The merged rules in order (`ord`), with origin, locked and overrides.

    Voice rules (ids that start with V) replace the house's as a set, except that locked
    house voice rules follow at the end; other rules override by id unless locked, and new
    ids are added.  `ord` of the inputs gives the order within each."""
    voiced = overlay.where("id like 'V%'").limit(1).select(F.lit(True).alias("has_v"))
    over = overlay.select(F.col("id").alias("oid")).distinct()
    home = house.select(F.col("id").alias("hid")).distinct()
    lock = locks.select(F.col("id").alias("lid"), F.lit(True).alias("is_locked")).distinct()
    small = F.broadcast  # hand-written rule bases
    h = house.join(small(lock), F.col("id") == F.col("lid"), "left").join(small(over), F.col("id") == F.col("oid"), "left").join(small(voiced), F.lit(True), "left")
    h = h.withColumns({"locked": F.coalesce("is_locked", F.lit(False)), "v": F.col("id").startswith("V"), "has_v": F.coalesce("has_v", F.lit(False))})
    o = overlay.join(small(lock), F.col("id") == F.col("lid"), "left").join(small(home), F.col("id") == F.col("hid"), "left")
    o = o.withColumns({"locked": F.coalesce("is_locked", F.lit(False)), "v": F.col("id").startswith("V")})
    cols = house.columns
    yes, no = F.lit(True), F.lit(False)
    kept = h.where(~(F.col("v") & F.col("has_v")) & (F.col("locked") | F.col("oid").isNull() | F.col("v"))).select(*cols, F.lit(0).alias("part"), F.lit("house").alias("origin"), "locked", no.alias("overrides"))
    new = o.where(F.col("v") | ~F.col("locked")).select(*cols, F.lit(1).alias("part"), F.lit("speaker").alias("origin"), no.alias("locked"), (F.col("hid").isNotNull() & ~F.col("v")).alias("overrides"))
    tail = h.where(F.col("v") & F.col("has_v") & F.col("locked")).select(*cols, F.lit(2).alias("part"), F.lit("house").alias("origin"), yes.alias("locked"), no.alias("overrides"))
    return reduce(DataFrame.unionByName, [kept, new, tail])


def lock_violations(house: DataFrame, overlay: DataFrame, locks: DataFrame) -> DataFrame:
    """Locked house rules that the overlay tries to override."""
    return house.where("id not like 'V%'").join(locks.select("id").distinct(), "id", "left_semi").join(overlay.select("id").distinct(), "id", "left_semi").select("id").distinct()
