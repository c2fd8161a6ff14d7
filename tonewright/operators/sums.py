"""Statistics kept as sums per profile and locale, and maintained by signed changes.

Every counter of a unit is a sum, and what a merge asks of its units besides (do all have
person markers, are English and other ones mixed) is asked of counts, so a unit is taken out
as it was put in: with a minus.  An index that changed changes its sums by the entries that
came and went alone; the others' statistics are not read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.functions import stats
from tonewright.functions import vocab as V

KEYS = ("profile", "locale")
COUNTS = ("units", "worded", "unmarked", "worded_unmarked", "worded_english", "worded_other")
SUMS = (*stats.COUNTERS, *stats.ENGLISH, *COUNTS)
SCHEMA = "profile string, locale string, " + ", ".join(f"{c} long" for c in SUMS)


def summed(rows: DataFrame, *keys: str, sign: int = 1) -> DataFrame:
    """Sums per key of rows with counters and flags; `sign` -1 takes them out."""
    worded, marked, english = F.col("words") > 0, F.coalesce("person_markers", F.lit(False)), F.coalesce("has_english", F.lit(False))
    asked = {"units": F.lit(True), "worded": worded, "unmarked": ~marked, "worded_unmarked": worded & ~marked, "worded_english": worded & english, "worded_other": worded & ~english}
    counters = [(F.coalesce(F.sum(c), F.lit(0)) * sign).cast("long").alias(c) for c in (*stats.COUNTERS, *stats.ENGLISH)]
    return rows.groupBy(*keys).agg(*counters, *[(F.count_if(x) * sign).cast("long").alias(c) for c, x in asked.items()])


def entries(index: DataFrame) -> DataFrame:
    """The entries whose statistics count; one without statistics or locale is an error."""
    rows = index.where(F.col("status").isin(*V.CONTRIBUTING))
    lacks = F.raise_error(F.lit("an indexed source lacks statistics or locale")).cast("string")
    return rows.withColumn("locale", F.when(F.col("stats").isNull() | F.col("locale").isNull(), lacks).otherwise(F.col("locale")))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed sums of what came and what went between two states of an index.  Entries, whose
    statistics are set once, meet by what they are and where they count; only those without a
    partner bring statistics."""
    what = F.md5(F.concat_ws("\x01", *[F.coalesce(F.col(c), F.lit("\x02")) for c in ("sha256", "entry_id", "profile", "locale")]))
    one, two = (df.where(F.col("status").isin(*V.CONTRIBUTING)).select(what.alias("met")).distinct() for df in (before, after))

    def without(df: DataFrame, other: DataFrame) -> DataFrame:
        return entries(df).withColumn("met", what).join(other, "met", "left_anti").select(*KEYS, "stats.*")

    return summed(without(after, one), *KEYS).unionByName(summed(without(before, two), *KEYS, sign=-1))


def together(*parts: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Sums of signed sums per key; keys whose last unit went are gone."""
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS]).where("units > 0")


def maintained(before: DataFrame, after: DataFrame, kept: DataFrame | None) -> DataFrame:
    """The kept sums after a change of the index; counted anew where none were kept."""
    return summed(entries(after).select(*KEYS, "stats.*"), *KEYS) if kept is None else together(kept, changes(before, after))


def merged(sums: DataFrame, *keys: str) -> DataFrame:
    """Kept sums in the form that `stats.finalise` takes."""
    every = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])
    mixed = F.raise_error(F.lit("English and other units cannot be merged")).cast("boolean")
    markers = F.when(F.col("worded") > 0, F.col("worded_unmarked") == 0).otherwise(F.col("unmarked") == 0)
    english = F.when((F.col("worded_english") > 0) & (F.col("worded_other") > 0), mixed).otherwise(F.col("worded_english") > 0)
    return every.withColumns({"person_markers": markers, "has_english": english})


def fingerprint(sums: DataFrame, *keys: str) -> DataFrame:
    return stats.finalise(merged(sums, *keys), *keys)
