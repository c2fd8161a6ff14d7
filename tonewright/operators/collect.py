"""What the reports and the gap detectors read: counts, freshness, coverage, one state a profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.functions import vocab as V
from tonewright.operators import gaps
from tonewright.operators.drift import age_days

#: Words of traffic from which a context without authored cells is a gap.
TRAFFIC_FLOOR = 500


def count_by(rows: DataFrame, key: str) -> DataFrame:
    """(level, n); rows without a key are not counted."""
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("level")).agg(F.count("*").alias("n"))


def zero_filled(counts: DataFrame, levels: list[str] | tuple[str, ...]) -> DataFrame:
    """Every level of the vocabulary, unused ones with 0; other levels are left out."""
    spark = counts.sparkSession
    every = spark.createDataFrame([(k, x) for k, x in enumerate(levels)], "pos int, level string")
    return every.join(counts.select("level", "n"), "level", "left").select("pos", "level", F.coalesce("n", F.lit(0)).alias("n"))


def in_locale(rows: DataFrame, locale: str | None) -> DataFrame:
    return rows if locale is None else rows.where(F.col("locale") == locale)


def draft_owner(text: Column) -> Column:
    """The profile that a draft's frontmatter names; the house's without one."""
    head = F.regexp_extract(F.substring(text, 1, 2000), r"\A---\n([\s\S]*?)\n---", 1)
    owner = F.regexp_extract(head, r"(?m)^profile:[ \t]*(\S+)[ \t]*$", 1)
    return F.when(owner == "", "default").otherwise(owner)


def drafts_by_profile(drafts: DataFrame, text: str = "text") -> DataFrame:
    return drafts.groupBy(draft_owner(F.coalesce(text, F.lit(""))).alias("profile")).agg(F.count("*").alias("drafts"))


# --- freshness


def stale_inputs(card_modified: float | None, inputs: dict[str, float | None]) -> list[str] | None:
    """Inputs of a card that are newer than it; null without a card."""
    if card_modified is None:
        return None
    return [name for name, t in inputs.items() if t is not None and t > card_modified]


def manifest_freshness(manifest: DataFrame, files: DataFrame, generated: Column) -> DataFrame:
    """How many of the manifest's files changed since, and how many could be checked: files
    that went since are not counted.  `manifest`: origin; `files`: origin, modified."""
    met = manifest.select("origin").join(files.select("origin", "modified"), "origin")
    return met.agg(F.count_if(F.col("modified") > generated).alias("changed_since"), F.count("*").alias("checked"))


def source_freshness(classified: DataFrame | None, spark: SparkSession | None = None) -> DataFrame:
    """Stale and fresh sources, of files that are neither the project's nor addresses; null,
    not zero, where nothing was hashed.  `classified`: kind, class."""
    if classified is None:
        return spark.range(1).select(F.lit("unchecked").alias("freshness"), F.lit(None).cast("long").alias("stale"), F.lit(None).cast("long").alias("fresh"))
    rows = classified.where(~F.col("kind").isin("project", "url"))
    return rows.agg(F.lit("checked").alias("freshness"), F.count_if(F.col("class") == "stale").alias("stale"), F.count_if(F.col("class") == "fresh").alias("fresh"))


def human_age(days: Column) -> Column:
    """today, 1 day, n days, n months (of 30 days), n years; null is never."""
    plural = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))
    return F.when(days.isNull(), "never").when(days == 0, "today").when(days < 60, plural(days, "day")).when(days < 730, plural(F.floor(days / 30), "month")).otherwise(plural(F.floor(days / 365), "year"))


def age(then: Column, now: Column) -> Column:
    return human_age(age_days(then, now))


# --- coverage


def cells_by_state(grid: DataFrame) -> DataFrame:
    """Per context: authored or computed for each state, in the order of the states."""
    order = F.array(*map(F.lit, V.STATES))
    per = grid.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("state", "origin"))).alias("m"))  # 8 states a context
    return per.select("context", F.transform(order, lambda s: F.coalesce(F.try_element_at("m", s), F.lit("computed"))).alias("cells"))


def bare_contexts(coverage: DataFrame, floor: int = TRAFFIC_FLOOR) -> DataFrame:
    """Contexts without an authored cell that the corpus has words of."""
    return coverage.where((F.col("authored") == 0) & (F.col("traffic") >= floor)).select("context")


def without_pack(declared: DataFrame, packs: DataFrame) -> DataFrame:
    """Declared locales that have no pack."""
    return declared.select("locale").distinct().join(packs.select("locale").distinct(), "locale", "left_anti")


# --- the state


def speaker_summary(speakers: DataFrame, rules: DataFrame, cells: DataFrame, drafts: DataFrame) -> DataFrame:
    """One row a speaker.  `speakers`: slug, name, has_dials, words, has_baseline, drift_flagged,
    never_ingested, stale_card (null without a card); `rules`: slug, id, origin, overrides, violates."""
    own = rules.groupBy("slug").agg(F.count_if((F.col("origin") == "speaker") & F.col("id").startswith("V")).alias("voice_rules"), F.count_if("overrides").alias("overrides"), F.count_if("violates").alias("violations"))
    out = speakers.join(own, "slug", "left").join(cells.groupBy("slug").agg(F.count("*").alias("cells")), "slug", "left").join(drafts.select(F.col("profile").alias("slug"), "drafts"), "slug", "left")
    zero = F.lit(0).cast("long")
    return out.select("slug", "name", "has_dials", *[F.coalesce(c, zero).alias(c) for c in ("voice_rules", "overrides", "violations", "cells", "drafts")], "words", "has_baseline", "drift_flagged", "never_ingested", "stale_card")


def speaker_state(summary: DataFrame) -> DataFrame:
    """What the detectors read of the speakers, in one row; each thing is named by its speaker."""
    named = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("slug"))))  # noqa: E731  hand-written speakers
    late = F.flatten(F.array_sort(F.collect_list(F.transform(F.coalesce("stale_card", F.array().cast("array<string>")), lambda x: F.concat(F.lit("["), F.col("slug"), F.lit("] "), x)))))
    return summary.agg(
        named((F.col("voice_rules") == 0) & ~F.col("has_dials")).alias("voiceless_speakers"),
        named(~F.col("has_baseline")).alias("unbaselined_speakers"),
        named(F.col("never_ingested") > 0).alias("uningested_speakers"),
        late.alias("stale_speaker_cards"),
        F.count("*").alias("speakers"),
    )


def state(parts: list[DataFrame]) -> DataFrame:
    """One row of `gaps.STATE` from one-row parts; what no part knows is null (not zero)."""
    row = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each
    types = dict(x.strip().split(" ") for x in gaps.STATE.split(","))
    return row.select(*[F.col(c).cast(t).alias(c) if c in row.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()])
