"""Sufficient statistics of text units, their merge and the style fingerprint.

A unit's statistics are sums, so merging is a grouped sum (commutative, associative, with
map-side partial aggregation); the fingerprint is arithmetic on merged sums.  English
counters exist for locales that start with `en`; merging English with other units that
hold words is refused.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tonewright.functions import scan
from tonewright.functions import text as T
from tonewright.functions import vocab as V

COUNTERS = (
    "strings", "words", "sentences", "paragraphs", "sum_word_len", "sum_sent_len", "sum_sent_len_sq", "sum_para_sent", "exclamations", "questions", "emoji", "em_dash", "semicolon",
    "first_person", "second_person", "headings_total", "headings_title_case", "h_1_5", "h_6_10", "h_11_20", "h_21_40", "h_41p",
)
ENGLISH = ("syllables", "contractions", "passive_sentences", "imperative_openers", "hedges", "intensifiers", "oxford_lists", "oxford_hits", "long_words")


FLAGS = ("person_markers", "has_english")
SCHEMA = StructType([*(StructField(c, LongType()) for c in (*COUNTERS, *ENGLISH)), *(StructField(c, BooleanType()) for c in FLAGS)])


@lru_cache(maxsize=1)
def _words() -> scan.Words:
    """One dictionary of words a worker process."""
    return scan.Words()


@F.arrow_udf(SCHEMA)
def _counted(strings: pa.Array, headings: pa.Array, locale: pa.Array) -> pa.Array:
    return scan.batch(strings, headings, locale, _words(), [*COUNTERS, *ENGLISH, *FLAGS])


def unit_stats(units: DataFrame, keep: tuple[str, ...] = ("unit_id", "locale")) -> DataFrame:
    """Counters of each unit (columns strings array<string>, headings array<string>, locale),
    in one pass over its text (see `scan`); no shuffle."""
    made = "counted"
    while made in keep:
        made += "_"
    counted = units.select(*keep, _counted("strings", "headings", "locale").alias(made))
    return counted.select(*keep, *[F.col(made)[c].alias(c) for c in (*COUNTERS, *FLAGS, *ENGLISH)])


def empty_guard() -> Column:
    """Refuses a mix of English and other units that hold words."""
    english = F.count_if(F.col("has_english") & (F.col("words") > 0))
    other = F.count_if(~F.col("has_english") & (F.col("words") > 0))
    return F.when((english > 0) & (other > 0), F.raise_error(F.lit("English and other units cannot be merged")).cast("boolean")).otherwise(english > 0)


def merge_stats(stats: DataFrame, *keys: str) -> DataFrame:
    """Sums per key; markers hold if all units have them."""
    worded = F.col("words") > 0
    return stats.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS],
        F.coalesce(F.bool_and(F.when(worded, F.col("person_markers"))), F.bool_and("person_markers"), F.lit(True)).alias("person_markers"),
        empty_guard().alias("has_english"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ENGLISH],
    )


def median_sentence() -> Column:
    """Midpoint of the first bucket that holds half of the sentences."""
    half, run, out = F.col("sentences") / 2, F.lit(0).cast("long"), None
    for name, _, _, mid in V.HISTOGRAM:
        run = run + F.col(name)
        out = F.when(run >= half, mid) if out is None else out.when(run >= half, mid)
    return F.when(F.col("sentences") > 0, out)


def finalise(merged: DataFrame, *keys: str) -> DataFrame:
    """The fingerprint: 16 universal and 8 English metrics; null is "cannot be measured"."""
    r, div = T.rounded, lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    en = lambda c: F.when(F.col("has_english"), c)
    per1000 = lambda a: r(F.try_divide(F.col(a) * 1000.0, F.col("words").cast("double")), 2)
    marked = lambda c: F.when(F.col("person_markers"), c)
    mean = div("sum_sent_len", "sentences")
    sd = F.when(F.col("sentences") > 0, r(F.sqrt(F.greatest(div("sum_sent_len_sq", "sentences") - mean * mean, F.lit(0.0))), 2))
    return merged.select(
        *keys,
        F.col("sentences").alias("sentence_count"),
        F.col("words").alias("word_count"),
        F.col("paragraphs").alias("paragraph_count"),
        r(mean, 2).alias("mean_sentence_length"),
        median_sentence().alias("median_sentence_length"),
        sd.alias("sentence_length_sd"),
        r(div("sum_para_sent", "paragraphs"), 2).alias("mean_paragraph_length"),
        r(div("sum_word_len", "words"), 2).alias("mean_word_length"),
        r(div("exclamations", "sentences"), 3).alias("exclamation_rate"),
        r(div("questions", "sentences"), 3).alias("question_rate"),
        per1000("emoji").alias("emoji_per_1000"),
        per1000("em_dash").alias("em_dash_per_1000"),
        per1000("semicolon").alias("semicolon_per_1000"),
        r(div("headings_title_case", "headings_total"), 3).alias("heading_title_case_ratio"),
        marked(per1000("first_person")).alias("first_person_per_1000"),
        marked(per1000("second_person")).alias("second_person_per_1000"),
        en(per1000("contractions")).alias("contraction_per_1000"),
        en(r(0.39 * div("words", "sentences") + 11.8 * div("syllables", "words") - 15.59, 2)).alias("reading_grade"),
        en(r(div("passive_sentences", "sentences"), 3)).alias("passive_rate"),
        en(r(div("imperative_openers", "sentences"), 3)).alias("imperative_opener_rate"),
        en(per1000("hedges")).alias("hedge_per_1000"),
        en(per1000("intensifiers")).alias("intensifier_per_1000"),
        en(r(div("oxford_hits", "oxford_lists"), 3)).alias("oxford_comma_rate"),
        en(r(div("long_words", "words"), 3)).alias("long_word_rate"),
    )


def fingerprint(units: DataFrame, *keys: str) -> DataFrame:
    return finalise(merge_stats(unit_stats(units), *keys), *keys)
