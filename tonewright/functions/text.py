"""Segmentation as column expressions (Column to Column): no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonewright.functions import vocab as V

_ABB = "|".join(a.replace(".", r"\.") for a in V.ABBREVIATIONS)
#: A run of .!? with its closers ends a sentence before a space, unless it is a single stop
#: after an abbreviation or after a lone capital.
_BOUNDARY = (
    r"((?<![.!?])(?:(?!(?<=(?<![\p{L}.])(?i:" + _ABB + r"))\.(?: |$))(?!(?<=(?:^|\s)\p{Lu})\.(?: |$)))[.!?]+[\"')\]»”’]*) "
)


def collapse(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, f"[{V.SPACE}]+", " "))


def normalize_eol(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"\A\x{feff}", ""), r"\r\n?", "\n")


def strip_control(t: Column) -> Column:
    return F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")


def sentences(t: Column) -> Column:
    marked = F.regexp_replace(collapse(t), _BOUNDARY, "$1\n")
    return F.filter(F.split(marked, "\n"), lambda s: F.length(F.trim(s)) > 0)


def words(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(V.WORD), F.lit(0))


def word_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(V.WORD)).cast("long")


def paragraphs(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, r"\n[ \t]*\n+"), lambda p: F.regexp_replace(p, rf"\A[{V.SPACE}]+|[{V.SPACE}]+\z", "")), lambda p: p != "")


def syllables(word: Column) -> Column:
    """English syllables of a word."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    core = F.regexp_replace(F.regexp_replace(letters, "(?:[^laeiouy]es|[^laeiouy]ed|[^laeiouy]e)$", ""), "^y", "")
    return F.when(letters == "", 0).when(F.length(letters) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(core, F.lit("[aeiouy]{1,2}"))))


def syllable_counts(words_: Column) -> Column:
    """`syllables` of every word of an array, by passes over the joined words instead of
    four regexes a word."""
    letters = F.regexp_replace(F.lower(F.array_join(words_, " ")), "[^a-z ]", "")
    core = F.regexp_replace(F.regexp_replace(letters, "(?:[^laeiouy ]es|[^laeiouy ]ed|[^laeiouy ]e)(?= |$)", ""), "(?<![^ ])y", "")
    groups = F.translate(F.regexp_replace(core, "[aeiouy]{1,2}", "1"), "bcdfghjklmnpqrstvwxz", "")
    each = F.zip_with(F.split(letters, " ", -1), F.split(groups, " ", -1), lambda w, g: F.when(w == "", 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.length(g))))
    return F.when(F.size(words_) > 0, each).otherwise(F.array().cast("array<int>"))


def rounded(x: Column, places: int) -> Column:
    """Half up, by floor; null stays null."""
    return F.floor(x * float(10**places) + 0.5) / float(10**places)


def token_estimate(t: Column) -> Column:
    return F.ceil(F.length(t) / 4).cast("long")
