"""The statistics of units once more, as column expressions: the second opinion of the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.functions import text as T
from tonewright.functions import vocab as V


def _long(c: Column) -> Column:
    return c.cast("long")


def _total(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + f(x))


def _among(a: Column, values: tuple[str, ...]) -> Column:
    return _long(F.size(F.filter(a, lambda w: w.isin(*values))))


def unit_stats_by_columns(units: DataFrame, keep: tuple[str, ...] = ("unit_id", "locale")) -> DataFrame:
    """Counters of each unit (columns strings array<string>, headings array<string>, locale)."""
    english = F.lower("locale").startswith("en")
    base = units.select(*keep, "strings", "headings", F.array_join("strings", "\n\n").alias("t"), F.lower("locale").startswith("en").alias("has_english"), F.lower(F.substring("locale", 1, 2)).alias("lang"))
    cut = base.select("*", T.words(F.col("t")).alias("w"), F.flatten(F.transform("strings", T.sentences)).alias("s"), T.paragraphs(F.col("t")).alias("p"))
    cut = cut.select("*", F.transform("w", F.lower).alias("lw"), F.transform("s", lambda s: _long(F.regexp_count(s, F.lit(V.WORD)))).alias("n"))
    when_en = lambda c: F.when(F.col("has_english"), c).otherwise(F.lit(0).cast("long"))

    def person(lists: dict[str, tuple[str, ...]]) -> Column:
        out = F.lit(0).cast("long")
        for lang, words in lists.items():
            out = F.when(F.col("lang") == lang, _among(F.col("lw"), words)).otherwise(out)
        return out

    multi = F.filter(F.transform("headings", T.words), lambda h: F.size(h) >= 2)
    title = F.filter(multi, lambda h: F.forall(F.filter(h, lambda x, i: (i == 0) | ~F.lower(x).isin(*V.MINOR_WORDS)), lambda x: x.rlike(r"^[\p{Lu}\p{N}]")))
    passive = rf"(?i)(?<![A-Za-z0-9_])(?:{V.BE_VERBS})\s+(?:[A-Za-z0-9_]+ed|{V.PARTICIPLES})(?![A-Za-z0-9_])"
    contraction = rf"(?i)(?<![A-Za-z0-9_])[A-Za-z0-9_]+['’](?:{V.CONTRACTION_TAIL})(?![A-Za-z0-9_])"
    lists = F.regexp_extract_all("t", F.lit(V.SERIAL_LIST), F.lit(0))
    hist = {name: _long(F.size(F.filter("n", (lambda lo, hi: lambda x: (x >= lo) if hi is None else (x >= lo) & (x <= hi))(lo, hi)))) for name, lo, hi, _ in V.HISTOGRAM}
    cut = cut.withColumn("syl", F.when(english, T.syllable_counts(F.col("w"))))
    # without blank lines inside, the strings are the paragraphs
    split_inside = F.exists("strings", lambda x: x.rlike(r"\n[ \t]*\n"))
    per_paragraph = F.when(split_inside, _total(F.col("p"), lambda p: F.size(T.sentences(p)))).otherwise(_long(F.size("s")))
    values = {
        "strings": _long(F.size("strings")),
        "words": _long(F.size("w")),
        "sentences": _long(F.size("s")),
        "paragraphs": _long(F.size("p")),
        "sum_word_len": _total(F.col("w"), F.length),
        "sum_sent_len": _total(F.col("n"), lambda x: x),
        "sum_sent_len_sq": _total(F.col("n"), lambda x: x * x),
        "sum_para_sent": per_paragraph,
        "exclamations": _long(F.size(F.filter("s", lambda s: s.rlike(r"!\p{P}*$")))),
        "questions": _long(F.size(F.filter("s", lambda s: s.rlike(r"\?\p{P}*$")))),
        "emoji": _long(F.regexp_count("t", F.lit(V.EMOJI))),
        "em_dash": _long(F.regexp_count("t", F.lit(r"—|\s-\s"))),
        "semicolon": _long(F.regexp_count("t", F.lit(";"))),
        "first_person": person(V.FIRST_PERSON),
        "second_person": person(V.SECOND_PERSON),
        "headings_total": when_en(_long(F.size(multi))),
        "headings_title_case": when_en(_long(F.size(title))),
        **hist,
        "person_markers": F.col("lang").isin(*V.FIRST_PERSON),
        "has_english": F.col("has_english"),
        "syllables": when_en(_total(F.col("syl"), lambda x: x)),
        "contractions": when_en(_long(F.regexp_count("t", F.lit(contraction)))),
        "passive_sentences": when_en(_long(F.size(F.filter("s", lambda s: s.rlike(passive))))),
        "imperative_openers": when_en(_long(F.size(F.filter("s", lambda s: F.lower(F.regexp_extract(s, V.WORD, 0)).isin(*V.OPENERS))))),
        "hedges": when_en(_among(F.col("lw"), V.HEDGES)),
        "intensifiers": when_en(_among(F.col("lw"), V.INTENSIFIERS)),
        "oxford_lists": when_en(_long(F.size(lists))),
        "oxford_hits": when_en(_long(F.size(F.filter(lists, lambda x: x.rlike(V.OXFORD))))),
        "long_words": when_en(_long(F.size(F.filter("syl", lambda x: x > 3)))),
    }
    return cut.select(*keep, *[c.alias(k) for k, c in values.items()])
