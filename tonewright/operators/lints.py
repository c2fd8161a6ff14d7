"""Lints that hold for all copy: accessibility and readiness for translation.  Heuristics for
English, each one pattern over the text, counted in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lint and pattern; ‹ and › are the edges of a word, ^ the start of a line.
LINTS = (
    ("directional", r"(?i)‹(?:below|above|to the (?:left|right)|on the (?:left|right)|left-hand|right-hand)›"),
    ("click-here", r"(?i)‹(?:click|tap) here›"),
    ("bare-address", r"(?i)‹https?://[^\s)\]]+"),
    ("double-negative", r"(?i)‹(?:not|never|cannot|can't|don't|won't|isn't)›[^.!?]{0,30}‹(?:no|not|never|nothing|none|without|un[a-z]{3,})›"),
    ("ambiguous-word", r"(?i)‹(?:once|since|right|may|left)›"),
    ("gerund-opener", r"(?m)^[A-Z][a-z]+ing›"),
    ("unit-abbreviation", r"‹[0-9]+ ?(?:kb|mb|gb|sec|min|hrs?|km|kg)›"),
    ("acronym", r"‹[A-Z]{2,6}›"),
)


def java(pattern: str) -> str:
    edges = pattern.replace("‹", "(?<![A-Za-z0-9_])").replace("›", "(?![A-Za-z0-9_])")
    return edges.replace("(?m)", "(?md)")


def lint(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds a count for each lint."""
    body = F.coalesce(text, F.lit(""))
    return texts.withColumns({name.replace("-", "_"): F.regexp_count(body, F.lit(java(p))).cast("long") for name, p in LINTS})


def totals(texts: DataFrame, text: str = "text") -> DataFrame:
    """(lint, hits, texts)."""
    names = [n.replace("-", "_") for n, _ in LINTS]
    one = lint(texts, text).agg(*[F.sum(n).alias(n) for n in names], *[F.count_if(F.col(n) > 0).alias(f"{n}__t") for n in names])
    rows = [F.struct(F.lit(name).alias("lint"), F.coalesce(n, F.lit(0)).alias("hits"), F.col(f"{n}__t").alias("texts")) for (name, _), n in zip(LINTS, names, strict=True)]
    return one.select(F.inline(F.array(*rows)))
