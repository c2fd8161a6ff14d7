"""The extraction quality gate: shape shares of tokens against thresholds.

The rounded share is compared, so 0.01504 passes a limit of 0.015."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.functions import text as T
from tonewright.functions import vocab as V
from tonewright.sources.extract import is_url_or_handle


def tokens(t: Column) -> Column:
    parts = F.filter(F.split(t, f"[{V.SPACE}]+"), lambda x: (x != "") & ~is_url_or_handle(x))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"\A\p{P}+|\p{P}+\z", "")), lambda x: x.rlike(r"\p{L}"))


def score(df: DataFrame, text: str = "text", locale: str = "locale", fmt: str | None = None, tier: str | None = None, glyph_recall: str | None = None) -> DataFrame:
    """Adds tokens, mean_token_len, single_share, long_token_share, repl_share, novowel_share,
    glyph_recall, passed and reasons."""
    lang = F.lower(F.substring(locale, 1, 2))
    limit = F.when(lang.isin(*V.COMPOUNDING), V.LONG_TOKEN_COMPOUNDING).otherwise(V.LONG_TOKEN)
    letters = F.lit("")
    for x, allowed in V.SINGLE_LETTERS.items():
        letters = F.when(lang == x, allowed).otherwise(letters)
    shape = F.lit(True)
    if fmt:
        shape = F.coalesce(~F.col(fmt).isin(*V.AUTHORED_FORMATS), F.lit(True))
    if tier:
        shape = shape | (F.coalesce(F.col(tier), F.lit("")) == "model")
    out = df.withColumns({"__tok": tokens(F.col(text)), "__limit": limit, "__letters": letters})
    n = F.size("__tok")
    share = lambda f, places: T.rounded(F.try_divide(F.size(F.filter("__tok", f)).cast("double"), n.cast("double")), places)
    out = out.withColumns(
        {
            "tokens": n.cast("long"),
            "mean_token_len": T.rounded(F.try_divide(F.aggregate("__tok", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).cast("double"), n.cast("double")), 2),
            "single_share": share(lambda x: (F.length(x) == 1) & ~F.contains(F.col("__letters"), F.lower(x)), 3),
            "long_token_share": share(lambda x: F.length(x) > F.col("__limit"), 4),
            "repl_share": T.rounded(F.try_divide(F.regexp_count(text, F.lit("�")).cast("double"), n.cast("double")), 4),
            "novowel_share": share(lambda x: (F.length(x) > 3) & ~F.lower(x).rlike(f"[{V.VOWELS}]"), 3),
            "glyph_recall": T.rounded(F.col(glyph_recall), 3) if glyph_recall else F.lit(None).cast("double"),
        }
    )
    judged = shape & (F.col("tokens") >= V.MIN_SHAPE_TOKENS)
    failed = [
        F.when(F.col("tokens") == 0, "empty"),
        F.when(judged & (F.col("long_token_share") > V.QUALITY["long"]), "longTokenShare"),
        F.when(judged & (F.col("single_share") > V.QUALITY["single"]), "singleShare"),
        F.when(F.col("repl_share") > V.QUALITY["repl"], "replShare"),
        F.when(F.col("glyph_recall") < V.QUALITY["glyph"], "glyphRecall"),
    ]
    out = out.withColumn("reasons", F.filter(F.array(*failed), lambda x: x.isNotNull()))
    return out.withColumn("passed", F.size("reasons") == 0).drop("__tok", "__limit", "__letters")


def status(scored: DataFrame, tier: str | None = None) -> DataFrame:
    """used or skipped, and the fidelity of what is used."""
    model = F.coalesce(F.col(tier), F.lit("")) == "model" if tier else F.lit(False)
    return scored.withColumns({"status": F.when(F.col("passed"), "used").otherwise("skipped"), "fidelity": F.when(model, "estimated").otherwise("measured")})


def needs_model_tier(tier: Column, status_: Column, n: Column, note: Column) -> Column:
    return (tier == "script") & (status_ == "skipped") & ((n > 0) | ~F.coalesce(note, F.lit("ok")).isin("unreadable", "ok"))
