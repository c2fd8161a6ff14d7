"""Tone arithmetic: dial vectors, speaker offsets, gates and the context x state matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.functions import vocab as V

VECTOR = ", ".join(f"{d} int" for d in V.DIALS)
CELL = f"context string, state string, {VECTOR}"


def vector_frame(spark: SparkSession, name: str, vectors: dict[str, tuple]) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in vectors.items()], f"{name} string, {VECTOR}")


def merge_vectors(house: DataFrame, overlay: DataFrame, name: str) -> DataFrame:
    """Overlay rows replace house rows whole."""
    o = overlay.select(F.col(name).alias("__k"), F.struct(*V.DIALS).alias("__o"))
    both = house.select(name, F.struct(*V.DIALS).alias("__h")).join(o, F.col(name) == F.col("__k"), "full_outer")
    chosen = F.coalesce("__o", "__h")
    return both.select(F.coalesce(name, "__k").alias(name), *[chosen[d].alias(d) for d in V.DIALS])


def neutral(dial: str) -> int:
    return 0 if dial == "humor" else 2


def default_dials(tone: Column) -> Column:
    """The `**Default dials:**` line as a map from dial to value; null without the line."""
    line = F.regexp_extract(tone, r"(?m)^\*\*Default dials:\*\*[ \t]*(.+)$", 1)
    pairs = F.regexp_extract_all(F.lower(line), F.lit(r"[a-z]+\s*[+-]?\d+"), F.lit(0))
    known = F.filter(pairs, lambda p: F.regexp_extract(p, "^[a-z]+", 0).isin(*V.DIALS))
    last = F.transform(F.array(*map(F.lit, V.DIALS)), lambda d: F.struct(d.alias("d"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(known, lambda p: F.regexp_extract(p, "^[a-z]+", 0) == d)), -1).alias("v")))
    kept = F.transform(F.filter(last, lambda x: x["v"].isNotNull()), lambda x: F.struct(x["d"], F.regexp_extract(x["v"], r"[+-]?\d+$", 0).cast("int")))
    return F.when(line != "", F.map_from_entries(kept))


def speaker_offset(house: Column, overlay: Column) -> dict[str, Column]:
    """Overlay minus house per dial; null where the overlay states no dials."""
    at = lambda m, d: F.coalesce(F.try_element_at(m, F.lit(d)), F.lit(neutral(d)))
    empty = F.create_map().cast("map<string,int>")
    return {d: F.when(overlay.isNotNull(), at(overlay, d) - at(F.coalesce(house, empty), d)) for d in V.DIALS}


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(4), c))


def matrix(spark: SparkSession, states: DataFrame, contexts: DataFrame, authored: DataFrame, speaker: dict[str, int] | None = None) -> DataFrame:
    """Every context x state: the first authored cell as written, else state + context +
    speaker, clamped, without humor; gated states never carry humor.  10 x 8 rows."""
    sv = states.select("state", *[F.col(d).alias(f"s_{d}") for d in V.DIALS])
    co = contexts.select("context", *[F.col(d).alias(f"c_{d}") for d in V.DIALS])
    names = spark.createDataFrame([(c, s) for c in V.CONTEXTS for s in V.STATES], "context string, state string")
    pos = F.col("pos") if "pos" in authored.columns else F.monotonically_increasing_id()
    first = authored.withColumn("__pos", pos).groupBy("context", "state").agg(F.min_by(F.struct(*V.DIALS), "__pos").alias("cell"))
    grid = names.join(F.broadcast(sv), "state", "left").join(F.broadcast(co), "context", "left").join(F.broadcast(first), ["context", "state"], "left")
    is_authored = F.col("cell").isNotNull()
    gated = F.col("state").isin(*V.HUMOR_FREE_STATES)

    def dial(d: str) -> Column:
        computed = clamp(F.coalesce(f"s_{d}", F.lit(2)) + F.coalesce(f"c_{d}", F.lit(0)) + F.lit((speaker or {}).get(d, 0)))
        if d == "humor":
            return F.when(is_authored & ~gated, F.col("cell.humor")).otherwise(0)
        return F.when(is_authored, F.col(f"cell.{d}")).otherwise(computed)

    return grid.select("context", "state", *[dial(d).cast("int").alias(d) for d in V.DIALS], F.when(is_authored, "authored").otherwise("computed").alias("origin"))


def coverage(grid: DataFrame, traffic: DataFrame) -> DataFrame:
    """Per context: authored cells, and the words of the paths attributed to it."""
    per = grid.groupBy("context").agg(F.count_if(F.col("origin") == "authored").alias("authored"), F.count("*").alias("of"))
    words = traffic.where("context is not null").groupBy(F.col("context").alias("tc")).agg(F.sum("words").alias("traffic"))
    return per.join(words, F.col("context") == F.col("tc"), "left").select("context", "authored", "of", F.coalesce("traffic", F.lit(0)).alias("traffic"))
