"""Rules over the corpus: patterns, hits, ranking, review, promotion and health."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tonewright.functions import patterns
from tonewright.functions import vocab as V

RULES = "id string, kind string, file string, confidence string, locked boolean, avoid string, prefer string, pattern string"


def pattern_of(avoid: str | None, explicit: str | None, compiles) -> str | None:
    """An explicit regex, or the avoided term between characters that are no letters or digits;
    null for no term and for a regex that does not compile (it then scores 0)."""
    if explicit:
        p = "(?i)" + explicit
        return p if compiles(p) else None
    if not avoid or avoid in ("—", "-"):
        return None
    term = re.sub(r"[.*+?^${}()|\[\]\\]", lambda m: "\\" + m[0], avoid)
    return rf"(?iu)(?<![\p{{L}}\p{{N}}]){term}(?![\p{{L}}\p{{N}}])"


def java_compiles(spark: SparkSession):
    def check(p: str) -> bool:
        try:
            spark._jvm.java.util.regex.Pattern.compile(p)
            return True
        except Exception:  # the JVM's PatternSyntaxException
            return False

    return check


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """The rule base (a few hundred rows, written by hand) with its compiled patterns."""
    ok = java_compiles(spark)
    rows = [(r["id"], r.get("kind", "table"), r.get("file", "lexicon"), r.get("confidence"), bool(r.get("locked")), r.get("avoid"), r.get("prefer"), pattern_of(r.get("avoid"), r.get("pattern"), ok)) for r in rules]
    return spark.createDataFrame(rows, RULES)


FOUND = StructType([StructField("terms", ArrayType(StructType([StructField("id", StringType()), StructField("hits", LongType())]))), StructField("run", ArrayType(IntegerType()))])


def hits_per_unit(units: DataFrame, rules: DataFrame, text: str = "t") -> DataFrame:
    """Hits of every rule in every unit, in one pass over the text for any number of rules: all
    terms and the literals of the regexes are one automaton, and a regex runs only where its
    literal occurs.  Nothing is shuffled before the hits are summed.

    The rule base is hand-written; its patterns are collected and travel to the units."""
    held = [(r.id, r.avoid, r.pattern) for r in rules.where("pattern is not null").select("id", "avoid", "pattern").collect()]
    if not held:
        return units.sparkSession.createDataFrame([], "unit_id string, id string, hits long")
    terms = [(i, a) for i, a, p in held if a and p == pattern_of(a, None, None)]
    named = {i for i, _ in terms}
    regexes = [(i, p) for i, _, p in held if i not in named]
    known = patterns.Patterns(tuple(terms), tuple(patterns.needed_literal(p.removeprefix("(?i)")) if p.startswith("(?i)") else None for _, p in regexes))

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        return patterns.found(texts, known)

    seen = units.select("unit_id", F.col(text).alias("text"), find(text).alias("seen"))
    each = F.col("seen.terms")
    if regexes:
        ids, rx = (F.array(*[F.lit(x[k]) for x in regexes]) for k in (0, 1))
        ran = F.transform("seen.run", lambda k: F.struct(F.get(ids, k).alias("id"), F.regexp_count("text", F.get(rx, k)).cast("long").alias("hits")))
        each = F.concat(each, F.filter(ran, lambda x: x["hits"] > 0))
    return seen.select("unit_id", F.inline(each))


def hits(units: DataFrame, rules: DataFrame, text: str = "t") -> DataFrame:
    """(rule, hits, units) over the corpus; rules without a hit have 0."""
    found = hits_per_unit(units, rules, text).groupBy(F.col("id").alias("hid")).agg(F.sum("hits").alias("hits"), F.countDistinct("unit_id").alias("units"))
    zero = F.lit(0).cast("long")
    return rules.join(found, F.col("id") == F.col("hid"), "left").drop("hid").withColumns({"hits": F.coalesce("hits", zero), "units": F.coalesce("units", zero)})


def rank(counted: DataFrame) -> DataFrame:
    """Most hits first, then confirmed rules, then by id; disputed rules are left out."""
    return counted.where(F.coalesce("confidence", F.lit("")) != "disputed").orderBy(F.desc("hits"), F.when(F.col("confidence") == "confirmed", 0).otherwise(1), "id")


def severity(confidence: Column, locked: Column, always: Column | None = None) -> Column:
    """blocker, warning or nit; null is not reported."""
    top = F.coalesce(locked, F.lit(False)) if always is None else F.coalesce(locked, F.lit(False)) | F.coalesce(always, F.lit(False))
    return F.when(confidence == "disputed", None).when(top, "blocker").when(confidence == "confirmed", "blocker").when(confidence == "derived", "warning").when(confidence == "assumed", "nit")


SEVERITY_RANK = {"blocker": 0, "warning": 1, "nit": 2}


def review(units: DataFrame, rules: DataFrame, text: str = "t") -> DataFrame:
    """(unit_id, id, severity, hits) of what is reported."""
    found = hits_per_unit(units, rules, text)
    graded = rules.select("id", severity(F.col("confidence"), F.col("locked")).alias("severity"), "confidence", "locked").where("severity is not null")
    return found.join(F.broadcast(graded), "id").select("unit_id", "id", "severity", "hits")


def inventory(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.sum("hits").alias("findings"), F.countDistinct("unit_id").alias("units"), F.countDistinct("id").alias("rules"))


def worst_units(findings: DataFrame, k: int = 10) -> DataFrame:
    per = findings.groupBy("unit_id").agg(*[F.sum(F.when(F.col("severity") == s, F.col("hits")).otherwise(0)).alias(s + "s") for s in SEVERITY_RANK])
    return per.orderBy(F.desc("blockers"), F.desc("warnings"), F.desc("nits"), "unit_id").limit(k)


def promotable(counted: DataFrame, least: int = V.THRESHOLDS["derived_min_samples"], units: int = 2) -> DataFrame:
    """Patterns seen often enough in enough files to become derived rules."""
    return counted.where((F.col("hits") >= least) & (F.col("units") >= units))


def corroborated(swaps: DataFrame, least: int = V.THRESHOLDS["corroboration"]) -> DataFrame:
    """Corrections (from, to) that `least` different drafts make."""
    return swaps.groupBy("from_word", "to_word").agg(F.countDistinct("draft").alias("drafts")).where(F.col("drafts") >= least)


def learned(corrections: DataFrame, house: DataFrame, least: int = V.THRESHOLDS["corroboration"]) -> DataFrame:
    """What corrections (draft, profile, class, from_word, to_word) propose: from_word, to_word,
    scope, drafts, outcome.

    Factual corrections propose nothing.  A correction counts once a draft; `least` drafts of a
    profile clear it, and one does for a swap of the lexicon.  A correction of a house rule
    (`house`: avoid, locked) that drafts of two profiles or more make is proposed for the
    house, else for its profile.  Of a locked rule nothing is proposed: its outcome is locked."""
    c = corrections.where("class <> 'factual'").select("draft", F.coalesce("profile", F.lit("house")).alias("profile"), "class", "from_word", "to_word")
    each = c.groupBy("profile", "from_word", "to_word").agg(F.countDistinct("draft").alias("own"), F.bool_or(F.col("class") == "lexicon").alias("swap"))
    every = c.groupBy("from_word", "to_word").agg(F.countDistinct("draft").alias("all"), F.countDistinct("profile").alias("speakers"))
    known = house.groupBy(F.lower("avoid").alias("avoid")).agg(F.bool_or(F.coalesce("locked", F.lit(False))).alias("locked"))
    met = each.join(every, ["from_word", "to_word"]).join(known, F.lower("from_word") == F.col("avoid"), "left")
    shared = F.col("avoid").isNotNull() & (F.col("speakers") >= 2) & (F.col("all") >= least)
    met = met.withColumn("shared", shared).where(F.col("shared") | (F.col("own") >= least) | F.col("swap"))
    return met.select(
        "from_word", "to_word", F.when(F.col("shared"), "house").otherwise(F.col("profile")).alias("scope"), F.when(F.col("shared"), F.col("all")).otherwise(F.col("own")).alias("drafts"), F.when(F.coalesce("locked", F.lit(False)), "locked").otherwise("proposed").alias("outcome")
    ).distinct()


def health(counted: DataFrame, evidence: DataFrame, now: Column, stale_months: int = V.THRESHOLDS["stale_months"], kept: DataFrame | None = None, often: int = 2) -> DataFrame:
    """dead (never hit), stale (never hit and its newest evidence is old), overridden (its hits
    were kept `often` times or more; `kept`: id, times), disputed or live."""
    newest = evidence.groupBy(F.col("id").alias("eid")).agg(F.max("date").alias("newest"))
    old = F.months_between(now, F.col("newest")) > stale_months
    verdict = F.when(F.col("confidence") == "disputed", "disputed").when((F.col("hits") == 0) & F.coalesce(old, F.lit(False)), "stale").when(F.col("hits") == 0, "dead").otherwise("live")
    out = counted.join(newest, F.col("id") == F.col("eid"), "left").withColumn("health", verdict)
    if kept is not None:
        often_kept = kept.groupBy(F.col("id").alias("kid")).agg(F.sum("times").alias("times")).where(F.col("times") >= often)
        out = out.join(often_kept, F.col("id") == F.col("kid"), "left").withColumn("health", F.when((F.col("health") == "live") & (F.col("hits") > 0) & F.col("kid").isNotNull(), "overridden").otherwise(F.col("health")))
    return out.select("id", "confidence", "hits", "newest", "health")
