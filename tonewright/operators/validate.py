"""Integrity constraints: every check is a query that returns findings (severity, code, ref)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonewright.functions import vocab as V


def found(df: DataFrame, code: str, ref: str | Column = "id") -> DataFrame:
    """The rows of `df` as findings; a code's first letter gives its severity."""
    ref = F.col(ref) if isinstance(ref, str) else ref
    return df.select(F.lit("error" if code[0] == "E" else "warning").alias("severity"), F.lit(code).alias("code"), ref.cast("string").alias("ref"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def links(rules: DataFrame) -> DataFrame:
    return rules.select("id", F.explode("evidence").alias("ev"))


def rule_checks(rules: DataFrame, evidence: DataFrame, known: DataFrame) -> DataFrame:
    """`rules`: id, kind, file, confidence, evidence, locked, pos; `evidence`: id, type,
    produced; `known`: every id of house and overlays."""
    counted = rules.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("pos")))
    ev = evidence.select(F.col("id").alias("ev"), "type", "produced")
    refs = links(rules)
    made = evidence.select(F.col("id").alias("eid"), F.explode("produced").alias("id"))
    return union(
        [
            found(rules.where("kind = 'prose'").where(F.col("file").isin("lexicon", "mechanics")), "W_PROSE_RULE_IN_TABLE_FILE"),
            found(counted.where("n > 1").where(~(F.col("id").startswith("V") & F.coalesce("locked", F.lit(False)))), "E_DUPLICATE_ID"),
            found(rules.where(~F.substring("id", 1, 1).isin(*V.ID_PREFIXES)), "E_UNKNOWN_PREFIX"),
            found(rules.where("coalesce(confidence, '') = ''"), "E_NO_CONFIDENCE"),
            found(rules.where(F.col("confidence") != "").where(~F.col("confidence").isin(*V.CONFIDENCES)), "E_UNKNOWN_CONFIDENCE"),
            found(refs.join(ev, "ev", "left_anti"), "E_BROKEN_EVIDENCE_REF", F.concat_ws(":", "id", "ev")),
            found(refs.join(ev, "ev").where(~F.array_contains("produced", F.col("id"))), "W_ONE_WAY_EVIDENCE", F.concat_ws(":", "id", "ev")),
            found(rules.where("size(evidence) = 0").where(F.coalesce("confidence", F.lit("")) != "assumed"), "W_NO_EVIDENCE"),
            found(evidence.where(~F.col("type").isin(*V.EVIDENCE_TYPES)), "E_UNKNOWN_EVIDENCE_TYPE"),
            found(made.join(known.select("id").distinct(), "id", "left_anti"), "W_ORPHAN_EVIDENCE", F.concat_ws(":", "eid", "id")),
        ]
    )


def cell_checks(cells: DataFrame) -> DataFrame:
    """`cells`: context, state, dials map<string,int>."""
    ref = F.concat(F.lit("T-"), "context", F.lit("/"), "state")
    each = cells.select("*", F.explode("dials").alias("dial", "value"))
    absent = cells.select("*", F.explode(F.array_except(F.array(*map(F.lit, V.DIALS)), F.map_keys("dials"))).alias("dial"))
    return union(
        [
            found(cells.where(~F.col("context").isin(*V.CONTEXTS)), "E_UNKNOWN_CONTEXT", ref),
            found(cells.where(~F.col("state").isin(*V.STATES)), "E_UNKNOWN_STATE", ref),
            found(each.where(~F.col("dial").isin(*V.DIALS) | ~F.coalesce(F.col("value").between(0, 4), F.lit(False))), "E_DIAL_RANGE", F.concat_ws(":", ref, "dial")),
            found(absent, "E_DIAL_MISSING", F.concat_ws(":", ref, "dial")),
            found(cells.where(F.col("state").isin(*V.HUMOR_FREE_STATES) & (F.try_element_at("dials", F.lit("humor")) > 0)), "E_HUMOR_GATE", ref),
        ]
    )


def vector_checks(vectors: DataFrame) -> DataFrame:
    """`vectors`: kind (state or context), name, dials map<string,int>."""
    spark = vectors.sparkSession
    vocab = spark.createDataFrame([("state", s) for s in V.STATES] + [("context", c) for c in V.CONTEXTS], "kind string, name string")
    low = F.when(F.col("kind") == "state", 0).otherwise(-4)
    each = vectors.select("kind", "name", F.explode("dials").alias("dial", "value"))
    any_vector = vectors.limit(1).select(F.lit(1).alias("one"))
    unknown = vectors.join(F.broadcast(vocab), ["kind", "name"], "left_anti")
    return union(
        [
            found(unknown.where("kind = 'state'"), "E_UNKNOWN_STATE", "name"),
            found(unknown.where("kind = 'context'"), "E_UNKNOWN_CONTEXT", "name"),
            found(each.where(~F.col("value").between(low, F.lit(4))), "E_VECTOR_RANGE", F.concat_ws(":", "name", "dial")),
            found(vocab.join(vectors, ["kind", "name"], "left_anti").join(F.broadcast(any_vector), F.lit(True)), "W_MISSING_VECTOR", "name"),
        ]
    )


def lock_checks(locks: DataFrame, house: DataFrame, violations: DataFrame, profiles: DataFrame, folders: DataFrame) -> DataFrame:
    """Locks of unknown rules, overridden locks, and profiles without folder or the reverse."""
    pair = profiles.select(F.col("slug").alias("a")).join(folders.select(F.col("slug").alias("b")), F.col("a") == F.col("b"), "full_outer").where("a is null or b is null")
    return union([found(violations, "E_LOCKED_OVERRIDE"), found(locks.join(house.select("id"), "id", "left_anti"), "E_UNKNOWN_LOCK"), found(pair, "E_OVERLAY_DIR_MISMATCH", F.coalesce("a", "b"))])


def speaker_checks(speakers: DataFrame, house: DataFrame, overlay: DataFrame) -> DataFrame:
    """`speakers`: slug, has_dials; `overlay`: slug and the columns of rules."""
    number = lambda c: F.regexp_extract(c, "^[A-Z]([0-9]+)", 1)
    top = house.where(number("id") != "").groupBy(F.substring("id", 1, 1).alias("prefix")).agg(F.max(number("id").cast("int")).alias("top"))
    voiced = overlay.where("id like 'V%'").select("slug").distinct()
    silent = speakers.join(voiced, "slug", "left_anti").unionByName(speakers.where("not has_dials")).select("slug").distinct()
    new = overlay.join(house.select("id"), "id", "left_anti").where(number("id") != "").withColumn("prefix", F.substring("id", 1, 1)).where("prefix <> 'V'")
    close = new.join(top, "prefix").where(number("id").cast("int") < (F.floor(F.col("top") / 10) + 1) * 10)
    bare = overlay.join(house.select("id"), "id", "left_semi").where("id not like 'V%' and size(evidence) = 0")
    return union([found(silent, "W_SPEAKER_NO_VOICE", "slug"), found(close, "W_ID_RANGE_COLLISION_RISK"), found(bare, "W_OVERRIDE_UNEVIDENCED")])


def index_checks(index: DataFrame, known: DataFrame, rules: DataFrame, evidence: DataFrame, locales: DataFrame, libraries: DataFrame) -> DataFrame:
    """`index`: entry_id, sha256, status, locale, has_stats, produced, extractor, version."""
    made = index.select("entry_id", F.explode("produced").alias("id"))
    source = evidence.where("type = 'source'").select(F.col("id").alias("ev"))
    cited = links(rules).join(source, "ev", "left_semi").select("id").distinct()
    double = index.withColumn("n", F.row_number().over(Window.partitionBy("sha256").orderBy("entry_id"))).where("n > 1")
    counted = index.where(F.col("status").isin(*V.CONTRIBUTING))
    old = index.join(libraries.select(F.col("name").alias("extractor"), F.col("version").alias("now")), "extractor").where("version <> now")
    return union(
        [
            found(made.join(known.select("id").distinct(), "id", "left_anti"), "E_DANGLING_PRODUCED_ID", F.concat_ws(":", "entry_id", "id")),
            found(cited.join(made.select("id").distinct(), "id", "left_anti"), "E_SOURCE_NOT_INDEXED"),
            found(double, "E_DUPLICATE_SHA", "entry_id"),
            found(counted.where("not has_stats"), "E_NO_STATS", "entry_id"),
            found(index.where("locale is not null").join(locales.select("locale").distinct(), "locale", "left_anti"), "W_LOCALE_NOT_ACTIVE", "entry_id"),
            found(old, "W_STALE_EXTRACTOR", "entry_id"),
        ]
    )


def heading_checks(unparsed: DataFrame) -> DataFrame:
    return found(unparsed, "W_UNPARSED_RULE_HEADING")


def kb_checks(bases: DataFrame) -> DataFrame:
    """`bases`: root, exists (of `read_kb`: any of config, voice and tone)."""
    return found(bases.where("not exists"), "E_NO_KB", "root")


def summary(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
