"""Maintenance of the source index, a table keyed by content hash.

All operations are joins and anti-joins over whole tables (no Delta is assumed); identity is
the hash, never the path.  Index columns used: entry_id, sha256, origin, aliases, kind,
status, locale, produced; others pass through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonewright.functions import vocab as V


def entry_number(c: str) -> Column:
    """The number of an entry id (f007: 7); null for an id of another form."""
    return F.regexp_extract(c, "^[a-z]([0-9]{1,18})$", 1).try_cast("long")


def entry_order(c: str = "entry_id") -> Column:
    """Entries by number, then by name: f1000 comes after f999."""
    return F.struct(F.coalesce(entry_number(c), F.lit(-1)), F.col(c))


def entry_name(number: Column, prefix: str = "f", width: int = 3) -> Column:
    """A number as an entry id, padded to `width` digits and never cut."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))


def known_paths(index: DataFrame) -> DataFrame:
    """(sha256, path): the origin and aliases of every entry."""
    return index.select("sha256", F.explode(F.array_union(F.array("origin"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("path")).distinct()


def classify(index: DataFrame, resolved: DataFrame) -> DataFrame:
    """Each resolved file (origin, sha256) as known, duplicate, stale or fresh.

    The hash decides first; then the origin (the entry with the greatest id holds a repeated
    origin).  Adds `entry_id` of the entry met."""
    by_hash = index.groupBy("sha256").agg(F.max_by("entry_id", entry_order()).alias("hash_entry"))
    paths = known_paths(index).select(F.col("sha256").alias("psha"), "path", F.lit(True).alias("known_path"))
    by_origin = index.groupBy("origin").agg(F.max_by("entry_id", entry_order()).alias("origin_entry"))
    out = resolved.join(by_hash, "sha256", "left").join(paths, (F.col("sha256") == F.col("psha")) & (F.col("origin") == F.col("path")), "left").join(by_origin, "origin", "left")
    kind = F.when(F.col("hash_entry").isNotNull(), F.when(F.col("known_path"), "known").otherwise("duplicate")).when(F.col("origin_entry").isNotNull(), "stale").otherwise("fresh")
    return out.withColumns({"class": kind, "entry_id": F.coalesce("hash_entry", "origin_entry")}).drop("psha", "path", "known_path", "hash_entry", "origin_entry")


def missing(index: DataFrame, classified: DataFrame) -> DataFrame:
    """Entries that no resolved file reached; pages fetched from an address are never missing."""
    seen = classified.where(F.col("class").isin("known", "duplicate")).select("sha256").distinct()
    stale = classified.where("class = 'stale'").select("entry_id").distinct()
    return index.where("kind <> 'url'").join(seen, "sha256", "left_anti").join(stale, "entry_id", "left_anti")


def fold_aliases(files: DataFrame) -> DataFrame:
    """One row per hash: the first origin, and its other origins as sorted aliases."""
    first = F.min("origin")
    return files.groupBy("sha256").agg(first.alias("origin"), F.count("*").alias("files"), F.array_sort(F.collect_set("origin")).alias("__all")).withColumn("aliases", F.filter("__all", lambda x: x != F.col("origin"))).drop("__all")


def upsert(index: DataFrame, entries: DataFrame) -> DataFrame:
    """New hashes are added; for a known hash id and `added` stay, the rest is taken from the
    entry, and an origin that it displaces becomes an alias."""
    cols = [c for c in entries.columns if c not in ("sha256", "entry_id", "added", "aliases", "origin")]
    old, new = index.alias("o"), entries.alias("n")
    both = old.join(new, F.col("o.sha256") == F.col("n.sha256"), "full_outer")
    none = F.array().cast("array<string>")
    names = F.array_union(F.coalesce("o.aliases", none), F.coalesce("n.aliases", none))
    origin = F.coalesce("n.origin", "o.origin")
    names = F.when(F.col("o.origin") != F.col("n.origin"), F.array_union(names, F.array("o.origin"))).otherwise(names)
    picked = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in index.columns else F.col(f"n.{c}") for c in cols]
    kept = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("entry_id", "added") if c in index.columns]
    return both.select(F.coalesce("o.sha256", "n.sha256").alias("sha256"), *kept, origin.alias("origin"), F.filter(F.array_sort(names), lambda x: x != origin).alias("aliases"), *picked)


def supersede(index: DataFrame, classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stale entries replaced by entries with new ids and nothing produced; and the displaced
    entries, whose rules reopen.  New numbers follow the greatest one in the order of the digest of
    the origin: a running count over ranges of digests, not one global window."""
    stale = classified.where("class = 'stale'").select(F.col("entry_id").alias("old_id"), F.col("sha256").alias("new_sha"))
    displaced = index.join(stale, index.entry_id == stale.old_id, "left_semi")
    top = index.agg(F.coalesce(F.max(entry_number("entry_id")), F.lit(0)).alias("top"))
    moved = index.join(stale, index.entry_id == stale.old_id).drop("sha256", "old_id", "produced").withColumnRenamed("new_sha", "sha256")
    moved = number_rows(moved, "origin").crossJoin(F.broadcast(top))  # one row
    moved = moved.withColumns({"entry_id": entry_name(F.col("top") + F.col("n")), "produced": F.array().cast("array<string>"), "status": F.lit("used")}).drop("top", "n")
    rest = index.join(stale, index.entry_id == stale.old_id, "left_anti")
    return rest.unionByName(moved.select(*index.columns)), displaced


def number_rows(df: DataFrame, key: str) -> DataFrame:
    """Adds n: 1, 2, ... in the order of the MD5 digest of `key`.  The 256 ranges of digests
    are numbered in parallel and shifted by the counts of the ranges before."""
    b = df.withColumn("__d", F.md5(key)).withColumn("__b", F.substring("__d", 1, 2))
    counts = b.groupBy("__b").agg(F.count("*").alias("__c"))  # at most 256 rows
    shifts = counts.select(F.col("__b").alias("__k"), (F.sum("__c").over(Window.orderBy("__b")) - F.col("__c")).alias("__s"))
    n = F.row_number().over(Window.partitionBy("__b").orderBy("__d"))
    return b.withColumn("__r", n).join(F.broadcast(shifts), F.col("__b") == F.col("__k")).withColumn("n", F.col("__r") + F.col("__s")).drop("__b", "__d", "__r", "__s", "__k")


def mark_missing(index: DataFrame, gone: DataFrame) -> DataFrame:
    """Status `missing` (unless skipped); what was measured stays and still contributes."""
    g = gone.select(F.col("entry_id").alias("gid")).distinct()
    return index.join(g, F.col("entry_id") == F.col("gid"), "left").withColumn("status", F.when(F.col("gid").isNotNull() & (F.col("status") != "skipped"), "missing").otherwise(F.col("status"))).drop("gid")


def forget(index: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries that stay, and the rules to reopen."""
    gone = index.join(ids.select("entry_id").distinct(), "entry_id", "left_semi")
    return index.join(ids.select("entry_id").distinct(), "entry_id", "left_anti"), gone.select(F.explode("produced").alias("rule_id")).distinct()


def reattribute(index: DataFrame, resolved: DataFrame) -> DataFrame:
    """An entry takes the locale of the first of its paths that is resolved elsewhere (pages stay)."""
    paths = index.where("kind <> 'url'").select("entry_id", F.posexplode(F.array_union(F.array("origin"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "path"))
    met = paths.join(resolved.select(F.col("origin").alias("path"), F.col("locale").alias("found")), "path").groupBy("entry_id").agg(F.min_by("found", F.struct("pos", "found")).alias("found"))
    return index.join(met, "entry_id", "left").withColumns({"relocated": F.coalesce(F.col("found") != F.col("locale"), F.lit(False)), "locale": F.coalesce("found", "locale")}).drop("found")


def stale_extractors(index: DataFrame, libraries: DataFrame) -> DataFrame:
    """Entries read by another version of a library than the installed one."""
    lib = libraries.select(F.col("name").alias("lib"), F.col("version").alias("now"))
    return index.join(lib, (F.col("extractor.name") == F.col("lib")) & (F.col("extractor.version") != F.col("now")))


def contributing(index: DataFrame) -> DataFrame:
    """Rows whose statistics count; one without statistics or locale is an error."""
    rows = index.where(F.col("status").isin(*V.CONTRIBUTING))
    checked = F.when(F.col("stats").isNull() | F.col("locale").isNull(), F.raise_error(F.lit("an indexed source lacks statistics or locale")).cast("string")).otherwise(F.col("locale"))
    return rows.withColumn("locale", checked)


def gather(live: DataFrame, index: DataFrame) -> DataFrame:
    """Live units and, where no live unit has the origin, contributing index units."""
    held = index.where(F.col("status").isin(*V.CONTRIBUTING)).join(live.select("origin").distinct(), "origin", "left_anti")
    return live.unionByName(held, allowMissingColumns=True)


def unindexed(files: DataFrame, index: DataFrame) -> DataFrame:
    """Registered files that no entry holds as origin or alias."""
    return files.join(known_paths(index).select(F.col("path").alias("origin")).distinct(), "origin", "left_anti")
