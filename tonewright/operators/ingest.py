"""Ingestion as one job: what is resolved meets the index, and what is new is read.

Every step is a join or a projection over whole tables.  A file that cannot be read, or that
went between the listing and the hashing, is a row of `errors` and never ends the job."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.operators import index as I
from tonewright.operators.quality_gate import needs_model_tier
from tonewright.sources.extract import is_container

#: The index: its rows are sources, their statistics travel with them.
INDEX = (
    "sha256 string, entry_id string, register_id string, kind string, origin string, aliases array<string>, format string, locale string, profile string, "
    "status string, note string, tier string, tokens long, produced array<string>, analysed string"
)
READ = ("status", "note", "tier", "tokens")


@dataclass
class Ingested:
    index: DataFrame
    ingested: DataFrame
    folded: DataFrame
    reopened: DataFrame
    missing: DataFrame
    relocated: DataFrame
    escalate: DataFrame
    errors: DataFrame


def ingestible(files: DataFrame) -> DataFrame:
    """Text files of the project are read live; of the project only containers are ingested."""
    return files.where((F.col("kind") != "project") | F.coalesce(is_container(F.col("format")), F.lit(False)))


def only(rows: DataFrame, value: str | None, *columns: str) -> DataFrame:
    """Rows of which one of `columns` is `value`; all rows where nothing is asked for."""
    if value is None:
        return rows
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c) == value, F.lit(False))
    return rows.where(hit)


def vanished(listed: DataFrame, hashed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The listed files that are still there, and those that went before they were hashed."""
    here = hashed.where("sha256 is not null").select("origin", "sha256")
    gone = listed.join(here, "origin", "left_anti").select("origin", "register_id", F.lit("vanished").alias("reason"))
    return listed.join(here, "origin"), gone


def escalations(index: DataFrame, hashes: DataFrame) -> DataFrame:
    """Entries of these hashes that wait for a reader with a model."""
    return index.where(needs_model_tier(F.col("tier"), F.col("status"), F.coalesce("tokens", F.lit(0)), F.col("note"))).join(hashes.select("sha256").distinct(), "sha256", "left_semi")


def read_status(n: Column, passed: Column, note: Column) -> dict[str, Column]:
    """Status and note of what was read: without text it is skipped with `note` or no-text-layer."""
    empty = n == 0
    return {"status": F.when(empty | ~passed, "skipped").otherwise("used"), "note": F.when(empty, F.coalesce(note, F.lit("no-text-layer"))).when(~passed, F.lit("quality")).otherwise("ok")}


def run(index: DataFrame, resolved: DataFrame, read: Callable[[DataFrame], DataFrame], now: str, wanted: str | None = None, kept: Callable[[DataFrame], DataFrame] = lambda df: df, complete: bool = True) -> Ingested:
    """`resolved`: origin, sha256 (null where the file went), register_id, kind, format, locale,
    profile and whatever `read` needs.  `read` adds status, note, tier and tokens to the rows it
    is given, of which null status says that the file cannot be read (note says why).  `kept`
    stores what was hashed and what was read: index and reports are made of the stored rows.
    Where `resolved` is not `complete`, as a batch of a stream, what it lacks is not missing."""
    # contents are met again only by what is to be read
    payload = [c for c in ("content",) if c in resolved.columns]
    listed = kept(resolved.drop(*payload))
    gone = listed.where("sha256 is null").select("origin", "register_id", F.lit("vanished").alias("reason"))
    here = listed.where("sha256 is not null")
    cls = I.classify(index, here)
    asked = only(cls, wanted, "origin", "register_id", "entry_id")
    fresh, stale, double = (asked.where(F.col("class") == c) for c in ("fresh", "stale", "duplicate"))

    # one reading a hash: the first origin is the source's, the others are its aliases
    new = fresh.unionByName(stale)
    first = new.groupBy("sha256").agg(F.min("origin").alias("origin"))
    chosen = new.join(first, ["sha256", "origin"], "left_semi").dropDuplicates(["sha256"])
    # a file that changed since it was hashed is read as what it was hashed to, or not at all
    measured = read(chosen.join(resolved.select("origin", "sha256", *payload), ["origin", "sha256"]) if payload else chosen)
    measured = kept(measured.drop(*payload))
    failed = measured.where("status is null").select("origin", "register_id", F.coalesce("note", F.lit("unreadable")).alias("reason"))
    if payload:
        lost = chosen.join(measured.select("sha256"), "sha256", "left_anti")
        failed = failed.unionByName(lost.select("origin", "register_id", F.lit("vanished").alias("reason")))
    good = measured.where("status is not null").drop("class").withColumnRenamed("entry_id", "old_id")
    others = new.join(first.select("sha256", F.col("origin").alias("head")), "sha256").where("origin <> head").groupBy("sha256").agg(F.array_sort(F.collect_set("origin")).alias("aliases"))
    top = index.agg(F.coalesce(F.max(I.entry_number("entry_id")), F.lit(0)).alias("top"))
    none = F.array().cast("array<string>")
    named = I.number_rows(good.join(others, "sha256", "left"), "origin").crossJoin(F.broadcast(top))  # one row
    entries = named.withColumns({"entry_id": I.entry_name(F.col("top") + F.col("n")), "aliases": F.coalesce("aliases", none), "produced": none, "analysed": F.lit(now[:10])})
    # columns of the index that a reading does not know stay null
    entries = entries.select(*[F.col(c) if c in entries.columns else F.lit(None).cast(t).alias(c) for c, t in index.dtypes], "old_id")

    replaced = stale.join(entries.select("sha256"), "sha256", "left_semi").select("entry_id").distinct()
    displaced = index.join(replaced, "entry_id", "left_semi")
    kept = index.join(displaced.select("entry_id"), "entry_id", "left_anti").select(*index.columns)
    # a known hash at a further path is recorded as an alias
    more = double.groupBy("sha256").agg(F.collect_set("origin").alias("more"))
    kept = kept.join(more, "sha256", "left").withColumn("aliases", F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("more", none)))).select(*index.columns)
    orphans = I.missing(index, cls) if complete else index.where("false")
    after = I.mark_missing(kept, orphans).unionByName(entries.drop("old_id"))
    moved = I.reattribute(after, here.select("origin", "locale"))
    folded = double.select("origin", "entry_id").unionByName(new.join(first.select("sha256", F.col("origin").alias("head")), "sha256").where("origin <> head").join(entries.select("sha256", F.col("entry_id").alias("into")), "sha256").select("origin", F.col("into").alias("entry_id")))
    return Ingested(
        index=moved.select(*index.columns),
        ingested=entries,
        folded=folded,
        reopened=displaced.select("entry_id", "origin", F.explode("produced").alias("rule_id")),
        missing=orphans,
        relocated=moved.where("relocated").select("entry_id", "locale"),
        escalate=escalations(moved.select(*index.columns), asked.where("class <> 'duplicate'")),
        errors=gone.unionByName(failed),
    )


# --- addresses


def fetched(spark: SparkSession, urls: DataFrame, fetch: Callable[[str], tuple[int, str, str]], pause: float = 0.0) -> DataFrame:
    """(register_id, url, code, content_type, body, error) by a function of the caller's.  What
    is no web address is refused before anything is opened; what the function raises is the
    row's error.  Pages of a host are fetched one after the other, `pause` seconds apart, by a
    thread of the task that has the host, so that a slow host delays no other."""

    def one(row: tuple[str, str]) -> tuple:
        try:
            if not re.match("https?://", row[1] or "", re.I):
                raise ValueError("not a web address")
            return (*row, *fetch(row[1]), None)
        except Exception as e:  # a fetch may fail in any way
            return (*row, None, None, None, f"{type(e).__name__}: {e}")

    def of_host(rows: list[tuple[str, str]]) -> list[tuple]:
        out = []
        for k, row in enumerate(rows):
            time.sleep(pause if k else 0)
            out.append(one(row))
        return out

    def run_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts: dict[str | None, list[tuple[str, str]]] = {}
            for key, url, host in zip(*(c.to_pylist() for c in b.columns), strict=True):
                hosts.setdefault(host, []).append((key, url))
            with ThreadPoolExecutor(max(1, min(32, len(hosts)))) as pool:
                for done in (f.result() for f in as_completed([pool.submit(of_host, rows) for rows in hosts.values()])):
                    columns = list(zip(*done, strict=True))
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["register_id", "url", "code", "content_type", "body", "error"])

    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    dealt = urls.select("register_id", "url", host.alias("host")).repartition(4 * spark.sparkContext.defaultParallelism, "host")
    return dealt.mapInArrow(run_hosts, "register_id string, url string, code long, content_type string, body string, error string")


def page_status(pages: DataFrame, units: Column) -> DataFrame:
    """Adds `note`: unreadable (no web address, an error, no success, no text), no-text-layer
    (read, but without copy) or ok."""
    web = F.lower("url").rlike("^https?://")
    good = web & F.col("error").isNull() & F.col("code").between(200, 299) & F.coalesce(F.lower("content_type").rlike(r"^(?:text/|application/(?:xhtml\+xml|xml|json))"), F.lit(False))
    return pages.withColumn("note", F.when(~F.coalesce(good, F.lit(False)), "unreadable").when(F.size(units) == 0, "no-text-layer").otherwise("ok"))


def refresh(index: DataFrame, pages: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """`pages`: register_id, origin, sha256 and what an entry has.  An unchanged page is only
    dated; a changed one replaces its entry under a new number, with nothing produced; a new
    one is added.  Also returns (register_id, origin, outcome, entry_id, reopened)."""
    held = index.where("kind = 'url'").select(F.col("register_id").alias("hreg"), F.col("entry_id").alias("held_id"), F.col("sha256").alias("held_sha"), F.col("produced").alias("held_produced"))
    met = pages.drop("entry_id", "produced", "analysed").join(held, F.col("register_id") == F.col("hreg"), "left")
    outcome = F.when(F.col("held_id").isNull(), "added").when(F.col("held_sha") == F.col("sha256"), "unchanged").otherwise("changed")
    met = met.withColumn("outcome", outcome)
    top = index.agg(F.coalesce(F.max(I.entry_number("entry_id")), F.lit(0)).alias("top"))
    new = I.number_rows(met.where("outcome <> 'unchanged'"), "origin").crossJoin(F.broadcast(top))  # one row
    none = F.array().cast("array<string>")
    new = new.withColumns({"entry_id": I.entry_name(F.col("top") + F.col("n")), "kind": F.lit("url"), "aliases": none, "produced": none, "analysed": F.lit(now[:10])})
    same = met.where("outcome = 'unchanged'").select(F.col("held_id").alias("sid"))
    left = index.join(new.where("held_id is not null").select(F.col("held_id").alias("entry_id")), "entry_id", "left_anti")
    left = left.join(same, F.col("entry_id") == F.col("sid"), "left").withColumn("analysed", F.when(F.col("sid").isNotNull(), F.lit(now[:10])).otherwise(F.col("analysed"))).select(*index.columns)
    rows = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in index.dtypes])
    report = new.select("register_id", "origin", "outcome", "entry_id", F.coalesce("held_produced", none).alias("reopened")).unionByName(met.where("outcome = 'unchanged'").select("register_id", "origin", "outcome", F.col("held_id").alias("entry_id"), none.alias("reopened")))
    return left.unionByName(rows), report


# --- retraction of a speaker


def owned_rules(ledger: DataFrame, index: DataFrame, slug: str) -> DataFrame:
    """Rules that evidence or sources of the speaker produced: they reopen."""
    mine = lambda df: df.where(F.col("profile") == slug).select(F.explode("produced").alias("rule_id"))
    return mine(ledger).unionByName(mine(index)).distinct()


def without_speaker(index: DataFrame, slug: str) -> DataFrame:
    return index.where(F.coalesce("profile", F.lit("")) != slug)
