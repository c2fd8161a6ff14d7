"""Gap detectors: predicates over one state, each with a severity and a leverage.

The state is one row per profile; what a detector names comes from its columns.  Without a
knowledge base nothing else is reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = (
    "exists boolean, errors long, unbaselined array<string>, never_ingested long, rules long, assumed long, bare_contexts array<string>, stale_card_inputs array<string>, manifest_checked boolean, manifest_changed long, "
    "flagged_metrics long, disputed long, freshness_checked boolean, stale_sources long, locales_without_pack array<string>, drafts long, stale_extractors long, no_evidence long, card_tokens long, "
    "voiceless_speakers array<string>, unbaselined_speakers array<string>, uningested_speakers array<string>, stale_speaker_cards array<string>, speakers long, locks long"
)


def some(c: str) -> Column:
    return F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0


def over(c: str, n: int = 0) -> Column:
    return F.coalesce(F.col(c) > n, F.lit(False))


#: id, severity, leverage, predicate, what is missing, what to do.
DETECTORS = [
    ("G02", "blocker", 5, lambda: over("errors"), "validation errors", "mend the findings"),
    ("G03", "blocker", 4, lambda: some("unbaselined"), "locales without a drift baseline", "set a baseline"),
    ("G04", "blocker", 4, lambda: over("never_ingested"), "registered sources never ingested", "ingest them"),
    ("G05", "warning", 4, lambda: over("rules") & (F.col("assumed") == F.col("rules")), "every rule is assumed", "gather evidence"),
    ("G06", "warning", 3, lambda: some("bare_contexts"), "contexts with traffic and no authored cell", "author cells"),
    ("G07", "warning", 3, lambda: some("stale_card_inputs"), "the card is older than its inputs", "compile the card"),
    ("G08", "warning", 2, lambda: ~F.coalesce("manifest_checked", F.lit(False)) | over("manifest_changed"), "the manifest is absent or old", "scan"),
    ("G09", "warning", 2, lambda: over("flagged_metrics"), "metrics drifted", "review the drift"),
    ("G10", "warning", 2, lambda: over("disputed"), "disputed rules", "decide them"),
    ("G11", "warning", 2, lambda: F.coalesce("freshness_checked", F.lit(False)) & over("stale_sources"), "sources changed since they were read", "ingest again"),
    ("G12", "nit", 3, lambda: some("locales_without_pack"), "declared locales without a pack", "write the packs"),
    ("G13", "nit", 2, lambda: over("drafts"), "drafts wait", "learn from them"),
    ("G14", "nit", 1, lambda: over("stale_extractors"), "sources read by an older extractor", "ingest again"),
    ("G15", "nit", 1, lambda: over("no_evidence"), "rules without evidence", "link evidence"),
    ("G16", "nit", 1, lambda: over("card_tokens", 900), "the card is over 900 tokens", "shorten it"),
    ("G17", "blocker", 4, lambda: some("voiceless_speakers"), "speakers without voice rules or dials", "state their voice"),
    ("G18", "blocker", 3, lambda: some("unbaselined_speakers"), "speakers without a baseline", "set a baseline"),
    ("G19", "blocker", 3, lambda: some("uningested_speakers"), "speakers with sources never ingested", "ingest them"),
    ("G20", "warning", 3, lambda: some("stale_speaker_cards"), "speakers' cards older than their inputs", "compile their cards"),
    ("G21", "warning", 3, lambda: over("speakers") & (F.col("locks") == 0), "speakers but no locked rule", "lock the guardrails"),
]


def detect(state: DataFrame, *keep: str) -> DataFrame:
    """`keep` (what names the profile), id, severity, leverage, what, fix; unordered."""
    here = F.coalesce("exists", F.lit(False))
    row = lambda i, s, n, w, f: F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"), F.lit(n).alias("leverage"), F.lit(w).alias("what"), F.lit(f).alias("fix"))
    first = F.when(~here, row("G01", "blocker", 5, "no knowledge base", "make one"))
    rest = [F.when(here & test(), row(i, s, n, w, f)) for i, s, n, test, w, f in DETECTORS]
    return state.select(*keep, F.inline(F.filter(F.array(first, *rest), lambda x: x.isNotNull())))


def ranked(gaps: DataFrame) -> DataFrame:
    severity = F.when(F.col("severity") == "blocker", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return gaps.orderBy(F.desc("leverage"), severity, "id")


def interview_round(gaps: DataFrame, k: int = 4) -> DataFrame:
    return ranked(gaps).limit(k)
