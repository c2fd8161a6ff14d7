"""More queries: ingestion, refresh, retraction, freshness, counts, lints, order of ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonewright import measured
from tonewright import oracle as O
from tonewright.functions import text
from tonewright.functions import vocab as V
from tonewright.operators import collect, diff, drift, gaps, index, ingest, lints, quality_gate, rules
from tonewright.queries import _CLASS, _GATE, _HITS, _IDX, _PAIRS, _values, counted_rules, draft_pairs, index_and_resolved, query, table

LANGS = ("en", "de", "fr", "es", "cs")


@query("zero_filled_counts", f"SELECT v.level, coalesce(n, 0) AS n FROM {_values([(x,) for x in LANGS])} v(level) LEFT JOIN (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1) c ON c.lang = v.level")
def zero_filled_counts(spark, d):
    return collect.zero_filled(collect.count_by(table(spark, d, "documents"), "lang"), LANGS).select("level", "n")


@query("drafts_by_profile", "SELECT CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'default' END AS profile, count(*) AS drafts FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def drafts_by_profile(spark, d):
    docs = table(spark, d, "documents").where("lang is not null")
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\ntitle: x\nprofile: "), "lang", F.lit(" \nnote: y\n---\n"))).otherwise("profile: not-a-head\n")
    return collect.drafts_by_profile(docs.select(F.concat(head, F.coalesce("text", F.lit(""))).alias("text")))


@query("source_freshness", f"WITH {_CLASS} SELECT 'checked' AS freshness, count(*) FILTER (WHERE class = 'stale') AS stale, count(*) FILTER (WHERE class = 'fresh') AS fresh FROM cls WHERE origin NOT LIKE '%src1/%' UNION ALL SELECT 'unchecked', NULL, NULL")
def source_freshness(spark, d):
    cls = index.classify(*index_and_resolved(spark, d)).withColumn("kind", F.when(F.col("origin").contains("src1/"), "project").otherwise("local"))
    return collect.source_freshness(cls).unionByName(collect.source_freshness(None, spark))


@query("manifest_freshness", "SELECT count(*) FILTER (WHERE doc_id % 7 > 3) AS changed_since, count(*) AS checked FROM documents WHERE doc_id % 3 <> 0")
def manifest_freshness(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("doc_id", F.lit(".txt")).alias("origin"))
    now = F.make_timestamp(F.lit(2026), F.lit(1), 1 + (F.col("doc_id") % 7).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    there = docs.where("doc_id % 3 <> 0").select("origin", now.alias("modified"))
    return collect.manifest_freshness(docs, there, F.lit("2026-01-04 12:00:00").cast("timestamp"))


_DAYS = "greatest(CAST(floor((epoch_us(TIMESTAMP '2026-09-10 00:00:00') - epoch_us(ts)) / 86400000000) AS BIGINT), 0)"


@query("human_age", f"SELECT event_id, CASE WHEN a = 0 THEN 'today' WHEN a < 60 THEN a || ' day' || CASE WHEN a = 1 THEN '' ELSE 's' END WHEN a < 730 THEN (a // 30) || ' month' || CASE WHEN a // 30 = 1 THEN '' ELSE 's' END ELSE (a // 365) || ' year' || CASE WHEN a // 365 = 1 THEN '' ELSE 's' END END AS age FROM (SELECT event_id, {_DAYS} AS a FROM events)")
def human_age(spark, d):
    return table(spark, d, "events").select("event_id", collect.human_age(drift.age_days(F.col("ts").cast("timestamp"), F.lit("2026-09-10 00:00:00").cast("timestamp"))).alias("age"))


_ORDER = f"CASE state {' '.join(f'WHEN {O.q(x)} THEN {k}' for k, x in enumerate(V.STATES))} END"


@query("cells_by_state", f"WITH {measured.grid_sql({})} SELECT context, string_agg(origin, ',' ORDER BY {_ORDER}) AS cells FROM grid GROUP BY context")
def cells_by_state(spark, d):
    return collect.cells_by_state(measured.grid(spark, d)).select("context", F.array_join("cells", ",").alias("cells"))


# --- ingestion


_AFTER = """gonepath AS (SELECT entry_id FROM gone), displaced AS (SELECT DISTINCT entry_id FROM cls WHERE class = 'stale'),
after AS (SELECT origin, sha256, CASE WHEN entry_id IN (SELECT entry_id FROM gonepath) THEN 'missing' ELSE status END AS status FROM idx WHERE entry_id NOT IN (SELECT entry_id FROM displaced)
UNION ALL SELECT min(origin), sha256, 'used' FROM cls WHERE class IN ('fresh', 'stale') GROUP BY sha256)"""


def _ingested(spark, d) -> ingest.Ingested:
    idx, res = index_and_resolved(spark, d)
    types = dict(x.strip().split(" ") for x in ingest.INDEX.split(","))
    idx = idx.select(*[F.col(c) if c in idx.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()])
    rows = res.withColumns({"kind": F.lit("local"), "register_id": F.lit("s01"), "format": F.lit("text"), "profile": F.lit(None).cast("string")})
    read = lambda df: df.withColumns({"status": F.lit("used"), "note": F.lit("ok"), "tier": F.lit("script"), "tokens": F.lit(1).cast("long")})
    return ingest.run(idx, rows, read, "2026-09-10")


@query("ingest_batch", f"WITH {_CLASS}, {_AFTER} SELECT origin, sha256, status FROM after")
def ingest_batch(spark, d):
    return _ingested(spark, d).index.select("origin", "sha256", "status")


@query("ingest_reopened", f"WITH {_CLASS}, {_AFTER} SELECT entry_id, unnest(produced) AS rule_id FROM idx WHERE entry_id IN (SELECT entry_id FROM displaced)")
def ingest_reopened(spark, d):
    return _ingested(spark, d).reopened.select("entry_id", "rule_id")


@query("ingest_only", "SELECT source, count(*) AS n FROM documents WHERE source = 'src2' OR lang = 'de' GROUP BY 1")
def ingest_only(spark, d):
    docs = table(spark, d, "documents").select("source", "lang")
    a, b = ingest.only(docs, "src2", "source", "lang"), ingest.only(docs, "de", "source", "lang").where("coalesce(source, '') <> 'src2'")
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("n"))


@query("escalations", f"WITH {_IDX} SELECT entry_id FROM idx WHERE number % 4 = 1 AND sha256 IN (SELECT sha256 FROM idx WHERE locale = 'en')")
def escalations(spark, d):
    idx, _ = index_and_resolved(spark, d)
    number = index.entry_number("entry_id") - 1
    note = F.when(number % 4 == 1, "no-text-layer").when(number % 4 == 2, "unreadable").otherwise("ok")
    rows = idx.withColumns({"tier": F.lit("script"), "status": F.when(number % 4 > 0, "skipped").otherwise("used"), "tokens": F.lit(0), "note": note})
    return ingest.escalations(rows, idx.where("locale = 'en'")).select("entry_id")


_PAGES = """held AS (SELECT 'f' || CASE WHEN page_id < 99 THEN lpad(CAST(page_id + 1 AS VARCHAR), 3, '0') ELSE CAST(page_id + 1 AS VARCHAR) END AS entry_id, page_id, url || '#' || page_id AS origin FROM pages WHERE page_id % 5 <> 0),
out AS (SELECT p.page_id, p.url || '#' || p.page_id AS origin, CASE WHEN h.page_id IS NULL THEN 'added' WHEN p.page_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS outcome, h.entry_id AS held_id FROM pages p LEFT JOIN held h ON h.page_id = p.page_id),
placed AS (SELECT *, (SELECT max(page_id) + 1 FROM held) + row_number() OVER (PARTITION BY outcome <> 'unchanged' ORDER BY md5(origin)) AS n FROM out),
numbered AS (SELECT *, CASE WHEN outcome = 'unchanged' THEN held_id WHEN n < 100 THEN 'f' || lpad(CAST(n AS VARCHAR), 3, '0') ELSE 'f' || n END AS entry_id FROM placed)"""


@query("refresh_pages", f"WITH {_PAGES} SELECT origin, outcome, entry_id FROM numbered")
def refresh_pages(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat("url", F.lit("#"), "page_id").alias("origin"), F.coalesce("html", F.lit("")).alias("html"), F.concat(F.lit("u"), "page_id").alias("register_id"))
    types = dict(x.strip().split(" ") for x in ingest.INDEX.split(","))
    held = p.where("page_id % 5 <> 0").withColumns({"sha256": F.sha2("html", 256), "entry_id": index.entry_name(F.col("page_id") + 1), "kind": F.lit("url"), "status": F.lit("used"), "produced": F.array(F.lit("V1"))})
    held = held.select(*[F.col(c) if c in held.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()])
    now = p.withColumn("sha256", F.sha2(F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")), 256)).drop("html", "page_id")
    _, report = ingest.refresh(held, now, "2026-09-10")
    return report.select("origin", "outcome", "entry_id")


@query("fetch_contract", "SELECT page_id, CASE WHEN page_id % 6 IN (1, 2, 3, 4) THEN 'unreadable' WHEN page_id % 6 = 5 THEN 'no-text-layer' ELSE 'ok' END AS note FROM pages")
def fetch_contract(spark, d):
    k = F.col("page_id") % 6
    p = table(spark, d, "pages").select("page_id", F.when(k == 1, "ftp://x.y/z").otherwise("https://x.y/z").alias("url"), F.when(k == 2, 404).otherwise(200).alias("code"), F.when(k == 3, "image/png").otherwise("text/html").alias("content_type"), F.when(k == 4, "TimeoutError").alias("error"), F.when(k == 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("copy"))).alias("units"))
    return ingest.page_status(p, F.col("units")).select("page_id", "note")


@query("retract_speaker", f"WITH {_IDX} SELECT DISTINCT rule_id FROM (SELECT unnest(produced) AS rule_id FROM idx WHERE locale = 'de' UNION ALL SELECT 'X7')")
def retract_speaker(spark, d):
    idx, _ = index_and_resolved(spark, d)
    ledger = spark.createDataFrame([("maya", ["X7", "V1"]), (None, ["X8"]), ("jonas", ["X9"])], "profile string, produced array<string>")
    return ingest.owned_rules(ledger, idx.withColumn("profile", F.when(F.col("locale") == "de", "maya")), "maya")


# --- order, limits, lints


@query("path_order", f"WITH {_IDX} SELECT origin FROM idx ORDER BY origin LIMIT 20")
def path_order(spark, d):
    idx, _ = index_and_resolved(spark, d)
    return idx.select("origin").orderBy("origin").limit(20)


@query("latest_entries", f"WITH {_IDX} SELECT entry_id FROM idx ORDER BY number DESC LIMIT 20")
def latest_entries(spark, d):
    idx, _ = index_and_resolved(spark, d)
    return idx.select("entry_id").orderBy(index.entry_order().desc()).limit(20)


_LINT = " UNION ALL ".join(f"SELECT {O.q(n)} AS lint, CAST(coalesce(sum(c), 0) AS BIGINT) AS hits, count(*) FILTER (WHERE c > 0) AS texts FROM (SELECT len(regexp_extract_all(coalesce(text, ''), {O.q(p.replace('‹', chr(92) + 'b').replace('›', chr(92) + 'b'))})) AS c FROM documents)" for n, p in lints.LINTS)


@query("always_on_lints", _LINT)
def always_on_lints(spark, d):
    return lints.totals(table(spark, d, "documents"))


@query("locale_seed", f"SELECT t.locale, quotes, date, thousands, decimal, currency, texts FROM {_values([(k, *v) for k, v in V.LOCALE_SEED.items()])} t(locale, quotes, date, thousands, decimal, currency) JOIN (SELECT lang, count(*) AS texts FROM documents GROUP BY lang) d ON d.lang = split_part(t.locale, '-', 1)")
def locale_seed(spark, d):
    """The typography of the languages that the documents are written in, and how many texts it is for."""
    seeds = spark.createDataFrame([(k, *v) for k, v in V.LOCALE_SEED.items()], "locale string, quotes string, date string, thousands string, decimal string, currency string")
    texts = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("texts"))
    return texts.join(F.broadcast(seeds), F.col("lang") == F.substring_index("locale", "-", 1)).drop("lang")


@query("rule_health_kept", f"WITH {_HITS} SELECT id, CASE WHEN confidence = 'disputed' THEN 'disputed' WHEN hits = 0 THEN 'dead' WHEN id = 'L02' THEN 'overridden' ELSE 'live' END AS health FROM counted")
def rule_health_kept(spark, d):
    none = spark.createDataFrame([], "id string, date date")
    kept = spark.createDataFrame([("L02", 3), ("L03", 1), ("L04", 5), ("L05", 9)], "id string, times int")
    counted = counted_rules(spark, d)
    return rules.health(counted, none, F.lit("2026-09-10").cast("date"), kept=kept).select("id", "health")


_W = lambda t: f"CAST(len({O.words(t)}) AS BIGINT)"


@query("word_diff_identity", f"WITH {_PAIRS} SELECT conv_id, turn, {_W('draft')} AS before_words, {_W('final')} AS after_words FROM pairs")
def word_diff_identity(spark, d):
    """The words of a draft are those removed and kept, of a final those added and kept."""
    return diff.diff(draft_pairs(spark, d)).select("conv_id", "turn", (F.col("unchanged") + F.col("removed")).alias("before_words"), (F.col("unchanged") + F.col("added")).alias("after_words"))


@query("gaps_by_source", measured.gaps_sql(gaps.DETECTORS))
def gaps_by_source(spark, d):
    """Every detector over the state of every source, as measured from its texts."""
    return gaps.detect(measured.states(measured.texts(spark, d)), "source").select("source", "id", "severity", "leverage")


@query("stages_by_source", measured.stages_sql())
def stages_by_source(spark, d):
    return drift.stages(measured.stages(measured.texts(spark, d)))


_FORMATS = {"en": "pdf", "de": "docx", "fr": "markdown"}
_READ_TEXTS = f"texts AS (SELECT doc_id, lang AS locale, text, CASE lang {' '.join(f'WHEN {O.q(k)} THEN {O.q(v)}' for k, v in _FORMATS.items())} END AS format, CASE WHEN quality = 0 THEN 'model' ELSE 'script' END AS tier, CASE WHEN n > 0 THEN 1 - detail * 18.0 / n END AS recall FROM m)"
_JUDGED = f"""WITH {measured.SQL}, {_READ_TEXTS}, {_GATE}, both_ AS (SELECT g.*, tier, {O.rounded('recall', 3)} AS glyph_recall, coalesce(format NOT IN {O.among(V.AUTHORED_FORMATS)}, true) OR tier = 'model' AS shape FROM gate g JOIN texts t ON t.doc_id = g.doc_id),
last AS (SELECT *, list_filter([CASE WHEN tokens = 0 THEN 'empty' END, CASE WHEN shape AND tokens >= 10 AND long_token_share > 0.015 THEN 'longTokenShare' END, CASE WHEN shape AND tokens >= 10 AND single_share > 0.1 THEN 'singleShare' END, CASE WHEN repl_share > 0.005 THEN 'replShare' END, CASE WHEN glyph_recall < 0.5 THEN 'glyphRecall' END], lambda x: x IS NOT NULL) AS r FROM both_)
SELECT doc_id, glyph_recall, array_to_string(r, ',') AS reasons, CASE WHEN len(r) = 0 THEN 'used' ELSE 'skipped' END AS status, CASE WHEN tier = 'model' THEN 'estimated' ELSE 'measured' END AS fidelity FROM last"""


@query("quality_gate_read", _JUDGED)
def quality_gate_read(spark, d):
    """The gate over texts that readers gave: shapes are judged of what was extracted, not of what
    was authored, unless a model read it; a reader's recall of glyphs is judged always."""
    kind = F.lit(None).cast("string")
    for lang, name in _FORMATS.items():
        kind = F.when(F.col("lang") == lang, name).otherwise(kind)
    t = measured.texts(spark, d).select("doc_id", F.col("lang").alias("locale"), "text", kind.alias("format"), F.when(F.col("quality") == 0, "model").otherwise("script").alias("tier"), F.when(F.col("n") > 0, 1 - F.col("detail") * 18.0 / F.col("n")).alias("recall"))
    scored = quality_gate.status(quality_gate.score(t, fmt="format", tier="tier", glyph_recall="recall"), tier="tier")
    return scored.select("doc_id", "glyph_recall", F.array_join("reasons", ",").alias("reasons"), "status", "fidelity")


_LEARNED = f"""WITH {_PAIRS}, sw AS (SELECT conv_id || '/' || turn AS draft, CASE WHEN length(draft) > 300 THEN 'maya' ELSE 'jonas' END AS profile, CASE WHEN length(final) > 900 THEN 'factual' WHEN length(final) < 60 THEN 'lexicon' ELSE 'style' END AS class, unnest(list_zip({O.words('lower(draft)')}, {O.words('lower(final)')})) AS p FROM pairs),
c AS (SELECT draft, profile, class, p[1] AS a, p[2] AS b FROM sw WHERE p[1] <> p[2] AND class <> 'factual'), each_ AS (SELECT profile, a, b, count(DISTINCT draft) AS own, bool_or(class = 'lexicon') AS swap FROM c GROUP BY ALL),
every_ AS (SELECT a, b, count(DISTINCT draft) AS n, count(DISTINCT profile) AS speakers FROM c GROUP BY ALL), known AS (SELECT lower({O.words('text')}[1]) AS avoid, bool_or(length(text) > 250) AS locked FROM benchmark GROUP BY 1),
met AS (SELECT e.*, n, coalesce(locked, false) AS locked, avoid IS NOT NULL AND speakers >= 2 AND n >= 2 AS shared FROM each_ e JOIN every_ t ON t.a = e.a AND t.b = e.b LEFT JOIN known ON avoid = e.a)
SELECT DISTINCT a AS from_word, b AS to_word, CASE WHEN shared THEN 'house' ELSE profile END AS scope, CASE WHEN shared THEN n ELSE own END AS drafts, CASE WHEN locked THEN 'locked' ELSE 'proposed' END AS outcome FROM met WHERE shared OR own >= 2 OR swap"""


@query("learned_rules", _LEARNED)
def learned_rules(spark, d):
    """What the words that stand at one place of a draft and of its answer would propose."""
    at = F.explode(F.arrays_zip(text.words(F.lower("draft")).alias("a"), text.words(F.lower("final")).alias("b")))
    kind = F.when(F.length("final") > 900, "factual").when(F.length("final") < 60, "lexicon").otherwise("style")
    swaps = draft_pairs(spark, d).select(F.concat_ws("/", "conv_id", "turn").alias("draft"), F.when(F.length("draft") > 300, "maya").otherwise("jonas").alias("profile"), kind.alias("class"), at.alias("p"))
    made = swaps.select("draft", "profile", "class", F.col("p.a").alias("from_word"), F.col("p.b").alias("to_word")).where("from_word <> to_word")
    house = table(spark, d, "benchmark").select(F.get(text.words(F.col("text")), 0).alias("avoid"), (F.length("text") > 250).alias("locked"))
    return rules.learned(made, house)
