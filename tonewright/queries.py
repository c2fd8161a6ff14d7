"""The query catalogue: every query reads its whole table, or the inline fixture of hand-written
rules it is about; `ORACLES` holds the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright import measured
from tonewright import oracle as O
from tonewright.functions import stats, text
from tonewright.functions import vocab as V
from tonewright.operators import diff, drift, gaps, index, overlay, quality_gate, rules, sums, tone, validate
from tonewright.sources import extract, files

QUERIES = {}
ORACLES: dict[str, str] = {}

#: Inline units that hold what the tables lack: blank lines, questions, dashes, emoji, contractions.
EXTRA_UNITS = [
    ("x1", "en", ["Your campaign is scheduled.", "Nice work!", "Want to schedule another one?", "We sent it - the report is ready; check your inbox."], []),
    ("x2", "en", ["x"], ["Schedule A Campaign", "Schedule a campaign", "Reports", "Set Up Billing"]),
    ("x3", "de", ["Wir senden dir Berichte."], ["Kunden Berichte", "Neue Einstellungen"]),
    ("x4", "en", ["We didn't send it.", "The report was generated by the system.", "Open the settings page.", "This might possibly work.", "It is very extremely good.", "Email, social, and web.", "Email, social and web."], []),
    ("x5", "en", ["Ask Dr. Smith about it.\n\nContact J. Smith today — now 😀. She said \"go.\" Then she left.", "etc. Then stop."], ["One"]),
    ("x6", "fr", [], []),
]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: A Parquet row group, the least that a task reads, holds this many bytes by default.
ROW_GROUP = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Text functions are heavy per row, and one task reads a row group whole, however small the
    splits: a table of fewer files than cores, and of less than a row group a core, is dealt to
    all cores; a larger one stays as it is, and its text is never shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= cores * ROW_GROUP:
        return df
    return df.repartition(cores)


def document_units(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return spread(table(spark, d, "documents").select("doc_id", "lang", "text")).select(F.concat(F.lit("d"), F.col("doc_id")).alias("unit_id"), F.col("lang").alias("locale"), F.array(F.coalesce("text", F.lit(""))).alias("strings"), none.alias("headings"))


def units(spark: SparkSession, d: str) -> DataFrame:
    extra = spark.createDataFrame([(u, loc, s, h) for u, loc, s, h in EXTRA_UNITS], "unit_id string, locale string, strings array<string>, headings array<string>")
    return document_units(spark, d).unionByName(extra)


def _list(a: list[str]) -> str:
    return "[" + ", ".join(O.q(s) for s in a) + "]::VARCHAR[]"


_DOCS = "SELECT 'd' || doc_id AS unit_id, lang AS locale, [coalesce(text, '')] AS strings, []::VARCHAR[] AS headings FROM documents"
_UNITS = f"units AS ({_DOCS} UNION ALL " + " UNION ALL ".join(f"SELECT {O.q(u)}, {O.q(loc)}, {_list(s)}, {_list(h)}" for u, loc, s, h in EXTRA_UNITS) + ")"


@query("fingerprint_by_locale", f"WITH {_UNITS}, {O.unit_stats('units')}, {O.merged()} {O.finalised()}")
def fingerprint_by_locale(spark, d):
    return stats.fingerprint(units(spark, d), "locale")


_BATCH = "SELECT 'd' || doc_id AS unit_id, lang AS locale, [CASE WHEN lang IN ('de', 'fr') THEN coalesce(text, '') || ' And more! Is it?' ELSE coalesce(text, '') END] AS strings, []::VARCHAR[] AS headings FROM documents WHERE source IS DISTINCT FROM 'src1'"


@query("fingerprint_maintained", f"WITH units AS ({_BATCH}), {O.unit_stats('units')}, {O.merged()} {O.finalised()}")
def fingerprint_maintained(spark, d):
    """The fingerprint after a batch in which German and French texts changed and one source
    was forgotten: from the sums kept before and the signed changes, with no recount."""
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "source", "text"))
    text, changes = F.coalesce("text", F.lit("")), F.col("lang").isin("de", "fr")

    def entries(rows: DataFrame, text: Column, prefix: str) -> DataFrame:
        none = F.array().cast("array<string>")
        units = rows.select(F.sha2(text, 256).alias("sha256"), F.concat(F.lit(prefix), F.col("doc_id")).alias("entry_id"), F.lit(None).cast("string").alias("profile"), F.col("lang").alias("locale"), F.lit("used").alias("status"), "source", F.array(text).alias("strings"), none.alias("headings"))
        held = ("sha256", "entry_id", "profile", "locale", "status", "source")
        counted = stats.unit_stats(units, held)
        return counted.select(*held, F.struct(*[c for c in counted.columns if c not in held]).alias("stats"))

    before = entries(docs, text, "f")
    stay = F.coalesce(F.col("source") != "src1", F.lit(True))
    kept = sums.summed(sums.entries(before).select(*sums.KEYS, "stats.*"), *sums.KEYS)
    same = before.where(stay & ~F.coalesce(F.col("locale").isin("de", "fr"), F.lit(False)))
    after = same.unionByName(entries(docs.where(stay & changes), F.concat(text, F.lit(" And more! Is it?")), "g"))
    return sums.fingerprint(sums.together(kept, sums.changes(before, after)), "locale")


@query("unit_stats", f"WITH {_UNITS}, {O.unit_stats('units')} SELECT * FROM stats")
def unit_stats(spark, d):
    return stats.unit_stats(units(spark, d))


_HIST = " UNION ALL ".join(f"SELECT locale, {O.q(n)} AS bucket, CAST(sum({n}) AS BIGINT) AS sentences FROM stats GROUP BY locale" for n, *_ in V.HISTOGRAM)


@query("sentence_histogram", f"WITH {_UNITS}, {O.unit_stats('units')} {_HIST}")
def sentence_histogram(spark, d):
    names = [n for n, *_ in V.HISTOGRAM]
    long = stats.unit_stats(units(spark, d)).groupBy("locale").agg(*[F.sum(n).alias(n) for n in names])
    return long.unpivot(["locale"], names, "bucket", "sentences")


@query("manifest_totals", f"WITH {_UNITS}, {O.unit_stats('units')} SELECT locale, count(*) AS files, CAST(sum(strings) AS BIGINT) AS strings, CAST(sum(words) AS BIGINT) AS words, CAST(sum(sentences) AS BIGINT) AS sentences FROM stats WHERE strings > 0 GROUP BY ROLLUP (locale)")
def manifest_totals(spark, d):
    s = stats.unit_stats(units(spark, d)).where("strings > 0")
    return s.rollup("locale").agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in ("strings", "words", "sentences")])


# --- pages: HTML units, headings, locale and context of addresses

_NAMED = "regexp_replace(" * 6 + "{x}" + "".join(f", '(?i)&{n};', {O.q(c)}, 'g')" for n, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")))
_EOL = r"regexp_replace(coalesce(html, ''), '\r\n?', chr(10), 'g')"
_BODY = r"regexp_replace(regexp_replace(regexp_replace({t}, '(?i)<script[\s\S]*?</script>', '', 'g'), '(?i)<style[\s\S]*?</style>', '', 'g'), '<!--[\s\S]*?-->', '', 'g')".replace("{t}", _EOL)
_CLEAN = lambda x: O.collapse(rf"regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g')")
_BARE = r"regexp_replace(trim(x), '^[(\[{<]+|[)\]}>.,;:!?]+$', '', 'g')"
_IS_COPY = rf"regexp_matches(x, '\p{{L}}') AND NOT regexp_matches({_BARE}, '(?i)^(?:https?:|mailto:|tel:|data:|//)') AND NOT regexp_matches({_BARE}, '^@[A-Za-z0-9_.-]+$') AND NOT regexp_matches(x, '(?i)^#[0-9a-f]{{3,8}}$') AND NOT (regexp_matches(x, '(?i)^(?:[0-9a-f]{{6}}|[0-9a-f]{{8}})$') AND regexp_matches(x, '[0-9]')) AND NOT regexp_matches(x, '^[/.]{{0,2}}/') AND NOT (regexp_matches(x, '^[A-Z0-9_]+$') AND contains(x, '_'))"
_ATTR = O.q(r"""(?i)\b(?:alt|title|aria-label|placeholder)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_COPIES = lambda a, f: f"list_filter(list_transform({a}, lambda x: {_CLEAN(f.replace('{x}', 'x'))}), lambda x: {_IS_COPY})"
_HTML_UNITS = _COPIES(f"list_concat(list_transform(regexp_extract_all(body, {_ATTR}, 0), lambda x: regexp_extract(x, {_ATTR}, 1) || regexp_extract(x, {_ATTR}, 2)), string_split(regexp_replace(body, '<[^>]*>', chr(10), 'g'), chr(10)))", _NAMED)
_HTML_HEADS = _COPIES(r"list_transform(regexp_extract_all(eol, '(?i)<h[1-6][^>]*>([\s\S]*?)</h[1-6]>', 1), lambda y: regexp_replace(y, '<[^>]*>', ' ', 'g'))", _NAMED)
_PAGES = f"page AS (SELECT page_id, url, {_EOL} AS eol, {_BODY} AS body FROM pages), pu AS (SELECT page_id, url, {_HTML_UNITS} AS strings, {_HTML_HEADS} AS headings FROM page)"


def page_units(spark: SparkSession, d: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return spread(table(spark, d, "pages")).select("page_id", "url", extract.html_units(html).alias("strings"), extract.html_headings(html).alias("headings"))


@query("html_units", f"WITH {_PAGES} SELECT page_id, CAST(len(strings) AS BIGINT) AS n_strings, array_to_string(strings, chr(10)) AS joined FROM pu")
def html_units(spark, d):
    return page_units(spark, d).select("page_id", F.size("strings").cast("long").alias("n_strings"), F.array_join("strings", "\n").alias("joined"))


@query("html_headings", f"WITH {_PAGES} SELECT page_id, CAST(len(headings) AS BIGINT) AS n_headings, array_to_string(headings, chr(10)) AS joined FROM pu")
def html_headings(spark, d):
    return page_units(spark, d).select("page_id", F.size("headings").cast("long").alias("n_headings"), F.array_join("headings", "\n").alias("joined"))


_PATH = r"regexp_replace(coalesce(url, ''), '^[A-Za-z]+://[^/]*/?', '')"


def _locale_sql(path: str, locales: tuple[str, ...], primary: str) -> str:
    folders = f"list_transform(string_split({path}, '/')[:-2], lambda s: lower(s))"
    stem = rf"lower(regexp_replace(string_split({path}, '/')[-1], '\.[^.]+$', ''))"
    return "CASE " + " ".join(f"WHEN list_contains({folders}, {O.q(x)}) OR {stem} = {O.q(x)} OR ends_with({stem}, {O.q('.' + x)}) OR ends_with({stem}, {O.q('-' + x)}) OR ends_with({stem}, {O.q('_' + x)}) THEN {O.q(x)}" for x in locales) + f" ELSE {O.q(primary)} END"


def _context_sql(path: str) -> str:
    parts = f"string_split(lower({path}), '/')"
    hit = lambda c: f"len(list_filter({parts}, lambda s: s = {O.q(c)} OR s = {O.q(c.replace('-', '', 1))} OR starts_with(s, {O.q(c + '.')}))) > 0"
    any_of = lambda *n: f"list_has_any({parts}, [{', '.join(map(O.q, n))}])"
    return "CASE " + " ".join(f"WHEN {hit(c)} THEN {O.q(c)}" for c in V.CONTEXTS) + f" WHEN {any_of('marketing', 'content')} THEN 'marketing-page' WHEN {any_of('docs', 'help')} THEN 'help-doc' WHEN {any_of('locales', 'ui')} THEN 'product-ui' END"


LOCALES = ("en", "de", "fr", "es", "docs")
#: Paths that the addresses lack.
EXTRA_PATHS = ["locales/de/app.json", "content/email/welcome.md", "docs/guide_FR.pdf", "ui/system-error.es.yml", "supportreply/x.md", "release-notes.md", "help/en.md", ""]
_PATHS = f"paths AS (SELECT {_PATH} AS path, CAST(length(coalesce(html, '')) AS BIGINT) AS words FROM pages UNION ALL " + " UNION ALL ".join(f"SELECT {O.q(p)}, CAST({k} AS BIGINT)" for k, p in enumerate(EXTRA_PATHS)) + ")"


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.coalesce("url", F.lit("")), "^[A-Za-z]+://[^/]*/?", "")
    extra = spark.createDataFrame([(p, k) for k, p in enumerate(EXTRA_PATHS)], "path string, words long")
    return table(spark, d, "pages").select(path.alias("path"), F.length(F.coalesce("html", F.lit(""))).cast("long").alias("words")).unionByName(extra)


@query("locale_of_url", f"WITH {_PATHS} SELECT path, {_locale_sql('path', LOCALES, 'en')} AS locale FROM paths")
def locale_of_url(spark, d):
    return page_paths(spark, d).select("path", files.locale_of(F.col("path"), list(LOCALES), "en").alias("locale"))


@query("context_traffic", f"WITH {_PATHS} SELECT {_context_sql('path')} AS context, count(*) AS paths, CAST(sum(words) AS BIGINT) AS words FROM paths GROUP BY 1")
def context_traffic(spark, d):
    return page_paths(spark, d).groupBy(files.context_of(F.col("path")).alias("context")).agg(F.count("*").alias("paths"), F.sum("words").alias("words"))


# --- quality gate

EXTRA_TEXTS = [(-1, "xx", "a b c d e f g h i j"), (-2, "en", "�" * 20 + " word"), (-3, "en", ""), (-4, "de", "Donaudampfschifffahrtsgesellschaft ist lang"), (-5, "en", "see https://x.y/z and @me, (ok) brrr xyzz one two three four")]
_TEXTS = "texts AS (SELECT doc_id, lang AS locale, coalesce(text, '') AS text FROM documents UNION ALL " + " UNION ALL ".join(f"SELECT {i}, {O.q(a)}, {O.q(t)}" for i, a, t in EXTRA_TEXTS) + ")"
_TOK = rf"list_filter(list_transform(list_filter(regexp_split_to_array(text, {O.q(f'[{V.SPACE}]+')}), lambda x: x <> '' AND NOT regexp_matches({_BARE}, '(?i)^(?:https?:|mailto:|tel:|data:|//)') AND NOT regexp_matches({_BARE}, '^@[A-Za-z0-9_.-]+$')), lambda x: regexp_replace(x, '\A\p{{P}}+|\p{{P}}+\z', '', 'g')), lambda x: regexp_matches(x, '\p{{L}}'))"
_SHARE = lambda cond, places: O.rounded(O.div(O.size_where("tok", cond), "len(tok)"), places)
_GATE = f"""tok AS (SELECT *, {_TOK} AS tok, CASE WHEN lower(substring(locale, 1, 2)) IN {O.among(V.COMPOUNDING)} THEN 30 ELSE 20 END AS lim,
 CASE lower(substring(locale, 1, 2)) {' '.join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in V.SINGLE_LETTERS.items())} ELSE '' END AS letters FROM texts),
gate AS (SELECT doc_id, locale, CAST(len(tok) AS BIGINT) AS tokens, {O.rounded(O.div("coalesce(list_sum(list_transform(tok, lambda x: length(x))), 0)", "len(tok)"), 2)} AS mean_token_len,
 {_SHARE("length(x) = 1 AND NOT contains(letters, lower(x))", 3)} AS single_share, {_SHARE("length(x) > lim", 4)} AS long_token_share, {O.rounded(O.div("len(regexp_extract_all(text, chr(65533)))", "len(tok)"), 4)} AS repl_share,
 {_SHARE(f"length(x) > 3 AND NOT regexp_matches(lower(x), '[{V.VOWELS}]')", 3)} AS novowel_share FROM tok),
verdict AS (SELECT *, list_filter([CASE WHEN tokens = 0 THEN 'empty' END, CASE WHEN tokens >= 10 AND long_token_share > 0.015 THEN 'longTokenShare' END, CASE WHEN tokens >= 10 AND single_share > 0.1 THEN 'singleShare' END, CASE WHEN repl_share > 0.005 THEN 'replShare' END], lambda x: x IS NOT NULL) AS r FROM gate)"""


def gated(spark: SparkSession, d: str) -> DataFrame:
    extra = spark.createDataFrame(EXTRA_TEXTS, "doc_id long, locale string, text string")
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "text")).select("doc_id", F.col("lang").alias("locale"), F.coalesce("text", F.lit("")).alias("text"))
    return quality_gate.status(quality_gate.score(docs.unionByName(extra)))


@query("quality_gate", f"WITH {_TEXTS}, {_GATE} SELECT doc_id, tokens, mean_token_len, single_share, long_token_share, repl_share, novowel_share, array_to_string(r, ',') AS reasons, len(r) = 0 AS passed FROM verdict")
def q_quality_gate(spark, d):
    return gated(spark, d).select("doc_id", "tokens", "mean_token_len", "single_share", "long_token_share", "repl_share", "novowel_share", F.array_join("reasons", ",").alias("reasons"), "passed")


@query("gate_escalation", f"WITH {_TEXTS}, {_GATE} SELECT locale, count(*) AS units, count(*) FILTER (WHERE len(r) > 0) AS skipped, count(*) FILTER (WHERE len(r) > 0 AND tokens > 0) AS escalated FROM verdict GROUP BY locale")
def gate_escalation(spark, d):
    need = quality_gate.needs_model_tier(F.lit("script"), F.col("status"), F.col("tokens"), F.lit("ok"))
    return gated(spark, d).groupBy("locale").agg(F.count("*").alias("units"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(need).alias("escalated"))


# --- source index: the index holds all documents; on resolving them again German texts have
# changed in place, Spanish files have moved, French files have moved and changed

_IDX = """idx AS (SELECT 'f' || CASE WHEN doc_id < 99 THEN lpad(CAST(doc_id + 1 AS VARCHAR), 3, '0') ELSE CAST(doc_id + 1 AS VARCHAR) END AS entry_id, doc_id AS number, sha256(coalesce(text, '')) AS sha256, source || '/' || doc_id || '.txt' AS origin, 'file' AS kind, lang AS locale, 'used' AS status, ['V' || (doc_id % 7), 'L' || (doc_id % 11)] AS produced FROM documents),
res AS (SELECT sha256(CASE WHEN lang IN ('de', 'fr') THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) AS sha256, CASE WHEN lang IN ('es', 'fr') THEN 'moved/' ELSE '' END || source || '/' || doc_id || '.txt' AS origin, CASE WHEN source = 'src3' THEN 'cs' ELSE lang END AS locale FROM documents)"""
_CLASS = _IDX + """, by_hash AS (SELECT sha256, arg_max(entry_id, number) AS he FROM idx GROUP BY 1), by_origin AS (SELECT origin, arg_max(entry_id, number) AS oe FROM idx GROUP BY 1),
cls AS (SELECT r.origin, r.sha256, r.locale, CASE WHEN h.he IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM idx i WHERE i.sha256 = r.sha256 AND i.origin = r.origin) THEN 'known' ELSE 'duplicate' END WHEN o.oe IS NOT NULL THEN 'stale' ELSE 'fresh' END AS class, coalesce(h.he, o.oe) AS entry_id FROM res r LEFT JOIN by_hash h ON r.sha256 = h.sha256 LEFT JOIN by_origin o ON r.origin = o.origin),
gone AS (SELECT * FROM idx WHERE kind <> 'url' AND sha256 NOT IN (SELECT sha256 FROM cls WHERE class IN ('known', 'duplicate')) AND entry_id NOT IN (SELECT entry_id FROM cls WHERE class = 'stale'))"""


def index_and_resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    origin = F.concat("source", F.lit("/"), "doc_id", F.lit(".txt"))
    idx = docs.select(index.entry_name(F.col("doc_id") + 1).alias("entry_id"), F.sha2("text", 256).alias("sha256"), origin.alias("origin"), F.array().cast("array<string>").alias("aliases"), F.lit("file").alias("kind"), F.col("lang").alias("locale"), F.lit("used").alias("status"), F.array(F.concat(F.lit("V"), F.col("doc_id") % 7), F.concat(F.lit("L"), F.col("doc_id") % 11)).alias("produced"))
    changed = F.when(F.col("lang").isin("de", "fr"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    moved = F.when(F.col("lang").isin("es", "fr"), F.concat(F.lit("moved/"), origin)).otherwise(origin)
    res = docs.select(F.sha2(changed, 256).alias("sha256"), moved.alias("origin"), F.when(F.col("source") == "src3", "cs").otherwise(F.col("lang")).alias("locale"))
    return idx, res


@query("index_diff", f"WITH {_CLASS} SELECT origin, sha256, class, entry_id FROM cls")
def index_diff(spark, d):
    return index.classify(*index_and_resolved(spark, d)).select("origin", "sha256", "class", "entry_id")


@query("index_missing", f"WITH {_CLASS} SELECT entry_id, origin, locale, CASE WHEN entry_id IN (SELECT entry_id FROM gone) THEN 'missing' ELSE 'used' END AS status FROM idx")
def index_missing(spark, d):
    idx, res = index_and_resolved(spark, d)
    gone = index.missing(idx, index.classify(idx, res))
    return index.mark_missing(idx, gone).select("entry_id", "origin", "locale", "status")


@query("index_supersede", f"WITH {_CLASS} SELECT c.origin, c.sha256, i.entry_id AS displaced, 'f' || ((SELECT max(number) + 1 FROM idx) + row_number() OVER (ORDER BY md5(c.origin))) AS entry_id, array_to_string(i.produced, ',') AS reopened FROM cls c JOIN idx i ON c.entry_id = i.entry_id WHERE c.class = 'stale'")
def index_supersede(spark, d):
    idx, res = index_and_resolved(spark, d)
    new, displaced = index.supersede(idx, index.classify(idx, res))
    fresh = new.where(F.size("produced") == 0).select("origin", "sha256", "entry_id")
    return displaced.select("origin", F.col("entry_id").alias("displaced"), F.array_join("produced", ",").alias("reopened")).join(fresh, "origin")


@query("index_forget", f"WITH {_IDX} SELECT CAST((SELECT count(*) FROM idx WHERE locale <> 'de') AS BIGINT) AS kept, rule_id FROM (SELECT DISTINCT unnest(produced) AS rule_id FROM idx WHERE locale = 'de')")
def index_forget(spark, d):
    idx, _ = index_and_resolved(spark, d)
    kept, reopened = index.forget(idx, idx.where("locale = 'de'").select("entry_id"))
    return reopened.crossJoin(F.broadcast(kept.agg(F.count("*").alias("kept"))))  # one row


@query("index_relocale", f"WITH {_IDX} SELECT i.entry_id, coalesce(r.locale, i.locale) AS locale, coalesce(r.locale <> i.locale, false) AS relocated FROM idx i LEFT JOIN res r ON i.origin = r.origin")
def index_relocale(spark, d):
    return index.reattribute(*index_and_resolved(spark, d)).select("entry_id", "locale", "relocated")


_FOLD = "SELECT sha256(coalesce(text, '')) AS sha256, min(source || '/' || doc_id || '.txt') AS origin, count(*) AS files, array_to_string(list_sort(list(source || '/' || doc_id || '.txt'))[2:], ',') AS aliases FROM documents GROUP BY 1"


@query("source_dedup_aliases", _FOLD)
def source_dedup_aliases(spark, d):
    idx, _ = index_and_resolved(spark, d)
    return index.fold_aliases(idx).withColumn("aliases", F.array_join("aliases", ","))


@query("index_upsert", f"WITH {_IDX}, ent AS (SELECT sha256, max(origin) AS origin, max(locale) AS locale FROM res GROUP BY 1), one AS (SELECT sha256, min(entry_id) AS entry_id, min(origin) AS origin, min(locale) AS locale FROM idx GROUP BY 1) SELECT coalesce(o.sha256, e.sha256) AS sha256, coalesce(o.entry_id, 'new') AS entry_id, coalesce(e.origin, o.origin) AS origin, coalesce(e.locale, o.locale) AS locale, CASE WHEN o.origin <> e.origin THEN o.origin ELSE '' END AS aliases FROM one o FULL JOIN ent e ON o.sha256 = e.sha256")
def index_upsert(spark, d):
    idx, res = index_and_resolved(spark, d)
    one = idx.groupBy("sha256").agg(F.min("entry_id").alias("entry_id"), F.min("origin").alias("origin"), F.first("aliases").alias("aliases"), F.min("locale").alias("locale"))
    new = res.groupBy("sha256").agg(F.max("origin").alias("origin"), F.max("locale").alias("locale")).withColumns({"entry_id": F.lit("new"), "aliases": F.array().cast("array<string>")})
    return index.upsert(one, new).withColumn("aliases", F.array_join("aliases", ","))


@query("unindexed", f"WITH {_IDX} SELECT origin, locale FROM res WHERE origin NOT IN (SELECT origin FROM idx)")
def unindexed(spark, d):
    idx, res = index_and_resolved(spark, d)
    return index.unindexed(res, idx).select("origin", "locale")


@query("gather_all", f"WITH {_IDX} SELECT locale, source, count(*) AS units FROM (SELECT locale, 'live' AS source FROM res UNION ALL SELECT locale, 'index' FROM idx WHERE origin NOT IN (SELECT origin FROM res)) GROUP BY ALL")
def gather_all(spark, d):
    idx, res = index_and_resolved(spark, d)
    both = index.gather(res.select("origin", "locale", F.lit("used").alias("status"), F.lit("live").alias("source")), idx.select("origin", "locale", "status", F.lit("index").alias("source")))
    return both.groupBy("locale", "source").agg(F.count("*").alias("units"))


# --- rules over the corpus

RULES = [
    {"id": "L01", "confidence": "derived", "avoid": "idiot", "prefer": "person"},
    {"id": "L02", "confidence": "confirmed", "avoid": "the", "prefer": "a"},
    {"id": "L03", "confidence": "assumed", "avoid": "que"},
    {"id": "L04", "confidence": "disputed", "avoid": "of"},
    {"id": "L05", "confidence": "confirmed", "avoid": "leverage", "locked": True},
    {"id": "L06", "confidence": "derived", "avoid": "of the"},
    {"id": "L07", "confidence": "derived", "avoid": "—"},
    {"id": "M01", "confidence": "confirmed", "file": "mechanics", "pattern": r"!!"},
    {"id": "M02", "confidence": "derived", "file": "mechanics", "pattern": r"[0-9]{4,}"},
    {"id": "M09", "confidence": "assumed", "file": "mechanics", "pattern": "(["},
]


def _hit_sql(r: dict) -> str:
    if r.get("pattern"):
        return "0" if r["pattern"] == "([" else f"len(regexp_extract_all(t, {O.q('(?i)' + r['pattern'])}))"
    if r["avoid"] == "—":
        return "0"
    term = "".join(c * 2 if not c.isalnum() else c for c in r["avoid"])
    return rf"len(regexp_extract_all(regexp_replace(' ' || t || ' ', '([^\p{{L}}\p{{N}}])', '\1\1', 'g'), {O.q(rf'(?i)[^\p{{L}}\p{{N}}]{term}[^\p{{L}}\p{{N}}]')}))"


_SEV = {"confirmed": "blocker", "derived": "warning", "assumed": "nit"}
_HITS = "per AS (" + " UNION ALL ".join(f"SELECT doc_id, {O.q(r['id'])} AS id, {O.q(r['confidence'])} AS confidence, {'NULL' if r['confidence'] == 'disputed' else O.q('blocker' if r.get('locked') else _SEV[r['confidence']])} AS severity, CAST({_hit_sql(r)} AS BIGINT) AS hits FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)" for r in RULES) + "), counted AS (SELECT id, confidence, CAST(sum(hits) AS BIGINT) AS hits, count(DISTINCT doc_id) FILTER (WHERE hits > 0) AS units FROM per GROUP BY ALL)"


def rule_units(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("unit_id"), F.coalesce("text", F.lit("")).alias("t"))


def counted_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.hits(rule_units(spark, d), rules.rules_frame(spark, RULES))


@query("rule_hits", f"WITH {_HITS} SELECT id, confidence, hits, units FROM counted")
def rule_hits(spark, d):
    return counted_rules(spark, d).select("id", "confidence", "hits", "units")


@query("rule_rank_topk", f"WITH {_HITS} SELECT id, hits FROM counted WHERE confidence <> 'disputed' ORDER BY hits DESC, confidence <> 'confirmed', id LIMIT 5")
def rule_rank_topk(spark, d):
    return rules.rank(counted_rules(spark, d)).select("id", "hits").limit(5)


@query("review_inventory", f"WITH {_HITS} SELECT severity, CAST(sum(hits) AS BIGINT) AS findings, count(DISTINCT doc_id) AS units, count(DISTINCT id) AS rules FROM per WHERE hits > 0 AND severity IS NOT NULL GROUP BY severity")
def review_inventory(spark, d):
    return rules.inventory(rules.review(rule_units(spark, d), rules.rules_frame(spark, RULES)))


_WORST = ", ".join(f"CAST(sum(CASE WHEN severity = {O.q(s)} THEN hits ELSE 0 END) AS BIGINT) AS {s}s" for s in ("blocker", "warning", "nit"))


@query("worst_documents", f"WITH {_HITS} SELECT CAST(doc_id AS VARCHAR) AS unit_id, {_WORST} FROM per WHERE hits > 0 AND severity IS NOT NULL GROUP BY 1 ORDER BY blockers DESC, warnings DESC, nits DESC, unit_id LIMIT 10")
def worst_documents(spark, d):
    return rules.worst_units(rules.review(rule_units(spark, d), rules.rules_frame(spark, RULES)))


@query("derived_promotion", f"WITH {_HITS} SELECT id, hits, units FROM counted WHERE hits >= 5 AND units >= 2")
def derived_promotion(spark, d):
    return rules.promotable(counted_rules(spark, d)).select("id", "hits", "units")


EVIDENCE = [("L01", "2025-01-01"), ("L05", "2024-01-01"), ("L05", "2024-06-01"), ("M09", "2026-08-01"), ("L07", "2026-01-31")]
_EV = "ev(id, date) AS (VALUES " + ", ".join(f"({O.q(a)}, DATE {O.q(b)})" for a, b in EVIDENCE) + ")"


@query("rule_health", f"WITH {_HITS}, {_EV}, nw AS (SELECT id, max(date) AS newest FROM ev GROUP BY 1) SELECT c.id, c.confidence, c.hits, newest, CASE WHEN confidence = 'disputed' THEN 'disputed' WHEN hits = 0 AND newest < DATE '2025-12-10' THEN 'stale' WHEN hits = 0 THEN 'dead' ELSE 'live' END AS health FROM counted c LEFT JOIN nw ON c.id = nw.id")
def rule_health(spark, d):
    ev = spark.createDataFrame(EVIDENCE, "id string, date string").withColumn("date", F.to_date("date"))
    return rules.health(counted_rules(spark, d), ev, F.lit("2026-09-10").cast("date"))


# --- tone, overlay

AUTHORED = [("social", "curious", 4, 2, 3, 1, 1, 0), ("email", "frustrated", 3, 2, 4, 1, 0, 1)]
SPEAKER = dict(zip(V.DIALS, (-1, 0, 1, 1, -1, 1), strict=True))


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(O.q(x) if isinstance(x, str) else "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) for x in r) + ")" for r in rows) + ")"


def _matrix_sql(speaker: dict[str, int]) -> str:
    dials = ", ".join(V.DIALS)
    col = lambda d: f"CASE WHEN a.context IS NOT NULL THEN a.{d} ELSE greatest(0, least(4, s.{d} + c.{d} + {speaker.get(d, 0)})) END" if d != "humor" else f"CASE WHEN a.context IS NOT NULL AND s.state NOT IN {O.among(V.HUMOR_FREE_STATES)} THEN a.humor ELSE 0 END"
    return f"SELECT c.context, s.state, {', '.join(f'CAST({col(d)} AS INTEGER) AS {d}' for d in V.DIALS)}, CASE WHEN a.context IS NOT NULL THEN 'authored' ELSE 'computed' END AS origin FROM {_values([(k, *v) for k, v in V.STATE_VECTORS.items()])} s(state, {dials}) CROSS JOIN {_values([(k, *v) for k, v in V.CONTEXT_OFFSETS.items()])} c(context, {dials}) LEFT JOIN {_values(AUTHORED)} a(context, state, {dials}) ON a.context = c.context AND a.state = s.state"


def grid(spark: SparkSession, speaker: dict[str, int] | None = None) -> DataFrame:
    return tone.matrix(spark, tone.vector_frame(spark, "state", V.STATE_VECTORS), tone.vector_frame(spark, "context", V.CONTEXT_OFFSETS), spark.createDataFrame(AUTHORED, tone.CELL), speaker)


@query("tone_matrix_house", f"WITH {measured.grid_sql({})} SELECT * FROM grid")
def tone_matrix_house(spark, d):
    return measured.grid(spark, d)


@query("tone_matrix_speaker", f"WITH {measured.grid_sql(SPEAKER)} SELECT * FROM grid")
def tone_matrix_speaker(spark, d):
    return measured.grid(spark, d, SPEAKER)


@query("coverage_matrix", f"WITH {_PATHS}, m AS ({_matrix_sql({})}), tr AS (SELECT {_context_sql('path')} AS context, sum(words) AS w FROM paths GROUP BY 1) SELECT m.context, count(*) FILTER (WHERE origin = 'authored') AS authored, count(*) AS \"of\", CAST(coalesce(max(w), 0) AS BIGINT) AS traffic FROM m LEFT JOIN tr ON m.context = tr.context GROUP BY m.context")
def coverage_matrix(spark, d):
    traffic = page_paths(spark, d).select(files.context_of(F.col("path")).alias("context"), "words")
    return tone.coverage(grid(spark), traffic)


_OWN = ", ".join(f"CASE WHEN max(humor) > 1 THEN CAST(sum({x}) % 5 AS INTEGER) - (SELECT CAST(sum({x}) % 5 AS INTEGER) FROM m) END AS {x}" for x in V.DIALS)


@query("speaker_offset", f"WITH {measured.SQL} SELECT source AS slug, {_OWN} FROM m WHERE source IS NOT NULL GROUP BY source")
def speaker_offset(spark, d):
    own, house = measured.tone_lines(measured.texts(spark, d))
    t = own.crossJoin(F.broadcast(house))  # one row
    t = t.select("slug", tone.default_dials(F.col("md")).alias("own"), tone.default_dials(F.col("house_md")).alias("house"))
    return t.select("slug", *[c.alias(k) for k, c in tone.speaker_offset(F.col("house"), F.col("own")).items()])


HOUSE = [(0, "V1", "voice", "Plainspoken"), (1, "V2", "voice", "No pressure"), (2, "L01", "lexicon", "leverage"), (3, "L20", "lexicon", "game changer"), (4, "M01", "mechanics", "Sentence case.")]
OVERLAYS = [(0, "V3", "voice", "Builder"), (1, "L01", "lexicon", "leverage: lean on"), (2, "L30", "lexicon", "excited to announce"), (3, "L20", "lexicon", "game changer: keep it")]
LOCKS = [("V2",), ("L20",)]
_RB = f"house(ord, id, file, name) AS {_values(HOUSE)}, ovl(ord, id, file, name) AS {_values(OVERLAYS)}, locks(id) AS {_values(LOCKS)}"


def rule_bases(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = "ord int, id string, file string, name string"
    return spark.createDataFrame(HOUSE, s), spark.createDataFrame(OVERLAYS, s), spark.createDataFrame(LOCKS, "id string")


@query("overlay_merge", f"WITH {measured.SQL} SELECT CAST(row_number() OVER (ORDER BY part, ord) AS INTEGER) AS pos, id, name, origin, locked, overrides FROM (SELECT 0 AS part, ord, id, name, 'house' AS origin, id IN (SELECT id FROM locks) AS locked, false AS overrides FROM house WHERE id NOT LIKE 'V%' AND (id IN (SELECT id FROM locks) OR id NOT IN (SELECT id FROM ovl)) UNION ALL SELECT 1, ord, id, name, 'speaker', false, id IN (SELECT id FROM house) AND id NOT LIKE 'V%' FROM ovl WHERE id LIKE 'V%' OR id NOT IN (SELECT id FROM locks) UNION ALL SELECT 2, ord, id, name, 'house', true, false FROM house WHERE id LIKE 'V%' AND id IN (SELECT id FROM locks))")
def overlay_merge(spark, d):
    from pyspark.sql.window import Window

    merged = overlay.merge_rules(*measured.bases(measured.texts(spark, d)))
    return merged.withColumn("pos", F.row_number().over(Window.orderBy("part", "ord"))).select("pos", "id", "name", "origin", "locked", "overrides")


@query("lock_violations", f"WITH {measured.SQL} SELECT id FROM house WHERE id NOT LIKE 'V%' AND id IN (SELECT id FROM locks) AND id IN (SELECT id FROM ovl)")
def lock_violations(spark, d):
    return overlay.lock_violations(*measured.bases(measured.texts(spark, d)))


# --- drift, ages, estimates

_DOCS2 = "units AS (SELECT 'd' || doc_id AS unit_id, lang AS locale, source, [coalesce(text, '')] AS strings, []::VARCHAR[] AS headings FROM documents)"


def _fp(name: str, where: str) -> str:
    return f"{O.merged(source=f'(SELECT * FROM stats WHERE {where})').replace('merged AS', f'{name}_m AS', 1)}, {name} AS ({O.finalised(source=f'{name}_m')})"


_LONG = lambda rel, v: " UNION ALL ".join(f"SELECT locale, {O.q(m)} AS metric, CAST({m} AS DOUBLE) AS {v} FROM {rel}" for m in V.DRIFT_METRICS)
_DELTA = "CASE WHEN was IS NULL OR now IS NULL THEN NULL WHEN was = 0 THEN CASE WHEN now = 0 THEN 0.0 END ELSE floor((now - was) / abs(was) * 1000.0 + 0.5) / 10.0 END"


@query("drift_by_locale", f"WITH {_DOCS2}, {O.unit_stats('units', ('unit_id', 'locale', 'source'))}, {_fp('b', 'source < ' + O.q('src15'))}, {_fp('c', 'source >= ' + O.q('src15'))}, bl AS ({_LONG('b', 'was')}), cl AS ({_LONG('c', 'now')}), dl AS (SELECT cl.locale, cl.metric, was, now, {_DELTA} AS delta_pct FROM cl LEFT JOIN bl ON cl.locale = bl.locale AND cl.metric = bl.metric) SELECT *, coalesce(abs(delta_pct) >= 25, false) AS flagged FROM dl")
def drift_by_locale(spark, d):
    """Baseline and current are the two halves of the sources, told apart by name."""
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "source", "text"))
    u = docs.select("doc_id", F.col("lang").alias("locale"), "source", F.array(F.coalesce("text", F.lit(""))).alias("strings"), F.array().cast("array<string>").alias("headings"))
    per = stats.merge_stats(stats.unit_stats(u, ("doc_id", "locale", "source")), "locale", "source")
    half = F.when(F.col("source") < "src15", "baseline").otherwise("current")
    sums = stats.merge_stats(per.withColumn("half", half), "locale", "half")
    both = stats.finalise(sums, "locale", "half")
    return drift.drift(both.where("half = 'baseline'"), both.where("half = 'current'")).select("locale", "metric", "was", "now", "delta_pct", "flagged")


@query("freshness_age", "SELECT event_id, greatest(CAST(floor((epoch_us(TIMESTAMP '2026-09-10 00:00:00') - epoch_us(ts)) / 86400000000) AS BIGINT), 0) AS age_days FROM events")
def freshness_age(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", drift.age_days(F.col("ts").cast("timestamp"), F.lit("2026-09-10 00:00:00").cast("timestamp")).alias("age_days"))


@query("token_estimate", "SELECT lang, CAST(sum(CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def token_estimate(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(text.token_estimate(F.coalesce("text", F.lit("")))).alias("tokens"))


# --- drafts and finals: each user turn and the assistant turn that follows it

_PAIRS = "turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lead(role) OVER w AS next_role, lead(coalesce(text, '')) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)), pairs AS (SELECT conv_id, turn, text AS draft, next_text AS final FROM turns WHERE role = 'user' AND next_role = 'assistant')"


def draft_pairs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = F.coalesce("text", F.lit(""))
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", t.alias("draft"), F.lead("role").over(w).alias("next_role"), F.lead(t).over(w).alias("final"))
    return c.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "draft", "final")


_MEASURE = lambda t, p: f"CAST(len({O.words(t)}) AS BIGINT) AS {p}_words, CAST(len({O.sentences(t)}) AS BIGINT) AS {p}_sentences"


@query("draft_measures", f"WITH {_PAIRS}, mm AS (SELECT conv_id, turn, {_MEASURE('draft', 'before')}, {_MEASURE('final', 'after')} FROM pairs) SELECT *, {O.rounded(O.div('before_words', 'before_sentences'), 2)} AS before_mean, {O.rounded(O.div('after_words', 'after_sentences'), 2)} AS after_mean, after_words - before_words AS word_delta FROM mm")
def draft_measures(spark, d):
    p = draft_pairs(spark, d)
    a, b = diff.measure(F.col("draft")), diff.measure(F.col("final"))
    m = p.select("conv_id", "turn", a["words"].alias("before_words"), a["sentences"].alias("before_sentences"), b["words"].alias("after_words"), b["sentences"].alias("after_sentences"), a["mean_sentence_length"].alias("before_mean"), b["mean_sentence_length"].alias("after_mean"))
    return m.withColumn("word_delta", F.col("after_words") - F.col("before_words"))


@query("word_diff")
def word_diff(spark, d):
    return diff.diff(draft_pairs(spark, d)).select("conv_id", "turn", "added", "removed", "unchanged", "word_delta", "word_delta_pct", F.size("word_swaps").alias("swaps"))


@query("corroboration")
def corroboration(spark, d):
    seeded = spark.createDataFrame([("x1", 1, "We utilize it now", "We use it now"), ("x2", 1, "Please utilize the tool", "Please use the tool"), ("x3", 1, "Kindly wait", "Please wait")], "conv_id string, turn int, draft string, final string")
    pairs = draft_pairs(spark, d).withColumn("conv_id", F.col("conv_id").cast("string")).unionByName(seeded.withColumn("turn", F.col("turn").cast(dict(draft_pairs(spark, d).dtypes)["turn"])))
    swaps = diff.diff(pairs).select(F.concat_ws("/", "conv_id", "turn").alias("draft"), F.inline("word_swaps").alias("from_word", "to_word"))
    return rules.corroborated(swaps)


BUDGETS = [("button", 20, 3), ("tooltip", 80, 12), ("error", 140, 25)]


@query("microcopy_budget", f"SELECT b.element, count(*) AS texts, count(*) FILTER (WHERE length(coalesce(text, '')) > b.chars) AS over_chars, count(*) FILTER (WHERE len({O.words('coalesce(text, ' + O.q('') + ')')}) > b.words) AS over_words FROM conversations CROSS JOIN {_values(BUDGETS)} b(element, chars, words) GROUP BY b.element")
def microcopy_budget(spark, d):
    t = table(spark, d, "conversations").select(F.length(F.coalesce("text", F.lit(""))).alias("n"), text.word_count(F.coalesce("text", F.lit(""))).alias("w"))
    aggs = [F.count("*").alias("texts")] + [x for e, c, w in BUDGETS for x in (F.count_if(F.col("n") > c).alias(f"{e}_c"), F.count_if(F.col("w") > w).alias(f"{e}_w"))]
    one = t.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(e).alias("element"), F.col("texts"), F.col(f"{e}_c").alias("over_chars"), F.col(f"{e}_w").alias("over_words")) for e, *_ in BUDGETS])))


# --- integrity: a rule base with one seeded fault of each kind

_FAULTY = f"""{measured.SQL},
l AS (SELECT id, unnest(evidence) AS ev FROM r), mk AS (SELECT id AS eid, unnest(produced) AS id FROM e), fnd AS (
SELECT 'W_PROSE_RULE_IN_TABLE_FILE' AS code, id AS ref FROM r WHERE kind = 'prose' AND file IN ('lexicon', 'mechanics')
UNION ALL SELECT 'E_DUPLICATE_ID', id FROM (SELECT id, locked, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM r) WHERE n > 1 AND NOT (id LIKE 'V%' AND locked)
UNION ALL SELECT 'E_UNKNOWN_PREFIX', id FROM r WHERE substring(id, 1, 1) NOT IN {O.among(V.ID_PREFIXES)}
UNION ALL SELECT 'E_NO_CONFIDENCE', id FROM r WHERE confidence = ''
UNION ALL SELECT 'E_UNKNOWN_CONFIDENCE', id FROM r WHERE confidence <> '' AND confidence NOT IN {O.among(V.CONFIDENCES)}
UNION ALL SELECT 'E_BROKEN_EVIDENCE_REF', id || ':' || ev FROM l WHERE ev NOT IN (SELECT id FROM e)
UNION ALL SELECT 'W_ONE_WAY_EVIDENCE', l.id || ':' || ev FROM l JOIN e ON e.id = l.ev WHERE NOT list_contains(produced, l.id)
UNION ALL SELECT 'W_NO_EVIDENCE', id FROM r WHERE len(evidence) = 0 AND confidence <> 'assumed'
UNION ALL SELECT 'E_UNKNOWN_EVIDENCE_TYPE', id FROM e WHERE type NOT IN {O.among(V.EVIDENCE_TYPES)}
UNION ALL SELECT 'W_ORPHAN_EVIDENCE', eid || ':' || id FROM mk WHERE id NOT IN (SELECT id FROM r))"""


@query("validate_rules", f"WITH {_FAULTY} SELECT CASE WHEN code LIKE 'E%' THEN 'error' ELSE 'warning' END AS severity, code, ref FROM fnd")
def validate_rules(spark, d):
    r = measured.rules(measured.texts(spark, d))
    return validate.rule_checks(r, measured.ledger(spark, d), r.select("id"))


_CELLSQL = f"""{measured.SQL}, cl AS (SELECT *, 'T-' || context || '/' || state AS ref FROM placed),
cd AS (SELECT ref, context, state, d.dial, CASE d.dial {" ".join(f"WHEN '{x}' THEN {x}" for x in V.DIALS)} END % 6 AS v FROM cl CROSS JOIN {_values([(x,) for x in V.DIALS])} d(dial)),
cf AS (SELECT 'E_UNKNOWN_CONTEXT' AS code, ref FROM cl WHERE context NOT IN {O.among(V.CONTEXTS)} UNION ALL SELECT 'E_UNKNOWN_STATE', ref FROM cl WHERE state NOT IN {O.among(V.STATES)} UNION ALL SELECT 'E_DIAL_RANGE', ref || ':' || dial FROM cd WHERE v > 4
UNION ALL SELECT 'E_DIAL_MISSING', ref || ':' || dial FROM cd WHERE v = 0 UNION ALL SELECT 'E_HUMOR_GATE', ref FROM cd WHERE dial = 'humor' AND v > 0 AND state IN {O.among(V.HUMOR_FREE_STATES)})"""


@query("validate_cells", f"WITH {_CELLSQL} SELECT 'error' AS severity, code, ref FROM cf")
def validate_cells(spark, d):
    return validate.cell_checks(measured.cells(measured.texts(spark, d)))


_VECTORS = f"""{measured.SQL}, vx AS (SELECT CASE WHEN quality = 1 THEN 'state' ELSE 'context' END AS kind, CASE WHEN quality = 1 THEN state ELSE context END AS name, warmth - humor AS a, directness - 3 AS b FROM placed WHERE toxic = 1),
vo AS (SELECT * FROM {_values([('state', x) for x in V.STATES] + [('context', x) for x in V.CONTEXTS])} t(kind, name)), vd AS (SELECT kind, name, 'warmth' AS dial, a AS v FROM vx UNION ALL SELECT kind, name, 'humor', b FROM vx)
SELECT 'error' AS severity, 'E_UNKNOWN_STATE' AS code, name AS ref FROM vx WHERE kind = 'state' AND name NOT IN {O.among(V.STATES)} UNION ALL SELECT 'error', 'E_UNKNOWN_CONTEXT', name FROM vx WHERE kind = 'context' AND name NOT IN {O.among(V.CONTEXTS)}
UNION ALL SELECT 'error', 'E_VECTOR_RANGE', name || ':' || dial FROM vd WHERE v > 4 OR v < CASE WHEN kind = 'state' THEN 0 ELSE -4 END
UNION ALL SELECT 'warning', 'W_MISSING_VECTOR', name FROM vo WHERE NOT EXISTS (SELECT 1 FROM vx WHERE vx.kind = vo.kind AND vx.name = vo.name) AND EXISTS (SELECT 1 FROM vx)"""


@query("validate_vectors", f"WITH {_VECTORS}")
def validate_vectors(spark, d):
    return validate.vector_checks(measured.vectors(measured.texts(spark, d)))


_SPEAKERS = f"""{measured.SQL}, sp AS (SELECT source AS slug, max(warmth) > 0 AS has_dials FROM m WHERE source >= '{measured.SPEAKERS_FROM}' GROUP BY source), fo AS (SELECT DISTINCT source AS slug FROM m WHERE source >= '{measured.SPEAKERS_FROM}' AND toxic = 1),
ov AS (SELECT source AS slug, id, max(warmth) > 0 AS cited FROM ruled WHERE source >= '{measured.SPEAKERS_FROM}' GROUP BY source, id), top AS (SELECT substring(id, 1, 1) AS prefix, max(CAST(substring(id, 2) AS INTEGER)) AS top FROM house GROUP BY 1)
SELECT 'warning' AS severity, 'W_SPEAKER_NO_VOICE' AS code, slug AS ref FROM sp WHERE NOT has_dials OR slug NOT IN (SELECT slug FROM ov WHERE id LIKE 'V%')
UNION ALL SELECT 'warning', 'W_ID_RANGE_COLLISION_RISK', id FROM ov JOIN top ON prefix = substring(id, 1, 1) WHERE id NOT LIKE 'V%' AND id NOT IN (SELECT id FROM house) AND CAST(substring(id, 2) AS INTEGER) < (top // 10 + 1) * 10
UNION ALL SELECT 'warning', 'W_OVERRIDE_UNEVIDENCED', id FROM ov WHERE id NOT LIKE 'V%' AND NOT cited AND id IN (SELECT id FROM house)
UNION ALL SELECT 'error', 'E_LOCKED_OVERRIDE', id FROM house WHERE id NOT LIKE 'V%' AND id IN (SELECT id FROM locks) AND id IN (SELECT id FROM ovl)
UNION ALL SELECT 'error', 'E_UNKNOWN_LOCK', id FROM locks WHERE id NOT IN (SELECT id FROM house)
UNION ALL SELECT 'error', 'E_OVERLAY_DIR_MISMATCH', coalesce(sp.slug, fo.slug) FROM sp FULL JOIN fo ON sp.slug = fo.slug WHERE sp.slug IS NULL OR fo.slug IS NULL"""


@query("validate_speakers", f"WITH {_SPEAKERS}")
def validate_speakers(spark, d):
    m = measured.texts(spark, d)
    home, over_, locks = measured.bases(m)
    speaking = measured.ruled(m).where(F.col("source") >= measured.SPEAKERS_FROM)
    cited = F.when(F.max("warmth") > 0, F.array(F.lit("e1"))).otherwise(F.array().cast("array<string>"))
    rows = speaking.groupBy(F.col("source").alias("slug"), "id").agg(cited.alias("evidence"))
    speakers = speaking.groupBy(F.col("source").alias("slug")).agg((F.max("warmth") > 0).alias("has_dials"))
    folders = speaking.where("toxic = 1").select(F.col("source").alias("slug")).distinct()
    return validate.union([validate.speaker_checks(speakers, home, rows), validate.lock_checks(locks, home, overlay.lock_violations(home, over_, locks), speakers.select("slug"), folders)])


# --- the documents as an index: duplicates by hash, locales that are not active


@query("validate_index", f"WITH {_IDX} SELECT 'error' AS severity, 'E_DUPLICATE_SHA' AS code, entry_id AS ref FROM (SELECT entry_id, row_number() OVER (PARTITION BY sha256 ORDER BY entry_id) AS n FROM idx) WHERE n > 1 UNION ALL SELECT 'warning', 'W_LOCALE_NOT_ACTIVE', entry_id FROM idx WHERE locale NOT IN ('en', 'de') UNION ALL SELECT 'warning', 'W_STALE_EXTRACTOR', entry_id FROM idx WHERE locale = 'fr' UNION ALL SELECT 'error', 'E_DANGLING_PRODUCED_ID', entry_id || ':' || p FROM (SELECT entry_id, unnest(produced) AS p FROM idx) WHERE p NOT IN ('V0', 'V1', 'V2', 'V3', 'V4', 'V5', 'L0', 'L1', 'L2', 'L3', 'L4', 'L5', 'L6', 'L7', 'L8', 'L9', 'M7') UNION ALL SELECT 'error', 'E_SOURCE_NOT_INDEXED', 'M7'")
def validate_index(spark, d):
    idx, _ = index_and_resolved(spark, d)
    idx = idx.withColumns({"has_stats": F.lit(True), "extractor": F.when(F.col("locale") == "fr", "pdf").otherwise("text"), "version": F.lit("1")})
    ids = [f"V{k}" for k in range(6)] + [f"L{k}" for k in range(10)] + ["M7"]
    known = spark.createDataFrame([(i,) for i in ids], "id string")
    cited = spark.createDataFrame([("M7", ["e1"]), ("V1", ["e1"]), ("V2", ["e2"])], "id string, evidence array<string>")
    ledger = spark.createDataFrame([("e1", "source"), ("e2", "interview")], "id string, type string")
    libs = spark.createDataFrame([("pdf", "2"), ("text", "1")], "name string, version string")
    return validate.index_checks(idx, known, cited, ledger, spark.createDataFrame([("en",), ("de",)], "locale string"), libs)


# --- gaps and stages over a state measured from the documents

_STATE = f"""{_HITS}, st AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(DISTINCT id) FROM counted) AS rules, (SELECT count(*) FROM counted WHERE confidence = 'disputed') AS disputed,
(SELECT count(*) - count(DISTINCT text) FROM documents) AS stale)"""


@query("gaps_ranked", f"WITH {_STATE} SELECT id, severity, CAST(leverage AS INTEGER) AS leverage FROM (SELECT 'G03' AS id, 'blocker' AS severity, 4 AS leverage, true AS hit FROM st UNION ALL SELECT 'G06', 'warning', 3, true FROM st UNION ALL SELECT 'G10', 'warning', 2, disputed > 0 FROM st UNION ALL SELECT 'G11', 'warning', 2, stale > 0 FROM st UNION ALL SELECT 'G12', 'nit', 3, true FROM st UNION ALL SELECT 'G16', 'nit', 1, true FROM st) WHERE hit")
def gaps_ranked(spark, d):
    docs = table(spark, d, "documents")
    copies = docs.agg((F.count("*") - F.countDistinct(F.sha2("text", 256))).alias("stale_sources"))
    ruled = counted_rules(spark, d).agg(F.count("*").alias("rules"), F.count_if(F.col("confidence") == "disputed").alias("disputed"), F.count_if(F.col("confidence") == "assumed").alias("assumed"))
    words = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    fixed = {"exists": F.lit(True), "errors": zero, "unbaselined": words("es"), "never_ingested": zero, "bare_contexts": words("email"), "stale_card_inputs": none, "manifest_checked": F.lit(True), "manifest_changed": zero, "flagged_metrics": zero, "freshness_checked": F.lit(True), "locales_without_pack": words("fr"), "drafts": zero, "stale_extractors": zero, "no_evidence": zero, "card_tokens": F.lit(901).cast("long"), "voiceless_speakers": none, "unbaselined_speakers": none, "uningested_speakers": none, "stale_speaker_cards": none, "speakers": zero, "locks": zero}
    state = copies.crossJoin(ruled).withColumns(fixed)  # one row each
    return gaps.ranked(gaps.detect(state)).select("id", "severity", "leverage")


@query("stage_inference", "SELECT count(*) > 0 AS scan, count(*) > 0 AS ingest, count(DISTINCT lang) > 0 AS measure, false AS draft, max(length(text)) > 1000000 AS interview, false AS canonize, CASE WHEN max(length(text)) > 1000000 THEN 'interview' WHEN count(*) > 0 THEN 'measure' END AS \"at\" FROM documents")
def stage_inference(spark, d):
    one = table(spark, d, "documents").agg((F.count("*") > 0).alias("scan"), (F.count("*") > 0).alias("ingest"), (F.countDistinct("lang") > 0).alias("measure"), F.lit(False).alias("draft"), (F.max(F.length("text")) > 1000000).alias("interview"), F.lit(False).alias("canonize"))
    return drift.stages(one)


# --- extractors


def extracted(files_: DataFrame) -> DataFrame:
    """(path, format, unit) of text files (path, raw); one row without a unit where none is found."""
    s = files_.withColumn("format", extract.format_of(F.col("path")))
    text_only = s.where(~F.coalesce(extract.is_container(F.col("format")), F.lit(False)))
    return text_only.select("path", "format", F.explode_outer(extract.extract_units(F.col("format"), F.col("raw"))).alias("unit"))


@query("extract_samples", measured.samples_sql())
def extract_samples(spark, d):
    return extracted(measured.samples(spark, d))


from tonewright import catalogue  # noqa: E402, F401  its queries register themselves
