"""Rules, cells, vectors and speakers measured from the given tables, as frames and as SQL.

The integrity, overlay and tone queries need rule bases.  These are taken from what the texts
hold: a text's marks give its dials, its numbers the evidence it cites, its labels the trust
in it, and equal beginnings and lengths the ids that meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.functions import vocab as V
from tonewright.operators import tone

#: The mark that is counted for each dial.
MARKS = dict(zip(V.DIALS, ("#", "w", "\n", ",", ".", "k"), strict=True))
CONTEXTS, STATES = (*V.CONTEXTS, "fax"), (*V.STATES, "bored")
SPEAKERS_FROM = "src15"


def _quoted(s: str) -> str:
    return "chr(10)" if s == "\n" else "'" + s + "'"


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


SQL = f"""m AS (SELECT d.doc_id, lang, source, quality, toxic, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, {", ".join(f"CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), {_quoted(c)}, '')) AS BIGINT) AS {d}" for d, c in MARKS.items())} FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
placed AS (SELECT *, {_list(CONTEXTS)}[CAST(n % {len(CONTEXTS)} AS INTEGER) + 1] AS context, {_list(STATES)}[CAST(detail % {len(STATES)} AS INTEGER) + 1] AS state FROM m),
ruled AS (SELECT *, CASE WHEN humor > 0 THEN 'V' ELSE 'L' END || (n % 300) AS id FROM m),
house AS (SELECT min(doc_id) AS ord, id, min(lang) AS file, min(source) AS name FROM ruled WHERE source < '{SPEAKERS_FROM}' GROUP BY id),
ovl AS (SELECT min(doc_id) AS ord, id, min(lang) AS file, min(source) AS name FROM ruled WHERE source >= '{SPEAKERS_FROM}' GROUP BY id),
locks AS (SELECT DISTINCT id FROM ruled WHERE toxic = 1),
r AS (SELECT doc_id AS pos, substring(text, 1, 1) || n AS id, CASE WHEN directness > 0 THEN 'prose' ELSE 'table' END AS kind, CASE lang WHEN 'en' THEN 'voice' WHEN 'de' THEN 'lexicon' ELSE 'mechanics' END AS file, CASE WHEN toxic = 1 THEN 'disputed' WHEN quality = 1 THEN 'confirmed' WHEN quality = 0 THEN 'doubtful' ELSE '' END AS confidence, list_transform(list_distinct(regexp_extract_all(text, '[0-9]+')), lambda x: 'e' || x) AS evidence, coalesce(source = 'src3', false) AS locked FROM m),
e AS (SELECT 'e' || item_id AS id, CASE WHEN contains(text, '?') THEN 'interview' WHEN length(text) > 300 THEN 'corpus' ELSE 'hearsay' END AS type, [substring(text, 1, 1) || length(text)] AS produced FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark))"""


def texts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, lang, source, quality, toxic, text, n and a count of marks per dial."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    labels = read("labels").select(F.col("doc_id").alias("lid"), "quality", "toxic")
    t = read("documents").withColumn("text", F.coalesce("text", F.lit(""))).join(labels, F.col("doc_id") == F.col("lid"), "left")
    n = F.length("text").cast("long")
    marks = {x: n - F.length(F.replace("text", F.lit(c))).cast("long") for x, c in MARKS.items()}
    return t.select("doc_id", "lang", "source", "quality", "toxic", "text", n.alias("n"), *[c.alias(x) for x, c in marks.items()])


def _named(names: tuple[str, ...], number: str) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.col(number) % len(names)).cast("int") + 1)


def placed(m: DataFrame) -> DataFrame:
    return m.withColumns({"context": _named(CONTEXTS, "n"), "state": _named(STATES, "detail")})


def cells(m: DataFrame) -> DataFrame:
    """A cell a text: the dials whose mark it holds, by its count."""
    each = F.create_map(*[x for d in V.DIALS for x in (F.lit(d), (F.col(d) % 6).cast("int"))])
    return placed(m).select("context", "state", F.map_filter(each, lambda k, v: v > 0).alias("dials"))


def vectors(m: DataFrame) -> DataFrame:
    """A vector for each text that is labelled toxic."""
    state = F.col("quality") == 1
    dials = F.create_map(F.lit("warmth"), (F.col("warmth") - F.col("humor")).cast("int"), F.lit("humor"), (F.col("directness") - 3).cast("int"))
    return placed(m.where("toxic = 1")).select(F.when(state, "state").otherwise("context").alias("kind"), F.when(state, F.col("state")).otherwise(F.col("context")).alias("name"), dials.alias("dials"))


def ruled(m: DataFrame) -> DataFrame:
    return m.withColumn("id", F.concat(F.when(F.col("humor") > 0, "V").otherwise("L"), F.col("n") % 300))


def bases(m: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """House rules, a speaker's rules and the locked ids."""
    r = ruled(m)
    side = lambda df: df.groupBy("id").agg(F.min("doc_id").alias("ord"), F.min("lang").alias("file"), F.min("source").alias("name")).select("ord", "id", "file", "name")
    return side(r.where(F.col("source") < SPEAKERS_FROM)), side(r.where(F.col("source") >= SPEAKERS_FROM)), r.where("toxic = 1").select("id").distinct()


def rules(m: DataFrame) -> DataFrame:
    evidence = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))), lambda x: F.concat(F.lit("e"), x))
    confidence = F.when(F.col("toxic") == 1, "disputed").when(F.col("quality") == 1, "confirmed").when(F.col("quality") == 0, "doubtful").otherwise("")
    file = F.when(F.col("lang") == "en", "voice").when(F.col("lang") == "de", "lexicon").otherwise("mechanics")
    return m.select(F.col("doc_id").alias("pos"), F.concat(F.substring("text", 1, 1), "n").alias("id"), F.when(F.col("directness") > 0, "prose").otherwise("table").alias("kind"), file.alias("file"), confidence.alias("confidence"), evidence.alias("evidence"), F.coalesce(F.col("source") == "src3", F.lit(False)).alias("locked"))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    b = spark.read.parquet(f"{d}/benchmark.parquet").withColumn("text", F.coalesce("text", F.lit("")))
    kind = F.when(F.contains("text", F.lit("?")), "interview").when(F.length("text") > 300, "corpus").otherwise("hearsay")
    return b.select(F.concat(F.lit("e"), "item_id").alias("id"), kind.alias("type"), F.array(F.concat(F.substring("text", 1, 1), F.length("text"))).alias("produced"))


def authored(m: DataFrame) -> DataFrame:
    """Cells written out: those of the texts labelled toxic, the first one of a place counting."""
    return placed(m.where("toxic = 1")).select(F.col("doc_id").alias("pos"), "context", "state", *[(F.col(d) % 5).cast("int").alias(d) for d in V.DIALS])


def grid(spark: SparkSession, d: str, speaker: dict[str, int] | None = None) -> DataFrame:
    return tone.matrix(spark, tone.vector_frame(spark, "state", V.STATE_VECTORS), tone.vector_frame(spark, "context", V.CONTEXT_OFFSETS), authored(texts(spark, d)), speaker)


def _values(rows: dict[str, tuple]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in rows.items()) + ")"


def grid_sql(speaker: dict[str, int]) -> str:
    """Common table expressions ending in `grid`."""
    dials = ", ".join(V.DIALS)
    free = "(" + ", ".join(f"'{s}'" for s in V.HUMOR_FREE_STATES) + ")"
    col = lambda x: f"CASE WHEN a.context IS NOT NULL THEN a.{x} ELSE greatest(0, least(4, s.{x} + c.{x} + {speaker.get(x, 0)})) END" if x != "humor" else f"CASE WHEN a.context IS NOT NULL AND s.state NOT IN {free} THEN a.humor ELSE 0 END"
    return f"""{SQL}, a AS (SELECT * FROM (SELECT context, state, {", ".join(f"{x} % 5 AS {x}" for x in V.DIALS)}, row_number() OVER (PARTITION BY context, state ORDER BY doc_id) AS nth FROM placed WHERE toxic = 1) WHERE nth = 1),
grid AS (SELECT c.context, s.state, {", ".join(f"CAST({col(x)} AS INTEGER) AS {x}" for x in V.DIALS)}, CASE WHEN a.context IS NOT NULL THEN 'authored' ELSE 'computed' END AS origin FROM {_values(V.STATE_VECTORS)} s(state, {dials}) CROSS JOIN {_values(V.CONTEXT_OFFSETS)} c(context, {dials}) LEFT JOIN a ON a.context = c.context AND a.state = s.state)"""


def tone_lines(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slug, md) of every source, whose counts of marks are written out as a line of dials
    where it has texts with a question; and the house's line (md) over all texts."""
    line = F.concat(F.lit("# Tone\n\n**Default dials:** "), F.concat_ws(" · ", *[F.concat(F.lit(x + " "), F.sum(x) % 5) for x in V.DIALS]))
    asked = F.max("humor") > 1
    each = m.where("source is not null").groupBy(F.col("source").alias("slug")).agg(F.when(asked, line).otherwise("# Tone").alias("md"))
    return each, m.agg(line.alias("house_md"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """(path, raw): the plain words of every turn, written as a file of each text format."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    t = c.select(F.concat("conv_id", F.lit("-"), "turn").alias("name"), words.alias("w")).where(F.size(F.split("w", " ")) >= 3)
    wrapped = {
        "md": F.concat(F.lit("---\ntitle: x\n---\n# "), "w", F.lit("\n\n```\ncode\n```\n")),
        "html": F.concat(F.lit("<h1>"), "w", F.lit("</h1><script>no()</script>")),
        "txt": F.concat("w", F.lit("\n\n")),
        "po": F.concat(F.lit('msgid ""\nmsgstr "Header: x"\n\nmsgid "a b c"\nmsgstr "'), "w", F.lit('"\n')),
        "vtt": F.concat(F.lit("WEBVTT\n\n00:01 --> 00:02\n"), "w", F.lit("\n")),
        "csv": F.concat(F.lit("12,"), "w", F.lit("\n")),
        "tsv": F.concat(F.lit("12\t"), "w", F.lit("\n")),
        "yml": F.concat(F.lit("url: https://x.y\nnested:\n  label: "), "w", F.lit("\n")),
        "json": F.to_json(F.struct(F.struct(F.array("w", F.lit("https://x.y")).alias("b")).alias("a"))),
        "rtf": F.concat(F.lit("{\\rtf1{\\fonttbl{\\f0 Arial;}}"), "w", F.lit("\\par}")),
    }
    each = F.array(*[F.struct(F.concat("name", F.lit("." + x)).alias("path"), raw.alias("raw")) for x, raw in wrapped.items()])
    return t.select(F.inline(each))


def samples_sql() -> str:
    kinds = {"md": "markdown", "html": "html", "txt": "text", "po": "po", "vtt": "subtitles", "csv": "csv", "tsv": "tsv", "yml": "yaml", "json": "json", "rtf": "rtf"}
    rows = ", ".join(f"('{x}', '{f}')" for x, f in kinds.items())
    return f"SELECT name || '.' || x AS path, f AS format, w AS unit FROM (SELECT conv_id || '-' || turn AS name, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) AS w FROM conversations) CROSS JOIN (VALUES {rows}) k(x, f) WHERE len(string_split(w, ' ')) >= 3"


# --- the state of a profile: every source is one, its languages are its speakers

LANGS = ("en", "de", "fr", "es")


def _count(condition: str) -> tuple[str, str]:
    """A count, in Spark's SQL and in DuckDB's (one text for both)."""
    return (f"count_if({condition})",) * 2


def _names(tests: dict[str, str]) -> tuple[str, str]:
    """The names whose test over the group holds."""
    each = ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests.items())
    return f"array_compact(array({each}))", f"list_filter([{each}], lambda x: x IS NOT NULL)"


def _of_lang(test: str) -> tuple[str, str]:
    return _names({x: test.replace("LANG", f"lang = '{x}'") for x in LANGS})


STATE = {
    "exists": ("count_if(warmth > 0) > 0",) * 2,
    "errors": _count("toxic = 1"),
    "unbaselined": _of_lang("count_if(LANG) < 5"),
    "never_ingested": _count("quality IS NULL AND lang = 'es' AND n < 200"),
    "rules": _count("directness > 0"),
    "assumed": _count("directness > 0 AND warmth = 0"),
    "bare_contexts": _names({c: f"count_if(context = '{c}') = 0" for c in V.CONTEXTS}),
    "stale_card_inputs": _names({"voice": "min(n) < 60", "tone": "max(n) > 15000"}),
    "manifest_checked": ("max(n) > 3000",) * 2,
    "manifest_changed": _count("n < 20"),
    "flagged_metrics": _count("formality = 0 AND n > 2000"),
    "disputed": _count("toxic = 1 AND quality = 1"),
    "freshness_checked": ("count_if(lang = 'de') > 1",) * 2,
    "stale_sources": ("count(text) - count(DISTINCT text)",) * 2,
    "locales_without_pack": _names({"es": "count_if(lang = 'es') > 5"}),
    "drafts": _count("detail > 200"),
    "stale_extractors": _count("urgency > 100"),
    "no_evidence": _count("formality = 0 AND lang = 'en' AND n > 500"),
    "card_tokens": ("CAST(floor(sum(n) / 100) AS BIGINT)",) * 2,
    "voiceless_speakers": _of_lang("count_if(LANG) > 0 AND count_if(LANG AND humor > 0) = 0"),
    "unbaselined_speakers": _of_lang("count_if(LANG) = 3"),
    "uningested_speakers": _of_lang("count_if(LANG AND toxic = 1) > 1"),
    "stale_speaker_cards": _of_lang("count_if(LANG AND n > 9000) > 0"),
    "speakers": ("count(DISTINCT lang)",) * 2,
    "locks": _count("toxic = 1 AND lang = 'en'"),
}
STAGES = {"scan": "count(*) > 0", "ingest": "count(quality) > 0", "measure": "count_if(toxic = 1) > 0", "draft": "max(n) > 9000", "interview": "count_if(warmth > 0) > 2", "canonize": "min(n) > 300"}


def states(m: DataFrame) -> DataFrame:
    """A row of the state per source."""
    return placed(m).where("source is not null").groupBy("source").agg(*[F.expr(spark_sql).alias(k) for k, (spark_sql, _) in STATE.items()])


def stages(m: DataFrame) -> DataFrame:
    return m.where("source is not null").groupBy("source").agg(*[F.expr(x).alias(k) for k, x in STAGES.items()])


def gaps_sql(detectors) -> str:
    """(source, id, severity, leverage) of every gap, each detector written out again."""
    some, over = (lambda c: f"len({c}) > 0"), (lambda c, n=0: f"{c} > {n}")
    tests = {
        "G02": over("errors"), "G03": some("unbaselined"), "G04": over("never_ingested"), "G05": "rules > 0 AND assumed = rules", "G06": some("bare_contexts"), "G07": some("stale_card_inputs"), "G08": "NOT manifest_checked OR manifest_changed > 0",
        "G09": over("flagged_metrics"), "G10": over("disputed"), "G11": "freshness_checked AND stale_sources > 0", "G12": some("locales_without_pack"), "G13": over("drafts"), "G14": over("stale_extractors"), "G15": over("no_evidence"), "G16": over("card_tokens", 900),
        "G17": some("voiceless_speakers"), "G18": some("unbaselined_speakers"), "G19": some("uningested_speakers"), "G20": some("stale_speaker_cards"), "G21": "speakers > 0 AND locks = 0",
    }
    grades = {i: (s, n) for i, s, n, *_ in detectors}
    each = " UNION ALL ".join(f"SELECT source, '{i}', '{grades[i][0]}', {grades[i][1]} FROM st WHERE \"exists\" AND ({t})" for i, t in tests.items())
    state = ", ".join(f'{duck} AS "{k}"' for k, (_, duck) in STATE.items())
    return f"WITH {SQL}, st AS (SELECT source, {state} FROM placed WHERE source IS NOT NULL GROUP BY source) SELECT source, 'G01' AS id, 'blocker' AS severity, 5 AS leverage FROM st WHERE NOT \"exists\" UNION ALL {each}"


def stages_sql() -> str:
    """The furthest stage that a source has reached."""
    each = ", ".join(f"{x} AS {k}" for k, x in STAGES.items())
    last = " ".join(f"WHEN {k} THEN '{k}'" for k in reversed(STAGES))
    return f'WITH {SQL}, st AS (SELECT source, {each} FROM m WHERE source IS NOT NULL GROUP BY source) SELECT *, CASE {last} END AS "at" FROM st'
