"""SQL twins: text in DuckDB's dialect that states the same results as the queries."""

from __future__ import annotations

from tonewright.functions import vocab as V
from tonewright.functions.stats import COUNTERS, ENGLISH


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


_ABB = "|".join(a.replace(".", r"\.") for a in V.ABBREVIATIONS)
WORD = q(V.WORD)


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, {q(f'[{V.SPACE}]+')}, ' ', 'g'))"


def sentences(t: str) -> str:
    """Marks every candidate, then unmarks twice after abbreviations and lone capitals."""
    m = f"""regexp_replace({collapse(t)}, {q(r'''([.!?]+["')\]»”’]*) ''')}, {q(chr(92) + '1' + chr(10))}, 'g')"""
    for _ in range(2):
        m = f"regexp_replace({m}, {q(rf'(^|[^\p{{L}}.])((?i:{_ABB}))\.' + chr(10))}, {q(r'\1\2. ')}, 'g')"
    for _ in range(2):
        m = f"regexp_replace({m}, {q(r'(^|\s)(\p{Lu})\.' + chr(10))}, {q(r'\1\2. ')}, 'g')"
    return f"list_filter(string_split({m}, chr(10)), lambda s: length(trim(s)) > 0)"


def words(t: str) -> str:
    return f"regexp_extract_all({t}, {WORD})"


def paragraphs(t: str) -> str:
    ends = q(rf"\A[{V.SPACE}]+|[{V.SPACE}]+\z")
    return f"list_filter(list_transform(regexp_split_to_array({t}, {q(chr(10) + '[ ' + chr(92) + 't]*' + chr(10) + '+')}), lambda p: regexp_replace(p, {ends}, '', 'g')), lambda p: p <> '')"


def syllables(w: str) -> str:
    letters = f"regexp_replace(lower({w}), '[^a-z]', '', 'g')"
    core = f"regexp_replace(regexp_replace({letters}, '(?:[^laeiouy]es|[^laeiouy]ed|[^laeiouy]e)$', ''), '^y', '')"
    return f"(CASE WHEN {letters} = '' THEN 0 WHEN length({letters}) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all({core}, '[aeiouy]{{1,2}}'))) END)"


def rounded(x: str, places: int) -> str:
    return f"(floor(({x}) * {10**places}.0 + 0.5) / {10**places}.0)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"


def count(pattern: str, t: str = "t") -> str:
    return f"len(regexp_extract_all({t}, {q(pattern)}))"


def size_where(a: str, condition: str) -> str:
    return f"len(list_filter({a}, lambda x: {condition}))"


def unit_stats(units: str, keep: tuple[str, ...] = ("unit_id", "locale")) -> str:
    """Common table expressions ending in `stats`, over the named relation."""
    k = ", ".join(keep)
    person = lambda lists: "CASE " + " ".join(f"WHEN lang = {q(lang)} THEN {size_where('lw', 'x IN ' + among(w))}" for lang, w in lists.items()) + " ELSE 0 END"
    total = lambda a, e: f"coalesce(list_sum(list_transform({a}, lambda x: {e})), 0)"
    hist = {n: size_where("n", f"x >= {lo}" + ("" if hi is None else f" AND x <= {hi}")) for n, lo, hi, _ in V.HISTOGRAM}
    passive = rf"(?i)\b(?:{V.BE_VERBS})\s+(?:\w+ed|{V.PARTICIPLES})\b"
    contraction = rf"(?i)\b\w+['’](?:{V.CONTRACTION_TAIL})\b"
    minor = f"lower(x) IN {among(V.MINOR_WORDS)}"
    title = f"len(list_filter(multi, lambda h: len(list_filter(h, lambda x, i: (i = 1 OR NOT {minor}) AND NOT regexp_matches(x, '^[\\p{{Lu}}\\p{{N}}]'))) = 0))"
    en = lambda e: f"CASE WHEN has_english THEN {e} ELSE 0 END"
    values = {
        "strings": "len(strings)", "words": "len(w)", "sentences": "len(s)", "paragraphs": "len(p)",
        "sum_word_len": total("w", "length(x)"), "sum_sent_len": total("n", "x"), "sum_sent_len_sq": total("n", "x * x"), "sum_para_sent": total("p", f"len({sentences('x')})"),
        "exclamations": size_where("s", r"regexp_matches(x, '!\p{P}*$')"), "questions": size_where("s", r"regexp_matches(x, '\?\p{P}*$')"),
        "emoji": count(V.EMOJI), "em_dash": count(r"—|\s-\s"), "semicolon": count(";"),
        "first_person": person(V.FIRST_PERSON), "second_person": person(V.SECOND_PERSON),
        "headings_total": en("len(multi)"), "headings_title_case": en(title), **hist,
    }
    english = {
        "syllables": total("syl", "x"), "contractions": count(contraction), "passive_sentences": size_where("s", f"regexp_matches(x, {q(passive)})"),
        "imperative_openers": size_where("s", f"lower(regexp_extract(x, {WORD})) IN {among(V.OPENERS)}"),
        "hedges": size_where("lw", "x IN " + among(V.HEDGES)), "intensifiers": size_where("lw", "x IN " + among(V.INTENSIFIERS)),
        "oxford_lists": count(V.SERIAL_LIST), "oxford_hits": size_where(f"regexp_extract_all(t, {q(V.SERIAL_LIST)})", f"regexp_matches(x, {q(V.OXFORD)})"), "long_words": size_where("syl", "x > 3"),
    }
    cols = [f"CAST({e} AS BIGINT) AS {c}" for c, e in values.items()]
    cols += [f"lang IN {among(V.FIRST_PERSON)} AS person_markers", "has_english"]
    cols += [f"CAST({en(e)} AS BIGINT) AS {c}" for c, e in english.items()]
    return f"""
base AS (SELECT {k}, strings, headings, array_to_string(strings, chr(10) || chr(10)) AS t, starts_with(lower(locale), 'en') AS has_english, lower(substring(locale, 1, 2)) AS lang FROM {units}),
cut AS (SELECT *, {words("t")} AS w, flatten(list_transform(strings, lambda x: {sentences("x")})) AS s, {paragraphs("t")} AS p,
  list_filter(list_transform(headings, lambda h: {words("h")}), lambda h: len(h) >= 2) AS multi FROM base),
fine AS (SELECT *, list_transform(w, lambda x: lower(x)) AS lw, list_transform(s, lambda x: len({words("x")})) AS n, CASE WHEN has_english THEN list_transform(w, lambda x: {syllables("x")}) END AS syl FROM cut),
stats AS (SELECT {k}, {", ".join(cols)} FROM fine)"""


def merged(keys: str = "locale", source: str = "stats") -> str:
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in (*COUNTERS, *ENGLISH))
    return f"merged AS (SELECT {keys}, {sums}, coalesce(bool_and(person_markers) FILTER (WHERE words > 0), bool_and(person_markers)) AS person_markers, count(*) FILTER (WHERE has_english AND words > 0) > 0 AS has_english FROM {source} GROUP BY {keys})"


def finalised(keys: str = "locale", source: str = "merged") -> str:
    run, cases = "0", ""
    for name, _, _, mid in V.HISTOGRAM:
        run += f" + {name}"
        cases += f" WHEN {run} >= sentences / 2.0 THEN CAST({mid} AS DOUBLE)"
    per = lambda a: rounded(div(f"{a} * 1000.0", "words"), 2)
    marked = lambda e: f"CASE WHEN person_markers THEN {e} END"
    en = lambda e: f"CASE WHEN has_english THEN {e} END"
    mean = div("sum_sent_len", "sentences")
    cols = {
        "sentence_count": "sentences", "word_count": "words", "paragraph_count": "paragraphs", "mean_sentence_length": rounded(mean, 2),
        "median_sentence_length": f"CASE WHEN sentences > 0 THEN CASE{cases} END END",
        "sentence_length_sd": f"CASE WHEN sentences > 0 THEN {rounded(f'sqrt(greatest({div("sum_sent_len_sq", "sentences")} - {mean} * {mean}, 0.0))', 2)} END",
        "mean_paragraph_length": rounded(div("sum_para_sent", "paragraphs"), 2), "mean_word_length": rounded(div("sum_word_len", "words"), 2),
        "exclamation_rate": rounded(div("exclamations", "sentences"), 3), "question_rate": rounded(div("questions", "sentences"), 3),
        "emoji_per_1000": per("emoji"), "em_dash_per_1000": per("em_dash"), "semicolon_per_1000": per("semicolon"),
        "heading_title_case_ratio": rounded(div("headings_title_case", "headings_total"), 3),
        "first_person_per_1000": marked(per("first_person")), "second_person_per_1000": marked(per("second_person")), "contraction_per_1000": en(per("contractions")),
        "reading_grade": en(rounded(f"0.39 * {div('words', 'sentences')} + 11.8 * {div('syllables', 'words')} - 15.59", 2)),
        "passive_rate": en(rounded(div("passive_sentences", "sentences"), 3)), "imperative_opener_rate": en(rounded(div("imperative_openers", "sentences"), 3)),
        "hedge_per_1000": en(per("hedges")), "intensifier_per_1000": en(per("intensifiers")), "oxford_comma_rate": en(rounded(div("oxford_hits", "oxford_lists"), 3)), "long_word_rate": en(rounded(div("long_words", "words"), 3)),
    }
    return f"SELECT {keys}, " + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + f" FROM {source}"
