"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's regex a Boolean trigram query is derived: stretches that must occur give
"all trigrams of one of these strings", joined by "and".  The postings table holds a row
(trigram, document) for every trigram that some query asks for; intersecting the postings
of a document decides for which rules it is a candidate, and only candidates are verified
by the regex.  Rules without a mandatory trigram scan every document.

Spans are code points, leftmost and not overlapping per kind.  The document join is keyed
by id and text hash, so repeated rows and null ids are joined rightly, and its
candidate side is stored first, so that adaptive execution can split a hot key.
A row's own columns travel as one struct, apart from those of the join.

Defined results: null text is empty and has no spans; repeated rows are repeated;
an empty table gives no rows; other columns pass through `scan` unchanged, whatever their
names (`secrets` is replaced).  Whole texts are searched, whatever their length.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.llm.shared import stored

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    from re import _constants as sre
    from re import _parser as parser


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length must reach `least`
    least: int = 0


#: The base rules, then those that this method adds.  A hexadecimal run of 24 or more is
#: the same run whether it is asked for by ``{24,}`` or filtered afterwards.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("privatekey", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)

Query = list[list[frozenset[str]]]  # and of or of all-trigrams-of
_MOST = 64


def trigram_query(pattern: str) -> Query:
    """The trigrams, lower-cased, that any match must hold; [] if there are none."""
    out: Query = []

    def flush(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            out.append(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted))

    def walk(items, strings: set[str]) -> set[str]:
        """Strings that the items so far can spell since the last flush."""
        for op, arg in items:
            options: set[str] | None = None
            if op is sre.LITERAL:
                options = {chr(arg).lower()}
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 6:
                options = {chr(a).lower() for _, a in arg}
            elif op is sre.SUBPATTERN:
                options = exact(arg[3])
                if options is None:
                    strings = walk(arg[3], strings)
                    continue
            elif op is sre.BRANCH:
                each = [exact(b) for b in arg[1]]
                options = None if None in each else set().union(*each)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] == arg[1] == 1 or op is sre.MAX_REPEAT and arg[:2] == (0, 1):
                inner = exact(arg[2])
                options = None if inner is None else inner | ({""} if arg[0] == 0 else set())
            if options is not None and len(strings) * len(options) <= _MOST:
                strings = {s + o for s in strings for o in options}
            else:
                flush(strings)
                strings = options if options is not None else {""}
        return strings

    def exact(items) -> set[str] | None:
        """All strings that the items spell, if these are few."""
        strings = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                options = {chr(arg).lower()}
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 6:
                options = {chr(a).lower() for _, a in arg}
            elif op is sre.SUBPATTERN:
                options = exact(arg[3])
            elif op is sre.BRANCH:
                each = [exact(b) for b in arg[1]]
                options = None if None in each else set().union(*each)
            elif op is sre.MAX_REPEAT and arg[:2] == (0, 1):
                inner = exact(arg[2])
                options = None if inner is None else inner | {""}
            else:
                return None
            if options is None or len(strings) * len(options) > _MOST:
                return None
            strings = {s + o for s in strings for o in options}
        return strings

    flush(walk(parser.parse(pattern), {""}))
    return out


def postings(docs: DataFrame, grams: list[str], text: Column) -> DataFrame:
    """(gram number, __id, __hash): the inverted index for `grams`."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select("__id", "__hash", low.alias("__low")).select("__id", "__hash", F.explode(F.array_compact(F.array(*[F.when(F.contains("__low", F.lit(g)), F.lit(k)) for k, g in enumerate(grams)]))).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], text: Column) -> tuple[DataFrame, list[str]]:
    """(__id, __hash, __for_<kind>...) of the documents whose postings satisfy a query, and
    the kinds that have a query."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for any_of in q for s in any_of for g in s})
    number = {g: k for k, g in enumerate(grams)}
    words = len(grams) // 60 + 1
    masks = [F.bit_or(F.when((F.col("gram") >= 60 * w) & (F.col("gram") < 60 * w + 60), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram") - 60 * w)).otherwise(F.lit(0).cast("long"))).alias(f"__m{w}") for w in range(words)]
    held = postings(docs, grams, text).groupBy("__id", "__hash").agg(*masks)

    def has(trigrams: frozenset[str]) -> Column:
        need = [0] * words
        for g in trigrams:
            need[number[g] // 60] |= 1 << number[g] % 60
        return reduce(Column.__and__, [F.col(f"__m{w}").bitwiseAND(F.lit(n)) == F.lit(n) for w, n in enumerate(need) if n])

    flags = {k: reduce(Column.__and__, [reduce(Column.__or__, [has(s) for s in any_of]) for any_of in q]) for k, q in queries.items()}
    out = held.select("__id", "__hash", *[c.alias(f"__for_{k}") for k, c in flags.items()])
    return out.where(reduce(Column.__or__, [F.col(f"__for_{k}") for k in flags])), list(flags)


def spans(text: Column, rule: Rule, number: int, when: Column | None) -> Column:
    """array<struct<start, number, end, kind>> of a rule's matches."""
    none = F.expr("cast(array() as array<struct<start:int,number:int,end:int,kind:string>>)")
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else F.transform(matches, F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    zipped = F.arrays_zip(gaps.alias("gap"), F.transform(matches, F.length).alias("len"), sized.alias("sized"))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        last = first + F.coalesce(x["len"], F.lit(0))
        found = F.array(F.struct(first.alias("start"), F.lit(number).alias("number"), last.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(last.alias("at"), F.when(x["sized"] >= rule.least, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    there = text.rlike(rule.pattern)
    return F.when(there if when is None else F.coalesce(when, F.lit(False)) & there, F.aggregate(zipped, start, step, lambda a: a["out"])).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `secrets`: array of (start, number, end, kind), by start then rule."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("__row"), F.coalesce(quoted(text_col), F.lit("")).alias("__text"), quoted(id_col).alias("__id"))
    rows = rows.withColumn("__hash", F.xxhash64("__text"))
    found, gated = candidates(rows, rules, F.col("__text"))
    found = stored(found, "candidates")
    keyed = found.withColumnsRenamed({"__id": "__cid", "__hash": "__chash"})
    joined = rows.join(keyed, (F.col("__hash") == F.col("__chash")) & F.col("__id").eqNullSafe(F.col("__cid")), "left")
    each = [spans(F.col("__text"), r, k, F.col(f"__for_{r.kind}") if r.kind in gated else None) for k, r in enumerate(rules)]
    own = [F.col("__row").getField(c).alias(c) for c in docs.columns if c.lower() != "secrets"]
    return joined.select(*own, F.array_sort(F.concat(*each)).alias("secrets"))


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[redacted]", spans_col: str = "secrets") -> DataFrame:
    """The text with every span replaced; overlapping spans are replaced once."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    rest = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
    clean = F.aggregate(spans_col, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    return scanned.withColumn(text_col, F.when(F.size(spans_col) > 0, clean).otherwise(F.col(text_col)))
