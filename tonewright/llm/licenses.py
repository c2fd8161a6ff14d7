"""License scans: an Aho-Corasick automaton over words, and licence expressions.

Each text is lower-cased (A-Z only), cut into words and joined by single spaces; one
Aho-Corasick automaton finds notice phrases and identifier tags at word boundaries.
After an identifier tag the original text holds a licence expression: a shunting-yard
parser turns ``id``, ``and``, ``or``, ``with`` and parentheses into postfix, which is
evaluated to the labels named and to a score.

The score is how permissive the whole text is: an identifier's permissiveness (0 to 1;
an unknown identifier 0.5), ``and`` the least, ``or`` the greatest, ``with`` a tenth of
the way to 1; several notices in one text hold together, so the least counts; without a
notice 0.

Defined results: null text is empty; a malformed expression yields the labels of the
identifiers before the error and no score of its own; repeated rows are repeated;
other columns are not kept.  Nothing is shuffled, a row is one text.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The notice phrases of the base contract.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases and what they name.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 3 clause": "bsd-3-clause",
    "bsd 2 clause": "bsd-2-clause",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl-1.0",
    "eclipse public license": "epl",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0-1.0",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: How permissive a licence is, by the first family its identifier starts with.
PERMISSIVE = {
    "mit": 1.0, "isc": 1.0, "bsd": 1.0, "apache": 1.0, "cc0": 1.0, "unlicense": 1.0, "0bsd": 1.0, "zlib": 1.0, "bsl": 1.0,
    "cc-by-nc": 0.2, "cc-by-nd": 0.3, "cc-by-sa": 0.6, "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "agpl": 0.3, "gpl": 0.4,
    "all-rights-reserved": 0.0,
}

_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_TAG_TEXT = re.compile(r"(?i)spdx[\W_]*license[\W_]*identifier[^\w(\n]*")
_TOKEN = re.compile(r"[^\S\n]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*)")
_NAME = re.compile(r"[^\S\n]*([A-Za-z0-9.+\-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


def permissiveness(label: str) -> float:
    for family in sorted(PERMISSIVE, key=len, reverse=True):
        if label.startswith(family):
            return PERMISSIVE[family]
    return 0.5


def to_postfix(expression: str, at: int = 0, end: int = sys.maxsize) -> list[str]:
    """Shunting-yard from `at` to `end`: identifiers lower-cased, operators after their operands.  The
    expression ends where the grammar or the line ends; ``ValueError`` if it is malformed before."""
    out, stack, want = [], [], True
    while m := _TOKEN.match(expression, at, end):
        token = m[1].lower().rstrip(".") or m[1]
        if want:
            if token == "(":
                stack.append(token)
            elif token in _RANK or token == ")":
                raise ValueError("an identifier is missing")
            else:
                out.append(token)
                want = False
        elif token == ")":
            if "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif token in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            want = True
        else:
            break
        at = m.end()
    if want or "(" in stack:
        raise ValueError("the expression breaks off")
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels named and permissiveness; an exception after ``with`` is not a label."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token in _RANK:
            (rl, rs), (ll, ls) = stack.pop(), stack.pop()
            stack.append((ll, ls + 0.1 * (1 - ls)) if token == "with" else (ll | rl, min(ls, rs) if token == "and" else max(ls, rs)))
        else:
            stack.append(({token}, permissiveness(token)))
    return stack[0]


def expressions(text: str) -> Iterator[tuple[set[str], float | None]]:
    tags = [m.span() for m in _TAG_TEXT.finditer(text)]
    for (_, at), (end, _) in zip(tags, [*tags[1:], (len(text), 0)], strict=True):
        try:
            yield evaluate(to_postfix(text, at, end))
        except ValueError:
            name = _NAME.match(text, at, end)[1]
            yield {name.lower()} - {"", *_RANK}, None


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str]):
        self.automaton = ahocorasick.Automaton()
        self.single = TAG
        for phrase in {**notices, **base, TAG: ""}:
            self.automaton.add_word(f" {phrase} ", phrase)
        self.automaton.make_automaton()
        self.base, self.notices = base, notices

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], set[str], float]:
        """Words, base places (word start, label), all labels, score."""
        words = text.encode("utf-8", "surrogatepass").translate(_KEPT).split()
        flat = " " + b" ".join(words).decode("latin-1") + " "
        places, labels, scores, tagged = [], set(), [], False
        at, word = 0, 0  # the words before `at` are counted on from the place before
        for end, phrase in self.automaton.iter(flat):
            if phrase in self.base:
                to = end - len(phrase) - 1
                word += flat.count(" ", at, to) if to >= at else -flat.count(" ", to, at)
                at = to
                places.append((word, self.base[phrase]))
                labels.add(self.base[phrase])
                scores.append(permissiveness(self.base[phrase]))
            elif phrase == TAG:
                tagged = True
            else:
                labels.add(self.notices[phrase])
                scores.append(permissiveness(self.notices[phrase]))
        if tagged:
            for named, score in expressions(text):
                labels |= named
                if score is not None:
                    scores.append(score)
        return len(words), places, labels, min(scores, default=0.0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, places (array of start and label), labels (array), score."""
    base, notices = base or BASE_PHRASES, NOTICE_PHRASES if notices is None else notices
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        place = pa.struct([("start", pa.int64()), ("label", pa.string())])
        for batch in batches:
            got = [scanner.scan(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([[{"start": s, "label": x} for s, x in g[1]] for g in got], pa.list_(place)), pa.array([sorted(g[2]) for g in got], pa.list_(pa.string())), pa.array([g[3] for g in got], pa.float64())],
                names=["doc_id", "n_words", "places", "labels", "score"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, places array<struct<start:long,label:string>>, labels array<string>, score double")
