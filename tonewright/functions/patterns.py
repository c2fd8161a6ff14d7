"""Many patterns over many texts in one pass.

Terms are found by one Aho-Corasick automaton, whatever their number, and count where no letter
or digit touches them.  A regex runs only on texts that hold a literal which each of its
matches must hold; these literals are further words of the same automaton.  Regexes without
one run on every text.

Letters are compared as the JVM does without regard to case: each code point by the lower
form of its upper form, where these are single code points.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa

from tonewright.functions.scan import LETTER, NUMBER, classes

#: Code points that have another case lie below.
_CASED = 0x20000


@lru_cache(maxsize=1)
def _folds() -> np.ndarray:
    out = np.arange(_CASED, dtype="<u4")
    for c in range(_CASED):
        x = chr(c)
        up = x.upper()
        low = (up if len(up) == 1 else x).lower()
        out[c] = ord(low) if len(low) == 1 else ord(up) if len(up) == 1 else c
    return out


def folded(text: str) -> str:
    """The text with each code point in its form for comparison; as long as it was."""
    if text.isascii():
        return text.lower()
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    cased = cp < _CASED
    cp[cased] = _folds()[cp[cased]]
    return cp.tobytes().decode("utf-32-le", "surrogatepass")


def needed_literal(regex: str, least: int = 2) -> str | None:
    """A literal, folded, that every match of a regex holds; null where none is evident.  Only
    what stands outside of groups, classes and alternatives is taken, and not what a quantifier
    may drop: the longest such stretch."""
    found, now = [], ""
    at, depth = 0, 0

    def flush() -> None:
        nonlocal now
        found.append(now)
        now = ""

    while at < len(regex):
        c = regex[at]
        if c == "\\":
            if at + 1 >= len(regex):
                return None
            nxt = regex[at + 1]
            if nxt in "QEpPxukNcbB0123456789":
                # a quoted stretch or a code: taken as no literal, its body as nothing certain
                if nxt in "QEN":
                    return None
                flush()
                at += 2
                if nxt in "pPxNk" and at < len(regex) and regex[at] in "{<":
                    close = regex.find("}" if regex[at] == "{" else ">", at)
                    at = len(regex) if close < 0 else close + 1
                elif nxt in "pP":
                    at += 1
                elif nxt == "x":
                    at += 2
                elif nxt == "u":
                    at += 4
                elif nxt == "c":
                    at += 1
                elif nxt == "0":
                    while at < len(regex) and regex[at].isdigit():
                        at += 1
                elif nxt.isdigit():
                    while at < len(regex) and regex[at].isdigit():
                        at += 1
                continue
            if nxt.isalnum():
                flush()
            elif depth == 0:
                now += nxt
            at += 2
            continue
        if c == "[":
            flush()
            level, at = 1, at + 1
            if at < len(regex) and regex[at] == "^":
                at += 1
            if at < len(regex) and regex[at] == "]":
                at += 1
            while at < len(regex) and level:
                if regex[at] == "\\":
                    at += 1
                elif regex[at] == "[":
                    level += 1
                elif regex[at] == "]":
                    level -= 1
                at += 1
            continue
        if c == "(":
            flush()
            depth += 1
            inline = regex[at + 1 : at + 4]
            if inline.startswith("?") and inline[1:2] not in ("", ":", "=", "!", "<", ">"):
                return None  # flags change what follows
        elif c == ")":
            depth -= 1
            if depth < 0:
                return None
            flush()
        elif c == "|":
            if depth == 0:
                return None
            flush()
        elif c in "?*{":
            now = now[:-1]
            flush()
            if c == "{":
                close = regex.find("}", at)
                at = len(regex) if close < 0 else close
        elif c in "+.^$":
            flush()
        elif depth == 0:
            now += c
        at += 1
    flush()
    best = max((folded(x) for x in found), key=len, default="")
    return best if len(best) >= least else None


@dataclass(frozen=True)
class Patterns:
    """`terms`: (name, text); `literals`: a literal of each regex, or null where it always runs."""

    terms: tuple[tuple[str, str], ...]
    literals: tuple[str | None, ...]


class Matcher:
    def __init__(self, patterns: Patterns):
        self.names = [n for n, _ in patterns.terms]
        self.always = [k for k, x in enumerate(patterns.literals) if x is None]
        self.automaton = ahocorasick.Automaton()
        held: dict[str, tuple[list[int], list[int]]] = {}
        for k, (_, text) in enumerate(patterns.terms):
            held.setdefault(folded(text), ([], []))[0].append(k)
        for k, x in enumerate(patterns.literals):
            if x is not None:
                held.setdefault(x, ([], []))[1].append(k)
        for word, (terms, regexes) in held.items():
            if word:
                self.automaton.add_word(word, (len(word), terms, regexes))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.edge = (classes() & (LETTER | NUMBER)) != 0

    def find(self, text: str) -> tuple[dict[int, int], list[int]]:
        """Hits of each term, leftmost and without overlaps, and the regexes to be run."""
        hits: dict[int, int] = {}
        ends: dict[int, int] = {}
        run = set(self.always)
        if len(self.automaton) and text:
            low, edge, n = folded(text), self.edge, len(text)
            for last, (size, terms, regexes) in self.automaton.iter(low):
                run.update(regexes)
                if not terms:
                    continue
                start, end = last + 1 - size, last + 1
                if start and edge[ord(text[start - 1])] or end < n and edge[ord(text[end])]:
                    continue
                for k in terms:
                    if start >= ends.get(k, 0):
                        hits[k] = hits.get(k, 0) + 1
                        ends[k] = end
        return hits, sorted(run)


@lru_cache(maxsize=4)
def matcher(patterns: Patterns) -> Matcher:
    """One automaton a worker process and set of patterns."""
    return Matcher(patterns)


def found(texts: pa.Array, patterns: Patterns) -> pa.StructArray:
    """Per text: `terms`, (id, hits) of the terms that occur, and `run`, places of regexes."""
    m = matcher(patterns)
    ids, counts, cuts, run, run_cuts = [], [], [0], [], [0]
    for t in texts.to_pylist():
        hits, may = m.find(t or "")
        ids += [m.names[k] for k in hits]
        counts += hits.values()
        cuts.append(len(ids))
        run += may if t is not None else []
        run_cuts.append(len(run))
    each = pa.StructArray.from_arrays([pa.array(ids, pa.string()), pa.array(counts, pa.int64())], ["id", "hits"])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), each), pa.ListArray.from_arrays(pa.array(run_cuts, pa.int32()), pa.array(run, pa.int32()))], ["terms", "run"])
