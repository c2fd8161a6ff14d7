"""The counters of text units in one pass over their code points.

A table gives each code point its classes (letter, capital, space, punctuation, ...).  A batch
of units is one array of code points, and words, sentences, paragraphs and patterns are
questions on runs of classes and the gaps between them, asked of the whole batch at once.
What depends on a word's spelling (person, hedges, syllables) is found once per distinct word.
Units are laid side by side, their strings joined by a blank line, as the definition has it.

Bounds: a batch is cut into stretches of about `MOST` code points between units; some 60 bytes
a code point are held.  A longer unit is a stretch of its own.

Defined results: a null array of strings or headings is an empty one; a null string counts as
a string and has no text; a null locale is no language; bytes that are no UTF-8 are replaced.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tonewright.functions import vocab as V

MOST = 1 << 20
LETTER, NUMBER, CAPITAL, SPACE, PUNCT, EMOJI, CODE, TOKEN, JOINT, STOP, CLOSER, BLANK = (1 << k for k in range(12))
#: What stands between two units: a code point that is no character and has no class.
_GAP = 0x10FFFF
_FLAGS = ("syllables", "long", "hedge", "intensifier", "opener", "minor", "upper", "first_en", "first_cs", "first_de", "second_en", "second_cs", "second_de")


def _members(body: str) -> Iterable[int]:
    """The code points of a pattern's class body of literals, \\x{...}, escapes and ranges."""
    escapes = {"t": 9, "n": 10, "x0B": 11, "f": 12, "r": 13}
    atoms = [int(h, 16) if h else escapes[e] if e else ord(c) if c != "-" else None for h, e, c in re.findall(r"\\x\{([0-9a-f]+)\}|\\(x0B|[tnfr])|(.)", body)]
    at = 0
    while at < len(atoms):
        if at + 2 < len(atoms) and atoms[at + 1] is None:
            yield from range(atoms[at], atoms[at + 2] + 1)
            at += 3
        else:
            yield atoms[at]
            at += 1


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The classes of every code point; past the fourth plane none has any."""
    out = np.zeros(sys.maxunicode + 1, np.uint16)
    by_category = {"L": LETTER, "N": NUMBER, "P": PUNCT}
    for c in range(0x40000):
        kind = unicodedata.category(chr(c))
        out[c] = by_category.get(kind[0], 0) | (CAPITAL if kind == "Lu" else 0)
    out[list(_members(V.SPACE))] |= SPACE
    out[list(_members(V.EMOJI.strip("[]")))] |= EMOJI
    word = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"]
    out[word] |= CODE | TOKEN
    for kind, members in ((TOKEN | JOINT, "'’-"), (STOP, ".!?"), (CLOSER, "\"')]»”’"), (BLANK, " \t\n\v\f\r")):
        out[[ord(c) for c in members]] |= kind
    return out


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of a mask."""
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def every_other(valid: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of candidates in order, those that a search without overlaps takes, where each overlaps
    the next only (`follows`: it overlaps the one before)."""
    at = np.arange(len(valid))
    first = valid & ~(follows & np.append(False, valid[:-1]))
    start = np.maximum.accumulate(np.where(first, at, 0))
    return valid & ((at - start) % 2 == 0)


def syllables_of(word: str) -> int:
    """English syllables of one word."""
    letters = "".join(c for c in word.lower() if "a" <= c <= "z")
    if len(letters) <= 3:
        return 1 if letters else 0
    core = letters
    for tail in ("es", "ed", "e"):
        if letters.endswith(tail) and letters[-len(tail) - 1] not in "laeiouy":
            core = letters[: -len(tail) - 1]
            break
    return max(1, sum((len(g) + 1) // 2 for g in re.findall("[aeiouy]+", core.removeprefix("y"))))


class Words:
    """What is known of distinct words, kept from batch to batch up to `most` of them."""

    def __init__(self, most: int = 200_000):
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(_FLAGS)), np.int32)
        self.most = most
        self.hedges, self.intensifiers, self.openers, self.minor = map(frozenset, (V.HEDGES, V.INTENSIFIERS, V.OPENERS, V.MINOR_WORDS))
        self.persons = [frozenset(v[k]) for v in (V.FIRST_PERSON, V.SECOND_PERSON) for k in ("en", "cs", "de")]

    def facts(self, words: list[str]) -> np.ndarray:
        """A row of `_FLAGS` per word."""
        if len(self.known) > self.most:
            self.known.clear()
        known, fresh = self.known, []
        for w in words:
            if w not in known:
                known[w] = len(known)
                low, n = w.lower(), syllables_of(w)
                sets = (low in self.hedges, low in self.intensifiers, low in self.openers, low in self.minor, unicodedata.category(w[0])[0] == "N" or unicodedata.category(w[0]) == "Lu")
                fresh.append((n, n > 3, *sets, *(low in p for p in self.persons)))
        if fresh:
            self.rows = np.concatenate([self.rows[: len(known) - len(fresh)], np.array(fresh, np.int32)])
        return self.rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]


class Text:
    """A stretch of units as code points, with where its strings and units begin."""

    def __init__(self, strings: list[list[str]]):
        parts, lengths, of_unit = [], [], []
        for k, each in enumerate(strings):
            for j, s in enumerate(each):
                parts.append(s)
                parts.append("\n\n" if j + 1 < len(each) else chr(_GAP))
                lengths.append(len(s) + (2 if j + 1 < len(each) else 1))
                of_unit.append(k)
        # a gap in front, so that every code point has one before it
        self.cp = np.frombuffer((chr(_GAP) + "".join(parts)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        #: where strings begin, and the unit of each
        self.start = 1 + np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if lengths else np.zeros(0, np.int64)
        self.of_unit = np.array(of_unit, np.int64)
        self.n = len(strings)
        self.kind = classes()[self.cp]
        gap = np.zeros(len(self.cp), bool)
        gap[0] = True
        if lengths:
            last = np.append(self.of_unit[1:] != self.of_unit[:-1], True)
            gap[(self.start + np.array(lengths) - 1)[last]] = True
        self.gap = gap
        self.lower = np.where((self.cp >= 65) & (self.cp <= 90), self.cp + 32, self.cp)

    def has(self, which: int) -> np.ndarray:
        return (self.kind & which) != 0

    def string_at(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, places, "right") - 1

    def unit_at(self, places: np.ndarray) -> np.ndarray:
        return self.of_unit[self.string_at(places)] if len(places) else np.zeros(0, np.int64)

    def per_unit(self, places: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.unit_at(places), weights, self.n).astype(np.int64)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Starts, ends, places in the dictionary and the dictionary of the words."""
        body = self.has(LETTER | NUMBER)
        joint = self.has(JOINT)
        inside = body.copy()
        inside[1:-1] |= joint[1:-1] & body[:-2] & body[2:]
        start, end = runs(inside)
        held = self.cp[inside]
        size = 1 + (held >= 0x80) + (held >= 0x800) + (held >= 0x10000)
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(end - start)])]
        values = held.astype("<u4").tobytes().decode("utf-32-le").encode()
        coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values)).dictionary_encode()
        return start, end, coded.indices.to_numpy(), coded.dictionary.to_pylist()

    def short_names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Runs of up to 8 code points of ASCII as numbers, lower-cased; longer ones are 0."""
        out = np.zeros(len(start), np.uint64)
        size = end - start
        few = np.flatnonzero(size <= 8)
        for k in range(8):
            few = few[size[few] > k]
            out[few] |= (self.lower[start[few] + k] & 0xFF).astype(np.uint64) << np.uint64(8 * k)
        return out


def named(words: Iterable[str]) -> np.ndarray:
    return np.array([int.from_bytes(w.encode(), "little") for w in words], np.uint64)


def sentence_ends(t: Text, content: np.ndarray) -> np.ndarray:
    """Places of the last code point of sentences that another one of their string follows."""
    start, end = runs(t.has(STOP))
    # closers right after the run belong to it
    c_start, c_end = runs(t.has(CLOSER))
    k = np.searchsorted(c_start, end)
    with_closers = (k < len(c_start)) & (c_start[np.minimum(k, len(c_start) - 1)] == end) if len(c_start) else np.zeros(len(end), bool)
    last = end - 1
    last[with_closers] = c_end[k[with_closers]] - 1
    space = t.has(SPACE)
    ok = space[np.minimum(last + 1, len(space) - 1)]
    start, end, last = start[ok], end[ok], last[ok]
    # content must follow in the same string
    places = np.flatnonzero(content)
    k = np.searchsorted(places, last, "right")
    ok = k < len(places)
    ok[ok] = t.string_at(places[k[ok]]) == t.string_at(last[ok])
    start, end, last = start[ok], end[ok], last[ok]
    # a single stop after an abbreviation or a lone capital ends nothing
    single = np.flatnonzero((end - start == 1) & (last == start) & (t.cp[start] == ord(".")))
    at = start[single]
    lone = t.has(CAPITAL)[at - 1] & ~content[np.maximum(at - 2, 0)]
    short = np.zeros(len(at), bool)
    no_start = t.has(LETTER) | (t.cp == ord("."))
    for a in V.ABBREVIATIONS:
        same = at > len(a)
        for j, c in enumerate(a):
            same &= t.lower[np.maximum(at - len(a) + j, 0)] == ord(c)
        short |= same & ~no_start[np.maximum(at - len(a) - 1, 0)]
    keep = np.ones(len(start), bool)
    keep[single[lone | short]] = False
    return last[keep]


def serial_lists(t: Text) -> tuple[np.ndarray, np.ndarray]:
    """Starts of lists "a, b and c", found without overlaps, and whether a comma stands before
    the conjunction."""
    start, end = runs(t.has(TOKEN))
    if len(start) < 4:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    blank = t.has(BLANK)
    comma = t.cp == ord(",")
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    blanks, commas = count(blank), count(comma)
    a, b = end[:-1], start[1:]  # the gap after each token
    n_blank, n_comma = blanks[b] - blanks[a], commas[b] - commas[a]
    plain = n_blank + n_comma == b - a
    spaced = plain & (n_comma == 0) & (n_blank > 0)
    one = plain & (n_comma == 1)
    trailing = one & blank[b - 1]  # the comma comes first, a blank last
    joins = np.isin(t.short_names(start, end), named(("and", "or")))
    i = np.flatnonzero(one[:-2] & (spaced | trailing)[1:-1] & joins[2:-1] & spaced[2:])
    taken, free = [], 0
    for k in i.tolist():
        if k >= free:
            taken.append(k)
            free = k + 4
    i = np.array(taken, np.int64)
    return start[i], trailing[i + 1] | (trailing[i] & joins[i + 1] & spaced[i + 1])


def count(units: list[list[str]], headings: list[list[str]], locales: list[str | None], words: Words) -> dict[str, np.ndarray]:
    """Every counter, an array over the units."""
    t = Text(units)
    n = t.n
    locales = [x or "" for x in locales]
    english = np.array([x.lower().startswith("en") for x in locales])
    lang = np.array([x[:2].lower() for x in locales])
    zero = np.zeros(n, np.int64)
    content = ~t.has(SPACE) & ~t.gap
    c_start, c_end = runs(content)

    # paragraphs: a gap with two line ends and nothing but blanks between them
    line = np.flatnonzero(t.cp == 10)
    dense = np.concatenate([[0], np.cumsum((t.cp != 32) & (t.cp != 9))])
    double = line[1:][dense[line[1:]] == dense[line[:-1] + 1]] if len(line) > 1 else line[:0]
    breaks = np.zeros(len(t.cp) + 1, np.int64)
    np.add.at(breaks, double, 1)
    breaks = np.cumsum(breaks)
    opens = np.append(True, (breaks[c_start[1:]] > breaks[c_end[:-1] - 1]) | (t.unit_at(c_start[1:]) != t.unit_at(c_start[:-1])))[: len(c_start)]
    paragraphs = t.per_unit(c_start[opens])

    # sentences
    ends = sentence_ends(t, content)
    after = c_start[np.searchsorted(c_start, ends, "right")]
    string = t.string_at(c_start)
    first_of_string = np.append(True, string[1:] != string[:-1])[: len(c_start)]
    begin = np.union1d(c_start[first_of_string], after)
    sentences = t.per_unit(begin)
    finish = c_end[np.searchsorted(c_start, np.append(begin[1:], len(t.cp)), "left") - 1] - 1 if len(begin) else begin
    inner = ~np.isin(after, c_start[opens])
    places = np.arange(len(t.cp))
    last_other = np.maximum.accumulate(np.where(t.has(PUNCT), -1, places))
    said = {}
    for name, mark in (("exclamations", "!"), ("questions", "?")):
        last_mark = np.maximum.accumulate(np.where(t.cp == ord(mark), places, -1))
        said[name] = t.per_unit(begin[last_mark[finish] > last_other[finish]])

    # words
    w_start, w_end, code, names = t.words()
    facts, w_unit = words.facts(names), t.unit_at(w_start)
    known = lambda name: facts[:, _FLAGS.index(name)][code]
    fact = lambda name: np.bincount(w_unit, known(name), n).astype(np.int64)
    of_sentence = np.searchsorted(begin, w_start, "right") - 1
    per_sentence = np.bincount(of_sentence, minlength=len(begin)) if len(begin) else np.zeros(0, np.int64)
    leads = np.append(True, of_sentence[1:] != of_sentence[:-1])[: len(of_sentence)]
    hist = {name: t.per_unit(begin[(per_sentence >= lo) & (per_sentence <= (hi if hi is not None else per_sentence.max(initial=0)))]) for name, lo, hi, _ in V.HISTOGRAM}

    # runs of ASCII word characters: contractions and passives
    a_start, a_end = runs(t.has(CODE))
    name = t.short_names(a_start, a_end)
    gap = a_start[1:] - a_end[:-1]
    apostrophe = np.isin(t.cp[np.minimum(a_end[:-1], len(t.cp) - 1)], [ord("'"), ord("’")])
    short = (gap == 1) & apostrophe & np.isin(name[1:], named(V.CONTRACTION_TAIL.split("|")))
    contracted = every_other(short, np.ones(len(short), bool))
    spaces = np.concatenate([[0], np.cumsum(t.has(SPACE))])
    apart = (gap > 0) & (spaces[a_start[1:]] - spaces[a_end[:-1]] == gap)
    be = np.flatnonzero(apart & np.isin(name[:-1], named(V.BE_VERBS.split("|"))))
    be = be[t.string_at(a_start[be]) == t.string_at(a_start[be + 1])]
    tail = a_end[be + 1]
    past = (tail - a_start[be + 1] > 2) & (t.lower[tail - 2] == ord("e")) & (t.lower[tail - 1] == ord("d"))
    be = be[past | np.isin(name[be + 1], named(V.PARTICIPLES.split("|")))]
    passive = np.unique(np.searchsorted(begin, a_start[be], "right") - 1)

    # dashes between blanks: two that share a blank are one
    blank = t.has(BLANK)
    dash = np.flatnonzero(t.cp == ord("-"))
    dash = dash[blank[dash - 1] & blank[np.minimum(dash + 1, len(blank) - 1)]]
    dash = dash[every_other(np.ones(len(dash), bool), np.append(False, np.diff(dash) == 2)[: len(dash)])]
    lists, oxford = serial_lists(t)

    # headings
    h = Text(headings)
    h_start, _, h_code, h_names = h.words()
    h_facts = words.facts(h_names)[h_code]
    of_heading = h.string_at(h_start)
    many = np.bincount(of_heading, minlength=len(h.start)) >= 2
    leading = np.append(True, of_heading[1:] != of_heading[:-1])[: len(of_heading)]
    low = (leading | (h_facts[:, _FLAGS.index("minor")] == 0)) & (h_facts[:, _FLAGS.index("upper")] == 0)
    titled = many & (np.bincount(of_heading, low, len(h.start)) == 0)

    def person(which: str) -> np.ndarray:
        return np.select([lang == x for x in ("en", "cs", "de")], [fact(f"{which}_{x}") for x in ("en", "cs", "de")], 0)

    only = lambda x: np.where(english, x, 0)
    return {
        "strings": np.array([len(u) for u in units], np.int64) if n else zero,
        "words": np.bincount(w_unit, minlength=n).astype(np.int64),
        "sentences": sentences,
        "paragraphs": paragraphs,
        "sum_word_len": np.bincount(w_unit, w_end - w_start, n).astype(np.int64),
        "sum_sent_len": t.per_unit(begin, per_sentence),
        "sum_sent_len_sq": t.per_unit(begin, per_sentence * per_sentence),
        "sum_para_sent": paragraphs + t.per_unit(ends[inner]),
        **said,
        "emoji": t.per_unit(np.flatnonzero(t.has(EMOJI))),
        "em_dash": t.per_unit(np.flatnonzero(t.cp == ord("—"))) + t.per_unit(dash),
        "semicolon": t.per_unit(np.flatnonzero(t.cp == ord(";"))),
        "first_person": person("first"),
        "second_person": person("second"),
        "headings_total": only(np.bincount(h.of_unit, many, n).astype(np.int64)),
        "headings_title_case": only(np.bincount(h.of_unit, titled, n).astype(np.int64)),
        **hist,
        "person_markers": np.isin(lang, list(V.FIRST_PERSON)),
        "has_english": english,
        "syllables": only(fact("syllables")),
        "contractions": only(t.per_unit(a_start[:-1][contracted])),
        "passive_sentences": only(t.per_unit(begin[passive])),
        "imperative_openers": only(np.bincount(w_unit[leads], known("opener")[leads], n).astype(np.int64)),
        "hedges": only(fact("hedge")),
        "intensifiers": only(fact("intensifier")),
        "oxford_lists": only(t.per_unit(lists)),
        "oxford_hits": only(t.per_unit(lists[oxford])),
        "long_words": only(fact("long")),
    }


def batch(strings: pa.Array, headings: pa.Array, locales: pa.Array, words: Words, fields: list[str]) -> pa.StructArray:
    """The counters of an Arrow batch of units, as structs of `fields`."""
    texts, heads, langs = strings.to_pylist(), headings.to_pylist(), locales.to_pylist()
    texts = [[s or "" for s in u or ()] for u in texts]
    heads = [[s or "" for s in u or ()] for u in heads]
    sizes = np.cumsum([sum(map(len, u)) for u in texts])
    out: list[dict[str, np.ndarray]] = []
    at = 0
    while at < len(texts):
        held = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, held + MOST, "right")))
        out.append(count(texts[at:to], heads[at:to], langs[at:to], words))
        at = to
    whole: Callable[[str], np.ndarray] = lambda f: np.concatenate([x[f] for x in out]) if out else np.zeros(0, np.int64)
    kinds = {"person_markers": pa.bool_(), "has_english": pa.bool_()}
    return pa.StructArray.from_arrays([pa.array(whole(f), kinds.get(f, pa.int64())) for f in fields], fields)
