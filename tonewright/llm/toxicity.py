"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, reported speech or other.  Three
sequential transducers mark insults and threats that are negated, reported, or aimed at a
target in the same clause; they are composed into one machine, which reads each clause
that holds an insult or a threat.  An output symbol is a kind with its marks, and every
output has a weight of its own: a negated or reported insult scores by what the labels say
about those, not as the bare word.  A text's score is the logistic of the weights of its
matched clauses.

Trained on labelled rows: the insult lexicon (whole words and word beginnings that stand
in toxic texts far more often than in others, so that any language is covered) and the
weights of the outputs.  `SAMPLE_ROWS` bounds the labelled rows used; the lexicon is
learned on two thirds of them and the weights on the rest.

Defined results: null or empty text scores as a text without a match; no labels at all
leave the seed lexicon with its default weights; equal texts score alike; other columns
are not inputs and pass through, whatever their names, but for the score's, which is
replaced; null ids are not learned from and are scored; repeated rows are scored each; texts
of any length are read whole; an empty table gives no rows.  A row is one text, nothing is
shuffled when scoring.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.llm.learning import labelled_sample, logistic, sigmoid
from tonewright.llm.shared import discard

SAMPLE_ROWS = 12_000
#: Seeds in the languages of the corpus.
INSULTS = "idiot moron loser scum trash stupid pathetic worthless disgusting clown imbecile idiota imbécil basura estúpido dummkopf abschaum trottel idioten ordure crétin imbécile connard".split()
THREATS = "kill hurt destroy murder strangle töten umbringen vernichten tuer frapper détruire matar destruir golpear".split()
TARGETS = "you your yourself he she they them du dich dein ihr euch tu toi vous elle ils tú usted ustedes ellos".split()
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = "said says wrote claimed called quoted reported sagte schrieb behauptete dit écrit déclaré dijo escribió".split()

KINDS = ("insult", "threat")
MARKS = ("negated", "reported", "aimed")
OUTPUTS = [(k, *m) for k in KINDS for n in range(4) for m in combinations(MARKS, n)]
#: Weights before any labels are seen, per output: a bare insult speaks for toxicity, marks change that.
DEFAULT = {o: 5.0 + ("aimed" in o) - 4.0 * ("negated" in o) - 3.0 * ("reported" in o) for o in OUTPUTS}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]")
Symbol = tuple[str, ...]


@dataclass
class Transducer:
    """Sequential: (state, symbol) to (state, symbol); the first state is `start`."""

    start: object
    arc: Callable[[object, Symbol], tuple[object, Symbol]]


def scope(opener: str, mark: str, length: int | None) -> Transducer:
    """Marks insults and threats within `length` words after `opener` (None: to the clause's end)."""
    full = -1 if length is None else length

    def arc(state, symbol):
        if symbol[0] == opener:
            return full, symbol
        out = (*symbol, mark) if state and symbol[0] in KINDS else symbol
        return (state if state < 0 else max(0, state - 1)), out

    return Transducer(0, arc)


@dataclass
class Machine:
    """The composition of transducers as a table over its reachable states."""

    table: dict[tuple[int, Symbol], tuple[int, Symbol]] = field(default_factory=dict)

    @classmethod
    def compose(cls, parts: list[Transducer], alphabet: Iterable[Symbol]) -> Machine:
        alphabet = list(alphabet)
        start = tuple(t.start for t in parts)
        ids, todo, out = {start: 0}, [start], cls()
        while todo:
            states = todo.pop()
            for symbol in alphabet:
                nxt, written = [], symbol
                for t, s in zip(parts, states, strict=True):
                    s, written = t.arc(s, written)
                    nxt.append(s)
                key = tuple(nxt)
                if key not in ids:
                    ids[key] = len(ids)
                    todo.append(key)
                out.table[ids[states], symbol] = (ids[key], written)
        return out

    def run(self, symbols: Iterable[Symbol]) -> Iterator[Symbol]:
        state = 0
        for s in symbols:
            state, written = self.table[state, s]
            yield written


def grammar() -> Machine:
    parts = [scope("negation", "negated", 3), scope("report", "reported", None), scope("target", "aimed", 4)]
    return Machine.compose(parts, [(x,) for x in (*KINDS, "target", "negation", "report", "other")])


class Scanner:
    """Matched clauses of a text under a lexicon: whole words ``=w`` and beginnings ``w``, each with a strength."""

    def __init__(self, lexicon: dict[str, float]):
        self.machine = grammar()
        self.fixed: dict[str, Symbol] = {}
        for kind, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("threat", THREATS)):
            self.fixed |= dict.fromkeys(words, (kind,))
        self.whole = {u[1:]: w for u, w in lexicon.items() if u[0] == "="}
        self.start = {u: w for u, w in lexicon.items() if u[0] != "="}
        self.longest = max(map(len, self.start), default=0)
        self.find = ahocorasick.Automaton()
        for u in {*self.whole, *self.start, *THREATS}:
            self.find.add_word(u, len(u))
        self.find.make_automaton()

    def symbol(self, word: str) -> tuple[Symbol, float]:
        strength = self.whole.get(word, 0.0)
        for n in range(1, min(len(word), self.longest) + 1):
            strength = max(strength, self.start.get(word[:n], 0.0))
        if strength:
            return ("insult",), strength
        return self.fixed.get(word, ("other",)), 1.0

    def clauses(self, text: str) -> Iterator[list[tuple[Symbol, float]]]:
        """Per clause with a match, its outputs and their strengths."""
        low, done = text.lower(), 0
        for end, size in self.find.iter(low):
            start = end - size + 1
            if start < done or (start and low[start - 1].isalpha()):
                continue
            first = max((m + 1 for m in (low.rfind(c, done, start) for c in ".!?;:\n") if m >= 0), default=done)
            stop = _CLAUSE_END.search(low, end + 1)
            last = stop.start() if stop else len(low)
            read = [self.symbol(m[0].replace("’", "'")) for m in _WORD.finditer(low, first, last)]
            done = last
            if any(s[0] in KINDS for s, _ in read):
                yield [(out, w) for out, (_, w) in zip(self.machine.run(s for s, _ in read), read, strict=True) if out[0] in KINDS]

    def features(self, text: str) -> np.ndarray:
        x = np.zeros(len(OUTPUTS))
        for clause in self.clauses(text):
            for out, strength in clause:
                x[_COLUMN[out]] += strength
        return np.log1p(x)


_COLUMN = {o: k for k, o in enumerate(OUTPUTS)}


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray

    def score(self, texts: list[str], scanner: Scanner | None = None) -> np.ndarray:
        scanner = scanner or Scanner(self.lexicon)
        x = np.array([scanner.features(t or "") for t in texts]).reshape(-1, len(OUTPUTS))
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def units(text: str, shortest: int = 4, longest: int = 8) -> set[str]:
    """Whole words and word beginnings of `shortest` to `longest` letters."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.add("=" + w)
        out.update(w[:n] for n in range(shortest, min(longest, len(w)) + 1))
    return out


def _least_shingle(text: str) -> int:
    w = text.lower().split()
    return min((xxhash.xxh3_64_intdigest(" ".join(w[i : i + 3])) >> 1 for i in range(max(1, len(w) - 2))), default=0)


def seeds() -> dict[str, float]:
    return {"=" + w: 1.0 for w in INSULTS}


def learn_lexicon(sample: DataFrame, min_docs: int = 6, min_precision: float = 0.8) -> dict[str, float]:
    """Units of toxic texts with a precision of `min_precision` or more: all of them, as many as
    the bounded sample has.  Texts with the same least three-word hash count once, so that
    a group of copies does not make its words toxic."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush():
            rows = [(u, y, n) for y in held for u, n in held[y].items()]
            for c in held.values():
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["unit", "y", "n"])

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[1 if y else 0].update(units(text or ""))
                if sum(map(len, held.values())) > 400_000:
                    yield flush()
        yield flush()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = [_least_shingle(t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.int64())], names=["text", "y", "least"])

    once = sample.select("text", "y").mapInArrow(sketch, "text string, y int, least long").groupBy("least").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y")).select("text", "y")
    n = {int(r.y): r.n for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return seeds()
    odds = (F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (clean + 1))
    strong = (
        once.mapInArrow(count, "unit string, y long, n long")
        .groupBy("unit")
        .agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
        .where((F.col("t") >= min_docs) & (F.col("t") >= min_precision * (F.col("t") + F.col("c"))))
        .withColumn("odds", F.log(odds))
        .where("odds > 2")
    )
    found = {r.unit: min(2.0, r.odds / 3) for r in strong.collect()}
    # a word or beginning that a shorter beginning already covers adds nothing
    short = {u for u in found if u[0] != "="}
    return seeds() | {u: w for u, w in found.items() if not any(u.lstrip("=")[:k] in short for k in range(1, len(u.lstrip("=")) + (u[0] == "=")))}


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """`keep` is a condition on the rows of `labels` that may be learned from."""
    sample = labelled_sample(docs, labels, "toxic", rows, keep, id_col, text_col)
    third = F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(3)) == 0
    lexicon = learn_lexicon(sample.where(~third))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for b in batches:
            x = [scanner.features(t or "").tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    rows_ = sample.where(third).select("text", "y").mapInArrow(measure, "x array<double>, y int").collect()
    discard(sample)
    prior = np.array([*(DEFAULT[o] for o in OUTPUTS), -3.0])
    y = np.array([r.y for r in rows_], dtype=float)
    if len(set(y.tolist())) < 2:
        return Model(lexicon, prior)
    x = np.array([r.x for r in rows_])
    w = logistic(x, y, ridge=0.5)
    # outputs too rare to learn (under five texts) follow the plain output of their kind
    for k, o in enumerate(OUTPUTS):
        if (x[:, k] > 0).sum() < 5:
            w[k] = w[_COLUMN[("insult",)]] * max(DEFAULT[o], 0.5) / DEFAULT[("insult",)]
    return Model(lexicon, w)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """`docs` with a score column (replaced if present)."""
    keep = [c for c in docs.columns if c != score_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"`{score_col}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.lexicon)
        for b in batches:
            score = model.score(b.column(b.schema.get_field_index(text_col)).to_pylist(), scanner)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(score, pa.float64())], names=[*keep, score_col])

    return docs.select(*keep).mapInArrow(run, schema)
