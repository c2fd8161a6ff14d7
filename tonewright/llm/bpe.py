"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens.  It starts as one state with an arc for every byte.
Each merge ``(u, v) -> w`` applies one gadget: wherever ``u`` leads from state p to
state q and ``v`` leads from q to s, an arc ``w`` is added from p to s, and the state
that ``u`` reaches loses its arc ``v``.  After the last gadget a token sequence is
accepted exactly if it is the BPE encoding of the bytes it spells.

A state of the finished automaton is "the last token read", so it is kept in two
tables instead of 50,000 x 50,000 arcs:

* ``right[t]``: the states whose lost arcs token ``t`` inherits (its right spine),
  each with the rank before which an arc had to be lost to be inherited;
* ``left[t]``: the tokens through which the arc ``t`` was built (its left spine),
  each with the rank up to which losing that arc prevents ``t``.

``allowed(p, t)`` joins the two.  For encoding, the token automaton is determinised
over bytes (a byte trie holds the arc labels): a table state is the set of half-read
arcs, and the table fills as texts need it.  A pre-split word is one walk through the
table; exactly one accepted path ends it.  Decoding emits the byte labels of the arcs.

Defined results: null or empty text gives no ids and decodes to ''.  Ids outside the
vocabulary raise ``KeyError``.  Equal texts give equal ids.  Text length is unbounded;
work is linear in it because token length is bounded.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import accumulate
from operator import getitem

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.shared import unused

#: Words and table states kept per Python worker; a full table is emptied, results do not change.
CACHE_WORDS, CACHE_STATES = 300_000, 150_000
_STOPS = frozenset(".,;:!?|&%$#*)")
_AUTOMATA: dict[str, Automaton] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


def _char_class(kind: str, last: int) -> str:
    """A regex class body of the code points to `last` whose general category starts with `kind`."""
    parts, start = [], None
    for cp in range(last + 2):
        inside = cp <= last and unicodedata.category(chr(cp))[0] == kind
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            parts.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return "".join(parts)


#: Unicode White_Space, as fixed by the standard.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def presplit_pattern(last: int = sys.maxunicode) -> re.Pattern[str]:
    """The split before the merges, for texts without code points over `last`."""
    letter, number = _char_class("L", last), _char_class("N", last)
    return re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{WHITE}{letter}{number}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
    )


class _State(dict):
    """A state of the byte-level table: the half-read arcs (trie state, state they start
    from), longest first, and the arc that ends here; transitions are added when first taken."""

    __slots__ = ("half", "size", "table", "token")

    def __init__(self, table: _Table, half: tuple, token: int):
        self.table, self.half, self.token = table, half, token
        self.size = len(table.auto.label[token]) if token >= 0 else 0

    def __missing__(self, byte: int) -> _State:
        auto, live, token = self.table.auto, [], -1
        for s, p in self.half:
            nxt = auto.step[s].get(byte)
            if nxt is None:
                continue
            t = auto.accept[nxt]
            if t >= 0 and token < 0 and (p < 0 or auto.allowed(p, t)):
                token = t
            if auto.step[nxt]:
                live.append((nxt, p))
        if token >= 0:
            live.append((0, token))
        self[byte] = to = self.table.state(tuple(live), token)
        return to


class _Table:
    def __init__(self, auto: Automaton):
        self.auto, self.known = auto, {}
        self.start = _State(self, ((0, -1),), -1)

    @property
    def count(self) -> int:
        return len(self.known)

    def state(self, half: tuple, token: int) -> _State:
        key = (half, token)
        if key not in self.known:
            self.known[key] = _State(self, half, token)
        return self.known[key]


class _Spaced(dict):
    """Ids of the pre-split words between two spaces, with the space before them."""

    def __init__(self, auto: Automaton):
        self.auto = auto

    def __missing__(self, w: str) -> bytes:
        if w.isalpha():
            ids = self.auto._run(" " + w, whole=True)
        elif w[:-1].isalpha() and w[-1] in _STOPS:  # two pre-split words
            ids = self[w[:-1]] + self.auto._run(w[-1], whole=True)
        else:
            ids = self.auto._run(" " + w)
        if len(w) < 64:
            self[w] = ids
        return ids


class Automaton:
    def __init__(self, spec: bytes):
        model = json.loads(spec)
        alphabet = byte_alphabet()
        vocab: dict[str, int] = model["model"]["vocab"]
        self.label = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        for content, i in self.special.items():
            self.label[i] = content.encode()
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.merge: dict[int, int] = {}
        self.right: dict[int, tuple[tuple[int, int], ...]] = {}
        self.left: dict[int, tuple[tuple[int, int], ...]] = {}
        self.pattern, self.pattern_bmp = presplit_pattern(), presplit_pattern(0xFFFF)
        self._compile(vocab, model["model"]["merges"], alphabet)
        self._trie()
        self.size = {t: len(x) for t, x in self.label.items()}
        self.spaced = _Spaced(self)
        self.loose = re.compile(f" (?=[{WHITE}]|\\Z)")
        self.table = _Table(self)

    def _compile(self, vocab: dict[str, int], merges: list, alphabet: dict[str, int]) -> None:
        never = len(merges) + 1
        for c in alphabet:
            if c in vocab:
                t = vocab[c]
                self.right[t] = self.left[t] = ((t, never),)
        for rank, m in enumerate(merges):
            a, b = m if isinstance(m, (list, tuple)) else m.split(" ")
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            self.merge[u << 32 | v] = rank
            if w in self.right:  # a second way to build the same token is never reached
                continue
            # the state that w reaches loses what v's state has lost by now, and later its own
            self.right[w] = ((w, never), *((t, min(r, rank)) for t, r in self.right[v]))
            # the arc w exists where the arc u existed when w was built
            self.left[w] = ((w, never), *((t, min(r, rank)) for t, r in self.left[u]))

    def _trie(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.accept: list[int] = [-1]
        for t in self.right:
            s = 0
            for byte in self.label[t]:
                nxt = self.step[s].get(byte)
                if nxt is None:
                    nxt = len(self.step)
                    self.step[s][byte] = nxt
                    self.step.append({})
                    self.accept.append(-1)
                s = nxt
            self.accept[s] = t

    def allowed(self, p: int, t: int) -> bool:
        """Whether the state reached by token `p` still has an arc `t`."""
        merge = self.merge
        for u, before in self.right[p]:
            for v, until in self.left[t]:
                rank = merge.get(u << 32 | v)
                # on a tie the leftmost of two equal merges is applied
                if rank is not None and rank < before and rank <= until:
                    return False
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """The one accepted path over `word`, by transitions of the byte-level table."""
        if self.table.count > CACHE_STATES:
            self.table = _Table(self)
        seen = list(accumulate(word, getitem, initial=self.table.start))
        out, n = [], len(word)
        while n:
            state = seen[n]
            if state.token < 0:
                raise ValueError("a byte is not in the vocabulary")
            out.append(state.token)
            n -= state.size
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special_re is None or not self.special_re.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out.append(self._plain(text[at : m.start()]))
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _split(self, text: str) -> list[str]:
        return (self.pattern_bmp if max(text, default="") < "\U00010000" else self.pattern).findall(text)

    def _run(self, text: str, whole: bool = False) -> bytes:
        """`whole`: the text is one pre-split word."""
        ids: list[int] = []
        for w in (text,) if whole else self._split(text):
            ids += self.encode_word(w.encode("utf-8", "surrogatepass"))
        a = array("I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.loose.search(text):
            return self._run(text)
        # No space stands before white space or the end, so every space begins a
        # pre-split word and the pieces between spaces can be encoded on their own.
        first, *rest = text.split(" ")
        spaced = self.spaced
        if len(spaced) > CACHE_WORDS:
            spaced.clear()
        return self._run(first) + b"".join([spaced[w] for w in rest])

    def decode(self, ids: bytes) -> str:
        a = array("I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return b"".join([self.label[i] for i in a]).decode("utf-8", "replace")


def automaton(spec: bytes) -> Automaton:
    """The automaton of a tokenizer file's bytes, compiled once per process."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _AUTOMATA:
        _AUTOMATA[key] = Automaton(spec)
        gc.collect()
        gc.freeze()  # the tables hold no cycles to look for
    return _AUTOMATA[key]


def read_spec(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", tokens_col: str = "n_tokens", digest_only: bool = False) -> DataFrame:
    """Adds the token ids (binary, little-endian unsigned 32-bit) and their number.

    With `digest_only` the ids and the decoded text are not returned but hashed, as
    ``ids_sha256`` and ``decoded_sha256``.  Columns of `docs` with the names of new
    columns are replaced.  The tokenizer file (a few MB, fixed) is shipped once.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    new = [tokens_col, "ids_sha256", "decoded_sha256"] if digest_only else [tokens_col, ids_col]
    keep = [c for c in docs.columns if c not in new and not (digest_only and c == text_col)]
    hidden = unused(docs, "text")
    src = docs.select(*keep, F.col(text_col).alias(hidden))
    kinds = {tokens_col: "long", ids_col: "binary", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"`{c}` {kinds[c]}" for c in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(spec.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(hidden))
            for at in range(0, max(batch.num_rows, 1), 1000):
                part = batch.slice(at, 1000)
                ids = [auto.encode(t or "") for t in texts.slice(at, 1000).to_pylist()]
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                cols.append(pa.array([len(x) // 4 for x in ids], pa.int64()))
                if digest_only:
                    cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()))
                    cols.append(pa.array([hashlib.sha256(auto.decode(x).encode("utf-8", "replace")).hexdigest() for x in ids], pa.string()))
                else:
                    cols.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *new])

    return src.mapInArrow(run, schema)
