"""Vectorised word and n-gram hashes over Arrow string batches, and group-wise streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH = 0xD6E8FEB86659FD93
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_VALUE = _LOWER.astype(U) + U(1)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def chunks(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of stretches of about `most` bytes; a longer text is one stretch."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray, most: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, in order.  Long texts
    are gone through in stretches of about `most` bytes, cut between words."""
    n = len(data)
    if n <= 2 * most:
        return _stretch(data, offsets)
    words, rows, at = [], [], 0
    while at < n:
        to = min(n, at + most)
        # the cut: a start of a row or a blank
        row = int(np.searchsorted(offsets, to, "right")) - 1
        if to < n and offsets[row] != to:
            blank = np.flatnonzero(_WHITE[data[max(at, int(offsets[row])) : to]])
            if len(blank):
                to = max(at, int(offsets[row])) + int(blank[-1]) + 1
            elif offsets[row] > at:
                to = int(offsets[row])
            else:  # one word fills the stretch: it ends at the next blank, or its row
                end = int(offsets[row + 1])
                while to < end and not (blank := np.flatnonzero(_WHITE[data[to : min(end, to + most)]])).size:
                    to = min(end, to + most)
                to = to + int(blank[0]) if to < end else end
                words.append(mix(np.array([_long_word(data[at:to], most)], U)))
                rows.append(np.array([row]))
                at = to
                continue
        inner = offsets[(offsets > at) & (offsets < to)]
        h, r = _stretch(data[at:to], np.concatenate([[0], inner - at, [to - at]]))
        words.append(h)
        rows.append(np.searchsorted(offsets, np.concatenate([[at], inner]), "right")[r] - 1)
        at = to
    return np.concatenate(words), np.concatenate(rows)


def _long_word(data: np.ndarray, most: int) -> int:
    """The hash, before mixing, of one word of any length."""
    power, _ = _tables(most)
    total = 0
    for at in range(0, len(data), most):
        piece = _VALUE[data[at : at + most]]
        total += int((piece * power[: len(piece)]).sum(dtype=U)) * pow(_BASE, at, 1 << 64)
    return (total + (len(data) - 1) * _LENGTH) % (1 << 64)


def _stretch(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    inside = ~_WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    power, inverse = _tables(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(_VALUE[data] * power[:n], out=total[1:])
    h = (total[end + 1] - total[start]) * inverse[start]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return mix(h + (end - start).astype(U) * U(_LENGTH)), row


def rolled(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `n` words, by its first word, and whether it lies within a row."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    if n == 1:
        return h, np.ones(m, bool)
    out = np.zeros(m, U)
    for k in range(n):
        out = (out + h[k : k + m]) * U(_BASE)
    return mix(out + U(n)), row[:m] == row[n - 1 :]


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of `n` words within a row; the k-th is the one that starts at
    the k-th word that has n - 1 followers."""
    out, ok = rolled(h, row, n)
    return out[ok], row[: len(ok)][ok]


def by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of rows with equal values in the first `keys` columns, of a stream sorted by
    them.  Only the open group is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in batch.columns[:keys]:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        first = tuple(c[0].as_py() for c in batch.columns[:keys])
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if held and (k or first != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[batch.num_rows - 1].as_py() for c in batch.columns[:keys])
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find; `join` tells whether it linked two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class Names:
    """Union-find over 64-bit names, the least of a set being its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def __len__(self) -> int:
        return len(self.up)

    def find(self, a: int) -> int:
        up = self.up
        while (b := up.setdefault(a, a)) != a:
            up[a] = a = up[b]
        return a

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for k in np.flatnonzero(a != b).tolist():
            x, y = self.find(int(a[k])), self.find(int(b[k]))
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def roots(self, a: np.ndarray) -> np.ndarray:
        return np.array([self.find(x) if x in self.up else x for x in a.tolist()], np.int64)

    def stars(self) -> np.ndarray:
        """An edge (root, name) for every name that is no root."""
        out = [(r, x) for x in list(self.up) if (r := self.find(x)) != x]
        return np.array(out, np.int64).reshape(-1, 2)

    def trees(self) -> np.ndarray:
        """`stars`, and an edge (root, root) for every root."""
        out = [(self.find(x), x) for x in list(self.up)]
        return np.array(out, np.int64).reshape(-1, 2)
