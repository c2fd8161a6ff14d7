"""Word-level differences of a draft and its final text.

The longest common subsequence is a dynamic programme over one pair of texts, in an
Arrow-batched function.  A row of the table grows by 0 or 1 a column, so it is one integer
with a bit per word (bit-parallel update, exact for every length).  About sqrt(n) rows are
kept; the trace computes the rows between two of them again, so n and m words take
O(m sqrt(n)) bits of memory.  No pair is refused."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tonewright.functions import text as T
from tonewright.sources.extract import strip_frontmatter

#: Memory for the kept masks of words, in bits.
MASK_BITS = 1 << 29
CHANGES = ArrayType(StructType([StructField("type", StringType()), StructField("tokens", ArrayType(StringType()))]))


class Table:
    """Lengths of common subsequences of the first p words of `x` and the first q of `y`: bit
    q - 1 of row p is clear where the length grows at q."""

    def __init__(self, x: list[str], y: list[str]):
        self.x, self.full, self.step = x, (1 << len(y)) - 1, isqrt(len(x)) + 1
        places: dict[str, list[int]] = {}
        for q, w in enumerate(y):
            places.setdefault(w, []).append(q)

        def mask(w: str) -> int:
            bits = bytearray(len(y) // 8 + 1)
            for q in places.get(w, ()):
                bits[q >> 3] |= 1 << (q & 7)
            return int.from_bytes(bits, "little")

        self.mask = lru_cache(max(1, MASK_BITS // max(1, len(y))))(mask)
        self.kept, row = [self.full], self.full
        for at in range(0, len(x), self.step):
            for w in x[at : at + self.step]:
                row = self.next(row, w)
            self.kept.append(row)
        self.block, self.rows = -1, []

    def next(self, row: int, word: str) -> int:
        hit = row & self.mask(word)
        return (row + hit | row - hit) & self.full if hit else row

    def row(self, p: int) -> int:
        """Rows are asked for from the last to the first."""
        if p // self.step != self.block:
            self.block = p // self.step
            self.rows = [self.kept[self.block]]
            for w in self.x[self.block * self.step : (self.block + 1) * self.step - 1]:
                self.rows.append(self.next(self.rows[-1], w))
        return self.rows[p % self.step]


def steps(a: list[str], b: list[str]) -> list[tuple[str, list[str]]]:
    """Runs of equal, remove and add; where both continue as well, a removal comes first."""
    n, m, i, j = len(a), len(b), 0, 0
    out: list[tuple[str, list[str]]] = []

    def put(kind: str, word: str) -> None:
        if out and out[-1][0] == kind:
            out[-1][1].append(word)
        else:
            out.append((kind, [word]))

    while i < min(n, m) and a[i] == b[i]:
        put("equal", a[i])
        i += 1
    j = same = i
    end = 0  # words of the common end; it adds the same to all lengths before it
    while end < min(n, m) - same and a[n - 1 - end] == b[m - 1 - end]:
        end += 1
    p, q = n - end - i, m - end - j
    if p and q:
        table = Table(a[i : i + p][::-1], b[j : j + q][::-1])
        length = lambda row, k: k - (row & (1 << k) - 1).bit_count()
        here, above = table.row(p), table.row(p - 1)
        now, up = length(here, q), length(above, q)
        while p and q:
            grows = not here >> (q - 1) & 1
            equal = a[i] == b[j]
            if equal or up >= now - grows:
                put("equal" if equal else "remove", a[i])
                i, p = i + 1, p - 1
                if equal:
                    j, q = j + 1, q - 1
                if p:
                    here, above = above, table.row(p - 1)
                    now, up = length(here, q), length(above, q)
            else:
                put("add", b[j])
                now, up = now - grows, up - (not above >> (q - 1) & 1)
                j, q = j + 1, q - 1
    # one side is at the common end, which is a subsequence of the other's rest: the first match is best
    longer = n - i > m - j
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            put("equal", a[i])
            i, j = i + 1, j + 1
        elif j >= m or i < n and longer:
            put("remove", a[i])
            i += 1
        else:
            put("add", b[j])
            j += 1
    return out


@F.pandas_udf(CHANGES)
def _changes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([[{"type": k, "tokens": w} for k, w in steps(list(x), list(y))] for x, y in zip(a, b, strict=True)])


def measure(t: Column) -> dict[str, Column]:
    words, sentences = T.word_count(t), F.size(T.sentences(t)).cast("long")
    return {"words": words, "sentences": sentences, "mean_sentence_length": T.rounded(F.try_divide(words.cast("double"), sentences.cast("double")), 2)}


def diff(pairs: DataFrame, draft: str = "draft", final: str = "final") -> DataFrame:
    """Adds before_*, after_*, changes, word_swaps and the summary."""
    a, b = strip_frontmatter(F.coalesce(F.col(draft), F.lit(""))), strip_frontmatter(F.coalesce(F.col(final), F.lit("")))
    out = pairs.withColumns({f"before_{k}": c for k, c in measure(a).items()} | {f"after_{k}": c for k, c in measure(b).items()})
    out = out.withColumn("changes", _changes(T.words(a), T.words(b)))
    count = lambda kind: F.aggregate(F.filter("changes", lambda x: x["type"] == kind), F.lit(0).cast("long"), lambda s, x: s + F.size(x["tokens"]))
    single = lambda x, kind: (x["type"] == kind) & (F.size(x["tokens"]) == 1)
    following = F.slice("changes", 2, F.greatest(F.size("changes") - 1, F.lit(0)))
    pair = F.filter(F.zip_with(F.slice("changes", 1, F.greatest(F.size("changes") - 1, F.lit(0))), following, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), lambda p: single(p["a"], "remove") & single(p["b"], "add"))
    swaps = F.transform(pair, lambda p: F.struct(p["a"]["tokens"][0].alias("from"), p["b"]["tokens"][0].alias("to")))
    delta = F.col("after_words") - F.col("before_words")
    return out.withColumns({"word_swaps": swaps, "added": count("add"), "removed": count("remove"), "unchanged": count("equal"), "word_delta": delta, "word_delta_pct": T.rounded(F.try_divide(delta * 100.0, F.col("before_words").cast("double")), 2)})

