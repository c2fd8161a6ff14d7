"""Spelling variants of a vocabulary: words one edit apart, grouped under the common form.

1. Words are counted: texts become Arrow arrays of runs, equal runs of a stretch are one entry
   of a dictionary, and only (word, count) rows leave a task.
2. Rolling-hash deletions: prefix and suffix polynomial hashes of every word give, for each
   code point, the hash of the word without it, in integer arithmetic over all words at once.
   Words that differ by one replaced code point share the deletion at its place; a word with
   one code point more shares a deletion with the whole shorter word.
3. Keys are dealt by their leading bits (radix) and sorted within each part; equal keys lie
   together, and strings decide whether they are more than a collision of hashes.
4. Each group is answered by counts and its two most frequent members, so no pair is written.
   Every near pair meets in exactly one group: a replacement in that of its place, an
   insertion at the first code point of the run of equal ones it lengthens.
5. Words follow their forms to the last by pointer jumping; each step multiplies the count by
   `ratio` or more, so chains are as long as the logarithm of the largest count.

Bounds: a group of one deletion at one place has as many words as there are letters (90), so
no group grows with the corpus.  A word has a row per code point and each carries the word;
words over `LONG` code points travel as digests instead, and the pairs that their keys give
are verified by joining the strings, so that rows stay as small as code points are many.

Defined results: null and empty texts have no words; a null id is the empty string before the
colon; repeated rows count each; ties of n go to the smallest word in code-point order; an
empty table gives no rows; other columns are not read, whatever their names; ids of any type
are taken as Spark prints them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.hashing import U, chunks, mix
from tonewright.llm.shared import discard, stored

#: Fixed values of the word definition: letters, and how often a code point is taken out.
LETTERS, EVERY = "[A-Za-zÀ-ÿ]+", 31
#: Code points from which on the rows of a word do not carry it.
LONG = 64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and one more


@lru_cache(maxsize=4096)
def _shift(length: int) -> np.ndarray:
    """Tables (4, 256) that carry a crc32 over `length` bytes more: crc(a + b) is the carried
    crc(a), xor crc(b).  Carrying is linear over bits, so each byte of a crc is looked up."""
    zeros = bytes(length)
    base = zlib.crc32(zeros)
    bit = np.array([zlib.crc32(zeros, 1 << k) ^ base for k in range(32)], np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for k in range(32):
        out[k // 8, (np.arange(256) >> (k % 8)) & 1 == 1] ^= bit[k]
    return out


def runs(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The runs of `least` code points or more, lower-cased, with their bytes' lengths and rows."""
    inside = _ASCII[data]
    lead = data == _LEAD
    inside |= lead
    inside[1:] |= lead[:-1]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    leads = np.concatenate([np.zeros(1, np.int32), np.cumsum(lead, dtype=np.int32)])
    keep = (end - start) - (leads[end] - leads[start]) >= least
    start, end = start[keep], end[keep]
    row = np.searchsorted(offsets, start, "right") - 1
    # bytes of the kept runs, side by side: the values of an Arrow array
    mark = np.zeros(n + 1, np.int8)
    np.add.at(mark, start, 1)
    np.subtract.at(mark, end, 1)
    values = _LOWER[data[np.cumsum(mark[:-1], dtype=np.int8) > 0]]
    lengths = end - start
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(values))
    return words, lengths, row


def word_counts(ids: list[str], data: np.ndarray, offsets: np.ndarray, least: int) -> pa.Table:
    """word, n of a stretch of texts; `ids` are the texts' ids as strings.  A run loses a code
    point where crc32 of "<id>:<run>" divides by 31."""
    words, lengths, row = runs(data, offsets, least)
    if not len(words):
        return pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    coded = words.dictionary_encode()
    code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    own = np.array([zlib.crc32(w.encode()) for w in names], np.uint32)
    before = np.array([zlib.crc32(f"{k}:".encode()) for k in ids], np.uint32)[row]
    h = own[code]
    for length in np.unique(lengths).tolist():
        mine = lengths == length
        t, c = _shift(length), before[mine]
        h[mine] ^= t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]
    cut = h % EVERY == 0
    n = np.bincount(code[~cut], minlength=len(names))
    out, times = [w for w, k in zip(names, n.tolist(), strict=True) if k], n[n > 0].tolist()
    for k, x in zip(code[cut].tolist(), h[cut].tolist(), strict=True):
        w = names[k]
        at = x % len(w)
        if len(w) > least:
            out.append(w[:at] + w[at + 1 :])
            times.append(1)
    return pa.table({"word": pa.array(out, pa.string()), "n": pa.array(times, pa.int64())}).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of the texts with `least_length` code points and `least_count` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, data, offsets in chunks(b.column(1), 4 << 20):
                held.append(word_counts([i or "" for i in ids[at : at + len(offsets) - 1]], data, offsets, least_length))
                if sum(t.num_rows for t in held) > 400_000:  # counts of a task meet before they travel
                    held = [pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])]
                    if held[0].num_rows > 200_000:
                        yield from held.pop().to_batches(20_000)
        if held:
            yield from pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches(20_000)

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def deletion_keys(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and of each word without each of its code points.  `points` are the
    words' code points side by side.  With prefix hash P and suffix hash S, the word without
    place i is P[i] * base ** (letters after i) + S[i + 1]."""
    m = len(points)
    if not m:
        return np.zeros(len(offsets) - 1, U), np.zeros(0, U)
    lengths = np.diff(offsets)
    word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(m) - offsets[word]
    value = mix(points.astype(U) + U(1))
    power = np.full(int(lengths.max()) + 1, _BASE, U)
    power[0] = 1
    power = np.cumprod(power)
    after = lengths[word] - 1 - place
    # suffix sums of value * base ** after, from sums over the whole array
    sums = np.concatenate([np.zeros(1, U), np.cumsum(value * power[after])])
    total = sums[offsets[1:]] - sums[offsets[:-1]]
    suffix = sums[offsets[1:]][word] - sums[1:]
    # a prefix without its suffix weighs one power more than the shortened word needs
    prefix = _prefix(value, place, word, offsets)
    gone = prefix * power[after] + suffix
    return mix(total + lengths.astype(U)), mix(gone + (lengths[word] - 1).astype(U))


def _prefix(value: np.ndarray, place: np.ndarray, word: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of the code points before each place, by place: P[i + 1] = P[i] * base + value[i]."""
    out = np.zeros(len(value), U)
    lengths = np.diff(offsets)
    alive = np.flatnonzero(lengths > 1)
    for i in range(1, int(lengths.max())):
        alive = alive[lengths[alive] > i]
        at = offsets[alive] + i
        out[at] = out[at - 1] * _BASE + value[at - 1]
    return out


def keys_of(words: pa.Array, *more: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows key, place and `more`, for the whole word (place -1) and each deletion's place."""
    flat = words.cast(pa.large_string())
    at = 0
    lengths = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    while at < len(flat):
        # about 200,000 code points at a time
        to = max(at + 1, at + int(np.searchsorted(np.cumsum(lengths[at:]), 200_000, "right")))
        part, size = flat.slice(at, to - at), lengths[at:to]
        points = np.frombuffer("".join(part.to_pylist()).encode("utf-32-le"), "<u4")
        offsets = np.concatenate([[0], np.cumsum(size)])
        whole, gone = deletion_keys(points, offsets)
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(points)) - offsets[word]
        take = pa.array(np.concatenate([np.arange(len(size)), word]))
        key, where = np.concatenate([whole, gone]).view(np.int64), np.concatenate([np.full(len(size), -1), place]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(where), *(m.slice(at, to - at).take(take) for m in more)], names=["key", "place", *(f"c{k}" for k in range(len(more)))])
        at = to


def near_in_group(members: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words here, count of the most frequent, that word) for members (place, word,
    n) of one deletion: those of one place replace each other's code point; the whole word
    (place -1) is near to each longer one, which counts once, at its first such place."""
    whole = [(w, n) for p, w, n in members if p < 0]
    at: dict[int, list[tuple[int, str]]] = {}
    for p, w, n in members:
        if p >= 0:
            at.setdefault(p, []).append((-n, w))
    for here in at.values():
        if len(here) > 1:
            here.sort()
            for x in here:
                n, w = here[1] if x == here[0] else here[0]
                yield x[1], len(here) - 1, -n, w
    if whole and at:
        short, n_short = whole[0]
        longer = sorted({(n, w) for p, here in at.items() for n, w in here if not p or w[p - 1] != w[p]})
        yield short, len(longer), -longer[0][0], longer[0][1]
        for _, w in longer:
            yield w, 1, n_short, short


def near_words(words: DataFrame, parts: int) -> DataFrame:
    """word, n_near, best (negative count and word of the most frequent near word)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in keys_of(b.column(0), b.column(0), b.column(1)):
                yield rows.rename_columns(["key", "place", "word", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in _with_end(batches):
            if b is not None:
                t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
                key = t.column("key").to_numpy()
                # the last key may go on in the next batch
                done = int(np.searchsorted(key, key[-1], "left"))
                held, t, key = t.slice(done), t.slice(0, done), key[:done]
            elif held is not None:
                t, key = held, held.column("key").to_numpy()
            else:
                return
            if len(key) < 2:
                continue
            same = key[1:] == key[:-1]
            shared = np.append(same, False) | np.append(False, same)
            if not shared.any():
                continue
            t = t.filter(pa.array(shared))
            out: list[tuple[str, int, int, str]] = []
            groups: dict[tuple[int, str], list[tuple[int, str, int]]] = {}
            # keys bring them together; the strings decide
            for k, p, w, n in zip(t.column("key").to_pylist(), t.column("place").to_pylist(), t.column("word").to_pylist(), t.column("n").to_pylist(), strict=True):
                groups.setdefault((k, w if p < 0 else w[:p] + w[p + 1 :]), []).append((p, w, n))
            for members in groups.values():
                if len(members) > 1:
                    out.extend(near_in_group(members))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out])], names=["word", "n_near", "best_n", "best"])

    rows = words.where(F.length("word") <= LONG).select("word", "n").mapInArrow(explode, "key long, place int, word string, n long")
    radix = F.shiftrightunsigned("key", 48)
    met = rows.repartition(parts, radix).sortWithinPartitions("key").mapInArrow(meet, "word string, n_near long, best_n long, best string")
    met = met.unionByName(_near_long(words.where(F.length("word") >= LONG)))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form"))).alias("best"))


def _near_long(words: DataFrame) -> DataFrame:
    """The same for pairs of which one word at least is over `LONG` code points."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in keys_of(b.column(0), b.column(1)):
                yield rows.rename_columns(["key", "place", "digest"])

    named = words.select("word", "n", F.sha2("word", 256).alias("digest"))
    keys = named.select("word", "digest").mapInArrow(explode, "key long, place int, digest string")
    one, two = keys.where("place >= 0"), keys.select("key", F.col("place").alias("at"), F.col("digest").alias("other"))
    pairs = one.join(two, "key").where("digest <> other and (at < 0 or at = place and digest < other)").select("digest", "other", "place", "at")
    a, b = (named.select(F.col("digest").alias(d), F.col("word").alias(w), F.col("n").alias(n)) for d, w, n in (("digest", "a", "na"), ("other", "b", "nb")))
    without = lambda w: F.concat(F.expr(f"substring({w}, 1, place)"), F.expr(f"substring({w}, place + 2)"))
    first = F.expr("place = 0 or substring(a, place, 1) <> substring(a, place + 1, 1)")
    real = F.when(F.col("at") < 0, first & (without("a") == F.col("b"))).otherwise(without("a") == without("b"))
    met = pairs.join(a, "digest").join(b, "other").where((F.greatest(F.length("a"), F.length("b")) > LONG) & real)
    both = met.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("nb").alias("best_n"), F.col("b").alias("best")), F.struct(F.col("b").alias("word"), F.col("na").alias("best_n"), F.col("a").alias("best")))).alias("p"))
    return both.select("p.word", F.lit(1).cast("long").alias("n_near"), "p.best_n", "p.best")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form: each word followed to the last form, by pointer jumping."""
    # the words that a step goes on from are few: those that are a form and have one
    at = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("on"))
        after = stored(at.join(step, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "forms")
        discard(at)
        at = after.drop("moved")
        at._scratch = after._scratch
        if not after.where("moved").limit(1).count():
            return at


def spelling_groups(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = stored(vocabulary(docs, least_length, least_count, id_col, text_col), "vocabulary")
    near = near_words(words, parts).withColumnRenamed("word", "of")
    form_n = -F.col("best.less")
    real = form_n >= ratio * F.col("n")
    named = words.join(near, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(real, F.col("best.form")).alias("form"), F.when(real, form_n).alias("form_n")
    )
    named = stored(named, "forms")
    discard(words)
    last = roots(named.where("form is not null").select("word", "form")).select(F.col("word").alias("of"), "root")
    return named.join(last, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def plain_words(text: str | None) -> list[str]:
    """The runs of one text, lower-cased, by the definition; for tests and small lookups."""
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(LETTERS, text or "")]
