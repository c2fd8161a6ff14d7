"""Stupid-backoff scores of documents under an n-gram model of a whole corpus.

The score of a word after its history is count(n-gram) / count(history) where the n-gram of
the highest order occurs in the corpus, else `alpha` times the score at the next lower
order; words fall back to count / corpus size.  Every n-gram counts, once-seen ones too.

`backoff_scores` without a corpus scores documents under their own counts.  Then every
n-gram that a text holds has a count, so a text's sum needs the counts of two orders only:
the full order and its histories (the first words' lower orders telescope to the count of
the first history).  Rows are exploded n-grams (history, n-gram, document), hash-partitioned
by history, once.  On that partitioning the two count tables, of n-grams and of histories,
are built and each is joined to the exploded rows (as hash joins where a part of the table is
known to be small, else as merges), and the logarithms are summed per document.

With a `corpus` of its own the tables of all orders are counted from it and the documents'
positions walk down the orders: a join with the table of each order scores those whose n-gram
is there and leaves the rest, with `alpha`, to the next.

Rounds: hash partitions are done in `rounds` rounds, each over all texts, and a round's
shuffle files go when its sums are stored: a share of the exploded rows is on disk at a time.

Hot n-grams: one that holds `hot_share` of all positions would make a partition hot.  There
are at most 2 / hot_share candidates an order, by arithmetic; they are counted exactly
beforehand with a combine in each task, and their part of every sum is made where the text
is read.  Rows of a hot history are dealt by their n-gram instead.

Defined results: null or empty text has no words, a sum of 0 and a null mean; a word that
`corpus` lacks counts as seen once; repeated rows count as often as they occur and get the
same score each; null ids are ids; an empty table gives no rows; other columns are not kept,
whatever their names; texts of any length are handled, n-grams as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.hashing import U, chunks, rolled, word_hashes
from tonewright.llm.shared import conf_set, discard, stored

#: Kinds of exploded rows: the first history of a text, an n-gram, the last history (no n-gram
#: follows) and an n-gram whose history is hot.
HEAD, GRAM, END, LONE, NONE = 0, 1, 2, 3, 4


class Stretch:
    """The n-grams of a stretch of texts: histories and full n-grams by first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, order: int):
        h, row = word_hashes(data, offsets)
        self.h, self.row, self.n = h, row, len(offsets) - 1
        self.words = np.bincount(row, minlength=self.n)
        hist, whole = rolled(h, row, order - 1)
        gram, full = rolled(h, row, order)
        full = np.append(full, np.zeros(len(whole) - len(full), bool))
        gram = np.append(gram, np.zeros(len(whole) - len(gram), U))
        starts = np.searchsorted(row, np.arange(self.n))
        first = np.zeros(len(whole), bool)
        first[starts[(self.words >= order - 1) & (starts < len(whole))]] = True
        #: history and n-gram that start at each word; n-grams hold where `full`
        self.hist, self.gram, self.whole, self.full, self.first = hist, gram, whole, full, first & whole


def _heavy(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur `least` times or more, and how often."""
    top = (x >> U(48)).astype(np.int64)
    busy = np.bincount(top, minlength=1 << 16) >= least
    v, c = np.unique(x[busy[top]], return_counts=True)
    return v[c >= least], c[c >= least]


class Table:
    """A sorted table of hashes; its bitmap of leading bits answers for most that it lacks."""

    def __init__(self, values):
        self.values = np.unique(np.array(values, np.int64).view(U))
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.values >> U(48)).astype(np.int64)] = True

    def at(self, x: np.ndarray) -> np.ndarray:
        """Places of `x` in the table, -1 where it is not there."""
        out = np.full(len(x), -1)
        if len(self.values):
            may = np.flatnonzero(self.bits[(x >> U(48)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.values, x[may]), len(self.values) - 1)
            same = self.values[k] == x[may]
            out[may[same]] = k[same]
        return out


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


#: Shuffle files go when the write that made them ends.  Count tables and exploded rows are read
#: from one shuffle: it keeps all columns for either use, and rows dealt by their history alone
#: count as dealt for a join on history and n-gram.
_ONCE = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.ColumnPruning",
}


def _log(c: str):
    return F.log(F.col(c).cast("double"))


def backoff_scores(docs: DataFrame, corpus: DataFrame | None = None, order: int = 3, alpha: float = 0.4, rounds: int = 4, partition_rows: int = 1_000_000, hashed_rows: int = 4_000_000, hot_share: float = 0.0005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logarithms), mean_log_score and the number
    of words scored by each order (n_order1, ...).  `order` is 2 or more."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    if corpus is not None:
        return _against(texts, corpus.select(F.lit(0).alias("key"), F.col(text_col).alias("text")), order, alpha)
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a text, with its whole hash if it is shorter than a history; and the n-grams
        that hold a good share of a stretch: order 0 for histories, 1 for n-grams."""
        for b in batches:
            for at, data, offsets in chunks(b.column(2)):
                s = Stretch(data, offsets, order)
                whole = np.zeros(s.n, U)
                for k in range(1, order - 1):
                    g, ok = rolled(s.h, s.row, k)
                    g, r = g[ok], s.row[: len(ok)][ok]
                    short = s.words[r] == k
                    whole[r[short]] = g[short]
                none = pa.nulls(s.n, pa.int64())
                yield _batch("doc_id key n_words gram level n", b.column(0).slice(at, s.n), b.column(1).slice(at, s.n), s.words, whole.view(np.int64), none, none)
                least = max(1, math.ceil(hot_share / 2 * len(s.h)))
                for level, x in enumerate((s.hist[s.whole], s.gram[s.full])):
                    v, c = _heavy(x, least)
                    yield _batch("doc_id key n_words gram level n", pa.nulls(len(v), b.column(0).type), pa.nulls(len(v), pa.int64()), pa.nulls(len(v), pa.int64()), v.view(np.int64), np.full(len(v), level), c)

    seen = stored(texts.mapInArrow(survey, f"doc_id {kind}, key long, n_words long, gram long, level long, n long"), "survey")
    heads = seen.where("level is null")
    total = heads.agg(F.sum("n_words")).first()[0] or 0
    often = seen.where("level is not null").groupBy("level", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= hot_share / 2 * total).select("level", "gram").collect()
    hot = [Table([r.gram for r in often if r.level == k]) for k in (0, 1)]

    lengths = list(range(1, order - 1))
    wanted = heads.where((F.col("n_words") > 0) & (F.col("n_words") < order - 1)).select("key", "n_words", "gram")
    # of 65,536 bits, so that n-grams which no short text has hardly travel
    bits = np.zeros(1 << 16, bool)
    bits[[r.b for r in wanted.select(F.shiftrightunsigned("gram", 48).cast("int").alias("b")).distinct().collect()]] = True

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the hot n-grams (level 0 and 1, by place), and of what short texts consist
        of (level 1 + number of words, by hash)."""
        for b in batches:
            for _, data, offsets in chunks(b.column(1)):
                s = Stretch(data, offsets, order)
                for level, x in enumerate((s.hist[s.whole], s.gram[s.full])):
                    k = hot[level].at(x)
                    c = np.bincount(k[k >= 0], minlength=len(hot[level].values))
                    yield _batch("level gram n", np.full(len(c), level), np.arange(len(c)), c)
                for k in lengths if bits.any() else ():
                    g, ok = rolled(s.h, s.row, k)
                    g = g[ok]
                    v, c = np.unique(g[bits[(g >> U(48)).astype(np.int64)]], return_counts=True)
                    yield _batch("level gram n", np.full(len(v), k + 1), v.view(np.int64), c)

    hot_log = [np.zeros(len(x.values)) for x in hot]
    counts = None
    if often or bits.any():
        counts = stored(texts.select("key", "text").mapInArrow(tally, "level long, gram long, n long").groupBy("level", "gram").agg(F.sum("n").alias("n")), "counts")
        for r in counts.where("level < 2 and n > 0").collect():
            hot_log[r.level][r.gram] = math.log(r.n)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The part of each text's sum that hot n-grams make."""
        for b in batches:
            for at, data, offsets in chunks(b.column(1)):
                s = Stretch(data, offsets, order)
                old, new = hot[0].at(s.hist), hot[1].at(s.gram)
                part = np.zeros(len(old))
                for use, sign, k, values in ((s.full & (new >= 0), 1, new, hot_log[1]), (s.full & (old >= 0), -1, old, hot_log[0]), (s.first & (old >= 0), 1, old, hot_log[0])):
                    part[use] += sign * values[k[use]]
                yield _batch("key term", b.column(0).slice(at, s.n), np.bincount(s.row[: len(part)], part, s.n).astype(float))

    def explode(now: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = b.column(0).to_numpy()
                for at, data, offsets in chunks(b.column(1)):
                    s = Stretch(data, offsets, order)
                    # what the n-gram that starts at a word is, and where its row is dealt
                    what = np.where(s.full, GRAM, np.where(s.whole, END, NONE)).astype(np.int8)
                    old = np.flatnonzero((hot[0].at(s.hist) >= 0) & s.whole)
                    what[old] = np.where(s.full[old] & (hot[1].at(s.gram[old]) < 0), LONE, NONE)
                    past = s.hist.copy()
                    past[old] = s.gram[old]
                    turn = ((past >> U(40)) * U(rounds)) >> U(24) == U(now)
                    mine, first = np.flatnonzero(turn & (what != NONE)), np.setdiff1d(np.flatnonzero(turn & s.first), old)
                    where = np.concatenate([mine, first])
                    what = np.concatenate([what[mine], np.full(len(first), HEAD, np.int8)])
                    past = past[where]
                    gram = np.where(what % 2 == 1, s.gram[where], U(0))
                    yield _batch("past gram key what", past.view(np.int64), gram.view(np.int64), keys[at + s.row[where]], what)

        return run

    parts = max(1, math.ceil(total / rounds / partition_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / rounds / 20_000)))
    source = texts.select("key", "text")
    # a count table's part is hashed in memory where neither an average part nor the heaviest history can be large
    how = "shuffle_hash" if max(total / rounds / parts, hot_share * total) <= hashed_rows else "merge"
    sums = []
    with conf_set(spark, _ONCE):
        for now in range(rounds):
            rows = source.mapInArrow(explode(now), "past long not null, gram long not null, key long not null, what byte not null").repartition(parts, "past")
            # the two count tables, on the partitioning of the exploded rows, each joined to them
            grams = rows.groupBy("past", "gram").agg(F.sum(F.col("what") % 2).alias("n_gram"))
            pasts = rows.groupBy("past").agg(F.sum(F.col("what").isin(GRAM, END).cast("long")).alias("n_past"))
            met = rows.join(grams.hint(how), ["past", "gram"]).join(pasts.hint(how), "past")
            term = F.when(F.col("what") == GRAM, _log("n_gram") - _log("n_past")).when(F.col("what") == HEAD, _log("n_past")).when(F.col("what") == LONE, _log("n_gram"))
            sums.append(stored(met.select("key", term.alias("term")).groupBy("key").agg(F.sum("term").alias("term")), "sums"))
    terms = [*sums, source.mapInArrow(known, "key long, term double")] if often else list(sums)
    # sums by key hold the terms of every repeated row, those of short texts one row's
    repeats = heads.groupBy("key").agg(F.count("*").alias("times"))
    each = reduce(DataFrame.unionByName, terms).groupBy("key").agg(F.sum("term").alias("term"))
    each = each.join(repeats, "key").select("key", (F.col("term") / F.col("times")).alias("term"))
    if counts is not None:
        short = wanted.distinct().withColumn("level", F.col("n_words") + 1).join(counts, ["level", "gram"]).select("key", _log("n").alias("term"))
        each = each.unionByName(short).groupBy("key").agg(F.sum("term").alias("term"))
    each = stored(each, "terms")
    for x in [*sums, *([counts] if counts is not None else [])]:
        discard(x)
    words = F.col("n_words")
    score = F.when(words > 0, F.coalesce("term", F.lit(0.0)) - math.log(max(total, 1))).otherwise(F.lit(0.0))
    by_order = [F.when(words >= k, F.lit(1) if k < order else words - order + 1).otherwise(F.lit(0)).cast("long").alias(f"n_order{k}") for k in range(1, order + 1)]
    return heads.join(each, "key", "left").select("doc_id", "n_words", score.alias("log_score"), F.when(words > 0, score / words).alias("mean_log_score"), *by_order)


def _against(texts: DataFrame, corpus: DataFrame, order: int, alpha: float) -> DataFrame:
    """Scores of `texts` under the counts of `corpus`."""

    def count(k: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, data, offsets in chunks(b.column(1)):
                    g, ok = rolled(*word_hashes(data, offsets), k)
                    h, n = np.unique(g[ok], return_counts=True)
                    yield _batch("h n", h.view(np.int64), n)

        return stored(corpus.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a word: the n-grams that end there (g) and at the word before (p)."""
        for b in batches:
            keys = b.column(0).to_numpy()
            for at, data, offsets in chunks(b.column(1)):
                h, row = word_hashes(data, offsets)
                end, before = [], []
                for k in range(1, order + 1):
                    g, ok = rolled(h, row, k)
                    g, ok = (np.concatenate([np.zeros(len(h) - len(x), x.dtype), x]) for x in (g, ok))
                    end.append(pa.array(g.view(np.int64), mask=~ok))
                    inside = np.append(False, row[1:] == row[:-1])[: len(h)] & np.append(False, ok)[: len(h)]
                    before.append(pa.array(np.append(U(0), g)[: len(h)].view(np.int64), mask=~inside))
                yield _batch(names, keys[at + row], *end, *before[:-1])

    tables = {k: count(k) for k in range(1, order + 1)}
    total = tables[1].agg(F.sum("n")).first()[0] or 1
    names = " ".join(["key", *(f"g{k}" for k in range(1, order + 1)), *(f"p{k}" for k in range(1, order))])
    left = texts.select("key", "text").mapInArrow(explode, ", ".join(f"{x} long" for x in names.split())).withColumn("off", F.lit(0.0))
    held, scored = [], []
    for k in range(order, 1, -1):
        gram, past = (tables[j].select(F.col("h").alias(h), F.col("n").alias(n)) for j, h, n in ((k, f"g{k}", "c"), (k - 1, f"p{k - 1}", "q")))
        able = left.where(F.col(f"g{k}").isNotNull())
        met = stored(able.join(gram, f"g{k}", "left").join(past, f"p{k - 1}", "left"), "met")
        held.append(met)
        scored.append(met.where("c is not null").select("key", (F.col("off") + _log("c") - _log("q")).alias("term"), F.lit(k).alias("by")))
        left = met.where("c is null").withColumn("off", F.col("off") + math.log(alpha)).drop("c", "q").unionByName(left.where(F.col(f"g{k}").isNull()))
    word = tables[1].select(F.col("h").alias("g1"), F.col("n").alias("c"))
    scored.append(left.join(word, "g1", "left").select("key", (F.col("off") + F.log(F.coalesce("c", F.lit(1)).cast("double")) - math.log(total)).alias("term"), F.lit(1).alias("by")))
    by_order = [F.sum((F.col("by") == k).cast("long")).alias(f"by{k}") for k in range(1, order + 1)]
    each = reduce(DataFrame.unionByName, scored).groupBy("key").agg(F.sum("term").alias("term"), *by_order)
    times = texts.groupBy("key").agg(F.count("*").alias("times"))
    each = stored(each.join(times, "key"), "terms")
    for x in [*held, *tables.values()]:
        discard(x)
    share = lambda c: F.coalesce((F.col(c) / F.col("times")), F.lit(0.0))
    words = reduce(lambda a, b: a + b, [share(f"by{k}") for k in range(1, order + 1)]).cast("long")
    return texts.select("doc_id", "key").join(each, "key", "left").select("doc_id", words.alias("n_words"), share("term").alias("log_score"), F.when(words > 0, share("term") / words).alias("mean_log_score"), *(share(f"by{k}").cast("long").alias(f"n_order{k}") for k in range(1, order + 1)))
