"""Near-duplicate embeddings by collision-counting projections.

Equal vectors are one class.  Every vector is projected on `windows` random directions, and
a pair collides on a projection if one value lies within the window centred on the other:
each projection is sorted, and a query's window is a stretch of it.  Linked pairs collide on
nearly all projections, others on about a third.  A pair is verified, in double precision,
if it collides at least `least` times; that count is calibrated from the window's collision
probability at the threshold so that at most 1 linked pair in 2,000 is missed.

The windows of one projection hold about a third of all unrelated vectors, so sorting whole
projections would count pairs as the square of the table.  Further projections, cut into
intervals, deal the vectors into cells first: `tables` times, vectors with `depth` equal
intervals share a cell, and the projections of a cell are sorted and searched.  `depth`
grows with the logarithm of the number of vectors, so that cells of unrelated vectors stay
about as large; `tables` follows from the recall wanted.

A pair that meets in several cells is counted in the first table where it meets, so links
are counted without a list of pairs.  Cells over `block` vectors are split into pairs of
blocks that run as tasks of their own.  Cells are computed once and stored.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and are their own component; vectors of different length never link;
equal vectors always link; very large and very small vectors are scaled first; repeated ids
count as separate vectors of one id; a tie for a component's name goes to the smallest id;
other columns are not kept, whatever their names; ids are integers (others cannot be cast
and end the job); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.hashing import U, by_group, mix
from tonewright.llm.shared import components, discard, stored

BLOCK = 1000


@dataclass(frozen=True)
class Plan:
    """Projections and thresholds; the same seed gives the same random directions everywhere."""

    cosine: float
    depth: int
    tables: int
    windows: int
    width: float
    window: float
    least: int
    seed: int = 17

    @classmethod
    def calibrated(cls, n: int, cosine: float = 0.95, recall: float = 0.9995, cell: int = 256, windows: int = 24) -> Plan:
        near, far = math.sqrt(2 - 2 * cosine), math.sqrt(2.0)
        width, window = 4 * near, 2 * near

        def within(sigma: float) -> float:  # a difference N(0, sigma) falls into one interval of `width`
            x = width / sigma
            return math.erf(x / math.sqrt(2)) - (1 - math.exp(-x * x / 2)) * math.sqrt(2 / math.pi) / x

        depth = max(1, round(math.log(max(n / cell, 2)) / -math.log(within(far))))
        tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - within(near) ** depth)))
        p = math.erf(window / near / math.sqrt(2))
        tail, least = 0.0, windows
        for hits in range(windows, -1, -1):
            tail += math.comb(windows, hits) * p**hits * (1 - p) ** (windows - hits)
            least = hits
            if tail >= 0.9995:
                break
        return cls(cosine, depth, tables, windows, width, window, least)

    @lru_cache(maxsize=8)  # noqa: B019
    def directions(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng([self.seed, dim])
        cells = rng.standard_normal((dim, self.tables * self.depth))
        return cells, rng.uniform(0, self.width, self.tables * self.depth), rng.standard_normal((dim, self.windows))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """A cell per vector and table."""
        a, shift, _ = self.directions(x.shape[1])
        # projected one vector at a time in a fixed order of additions, so that a cell does not depend on the batch
        q = np.floor((np.einsum("ij,jk->ik", x, a, optimize=False) + shift) / self.width).astype(np.int64).astype(U)
        out = np.zeros((len(x), self.tables), U)
        for k in range(self.depth):
            out = mix(out + q[:, k :: self.depth] + U(k + x.shape[1]))
        return out.view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vector(v) -> bytes | None:
    """Little-endian doubles of a usable vector."""
    if v is None or not len(v) or any(c is None for c in v):
        return None
    x = np.asarray(v, "<f8")
    if not np.isfinite(x).all():
        return None
    big = np.abs(x).max()
    if not big:
        return None
    # squares of other sizes leave the range of full precision
    return (x if 1e-120 < big < 1e120 else x / big).tobytes()


def collisions(p: np.ndarray, q: np.ndarray, window: float) -> np.ndarray:
    """How many projections of each pair (row of p, row of q) lie within the window: every
    projection of q is sorted, and each query's window is a stretch of it."""
    out = np.zeros((len(p), len(q) + 1), np.int16)
    rows = np.arange(len(p))
    for k in range(p.shape[1]):
        order = np.argsort(q[:, k], kind="stable")
        values = q[order, k]
        low, high = np.searchsorted(values, p[:, k] - window, "left"), np.searchsorted(values, p[:, k] + window, "right")
        mark = np.zeros((len(p), len(q) + 1), np.int16)
        mark[rows, low] += 1
        np.subtract.at(mark, (rows, high), 1)
        hit = np.cumsum(mark, 1)[:, :-1]
        out[:, order] += hit
    return out[:, :-1]


def links_in_cell(x: np.ndarray, cells: np.ndarray, side: np.ndarray, table: int, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the cell that link and meet in no earlier table."""
    _, _, w = plan.directions(x.shape[1])
    p = np.einsum("ij,jk->ik", x, w, optimize=False)
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(two) or not len(one)
    if within:
        one = two = np.arange(len(x))
    i, j = np.nonzero(collisions(p[one], p[two], plan.window) >= plan.least)
    i, j = one[i], two[j]
    if within:
        i, j = i[i < j], j[i < j]
    keep = []
    for at in range(0, len(i), 65536):
        a, b = i[at : at + 65536], j[at : at + 65536]
        keep.append((np.einsum("ij,ij->i", x[a], x[b]) >= plan.cosine) & ~(cells[a, :table] == cells[b, :table]).any(1))
    ok = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[ok], j[ok]


def least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of 0..n-1 that each can reach by the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(after, at, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.9995, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept; ids are integers."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [_vector(v.as_py()) for v in b.column(1)]
            key = [None if v is None else xxhash.xxh3_128_digest(v) for v in x]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.binary()), pa.array(x, pa.binary())], names=["vec_id", "key", "x"])

    every = stored(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(name, "vec_id long, key binary, x binary"), "vectors")
    classes = stored(every.where("key is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("x").alias("x")), "classes")
    plan = Plan.calibrated(classes.count(), cosine, recall)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            for dim in sorted({len(v) for v in raw}):
                mine = [k for k, v in enumerate(raw) if len(v) == dim]
                for at in range(0, len(mine), 2000):
                    rows = mine[at : at + 2000]
                    cell = plan.cells(unit(np.frombuffer(b"".join(raw[k] for k in rows)).reshape(len(rows), -1)))
                    kept = [b.column(c).take(pa.array(rows)) for c in range(3)]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(list(cell), pa.list_(pa.int64()))], names=["rep", "copies", "x", "cells"])

    laid = stored(classes.select("rep", "copies", "x").mapInArrow(spread, "rep long, copies long, x binary, cells array<long>"), "cells")
    each = laid.select(F.posexplode("cells").alias("t", "cell"), "rep", "copies", "x", "cells")
    hot = stored(each.groupBy("t", "cell").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("t").alias("ht"), F.col("cell").alias("hcell"), F.ceil(F.col("n") / block).cast("int").alias("cuts")), "hot")
    cut = each.join(hot, (F.col("t") == F.col("ht")) & (F.col("cell") == F.col("hcell")), "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("cuts").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    # of the cells only those of earlier tables are asked for
    tiles = cut.select("t", "cell", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "rep", "copies", "x", F.slice("cells", 1, F.greatest("t", F.lit(1))).alias("before"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in by_group(batches, 4):
            if g.num_rows < 2:
                continue
            raw = g.column(7).to_pylist()
            table, lo = g.column(0)[0].as_py(), g.column(2)[0].as_py()
            rep, copies, part = g.column(5).to_numpy(), g.column(6).to_numpy(), g.column(4).to_numpy()
            before = g.column(8).combine_chunks().flatten().to_numpy().reshape(g.num_rows, -1)
            for dim in {len(v) for v in raw}:
                mine = np.array([k for k, v in enumerate(raw) if len(v) == dim])
                x = unit(np.frombuffer(b"".join(raw[k] for k in mine)).reshape(len(mine), -1))
                side = (part[mine] != lo).astype(int)
                if lo != g.column(3)[0].as_py() and side.all() or len(mine) < 2:
                    continue
                i, j = links_in_cell(x, before[mine], side, table, plan)
                if not len(i):
                    continue
                n = np.bincount(i, copies[mine][j], len(mine)) + np.bincount(j, copies[mine][i], len(mine))
                a, b = _tree(least_reachable(len(mine), i, j))
                has = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[mine][has], rep[mine][a]])), pa.array(np.concatenate([n[has].astype(np.int64), np.zeros(len(a), np.int64)])), pa.array(np.concatenate([np.zeros(len(has), np.int64), rep[mine][b]]), mask=np.arange(len(has) + len(a)) < len(has))], names=["a", "n", "b"])

    found = stored(tiles.repartition(parts, "t", "cell", "lo", "hi").sortWithinPartitions("t", "cell", "lo", "hi").mapInArrow(count, "a long, n long, b long"), "found")
    roots = components(found.where("b is not null").select("a", "b"))
    sums = found.where("b is null").groupBy(F.col("a").alias("srep")).agg(F.sum("n").alias("n"))
    named = classes.join(sums, F.col("rep") == F.col("srep"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    named = stored(named.select(F.col("key").alias("ckey"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"), F.coalesce("root", "rep").alias("component")), "named")
    out = every.select("vec_id", "key").join(named, F.col("key") == F.col("ckey"), "left")
    for df in (classes, laid, hot, found):
        discard(df)
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _tree(root: np.ndarray, fan: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what has the same root, at most `fan` + 1 a node."""
    order = np.argsort(root, kind="stable")
    sorted_root = root[order]
    first = np.searchsorted(sorted_root, sorted_root, "left")
    rank = np.arange(len(root)) - first
    child = np.flatnonzero(rank > 0)
    return order[child], order[first[child] + (rank[child] - 1) // fan]
