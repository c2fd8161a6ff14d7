"""Exact top-k inner products by a threshold algorithm over sorted per-dimension lists.

Components become integers, floor(scale * x), and every score is an exact integer.

1. Equal integer vectors are one class, of which the k + 1 smallest ids are kept: any further
   copy has k + 1 rows before it in every answer, and a query leaves out one id, its own.
2. Classes are dealt by hash to shards of about `shard` classes.  Every query class goes to
   every shard once, as a row of bytes; a task loads a shard, sorts a list per dimension and
   lets the queries stream by.  A query set meets all rows, in blocks; nothing is broadcast.
3. A query walks down the lists, from the top where its component is positive and from the
   bottom where it is negative, some entries at a time.  What a list shows for the first time
   is scored by random access.  No class below can score more than the sum over lists of
   component times last value seen; the walk ends when that bound is under the k + 1-st result.
4. The shards' results of a query class meet in a window that keeps the best k + 1, and each
   query row takes them without its own id.

In many dimensions without structure the bound falls late and most of a shard is scored, as
it must be for this method; results are exact wherever it stops.

Defined results: vectors that are null or hold null or non-finite components, and rows without
an id, take no part; only vectors of one length are compared (empty ones score 0); a row that
repeats with id and vector counts once, and a query leaves out its own id wherever it occurs;
ties go to the smaller id; where fewer rows are there, all are given; scores beyond a long are
held at its limits, ranked by their true value; an empty table gives no rows; other columns
are not read, whatever their names; ids are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonewright.llm.shared import stored

#: Integers of these sizes, else "f": the components as doubles, taken as Python integers.
_KINDS = {b"h": "<i2", b"i": "<i4", b"q": "<i8"}
_LONG = (1 << 63) - 1


def packed(values: np.ndarray, scale: int) -> bytes:
    """A vector's integers in the smallest size that holds them, led by the size's name."""
    y = np.floor(values * scale)
    most = np.abs(y).max() if len(y) else 0.0
    for kind, dtype in _KINDS.items():
        if most < 2.0 ** (8 * np.dtype(dtype).itemsize - 1):
            return kind + y.astype(dtype).tobytes()
    return b"f" + values.astype("<f8").tobytes()


def unpacked(raw: bytes, scale: int) -> np.ndarray:
    if raw[:1] == b"f":
        return np.array([int(c) * scale if abs(c) > 2.0**60 else math.floor(c * scale) for c in np.frombuffer(raw, "<f8", offset=1).tolist()], object)
    return np.frombuffer(raw, _KINDS[raw[:1]], offset=1).astype(np.int64)


def _matrix(raw: list[bytes], scale: int) -> np.ndarray:
    """Rows of integers: as doubles where every double here is exact, else as Python integers."""
    rows = [unpacked(r, scale) for r in raw]
    if all(r.dtype != object for r in rows):
        x = np.array(rows, np.int64)
        if not x.size or np.abs(x.astype(float)).max() < 2.0**52:
            return x.astype(float)
    return np.array([r.tolist() for r in rows], object).reshape(len(rows), -1)


class Lists:
    """The sorted lists of a shard."""

    def __init__(self, x: np.ndarray, least_id: np.ndarray):
        self.x, self.least_id = x, least_id
        self.order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.order, 0)
        self.most = max((abs(v) for v in (x.max(), x.min())), default=0) if x.size else 0

    def best(self, q: np.ndarray, k: int, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best, ties to the smaller id, and how they were found: sorted
        access by growing steps, random access to what is new, a stop by the bound."""
        x, n = self.x, len(self.x)
        size = int(max((abs(v) for v in q.tolist()), default=0))
        if x.dtype == object or q.dtype == object or size * int(self.most) * max(1, len(q)) >= 1 << 53:
            x, q = (a if a.dtype == object else np.array([int(v) for v in a.ravel().tolist()], object).reshape(a.shape) for a in (x, q))
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = np.zeros(n, bool)
        found, scores = np.zeros(0, np.int64), np.zeros(0, x.dtype)
        at = 0
        if not len(up) and not len(down):  # every score is 0
            at, found, scores = n, np.arange(n), np.full(n, 0, x.dtype)
            keep = np.lexsort((self.least_id, -scores))[:k]
            return found[keep], scores[keep]
        while at < n:
            to = min(n, at + step)
            new = np.zeros(n, bool)
            new[self.order[n - to : n - at, up].ravel()] = True
            new[self.order[at:to, down].ravel()] = True
            new &= ~seen
            seen |= new
            fresh = np.flatnonzero(new)
            found, scores = np.concatenate([found, fresh]), np.concatenate([scores, x[fresh] @ q])
            keep = np.lexsort((self.least_id[found], -scores))[:k]
            found, scores = found[keep], scores[keep]
            if seen.all():
                break
            bound = (q[up] * self.values[n - to, up]).sum() + (q[down] * self.values[to - 1, down]).sum()
            if len(found) >= k and bound < scores[-1]:
                break
            at, step = to, step * 2
        return found, scores


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` best rows for each row where `is_query`."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, raw = [], []
            v = b.column(2)
            flat = v.flatten().cast(pa.float64())
            values = flat.fill_null(math.nan).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in v])])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            for r in np.flatnonzero(np.asarray(v.is_valid()) & np.asarray(b.column(0).is_valid())).tolist():
                if bad[ends[r + 1]] == bad[ends[r]]:
                    keep.append(r)
                    raw.append(packed(values[ends[r] : ends[r + 1]], scale))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64())), pa.array(raw, pa.binary())], names=["vec_id", "asks", "x"])

    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector_col).alias("v"))
    every = stored(source.mapInArrow(pack, "vec_id long, asks boolean, x binary"), "vectors")
    by_id = Window.partitionBy("x").orderBy("vec_id")
    firsts = every.select("x", "vec_id").distinct().withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    classes = stored(firsts.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    asks = stored(every.where("asks").select("x").distinct(), "asks")
    n = classes.count()
    shards = max(1, math.ceil(n / max(1024, min(shard, math.ceil(n / parts)))))
    where = F.pmod(F.xxhash64("x"), F.lit(shards)).cast("int")
    side = F.lit(0).cast("byte")
    rows = classes.select(where.alias("shard"), side.alias("side"), "x", "ids").unionByName(
        asks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).cast("byte").alias("side"), "x", F.lit(None).cast("array<long>").alias("ids"))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard_now, raw, ids, lists = None, [], [], {}
        for b in batches:
            shard_of, side_of, x = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            out: list[tuple[bytes, int, int]] = []
            for r in range(b.num_rows):
                if shard_of[r] != shard_now:
                    shard_now, raw, ids, lists = shard_of[r], [], [], {}
                if not side_of[r]:
                    raw.append(x[r])
                    ids.append(b.column(3)[r].as_py())
                    continue
                if raw:
                    lists, raw, ids = _by_length(raw, ids, scale), [], []
                q = _matrix([x[r]], scale)[0]
                if len(q) not in lists:
                    continue
                mine, own = lists[len(q)]
                found, scores = mine.best(q, k + 1)
                each = sorted((-int(s), i) for f, s in zip(found.tolist(), scores.tolist(), strict=True) for i in own[f])[: k + 1]
                out.extend((x[r], -s, i) for s, i in each)
            if out:
                # true scores may pass a long: their order is kept as text of one length, offset to be positive
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([f"{o[1] + (1 << 2200):0700d}" if abs(o[1]) > _LONG else None for o in out], pa.string()), pa.array([max(-_LONG - 1, min(_LONG, o[1])) for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], names=["x", "beyond", "score", "vec_id"])

    dealt = rows.repartition(min(shards, parts * 8), "shard").sortWithinPartitions("shard", "side")
    found = dealt.mapInArrow(search, "x binary, beyond string, score long, vec_id long")
    best = [F.col("score").desc(), F.col("beyond").desc_nulls_last(), F.col("vec_id")]
    top = found.withColumn("nth", F.row_number().over(Window.partitionBy("x").orderBy(*best))).where(F.col("nth") <= k + 1)
    answers = top.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("best"))
    # query rows with one vector may be many: they are joined with the few answers of their class
    asked = every.where("asks").select("vec_id", "x").distinct().withColumnRenamed("vec_id", "query_id")
    own = F.slice(F.filter("best", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    each = asked.join(answers, "x").select("query_id", F.posexplode(own).alias("p", "c"))
    return each.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), F.col("c.score").alias("score"))


def _by_length(raw: list[bytes], ids: list[list[int]], scale: int) -> dict[int, tuple[Lists, list[list[int]]]]:
    """Sorted lists of the vectors of each length."""
    rows: dict[int, list[int]] = {}
    for r, b in enumerate(raw):
        rows.setdefault((len(b) - 1) // (8 if b[:1] == b"f" else np.dtype(_KINDS[b[:1]]).itemsize), []).append(r)
    return {n: (Lists(_matrix([raw[r] for r in mine], scale), np.array([ids[r][0] for r in mine], np.int64)), [ids[r] for r in mine]) for n, mine in rows.items()}
