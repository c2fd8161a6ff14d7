"""N-gram Jaccard join by signature trees.

Documents are sets of word n-grams; two link when ``den * |A & B| >= num * |A | B|``.
Documents with equal sets are one class.  The exact join of classes has three steps:

1. Candidate groups.  Linked sets differ in at most d shingles, d known from their sizes.
   Shingles are dealt by hash into d + 1 + c buckets, so at least c + 1 buckets of linked
   sets agree.  Each set keeps the signatures of all but its c weakest buckets (fewest
   shingles, then by hash): the strongest agreeing bucket is kept by both.  Sets that
   share a signature are joined, and the connected components are the candidate groups:
   every link lies within a group, and text that many documents share hardly joins them
   because a whole bucket must agree.  In a large corpus it still joins some, and chains of
   them make groups of sets that do not link.  So a group of several blocks is divided:
   linked sets share at least m of their shingles, m known from the size of each.  In any
   order of all shingles each set drops its first m - 1; the last shingle that linked sets
   share is kept by both, so sets that share a kept one are joined, the rest link with
   nothing.  The order is by how many sets hold a shingle, most first, read from a table of
   counts by hash of fixed size; what one set alone holds by that table is not sent.  A full
   table orders less well, and joins more, but loses nothing.  Groups that are then still of
   more than `DEEP` blocks are divided by exact counts: of the shingles that others hold each
   set drops the m - 1 that most sets hold.
2. Signature trees.  A group's sets are cut into blocks of bounded size, a small group is
   one block; of a block a tree is built whose nodes hold the size range and the OR-combined
   token bitmap of the sets below, with the most shingles that any of them has on each bit.
   A dual traversal prunes pairs of nodes by the largest overlap the bitmaps and sizes
   allow, and pairs that are connected already; what remains is verified exactly.
   First every block is joined with itself and with a few pivot sets of the near blocks of
   its group, which connects near copies across blocks.  Then, in groups that are not one
   component yet, the sets are cut into blocks anew, those of a large component apart, and
   every two blocks whose sizes allow a link meet, but for two of one component.
3. Links found form the components.

Bounds: signatures are 16 bytes a row, one a batch and signature; edges are trees of what a
task connects, so their number follows the sets, not their pairs, and a round of the components
(`settled`) sends a set's name once a task and writes one table; blocks hold about
`block` sets and `shingles` shingles at most (a longer set is a block of its own); groups of
any size are split, so no group reaches one task.  Sets of large groups are divided by a row for
each kept shingle, (1 - num / den) of a set at most; the table of counts is `CELLS` bytes, one a task
of `CELLS` / 4 shingles, and reaches the driver and every task once.  The exact counts take a row of
24 bytes a shingle, and one for each that others hold.  A text travels once, and again only for what
its group leaves unconnected.  Shuffle files go with the write that
made them.

Defined results: with fewer words than n the whole sequence is one shingle; null or empty
text has no shingles and links with nothing; a row without an id is not linked; repeated
rows are a class of their own; documents of one id and different texts are separate sets of
one id; a tie for a component's name goes to the smallest id; an empty table gives no rows;
texts of any length are read whole, in stretches; other columns are not kept, whatever
their names; ids are integers (others cannot be cast and end the job).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonewright.llm.hashing import Forest, Names, U, by_group, chunks, mix, ngrams, word_hashes
from tonewright.llm.shared import components, conf_set, discard, stored

BITS = 1024
BLOCK = 256
LEAF = 4
LEVEL = 1.12  # the ratio of neighbouring size levels
PIVOTS = 8  # a block's pivot sets, on average
SHINGLES = 2_000_000  # a block's shingles, at most (but for one set)
CELLS = 1 << 24  # of the table of counts by hash, a byte each
DEEP = 16  # a group of more blocks is divided by exact counts
STRETCH = 500_000  # rows of edges that a task connects at once
#: Shuffle files go when the write that made them ends, not when the driver collects its garbage.
_ONCE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their row, sorted by row, then shingle."""
    h, row = word_hashes(data, offsets)
    g, r = ngrams(h, row, n)
    count = np.bincount(row, minlength=len(offsets) - 1) if len(row) else np.zeros(len(offsets) - 1, int)
    for k in range(1, n):  # shorter texts are one shingle
        short = count[row] == k
        gk, rk = ngrams(h[short], row[short], k)
        g, r = np.concatenate([g, gk]), np.concatenate([r, rk])
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    return g[new], r[new]


def levels(most: int, num: int, den: int) -> np.ndarray:
    """Size classes [b, next b): a set and its larger partner lie in one or in neighbouring classes."""
    ratio = 1.08 * den / num
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * ratio))))
    return np.array([*out, max(out[-1] + 1, int(np.ceil(out[-1] * ratio)))])


def differences(high: np.ndarray, num: int, den: int) -> np.ndarray:
    """The most shingles by which linked sets can differ if the smaller has up to `high`."""
    return (high + high * den // num) * (den - num) // (den + num)


def signatures(g: np.ndarray, r: np.ndarray, rows: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of the kept buckets of every set, at its size class and, if a
    smaller partner can lie there, the class below."""
    size = np.bincount(r, minlength=rows)
    if not len(g):
        return np.zeros(0, U), np.zeros(0, np.int64)
    bounds = levels(int(size.max()), num, den)
    own = np.searchsorted(bounds, size, "right") - 1
    out_s, out_r = [], []
    for below in (0, 1):
        level = own - below
        use = (size > 0) & (level >= 0)
        if below:
            use &= (bounds[np.maximum(own, 0)] - 1) * den >= size * num
        high = bounds[np.maximum(level, 0) + 1] - 1
        d = differences(high, num, den)
        use &= d > 0  # else only equal sets link
        if not use.any():
            continue
        spare = d // 4 + 1
        k = np.where(use, d + 1 + spare, 0)
        base = np.concatenate([[0], np.cumsum(k)])
        mine = use[r]
        e, er = g[mine], r[mine]
        bucket = base[er] + (mix(e + level[er].astype(U) * U(0xA0761D6478BD642F)) % k[er].astype(U)).astype(np.int64)
        total = np.zeros(base[-1], U)
        np.add.at(total, bucket, mix(e ^ U(0x2545F4914F6CDD1D)))
        held = np.bincount(bucket, minlength=base[-1])
        row = np.repeat(np.arange(rows), k)
        sig = mix(total + mix((np.arange(base[-1]) - base[row]).astype(U) * U(_STEP) + level[row].astype(U)))
        order = np.lexsort((sig, held, row))  # weakest first within a row
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - base[row[order]]
        keep = rank >= spare[row]
        out_s.append(sig[keep])
        out_r.append(row[keep])
    if not out_s:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(out_s), np.concatenate(out_r)


_STEP = 0xE7037ED1A0B428DB


class _Node:
    __slots__ = ("count", "items", "kids", "least", "most")

    def __init__(self, items: list[int], sizes: np.ndarray, counts: np.ndarray, kids: list[_Node]):
        self.items, self.kids = items, kids
        self.least, self.most = int(sizes[items].min()), int(sizes[items].max())
        self.count = counts[items].max(0) if not kids else np.maximum.reduce([k.count for k in kids])


def build_tree(items: list[int], sizes: np.ndarray, counts: np.ndarray) -> _Node:
    """Neighbours in the order given share nodes; four kids a node."""
    nodes = [_Node(items[i : i + LEAF], sizes, counts, []) for i in range(0, len(items), LEAF)]
    while len(nodes) > 1:
        nodes = [_Node([x for n in nodes[i : i + 4] for x in n.items], sizes, counts, nodes[i : i + 4]) for i in range(0, len(nodes), 4)]
    return nodes[0]


def join_trees(a: _Node, b: _Node, sets: list[np.ndarray], counts: np.ndarray, forest: Forest, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links that connect what was not connected: a dual traversal of two trees (or of one with itself)."""
    todo = [(a, b)]
    uniform: dict[int, bool] = {}

    def one(node: _Node) -> bool:
        if not uniform.get(id(node)):
            root = forest.find(node.items[0])
            uniform[id(node)] = all(forest.find(i) == root for i in node.items)
        return uniform[id(node)]

    while todo:
        m, n = todo.pop()
        small, large = max(m.least, n.least), min(m.most, n.most)
        if m is not n and (small * num > large * den or one(m) and one(n) and forest.find(m.items[0]) == forest.find(n.items[0])):
            continue
        if m is n and one(m):
            continue
        if m is not n:
            overlap = int(np.minimum(m.count, n.count).sum())
            if overlap * (num + den) < num * (m.least + n.least):
                continue
        if m.kids or n.kids:
            if m is n:
                todo += [(x, y) for i, x in enumerate(m.kids) for y in m.kids[i:]]
            elif m.kids and (not n.kids or len(m.items) >= len(n.items)):
                todo += [(x, n) for x in m.kids]
            else:
                todo += [(m, y) for y in n.kids]
            continue
        for i in m.items:
            for j in n.items:
                if (m is n and j <= i) or forest.find(i) == forest.find(j):
                    continue
                s, t = sets[i], sets[j]
                if min(len(s), len(t)) * den < max(len(s), len(t)) * num:
                    continue
                if int(np.minimum(counts[i], counts[j]).sum()) * (num + den) < num * (len(s) + len(t)):
                    continue
                both = np.concatenate([s, t])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                if same * (num + den) >= num * (len(s) + len(t)):
                    forest.join(i, j)
                    yield i, j


def _token_counts(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), BITS), np.uint16)
    for k, s in enumerate(sets):
        out[k] = np.minimum(np.bincount((s >> U(20)) % U(BITS), minlength=BITS), 65535)
    return out


def link_block(sets: list[np.ndarray], side: np.ndarray, num: int, den: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Connecting links between sets of side 0 and side 1, or all, if there is one side; sets of
    the same `known` root are connected already."""
    counts, sizes = _token_counts(sets), np.array([len(s) for s in sets])
    order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), int(sizes[i])))
    forest, of_root = Forest(len(sets)), {}
    for i, root in enumerate(known or []):
        forest.join(of_root.setdefault(root, i), i)
    sides = [[i for i in order if side[i] == k] for k in (0, 1)]
    if not sides[1] or not sides[0]:
        tree = build_tree(sides[0] or sides[1], sizes, counts)
        return list(join_trees(tree, tree, sets, counts, forest, num, den))
    return list(join_trees(build_tree(sides[0], sizes, counts), build_tree(sides[1], sizes, counts), sets, counts, forest, num, den))


def _held(s: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
    """(key, a, b) of keys `s` and the sets `a` that hold them.  Sets that share keys are
    connected by a forest: rows with b.  Rows without b say that key `key` occurs, among the
    sets connected with a."""
    order = np.argsort(s, kind="stable")
    s, a = s[order], a[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(~new)
    names = Names()
    names.join(a[at - 1], a[at])
    edges = names.stars()
    key = np.concatenate([s[new], edges[:, 0]])
    left = np.concatenate([names.roots(a[new]), edges[:, 0]])
    right = np.concatenate([np.zeros(int(new.sum()), np.int64), edges[:, 1]])
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(left), pa.array(right, mask=np.arange(len(right)) < int(new.sum()))], names=["key", "a", "b"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees (a the root) of what the task's keys connect; they are given out when there are many,
    which costs repeated edges but no connection."""
    last, names = None, Names()

    def out() -> pa.RecordBatch:
        both = names.trees()
        names.up.clear()
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        edge = b.column(2).is_valid().to_numpy(zero_copy_only=False)
        key, a = b.column(0).to_numpy(), b.column(1).to_numpy()
        names.join(a[edge], b.column(2).fill_null(0).to_numpy()[edge])
        key, a = key[~edge], a[~edge]
        if last is not None:
            key, a = np.append(last[0], key), np.append(last[1], a)
        if len(key):
            last = (key[-1:], a[-1:])
        same = key[1:] == key[:-1]
        names.join(a[:-1][same], a[1:][same])
        if len(names) > STRETCH:
            yield out()
    yield out()


def jaccard_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, shingles: int = SHINGLES) -> DataFrame:
    """(doc_id, node, n_shingles, component_id): one row per row of `docs`; `node` is a
    128-bit digest of the set (null without shingles).  Ids are integers."""
    with conf_set(docs.sparkSession, _ONCE):
        return _groups(docs, n, num, den, id_col, text_col, block, shingles)


def _groups(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str, block: int, shingles: int) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in chunks(b.column(1)):
                g, r = shingle_sets(data, offsets, n)
                rows = len(offsets) - 1
                size = np.bincount(r, minlength=rows)
                ends = np.cumsum(size)
                node = [xxhash.xxh3_128_digest(g[e - s : e].tobytes()) if s else None for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, rows), pa.array(node, pa.binary()), pa.array(size, pa.int64())], names=["doc_id", "node", "n_shingles"])

    every = stored(texts.mapInArrow(digest, "doc_id long, node binary, n_shingles long"), "sets")
    classes = stored(every.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size")).withColumn("short", F.xxhash64("node")), "classes")
    held = [classes]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, a, b): the signatures of sets, as of `_held`."""
        for batch in batches:
            for _, data, offsets in chunks(batch.column(1)):
                g, r = shingle_sets(data, offsets, n)
                sig, row = signatures(g, r, len(offsets) - 1, num, den)
                size = np.bincount(r, minlength=len(offsets) - 1)
                ends = np.cumsum(size)
                name = np.array([_short_digest(g[e - s : e]) if s else 0 for s, e in zip(size.tolist(), ends.tolist(), strict=True)], np.int64)
                yield _held(sig.view(np.int64), name[row])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = texts.select("doc_id", "text").mapInArrow(sign, "key long, a long, b long").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_meet, "a long, b long")
    groups = settled(pairs)
    # linked sets lie at most `reach` size levels apart, so only blocks of near levels meet
    step = math.log(LEVEL)
    reach = math.floor(math.log(den / num) / step + 1e-9) + 1
    member = classes.join(groups.withColumnRenamed("node", "gnode"), F.col("short") == F.col("gnode"))
    member = stored(member.select("node", "rep", "size", F.col("root").alias("grp"), F.floor(F.log(F.col("size").cast("double")) / step).cast("long").alias("level")), "members")
    held.append(member)
    cuts = F.ceil(F.greatest(F.count("*") / block, F.sum("size") / shingles)).cast("long").alias("cuts")

    def near(cells: DataFrame, *more: str) -> DataFrame:
        """Cells (grp, level, `more`, cuts) with the cells of near levels of their group."""
        wide = cells.withColumn("olevel", F.explode(F.sequence(F.col("level") - reach, F.col("level") + reach)))
        other = cells.select("grp", F.col("level").alias("olevel"), *(F.col(c).alias(f"o{c}") for c in (*more, "cuts")))
        # as many entries as the group has blocks in 2 * reach + 1 levels, at most
        found = F.collect_list(F.struct("olevel", *(f"o{c}" for c in (*more, "cuts")))).alias("others")
        return wide.join(other, ["grp", "olevel"]).groupBy("grp", "level", *more, "cuts").agg(found)

    def meeting(placed: DataFrame) -> DataFrame:
        """Links of the roots of `placed`: (grp, node, rep, root, cell, met), met the cells to be joined with."""
        # the members of groups have no size bound: never broadcast, at any size
        tiles = texts.join(placed.hint("merge"), F.col("doc_id") == F.col("rep")).select("grp", "node", "root", "cell", "text", F.explode("met").alias("other"))
        tiles = tiles.select("grp", F.least("cell", "other").alias("lo"), F.greatest("cell", "other").alias("hi"), "cell", "node", "root", "text")
        return tiles.repartition(parts, "grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi").mapInArrow(verify, "a long, b long")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, 3):
            sets: list[np.ndarray] = []
            roots: list[int] = []
            side: list[int] = []
            known: set[bytes] = set()
            lo = t.column(1)[0].as_py()
            cells, node, root = (t.column(k).to_pylist() for k in range(3, 6))
            for at, data, offsets in chunks(t.column(6)):
                g, r = shingle_sets(data, offsets, n)
                size = np.bincount(r, minlength=len(offsets) - 1)
                ends = np.cumsum(size)
                for k in range(len(offsets) - 1):
                    own = g[ends[k] - size[k] : ends[k]]
                    # another text of the same id, or a repeated row, is not this set
                    if node[at + k] in known or xxhash.xxh3_128_digest(own.tobytes()) != node[at + k]:
                        continue
                    known.add(node[at + k])
                    sets.append(own.copy())
                    roots.append(root[at + k])
                    side.append(int(cells[at + k] != lo))
            if len(sets) < 2:
                continue
            found = link_block(sets, np.array(side), num, den, roots)
            names = Names()
            names.join(np.array([roots[i] for i, _ in found], np.int64), np.array([roots[j] for _, j in found], np.int64))
            both = names.trees()
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def summed(member: DataFrame) -> DataFrame:
        return stored(member.groupBy("grp").agg(cuts.alias("blocks"), F.count("*").alias("sets")).select("grp", (F.col("blocks") <= 1).alias("single"), "sets", "blocks"), "groups")

    whole = summed(member)
    held.append(whole)
    for way, blocks in ((divide, 1), (divide_exactly, DEEP)):
        large = whole.where((F.col("blocks") > blocks) & (F.col("sets") > 1)).select("grp")
        if not large.limit(1).count():
            break
        divided = way(texts, stored(member.join(large, "grp", "left_semi"), "large"), n, num, den)
        member = stored(member.join(large, "grp", "left_anti").unionByName(divided), "members")
        whole = summed(member)
        held += [member, whole, divided]

    # First: every block with itself and the pivots of near blocks.
    sized = member.join(whole.where("sets > 1").drop("blocks"), "grp").withColumn("level", F.when(F.col("single"), F.lit(0)).otherwise(F.col("level")).cast("long"))
    cells = near(stored(sized.groupBy("grp", "level").agg(cuts), "cells"))
    place = lambda level, k: F.xxhash64(level, k)
    each = F.transform("others", lambda o: F.transform(F.sequence(F.lit(0).cast("long"), o["ocuts"] - 1), lambda k: place(o["olevel"], k)))
    pivot = ~F.col("single") & (F.pmod(F.xxhash64("node", F.lit(3)), F.greatest(F.col("cuts") * (block // PIVOTS), F.lit(1))) == 0)
    own = place(F.col("level"), F.pmod(F.xxhash64("node"), F.col("cuts")))
    first = sized.join(cells, ["grp", "level"]).withColumn("own", own)
    first = first.select("grp", "node", "rep", F.col("rep").alias("root"), F.explode(F.when(pivot, F.array_union(F.flatten(each), F.array("own"))).otherwise(F.array("own"))).alias("cell"))
    roots = settled(meeting(first.withColumn("met", F.array("cell")))).withColumnsRenamed({"node": "linked"})

    # Then: blocks of groups that are not one component yet.
    several = sized.where(~F.col("single")).join(roots, F.col("rep") == F.col("linked"), "left").withColumn("root", F.coalesce("root", "rep"))
    several = stored(several.select("grp", "level", "node", "rep", "size", "root"), "several")
    open_ = several.groupBy("grp").agg((F.min("root") < F.max("root")).alias("open")).where("open").select("grp")
    counted = several.join(open_, "grp", "left_semi").groupBy("grp", "level", "root").agg(F.count("*").alias("n"), F.sum("size").alias("sum"))
    # a component with half a block of sets in a level has blocks of its own there
    counted = stored(counted.withColumn("part", F.when((F.col("n") >= block // 2) | (F.col("sum") >= shingles // 2), F.col("root"))), "counted")
    cuts = F.ceil(F.greatest(F.sum("n") / block, F.sum("sum") / shingles)).cast("long").alias("cuts")
    nobody = F.lit(-(1 << 63)).cast("long")  # the part of small components
    cells = near(stored(counted.groupBy("grp", "level", F.coalesce("part", nobody).alias("part")).agg(cuts), "cells"), "part")
    place = lambda level, part, k: F.xxhash64(level, part, k)
    apart = F.filter("others", lambda o: (o["opart"] != F.col("part")) | (F.col("part") == nobody))
    each = F.transform(apart, lambda o: F.transform(F.sequence(F.lit(0).cast("long"), o["ocuts"] - 1), lambda k: place(o["olevel"], o["opart"], k)))
    rest = several.join(counted.select("grp", "level", "root", F.coalesce("part", nobody).alias("part")), ["grp", "level", "root"]).join(cells, ["grp", "level", "part"])
    rest = rest.select("grp", "node", "rep", "root", place(F.col("level"), F.col("part"), F.pmod(F.xxhash64("node"), F.col("cuts"))).alias("cell"), F.flatten(each).alias("met"))
    late = settled(meeting(stored(rest, "placed"))).select(F.col("node").alias("first"), F.col("root").alias("last"))
    named = classes.join(roots, F.col("rep") == F.col("linked"), "left").select(F.col("node").alias("cnode"), F.coalesce("root", "rep").alias("component"))
    if late.limit(1).count():
        named = named.join(late, F.col("component") == F.col("first"), "left").select("cnode", F.coalesce("last", "component").alias("component"))
    named = stored(named, "named")
    out = every.join(named, F.col("node") == F.col("cnode"), "left").select("doc_id", "node", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id"))
    for df in (*held, several, counted):
        discard(df)
    return out


def settled(trees: DataFrame) -> DataFrame:
    """Connected components of `trees` (a, b), edges of forests with a the root, and (a, a) for
    each root: (node, root), root the smallest node of the component; no edges give no rows.

    Edges are dealt by their larger end; a task connects all that it gets and tells each node the
    least that it is connected with (`own`), and so each label that is not the least of its own
    and is dealt elsewhere.  So a node gets a row a task at most, however many nodes name it.
    Labels then take their label's label, by a join that adaptive execution can split, with the
    nodes that were a root of `trees` (`head`) and are none: others are no label.  When no task
    has news for another one, every node has one label, and only the labels' labels remain.
    A round writes one table, the first, which deals twice, too; `trees` is read once."""
    parts = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.select("node", "up", "head").repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_close, "node long, up long, head boolean, own boolean")

    def noted(rows: DataFrame) -> tuple[DataFrame, bool]:
        """`rows`, stored, and whether a task has news for another one."""
        seen = Observation()
        out = stored(rows.observe(seen, F.max(~F.col("own")).alias("news")), "labels")
        return out, bool(seen.get["news"])

    def jumped(labels: DataFrame) -> DataFrame:
        own = labels.where("own and head and up < node").select(F.col("node").alias("of"), F.col("up").alias("top"))
        return labels.join(own, F.col("up") == F.col("of"), "left").select("node", F.coalesce("top", "up").alias("up"), "head", "own", F.col("top").isNotNull().alias("moved"))

    rows = trees.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("up"), (F.col("a") == F.col("b")).alias("head"))
    labels, news = noted(dealt(dealt(rows)))
    while news:
        before = labels
        labels, news = noted(dealt(jumped(before)))
        discard(before)
    while (after := jumped(labels)).where("moved").limit(1).count():
        before, labels = labels, stored(after, "labels")
        discard(before)
    return labels.select("node", F.col("up").alias("root"))


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream (node, up, head) sorted by node the least that each node is connected with within
    the task, or a stretch of it: (node, up, head, own), own of nodes, not own of labels that are no
    node there."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

    def out(node: np.ndarray, up: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
        names = Names()
        names.join(node, up)
        keys, first = np.unique(node, return_index=True)
        head = np.logical_or.reduceat(head, first) if len(first) else head
        rest = np.setdiff1d(up, keys)
        least = names.roots(rest)
        rest, least = rest[least != rest], least[least != rest]
        own = np.arange(len(keys) + len(rest)) < len(keys)
        columns = [np.concatenate([keys, rest]), np.concatenate([names.roots(keys), least]), np.concatenate([head, np.ones(len(rest), bool)]), own]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "up", "head", "own"])

    for b in batches:
        held = [np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(held, b.columns, strict=True)]
        if len(held[0]) > STRETCH and (last := int(np.searchsorted(held[0], held[0][-1]))):  # the last node may go on
            yield out(*(x[:last] for x in held))
            held = [x[last:] for x in held]
    yield out(*held)


def _texts_of(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, text) of `sets`; other texts of the same id too."""
    # the members of groups have no size bound: never broadcast, at any size
    return texts.join(sets.select("node", "rep").hint("merge"), F.col("doc_id") == F.col("rep")).select("node", "text")


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of batches (node, text), in stretches: shingles and their row; name and size by row."""
    for b in batches:
        node = b.column(0).to_pylist()
        for at, data, offsets in chunks(b.column(1)):
            g, r = shingle_sets(data, offsets, n)
            size = np.bincount(r, minlength=len(offsets) - 1)
            ends = np.cumsum(size)
            # another text of the same id is not this set
            same = np.array([xxhash.xxh3_128_digest(g[e - s : e].tobytes()) == node[at + k] for k, (s, e) in enumerate(zip(size.tolist(), ends.tolist(), strict=True))])
            name = np.array([_spark_xxhash64(x) for x in node[at : at + len(size)]], np.int64)
            yield g[same[r]], r[same[r]], name, size


def _regrouped(large: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of `large` that are in a group of `groups`, under its name; uses up `large`."""
    groups = groups.select(F.col("node").alias("gnode"), F.col("root").alias("part"))
    out = stored(large.join(groups, F.xxhash64("node") == F.col("gnode")).select("node", "rep", "size", F.col("part").alias("grp"), "level"), "divided")
    discard(large)
    return out


def divide(texts: DataFrame, large: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The rows of `large` (node, rep, size, grp, level) that can have a link, in smaller groups:
    linked sets are in one.  `texts` is (doc_id, text); `large` is a stored table that is used up."""
    spark, cells = texts.sparkSession, CELLS
    part = min(cells, 1 << 16)

    def place(g: np.ndarray) -> np.ndarray:
        return (mix(g ^ U(_STEP)) % U(cells)).astype(np.int64)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, cells): how many sets of the task hold a shingle of the cell, 255 at most."""
        table = np.zeros(cells, np.uint8)
        for g, _, _, _ in _sets(batches, n):
            at, count = np.unique(place(g), return_counts=True)
            table[at] = np.minimum(table[at] + count, 255)
        if table.any():
            for k in range(0, cells, part):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([table[k : k + part].tobytes()])], names=["part", "cells"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, 1):
            both = np.zeros(part, np.uint64)
            for x in t.column(1):
                both[: len(x.as_py())] += np.frombuffer(x.as_py(), np.uint8)
            yield pa.RecordBatch.from_arrays([t.column(0)[:1].combine_chunks(), pa.array([np.minimum(both, 255).astype(np.uint8).tobytes()])], names=["part", "cells"])

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, a, b): the kept shingles of sets, as of `_held`."""
        for g, r, name, size in _sets(batches, n):
            count = held.value[place(g)]
            order = np.lexsort((g, -count.astype(int), r))
            g, r, count = g[order], r[order], count[order]
            nth = np.arange(len(r)) - np.searchsorted(r, r) + 1
            keep = (nth >= -(-size[r] * num // den)) & (count > 1)  # a shingle of one set links nothing
            yield _held(g[keep].view(np.int64), name[r[keep]])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_large = stored(_texts_of(texts, large), "texts")
    tasks = math.ceil((large.agg(F.sum("size")).first()[0] or 0) / max(cells / 4, 1))
    counts = of_large.coalesce(max(1, tasks)).mapInArrow(tally, "part long, cells binary")
    counts = counts.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(total, "part long, cells binary")
    # of fixed size, whatever the input
    held = spark.sparkContext.broadcast(np.frombuffer(b"".join(x.cells for x in sorted(counts.collect(), key=lambda x: x.part)).ljust(cells, b"\0"), np.uint8)[:cells])
    rows = of_large.mapInArrow(rarest, "key long, a long, b long")
    out = _regrouped(large, settled(rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_meet, "a long, b long")))
    held.destroy()
    discard(of_large)
    return out


def divide_exactly(texts: DataFrame, large: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """As `divide`, by the exact counts of shingles."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shingle, name, size) of every set."""
        for g, r, name, size in _sets(batches, n):
            for a in range(0, len(g), _ROWS):
                rows = r[a : a + _ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(g[a : a + _ROWS].view(np.int64)), pa.array(name[rows]), pa.array(size[rows])], names=["shingle", "name", "size"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a stream sorted by shingle and name the rows of shingles that several sets hold, with how many do."""
        none = np.zeros(0, np.int64)
        held = [none, none, none]

        def out(g: np.ndarray, name: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (name[1:] != name[:-1])  # a repeated row is the same set
            g, name, size = g[new], name[new], size[new]
            first = np.flatnonzero(np.concatenate([np.ones(min(len(g), 1), bool), g[1:] != g[:-1]]))
            sets = np.diff(np.append(first, len(g)))
            sets = np.repeat(sets, sets)
            several = sets > 1
            return pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (g, name, size, sets)], names=["shingle", "name", "size", "sets"])

        for b in batches:
            if not b.num_rows:
                continue
            held = [np.concatenate([x, c.to_numpy()]) for x, c in zip(held, b.columns, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1]))  # the last shingle may go on
            if last:
                yield out(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        yield out(*held)

    rows = _texts_of(texts, large).mapInArrow(spread, "shingle long, name long, size long").repartition(parts, "shingle").sortWithinPartitions("shingle", "name")
    shared = rows.mapInArrow(count, "shingle long, name long, size long, sets long")
    least = F.ceil(F.col("size") * num / den)  # so many a linked set shares
    own = Window.partitionBy("name")
    kept = shared.withColumn("nth", F.row_number().over(own.orderBy(F.desc("sets"), "shingle"))).withColumn("of", F.count("*").over(own))
    kept = kept.where((F.col("of") >= least) & (F.col("nth") >= least)).select("shingle", "name")
    stars = kept.select(F.min("name").over(Window.partitionBy("shingle")).alias("a"), F.col("name").alias("b")).where("a <> b").distinct()
    return _regrouped(large, components(stars))


_ROWS = 1 << 18


def _short_digest(g: np.ndarray) -> int:
    """Spark's xxhash64 of the set's digest, so that both sides name a set alike."""
    return _spark_xxhash64(xxhash.xxh3_128_digest(g.tobytes()))


def _spark_xxhash64(b: bytes) -> int:
    v = xxhash.xxh64_intdigest(b, seed=42)
    return v - (1 << 64) if v >> 63 else v
