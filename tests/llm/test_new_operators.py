"""Spelling variants, exact search and whitening against plain definitions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.llm import queries, spelling, topk, whitening

DOCS, VECS = "doc_id long, text string", "vec_id long, embedding array<double>"


# --- spelling variants


def plain_groups(rows):
    """The groups by the words of the definition, every pair compared."""
    n = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    words = sorted(w for w, k in n.items() if k >= 2 and len(w) >= 7)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w in words:
        others = [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        out[w] = [n[w], len(others)]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w], n[form[w]] if form[w] else None)
    return out


def some_words(seed):
    r = random.Random(seed)
    bases = ["millwheel", "aabbaabb", "éèçaßöñ", "harvester", "x" * 80, "ab" * 40]
    rows = []
    for k in range(60):
        words = []
        for _ in range(r.randrange(60)):
            w = r.choice(bases)
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abxéZ") + w[at:], w[:at] + r.choice("abxé") + w[at + 1 :]])
            words.append(w)
        rows.append((k, r.choice([" ", "-", "\n"]).join(words)))
    many = "millwheel " * 400 + "millwheex " * 30 + "millwheexx " * 2 + "millwheexx"
    return [*rows, (90, None), (91, ""), (None, "millwheel harvester"), (92, many), (92, many), (93, "a" * 30_000), (93, "a" * 30_000), (94, "12×÷34 naïveté")]


def test_spelling_groups(spark):
    rows = some_words(1)
    df = spark.createDataFrame(rows, DOCS).withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).repartition(5)
    got = spelling.spelling_groups(df).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_groups(rows) and len(got) == len({r.word for r in got})
    assert any(r.root not in (r.form, r.word) for r in got)  # a chain of two forms
    assert spelling.spelling_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_crc_is_carried():
    r = random.Random(2)
    for length in (0, 1, 7, 40, 1000):
        a, b = r.randbytes(5), r.randbytes(length)
        t, c = spelling._shift(length), zlib.crc32(a)
        assert zlib.crc32(a + b) == int(t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]) ^ zlib.crc32(b)


def test_deletion_keys_are_hashes_of_shorter_words():
    r = random.Random(3)
    words = ["".join(r.choice("abé") for _ in range(r.randrange(2, 12))) for _ in range(200)]
    every = sorted({*words, *(w[:i] + w[i + 1 :] for w in words for i in range(len(w)))} - {""})
    hashes = lambda ws: spelling.deletion_keys(np.array([ord(c) for w in ws for c in w]), np.concatenate([[0], np.cumsum([len(w) for w in ws])]))
    whole = dict(zip(every, hashes(every)[0].tolist(), strict=True))
    assert len(set(whole.values())) == len(every)
    gone = iter(hashes(words)[1].tolist())
    assert all(next(gone) == whole[w[:i] + w[i + 1 :]] for w in words for i in range(len(w)))


def test_equal_keys_of_other_strings_do_not_link():
    members = [(0, "axyzxyz", 3), (-1, "xyzxyz", 5)]
    assert sorted(spelling.near_in_group(members)) == [("axyzxyz", 1, 5, "xyzxyz"), ("xyzxyz", 1, 3, "axyzxyz")]


# --- exact search


def plain_top(rows, k=5):
    ok = {(i, tuple(math.floor(256 * c) if abs(c) < 1e300 else int(c) * 256 for c in v)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = set()
    for q, x in ok:
        if q % 50 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ok if i != q and len(x) == len(y))[:k]
            out |= {(q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("spread", [1, 40])
def test_top_k(spark, spread):
    r = random.Random(spread)
    rows = [(k, [r.gauss(0, spread) for _ in range(6)]) for k in range(400)]
    rows += [(1000 + k, [0.5] * 6) for k in range(300)]  # equal vectors, more than are kept
    rows += [(-50, None), (2000, [None] * 6), (2050, [math.nan] * 6), (2100, [math.inf] * 6), (2150, []), (2151, []), (2200, [0.0] * 6), (None, [1.0] * 6), (2250, [1e308, -1e308]), (2300, [1e308, 1e308]), (2301, [-1e308, 1.0]), (2350, [1e5] * 6), (2400, [1.0]), rows[0], rows[50]]
    df = spark.createDataFrame(rows, VECS).withColumn("x", F.lit(1)).withColumn("rank", F.lit(2)).repartition(7)
    got = [tuple(x) for x in topk.top_k(df, F.col("vec_id") % 50 == 0, shard=100).collect()]
    assert set(got) == plain_top(rows) and len(got) == len(set(got))
    assert topk.top_k(spark.createDataFrame([], VECS), F.lit(True)).count() == 0


def test_threshold_stops_early():
    """Where few components matter the walk ends long before the lists do."""
    r = np.random.default_rng(4)
    x = np.floor(r.standard_normal((5000, 3)) * 256 * np.array([1, 0.05, 0.05]))
    lists = topk.Lists(x, np.arange(5000))
    touched = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.ndim == 1:
                touched.append(len(at))
            return np.asarray(super().__getitem__(at))

    lists.x = x.view(Counted)
    rows, scores = lists.best(np.array([300.0, 1.0, -1.0]), 6)
    every = x @ np.array([300.0, 1.0, -1.0])
    want = np.lexsort((np.arange(5000), -every))[:6]
    assert rows.tolist() == want.tolist() and scores.tolist() == every[want].tolist() and sum(touched) < 500


# --- whitening


@pytest.mark.parametrize("n", [1, 2, 3, 12, 64])
def test_symmetric_qr(n):
    r = np.random.default_rng(n)
    for a in (r.standard_normal((n, n)), np.ones((n, n)), np.zeros((n, n)), np.diag(np.arange(n)), 1e8 * r.integers(0, 2, (n, n))):
        a = a + a.T
        values, vectors = whitening.symmetric_qr(a)
        scale = max(1.0, np.abs(a).max()) * n
        assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1], atol=1e-13 * scale)
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-13) and np.allclose(a @ vectors, vectors * values, atol=1e-13 * scale)


def test_moments_merge():
    r = np.random.default_rng(6)
    x = r.standard_normal((500, 4)) * 30 + 100_000
    parts = [whitening.Moments(4) for _ in range(3)]
    for k, row in enumerate(x):
        parts[k % 2].add(row)
    whole = whitening.Moments(4)
    for p in parts:
        whole.merge(p.n, p.mean, p.spread, p.sums)
    assert np.allclose(whole.covariance(), np.cov(x.T, bias=True), rtol=1e-12)


def check_whitening(got, rows, d):
    ok = [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in ok], object)
    n, s = len(ok), x.sum(0)
    centred = (n * x - s).astype(float) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    by = {}
    for g in got:
        by.setdefault(g.vec_id, {})[g.component] = g
    assert {i for i, _ in ok} == set(by) and all(len(v) == min(8, d) for v in by.values())
    w = np.array([[by[i][c + 1].whitened for c in range(min(8, d))] for i, _ in ok])
    want = centred @ vectors[:, : min(8, d)] / np.sqrt(values[: min(8, d)])
    sign = np.sign((w * want).sum(0))
    assert np.allclose(w, want * sign, rtol=1e-8, atol=1e-8)
    for (i, _), row in zip(ok, x, strict=True):
        assert by[i][1].deviation == sum(int(v) ** 2 for v in n * row - s) and by[i][1].n == n
    assert np.allclose([by[ok[0][0]][c + 1].explained for c in range(min(8, d))], values[: min(8, d)] / np.trace(cov), rtol=1e-9)
    off = np.abs(np.cov(w.T, bias=True) - np.eye(w.shape[1])).max()
    errors = {g.identity_error for g in got}
    assert len(errors) == 1 and off < 1e-8 and errors.pop() < 1e-8


def test_whiten(spark):
    r = np.random.default_rng(7)
    mix = r.standard_normal((10, 10))
    rows = [(k, (r.standard_normal(10) @ mix / 8).tolist()) for k in range(300)]
    bad = [(900, None), (901, [None] * 10), (902, [math.nan] * 10), (903, [math.inf] * 10), (904, [])]
    df = spark.createDataFrame(rows + bad, VECS).withColumn("w", F.lit("x")).withColumn("dim", F.lit(1)).repartition(6)
    check_whitening(whitening.whiten(df).collect(), rows, 10)
    assert whitening.whiten(spark.createDataFrame([], VECS)).count() == 0


def test_whiten_awkward(spark):
    """Lengths apart, no variance, one row, huge entries, null ids and repeated rows."""
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.0]), (5, [1.0, 1.0, 1.0]), (6, [1e300]), (7, [-1e300])]
    got = whitening.whiten(spark.createDataFrame(rows, VECS)).collect()
    assert Counter(g.n for g in got) == {3: 6, 1: 3, 2: 2}
    two = [g for g in got if g.n == 3]
    assert {g.explained for g in two} == {1.0, 0.0} and all((g.whitened is None) == (g.component == 2) for g in two)
    assert sorted(abs(round(g.whitened, 9)) for g in two if g.component == 1) == [0.707106781, 0.707106781, 1.414213562]
    assert {g.deviation for g in got if g.n == 2} == {None} and all(g.whitened is None for g in got if g.n == 1)
    assert [g.vec_id for g in two].count(None) == 2


def test_op13_whole_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>")).collect()]
    check_whitening(queries.op13_whitening(spark, path).collect(), rows, 64)
