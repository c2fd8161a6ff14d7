"""Quality by hierarchical empirical Bayes.

A classifier over a text's surface gives the evidence of the document itself, as log odds
against the share of good rows it was trained on.  Hosts and paths give the prior: for
every site the expected number of good documents is summed, a host's rate is shrunk
towards the global rate and a path's rate towards its host's, each with a strength
estimated from how much rates differ between sites beyond chance (method of moments).
Sparse sites so keep the rate above them.  A document does not count in its own prior.
Score = logistic(evidence + logit of the path's rate).

`SAMPLE_ROWS` bounds the labelled rows the classifier is fitted on; all sites are counted
over all documents by grouped sums with map-side combining, one row per site.

Defined results: null text is empty; null hosts or paths are a site of their own; without
labels of both kinds the evidence is 0 and everything is kept; repeated rows count as
often as they occur; equal texts of one site score alike; texts of any length are measured
whole; other columns pass through, whatever their names, but for those of the results,
which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.llm.learning import labelled_sample, logistic
from tonewright.llm.shared import discard, stored, unused

SAMPLE_ROWS = 12_000
_SYMBOL_RUN = re.compile(rb"[*&%$#|!?=~^+<>@_-]{2,}")
NAMES = ("letters", "upper", "digits", "spaces", "lines", "stops", "marks", "other", "runs", "word", "distinct", "longline", "size", "repeat", "entropy", "tables")


def surface(text: str) -> list[float]:
    """Rates of kinds of bytes, and the shape of words and lines."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(NAMES)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    upper, lower = h[65:91].sum(), h[97:123].sum()
    marks = sum(int(h[ord(c)]) for c in "*&%$#|!?=~^+<>@_")
    p = h[h > 0] / n
    w = max(len(words), 1)
    return [
        (upper + lower + h[128:].sum()) / n,
        upper / max(upper + lower, 1),
        h[48:58].sum() / n * 10,
        h[32] / n,
        np.log1p(len(lines)) / 5,
        (h[ord(".")] + h[ord(",")]) / w,
        min(marks / w, 2.0),
        (h[:32].sum() - h[10]) / n * 10,
        min(len(_SYMBOL_RUN.findall(raw)) / w, 2.0),
        min(n / w, 30) / 10,
        len(set(words)) / w,
        min(max(map(len, lines)) / n, 1.0),
        np.log1p(w) / 10,
        1 - len(set(lines)) / len(lines),
        float(-(p * np.log2(p)).sum()) / 5,
        min(int(h[ord("|")]) / w, 1.0),
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """Squares and products, as junk of different kinds lies on different sides."""
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([x, x[:, i] * x[:, j]])


@dataclass
class Evidence:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    rate: float

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Log odds that a text is good, without the training rows' share of good ones."""
        if self.weights is None or not texts:
            return np.zeros(len(texts))
        x = (np.array([surface(t or "") for t in texts]) - self.mean) / self.scale
        z = expand(np.clip(x, -6, 6)) @ self.weights[:-1] + self.weights[-1]
        return np.clip(z - np.log(self.rate / (1 - self.rate)), -30, 30)


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Evidence:
    sample = labelled_sample(docs, labels, "quality", rows, keep, id_col, text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([list(map(float, surface(t or ""))) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    got = sample.select("text", "y").mapInArrow(measure, "x array<double>, y int").collect()
    discard(sample)
    y = np.array([float(r.y > 0) for r in got])
    if len(set(y.tolist())) < 2:
        return Evidence(np.zeros(len(NAMES)), np.ones(len(NAMES)), None, 0.5)
    x = np.array([r.x for r in got])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    return Evidence(mean, scale, logistic(expand(np.clip((x - mean) / scale, -6, 6)), y, ridge=3.0), float(np.clip(y.mean(), 0.01, 0.99)))


def with_evidence(docs: DataFrame, evidence: Evidence, text_col: str = "text", name: str = "__z") -> DataFrame:
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{name}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = evidence(b.column(b.schema.get_field_index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(z, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, within: Column) -> float:
    """Prior strength by moments: how far the rates s/n of `groups` spread around `within`
    beyond the chance of n draws; between 1 and 10,000 draws."""
    r = (
        groups.where("n > 0")
        .agg(
            F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - within, 2)).alias("spread"),
            F.sum(within * (1 - within)).alias("chance"),
            F.sum(F.col("n") * within * (1 - within)).alias("mass"),
        )
        .first()
    )
    if r is None or r.spread is None or not r.mass:
        return 10_000.0
    beyond = (r.spread - r.chance) / r.mass  # variance of rates over m (1 - m)
    return float(np.clip(1 / beyond - 1, 1.0, 10_000.0)) if beyond > 0 else 10_000.0


def site_posteriors(scored: DataFrame, rate: float, host: str = "__host", path: str = "__path", z: str = "__z") -> tuple[DataFrame, dict[str, float]]:
    """One row per (host, path): the sums n and s, the host's and the path's posterior rates,
    and what is needed to leave one document out."""
    p = 1 / (1 + F.exp(-(F.col(z) + float(np.log(rate / (1 - rate))))))
    paths = stored(scored.groupBy(host, path).agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("s")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    m = float(np.clip((total.s or 0.0) / total.n, 1e-3, 1 - 1e-3)) if total.n else rate
    hosts = stored(paths.groupBy(host).agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    k = _strength(hosts, F.lit(m))
    post = stored(hosts.select(F.col(host).alias("__h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + k * m) / (F.col("n") + k)).alias("host_rate")), "posts")
    both = paths.join(post, F.col(host).eqNullSafe(F.col("__h"))).drop("__h")
    k2 = _strength(both, F.col("host_rate"))
    return stored(both, "sites"), {"rate": m, "host_strength": k, "path_strength": k2}


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5, keep: Column | None = None, text_col: str = "text", evidence: Evidence | None = None) -> DataFrame:
    """`docs` with evidence, host_posterior, path_posterior, quality_score and quality_keep
    (columns of these names are replaced)."""
    new = ["evidence", "host_posterior", "path_posterior", "quality_score", "quality_keep"]
    evidence = evidence or fit(docs, labels, keep, text_col=text_col)
    h, p, z, hs, ps, site = (unused(docs, f"__{c}") for c in ("host", "path", "z", "site_host", "site_path", "site"))
    rows = docs.drop(*new).withColumns({h: host, p: path})
    scored = with_evidence(rows, evidence, text_col, z)
    bare = rows.select(F.col(h).alias("__host"), F.col(p).alias("__path"), F.col(text_col).alias("text"))
    sites, c = site_posteriors(with_evidence(bare, evidence, "text"), evidence.rate)
    m, k, k2 = c["rate"], c["host_strength"], c["path_strength"]
    own = 1 / (1 + F.exp(-(F.col(z) + float(np.log(evidence.rate / (1 - evidence.rate))))))
    host_rate = (F.greatest(F.col(site)["host_s"] - own, F.lit(0.0)) + k * m) / (F.col(site)["host_n"] - 1 + k)
    path_rate = (F.greatest(F.col(site)["s"] - own, F.lit(0.0)) + k2 * F.col("host_posterior")) / (F.col(site)["n"] - 1 + k2)
    sites = sites.select(F.col("__host").alias(hs), F.col("__path").alias(ps), F.struct("n", "s", "host_n", "host_s").alias(site))
    return (
        scored.join(sites, F.col(h).eqNullSafe(F.col(hs)) & F.col(p).eqNullSafe(F.col(ps)))
        .withColumn("host_posterior", host_rate)
        .withColumn("path_posterior", path_rate)
        .withColumn("evidence", F.col(z))
        .withColumn("quality_score", 1 / (1 + F.exp(-(F.col(z) + logit(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_posterior"))))))))
        .withColumn("quality_keep", F.col("quality_score") >= threshold)
        .select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *new)
    )
