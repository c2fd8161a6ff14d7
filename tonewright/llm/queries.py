"""The registered queries of this subpackage: each applies its operator, with production
parameters, to its whole table and derives the contract's columns from the real outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm import bpe, embeddings, jaccard, licenses, lm, media, packing, quality, secrets, spelling, sql, topk, toxicity, whitening

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.backoff_scores(table(spark, sf_dir, "documents"))
    # sums of logarithms differ in their last digits with the order of addition
    return scores.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER, digest_only=True)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.media_columns(table(spark, sf_dir, "documents")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["number"] < len(secrets.BASE))
    named = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.size(F.filter("secrets", lambda s: s["number"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{r.kind}") for k, r in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("secrets")).alias("spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang")).drop("text")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def held_out() -> Column:
    # a null id has no text: its sum is that of no bytes
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), keep=~held_out())
    scored = toxicity.with_score(docs, model, score_col="score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


_ALL = (op1_license_scan, op2_lm_score, op3_embedding_dedup, op4_bpe, op5_packing, op6_media, op7_secret_scan, op8_quality, op9_jaccard_join, op10_toxicity, op11_spelling_variants, op12_topk_search, op13_whitening)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = dict(sql.ORACLES)
