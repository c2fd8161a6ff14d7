"""A corpus pipeline of five stages over `documents`.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's input.  All stages but the last return the columns of
`documents`; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonewright.llm import jaccard, packing, quality, secrets, toxicity
from tonewright.llm.shared import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The stages have no SQL form (trained scores, set similarity); tests compare with brute force.
ORACLE_SQL: str | None = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go.  Null and empty texts score as texts without a match and
    stay; a null id is scored like any other, a repeated row each time; very long texts are read
    whole; columns besides those of `documents` are dropped; an empty table gives no rows."""
    model = toxicity.train(docs, _labels(spark, sf_dir))
    return toxicity.with_score(docs, model).where("toxicity < 0.5").select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under 0.5 go; sites are source and, within it, language.
    A null text is measured as empty, a null source or language is a site of its own; repeated
    rows count and are decided each; other columns are dropped; an empty table gives no rows."""
    return quality.classify(docs, _labels(spark, sf_dir), F.col("source"), F.col("lang")).where("quality_keep").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles the
    one with the smallest id stays, repeated rows (same id and text) once: the first by
    language, source and n_chars, nulls first.  Texts without a word, and rows without an id,
    are linked with nothing and stay.  Where an id repeats with other texts, all texts of the
    kept id stay: none of them is known to be the copy.  Long texts are compared whole; other
    columns are dropped; an empty table gives no rows."""
    groups = jaccard.jaccard_groups(docs, n=5, num=80, den=100)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept")).distinct()
    stay = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("kept"), "left_semi").unionByName(docs.where("doc_id is null"))
    # repeats meet by a digest of the text, on the partitioning of the join
    stay = stay.select(*COLUMNS, F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.col("text").isNull().alias("none"))
    first = Window.partitionBy("doc_id", "digest", "none").orderBy("lang", "source", "n_chars")
    return stay.withColumn("nth", F.row_number().over(first)).where("nth = 1").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts and n_chars is counted anew; no document goes.  Texts
    without a secret, null ones too, are unchanged; overlapping spans are replaced once;
    repeated rows each; other columns are dropped; an empty table gives no rows."""
    clean = secrets.redact(secrets.scan(docs))
    return clean.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences of 1,024.  A null or empty text is its end token; repeated
    rows and null ids are packed each; long texts are cut, never shortened; other columns are
    not kept; an empty table gives no pieces."""
    return packing.pack(docs, TOKENIZER, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each),
    ("secret scans", redact_secrets),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
