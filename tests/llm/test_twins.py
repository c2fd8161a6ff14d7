"""SQL twins of the subpackage, and awkward rows alone in their partitions."""

import duckdb
import pytest

from tonewright.llm import queries

DIR = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "a", "a b", "a b c", "A b C", "a b c d", "\n\t", "é"]
VECTORS = [None, [], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0], [2.0, 4.0], [1.0], [-1.0, -2.0]]


def plain(v):
    return "null" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)


def same(df, con, sql):
    cols, rel = sorted(df.columns), con.sql(sql)
    assert cols == sorted(rel.columns)
    want = sorted([plain(r[rel.columns.index(c)]) for c in cols] for r in rel.fetchall())
    assert sorted([plain(r[c]) for c in cols] for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    same(queries.QUERIES[name](spark, DIR), con, queries.ORACLES[name])


def apart(spark, tmp_path, docs, vectors):
    """Tables of one row a file, each a partition of its own."""
    for k, text in enumerate(docs):
        spark.createDataFrame([(k, text, "en", "web", 1)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    for k, v in enumerate(vectors):
        spark.createDataFrame([(k * 10, v, 0)], "vec_id long, embedding array<float>, label int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(3, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")


@pytest.fixture(scope="module")
def rows_apart(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("apart")
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    apart(spark, at, TEXTS, VECTORS)
    yield str(at)
    spark.conf.set("spark.sql.files.openCostInBytes", was)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_rows_apart(spark, rows_apart, name):
    """No row ends a job by being alone in its task; twins agree on these rows as well."""
    df = queries.QUERIES[name](spark, rows_apart)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.sql(f"create view {t} as select * from '{rows_apart}/{t}.parquet/*.parquet'")
        same(df, con, queries.ORACLES[name])
    else:
        df.collect()
