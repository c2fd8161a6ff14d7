"""The single pass over a unit's text against column expressions."""

import random
import time

import pytest
from pyspark.sql import functions as F
from second_opinion import unit_stats_by_columns

from tonewright.functions import scan, stats, text

UNIT = "unit_id string, locale string, strings array<string>, headings array<string>"
BITS = [
    "Dr.", "J.", "É.", "e.g.", "etc.", "x.", "No.", "go", "It", "is", "Was", "shown", "cached", "ed", "been", "put", "a", "b,", ",", "and", "or", "c", "don't", "we’ll", "o's's", "I'm's",
    "!", "?!", "...", '."', "(?)", "»", "]", "—", "-", "- -", " - - - ", "–", ";", ":", "you", "Ihr", "já", "mne", "wir", "very", "maybe", "create", "Add", "over-promise", "it's-", "été", "naïve",
    "İstanbul", "K", "😀", "☎", "©", "日本", "9th", "½", "\n", "\n\n", "\n \t\n", "\r\n", " ", " ", "\t", "  ", "accessibility", "newsletters", "yes", "played", "rules", "_x_", "and\nor", "x,and", "a ,b ,or c",
]


def some(seed, n):
    r = random.Random(seed)
    say = lambda k: "".join(r.choice(BITS) + r.choice(["", " ", " ", " ", "\n"]) for _ in range(r.randrange(k)))
    return [(f"u{k}", r.choice(["en", "en-US", "EN-gb", "de", "cs-CZ", "fr", ""]), [say(30) for _ in range(r.randrange(5))], [say(7) for _ in range(r.randrange(4))]) for k in range(n)]


def compare(units):
    one, two = (sorted((r.asDict() for r in f(units).collect()), key=lambda r: r["unit_id"]) for f in (stats.unit_stats, unit_stats_by_columns))
    for a, b in zip(one, two, strict=True):
        assert a == b, {k: (a[k], b[k]) for k in a if a[k] != b[k]}


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_pass_equals_columns(spark, monkeypatch, most):
    monkeypatch.setattr(scan, "MOST", most)
    compare(spark.createDataFrame(some(most, 500), UNIT).repartition(3))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    compare(docs.select(F.col("doc_id").cast("string").alias("unit_id"), F.col("lang").alias("locale"), F.array(F.coalesce("text", F.lit(""))).alias("strings"), F.split("source", "a").alias("headings")))


def test_awkward_units(spark):
    rows = [("a", "en", None, None), ("b", None, ["Hi. You."], []), ("c", "en", [None, "", " \n"], [None]), ("d", "en", [], [])]
    got = {r.unit_id: r for r in stats.unit_stats(spark.createDataFrame(rows, UNIT)).collect()}
    assert [got[k].strings for k in "abcd"] == [0, 1, 3, 0] and [got[k].sentences for k in "abcd"] == [0, 2, 0, 0]
    assert got["b"].second_person == 0 and not got["b"].has_english and got["c"].paragraphs == 0
    assert stats.unit_stats(spark.createDataFrame([], UNIT)).count() == 0


def test_one_long_unit(spark):
    long = "We made it. " * 100_000
    r = stats.unit_stats(spark.createDataFrame([("a", "en", [long], [])], UNIT)).first()
    assert (r.words, r.sentences, r.first_person, r.paragraphs) == (300_000, 100_000, 100_000, 1)


def test_syllables_of(spark):
    words = ["the", "campaign", "newsletter", "marketing", "accessibility", "scheduled", "yes", "played", "rules", "İst", "K", "naïve", "a", "42", "yellow", "queue"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(text.syllables(F.col("w"))).collect()
    assert [scan.syllables_of(w) for w in words] == [r[0] for r in got]


def test_constant_cost_a_code_point():
    """Ten times the text takes about ten times as long, however it is cut."""
    words, part = scan.Words(), [["We made it, and it was shown. " * 200]]
    scan.count(part, [[]], ["en"], words)
    took = []
    for k in (20, 200):
        began = time.process_time()
        scan.count(part * k, [[]] * k, ["en"] * k, words)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0]
