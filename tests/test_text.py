import pytest
from pyspark.sql import functions as F

from tonewright.functions import stats, text

UNIT = "unit_id string, locale string, strings array<string>, headings array<string>"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("Your campaign is scheduled. Nice work! Ready?", ["Your campaign is scheduled.", "Nice work!", "Ready?"]),
        ("Ask Dr. Smith about it.", ["Ask Dr. Smith about it."]),
        ("Contact J. Smith today.", ["Contact J. Smith today."]),
        ("Use commas, semicolons, etc. Then stop.", ["Use commas, semicolons, etc. Then stop."]),
        ('She said "go." Then she left.', ['She said "go."', "Then she left."]),
        ("", []),
    ],
)
def test_sentences(spark, value, expected):
    assert one(spark, text.sentences, value) == expected


def test_words(spark):
    assert one(spark, text.words, "Don't over-promise, prosím.") == ["Don't", "over-promise", "prosím"]
    assert one(spark, text.words, "--- *** 42") == ["42"]


def test_syllables(spark):
    words = {"the": 1, "campaign": 2, "newsletter": 3, "marketing": 3, "accessibility": 6, "": 0, "scheduled": 3}
    assert {w: one(spark, text.syllables, w) for w in words} == words


def fp(spark, strings, headings=(), locale="en"):
    df = spark.createDataFrame([("u", locale, list(strings), list(headings))], UNIT)
    return stats.fingerprint(df, "locale").first().asDict()


def test_universal_metrics(spark):
    f = fp(spark, ["Your campaign is scheduled.", "Nice work!", "Want to schedule another one?", "We sent it - the report is ready; check your inbox."])
    assert (f["sentence_count"], f["word_count"]) == (4, 21)
    assert (f["exclamation_rate"], f["question_rate"], f["emoji_per_1000"]) == (0.25, 0.25, 0.0)
    assert f["semicolon_per_1000"] > 0


def test_golden_fixture(spark):
    f = fp(spark, ["A", "We leverage it. One thing worth knowing."])
    assert (f["mean_sentence_length"], f["median_sentence_length"], f["mean_word_length"], f["reading_grade"]) == (2.67, 3.0, 4.13, 1.68)


def test_headings_and_markers(spark):
    assert fp(spark, ["x"], ["Schedule A Campaign", "Schedule a campaign", "Reports", "Set Up Billing"])["heading_title_case_ratio"] == 0.667
    heads = ["Kunden Berichte", "Neue Einstellungen"]
    assert fp(spark, ["x"], heads)["heading_title_case_ratio"] == 1.0
    assert fp(spark, ["x"], heads, "de")["heading_title_case_ratio"] is None
    assert fp(spark, ["Neco tady je."], locale="xx")["first_person_per_1000"] is None


def test_empty_unit_is_null(spark):
    f = fp(spark, [])
    assert f["sentence_count"] == 0 and f["mean_sentence_length"] is None and f["sentence_length_sd"] is None


def test_oxford(spark):
    assert fp(spark, ["Email, social, and web."])["oxford_comma_rate"] == 1.0
    assert fp(spark, ["Email, social and web."])["oxford_comma_rate"] == 0.0
    assert fp(spark, ["Just one thing."])["oxford_comma_rate"] is None


def test_english_block(spark):
    f = fp(spark, ["We didn't send it.", "The report was generated by the system.", "Open the settings page.", "This might possibly work.", "It is very extremely good."])
    for k in ("contraction_per_1000", "passive_rate", "imperative_opener_rate", "hedge_per_1000", "intensifier_per_1000", "reading_grade"):
        assert f[k] > 0


def test_sd_and_median(spark):
    assert fp(spark, ["One two.", "One two three four.", "One two three four five six."])["sentence_length_sd"] == 1.63
    assert fp(spark, ["One two.", "One two three.", "One two three four."])["median_sentence_length"] == 3.0


def test_merge_is_sum_of_parts(spark):
    """Statistics of any partition of the units merge to those of all units."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    units = docs.select(F.col("doc_id").cast("string").alias("unit_id"), F.col("lang").alias("locale"), F.array("text").alias("strings"), F.array().cast("array<string>").alias("headings"), "source")
    s = stats.unit_stats(units, ("unit_id", "locale", "source"))
    whole = {r.locale: r for r in stats.merge_stats(s, "locale").collect()}
    parts = {r.locale: r for r in stats.merge_stats(stats.merge_stats(s, "locale", "source"), "locale").collect()}
    assert whole == parts and len(whole) == 4


def test_mixed_languages_are_refused(spark):
    df = spark.createDataFrame([("a", "en", ["One two."], []), ("b", "cs", ["Vase kampan."], [])], UNIT)
    s = stats.unit_stats(df).withColumn("all", F.lit(1))
    with pytest.raises(Exception, match="cannot be merged"):
        stats.merge_stats(s, "all").collect()


def test_syllable_counts(spark):
    words = ["the", "campaign", "don't", "42", "yes", "yelled", "rhythm", "Scheduled", "éa", "pfft", "yxed", "queue", "bees"]
    df = spark.createDataFrame([(words,), ([],)], "w array<string>")
    got = df.select(text.syllable_counts(F.col("w")), F.transform("w", text.syllables)).collect()
    assert got[0][0] == got[0][1] and got[1][0] == []
