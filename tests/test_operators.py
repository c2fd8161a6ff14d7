import pytest
from pyspark.sql import functions as F

from tonewright.operators import diff, drift, gaps, index, overlay, quality_gate, rules, tone
from tonewright.functions import vocab as V
from tonewright.queries import grid, rule_bases

IDX = "sha256 string, entry_id string, origin string, aliases array<string>, kind string, locale string, status string, produced array<string>"


def idx(spark):
    rows = [("a", "f001", "x.txt", ["y.txt"], "file", "en", "used", ["V1"]), ("b", "f002", "z.txt", [], "file", "en", "used", ["L1"]), ("c", "f003", "u", [], "url", "en", "used", []), ("d", "f004", "gone.txt", [], "file", "en", "skipped", [])]
    return spark.createDataFrame(rows, IDX)


def resolved(spark):
    return spark.createDataFrame([("x.txt", "a", "en"), ("y.txt", "a", "de"), ("copy.txt", "a", "en"), ("z.txt", "bb", "en"), ("new.txt", "n", "en")], "origin string, sha256 string, locale string")


def test_index_classes_are_disjoint(spark):
    got = {r.origin: r["class"] for r in index.classify(idx(spark), resolved(spark)).collect()}
    assert got == {"x.txt": "known", "y.txt": "known", "copy.txt": "duplicate", "z.txt": "stale", "new.txt": "fresh"}


def test_index_missing_and_supersede(spark):
    cls = index.classify(idx(spark), resolved(spark))
    gone = index.missing(idx(spark), cls)
    assert [r.entry_id for r in gone.collect()] == ["f004"]
    assert {r.entry_id: r.status for r in index.mark_missing(idx(spark), gone).collect()}["f004"] == "skipped"
    new, displaced = index.supersede(idx(spark), cls)
    rows = {r.origin: r for r in new.collect()}
    assert rows["z.txt"].entry_id == "f005" and rows["z.txt"].sha256 == "bb" and rows["z.txt"].produced == []
    assert [r.entry_id for r in displaced.collect()] == ["f002"]


def test_upsert_keeps_id_and_records_alias(spark):
    e = spark.createDataFrame([("a", "f900", "moved.txt", [], "file", "cs", "used", [])], IDX)
    r = {x.sha256: x for x in index.upsert(idx(spark), e).collect()}["a"]
    assert (r.entry_id, r.origin, r.aliases, r.locale) == ("f001", "moved.txt", ["x.txt", "y.txt"], "cs")


def test_reattribute_takes_first_path(spark):
    got = {r.entry_id: (r.locale, r.relocated) for r in index.reattribute(idx(spark), resolved(spark)).collect()}
    assert got["f001"] == ("en", False)


def test_forget(spark):
    kept, reopened = index.forget(idx(spark), spark.createDataFrame([("f001",)], "entry_id string"))
    assert kept.count() == 3 and [r.rule_id for r in reopened.collect()] == ["V1"]


def test_contributing_refuses_broken_rows(spark):
    bad = spark.createDataFrame([("used", None, "en")], "status string, stats int, locale string")
    with pytest.raises(Exception, match="lacks"):
        index.contributing(bad).collect()


def test_rule_hits(spark):
    rs = rules.rules_frame(spark, [{"id": "L01", "confidence": "derived", "avoid": "leverage"}, {"id": "L02", "confidence": "confirmed", "avoid": "simply"}, {"id": "L03", "confidence": "confirmed", "avoid": "utilize"}, {"id": "M09", "pattern": "(["}, {"id": "M01", "pattern": r"\s{2,}"}])
    u = spark.createDataFrame([("1", "Leverage the tool.\nWe simply leverage it.\nLeveraged is a different word."), ("2", "one  two\nthree  four")], "unit_id string, t string")
    got = {r.id: r.hits for r in rules.hits(u, rs).collect()}
    assert got == {"L01": 2, "L02": 1, "L03": 0, "M09": 0, "M01": 2}


def test_rank(spark):
    c = spark.createDataFrame([("L01", "derived", 5), ("L02", "confirmed", 5), ("L03", "confirmed", 0), ("L04", "disputed", 9)], "id string, confidence string, hits long")
    assert [r.id for r in rules.rank(c).collect()] == ["L02", "L01", "L03"]


@pytest.mark.parametrize(
    ("text", "locale", "fmt", "reasons"),
    [
        ("a b c d e f g h i j", "xx", None, ["singleShare"]),
        ("a b c d e f g h i j", "xx", "text", []),
        ("�" * 20 + " word", "en", None, ["replShare"]),
        ("", "en", None, ["empty"]),
        ("x" * 25 + " and then nine more words of sound prose follow here", "en", None, ["longTokenShare"]),
        ("x" * 25 + " and then nine more words of sound prose follow here", "de", None, []),
    ],
)
def test_quality_gate(spark, text, locale, fmt, reasons):
    df = spark.createDataFrame([(text, locale, fmt)], "text string, locale string, format string")
    assert quality_gate.score(df, fmt="format").first().reasons == reasons


def test_tone_matrix(spark):
    house = {(r.context, r.state): r for r in grid(spark).collect()}
    r = house["system-error", "frustrated"]
    assert tuple(r[d] for d in V.DIALS) == (1, 0, 4, 3, 2, 2)
    assert house["social", "curious"].humor == 2 and house["email", "frustrated"].humor == 0 and len(house) == 80
    speaker = dict(zip(V.DIALS, (-1, 0, 1, 1, -1, 1), strict=True))
    r = {(x.context, x.state): x for x in grid(spark, speaker).collect()}["system-error", "frustrated"]
    assert tuple(r[d] for d in V.DIALS) == (0, 0, 4, 4, 1, 3)


def test_overlay(spark):
    merged = overlay.merge_rules(*rule_bases(spark)).orderBy("part", "ord").collect()
    assert [(r.id, r.origin, r.locked, r.overrides) for r in merged] == [("L20", "house", True, False), ("M01", "house", False, False), ("V3", "speaker", False, False), ("L01", "speaker", False, True), ("L30", "speaker", False, False), ("V2", "house", True, False)]
    assert [r.id for r in overlay.lock_violations(*rule_bases(spark)).collect()] == ["L20"]


def test_delta(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (2.0, 3.0), (None, 1.0), (-2.0, -1.0)], "a double, b double")
    assert [r[0] for r in rows.select(drift.delta_pct(F.col("a"), F.col("b"))).collect()] == [0.0, None, 50.0, None, 50.0]


def brute(a, b):
    """Lengths of common subsequences of all suffixes, by definition."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("equal", a[i]))
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or t[i + 1][j] >= t[i][j + 1]):
            out.append(("remove", a[i]))
            i += 1
        else:
            out.append(("add", b[j]))
            j += 1
    return out


def test_diff_against_definition():
    import random

    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(9))] for _ in range(2))
        assert [(k, w) for k, ws in diff.steps(a, b) for w in ws] == brute(a, b)


def test_diff_of_many_rows_against_definition():
    import random

    r = random.Random(5)
    for k in range(40):
        a, b = ([r.choice("abcdefgh"[: 2 + k % 7]) for _ in range(r.randrange(60, 200))] for _ in range(2))
        end = a[: k % 5]
        assert [(x, w) for x, ws in diff.steps(a + end, b + end) for w in ws] == brute(a + end, b + end)


def test_diff_of_long_texts(spark):
    draft = [f"w{k}" for k in range(10_001)]
    final = [f"new{k}" if k % 100 == 0 else w for k, w in enumerate(draft)]
    (got,) = diff.diff(spark.createDataFrame([(" ".join(draft), " ".join(final))], "draft string, final string")).collect()
    assert [(s["from"], s["to"]) for s in got.word_swaps] == [(f"w{k}", f"new{k}") for k in range(0, 10_001, 100)]
    assert (got.removed, got.added, got.unchanged) == (101, 101, 9_900)


def test_diff_summary(spark):
    df = spark.createDataFrame([("We simply leverage it now.", "We simply use it."), ("", "a b"), (None, None)], "draft string, final string")
    got = diff.diff(df).collect()
    assert [(s["from"], s["to"]) for s in got[0].word_swaps] == [("leverage", "use")]
    assert (got[0].removed, got[0].added, got[0].unchanged, got[0].word_delta) == (2, 1, 3, -1)
    assert got[1].word_delta_pct is None and got[2].added == 0


def state(spark, **over):
    healthy = {"exists": True, "manifest_checked": True, "rules": 3, "assumed": 1, "freshness_checked": True, "locks": 1, "speakers": 0}
    row = healthy | over
    return spark.createDataFrame([tuple(row.get(c.split()[0]) for c in gaps.STATE.split(", "))], gaps.STATE)


@pytest.mark.parametrize(
    ("over", "expected"),
    [({}, []), ({"exists": False, "errors": 5}, ["G01"]), ({"errors": 2}, ["G02"]), ({"assumed": 3}, ["G05"]), ({"speakers": 2, "locks": 0}, ["G21"]), ({"card_tokens": 900}, []), ({"card_tokens": 901, "disputed": 1, "unbaselined": ["en"]}, ["G03", "G10", "G16"]), ({"freshness_checked": False, "stale_sources": 4}, [])],
)
def test_gaps(spark, over, expected):
    assert [r.id for r in gaps.ranked(gaps.detect(state(spark, **over))).collect()] == expected


def test_speaker_offset(spark):
    df = spark.createDataFrame([("**Default dials:** warmth 2 · humor 0 · directness 4 · detail 1 · urgency 3 · formality 3",), ("none",)], "md string")
    house = tone.default_dials(F.lit("**Default dials:** warmth 3 · humor 0 · directness 3 · detail 2 · urgency 2 · formality 2"))
    off = tone.speaker_offset(house, tone.default_dials(F.col("md")))
    got = df.select(*[c.alias(k) for k, c in off.items()]).collect()
    assert tuple(got[0]) == (-1, 0, 1, -1, 1, 1) and tuple(got[1]) == (None,) * 6


def test_entry_numbers_are_numbers(spark):
    rows = [("a", "f999", "x", [], "file", "en", "used", []), ("b", "f1000", "x", [], "file", "en", "used", [])]
    got = index.classify(spark.createDataFrame(rows, IDX), spark.createDataFrame([("x", "c", "en")], "origin string, sha256 string, locale string")).first()
    assert got.entry_id == "f1000" and got["class"] == "stale"
    many = spark.createDataFrame([(f"s{k}", f"f{k:03d}", f"o{k}", [], "file", "en", "used", ["V1"]) for k in range(1, 1200)], IDX)
    cls = index.classify(many, many.select("origin", index.F.concat("sha256", index.F.lit("!")).alias("sha256"), "locale"))
    new, _ = index.supersede(many, cls)
    ids = {r.entry_id for r in new.collect()}
    assert ids == {f"f{k}" for k in range(1200, 2399)}


def test_learned_rules(spark):
    rows = [
        ("d1", "maya", "style", "use", "apply"), ("d1", "maya", "style", "use", "apply"), ("d2", "maya", "style", "use", "apply"),  # two drafts of one speaker
        ("d1", "maya", "style", "big", "large"),  # once
        ("d3", "jonas", "lexicon", "ok", "fine"),  # a swap is exempt
        ("d1", "maya", "style", "leverage", "use"), ("d4", "jonas", "style", "leverage", "use"),  # a house rule, two speakers
        ("d1", "maya", "style", "V2word", "x"), ("d2", "maya", "style", "V2word", "x"),  # locked
        ("d1", "maya", "factual", "May", "June"), ("d2", "maya", "factual", "May", "June"),
        ("d5", None, "style", "utilise", "use"), ("d6", None, "style", "utilise", "use"),
    ]
    made = spark.createDataFrame(rows, "draft string, profile string, class string, from_word string, to_word string")
    house = spark.createDataFrame([("leverage", False), ("v2word", True), ("v2word", None)], "avoid string, locked boolean")
    assert {tuple(r) for r in rules.learned(made, house).collect()} == {("use", "apply", "maya", 2, "proposed"), ("ok", "fine", "jonas", 1, "proposed"), ("leverage", "use", "house", 2, "proposed"), ("V2word", "x", "maya", 2, "locked"), ("utilise", "use", "house", 2, "proposed")}
