import pytest

from tonewright.operators import validate
from tonewright.plans import markdown, report
from tonewright.streaming import ingest

VOICE = """# Voice
<!-- ### V9 · Ghost `confirmed` ev: e9 -->
### V1 · Plainspoken `confirmed` ev: e1, e2
**Means:** Clarity above all.
**Rules out:** fluff, hype

### V2 without confidence
"""
LEXICON = "## Avoid\n\n| ID | Avoid | Prefer | Pattern | Conf | Ev |\n|---|---|---|---|---|---|\n| L01 | leverage | use | a\\|b | derived | e1 |\n"


def test_rules():
    (r,) = markdown.prose_rules(VOICE)
    assert (r["id"], r["name"], r["confidence"], r["evidence"], r["cells"]["Rules out"], r["line"]) == ("V1", "Plainspoken", "confirmed", ["e1", "e2"], "fluff, hype", 3)
    assert [h["id"] for h in markdown.unparsed_headings(VOICE)] == ["V2"]
    (t,) = markdown.table_rules(LEXICON)
    assert t["cells"] == {"Avoid": "leverage", "Prefer": "use", "Pattern": "a|b"} and t["section"] == "Avoid" and t["confidence"] == "derived"


def test_cells_and_vectors():
    md = "**Default dials:** warmth 3 · humor 0\n\n| State | warmth | humor |\n|---|---|---|\n| curious | 3 | 2 |\n\n### T-social/curious `confirmed` ev: e1\n**Dials:** warmth 4 · humor +2\n**Do:** a · b\n<!-- open ### T-email/curious `derived`"
    (c,) = markdown.tone_cells(md)
    assert (c["context"], c["state"], c["dials"], c["do"]) == ("social", "curious", {"warmth": 4, "humor": 2}, ["a", "b"])
    assert markdown.vectors(md)["state"] == {"curious": {"warmth": 3, "humor": 2}} and markdown.default_dials(md) == {"warmth": 3, "humor": 0}


def test_evidence():
    (e,) = markdown.evidence("### e1 — 2026-08-26 — interview\n**Produced:** V1, L01\n")
    assert (e["id"], e["date"], e["type"], e["produced"]) == ("e1", "2026-08-26", "interview", ["V1", "L01"])


def test_yaml():
    y = "a: 1 # note\nb:\n  - x: 'it''s'\n    y: [p, \"q, r\"]\n  - z\nc: |\n  one\n  two\nd: true\n"
    assert markdown.parse_yaml(y) == {"a": 1, "b": [{"x": "it's", "y": ["p", "q, r"]}, "z"], "c": "one\ntwo\n", "d": True}
    for bad in ("a:\n\tb: 1", "a: &x 1"):
        with pytest.raises(markdown.YamlError, match="line"):
            markdown.parse_yaml(bad)


def test_config_and_profiles():
    c = markdown.merged_config({"thresholds": {"drift_pct": 10}, "profiles": {"default": {"name": "Acme"}, "maya": {"name": "Maya"}}, "locks": ["V2"]})
    assert c["thresholds"]["drift_pct"] == 10 and c["thresholds"]["corroboration"] == 2
    assert markdown.profile(c, "maya") == {"name": "Maya", "primary_locale": "en", "locales": ["en"]}


def test_absent_knowledge_base(spark, tmp_path):
    for f in ("config.yml", "voice.md", "tone.md", "lexicon.md"):
        (tmp_path / f[:-3]).mkdir()
        (tmp_path / f[:-3] / f).write_text("locks: []\n")
    roots = [str(tmp_path / x) for x in ("nowhere", "config.", "voice", "tone", "lexicon")]
    bases = spark.createDataFrame([(r, markdown.read_kb(r)["exists"]) for r in roots], "root string, exists boolean")
    got = sorted(map(tuple, validate.kb_checks(bases).collect()))
    assert got == [("error", "E_NO_KB", roots[4]), ("error", "E_NO_KB", roots[0])]


def test_read_kb_and_card(tmp_path):
    (tmp_path / "voice.md").write_text(VOICE)
    (tmp_path / "lexicon.md").write_text(LEXICON)
    kb = markdown.read_kb(str(tmp_path))
    assert kb["exists"] and [r["id"] for r in kb["rules"]] == ["V1", "L01"]
    card = report.card(kb, [{"id": "L01", "avoid": "leverage", "prefer": "use", "confidence": "derived"}], [])
    assert "- **Plainspoken** (`confirmed`)" in card and "| leverage | use | derived |" in card


def test_report():
    s = report.status({"gaps": [{"severity": "nit", "id": "G16", "what": "— wide", "fix": "x"}] * 12}, width=40, panels=("missing",))
    lines = s.splitlines()
    assert all(len(x) == report.LEAST for x in lines) and "+2 more" in s and s.isascii()
    assert report.delta_bar(None, 25).strip() == "n/a" and "&lt;b&gt;" in report.page({"rules": [{"id": "<b>"}]})
    assert report.to_ascii("café “x” 漢") == 'cafe "x" ?'


def test_stream(spark, tmp_path):
    src, base, cp = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "cp")
    src.mkdir()
    (src / "a.txt").write_text("one")
    (src / "b.txt").write_text("one")
    ingest.start(spark, str(src), base, cp).awaitTermination()
    (src / "c.txt").write_text("two")
    ingest.start(spark, str(src), base, cp).awaitTermination()
    rows = {len(r.aliases) for r in ingest.read_index(spark, base, 1).collect()}
    assert ingest.read_index(spark, base, 1).count() == 2 and rows == {0, 1}


def test_card_of_a_house(tmp_path):
    """The whole card of a small base, line by line."""
    (tmp_path / "evidence").mkdir()
    (tmp_path / "config.yml").write_text("kb_version: 0.3.0\nprofiles:\n  default:\n    name: Acme\n    primary_locale: en\n    locales: [en]\n")
    (tmp_path / "voice.md").write_text("# Voice\n\n### V1 · Plainspoken `confirmed` ev: e1\n**Means:** Clarity above all.\n**Rules out:** fluff, hype\n")
    (tmp_path / "tone.md").write_text("# Tone\n\n**Default dials:** warmth 3 · humor 0 · directness 3 · detail 2 · urgency 2 · formality 2\n")
    kb = markdown.read_kb(str(tmp_path)) | {"role": "house", "overrides": []}
    got = report.card(kb, [{"id": "L01", "avoid": "leverage", "prefer": "use", "confidence": "confirmed"}], [], generated="2026-09-10T00:00:00.000Z").split("\n")
    assert got == [
        *report.CARD_HEAD,
        "**Brand:** Acme · **Profile:** default · **Locales:** en · **KB version:** 0.3.0 · **Generated:** 2026-09-10T00:00:00.000Z", "",
        "## Voice - constant", "", "- **Plainspoken** (`confirmed`) - Clarity above all.", "  - Rules out: fluff, hype", "",
        "## Default dials", "", "warmth 3 · humor 0 · directness 3 · detail 2 · urgency 2 · formality 2", "",
        "## Lexicon - most-violated first", "", "| Avoid | Prefer | Conf |", "|---|---|---|", "| leverage | use | confirmed |", "",
        "## Mechanics - most-violated first", "", "_None yet._", "",
        "## Humor gate", "", report.CARD_HUMOR, "These states force `humor 0` whatever the dials say: frustrated · anxious-at-risk · disappointed-leaving.", "",
        "## Where to look next", "", "| Need | Load |", "|---|---|", "| A tone cell | `tone.md` - 0 authored of 80 |", "| A channel playbook | _none yet_ |", "| A locale pack | _none yet_ |", "| Who we write for | `audience.md` |", "| Why a rule exists | `evidence/ledger.md` |", "", "",
    ]


def test_card_of_a_speaker():
    rule = lambda i, file, kind, cells, **more: {"id": i, "file": file, "kind": kind, "name": None, "confidence": "confirmed", "cells": cells, "locked": False} | more
    rules = [rule("V9", "voice", "prose", {"Means": "x"}, name="Own"), rule("V1", "voice", "prose", {"Rules out": "hype. And more"}, name="Plain", locked=True), rule("L20", "lexicon", "table", {"Avoid": "game changer"}, locked=True), rule("L01", "lexicon", "table", {"Avoid": "a"}), rule("L3", "lexicon", "table", {"Avoid": "b"}, confidence="disputed", locked=True)]
    kb = {"config": {"kb_version": "1.0.0", "profiles": {"default": {"name": "Acme"}, "maya": {"name": "Maya"}}}, "role": "speaker", "rules": rules, "cells": [], "overrides": ["L01"], "channels": ["blog", "social"], "locales": [], "default_dials": None}
    got = report.card(kb, [], [], "maya", "now", {"channels": ["social"], "audience": True})
    assert "**Brand:** Acme · **Speaker:** Maya (maya)" in got and "**Own**" in got and "**Plain**" not in got
    assert "- **V1** Plain - rules out hype" in got and "- **L20** - game changer" in got and "L3" not in got
    assert "Overrides: L01 (house rule replaced)" in got and "| A channel playbook | `channels/blog.md`, `profiles/maya/channels/social.md` |" in got
    assert "`profiles/maya/audience.md`" in got and "| The house card | `CONTEXT.md` |" in got and "`profiles/maya/tone.md` - 0 authored of 80" in got
