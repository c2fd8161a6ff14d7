"""The commands on a small project."""

import json

import pytest

from tonewright import cli, sinks
from tonewright.plans import markdown, resolve

NOW = "2026-09-10T00:00:00Z"
CONFIG = """kb_version: 1.2.3
# who speaks
profiles:
  default:
    name: Acme
    primary_locale: en
    locales: [en, de]
  maya:
    name: Maya
sources:
  - id: s01
    kind: project
    include: ["content/**/*.md", "**/*.json", "**/*.bin"]
    exclude: ["node_modules/**"]
  - id: s02   # the inbox
    kind: inbox
    path: inbox
  - id: s03
    kind: url
    url: https://x.y/page
    retain: snapshot
locks: [V1]
"""
VOICE = "# Voice\n### V1 · Plain `confirmed` ev: e1\n**Means:** clear\n"
LEXICON = "## Avoid\n\n| ID | Avoid | Prefer | Conf | Ev |\n|---|---|---|---|---|\n| L01 | leverage | use | derived | e1 |\n"
LEDGER = "### e1 — 2026-08-26 — interview\n**Produced:** V1, L01\n\n### e2 — 2026-08-27 — source\n**Profile:** maya\n**Produced:** L30\n"


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")

    def put(path, text):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text if isinstance(text, bytes) else text.encode())

    put("content/a.md", "# Hello there\n\nWe leverage the tool. It is sent.\n")
    put("content/de/b.md", "Wir senden dir Berichte.\n")
    put("node_modules/x/c.json", '{"a": "Never read"}')
    put("broken.json", '{"a": ')
    put("odd.bin", b"\xff\xfe")
    put(".voice/config.yml", CONFIG)
    put(".voice/voice.md", VOICE)
    put(".voice/tone.md", "# Tone\n")
    put(".voice/lexicon.md", LEXICON)
    put(".voice/evidence/ledger.md", LEDGER)
    put(".voice/inbox/one.txt", "A letter to you with more than ten words in it, so that it counts.")
    put(".voice/inbox/two.txt", "A letter to you with more than ten words in it, so that it counts.")
    put(".voice/inbox/bad.pdf", b"%PDF /Encrypt \xff")
    put(".voice/profiles/maya/voice.md", "# Voice\n### V3 · Bold `derived` ev: e2\n")
    put(".voice/profiles/maya/tone.md", "**Default dials:** warmth 4\n")
    return root


def run(spark, project, *argv, get=None, code=0):
    got, text = cli.run(spark, [argv[0], "--root", str(project), "--kb", str(project / ".voice"), "--now", NOW, "--json", *argv[1:]], *([get] if get else []))
    assert got == code, text
    return json.loads(text)


def test_commands(spark, project):
    scanned = run(spark, project, "scan")
    assert scanned["totals"]["files"] == 2 and set(scanned["byLocale"]) == {"en", "de"}
    assert scanned["skipped"]["byReason"]["no-extractor"] == 1 and scanned["unreadable"]["count"] == 1
    assert scanned["unindexed"]["count"] == 3

    assert run(spark, project, "sources", "--check") == {"fresh": 3}
    done = run(spark, project, "sources", "--ingest")
    assert len(done["ingested"]) == 2 and len(done["folded"]) == 1 and "bad.pdf" in done["escalate"][0] and "encrypted" in done["escalate"][0]
    (project / ".voice/inbox/one.txt").write_text("Another letter to you with more than ten words in it, so it counts.")
    done = run(spark, project, "sources", "--ingest", "--only", "s02:one.txt")
    assert len(done["ingested"]) == 1 and done["errors"] == []

    pages = {"https://x.y/page": (200, "text/html", "<p>Hello world</p>")}
    got = run(spark, project, "sources", "--refresh", get=lambda u: pages[u])
    assert [p["outcome"] for p in got["pages"]] == ["added"]
    assert [p["outcome"] for p in run(spark, project, "sources", "--refresh", get=lambda u: 1 / 0)["pages"]] == ["failed"]

    first = run(spark, project, "fingerprint", "--set-baseline")
    assert first["locales"]["de"]["word_count"] == 4 and first["baseline"]["locales"]
    assert run(spark, project, "fingerprint")["baseline"] == first["baseline"]

    found = {(f["code"], f["ref"]) for f in run(spark, project, "validate")["findings"]}
    assert ("W_ORPHAN_EVIDENCE", "e2:L30") in found
    assert run(spark, project, "compile-context")["tokens"] < 900
    assert "| leverage | use | derived |" in (project / ".voice/CONTEXT.md").read_text()

    state = run(spark, project, "status")
    assert state["stages"]["scan"] and {g["id"] for g in state["gaps"]} >= {"G12", "G18"}
    assert state["freshness"]["freshness"] == "unchecked" and state["freshness"]["stale"] is None
    _, text = cli.run(spark, ["status", "--root", str(project), "--kb", str(project / ".voice"), "--panel", "rules", "--artifact", str(project / "page.html")])
    assert "confirmed 1" in text and (project / "page.html").read_text().startswith("<!doctype html>")


def test_forget_and_speakers(spark, project):
    assert run(spark, project, "speaker", "--add", "ola", "--name", "Ola", "--locale", "de")["overlay"].endswith("ola")
    assert "# who speaks" in (project / ".voice/config.yml").read_text()
    plan = run(spark, project, "speaker", "--remove", "maya", "--dry-run")
    assert plan["reopen"] == ["L30"] and not plan["removed"] and (project / ".voice/profiles/maya").exists()
    run(spark, project, "speaker", "--remove", "maya")
    config = markdown.parse_yaml((project / ".voice/config.yml").read_text())
    assert set(config["profiles"]) == {"default", "ola"} and not (project / ".voice/profiles/maya").exists()
    assert run(spark, project, "sources", "--add", "https://z.w/a", "--label", "A page") == {"added": "s04"}
    with pytest.raises(ValueError, match="no source"):
        run(spark, project, "sources", "--forget", "f999")
    with pytest.raises(SystemExit):
        cli.run(spark, ["scan", "--unknown"])


def test_diff_and_sync(spark, project):
    (project / ".voice/.drafts").mkdir()
    (project / ".voice/.drafts/d.md").write_text("We leverage it")
    (project / "final.md").write_text("We use it")
    out = run(spark, project, "diff", "--draft", str(project / ".voice/.drafts/d.md"), "--final", str(project / "final.md"))
    assert out["removed"] == out["added"] == 1 and out["word_swaps"] == [{"from": "leverage", "to": "use"}]
    assert json.loads((project / ".voice/.drafts/d.diff.json").read_text())["unchanged"] == 2


def test_resolve(tmp_path):
    for path, text in (("config.yml", CONFIG), ("voice.md", VOICE + "### V2 · Two `derived` ev: e1\n"), ("lexicon.md", LEXICON), ("profiles/maya/voice.md", "### V3 · Own `derived`\n"), ("profiles/maya/lexicon.md", LEXICON.replace("use", "apply")), ("profiles/maya/tone.md", "**Default dials:** warmth 4\n\n### T-email/curious `derived`\n**Dials:** warmth 4\n")):
        sinks.write_text(str(tmp_path / path), text)
    kb = resolve.resolve(str(tmp_path), "maya")
    assert [(r["id"], r["origin"], r["locked"]) for r in kb["rules"]] == [("V3", "speaker", False), ("T-email/curious", "speaker", False), ("L01", "speaker", False), ("V1", "house", True)]
    assert kb["overrides"] == ["L01"] and kb["offset"]["warmth"] == 2 and len(kb["cells"]) == 1 and kb["known_ids"] == ["L01", "T-email/curious", "V1", "V2", "V3"]
    assert resolve.resolve(str(tmp_path))["cells"] == []


def test_config_edits():
    text = sinks.add_item(CONFIG, "sources", {"id": "s09", "kind": "local", "path": "/a b", "profile": "maya"})
    assert markdown.parse_yaml(text)["sources"][-1] == {"id": "s09", "kind": "local", "path": "/a b", "profile": "maya"} and "# the inbox" in text
    assert sinks.remove_items(text, "sources", "profile", "maya") == CONFIG
    assert markdown.parse_yaml(sinks.add_item("sources: []\n", "sources", {"id": "s01"})) == {"sources": [{"id": "s01"}]}
    assert "maya" not in sinks.remove_entry(CONFIG, "profiles", "maya")
    value = {"a": [1, {"b": "x: y", "c": []}], "d": {"e": None, "f": True}, "g": "true"}
    assert markdown.parse_yaml(sinks.to_yaml(value)) == value


def test_index_versions(spark, tmp_path):
    base = str(tmp_path / "idx")
    df = spark.createDataFrame([("f1000",), ("f999",), ("f002",)], "entry_id string").coalesce(1)
    for k in range(4):
        assert sinks.save_index(df, base) == k
    assert [r.entry_id for r in sinks.load_index(spark, base, "entry_id string").collect()] == ["f002", "f999", "f1000"]
    # every version has its entry, the two latest have their data
    log = sinks.IndexLog(spark, base)
    assert log.version() == 3 and len(list((tmp_path / "idx/data").iterdir())) == 2
    assert {log.entry(v)["data"] for v in (2, 3)} == {f"data/{p.name}" for p in (tmp_path / "idx/data").iterdir()}
