import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tonewright.queries import extracted
from tonewright.sources import extract, files, tree


SAMPLES = [
    ("a.md", "---\ntitle: x\n---\n# Hello **World**\n\n- first [link](http://a.b)\n- [x] done\n\n| A | Bee |\n|---|---|\n| One cell | #fff |\n\n```\ncode\n```\n<!-- no -->\nTail `x` text\n"),
    ("b.html", "<h1>Big &amp; bold</h1><script>no()</script><img alt='A photo'><p>It&#39;s &#x41; &copy;</p>"),
    ("c.txt", "First para\nstill first.\n\n\nSecond para.\n"),
    ("d.po", 'msgid ""\nmsgstr "Header: x"\n\n# note\nmsgid "Hello"\nmsgstr "Hallo"\n\nmsgid "Long "\n"text"\nmsgstr ""\n'),
    ("e.vtt", "WEBVTT\n\nNOTE hidden\nstill hidden\n\nid-1\n00:01 --> 00:02\nHello <b>there</b>\nyou\n\n00:03 --> 00:04\nBye\n"),
    ("f.csv", 'name,count\n"Say ""hi"", now",12\n"two\nlines",x\n'),
    ("g.yml", "title: Hello there\nurl: https://x.y\nnested:\n  label: 'Save it'\n"),
    ("h.json", '{"a": "Save changes", "b": {"c": ["Undo", "https://x.y", 3]}, "d": "ABC_DEF"}'),
    ("i.rtf", "{\\rtf1{\\fonttbl{\\f0 Arial;}}Hello \\b world\\b0\\par caf\\'e9 \\u8211?dash\\par}"),
    ("j.pdf", "bytes"),
    ("k.xyz", "unknown"),
]


def test_samples(spark):
    got = {}
    for r in extracted(spark.createDataFrame(SAMPLES, "path string, raw string")).collect():
        got.setdefault(r.path, []).append(r.unit)
    assert got == {
        "a.md": ["Hello World", "first link", "done", "A", "Bee", "One cell", "Tail text"],
        "b.html": ["A photo", "Big & bold", "It's A &copy;"],
        "c.txt": ["First para still first.", "Second para."],
        "d.po": ["Hallo", "Long text"],
        "e.vtt": ["Hello there you", "Bye"],
        "f.csv": ["name", "count", 'Say "hi", now', "two lines", "x"],
        "g.yml": ["Hello there", "Save it"],
        "h.json": ["Save changes", "Undo"],
        "i.rtf": ["Hello world", "café –dash"],
        "k.xyz": [None],
    }


def test_yaml_trees(spark):
    texts = {
        "- Save your work\n- 'Undo it'\n": ["Save your work", "Undo it"],
        "tips:\n  - Save early\n  - label: Save often\n": ["Save early", "Save often"],
        "a: |\n  One line\n  Two line\nb: >-\n  folded\n  text\nc: |+\n  kept\n": ["One line Two line", "folded text", "kept"],
        '"quoted key": Hello\nkey with space: There # note\n': ["Hello", "There"],
        "a: &x Hello\nb: *x\n": ["&x Hello", "*x"],
        "  a: Hello\nb: There\n": ["Hello", "There"],
        'a: "bad \\q escape"\n': ["bad \\q escape"],
        "": [],
    }
    rows = spark.createDataFrame([("yaml", t) for t in texts], "format string, raw string")
    assert {r.raw: r.units for r in rows.withColumn("units", extract.extract_units(F.col("format"), F.col("raw"))).collect()} == texts


def test_container_is_refused(spark):
    df = spark.createDataFrame([("docx", "x")], "format string, raw string")
    with pytest.raises(Exception, match="container"):
        df.select(extract.extract_units(F.col("format"), F.col("raw"))).collect()


def test_office():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:p/></w:document>')
    assert extract.office_lines(b.getvalue(), "docx") == ["Hello there"]


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("content/**/*.md", "content/a.md", True), ("content/**/*.md", "content/x/y/a.md", True), ("*.md", "a/b.md", False), ("{a,b}/?.t", "b/x.t", True), ("a+b", "a+b", True), ("**", "a/b/c", True), ("*.md", "a.mdx", False)],
)
def test_globs(spark, pattern, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(files.matches_any(F.col("p"), [pattern])).first()[0] is hit


def test_pruning():
    assert files.pruned("node_modules", ["node_modules/**"]) and not files.pruned("docs", ["docs/*.md"]) and files.pruned("dist", ["dist"])


def test_scan(spark, tmp_path):
    (tmp_path / "content").mkdir()
    (tmp_path / "content/a.md").write_bytes("\ufeffHi\r\nthere".encode())
    (tmp_path / "content/b.txt").write_text("no")
    got = files.read_text(files.scan_files(spark, str(tmp_path), ["content/**"], ["**/*.txt"])).select("rel", "format", "raw").collect()
    assert [tuple(r) for r in got] == [("content/a.md", "markdown", "Hi\nthere")]


def test_register(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox/x.txt").write_text("x")
    entries = [{"id": "s02", "kind": "inbox", "path": "inbox"}, {"id": "s03", "kind": "local", "path": str(tmp_path / "gone")}]
    got, notes = files.resolve_register(spark, entries, str(tmp_path), str(tmp_path))
    assert [r.origin for r in got.collect()] == ["s02:x.txt"] and [n["missing"] for n in notes] == [False, True]
    with pytest.raises(ValueError, match="leaves"):
        files.resolve_register(spark, [{"id": "s04", "kind": "inbox", "path": "../.."}], str(tmp_path), str(tmp_path))
    assert files.next_id(["s02", "s10"], "s", 2) == "s11"


def test_numeric_entities(spark):
    assert spark.range(1).select(extract.decode_entities(F.lit("&#8217;&#x1F600; &amp;lt; &nope;"))).first()[0] == "’😀 &lt; &nope;"


def test_bad_input_ends_no_job(spark):
    texts = [
        ("html", "<p>&#99999999; &#xD800; &#99999999999999999999; &#0065;</p>", ["&#99999999; &#xD800; &#99999999999999999999; A"]),
        ("rtf", "{\\rtf1 a\\u-10179?\\u-8704?b\\u99999999?c\\u-10179?}", ["a😀b�c�"]),
        ("json", "[" * 5000 + '"Save it"' + "]" * 5000, ["Save it"]),
        ("json", '{"a": ["Pair \\ud83d\\ude00 and \\ud83d half"]}', ["Pair 😀 and � half"]),
        ("json", "[" * 5000, []),
        ("markdown", "~~~\nno\n~~~\n<!-- a\nb --> Kept\nimport x from 'y'\n```\nopen fence", ["Kept", "```", "open fence"][:1] + ["open fence"]),
    ]
    df = spark.createDataFrame([(k, f, t) for k, (f, t, _) in enumerate(texts)], "k int, format string, raw string")
    got = {r.k: r.u for r in df.select("k", extract.extract_units(F.col("format"), F.col("raw")).alias("u")).collect()}
    assert got == {k: u for k, (_, _, u) in enumerate(texts)}


@pytest.mark.parametrize(
    ("folder", "globs", "holds"),
    [("", ["a/*.md"], True), ("a", ["a/*.md"], True), ("a/b", ["a/*.md"], False), ("a/b/c", ["a/**/*.md"], True), ("x", ["a/**/*.md", "x?/y"], False), ("xy", ["x?/y"], True), ("docs", ["docs"], False), ("a", ["**"], True), ("q", ["{p,q}/*"], True), ("r", ["{p,q}/*"], False), ("a", [], False)],
)
def test_folders_that_may_hold(folder, globs, holds):
    assert tree.may_hold(folder, globs) is holds


def grown(root):
    for name in ("a.md", "docs/b.md", "docs/deep/c.md", "docs/deep/node_modules/x/d.md", "node_modules/e.md", "docs/no.txt", "docs/[x] {y}*?.md", "docs/_index.md", "docs/sp ace/%41.md", "_drafts/f.md", "docs/é.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (root / "docs/link.md").symlink_to(root / "a.md")
    (root / "loop").symlink_to(root)


TAKEN = {"a.md", "docs/b.md", "docs/deep/c.md", "docs/[x] {y}*?.md", "docs/_index.md", "docs/sp ace/%41.md", "_drafts/f.md", "docs/é.md"}


def test_tree_lists_nothing_excluded(spark, tmp_path, monkeypatch):
    grown(tmp_path)
    listed, plain = [], tree.Tree.list
    monkeypatch.setattr(tree.Tree, "list", lambda self, rel: (listed.append(rel), plain(self, rel))[1])
    got = files.scan_files(spark, str(tmp_path), ["**/*.md"], ["**/node_modules/**"])
    assert {r.rel: bytes(r.content).decode() for r in got.collect()} == {x: x for x in TAKEN}
    assert sorted(listed) == ["", "_drafts", "docs", "docs/deep", "docs/sp ace"]
    listed.clear()
    assert [r.rel for r in files.scan_files(spark, str(tmp_path), ["docs/deep/*.md"], []).collect()] == ["docs/deep/c.md"]
    assert sorted(listed) == ["", "docs", "docs/deep"]
    assert all(r.modified is not None and r.bytes == len(r.content) for r in got.collect())


def test_tree_takes_uris(spark, tmp_path):
    """A path that only Hadoop opens gives the rows of the plain one; what is absent is an error."""
    grown(tmp_path)
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.shelf.link./in", f"file://{tmp_path}")
    rows = lambda root: sorted((r.rel, bytes(r.content), r.bytes, r.format) for r in files.scan_files(spark, root, ["**/*.md"], ["**/node_modules/**", "**/_*"]).collect())
    assert rows(str(tmp_path)) == rows(f"file://{tmp_path}") == rows(f"file:{tmp_path}/") == rows("viewfs://shelf/in")
    assert [r[0] for r in rows(str(tmp_path))] == sorted(TAKEN - {"docs/_index.md"})
    for gone in (str(tmp_path / "gone"), f"file://{tmp_path}/gone", "viewfs://shelf/in/gone"):
        with pytest.raises(FileNotFoundError):
            files.scan_files(spark, gone, ["**"], [])
    entries = [{"id": "s01", "kind": "local", "path": f"file://{tmp_path}/docs"}, {"id": "s02", "kind": "local", "path": "viewfs://shelf/in/a.md"}, {"id": "s03", "kind": "local", "path": "viewfs://shelf/in/gone"}, {"id": "s04", "kind": "local", "path": f"file://{tmp_path}/docs", "include": ["*.rst"]}]
    got, notes = files.resolve_register(spark, entries, str(tmp_path), str(tmp_path))
    assert {"s01:b.md", "s02:a.md"} <= {r.origin for r in got.collect()}
    assert [(n["missing"], n["empty"]) for n in notes] == [(False, False), (False, False), (True, False), (False, True)]
