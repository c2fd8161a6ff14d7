"""The index's log of commits, sums kept by signed changes, one reading an ingest, fetches."""

import http.server
import threading
import time

import pytest
from pyspark.sql import functions as F

from tonewright import cli, sinks
from tonewright import workspace as W
from tonewright.functions import stats
from tonewright.operators import index, ingest, sums
from tonewright.streaming import ingest as follow

KEYS = "sha256 string, entry_id string, profile string, locale string, status string"
SMALL = "entry_id string"


def counted(spark, rows):
    """Entries with statistics, of (entry, profile, locale, status, text)."""
    units = spark.createDataFrame([(f"h{t}", e, p, loc, s, [t]) for e, p, loc, s, t in rows], KEYS + ", strings array<string>").withColumn("headings", F.array().cast("array<string>"))
    held = tuple(c.split()[0] for c in KEYS.split(", "))
    out = stats.unit_stats(units, held)
    return out.select(*held, F.struct(*[c for c in out.columns if c not in held]).alias("stats"))


BEFORE = [("f1", None, "en", "used", "We made it. It was shown!"), ("f2", None, "en", "used", "You did."), ("f3", "maya", "en", "used", "I am here."), ("f4", None, "de", "used", "Wir sind da."), ("f5", None, "de", "skipped", "x"), ("f6", None, "cs", "used", "Já."), ("f7", None, "en", "used", "")]
#: changed, forgotten, missing (still counts), moved to another locale, another profile, added
AFTER = [("f8", None, "en", "used", "We made it. It was shown! Again?"), ("f2", None, "en", "missing", "You did."), ("f3", None, "en", "used", "I am here."), ("f4", None, "fr", "used", "Wir sind da."), ("f5", None, "de", "skipped", "x"), ("f9", "maya", "de", "used", "Du."), ("f7", None, "en", "used", "")]


def test_kept_sums_equal_a_recount(spark):
    before, after = counted(spark, BEFORE), counted(spark, AFTER)
    kept = sums.maintained(before, before, None)
    moved, anew = sums.maintained(before, after, kept), sums.maintained(before, after, None)
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert order(moved) == order(anew) and {r.locale for r in moved.collect()} == {"en", "fr", "de"}
    house = moved.where("profile is null")
    plain = stats.finalise(stats.merge_stats(after.where("profile is null and status <> 'skipped'").select("locale", "stats.*"), "locale"), "locale")
    assert order(sums.fingerprint(house, "locale")) == order(plain)
    assert order(sums.maintained(after, before, moved)) == order(kept)  # and back again
    with pytest.raises(Exception, match="cannot be merged"):
        sums.fingerprint(moved.withColumn("one", F.lit(1)).drop("locale"), "one").collect()


def test_changes_read_the_statistics_of_changed_entries(spark, tmp_path):
    before, after = counted(spark, BEFORE), counted(spark, AFTER)
    for name, df in (("a", before), ("b", after)):
        df.write.parquet(f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{n}") for n in "ab")
    assert sums.changes(a, a).count() == 0
    got = sums.changes(a, b).where("units <> 0").groupBy("profile", "locale").agg(F.sum("units").alias("n")).collect()
    assert {(r.profile, r.locale): r.n for r in got} == {(None, "en"): 1, ("maya", "en"): -1, (None, "de"): -1, (None, "fr"): 1, (None, "cs"): -1, ("maya", "de"): 1}


def test_two_writers_lose_nothing(spark, tmp_path):
    base, errors = str(tmp_path / "index"), []
    start = threading.Barrier(2)

    def add(name):
        try:
            first = True

            def change(held):
                nonlocal first
                if first:
                    first = False
                    start.wait()
                return held.unionByName(spark.createDataFrame([(name,)], SMALL))

            sinks.IndexLog(spark, base).update(SMALL, change)
        except Exception as e:  # seen by the test
            errors.append(e)

    both = [threading.Thread(target=add, args=(n,)) for n in ("f001", "f002")]
    for t in both:
        t.start()
    for t in both:
        t.join(120)
    log = sinks.IndexLog(spark, base)
    assert not errors and log.version() == 1
    assert sorted(r.entry_id for r in log.read("data", SMALL).collect()) == ["f001", "f002"]


@pytest.mark.parametrize("scheme", ["", "file://", "viewfs"])
def test_log_puts_only_where_none_is(spark, tmp_path, scheme):
    base = f"{scheme}{tmp_path}/index"
    if scheme == "viewfs":
        spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.logs.link./at", f"file://{tmp_path}")
        base = "viewfs://logs/at/index"
    log = sinks.IndexLog(spark, base)
    assert log.version() == -1 and log.read("data", SMALL) is None
    assert log.put(0, {"data": "one"}) and not log.put(0, {"data": "two"})
    assert log.version() == 0 and log.entry(0) == {"data": "one"}


def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "index")
    sinks.save_index(spark.createDataFrame([("f001",)], SMALL), base)
    monkeypatch.setattr(sinks.IndexLog, "put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        sinks.save_index(spark.createDataFrame([("f002",)], SMALL), base)
    monkeypatch.undo()
    assert [r.entry_id for r in sinks.load_index(spark, base, SMALL).collect()] == ["f001"]
    assert sinks.save_index(spark.createDataFrame([("f003",)], SMALL), base) == 1


def test_ingest_reads_once_and_keeps_sums(spark, tmp_path, monkeypatch):
    kb = tmp_path / ".voice"
    (kb / "inbox").mkdir(parents=True)
    (kb / "config.yml").write_text("profiles:\n  default:\n    primary_locale: en\nsources:\n  - id: s01\n    kind: inbox\n    path: inbox\n")
    for k in range(4):
        (kb / f"inbox/{k}.txt").write_text(f"A letter number {k} to you with more than ten words in it, so that it counts.")
    ws = W.Workspace(spark, str(tmp_path), str(kb), now="2026-09-10T00:00:00Z")
    done = ws.ingest()
    # files change after the commit: reports still tell what was committed
    (kb / "inbox/0.txt").write_text("Something else.")
    (kb / "inbox/1.txt").unlink()
    assert sorted(r.origin for r in done.ingested.collect()) == [f"s01:{k}.txt" for k in range(4)]
    assert {r.sha256 for r in done.ingested.collect()} == {r.sha256 for r in ws.whole_index().collect()}
    log = sinks.IndexLog(spark, ws.index_base)

    def recount():
        a = sorted(map(tuple, log.read("sums", sums.SCHEMA).collect()), key=repr)
        return a == sorted(map(tuple, sums.maintained(ws.whole_index(), ws.whole_index(), None).collect()), key=repr)

    assert recount()
    (kb / "inbox/0.txt").write_text("This letter has changed since, and it still has more than ten words in it.")
    again = ws.ingest()
    assert again.ingested.count() == 1 and recount() and log.version() == 1
    ws.forget(ws.whole_index().where("origin = 's01:2.txt'").first().entry_id)
    assert recount() and log.version() == 2
    monkeypatch.setattr(ws, "statistics", lambda: pytest.fail("the sums were kept"))
    assert ws.fingerprint()["locales"]["en"]["word_count"] == sum(r.stats.words for r in ws.whole_index().collect())
    ws.close()
    assert not list((kb / "evidence/sources/work").iterdir())
    other = W.Workspace(spark, str(tmp_path), str(kb), digest=lambda c: F.concat(F.lit("m:"), F.md5(c)))
    assert all(r.sha256.startswith("m:") and r["class"] != "known" for r in other.check().collect())


def test_a_file_that_changes_while_it_is_ingested_is_an_error(spark):
    resolved = spark.createDataFrame([("a", "h1", "s1", "inbox", "text", "en", None, b"x"), ("b", None, "s1", "inbox", "text", "en", None, None)], "origin string, sha256 string, register_id string, kind string, format string, locale string, profile string, content binary")
    empty = spark.createDataFrame([], ingest.INDEX)
    calls = []

    def read(rows):
        calls.append(1)
        return rows.where("false").withColumns({"status": F.lit("used"), "note": F.lit("ok"), "tier": F.lit("script"), "tokens": F.lit(1).cast("long")})

    done = ingest.run(empty, resolved, read, "2026-09-10")
    assert {(r.origin, r.reason) for r in done.errors.collect()} == {("a", "vanished"), ("b", "vanished")} and done.index.count() == 0 and len(calls) == 1
    assert index.entry_number("entry_id") is not None


# --- fetches


def test_only_web_addresses_are_opened(spark, tmp_path):
    (tmp_path / "secret").write_text("x")
    urls = [("a", f"file://{tmp_path}/secret"), ("b", "ftp://x.y/z"), ("c", None), ("d", "HTTPS://x.y/z"), ("e", "javascript:1")]
    got = {r.register_id: r for r in ingest.fetched(spark, spark.createDataFrame(urls, "register_id string, url string"), lambda url: (200, "text/html", url)).collect()}
    assert [got[k].error for k in "abce"] == ["ValueError: not a web address"] * 4 and got["d"].code == 200
    with pytest.raises(ValueError, match="not a web"):
        cli.fetch(f"file://{tmp_path}/secret")


def test_a_slow_host_delays_no_other(spark, tmp_path):
    def fetch(url):
        time.sleep(3 if "slow" in url else 0)
        return 200, "text/html", str(time.time())

    urls = [(f"s{k}", f"http://slow/{k}") for k in range(3)] + [(f"q{k}", f"http://quick{k}/") for k in range(20)]
    got = {r.register_id: float(r.body) for r in ingest.fetched(spark, spark.createDataFrame(urls, "register_id string, url string").coalesce(1), fetch).collect()}
    slow = sorted(got[f"s{k}"] for k in range(3))
    assert len(got) == 23 and slow[1] - slow[0] > 2.5 and sum(got[f"q{k}"] < slow[2] for k in range(20)) == 20


def test_fetch_limits(tmp_path):
    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/away":
                self.send_response(302)
                self.send_header("Location", f"file://{tmp_path}/x")
                self.end_headers()
                return
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            self.wfile.write(b"\xe9" * (10 if self.path == "/" else 5000))

        def log_message(self, *a):
            pass

    site = http.server.HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=site.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{site.server_port}"
    try:
        assert cli.fetch(at + "/", most=100) == (200, "text/html", "é" * 10)
        with pytest.raises(ValueError, match="over 100 bytes"):
            cli.fetch(at + "/large", most=100)
        with pytest.raises(Exception, match="no web address|not allowed"):
            cli.fetch(at + "/away")
    finally:
        site.shutdown()


# --- the streaming form


def test_a_stream_of_batches_equals_one_batch(spark, tmp_path):
    """Three batches, one of them run twice, against one ingestion of the same folder."""
    letter = "A letter number {} to you with more than ten words in it, so that it counts."

    def space(name):
        kb = tmp_path / name / ".voice"
        kb.mkdir(parents=True)
        (kb / "config.yml").write_text(f"profiles:\n  default:\n    primary_locale: en\n    locales: [en, de]\nsources:\n  - id: s01\n    kind: local\n    path: {tmp_path}/in\n")
        return W.Workspace(spark, str(tmp_path / name), str(kb), now="2026-09-10T00:00:00Z")

    streamed, whole = space("a"), space("b")
    (tmp_path / "in/de").mkdir(parents=True)
    put = {0: {"1.txt": letter.format(1), "2.txt": letter.format(2), "de/3.txt": letter.format(3)}, 1: {"4.txt": letter.format(2), "5.bin": "x"}, 2: {"1b.txt": letter.format(9), "6.txt": ""}}
    for files in put.values():
        for rel, text in files.items():
            (tmp_path / "in" / rel).write_text(text)
        follow.follow(streamed, str(tmp_path / "in"), "s01", str(tmp_path / "check")).awaitTermination()
    log = sinks.IndexLog(spark, streamed.index_base)
    before = log.version()
    assert before == 2 and log.entry(before)["batches"] == {"files": 2}
    # a batch that runs again
    again = spark.createDataFrame([("7.txt", bytearray(letter.format(7), "utf-8"))], "rel string, content binary")
    streamed.take_in(again, "s01", ("files", 2))
    assert log.version() == before
    whole.ingest()
    facts = lambda ws: {(r.sha256, r.origin, tuple(r.aliases), r.locale, r.status, r.note, r.tokens, r.stats) for r in ws.whole_index().collect()}
    assert facts(streamed) == facts(whole)
    numbers = [r.entry_id for r in streamed.whole_index().collect()]
    assert len(set(numbers)) == len(numbers) and all(n.startswith("f0") for n in numbers)
    kept = lambda ws: {tuple(r) for r in sinks.IndexLog(spark, ws.index_base).read("sums", sums.SCHEMA).collect()}
    assert kept(streamed) == kept(whole)
    # and the batch form goes on where the stream stopped
    (tmp_path / "in/8.txt").write_text(letter.format(8))
    done = streamed.ingest()
    assert done.ingested.count() == 1 and done.missing.count() == 0
