"""The command line: scan, fingerprint, sources, validate, compile-context, diff, status,
speaker, sync.  Unknown options are refused; errors end with 1, findings of errors with 2."""

from __future__ import annotations

import argparse
import json
import sys
import urllib.request

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tonewright.operators import ingest
from tonewright.plans.report import to_ascii
from tonewright.workspace import SHOWN, Workspace


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tonewright", allow_abbrev=False)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, allow_abbrev=False)
        p.add_argument("--root", default=".")
        p.add_argument("--kb", default=".voice")
        p.add_argument("--profile", default="default")
        p.add_argument("--now", help="pins the time")
        p.add_argument("--json", action="store_true")
        for f in flags:
            p.add_argument(f, action="store_true")
        return p

    command("scan").add_argument("--out")
    p = command("fingerprint", "--set-baseline")
    p.add_argument("--source", choices=("measured", "estimated"))
    p = command("sources", "--check", "--ingest", "--refresh")
    for f in ("--add", "--label", "--forget", "--only"):
        p.add_argument(f)
    command("validate")
    command("compile-context")
    p = command("diff")
    p.add_argument("--draft", required=True)
    p.add_argument("--final", required=True)
    p = command("status", "--refresh")
    p.add_argument("--panel", action="append", default=[])
    p.add_argument("--width", type=int)
    p.add_argument("--locale")
    p.add_argument("--artifact")
    p = command("speaker", "--list", "--dry-run")
    for f in ("--add", "--name", "--locale", "--remove"):
        p.add_argument(f)
    command("sync").add_argument("--part", choices=("major", "minor", "patch"), default="patch")
    return top


class _WebOnly(urllib.request.HTTPRedirectHandler):
    """Redirects stay on the web."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if not newurl.lower().startswith(("http://", "https://")):
            raise ValueError("redirected to no web address")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def fetch(url: str, seconds: float = 15, most: int = 5 << 20) -> tuple[int, str, str]:
    """One page by the standard library, of `most` bytes at most; only web addresses are opened."""
    if not url.lower().startswith(("http://", "https://")):
        raise ValueError("not a web address")
    with urllib.request.build_opener(_WebOnly()).open(url, timeout=seconds) as r:
        body = r.read(most + 1)
        if len(body) > most:
            raise ValueError(f"over {most} bytes")
        return r.status, r.headers.get_content_type(), body.decode(r.headers.get_content_charset() or "utf-8", "replace")


def shown(rows: list[str]) -> list[str]:
    return rows[:SHOWN] + ([f"+{len(rows) - SHOWN} more"] if len(rows) > SHOWN else [])


def listed(df, *columns: str) -> list[str]:
    """The first rows by path, and one more that says that there are others."""
    return [" ".join(str(x) for x in r if x is not None) for r in df.select(*columns).sort(*columns).limit(SHOWN + 1).collect()]


def sources(w: Workspace, a: argparse.Namespace, get) -> tuple[dict, list[str]]:
    if a.only and not a.refresh and not a.ingest:
        raise ValueError("--only needs --refresh or --ingest")
    if a.add:
        kind = "url" if a.add.lower().startswith(("http://", "https://")) else "local"
        new = w.add_source(kind, a.add, a.label)
        return {"added": new}, [f"added {new}"]
    if a.forget:
        rules = w.forget(a.forget)
        return {"forgotten": a.forget, "reopen": rules}, [f"forgot {a.forget}", *(f"reopen {r}" for r in rules)]
    if a.refresh:
        urls = w.spark.createDataFrame([(e["id"], e["url"]) for e in w.register if e["kind"] == "url" and a.only in (None, e["id"], e["url"])], "register_id string, url string")
        rows = w.refresh(ingest.fetched(w.spark, urls, get)).sort("register_id").collect()
        return {"pages": [r.asDict() for r in rows]}, shown([f"{r.outcome} {r.origin}" for r in rows])
    if a.ingest:
        done = w.ingest(a.only)
        out = {k: listed(getattr(done, k), *c) for k, c in (("ingested", ("entry_id", "origin")), ("folded", ("origin", "entry_id")), ("reopened", ("entry_id", "rule_id")), ("missing", ("entry_id", "origin")), ("escalate", ("entry_id", "origin", "note")), ("errors", ("origin", "reason")))}
        w.close()
        return out, [f"{k}: {x}" for k, v in out.items() for x in shown(v)] or ["nothing to ingest"]
    counts = {r["class"]: r["n"] for r in w.check().groupBy("class").agg(F.count("*").alias("n")).collect()}
    return counts, [f"{k} {counts.get(k, 0)}" for k in ("known", "duplicate", "stale", "fresh")]


def run(spark: SparkSession, argv: list[str], get=fetch) -> tuple[int, str]:
    """Exit code and output of a command."""
    a = parser().parse_args(argv)
    w = Workspace(spark, a.root, a.kb, a.profile, a.now)
    code = 0
    if a.command == "scan":
        out = w.scan(a.out)
        text = [f"{k} {v}" for k, v in out["totals"].items()] + [f"{out['unindexed']['count']} file(s) need ingest"]
    elif a.command == "fingerprint":
        out = w.fingerprint(a.set_baseline, a.source)
        text = [f"{k}: {v['word_count']} words, mean sentence {v['mean_sentence_length']}" for k, v in out["locales"].items()]
    elif a.command == "sources":
        out, text = sources(w, a, get)
    elif a.command == "validate":
        rows = w.validate().sort("severity", "code", "ref").collect()
        out, text = {"findings": [r.asDict() for r in rows]}, shown([f"{r.severity} {r.code} {r.ref}" for r in rows]) or ["no findings"]
        code = 2 if any(r.severity == "error" for r in rows) else 0
    elif a.command == "compile-context":
        card, tokens = w.compile_card()
        out, text = {"tokens": tokens}, [f"{tokens} tokens", *(["warning: over 900 tokens"] if tokens > 900 else [])]
    elif a.command == "diff":
        out = w.diff(a.draft, a.final)
        text = [f"{k} {v}" for k, v in out.items() if isinstance(v, int)]
    elif a.command == "status":
        if a.json:
            out, text = w.collect(a.refresh, a.locale), []
        else:
            out, text = {}, w.status(a.width, tuple(a.panel), a.refresh, a.locale, a.artifact).rstrip("\n").split("\n")
    elif a.command == "speaker":
        if a.add:
            out = {"overlay": w.add_speaker(a.add, a.name, a.locale)}
        elif a.remove:
            out = w.remove_speaker(a.remove, a.dry_run)
        else:
            out = {"speakers": w.collect()["speakers"]}
        text = [f"{k}: {v}" for k, v in out.items()]
    else:
        out = w.sync(a.part)
        text, code = [f"{k}: {v}" for k, v in out.items()], 2 if out.get("errors") else 0
    return code, json.dumps(out, indent=2, default=str, ensure_ascii=False) if a.json else to_ascii("\n".join(text)) if a.command != "status" else "\n".join(text)


def main() -> int:
    spark = SparkSession.builder.appName("tonewright").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        code, text = run(spark, sys.argv[1:])
        print(text)
        return code
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        spark.stop()
