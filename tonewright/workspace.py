"""A project with its knowledge base: every command as a method.

Hand-written files and small artifacts are read and written by the driver; the corpus, its
statistics and the source index are DataFrames throughout."""

from __future__ import annotations

import datetime as dt
import os
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright import sinks
from tonewright.functions import stats
from tonewright.functions import text as T
from tonewright.functions import vocab as V
from tonewright.operators import collect, diff, drift, gaps, ingest, quality_gate, rules, sums, tone, validate
from tonewright.operators import index as I
from tonewright.plans import markdown, report, resolve
from tonewright.sources import extract, files

CARD_INPUTS = ("voice.md", "tone.md", "lexicon.md", "mechanics.md", "config.yml")
SHOWN = 20  # rows of a list that a command prints
STATS = "struct<" + ", ".join(f"{c}:long" for c in (*stats.COUNTERS, *stats.ENGLISH)) + ", person_markers:boolean, has_english:boolean>"
INDEX = ingest.INDEX + f", stats {STATS}"


class Workspace:
    def __init__(self, spark: SparkSession, root: str, kb: str, profile: str = "default", now: str | None = None, digest: Callable[[Column], Column] = lambda content: F.sha2(content, 256)):
        """`digest` is the identity of contents; one index is kept with one digest."""
        self.digest = digest
        self.spark, self.root, self.base, self.profile = spark, os.path.abspath(root), os.path.abspath(kb), profile
        self.now = now or dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds").replace("+00:00", "Z")
        self.work: list[str] = []
        self.kb = resolve.resolve(self.base, profile)
        self.config = self.kb["config"]
        own = markdown.profile(self.config, profile)
        self.primary = own.get("primary_locale") or "en"
        self.locales = list(own.get("locales") or [self.primary])
        speaking = self.kb["role"] == "speaker"
        self.artifacts = resolve.overlay_root(self.base, profile) if speaking else self.base
        self.register = files.entries_for(files.load_register(self.config), profile)

    def path(self, *parts: str) -> str:
        return os.path.join(self.artifacts, *parts)

    def close(self) -> None:
        """Removes what reports of this workspace were made of."""
        while self.work:
            shutil.rmtree(self.work.pop(), ignore_errors=True)

    @property
    def index_base(self) -> str:
        return os.path.join(self.base, "evidence", "sources")

    def index(self) -> DataFrame:
        """The entries of this profile."""
        mine = F.col("profile").isNull() if self.kb["role"] == "house" else F.col("profile") == self.profile
        return self.whole_index().where(mine)

    def whole_index(self) -> DataFrame:
        return sinks.load_index(self.spark, self.index_base, INDEX)

    # --- the corpus

    def resolved(self) -> tuple[DataFrame, list[dict]]:
        found, notes = files.resolve_register(self.spark, self.register, self.root, self.base)
        return found.withColumn("locale", files.locale_of(F.col("rel"), self.locales, self.primary)), notes

    def live(self) -> tuple[DataFrame, DataFrame]:
        """(text files of the project with units; files without an extractor or with none of
        their strings: origin, reason)."""
        found, _ = self.resolved()
        project = found.where("kind = 'project'")
        container = F.coalesce(extract.is_container(F.col("format")), F.lit(False))
        skipped = project.where(F.col("format").isNull() | container).select("origin", F.when(F.col("format").isNull(), "no-extractor").otherwise("container").alias("reason"))
        texts = files.read_text(project.where(F.col("format").isNotNull() & ~container)).withColumn("raw", T.normalize_eol(F.col("raw")))
        units = texts.withColumns({"strings": extract.extract_units(F.col("format"), F.col("raw")), "headings": self._headings()})
        bad = units.where((F.col("format") == "json") & (F.size("strings") == 0)).select("origin", F.lit("unreadable").alias("reason"))
        return units, skipped.unionByName(bad)

    @staticmethod
    def _headings():
        none = F.array().cast("array<string>")
        return F.when(F.col("format") == "markdown", extract.markdown_headings(F.col("raw"))).when(F.col("format") == "html", extract.html_headings(F.col("raw"))).otherwise(none)

    def statistics(self) -> DataFrame:
        """Statistics of the live files and, where no live file has the origin, of the index."""
        units, _ = self.live()
        live = stats.unit_stats(units, ("origin", "locale"))
        held = I.contributing(self.index()).select("origin", "locale", "stats.*")
        return live.unionByName(held.join(live.select("origin").distinct(), "origin", "left_anti"))

    def summed(self) -> DataFrame:
        """The same, as sums per locale: those kept with the index, with the live files and
        without the entries that a live file stands for."""
        units, _ = self.live()
        live = stats.unit_stats(units, ("origin", "locale"))
        kept = sinks.IndexLog(self.spark, self.index_base).read("sums", sums.SCHEMA)
        if kept is None:
            return sums.summed(self.statistics(), "locale")
        mine = kept.where(F.col("profile").isNull() if self.kb["role"] == "house" else F.col("profile") == self.profile).drop("profile")
        over = sums.entries(self.index()).join(units.select("origin").distinct(), "origin", "left_semi").select("locale", "stats.*")
        return sums.together(mine, sums.summed(live, "locale"), sums.summed(over, "locale", sign=-1), keys=("locale",))

    def commit(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """The index changed, and its sums with it, as the next version; `change` may be asked
        again, with a newer index, where another writer came first."""
        return sinks.IndexLog(self.spark, self.index_base).update(INDEX, change, sums.maintained, sums.SCHEMA)

    def scan(self, out: str | None = None) -> dict:
        """The manifest: one row a file beside it, and the totals in it."""
        units, skipped = self.live()
        rows = stats.unit_stats(units, ("origin", "locale")).where("strings > 0").select("origin", "locale", "strings", "words", "sentences")
        held = self.index().where(F.col("status").isin(*V.CONTRIBUTING)).select("origin", "locale", "stats.strings", "stats.words", "stats.sentences")
        every = rows.unionByName(held.join(units.select("origin"), "origin", "left_anti"))
        where = out or self.path("evidence", "manifest.json")
        every.sort("origin").write.mode("overwrite").parquet(where + ".files")
        every = self.spark.read.parquet(where + ".files")
        sums = [F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("strings", "words", "sentences")]]
        by_locale = {r["locale"]: {k: r[k] for k in ("files", "strings", "words", "sentences")} for r in every.groupBy("locale").agg(*sums).sort("locale").collect()}
        reasons = {r.level: r.n for r in collect.count_by(skipped, "reason").collect()}
        found, notes = self.resolved()
        pending = I.unindexed(ingest.ingestible(found.where("format is not null")), self.whole_index())
        manifest = {
            "generated": self.now,
            "totals": every.agg(*sums).first().asDict(),
            "byLocale": by_locale,
            "skipped": {"count": sum(n for k, n in reasons.items() if k != "unreadable"), "byReason": reasons},
            "unreadable": {"count": reasons.get("unreadable", 0)},
            "unindexed": {"count": pending.count(), "first": [r.origin for r in pending.sort("origin").limit(SHOWN).collect()]},
            "missing": [n["id"] for n in notes if n["missing"]],
            "empty": [n["id"] for n in notes if n["empty"]],
        }
        sinks.write_json(where, manifest)
        return manifest

    def fingerprint(self, set_baseline: bool = False, source: str | None = None) -> dict:
        """The fingerprint of each locale; `source` keeps measured or estimated sources only."""
        if source:
            rows = self.statistics()
            tier = self.index().select("origin", F.when(F.col("tier") == "model", "estimated").otherwise("measured").alias("fidelity"))
            rows = rows.join(tier, "origin", "left").where(F.coalesce("fidelity", F.lit("measured")) == source).drop("fidelity")
            prints = stats.finalise(stats.merge_stats(rows, "locale"), "locale")
        else:
            prints = sums.fingerprint(self.summed(), "locale")
        prints = prints.sort("locale")
        locales = {r["locale"]: {k: v for k, v in r.asDict().items() if k != "locale"} for r in prints.collect()}
        return sinks.write_fingerprint(self.path("evidence", "fingerprint.json"), locales, self.now, set_baseline)

    # --- sources

    def candidates(self) -> DataFrame:
        found, _ = self.resolved()
        owner = F.lit(None).cast("string") if self.kb["role"] == "house" else F.lit(self.profile)
        return ingest.ingestible(found.where("format is not null")).withColumns({"sha256": self.digest(F.col("content")), "profile": owner})

    def check(self) -> DataFrame:
        return I.classify(self.whole_index(), self.candidates().drop("content"))

    def read(self, rows: DataFrame) -> DataFrame:
        """Status, note, tier, tokens and statistics of files: text, office containers, and
        PDF by its contract only (it has no reader here and waits for a model)."""
        container = extract.is_container(F.col("format"))
        raw = T.normalize_eol(F.when(~container, F.make_valid_utf8(F.col("content").cast("string"))))
        strings = F.when(container, extract.office_units("content", "format")).otherwise(extract.extract_units(F.when(~container, F.col("format")), raw))
        note = F.when((F.col("format") == "pdf") & (F.instr(F.decode("content", "ISO-8859-1"), "/Encrypt") > 0), "encrypted").otherwise("no-text-layer")
        none = F.array().cast("array<string>")
        texts = rows.withColumns({"strings": F.coalesce(strings, none), "headings": none, "fail": note}).withColumn("text", F.array_join("strings", "\n"))
        scored = quality_gate.score(texts, fmt="format")
        counted = stats.unit_stats(scored, tuple(c for c in scored.columns if c not in ("strings", "headings")))
        names = [*stats.COUNTERS, *stats.ENGLISH, "person_markers", "has_english"]
        out = counted.withColumn("stats", F.struct(*names)).drop(*names)
        status = ingest.read_status(F.col("tokens"), F.col("passed"), F.col("fail"))
        return out.withColumns({**status, "tier": F.lit("script")}).drop("text", "fail", "passed", "reasons")

    def ingest(self, only: str | None = None) -> ingest.Ingested:
        """One hashing of what is resolved and one reading of what is new, both stored beside
        the index: the index and every report are made of them."""
        candidates, done = self.candidates(), None

        def change(index: DataFrame) -> DataFrame:
            nonlocal done
            done = ingest.run(index, candidates, self.read, self.now, only, self._kept)
            return done.index

        self.commit(change)
        return done

    def _kept(self, df: DataFrame) -> DataFrame:
        """`df` stored beside the index until `close`."""
        at = f"{self.index_base}/work/{uuid.uuid4().hex}"
        self.work.append(at)
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def take_in(self, arrived: DataFrame, register_id: str, batch: tuple[str, int]) -> None:
        """A batch of a stream of files (rel, content) of a register entry, as `ingest` takes
        all files of it: read, counted and named alike.  A batch that comes again changes
        nothing; what a batch lacks is not missing."""
        owner = F.lit(None).cast("string") if self.kb["role"] == "house" else F.lit(self.profile)
        origin = F.concat(F.lit(f"{register_id}:"), "rel")
        rows = arrived.select(F.lit(register_id).alias("register_id"), F.lit("local").alias("kind"), origin.alias("origin"), "rel", "content", extract.format_of(F.col("rel")).alias("format"), files.locale_of(F.col("rel"), self.locales, self.primary).alias("locale"))
        rows = rows.where("format is not null").withColumns({"sha256": self.digest(F.col("content")), "profile": owner})
        log = sinks.IndexLog(self.spark, self.index_base)
        log.update(INDEX, lambda index: ingest.run(index, rows, self.read, self.now, None, self._kept, complete=False).index, sums.maintained, sums.SCHEMA, batch=batch)
        self.close()

    def refresh(self, pages: DataFrame, only: str | None = None) -> DataFrame:
        """`pages`: register_id, url, code, content_type, body, error, as `ingest.fetched` gives."""
        pages = ingest.only(pages, only, "register_id", "url")
        read = ingest.page_status(pages, extract.html_units(F.coalesce("body", F.lit("")))).withColumns({"origin": F.col("url"), "content": F.encode(F.coalesce("body", F.lit("")), "UTF-8"), "format": F.lit("html"), "locale": F.lit(self.primary), "profile": F.lit(None).cast("string"), "kind": F.lit("url")})
        bad = read.where("note = 'unreadable'").select("register_id", "origin", F.lit("failed").alias("outcome"))
        good = self.read(read.where("note <> 'unreadable'").withColumn("sha256", self.digest(F.col("content"))).drop("note"))
        told = None

        def change(index: DataFrame) -> DataFrame:
            nonlocal told
            after, told = ingest.refresh(index, good, self.now)
            return after

        before = self.whole_index()
        change(before)
        retain = {e["id"] for e in self.register if e.get("retain") == "snapshot"}
        if retain:
            kept = told.where("outcome <> 'unchanged'").join(pages.select("register_id", "body"), "register_id").withColumn("retain", F.when(F.col("register_id").isin(*retain), "snapshot"))
            sinks.write_snapshots(kept, os.path.join(self.base, "evidence", "snapshots"), self.now[:10])
        every = told.unionByName(bad, allowMissingColumns=True)
        told = self.spark.createDataFrame(every.collect(), every.schema)  # one row an address of the register
        result = told
        self.commit(change)
        return result

    def forget(self, entry_id: str) -> list[str]:
        """The rules to reopen."""
        whole = self.whole_index()
        if not whole.where(F.col("entry_id") == entry_id).limit(1).count():
            raise ValueError(f"no source {entry_id}")
        _, reopened = I.forget(whole, self.spark.createDataFrame([(entry_id,)], "entry_id string"))
        out = sorted(r.rule_id for r in reopened.collect())
        gone = self.spark.createDataFrame([(entry_id,)], "entry_id string")
        self.commit(lambda index: I.forget(index, gone)[0])
        return out

    def add_source(self, kind: str, where: str, label: str | None = None) -> str:
        new = files.next_id([e.get("id", "") for e in self.config.get("sources") or []], "s", 2)
        item = {"id": new, "kind": kind, ("url" if kind == "url" else "path"): where} | ({"label": label} if label else {}) | ({"profile": self.profile} if self.kb["role"] == "speaker" else {})
        self._edit_config(lambda t: sinks.add_item(t, "sources", item))
        return new

    def _edit_config(self, f: Callable[[str], str]) -> None:
        path = os.path.join(self.base, "config.yml")
        text = open(path, encoding="utf-8").read() if os.path.exists(path) else ""
        changed = f(text)
        markdown.parse_yaml(changed)  # what is written can be read
        sinks.write_text(path, changed)

    # --- rules

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def rules_frame(self) -> DataFrame:
        cells = lambda r, *names: next((r["cells"][n] for n in names if r["cells"].get(n)), None)
        return rules.rules_frame(self.spark, [{"id": r["id"], "kind": r["kind"], "file": r["file"], "confidence": r["confidence"], "locked": r["locked"], "avoid": cells(r, "Avoid"), "prefer": cells(r, "Prefer"), "pattern": cells(r, "Pattern")} for r in self.kb["rules"]])

    def counted_rules(self) -> DataFrame:
        units, _ = self.live()
        return rules.hits(units.select(F.col("origin").alias("unit_id"), F.array_join("strings", "\n").alias("t")), self.rules_frame())

    def validate(self) -> DataFrame:
        kb = self.kb
        if not kb["exists"]:
            return validate.kb_checks(self._frame([(self.base, False)], "root string, exists boolean"))
        made = self._frame([(r["id"], r["kind"], r["file"], r["confidence"], r["evidence"], r["locked"], k) for k, r in enumerate(kb["rules"])], "id string, kind string, file string, confidence string, evidence array<string>, locked boolean, pos int")
        ledger = self._frame([(e["id"], e["type"], e["produced"]) for e in kb["evidence"]], "id string, type string, produced array<string>")
        known = self._frame([(i,) for i in kb["known_ids"]], "id string")
        cells = self._frame([(c["context"], c["state"], c["dials"]) for c in kb["cells"]], "context string, state string, dials map<string,int>")
        vectors = self._frame([(k, n, d) for k, rows in kb["vectors"].items() for n, d in rows.items()], "kind string, name string, dials map<string,int>")
        idx = self.index().select("entry_id", "sha256", "status", "locale", F.col("stats").isNotNull().alias("has_stats"), "produced", F.col("format").alias("extractor"), F.lit("1").alias("version"))
        locks = self._frame([(i,) for i in kb["locks"]], "id string")
        names = resolve.speakers(self.config)
        folder = os.path.join(self.base, "profiles")
        folders = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
        house = self._frame([(r["id"],) for r in kb["rules"] if r["origin"] == "house"], "id string")
        broken = self._frame([(i,) for i in kb["lock_violations"]], "id string")
        return validate.union(
            [
                validate.rule_checks(made, ledger, known),
                validate.cell_checks(cells),
                validate.vector_checks(vectors) if any(kb["vectors"].values()) else validate.cell_checks(cells.where("false")),
                validate.index_checks(idx, known, made.select("id", "evidence"), ledger.select("id", "type"), self._frame([(x,) for x in self.locales], "locale string"), self._frame([], "name string, version string")),
                validate.lock_checks(locks, house, broken, self._frame([(s,) for s in names], "slug string"), self._frame([(s,) for s in folders], "slug string")),
                validate.heading_checks(self._frame([(h["id"],) for h in kb["unparsed"]], "id string")),
            ]
        )

    def compile_card(self) -> tuple[str, int]:
        """Writes the card; returns it and its estimated tokens."""
        hit = {r.id: r.hits for r in self.counted_rules().collect()}
        ranked = sorted((r for r in self.kb["rules"] if r["confidence"] != "disputed"), key=lambda r: (-hit.get(r["id"], 0), r["confidence"] != "confirmed", r["id"]))
        lexicon = [{"avoid": r["cells"].get("Avoid", r["id"]), "prefer": r["cells"].get("Prefer"), "confidence": r["confidence"]} for r in ranked if r["file"] == "lexicon"]
        mechanics = [{"id": r["id"], "rule": r["cells"].get("Rule"), "confidence": r["confidence"]} for r in ranked if r["file"] == "mechanics"]
        own = None
        if self.kb["role"] == "speaker":
            of = markdown.read_kb(self.artifacts)
            own = {"channels": of["channels"], "locales": of["locales"], "audience": os.path.exists(os.path.join(self.artifacts, "audience.md"))}
        card = report.card(self.kb, lexicon, mechanics, self.profile, self.now, own)
        sinks.write_text(self.path("CONTEXT.md"), card)
        return card, -(-len(card) // 4)

    def diff(self, draft: str, final: str) -> dict:
        """Word changes of a draft; kept beside it."""
        text = lambda p: open(p, encoding="utf-8-sig").read()
        row = diff.diff(self._frame([(text(draft), text(final))], "draft string, final string")).first()
        out = row.asDict(recursive=True)
        for k in ("draft", "final"):
            out.pop(k, None)
        name = os.path.splitext(os.path.basename(draft))[0]
        sinks.write_json(os.path.join(self.base, ".drafts", f"{name}.diff.json"), out)
        return out

    # --- the state and its reports

    def _modified(self, path: str) -> float | None:
        return os.path.getmtime(path) if os.path.exists(path) else None

    def stale_card(self) -> list[str] | None:
        inputs = {n: self._modified(os.path.join(self.base, n)) for n in CARD_INPUTS}
        if self.kb["role"] == "speaker":
            inputs |= {f"profiles/{self.profile}/{n}": self._modified(self.path(n)) for n in CARD_INPUTS}
        return collect.stale_inputs(self._modified(self.path("CONTEXT.md")), inputs)

    def drafts(self) -> dict[str, int]:
        folder = os.path.join(self.base, ".drafts")
        if not os.path.isdir(folder):
            return {}
        texts = [(open(os.path.join(folder, f), encoding="utf-8-sig").read(),) for f in sorted(os.listdir(folder)) if f.endswith(".md")]
        return {r.profile: r.drafts for r in collect.drafts_by_profile(self._frame(texts, "text string")).collect()}

    def speaker(self, slug: str) -> dict:
        w = self if slug == self.profile else Workspace(self.spark, self.root, self.base, slug, self.now)
        prints = sinks.read_json(w.path("evidence", "fingerprint.json"), {}) or {}
        manifest = sinks.read_json(w.path("evidence", "manifest.json"), {}) or {}
        return {
            "slug": slug,
            "name": markdown.profile(self.config, slug).get("name") or slug,
            "voice_rules": sum(r["origin"] == "speaker" and r["id"].startswith("V") for r in w.kb["rules"]),
            "has_dials": w.kb["role"] == "speaker" and w.kb["default_dials"] is not None,
            "cells": len(w.kb["cells"]) if w.kb["role"] == "speaker" else 0,
            "overrides": len(w.kb["overrides"]),
            "violations": len(w.kb["lock_violations"]),
            "words": (manifest.get("totals") or {}).get("words", 0),
            "has_baseline": bool(prints.get("baseline")),
            "drift_flagged": any(d["flagged"] for d in w.drift()),
            "drafts": self.drafts().get(slug, 0),
            "never_ingested": (manifest.get("unindexed") or {}).get("count", 0),
            "stale_card": w.stale_card(),
        }

    def drift(self, locale: str | None = None) -> list[dict]:
        prints = sinks.read_json(self.path("evidence", "fingerprint.json"), {}) or {}
        schema = "locale string, " + ", ".join(f"{m} double" for m in V.DRIFT_METRICS)
        frame = lambda held: self._frame([(k, *[None if v.get(m) is None else float(v[m]) for m in V.DRIFT_METRICS]) for k, v in (held or {}).items()], schema)
        rows = drift.drift(frame((prints.get("baseline") or {}).get("locales")), frame(prints.get("locales")), self.config["thresholds"]["drift_pct"])
        return [r.asDict() for r in collect.in_locale(rows, locale).sort("locale", "metric").collect()]

    def collect(self, refresh: bool = False, locale: str | None = None) -> dict:
        """Everything that the reports show; an absent artifact is an absent value, never an error."""
        kb, manifest = self.kb, sinks.read_json(self.path("evidence", "manifest.json"))
        prints = sinks.read_json(self.path("evidence", "fingerprint.json"), {}) or {}
        findings = [r.asDict() for r in self.validate().collect()]
        card = self.path("CONTEXT.md")
        listed = self.path("evidence", "manifest.json") + ".files"
        rows = self.spark.read.parquet(listed) if manifest and os.path.isdir(listed) else self._frame([], "origin string, locale string, strings long, words long, sentences long")
        rows = collect.in_locale(rows, locale)
        authored = self._frame([(c["context"], c["state"], *[c["dials"].get(d) for d in V.DIALS]) for c in kb["cells"]], tone.CELL)
        full = lambda k, default: {n: tuple(kb["vectors"][k].get(n, {}).get(d, v[i]) for i, d in enumerate(V.DIALS)) for n, v in default.items()}
        grid = tone.matrix(self.spark, tone.vector_frame(self.spark, "state", full("state", V.STATE_VECTORS)), tone.vector_frame(self.spark, "context", full("context", V.CONTEXT_OFFSETS)), authored, kb["offset"])
        cover = tone.coverage(grid, rows.select(files.context_of(F.col("origin")).alias("context"), "words"))
        matrix = [r.asDict() for r in cover.join(collect.cells_by_state(grid), "context").sort("context").collect()]
        confidences = collect.zero_filled(collect.count_by(self._frame([(r["confidence"],) for r in kb["rules"]], "c string"), "c"), V.CONFIDENCES)
        evidence = collect.zero_filled(collect.count_by(self._frame([(e["type"],) for e in kb["evidence"]], "t string"), "t"), V.EVIDENCE_TYPES)
        idx = self.index()
        freshness = collect.source_freshness(self.check().select("kind", "class") if refresh else None, self.spark).first()
        fresh = None
        if manifest:
            now_there, _ = files.resolve_register(self.spark, [e for e in self.register if e["kind"] == "project"], self.root, self.base)
            fresh = collect.manifest_freshness(rows, now_there.select("origin", "modified"), F.to_timestamp(F.lit(manifest["generated"]))).first().asDict() if "modified" in now_there.columns else None
        people = [self.speaker(s) for s in ([self.profile] if kb["role"] == "speaker" else resolve.speakers(self.config))] if kb["exists"] else []
        reached = {"scan": manifest is not None, "ingest": idx.limit(1).count() > 0 or not [e for e in self.register if e["kind"] != "project"], "measure": bool(prints.get("locales")), "draft": bool(kb["rules"]), "interview": any(r["confidence"] == "confirmed" for r in kb["rules"]), "canonize": os.path.exists(card) and not any(f["severity"] == "error" for f in findings)}
        state = {
            "generated": self.now,
            "stages": reached if kb["exists"] else dict.fromkeys(V.STAGES, False),
            "findings": findings,
            "matrix": matrix,
            "rules": [{"confidence": r.level, "n": r.n} for r in confidences.sort("pos").collect()],
            "evidence": [{"type": r.level, "n": r.n} for r in evidence.sort("pos").collect()],
            "drift": self.drift(locale),
            "sources": [{"status": r.level, "n": r.n} for r in collect.count_by(idx, "status").sort("level").collect()],
            "settings": dict(self.config["thresholds"]) | {"register": len(self.register), "kb_version": self.config["kb_version"]},
            "speakers": [p | {"rules": p["voice_rules"] + p["overrides"]} for p in people],
            "freshness": freshness.asDict() | {"card": self.stale_card(), "manifest": fresh},
            "corpus": (manifest or {}).get("totals"),
        }
        state["gaps"] = [r.asDict() for r in gaps.ranked(gaps.detect(self._gap_state(state, prints, manifest, people))).collect()]
        return state

    def _gap_state(self, s: dict, prints: dict, manifest: dict | None, people: list[dict]) -> DataFrame:
        kb = self.kb
        based = (prints.get("baseline") or {}).get("locales") or {}
        count = lambda c: next((r["n"] for r in s["rules"] if r["confidence"] == c), 0)
        fresh = s["freshness"]["manifest"]
        named = lambda f: [p["slug"] for p in people if f(p)]
        card = self.path("CONTEXT.md")
        known = {
            "exists": kb["exists"],
            "errors": sum(f["severity"] == "error" for f in s["findings"]),
            "unbaselined": [x for x in (prints.get("locales") or {}) if x not in based],
            "never_ingested": ((manifest or {}).get("unindexed") or {}).get("count", 0),
            "rules": len(kb["rules"]),
            "assumed": count("assumed"),
            "bare_contexts": [c["context"] for c in s["matrix"] if not c["authored"] and c["traffic"] >= collect.TRAFFIC_FLOOR],
            "stale_card_inputs": s["freshness"]["card"],
            "manifest_checked": manifest is not None,
            "manifest_changed": (fresh or {}).get("changed_since"),
            "flagged_metrics": sum(d["flagged"] for d in s["drift"]),
            "disputed": max(count("disputed"), kb["conflicts"]),
            "freshness_checked": s["freshness"]["freshness"] == "checked",
            "stale_sources": s["freshness"]["stale"],
            "locales_without_pack": sorted(set(self.locales) - set(kb["locales"]) - {self.primary}),
            "drafts": self.drafts().get(self.profile, 0),
            "stale_extractors": sum(f["code"] == "W_STALE_EXTRACTOR" for f in s["findings"]),
            "no_evidence": sum(f["code"] == "W_NO_EVIDENCE" for f in s["findings"]),
            "card_tokens": -(-os.path.getsize(card) // 4) if os.path.exists(card) else 0,
            "voiceless_speakers": named(lambda p: not p["voice_rules"] and not p["has_dials"]),
            "unbaselined_speakers": named(lambda p: not p["has_baseline"]),
            "uningested_speakers": named(lambda p: p["never_ingested"]),
            "stale_speaker_cards": [f"[{p['slug']}] {x}" for p in people for x in p["stale_card"] or []],
            "speakers": len(people),
            "locks": len(kb["locks"]),
        }
        names = [x.strip().split(" ")[0] for x in gaps.STATE.split(",")]
        return self._frame([tuple(known[n] for n in names)], gaps.STATE)

    def status(self, width: int | None = None, panels: tuple[str, ...] = (), refresh: bool = False, locale: str | None = None, artifact: str | None = None) -> str:
        state = self.collect(refresh, locale)
        if artifact:
            sinks.write_text(artifact, report.page(state))
        return report.status(state, width, panels)

    def sync(self, part: str = "patch") -> dict:
        """Validates, compiles the card, raises the version and removes settled drafts (those
        with a diff); with an error nothing is changed."""
        errors = [r.asDict() for r in self.validate().where("severity = 'error'").collect()]
        if errors:
            return {"errors": errors}
        numbers = [int(x) for x in str(self.config["kb_version"]).split(".")]
        k = ("major", "minor", "patch").index(part)
        version = ".".join(map(str, [*numbers[:k], numbers[k] + 1, *[0] * (2 - k)]))

        def bump(text: str) -> str:
            lines = [f"kb_version: {version}" if x.startswith("kb_version:") else x for x in text.rstrip("\n").split("\n")]
            return "\n".join(lines if any(x.startswith("kb_version:") for x in lines) else [f"kb_version: {version}", *lines]) + "\n"

        self._edit_config(bump)
        folder, pruned = os.path.join(self.base, ".drafts"), []
        for f in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
            if f.endswith(".md") and os.path.exists(os.path.join(folder, f[:-3] + ".diff.json")):
                os.remove(os.path.join(folder, f))
                pruned.append(f)
        self.config["kb_version"] = version
        return {"version": version, "tokens": self.compile_card()[1], "pruned": pruned}

    # --- speakers

    def add_speaker(self, slug: str, name: str | None = None, locale: str | None = None) -> str:
        if not resolve.SLUG.fullmatch(slug):
            raise ValueError(f"not a slug: {slug}")
        if slug == "default" or slug in self.config["profiles"]:
            raise ValueError(f"{slug} is declared already")
        self._edit_config(lambda t: sinks.add_entry(t, "profiles", slug, {"name": name or slug} | ({"primary_locale": locale, "locales": [locale]} if locale else {})))
        folder = resolve.overlay_root(self.base, slug)
        for f, head in (("voice.md", "# Voice\n"), ("tone.md", "# Tone\n")):
            if not os.path.exists(os.path.join(folder, f)):
                sinks.write_text(os.path.join(folder, f), head)
        return folder

    def remove_speaker(self, slug: str, dry_run: bool = False) -> dict:
        if slug not in resolve.speakers(self.config):
            raise ValueError(f"no speaker {slug}")
        folder, whole = resolve.overlay_root(self.base, slug), self.whole_index()
        ledger = self._frame([((e["fields"].get("Profile") or "").strip() or None, e["produced"]) for e in self.kb["evidence"]], "profile string, produced array<string>")
        reopened = sorted(r.rule_id for r in ingest.owned_rules(ledger, whole, slug).collect())
        gone = whole.where(F.col("profile") == slug).count()
        plan = {"slug": slug, "overlay": folder if os.path.isdir(folder) else None, "entries": gone, "registered": [e["id"] for e in self.config.get("sources") or [] if e.get("profile") == slug], "reopen": reopened, "removed": not dry_run}
        if dry_run:
            return plan
        if gone:
            self.commit(lambda index: ingest.without_speaker(index, slug))
        self._edit_config(lambda t: sinks.remove_entry(sinks.remove_items(t, "sources", "profile", slug), "profiles", slug))
        shutil.rmtree(folder, ignore_errors=True)
        return plan

