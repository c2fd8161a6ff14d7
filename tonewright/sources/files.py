"""Sources: directory scans, globs, register entries, locale attribution and artifacts."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.functions import text as T
from tonewright.functions import vocab as V
from tonewright.sources import tree
from tonewright.sources.extract import format_of
from tonewright.sources.tree import glob_regex, pruned  # noqa: F401


def matches_any(path: Column, patterns: list[str]) -> Column:
    return F.lit(False) if not patterns else path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def is_inside(parent: str, target: str) -> bool:
    rel = os.path.relpath(os.path.realpath(target), os.path.realpath(parent))
    return rel != ".." and not rel.startswith(".." + os.sep) and not os.path.isabs(rel)


def scan_files(spark: SparkSession, root: str, include: list[str], exclude: list[str]) -> DataFrame:
    """(rel, bytes, modified, content, format) of the files that the globs take, of a root that
    is a path or a URI.  Exclusion wins; no include takes nothing; a root that is no folder is
    an error.  Excluded folders are never listed, links are not followed."""
    at = tree.Tree(spark, root)
    return at.read(list(at.walk(include, exclude))).withColumn("format", format_of(F.col("rel")))


def read_text(files: DataFrame) -> DataFrame:
    """Adds `raw`: UTF-8 (other bytes as replacement characters), without byte order mark, line
    ends folded."""
    return files.withColumn("raw", T.normalize_eol(F.make_valid_utf8(F.col("content").cast("string"))))


def load_register(config: dict) -> list[dict]:
    """The declared entries, or one made of the scan globs."""
    if config.get("sources"):
        return [dict(e) for e in config["sources"]]
    scan = config.get("scan", {})
    return [{"id": "s01", "kind": "project", "label": "project", "include": scan.get("include", []), "exclude": scan.get("exclude", []), "profile": "default"}]


def entries_for(register: list[dict], profile: str) -> list[dict]:
    owner = None if profile == "default" else profile
    return [e for e in register if (None if e.get("profile") in (None, "default") else e["profile"]) == owner]


def next_id(ids: list[str], prefix: str, width: int) -> str:
    """One more than the greatest number; ids are never renumbered."""
    return f"{prefix}{max((int(i[1:]) for i in ids if re.fullmatch(prefix + r'[0-9]+', i)), default=0) + 1:0{width}d}"


def resolve_register(spark: SparkSession, register: list[dict], project: str, kb: str) -> tuple[DataFrame, list[dict]]:
    """Files of all entries, and per entry whether its path is missing or empty.

    `project` applies globs at the root, `inbox` takes all files of a folder inside the
    knowledge base (leaving it raises), `local` any folder or file, `url` none."""
    frames, notes = [], []
    for e in register:
        if e["kind"] == "url":
            continue
        root = project if e["kind"] == "project" else os.path.expanduser(e["path"])
        if e["kind"] == "inbox":
            root = os.path.join(kb, e["path"])
            if not is_inside(kb, root):
                raise ValueError(f"{e['id']}: leaves the knowledge base")
        at = tree.Tree(spark, root)
        if not at.exists():
            notes.append({"id": e["id"], "missing": True, "empty": False})
            continue
        include, exclude = (e.get("include") or ([] if e["kind"] == "project" else ["**"])), e.get("exclude") or []
        if not at.is_folder():
            folder, name = at.parent()
            at = tree.Tree(spark, folder)
            found = [x for x in at.walk(["*"], exclude) if x.rel == name]
        else:
            found = list(at.walk(include, exclude))
        f = at.read(found).withColumn("format", format_of(F.col("rel")))
        prefix = "" if e["kind"] == "project" else f"{e['id']}:"
        frames.append(f.select(F.lit(e["id"]).alias("register_id"), F.lit(e["kind"]).alias("kind"), F.concat(F.lit(prefix), F.col("rel")).alias("origin"), "rel", "format", "bytes", "modified", "content", F.lit(e.get("profile") or "default").alias("profile")))
        notes.append({"id": e["id"], "missing": False, "empty": not found})
    if not frames:
        schema = "register_id string, kind string, origin string, rel string, format string, bytes long, modified timestamp, content binary, profile string"
        return spark.createDataFrame([], schema), notes
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out, notes


def locale_of(path: Column, locales: list[str], primary: str) -> Column:
    """The first declared locale that is a directory of the path, the file's stem or its suffix."""
    parts = F.split(path, "/")
    folders = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lower)
    stem = F.lower(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", ""))
    out = F.lit(primary)
    for x in reversed(locales):
        n = x.lower()
        out = F.when(F.array_contains(folders, n) | (stem == n) | stem.endswith("." + n) | stem.endswith("-" + n) | stem.endswith("_" + n), x).otherwise(out)
    return out


def context_of(path: Column) -> Column:
    """The context that a path belongs to, by its segments; null if none."""
    parts = F.split(F.lower(path), "/")
    out = None

    def names(c: str):
        return lambda s: (s == c) | (s == c.replace("-", "", 1)) | s.startswith(c + ".")

    for c in V.CONTEXTS:
        hit = F.exists(parts, names(c))
        out = F.when(hit, c) if out is None else out.when(hit, c)
    has = lambda *x: F.arrays_overlap(parts, F.array(*map(F.lit, x)))
    return out.when(has("marketing", "content"), "marketing-page").when(has("docs", "help"), "help-doc").when(has("locales", "ui"), "product-ui")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored artifact; absent or unreadable is empty."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:  # the analyser's error for a path that is not there
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
