"""Sinks: texts, JSON artifacts, index versions, snapshots, and edits of the configuration.

Small artifacts are written by the driver beside the hand-written files; whatever grows with
the corpus is written by Spark.  A file that is replaced is written beside and moved over, so
that a reader sees the old or the new one."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.operators.index import entry_order


def write_text(path: str, text: str) -> None:
    """Folders are made; line ends are LF."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "w", encoding="utf-8", newline="\n") as f:
        f.write(text.replace("\r\n", "\n").replace("\r", "\n"))
    os.replace(beside, path)


def write_json(path: str, value) -> None:
    write_text(path, json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n")


def read_json(path: str, default=None):
    """A stored artifact; absent or damaged is the default."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (FileNotFoundError, ValueError):
        return default


def write_fingerprint(path: str, locales: dict[str, dict], now: str, set_baseline: bool = False) -> dict:
    """The current fingerprint; the baseline stays unless one is asked for."""
    held = read_json(path, {}) or {}
    new = {"generated": now, "locales": locales, "baseline": held.get("baseline")}
    if set_baseline:
        new["baseline"] = {"generated": now, "locales": locales}
    write_json(path, new)
    return new


# --- the source index: a log of commits, each of which names its data


class IndexLog:
    """Versions of the source index on any file system that Hadoop reads.

    Data is written under a name of its own first; a version exists when its entry of the log
    does.  An entry is put only where none is: a writer that lost takes the newer version and
    does its work again, so that no update is lost, and one that stops half-way leaves the
    version before it.  The sums of statistics that a version keeps are named by its entry."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())
        root = self._fs.makeQualified(self._path(self.base))
        self._disk = root.toUri().getPath() if root.toString().startswith("file:") else None

    def _at(self, *parts: str):
        return self._path("/".join((self.base, *parts)))

    def _entry_path(self, version: int) -> tuple[str, str]:
        return "_log", f"{version:010d}.json"

    def version(self) -> int:
        """The latest; -1 where nothing is stored."""
        log = self._at("_log")
        if not self._fs.exists(log):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return max((int(n[:10]) for n in names if re.fullmatch(r"[0-9]{10}\.json", n)), default=-1)

    def entry(self, version: int) -> dict:
        stream = self._fs.open(self._at(*self._entry_path(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, version: int, entry: dict) -> bool:
        """Whether the entry is there now by this call: it is complete or absent for readers."""
        folder, name = self._entry_path(version)
        text = json.dumps(entry)
        if self._disk is not None:
            beside = os.path.join(self._disk, folder, f".{uuid.uuid4().hex}")
            write_text(beside, text)
            try:
                os.link(beside, os.path.join(self._disk, folder, name))
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(beside)
        beside = self._at(folder, f".{uuid.uuid4().hex}")
        out = self._fs.create(beside, False)
        out.write(bytearray(text.encode()))
        out.close()
        # a rename does not replace a file
        done = not self._fs.exists(self._at(folder, name)) and self._fs.rename(beside, self._at(folder, name))
        if not done:
            self._fs.delete(beside, False)
        return bool(done)

    def read(self, kind: str, schema: str, version: int | None = None) -> DataFrame | None:
        """`data` or `sums` of a version; null where it keeps none."""
        v = self.version() if version is None else version
        where = self.entry(v).get(kind) if v >= 0 else None
        return self.spark.read.schema(schema).parquet(f"{self.base}/{where}") if where else None

    def update(self, schema: str, change: Callable[[DataFrame], DataFrame], sums: Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame] | None = None, sums_schema: str = "", keep: int = 2, tries: int = 50, batch: tuple[str, int] | None = None) -> int:
        """Commits `change` of the latest index, in the order of entry numbers, and the sums
        that `sums` makes of the index before, the new one and the sums before.  Data of all
        but the `keep` latest versions goes.  A `batch` (the name of a stream, a number) that
        the log has taken in before changes nothing."""
        for _ in range(tries):
            v = self.version()
            taken = dict(self.entry(v).get("batches", {})) if v >= 0 else {}
            if batch is not None and taken.get(batch[0], -1) >= batch[1]:
                return v
            held = self.read("data", schema, v)
            old = self.spark.createDataFrame([], schema) if held is None else held
            entry = {"version": v + 1, "data": f"data/{uuid.uuid4().hex}", "batches": taken | ({batch[0]: batch[1]} if batch else {})}
            change(old).sort(entry_order()).write.parquet(f"{self.base}/{entry['data']}")
            if sums is not None:
                entry["sums"] = f"sums/{uuid.uuid4().hex}"
                new = self.spark.read.schema(schema).parquet(f"{self.base}/{entry['data']}")
                sums(old, new, self.read("sums", sums_schema, v)).coalesce(1).write.parquet(f"{self.base}/{entry['sums']}")
            if self.put(v + 1, entry):
                self._clean(v + 1 - keep)
                return v + 1
            for kind in ("data", "sums"):
                if kind in entry:
                    self._fs.delete(self._at(entry[kind]), True)
        raise RuntimeError(f"{self.base}: other writers came first {tries} times")

    def _clean(self, last: int) -> None:
        for v in range(last, -1, -1):
            entry = self.entry(v)
            gone = [self._fs.delete(self._at(entry[k]), True) for k in ("data", "sums") if k in entry]
            if not any(gone):
                break


def load_index(spark: SparkSession, base: str, schema: str) -> DataFrame:
    held = IndexLog(spark, base).read("data", schema)
    return spark.createDataFrame([], schema) if held is None else held


def save_index(index: DataFrame, base: str, keep: int = 2) -> int:
    """The index as the next version, whatever was there."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return IndexLog(index.sparkSession, base).update(schema, lambda _: index, keep=keep)


def write_snapshots(pages: DataFrame, folder: str, date: str) -> None:
    """What was fetched of entries that are to be retained: (entry_id, body), once a day each."""
    pages.where(F.col("retain") == "snapshot").where("body is not null").select("entry_id", "body").write.mode("append").parquet(os.path.join(folder, f"date={date}"))


# --- the configuration: lines are added and taken away, so that comments stay


def to_yaml(value, indent: int = 0) -> str:
    """Block maps and sequences; scalars are quoted where they would be read as something else."""
    pad = " " * indent
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{_scalar(str(k))}:" + (f" {_scalar(v)}\n" if _flat(v) else "\n" + to_yaml(v, indent + 2)) for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}- {_scalar(v)}\n" if _flat(v) else f"{pad}- " + to_yaml(v, indent + 2).lstrip() for v in value)
    return f"{pad}{_scalar(value)}\n"


def _flat(v) -> bool:
    return not isinstance(v, (dict, list)) or not v or isinstance(v, list) and all(not isinstance(x, (dict, list)) for x in v)


def _scalar(v) -> str:
    if isinstance(v, dict):
        return "{}"
    if isinstance(v, list):
        return "[" + ", ".join(_scalar(x) for x in v) + "]"
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    s = str(v)
    plain = isinstance(v, (int, float)) or re.fullmatch(r"[A-Za-z_./][\w./ @-]*", s) and s.strip() == s and s not in ("true", "false", "null")
    return s if plain else json.dumps(s, ensure_ascii=False)


def _section(lines: list[str], key: str) -> tuple[int, int] | None:
    """The line of a top-level key, and the end of its block."""
    at = next((k for k, x in enumerate(lines) if re.match(rf"{re.escape(key)}:(?:\s|$)", x)), None)
    if at is None:
        return None
    end = at + 1
    while end < len(lines) and (not lines[end].strip() or lines[end][0] in " -#"):
        end += 1
    while end > at + 1 and (not lines[end - 1].strip() or lines[end - 1].startswith("#")):
        end -= 1
    return at, end


def add_item(text: str, key: str, item: dict | str) -> str:
    """The text with an item at the end of a top-level list."""
    body = to_yaml([item], 2).rstrip("\n").split("\n")
    lines = text.rstrip("\n").split("\n") if text.strip() else []
    where = _section(lines, key)
    if where is None:
        return "\n".join([*lines, f"{key}:", *body]) + "\n"
    at, end = where
    lines[at] = re.sub(r":\s*\[\s*\]", ":", lines[at])
    return "\n".join([*lines[:end], *body, *lines[end:]]) + "\n"


def remove_items(text: str, key: str, field: str, value: str) -> str:
    """The text without the items of a top-level list of maps whose `field` is `value`."""
    lines = text.rstrip("\n").split("\n")
    where = _section(lines, key)
    if where is None:
        return text
    at, end = where
    starts = [k for k in range(at + 1, end) if re.match(r"\s*- ", lines[k])]
    depth = min((len(lines[k]) - len(lines[k].lstrip()) for k in starts), default=0)
    starts = [k for k in starts if len(lines[k]) - len(lines[k].lstrip()) == depth]
    is_it = re.compile(rf"\s*(?:- )?\s*{re.escape(field)}:\s*[\"']?{re.escape(value)}[\"']?\s*(?:#.*)?$")
    gone = [(a, b) for a, b in zip(starts, [*starts[1:], end], strict=True) if any(is_it.match(x) for x in lines[a:b])]
    out = [x for k, x in enumerate(lines) if not any(a <= k < b for a, b in gone)]
    if gone and len(gone) == len(starts):
        out[at] = f"{key}: []"
    return "\n".join(out) + "\n"


def add_entry(text: str, key: str, name: str, value: dict) -> str:
    """The text with a map entry at the end of a top-level map."""
    body = to_yaml({name: value}, 2).rstrip("\n").split("\n")
    lines = text.rstrip("\n").split("\n") if text.strip() else []
    where = _section(lines, key)
    if where is None:
        return "\n".join([*lines, f"{key}:", *body]) + "\n"
    return "\n".join([*lines[: where[1]], *body, *lines[where[1] :]]) + "\n"


def remove_entry(text: str, key: str, name: str) -> str:
    """The text without an entry of a top-level map."""
    lines = text.rstrip("\n").split("\n")
    where = _section(lines, key)
    if where is None:
        return text
    a = next((k for k in range(where[0] + 1, where[1]) if re.match(rf"  [\"']?{re.escape(name)}[\"']?:(?:\s|$)", lines[k])), None)
    if a is None:
        return text
    b = a + 1
    while b < where[1] and (not lines[b].strip() or len(lines[b]) - len(lines[b].lstrip()) > 2):
        b += 1
    return "\n".join(lines[:a] + lines[b:]) + "\n"
