"""A walk over the folders of any file system that Hadoop reads, with pruning.

Folders are listed one by one from the root, and only those that an include can take files of
and no exclude takes whole: what is pruned is never listed.  The walk asks for names only and
holds, like any listing of Spark, one entry a file on the driver; contents are read by
Spark's own binary source, which plans partitions by bytes.  That source passes over names
that begin with "_" or "."; these files are dealt to tasks that open them by themselves.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "rel string, bytes long, modified timestamp, content binary"


def glob_regex(pattern: str) -> str:
    """`*` and `?` within a segment, `**/` over any number of segments, `{a,b}`; anchored."""
    token = re.compile(r"\*\*/|\*\*|\*|\?|\{[^}]*\}|.", re.S)
    to = {"**/": "(?:[^/]*/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = [to.get(t) or ("(?:" + "|".join(map(re.escape, t[1:-1].split(","))) + ")" if t[0] == "{" and t[-1] == "}" and len(t) > 1 else re.escape(t)) for t in token.findall(pattern)]
    return "^" + "".join(parts) + "$"


def pruned(directory: str, exclude: list[str]) -> bool:
    """Whether a directory need not be listed: its pattern has a literal last segment that
    matches it, or a wildcard that matches a child and a grandchild alike."""
    for p in exclude:
        rx, last = re.compile(glob_regex(p)), p.rsplit("/", 1)[-1]
        if not re.search(r"[*?{]", last):
            if rx.match(directory):
                return True
        elif rx.match(f"{directory}/x") and rx.match(f"{directory}/x/y"):
            return True
    return False


def may_hold(directory: str, include: list[str]) -> bool:
    """Whether a glob can take a file at or below a directory ("" is the root)."""
    parts = directory.split("/") if directory else []
    for p in include:
        # a slash within braces is no end of a segment
        segments = re.findall(r"(?:\{[^}]*\}|[^/])+", p)
        fits = True
        for k, name in enumerate(parts):
            if k >= len(segments) or k == len(segments) - 1 and "**" not in segments[k]:
                fits = "{" in p and "/" in "".join(re.findall(r"\{[^}]*\}", p))
                break
            if "**" in segments[k] or "{" in segments[k] and "/" in segments[k]:
                break
            if not re.match(glob_regex(segments[k]), name):
                fits = False
                break
        if fits:
            return True
    return False


@dataclass(frozen=True)
class Found:
    rel: str
    path: str
    bytes: int
    modified: int  # milliseconds


class Tree:
    """A root folder or file, as a local path or a URI."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self.spark = spark
        given = root if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root) else "file://" + os.path.abspath(root)
        # a URI's own escapes are kept; a path is taken as it is
        Path = jvm.org.apache.hadoop.fs.Path
        self._path = Path(given) if given == root else Path("file", None, os.path.abspath(root))
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self._fs.makeQualified(self._path).toString().rstrip("/")
        self._jvm = jvm
        #: the folder on this machine's own disk that a path leads to, if any: its links are seen there
        real = self._fs.resolvePath(self._path) if self._fs.exists(self._path) else self._path
        self._disk = real.toUri().getPath() if real.toString().startswith("file:") else None

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def is_folder(self) -> bool:
        return self.exists() and self._fs.getFileStatus(self._path).isDirectory()

    def parent(self) -> tuple[str, str]:
        """The folder of a root that is a file, and its name."""
        return self._path.getParent().toString(), self._path.getName()

    def _linked(self, rel: str, status) -> bool:
        return status.isSymlink() or self._disk is not None and os.path.islink(os.path.join(self._disk, rel, status.getPath().getName()))

    def list(self, rel: str) -> Iterator[tuple[str, bool, str, int, int]]:
        """(name, is a folder, path, bytes, modified) of what a folder holds, links left out,
        by name."""
        at = self._jvm.org.apache.hadoop.fs.Path(self._path, rel) if rel else self._path
        out = []
        for s in self._fs.listStatus(at):
            if not self._linked(rel, s):
                out.append((s.getPath().getName(), s.isDirectory(), s.getPath().toString(), s.getLen(), s.getModificationTime()))
        yield from sorted(out)

    def walk(self, include: list[str], exclude: list[str]) -> Iterator[Found]:
        """The files that the globs take; exclusion wins, no include takes nothing."""
        if not self.is_folder():
            raise FileNotFoundError(f"no folder: {self.root}")
        wanted = re.compile("|".join(map(glob_regex, include))) if include else None
        barred = re.compile("|".join(map(glob_regex, exclude))) if exclude else None
        queue = [""] if include else []
        while queue:
            rel = queue.pop()
            for name, folder, *rest in self.list(rel):
                inner = f"{rel}/{name}" if rel else name
                if folder:
                    if may_hold(inner, include) and not pruned(inner, exclude):
                        queue.append(inner)
                elif wanted.match(inner) and not (barred and barred.match(inner)):
                    yield Found(inner, *rest)

    def read(self, files: list[Found]) -> DataFrame:
        """rel, bytes, modified, content of files found; a name's glob characters are its own."""
        hidden = [f for f in files if f.rel.rsplit("/", 1)[-1][0] in "_."]
        plain = [re.sub(r"([\\*?\[\]{}])", r"\\\1", f.path) for f in files if f.rel.rsplit("/", 1)[-1][0] not in "_."]
        out = self.spark.createDataFrame([], FILES)
        if plain:
            read = self.spark.read.format("binaryFile").load(plain)
            rel = F.substr("path", F.lit(len(self.root) + 2))
            out = read.select(rel.alias("rel"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")
        if hidden:
            listed = self.spark.createDataFrame([(f.rel, f.bytes, f.modified, f.path) for f in hidden], "rel string, bytes long, millis long, path string")
            opened = listed.mapInArrow(_opened, "rel string, bytes long, millis long, content binary")
            out = out.unionByName(opened.select("rel", "bytes", F.timestamp_millis("millis").alias("modified"), "content"))
        return out


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            path = b.column(3)[r].as_py()
            fs, inner = (pyarrow.fs.LocalFileSystem(), re.sub("^file:/+", "/", path)) if path.startswith("file:") else pyarrow.fs.FileSystem.from_uri(path)
            with fs.open_input_stream(inner) as f:
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(r, 1) for c in range(3)), pa.array([f.read()], pa.binary())], names=["rel", "bytes", "millis", "content"])
