"""Packing by concatenate and cut.

Pass one encodes each partition, writes its ids and each document's start within the
partition; pass two adds the prefix sums of the partition totals, which gives every
document its global offset, and cuts at multiples of the window.  A document that
crosses a boundary leaves one piece per window (its boundary records).  Only the last
sequence can be shorter than the window.

Bounds: the totals are one row per partition; ids are handled a batch at a time.  Rows
are never moved between partitions, so no document or source can make a task hot.
Defined results: null or empty text is the end token alone; repeated rows are packed
once each; null ids are ids; an empty table gives no pieces; other columns are not kept,
whatever their names; of special tokens that start alike the longest is met; texts of any
length are encoded whole.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from public_tokenizers import PATTERN
from tonewright.llm import bpe
from tonewright.llm.shared import conf_set, stored


#: A run of white space that goes to the automaton, which gives the same ids.
LONG_BLANK = re.compile(r"(?<!\s)\s{20000}")


class RankEncoder:
    """Ids by a rank-based library, for vocabularies whose ids are their merge ranks."""

    _made: dict[bytes, RankEncoder] = {}

    def __init__(self, spec: bytes):
        model, alphabet = json.loads(spec), bpe.byte_alphabet()
        self.spec = spec
        #: of two that start alike the longer one is met first
        self.special = {t["content"]: t["id"].to_bytes(4, "little") for t in sorted(model.get("added_tokens", []), key=lambda t: -len(t["content"]))}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        ranks = {bytes(alphabet[c] for c in s): i for s, i in model["model"]["vocab"].items() if s not in self.special}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, spec: bytes) -> RankEncoder | bpe.Automaton:
        """The encoder of a tokenizer file, made once per process; if its ids are not in
        the order of its merges, the automaton."""
        if spec not in cls._made:
            model = json.loads(spec)["model"]
            vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            ordered = all(vocab[a + b] == 256 + k for k, (a, b) in enumerate(merges))
            cls._made[spec] = cls(spec) if ordered else bpe.automaton(spec)
        return cls._made[spec]

    def encode(self, text: str) -> bytes:
        if self.split is None or not self.split.search(text):
            return self._plain(text)
        return b"".join(self.special.get(x) or self._plain(x) for x in self.split.split(text))

    def _plain(self, text: str) -> bytes:
        # the library's matcher keeps a state for every blank of a run and fails on a long one
        if LONG_BLANK.search(text):
            return bpe.automaton(self.spec).encode(text)
        return array("I", self.core.encode_ordinary(text)).tobytes()


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one: (doc_id, part, at, n, ids): tokens with the end token, packed as bytes,
    and the document's first position within its partition.  Written to the shared folder."""
    sc = docs.sparkSession.sparkContext
    spec = sc.broadcast(bpe.read_spec(tokenizer_path))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = RankEncoder.of(spec.value)
        context = TaskContext.get()
        part, at = context.partitionId() if context else 0, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                piece = batch.slice(k, 1000)
                ids = [auto.encode(t or "") + end for t in piece.column(1).to_pylist()]
                starts = []
                for x in ids:
                    starts.append(at)
                    at += len(x) // 4
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([part] * len(ids), pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "part", "at", "n", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    # whole texts and their ids are long rows, and a batch is held several times over
    with conf_set(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}):
        return stored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, part long, at long, n long, ids binary"), "tokens")


def bases(tokens: DataFrame) -> DataFrame:
    """Prefix sums of the partition totals, one row per partition that holds documents."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    rows, base = [], 0
    for r in totals:
        rows.append((r.part, base))
        base += r.n
    return tokens.sparkSession.createDataFrame(rows, "part long, base long")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, unless `with_ids` is off, the piece's ids as binary."""
    tokens = tokenised(docs, tokenizer_path, end_id, id_col, text_col)
    placed = tokens.join(F.broadcast(bases(tokens)), "part").select("doc_id", "n", "ids", (F.col("base") + F.col("at")).alias("first"))
    kind = tokens.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n, ids, first = (batch.column(k) for k in range(4))
            rows: list[list] = [[] for _ in names]
            where = []
            for k in range(batch.num_rows):
                at, total, data = first[k].as_py(), n[k].as_py(), memoryview(ids[k].as_buffer())
                start = 0
                while start < total:
                    length = min(total - start, window - (at + start) % window)
                    piece = data[4 * start : 4 * (start + length)]
                    where.append(k)
                    for col, v in zip(rows[1:], (start, length, zlib.crc32(piece), total, (at + start) // window, (at + start) % window, *([bytes(piece)] if with_ids else [])), strict=True):
                        col.append(v)
                    start += length
            cols = [doc.take(pa.array(where, pa.int64()))] + [pa.array(c, pa.binary() if x == "ids" else pa.int64()) for x, c in zip(names[1:], rows[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return placed.mapInArrow(cut, f"doc_id {kind}, " + ", ".join(f"`{x}` {'binary' if x == 'ids' else 'long'}" for x in names[1:]))
