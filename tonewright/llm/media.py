"""Media columns: payloads stored as images in archives that only byte ranges are read of.

`store` writes each payload as a lossless 8-bit grey PNG (64 samples a row) into tar
archives of one folder, one archive per task, each with an index member at its end.
`MediaArchiveSource` is a custom Spark data source over such a folder: the driver
knows the archives' sizes only and plans byte ranges of `range_bytes`; each task finds the
members that start in its range in the archive's index, reads them one by one, checks the member's CRC, reads a failed member again by its own
offset, and streams batches through Arrow.

Paths are URIs that pyarrow.fs or the local file system can open; the folder must be
shared by driver and executors.  Defined results: null or empty text is stored as 64 zero
bytes; equal texts have equal stored bytes; null ids and repeated rows are members of their
own; ids that are no integers are refused with a TypeError before anything runs; other columns
are not kept, whatever their names; texts of any length are one member each; a member that stays unreadable after the
retries raises, it is never skipped; an empty table leaves an empty folder and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StructType

from tonewright.llm.shared import scratch_path

ROW = 64
ARCHIVE_BYTES = 256 << 20
_MAGIC = b"MEDIAIDX"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, n_bytes long, payload binary, media binary"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """`payload` (a positive multiple of 64 bytes) as an 8-bit grey image, unfiltered rows."""
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 2)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image made by `to_png`; every chunk's CRC is checked."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not an image")
    at, width, data = 8, 0, []
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if raw[:, 0].any():
        raise ValueError("a filtered row")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """An 8 x 8 difference hash of the samples: each of 64 equal stretches against the next."""
    x = np.frombuffer(payload, np.uint8)
    edges = np.linspace(0, len(x), 65).astype(np.int64)
    means = np.add.reduceat(x.astype(np.float64), edges[:-1]) / np.diff(edges)
    bits = means > np.roll(means, -1)
    return f"{int(np.packbits(bits).view('>u8')[0]):016x}"


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def _tar_header(name: str, size: int) -> bytes:
    """A ustar header."""
    h = bytearray(512)
    h[: len(name)] = name.encode()
    for at, text in ((100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        h[at : at + len(text)] = text
    h[148:156] = b"%06o\0 " % sum(h)
    return bytes(h)


class _Archive:
    """Writes members; `close` adds the index member, whose last 16 bytes give its place."""

    def __init__(self, path: str):
        filesystem, self.path = _filesystem(path)
        self.fs, self.out, self.at, self.index = filesystem, filesystem.open_output_stream(self.path), 0, []

    def _put(self, name: str, body: bytes) -> int:
        head = _tar_header(name, len(body))
        self.out.write(head + body + bytes(-len(body) % 512))
        start = self.at + 512
        self.at = start + len(body) + -len(body) % 512
        return start

    def add(self, doc_id: int | None, n_bytes: int, media: bytes) -> None:
        start = self._put(f"{len(self.index):09d}.png", media)
        self.index.append((start, len(media), zlib.crc32(media), n_bytes, doc_id is None, doc_id or 0))

    def close(self) -> int:
        """The number of bytes before the index."""
        a = np.array(self.index, dtype=np.int64).reshape(-1, 6)
        body = zlib.compress(a.tobytes())
        start = self._put("index", body)
        self.out.write(bytes(1024 - 24) + struct.pack("<QQ8s", start, len(body), _MAGIC))
        self.out.close()
        return start - 512


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Writes the archives of `docs` under `folder`; returns the number of archives.

    Every attempt of a task writes names of its own; the names of the attempts that
    succeeded are kept in one row per archive, so a lost executor leaves no double rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        stem, names, sizes, archive = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}", [], [], None
        for batch in batches:
            for k in range(batch.num_rows):
                if archive is None:
                    names.append(f"{stem}-{len(names):04d}.tar")
                    archive = _Archive(names[-1])
                raw = (batch.column(1)[k].as_py() or "").encode("utf-8", "surrogatepass")
                payload = raw + bytes(-len(raw) % ROW if raw else ROW)
                archive.add(batch.column(0)[k].as_py(), len(raw), to_png(payload))
                if archive.at > ARCHIVE_BYTES:
                    sizes.append(archive.close())
                    archive = None
        if archive is not None:
            sizes.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["archive", "size"])

    filesystem, path = _filesystem(folder)
    filesystem.create_dir(path, recursive=True)
    listing = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "archive string, size long")
    listing.write.mode("overwrite").parquet(folder + "/_archives")
    return docs.sparkSession.read.parquet(folder + "/_archives").count()


class _Range(InputPartition):
    """The members of `archive` that start in bytes `low` to `high`."""

    def __init__(self, archive: str, low: int, high: int):
        self.archive, self.low, self.high = archive, low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.size = options["path"], int(options.get("range_bytes", 16 << 20))
        self.retries, self.wanted = int(options.get("retries", 3)), options.get("archives")

    def partitions(self) -> list[InputPartition]:
        """Byte ranges, from the archives' sizes; the driver reads no index and no member."""
        import pyarrow.dataset as ds

        filesystem, path = _filesystem(self.folder)
        listing = ds.dataset(path + "/_archives", filesystem=filesystem, exclude_invalid_files=False, ignore_prefixes=["_SUCCESS", "."], format="parquet").to_table()
        sizes = sorted(zip(listing.column("archive").to_pylist(), listing.column("size").to_pylist(), strict=True))
        return [_Range(name, low, low + self.size) for name, size in sizes for low in range(0, size, self.size)]

    def _index(self, name: str, low: int, high: int) -> np.ndarray:
        """The index rows of a range, read again as often as `retries` says."""
        for attempt in range(self.retries + 1):
            try:
                fs, p = _filesystem(name)
                with fs.open_input_file(p) as f:
                    start, n, magic = struct.unpack("<QQ8s", f.read_at(24, f.size() - 24))
                    if magic != _MAGIC:
                        raise OSError(f"{name}: no index")
                    index = np.frombuffer(zlib.decompress(f.read_at(n, start)), np.int64).reshape(-1, 6)
                return index[(index[:, 0] >= low) & (index[:, 0] < high)]
            except (OSError, ValueError, struct.error, zlib.error) as e:
                error: Exception = e
            time.sleep(0.05 * 2**attempt)
        raise error

    def _member(self, name: str, start: int, size: int, crc: int) -> bytes:
        """One member by its own offset, as often as `retries` says."""
        for attempt in range(self.retries + 1):
            try:
                fs, p = _filesystem(name)
                with fs.open_input_file(p) as f:
                    media = f.read_at(size, start)
                if len(media) == size and zlib.crc32(media) == crc:
                    return media
                error: Exception = OSError(f"{name} at {start}: damaged member")
            except OSError as e:
                error = e
            time.sleep(0.05 * 2**attempt)
        raise error

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # without ranges Spark still reads once
            return
        fs, p = _filesystem(partition.archive)
        rows: list[tuple] = []
        held = 0
        index = self._index(partition.archive, partition.low, partition.high)
        with fs.open_input_file(p) as f:
            for start, size, crc, n_bytes, null, doc_id in index.tolist():
                try:
                    media = f.read_at(size, start)
                except OSError:
                    media = b""
                if len(media) != size or zlib.crc32(media) != crc:
                    media = self._member(partition.archive, start, size, crc)
                rows.append((None if null else doc_id, n_bytes, from_png(media), media))
                held += n_bytes + size
                if len(rows) >= 512 or held > 8 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "payload", "media"])


class MediaArchiveSource(DataSource):
    """Options: path, range_bytes (16 MB), retries (3)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").options(**options).load(folder)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Stores `docs`, reads the archives back and adds the features: doc_id, n_bytes,
    payload, media, feature."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{id_col}: the archive's index holds integer ids")
    folder = folder or scratch_path(spark, "media")
    store(docs, folder, id_col, text_col)
    return with_feature(read(spark, folder))


def with_feature(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([feature(x.as_py()) for x in b.column(2)], pa.string())], names=[*b.schema.names, "feature"])

    return df.mapInArrow(run, SCHEMA + ", feature string")


def digests(media: DataFrame) -> DataFrame:
    """The checkable columns of `media_columns`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payload, stored = [x.as_buffer().to_pybytes() for x in b.column(2)], [x.as_buffer().to_pybytes() for x in b.column(3)]
            cols = [pa.array([len(x) for x in payload], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in payload]), pa.array([zlib.crc32(x[-ROW:]) for x in payload], pa.int64()), pa.array([len(x) for x in stored], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in stored]), b.column(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
