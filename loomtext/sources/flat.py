"""Flat binary files as Spark data sources: fixed-length records, and words that a
symbol ends, as dictionaries are exchanged.

Reading is planned in ranges of bytes, so one file is as many tasks as it is
long; a range has the records, or the words, that begin in it. Writing makes a
folder of parts whose concatenation, in the order of their names, is the flat
file: rows are numbered, so each part's place is known beforehand, parts are
written by all tasks under names of their own, and the commit gives the names in order.
Paths are opened through Arrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .ship import ship

#: Bytes of a range, and records of a part.
RANGE, PART = 64 << 20, 1 << 20
#: Bytes that a task reads, or has of rows to write, at a time.
STEP = 1 << 20
#: What ends a word, and a dictionary, in files of dictionaries.
END_OF_WORD, END_OF_DICT = 1, 0
_KIND = {"q": "bigint", "i": "int", "I": "bigint"}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path there."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def _files(path: str) -> list[tuple[str, int]]:
    """The parts of a flat file in order, or the file itself, with sizes."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(at, info.size)]
    found = fs.get_file_info(pafs.FileSelector(at))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name.startswith("part-"))


class _Bytes:
    """Bytes of the concatenated parts, by their place in all."""

    def __init__(self, path: str, files: list[tuple[str, int]]):
        self.fs, _ = opened(path)
        self.files = files
        self.size = sum(size for _, size in files)

    def read(self, start: int, stop: int) -> bytes:
        out, base = [], 0
        for name, size in self.files:
            a, b = max(start, base), min(stop, base + size)
            if a < b:
                with self.fs.open_input_file(name) as f:
                    out.append(f.read_at(b - a, a - base))
            base += size
        return b"".join(out)


@dataclass
class _Range(InputPartition):
    start: int
    stop: int


def _dtype(fields: str) -> np.dtype:
    """``name:kind`` pairs, comma-separated; kinds q, i, I as in ``struct``."""
    return np.dtype([(n, {"q": "<i8", "i": "<i4", "I": "<u4"}[k]) for n, k in (f.split(":") for f in fields.split(","))])


class RecordsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dtype, self.header = options["path"], _dtype(options["fields"]), int(options.get("header", "0"))
        self.range = max(1, int(options.get("rangebytes", RANGE)) // self.dtype.itemsize) * self.dtype.itemsize
        self.files = _files(self.path)

    def partitions(self) -> list[_Range]:
        size = sum(s for _, s in self.files) - self.header
        if size < 0 or size % self.dtype.itemsize:
            raise ValueError(f"{self.path} doesn't hold whole records")
        return [_Range(a, min(size, a + self.range)) for a in range(0, size, self.range)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        source, step = _Bytes(self.path, self.files), STEP // self.dtype.itemsize * self.dtype.itemsize
        for a in range(partition.start, partition.stop, step):
            rows = np.frombuffer(source.read(self.header + a, self.header + min(partition.stop, a + step)), self.dtype)
            i = a // self.dtype.itemsize + np.arange(len(rows), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(i), *(pa.array(rows[n].astype(np.int64 if self.dtype[n].itemsize == 8 or self.dtype[n].kind == "u" else np.int32)) for n in self.dtype.names)], names=["i", *self.dtype.names])


class Records(DataSource):
    """``i`` and the ``fields`` of fixed-length little-endian records behind
    ``header`` bytes."""

    @classmethod
    def name(cls) -> str:
        return "loomtext_records"

    def schema(self) -> str:
        return "i bigint, " + ", ".join(f"{n} {_KIND[k]}" for n, k in (f.split(":") for f in self.options["fields"].split(",")))

    def reader(self, schema) -> RecordsReader:
        return RecordsReader(dict(self.options))


class WordsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options.get("width", "1"))
        self.type = np.dtype({1: "u1", 4: "<u4"}[self.width])
        self.range = max(1, int(options.get("rangebytes", RANGE)) // self.width) * self.width
        self.files = _files(self.path)

    def partitions(self) -> list[_Range]:
        size = sum(s for _, s in self.files)
        if size % self.width:
            raise ValueError(f"{self.path} doesn't hold whole symbols")
        return [_Range(a, min(size, a + self.range)) for a in range(0, size, self.range)] or [_Range(0, 0)]

    def _symbols(self, source: _Bytes, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(source.read(start, stop), self.type)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        """A word belongs to the range where its first symbol is, so what the
        range before has begun is skipped, and the last word is read to its end.
        A step of the range, and a word that goes on behind it, is held at a time."""
        source, w = _Bytes(self.path, self.files), self.width
        step = STEP // w * w
        # the symbol before tells whether a word begins with the first
        pos, at = max(0, partition.start - w), None if partition.start else 0
        begun: list[np.ndarray] = []  # of the word that begins at ``at``
        while pos < partition.stop or begun and pos < source.size:
            behind = pos >= partition.stop
            end = min(pos + step, source.size if behind else partition.stop)
            symbols = self._symbols(source, pos, end)
            if behind:  # only the end of the word that goes on
                last = np.flatnonzero((symbols == END_OF_WORD) | (symbols == END_OF_DICT))
                symbols, end = (symbols[: last[0] + 1], source.size) if len(last) else (symbols, end)
            ends = np.flatnonzero(symbols == END_OF_WORD)
            if at is None and len(ends):
                at = pos + (int(ends[0]) + 1) * w
                symbols, ends = symbols[ends[0] + 1 :], ends[1:] - ends[0] - 1
            pos = end
            if at is None:
                continue
            if len(ends):
                whole, begun = np.concatenate([*begun, symbols[: ends[-1] + 1]]), []
                symbols = symbols[ends[-1] + 1 :].copy()
                yield from self._words(whole, at)
                at += len(whole) * w
            if len(symbols):
                begun.append(symbols)
            if pos >= partition.stop and len(symbols) and symbols[-1] == END_OF_DICT:
                return

    def _words(self, symbols: np.ndarray, at: int) -> Iterator[pa.RecordBatch]:
        """The words of whole words' ``symbols``, which begin at ``at``."""
        ends = np.flatnonzero(symbols == END_OF_WORD)
        starts = np.r_[0, ends[:-1] + 1]
        if self.width == 1:
            words = pa.array(symbols.tobytes().decode("latin-1").split(chr(END_OF_WORD))[:-1], pa.string())
        else:
            offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(symbols[symbols != END_OF_WORD].astype(np.int64)))
        batch = pa.RecordBatch.from_arrays([pa.array(at + starts * self.width, pa.int64()), words], names=["at", "word"])
        for a in range(0, len(ends), 4096):
            yield batch.slice(a, 4096)


class Words(DataSource):
    """``at, word``: where each word of a dictionary begins, in bytes, and the
    word: a string of symbols 0 to 255 (``width`` 1), or an array of numbers (4)."""

    @classmethod
    def name(cls) -> str:
        return "loomtext_words"

    def schema(self) -> str:
        return "at bigint, word " + ("string" if self.options.get("width", "1") == "1" else "array<bigint>")

    def reader(self, schema) -> WordsReader:
        return WordsReader(dict(self.options))


@dataclass
class _Written(WriterCommitMessage):
    files: list


class PartsWriter(DataSourceWriter):
    """Appends ``payload`` to the part ``block``; rows come sorted."""

    def __init__(self, path: str):
        self.path, self.staging = path, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> _Written:
        fs, at = opened(self.path)
        folder, attempt = f"{at}/{self.staging}", uuid.uuid4().hex
        fs.create_dir(folder, recursive=True)
        files, out, block = [], None, None
        for row in iterator:
            if row.block != block:
                if out is not None:
                    out.close()
                block = row.block
                name = f"{folder}/{block:012d}-{attempt}"
                out = fs.open_output_stream(name)
                files.append((block, name))
            out.write(row.payload)
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages) -> None:
        fs, at = opened(self.path)
        for block, name in sorted(f for m in messages if m for f in m.files):
            fs.move(name, f"{at}/part-{block:012d}")
        fs.delete_dir(f"{at}/{self.staging}")

    def abort(self, messages) -> None:
        fs, at = opened(self.path)
        if fs.get_file_info(f"{at}/{self.staging}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{at}/{self.staging}")


class Parts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomtext_parts"

    def schema(self) -> str:
        return "block bigint, payload binary"

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the sources known to a session; repeated calls do no harm."""
    ship(spark)
    for source in (Records, Words, Parts):
        spark.dataSource.register(source)


def _write(df: DataFrame, pack, path: str, before: bytes, after: bytes, part: int) -> None:
    """Parts of ``df(i, ...)``, its ``i`` counting from 0, each of ``part`` rows
    as ``pack`` makes bytes of a batch; ``before`` and ``after`` all."""
    spark = df.sparkSession
    register(spark)
    fs, at = opened(path)
    if fs.get_file_info(at).type != pafs.FileType.NotFound:
        raise FileExistsError(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.asarray(batch.column("block"))
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([block[a]], pa.int64()), pa.array([pack(batch.slice(a, b - a))], pa.binary())], names=["block", "payload"])

    # block 0 is what stands before all
    blocks = df.withColumn("block", F.floor(F.col("i") / part) + 1)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = blocks.repartition(n, "block").sortWithinPartitions("block", "i").mapInArrow(work, "block bigint, payload binary")
    ends = [(b, p) for b, p in ((0, before), ((1 << 39) - 1, after)) if p]
    if ends:
        body = body.unionByName(spark.createDataFrame(ends, "block bigint, payload binary"))
    # both of a task's workers hold a batch: by bytes, not by Spark's 64 MB
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    spark.conf.set(key, str(STEP))
    try:
        body.write.format("loomtext_parts").option("path", path).mode("append").save()
    finally:
        spark.conf.unset(key) if held is None else spark.conf.set(key, held)


def write_records(df: DataFrame, fields: str, path: str, before: bytes = b"", part: int = PART) -> None:
    """The rows of ``df(i, ...)`` as records of ``fields``, in the order of ``i``."""
    dtype = _dtype(fields)

    def pack(batch: pa.RecordBatch) -> bytes:
        out = np.empty(batch.num_rows, dtype)
        for n in dtype.names:
            out[n] = np.asarray(batch.column(n))
        return out.tobytes()

    _write(df.select("i", *dtype.names), pack, path, before, b"", part)


def write_words(df: DataFrame, path: str, width: int = 1, part: int = PART) -> None:
    """The words of ``df(i, word)``, each with its end, in the order of ``i``,
    and the dictionary's end."""

    def pack(batch: pa.RecordBatch) -> bytes:
        if width == 1:
            return b"".join(w.encode("latin-1") + bytes([END_OF_WORD]) for w in batch.column("word").to_pylist())
        return b"".join(np.array([*w, END_OF_WORD], "<u4").tobytes() for w in batch.column("word").to_pylist())

    _write(df.select("i", "word"), pack, path, b"", END_OF_DICT.to_bytes(width, "little"), part)


def read_records(spark: SparkSession, path: str, fields: str, header: int = 0, range_bytes: int = RANGE) -> DataFrame:
    register(spark)
    return spark.read.format("loomtext_records").options(path=path, fields=fields, header=str(header), rangebytes=str(range_bytes)).load()


def read_words(spark: SparkSession, path: str, width: int = 1, range_bytes: int = RANGE) -> DataFrame:
    register(spark)
    return spark.read.format("loomtext_words").options(path=path, width=str(width), rangebytes=str(range_bytes)).load()
