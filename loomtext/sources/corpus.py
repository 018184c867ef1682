"""Text collections: the circular text that the index is built of.

The text is every sequence in key order, each with its separator, and ``w``
terminators at the end. It is kept in tiles of equal length, so that neither a
long sequence nor many short ones make a large row; each tile knows the ``w``
symbols before it, so that every window of the text lies in exactly one tile.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.symbols import SEPARATOR, SEPARATOR_END, TERMINATOR, separator
from ..plans.order import running
from .flat import RANGE, read_records, write_records
from .scratch import measured_broadcasts, stored
from .ship import ship

#: Symbols of a tile, and of the pieces that Python gives back at once.
TILE, HELD = 1 << 16, 1 << 22


@dataclass
class Text:
    """``sequences(k, own, off)``: number, symbols with the separator, and where
    they begin, of each sequence, the last being the terminators; ``tiles(tile,
    before, text)``: the symbols; ``n``: how many."""

    sequences: DataFrame
    tiles: DataFrame
    n: int
    tile: int


def clean(text: Column) -> Column:
    """Null is empty; reserved symbols are taken out."""
    return F.translate(F.coalesce(text, F.lit("")), TERMINATOR + SEPARATOR + SEPARATOR_END, "")


def tiled(pieces: DataFrame, w: int, tile: int) -> DataFrame:
    """``tile, before, text`` of ``pieces(off, text)``, which have every symbol
    once: pieces are cut at multiples of ``tile`` and put together there."""
    if tile < w:
        raise ValueError("a tile must hold a window")
    ship(pieces.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []

        def done() -> pa.RecordBatch:
            at = np.array([x for x, _ in held], np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(at // tile), pa.array(at), pa.array([t for _, t in held], pa.string())], names=["tile", "at", "text"])
            held.clear()
            return out

        for batch in batches:
            size = 0
            for off, text in zip(batch.column("off").to_pylist(), batch.column("text").to_pylist()):
                cuts = [0, *range(tile - off % tile, len(text), tile), len(text)] if text else []
                for x, y in zip(cuts, cuts[1:]):
                    held.append((off + x, text[x:y]))
                    size += y - x
                    if size > HELD:
                        yield done()
                        size = 0
            if held:
                yield done()

    cut = pieces.select("off", "text").mapInArrow(work, "tile bigint, at bigint, text string")
    whole = cut.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("p")).select("tile", F.array_join("p.text", "").alias("text"))
    whole = stored(whole, "tiles")
    tails = whole.where(F.length("text") == tile).select((F.col("tile") + 1).alias("tile"), F.expr(f"right(text, {w})").alias("before"))
    return stored(whole.join(tails, "tile", "left").select("tile", F.coalesce("before", F.lit(TERMINATOR * w)).alias("before"), "text"), "tiles")


def _text(sequences: DataFrame, pieces: DataFrame, count: int, length: int, w: int, tile: int) -> Text:
    """With the terminators behind ``count`` sequences of ``length`` symbols."""
    spark = pieces.sparkSession
    last = spark.createDataFrame([(count, w, length)], "k bigint, own bigint, off bigint")
    end = spark.createDataFrame([(length, TERMINATOR * w)], "off bigint, text string")
    return Text(stored(sequences.select("k", "own", "off").unionByName(last), "sequences"), tiled(pieces.select("off", "text").unionByName(end), w, tile), length + w, tile)


def of_table(docs: DataFrame, key: str, text: str, w: int, tile: int = TILE) -> Text:
    """A row for each sequence, in the order of ``key``, then of the text."""
    measured_broadcasts(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.concat(clean(F.col(text)), F.lit(separator(w))).alias("text")).withColumn("own", F.length("text").cast("bigint"))
    rows = stored(running(rows, ["key", "text"], "off", F.col("own"), rank="k"), "rows")
    count, length = rows.agg(F.count("*"), F.coalesce(F.sum("own"), F.lit(0))).first()
    return _text(rows, rows, count, length, w, tile)


def of_strings(spark: SparkSession, texts: list[str], w: int, tile: int = TILE) -> Text:
    """A small collection given as strings."""
    return of_table(spark.createDataFrame(list(enumerate(texts)), "key bigint, text string"), "key", "text", w, tile)


_ORDER = ["file", "block", "at"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of files, with columns that order them: files by path, blocks
    by where they start, lines of a block as they were read."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return stored(lines.withColumn("at", F.monotonically_increasing_id()), "lines")


def of_fasta(spark: SparkSession, path: str, w: int, tile: int = TILE) -> Text:
    """A sequence for each record of FASTA files, read by lines, so that a
    record of any length is many rows. A record begins with ``>`` at the start
    of a line; what stands before a file's first record goes to the record before,
    or is left out if there is none; blanks aren't symbols."""
    measured_broadcasts(spark)
    lines = running(_lines(spark, path).withColumn("head", F.col("value").startswith(">").cast("bigint")), _ORDER, "records", F.col("head"))
    ended = F.when(F.col("records") > 0, F.lit(separator(w))).otherwise("")
    symbols = F.when(F.col("records") > 0, clean(F.regexp_replace("value", r"\s+", ""))).otherwise("")
    pieces = lines.select(*_ORDER, "head", "records", F.when(F.col("head") == 1, ended).otherwise(symbols).alias("text"))
    pieces = stored(running(pieces, _ORDER, "off", F.length("text")), "pieces")
    count, length = pieces.agg(F.coalesce(F.sum("head"), F.lit(0)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if count:
        closing = spark.createDataFrame([(length, separator(w))], "off bigint, text string")
        length += w
    starts = pieces.where("head = 1").select(F.col("records").alias("k"), (F.col("off") + F.length("text")).cast("bigint").alias("off"))
    following = starts.select((F.col("k") - 1).alias("k"), F.col("off").alias("next"))
    sequences = starts.join(following, "k", "left").select("k", (F.coalesce("next", F.lit(length)) - F.col("off")).cast("bigint").alias("own"), "off")
    pieces = pieces.select("off", "text")
    return _text(sequences, pieces.unionByName(closing) if count else pieces, count, length, w, tile)


def from_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, name, text`` of FASTA records, a row each, in the order of
    their files' paths and of their places there. A record begins with a ``>`` at
    the start of a line; files are split there, so a long file is read in parallel.
    Blank lines and records without a name or text are read as they are; what stands
    before a file's first record is left out. For records of any length: ``of_fasta``."""
    # the first record of a file still has its mark, all others lost it with the line end
    lines = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_path").alias("file"))
    lines = stored(lines.withColumn("at", F.monotonically_increasing_id()), "records")
    head = lines.where("block = 0").groupBy("file").agg(F.min("at").alias("at"), F.lit(True).alias("head"))
    marked = lines.join(head, ["file", "at"], "left")
    record = F.when(F.col("head"), F.regexp_extract("value", r"^\s*>([\s\S]*)", 1)).otherwise(F.col("value"))
    records = marked.where("head is null or value rlike '^\\\\s*>'").select(*_ORDER, record.alias("value"))
    named = records.select(*_ORDER, F.regexp_extract("value", r"^[^\s]*", 0).alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "").alias("text"))
    return running(named, _ORDER, "doc_id").select("doc_id", "name", "text")


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table that ``save_tables`` wrote; Spark names a path that is missing."""
    return spark.read.parquet(f"{path}/{name}")


def write_ssa(ssa: DataFrame, path: str) -> int:
    """The flat layout of samples: an 8-byte count, then 8-byte values in run
    order, in parts that all executors write; put one after another, these are
    the file. Gives its size."""
    count = ssa.count()
    write_records(ssa.select(F.col("run_id").alias("i"), "sa"), "sa:q", path, struct.pack("<Q", count))
    return 8 * (1 + count)


def read_ssa(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """``run_id, sa`` of the flat layout, in one file or in parts."""
    return read_records(spark, path, "sa:q", 8, range_bytes).withColumnRenamed("i", "run_id")


def write_runs(rlbwt: DataFrame, path: str) -> int:
    """Runs in a flat layout: for each, in order, its symbol's code point in 4
    bytes and its length in 8. Gives the size."""
    write_records(rlbwt.select(F.col("run_id").alias("i"), F.ascii("ch").alias("code"), "len"), "code:I,len:q", path)
    return 12 * rlbwt.count()


def read_runs(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """``run_id, ch, start, len`` of the flat layout."""
    runs = read_records(spark, path, "code:I,len:q", 0, range_bytes)
    placed = running(runs, ["i"], "start", F.col("len"))
    # a code point as UTF-32, which every decoder of Spark reads
    ch = F.decode(F.unhex(F.lpad(F.hex("code"), 8, "0")), "UTF-32")
    return placed.select(F.col("i").alias("run_id"), ch.alias("ch"), "start", "len")
