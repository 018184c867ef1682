"""Prefix-free parsing at both levels: triggers, phrases, dictionary, parse.

A level's sequence lies in tiles of equal length, so one long record is many
rows. Each tile, with the ``w`` symbols before it, is cut at the ends of its
trigger windows; the pieces that cross the border of a tile are put
together by their phrase's number, which is a running count of triggers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import SEPARATOR_END, TERMINATOR, trigger_windows
from ..sources.scratch import stored
from ..sources.ship import ship
from .order import running

#: Tokens of a tile of the second level.
TILE2 = 1 << 14


def _fragments(symbols: np.ndarray, forced: np.ndarray, end: int, w: int, p: int, first: bool) -> list[int]:
    """Where trigger windows end in a tile, whose first ``w`` symbols are those
    before it. ``forced`` marks symbols that end a trigger wherever they are;
    ``w`` of the symbol ``end`` are one too. A window that ends with the symbols
    before is the tile before's, but for the very first."""
    if len(symbols) < w:
        return []
    found = trigger_windows(symbols, w, p) | forced[w - 1 :] | ((symbols[: len(symbols) - w + 1] == end) & (symbols[w - 1 :] == end))
    found[0] = first
    return np.flatnonzero(found).tolist()


_CUT = "tile bigint, j int, x int, m int, seps int, sep_so_far int, piece "


def _rows(tile: int, ends: list[int], seps: list[bool], w: int, whole, size: int) -> Iterator[tuple]:
    """Rows of a tile: what stands before its first trigger ends (j = -1), then
    a piece from the start of each trigger to the end of the next."""
    total = sum(seps)
    yield tile, -1, 0, len(ends), total, 0, whole[w : w + ends[0]] if ends else whole[w:]
    so_far = 0
    for j, x in enumerate(ends):
        so_far += seps[j]
        yield tile, j, x, len(ends), total, so_far, whole[x : w + (ends[j + 1] if j + 1 < len(ends) else size)]


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    c = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *(pa.array(x, pa.int32()) for x in c[1:6]), pa.array(c[6], kind)], names=["tile", "j", "x", "m", "seps", "sep_so_far", "piece"])


def cut_text(tiles: DataFrame, w: int, p: int) -> DataFrame:
    """The pieces of ``tiles(tile, before, text)``."""
    ship(tiles.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, before, text in zip(*(batch.column(c).to_pylist() for c in ("tile", "before", "text"))):
                whole = before + text
                c = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.int64)
                ends = _fragments(c, c == ord(SEPARATOR_END), ord(TERMINATOR), w, p, tile == 0)
                yield _batch(list(_rows(tile, ends, [x > 0 and whole[w + x - 1] == SEPARATOR_END for x in ends], w, whole, len(text))), pa.string())

    return tiles.select("tile", "before", "text").mapInArrow(work, _CUT + "string")


def cut_tokens(tiles: DataFrame, w: int, p: int) -> DataFrame:
    """The pieces of ``tiles(tile, before, toks, fin)``; ``fin`` marks phrases
    that end a sequence. Zeros are the terminators."""
    ship(tiles.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, before, toks, fin in zip(*(batch.column(c).to_pylist() for c in ("tile", "before", "toks", "fin"))):
                whole = before + toks
                ends = _fragments(np.array(whole, np.int64), np.array([False] * len(before) + fin, bool), 0, w, p, tile == 0)
                yield _batch(list(_rows(tile, ends, [False] * len(ends), w, whole, len(toks))), pa.list_(pa.int64()))

    return tiles.select("tile", "before", "toks", "fin").mapInArrow(work, _CUT + "array<bigint>")


class Cuts:
    """Phrases of a level from its pieces.

    ``phrases``: ``tile, j, x, sep_so_far, phrase``, where j counts the tile's
    triggers and x is where the phrase's first trigger ends in the tile;
    ``offsets``: ``tile, before, seps_before``, triggers and ends of sequences in
    the tiles before; ``count``: phrases in all."""

    def __init__(self, pieces: DataFrame, joined: Column):
        self.pieces = stored(pieces, "pieces")
        heads = self.pieces.where("j = -1").select("tile", "m", "seps")
        offsets = running(heads, ["tile"], "before", F.col("m"))
        self.offsets = stored(running(offsets, ["tile"], "seps_before", F.col("seps")).select("tile", "m", "before", "seps_before"), "offsets")
        # the last trigger ends the sequence and begins no phrase
        self.count = (self.offsets.agg(F.sum("m")).first()[0] or 1) - 1
        inner = self.pieces.where("j >= 0 and j < m - 1").select("tile", "j", "x", "sep_so_far", F.col("piece").alias("phrase"))
        edges = self.pieces.where("j = -1 or j = m - 1").join(self.offsets.select("tile", "before"), "tile").withColumn("i", F.col("before") + F.col("j"))
        edge = edges.where((F.col("i") >= 0) & (F.col("i") < self.count)).groupBy("i").agg(
            F.sort_array(F.collect_list(F.struct("tile", "j", "piece"))).alias("p"), F.min(F.when(F.col("j") >= 0, F.struct("tile", "j", "x", "sep_so_far"))).alias("a")
        )
        self.phrases = inner.unionByName(edge.select("a.tile", "a.j", "a.x", "a.sep_so_far", joined.alias("phrase")))


def phrases1(tiles: DataFrame, w: int, p: int) -> Cuts:
    return Cuts(cut_text(tiles, w, p), F.array_join("p.piece", ""))


def dictionary1(phrases: DataFrame) -> DataFrame:
    """``pid, phrase, len, freq``: distinct phrases, ids from 1 in order."""
    d = running(phrases.groupBy("phrase").agg(F.count("*").alias("freq")), ["phrase"], "pid")
    return stored(d.select((F.col("pid") + 1).alias("pid"), "phrase", F.length("phrase").cast("bigint").alias("len"), "freq"), "dict1")


def occurrences(cuts: Cuts, phrases: DataFrame, sequences: DataFrame, w: int, tile: int, *more: str) -> DataFrame:
    """``i, k, j, start`` and ``more`` of each row of ``phrases``: its number
    in the text, its sequence, its number there, and where it begins; the first
    begins ``w`` before the text, with the terminators."""
    i, k = (F.col("before") + F.col("j")).cast("bigint"), (F.col("seps_before") + F.col("sep_so_far")).cast("bigint")
    placed = phrases.join(cuts.offsets, "tile").select(i.alias("i"), k.alias("k"), (F.col("tile") * tile + F.col("x") - w).cast("bigint").alias("start"), *more)
    # a sequence's first phrase begins with the mark before it
    first = placed.join(sequences.select("k", "off"), "k").where(F.col("start") + w == F.col("off")).select("k", F.col("i").alias("first"))
    return placed.join(stored(first, "first"), "k").select("i", "k", (F.col("i") - F.col("first")).alias("j"), "start", *more)


def trigger_positions(starts: DataFrame, sequences: DataFrame, w: int) -> DataFrame:
    """``k, t``: the triggers of each sequence with the ``w`` symbols before it
    (from 0): one begins each phrase of ``starts(k, start)``, one more ends the
    sequence."""
    begin = starts.join(sequences.select("k", "off"), "k").select("k", (F.col("start") - F.col("off") + w).alias("t"))
    return begin.unionByName(sequences.select("k", F.col("own").alias("t")))


def parse1(cuts: Cuts, phrases: DataFrame, dict1: DataFrame) -> DataFrame:
    """``i, pid, tile, j, x, sep_so_far``: the phrase ids in text order."""
    numbered = phrases.join(dict1.select("phrase", "pid"), "phrase").drop("phrase")
    return stored(numbered.join(cuts.offsets.select("tile", "before"), "tile").select((F.col("before") + F.col("j")).cast("bigint").alias("i"), "pid", "tile", "j", "x", "sep_so_far"), "parse1")


def tiles2(parse1: DataFrame, dict1: DataFrame, n: int, w: int, size: int = TILE2) -> DataFrame:
    """``tile, before, toks, fin``: the ids in tiles, with ``w`` zeros behind the
    last, and the ``w`` tokens before each tile (zeros before the first)."""
    if size < w:
        raise ValueError("a tile must hold a window")
    spark = parse1.sparkSession
    ends = dict1.select("pid", F.col("phrase").endswith(SEPARATOR_END).alias("fin"))
    rows = parse1.select("i", "pid").join(ends, "pid").select("i", "pid", "fin").unionByName(spark.range(n, n + w).select(F.col("id").alias("i"), F.lit(0).cast("bigint").alias("pid"), F.lit(False).alias("fin")))
    tiles = rows.groupBy(F.floor(F.col("i") / size).alias("tile")).agg(F.sort_array(F.collect_list(F.struct("i", "pid", "fin"))).alias("t"))
    tiles = stored(tiles.select("tile", F.col("t.pid").alias("toks"), F.col("t.fin").alias("fin")), "tiles2")
    tails = tiles.where(F.size("toks") == size).select((F.col("tile") + 1).alias("tile"), F.slice("toks", -w, w).alias("before"))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), w)
    return tiles.join(tails, "tile", "left").select("tile", F.coalesce("before", zeros).alias("before"), "toks", "fin")


def phrases2(tiles: DataFrame, w: int, p: int) -> Cuts:
    return Cuts(cut_tokens(tiles, w, p), F.flatten("p.piece"))


def dictionary2(phrases: DataFrame) -> DataFrame:
    """``pid2, toks, len, freq``."""
    d = running(phrases.groupBy(F.col("phrase").alias("toks")).agg(F.count("*").alias("freq")), ["toks"], "pid2")
    return stored(d.select((F.col("pid2") + 1).alias("pid2"), "toks", F.size("toks").cast("bigint").alias("len"), "freq"), "dict2")


def numbered2(cuts: Cuts, dict2: DataFrame) -> DataFrame:
    """``i, pid2``: the second-level ids in text order."""
    found = cuts.phrases.withColumnRenamed("phrase", "toks").join(dict2.select("toks", "pid2"), "toks").select("tile", "j", "pid2")
    return found.join(cuts.offsets.select("tile", "before"), "tile").select((F.col("before") + F.col("j")).cast("bigint").alias("i"), "pid2")


def parse2(numbered: DataFrame, dict2: DataFrame, dict1: DataFrame, w1: int, w2: int) -> DataFrame:
    """``i, pid2, end_pos``: the second-level ids ``numbered(i, pid2)``, and where
    in the text the symbols end that each adds (its last ``w2`` ids are shared)."""
    shared = dict2.select("pid2", F.explode(F.slice("toks", F.lit(1), (F.col("len") - w2).cast("int"))).alias("pid")).where("pid > 0")
    adds = shared.join(dict1.select("pid", "len"), "pid").groupBy("pid2").agg(F.sum(F.col("len") - w1).alias("adds"))
    sized = numbered.join(adds, "pid2", "left").select("i", "pid2", F.coalesce("adds", F.lit(0)).cast("bigint").alias("adds"))
    return stored(running(sized, ["i"], "before", F.col("adds")).select("i", "pid2", (F.col("before") + F.col("adds")).alias("end_pos")), "parse2")
