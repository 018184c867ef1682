"""Run-length encoding of the BWT, and access to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.order import running
from ..schemas import RLBWT
from ..sources.scratch import stored
from .intervals import containing


def encode(pieces: DataFrame) -> DataFrame:
    """``run_id, ch, start, len, row1``: maximal runs of ``pieces(start, ch,
    len, row1)``, which tile the text. A piece's predecessor ends where it
    starts, an equi-join; the runs' order is a distributed rank."""
    pieces = stored(pieces.where("len > 0"), "pieces")
    n = pieces.agg(F.sum("len")).first()[0] or 0
    ends = pieces.select((F.col("start") + F.col("len")).alias("start"), F.col("ch").alias("before"))
    heads = pieces.join(ends, "start", "left").where("before is null or before <> ch").select("start", "ch", "row1")
    heads = stored(running(heads, ["start"], "run_id"), "heads")
    following = heads.select((F.col("run_id") - 1).alias("run_id"), F.col("start").alias("next"))
    out = heads.join(following, "run_id", "left")
    return out.select("run_id", "ch", "start", (F.coalesce("next", F.lit(n)) - F.col("start")).cast("bigint").alias("len"), "row1").select(*RLBWT.names)


def merged(pieces: DataFrame) -> DataFrame:
    """``start, ch, len, row1``: ``pieces(start, ch, len, row1)`` of any part of
    the text, where those that touch and are of one symbol are one. Associative:
    parts may be merged in any grouping, so chunks that were built apart are too."""
    pieces = stored(pieces.where("len > 0"), "pieces")
    ends = pieces.select((F.col("start") + F.col("len")).alias("start"), F.col("ch").alias("before"))
    follows = pieces.join(ends, "start", "left")
    island = running(follows.select("start", "ch", "len", "row1", F.when(F.col("before") == F.col("ch"), 0).otherwise(1).alias("head")), ["start"], "heads", F.col("head"))
    whole = island.groupBy((F.col("heads") + F.col("head")).alias("run")).agg(F.min("start").alias("start"), F.first("ch").alias("ch"), F.sum("len").cast("bigint").alias("len"), F.min("row1").alias("row1"))
    return whole.select("start", "ch", "len", "row1")


def decode(runs: DataFrame) -> DataFrame:
    """``pos, ch``: the symbols that runs stand for."""
    return runs.select("ch", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos")).select("pos", "ch")


def access(runs: DataFrame, positions: DataFrame, span: int | None = None) -> DataFrame:
    """``pos, ch, run_id`` of ``positions(pos)``."""
    ranges = runs.select("run_id", "ch", F.col("start").alias("first"), (F.col("start") + F.col("len") - 1).alias("last"))
    return containing(positions, ranges, span).select("pos", "ch", "run_id")


def stats(runs: DataFrame) -> DataFrame:
    """``n, r, longest``."""
    return runs.agg(F.sum("len").cast("bigint").alias("n"), F.count("*").alias("r"), F.max("len").alias("longest"))
