"""The Burrows-Wheeler transform in three tiers, each expanded only as far as
it needs: whole suffix groups, second-level rows, occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.order import running, within
from ..sources.scratch import stored


def easy_runs(groups: DataFrame) -> DataFrame:
    """Groups with one preceding symbol: a run each, not expanded at all."""
    return groups.where("kind = 'easy'").select(F.col("l_left").alias("start"), "ch", F.col("cnt").alias("len"), "row1", F.lit("easy").alias("tier"))


def hard_rows(groups: DataFrame, suffix1: DataFrame, v_table: DataFrame) -> DataFrame:
    """``row1, row2, start, cnt, n_pids, ch``: the hard groups' second-level
    rows, in order within their group; a group's rows are placed by a running
    sum over all rows, less that of the groups before."""
    hard = groups.where("kind = 'hard'")
    pids = hard.select("row1", "grp").join(suffix1.select("grp", "pid", "prev"), "grp")
    rows = pids.join(v_table, "pid").groupBy("row1", "row2").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("n_pids"), F.min("prev").alias("ch"))
    first = running(hard.select("row1", "l_left", "cnt"), ["row1"], "first", F.col("cnt")).select("row1", "l_left", "first")
    placed = running(rows, ["row1", "row2"], "before", F.col("cnt")).join(first, "row1")
    return stored(placed.select("row1", "row2", (F.col("l_left") + F.col("before") - F.col("first")).alias("start"), "cnt", "n_pids", "ch"), "hard_rows")


def hard_easy_runs(rows: DataFrame) -> DataFrame:
    """Rows that one phrase makes up: a run each."""
    return rows.where("n_pids = 1").select("start", "ch", F.col("cnt").alias("len"), "row1", F.lit("hard_easy").alias("tier"))


def hard_hard_chars(rows: DataFrame, groups: DataFrame, suffix1: DataFrame, m_table: DataFrame, ilist: DataFrame) -> DataFrame:
    """Rows of several phrases: a symbol for each occurrence, in the order of
    the second parse's BWT."""
    rows = rows.where("n_pids > 1").select("row1", "row2", "start", "cnt")
    chars = groups.where("kind = 'hard'").select("row1", "grp").join(suffix1.select("grp", F.col("pid").alias("prev_pid"), "prev"), "grp").select("row1", "prev_pid", "prev")
    # by the phrase first: by row2 alone, each row would meet all phrases before its suffix
    found = chars.join(m_table.select("row2", "pid2", "prev_pid"), "prev_pid").join(rows, ["row1", "row2"]).join(ilist.select("pid2", "pos2"), "pid2")
    found = within(found.select("row1", "row2", "start", "prev", "pos2"), ["row1", "row2"], ["pos2"], "rank", rows.select("row1", "row2", F.col("cnt").alias("size")))
    return found.select((F.col("start") + F.col("rank")).alias("start"), F.col("prev").alias("ch"), F.lit(1).cast("bigint").alias("len"), "row1", F.lit("hard_hard").alias("tier"))


def from_suffix_array(tiles: DataFrame, sa: DataFrame, n: int, tile: int) -> DataFrame:
    """``pos, ch``: the symbol before each suffix of ``sa(pos, sa)``, from the
    text's ``tiles(tile, text)`` of ``tile`` symbols."""
    text = tiles.select("tile", F.posexplode(F.split("text", "")).alias("j", "ch"))
    # a row for each symbol: Spark judges it by the tiles' compressed size, and would broadcast it
    text = text.select((F.col("tile") * tile + F.col("j")).alias("at"), "ch").hint("merge")
    return sa.select("pos", F.pmod(F.col("sa") - 1, F.lit(n)).alias("at")).join(text, "at").select("pos", "ch")
