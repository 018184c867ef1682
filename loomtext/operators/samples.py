"""Suffix-array values: of all positions, of the run heads, or of any asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import wrapped
from ..plans.order import running, within
from ..sources.scratch import stored
from .intervals import containing


def placed_rows(groups: DataFrame, suffix1: DataFrame, m_table: DataFrame, expansion: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The second-level rows of the given groups, ``row1, row2, start, cnt,
    entries, pid2, back``: where a row's symbols begin in the BWT, how many they
    are, of how many second-level phrases (one of which is ``pid2``), and how far
    before an occurrence's end the suffix begins; and the entries themselves,
    ``row1, row2, pid2``.

    A group's rows are placed by a running sum over all rows, less that of the
    groups before, so that no group is one task's work."""
    first = running(groups.select("row1", "grp", "l_left", "len_alpha", "cnt"), ["row1"], "first", F.col("cnt"))
    entries = (
        first.join(suffix1.select("grp", F.col("pid").alias("prev_pid")), "grp").drop("grp", "cnt")
        .join(m_table.select("prev_pid", "row2", "pid2", "freq"), "prev_pid")
    )
    rows = entries.groupBy("row1", "row2", "l_left", "len_alpha", "first").agg(
        F.sum("freq").alias("cnt"), F.count("*").alias("entries"), F.min("pid2").alias("pid2")
    )
    rows = running(rows, ["row1", "row2"], "before", F.col("cnt")).join(expansion, "row2")
    rows = rows.select(
        "row1", "row2", (F.col("l_left") + F.col("before") - F.col("first")).alias("start"), "cnt", "entries", "pid2", (F.col("expands") + F.col("len_alpha")).alias("back")
    )
    return stored(rows, "sa_rows"), entries.select("row1", "row2", "pid2")


def _several(rows: DataFrame, entries: DataFrame, ilist: DataFrame) -> DataFrame:
    """``row1, row2, start, back, rank, end_pos``: the occurrences of rows of
    several entries, by their place among all such rows' occurrences."""
    rows = rows.where("entries > 1").drop("pid2")
    found = rows.join(entries, ["row1", "row2"]).join(ilist, "pid2").select("row1", "row2", "start", "back", "pos2", "end_pos")
    return within(found, ["row1", "row2"], ["pos2"], "rank", rows.select("row1", "row2", F.col("cnt").alias("size")))


def suffix_array(groups: DataFrame, suffix1: DataFrame, m_table: DataFrame, ilist: DataFrame, expansion: DataFrame, n: int) -> DataFrame:
    """``pos, row1, sa`` of the given groups. A suffix begins where the text of
    its occurrence ends, less what follows the phrase and the suffix itself.
    Where one entry makes up a row, the place in its list is the rank."""
    rows, entries = placed_rows(groups, suffix1, m_table, expansion)
    single = rows.where("entries = 1").join(ilist, "pid2").select((F.col("start") + F.col("k")).alias("pos"), "row1", "end_pos", "back")
    several = _several(rows, entries, ilist).select((F.col("start") + F.col("rank")).alias("pos"), "row1", "end_pos", "back")
    return single.unionByName(several).select("pos", "row1", wrapped(F.col("end_pos") - F.col("back"), n).alias("sa"))


def groups_with_heads(groups: DataFrame, runs: DataFrame) -> DataFrame:
    """The groups that hold a run head; the others need no suffix-array pass."""
    return groups.join(runs.select("row1"), "row1", "left_semi")


def lookup(positions: DataFrame, groups: DataFrame, suffix1: DataFrame, m_table: DataFrame, ilist: DataFrame, expansion: DataFrame, n: int, span: int | None = None) -> DataFrame:
    """``pos, sa`` of the distinct ``positions(pos)`` only: from a position to
    its group, to its second-level row, to its occurrence. Only groups and rows
    that hold an asked position are expanded; a row of one entry isn't even then."""
    asked = stored(positions.select("pos").distinct(), "asked")
    held = containing(asked, groups.select("row1", F.col("l_left").alias("first"), F.col("l_right").alias("last")), span).select("row1").distinct()
    rows, entries = placed_rows(groups.join(stored(held, "held"), "row1", "left_semi"), suffix1, m_table, expansion)
    at = containing(asked, rows.withColumns({"first": F.col("start"), "last": F.col("start") + F.col("cnt") - 1}), span)
    at = stored(at.select("pos", "row1", "row2", "start", "cnt", "entries", "pid2", "back", (F.col("pos") - F.col("start")).alias("rank")), "at")
    single = at.where("entries = 1").join(ilist.withColumnRenamed("k", "rank"), ["pid2", "rank"]).select("pos", "end_pos", "back")
    needed = at.where("entries > 1").select("row1", "row2").distinct()
    several = _several(rows.join(needed, ["row1", "row2"], "left_semi"), entries, ilist).drop("start", "back")
    several = at.where("entries > 1").join(several, ["row1", "row2", "rank"]).select("pos", "end_pos", "back")
    return single.unionByName(several).select("pos", wrapped(F.col("end_pos") - F.col("back"), n).alias("sa"))


def at_run_heads(groups: DataFrame, runs: DataFrame, suffix1: DataFrame, m_table: DataFrame, ilist: DataFrame, expansion: DataFrame, n: int) -> DataFrame:
    """``run_id, sa``: one sample for each run, at its head. Groups, and of
    these second-level rows, without a run head are skipped."""
    found = lookup(runs.select(F.col("start").alias("pos")), groups_with_heads(groups, runs), suffix1, m_table, ilist, expansion, n)
    return runs.select("run_id", F.col("start").alias("pos")).join(found, "pos").select("run_id", "sa")


def skipped(groups: DataFrame, runs: DataFrame, suffix1: DataFrame, m_table: DataFrame, expansion: DataFrame, span: int | None = None) -> DataFrame:
    """``level, n_rows, n_symbols``: what the samples skip: groups without a run
    head, second-level rows without one in the other groups, and what is left."""
    needed = groups_with_heads(groups, runs)
    rows, _ = placed_rows(needed, suffix1, m_table, expansion)
    heads = containing(runs.select(F.col("start").alias("pos")), rows.withColumns({"first": F.col("start"), "last": F.col("start") + F.col("cnt") - 1}), span).select("row1", "row2").distinct()
    told = rows.join(heads.withColumn("held", F.lit(True)), ["row1", "row2"], "left").select(F.when(F.col("held"), "expanded").otherwise("row").alias("level"), "cnt")
    apart = groups.join(needed.select("row1"), "row1", "left_anti").select(F.lit("group").alias("level"), "cnt")
    return apart.unionByName(told).groupBy("level").agg(F.count("*").alias("n_rows"), F.sum("cnt").cast("bigint").alias("n_symbols"))
