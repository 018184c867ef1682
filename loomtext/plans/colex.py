"""Colexicographic order: phrases by their ends.

Second-level phrases that end alike stand together in it, so all phrases with
one suffix are an interval, and a row of the table of suffixes is of constant
size however many phrases it stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import containing
from ..sources.scratch import stored
from .order import running, suffix_order, within

#: Phrases of a piece of the interval join.
SPAN = 256


def colex1(dict1: DataFrame) -> DataFrame:
    """``pid, colex``: ranks of the phrases read backwards, from 1."""
    ranked = running(dict1.select("pid", F.reverse("phrase").alias("r")), ["r"], "colex")
    return stored(ranked.select("pid", (F.col("colex") + 1).alias("colex")), "colex1")


def colex2(dict2: DataFrame, colex1: DataFrame, head: int = 4) -> DataFrame:
    """``pid2, colex2``: ranks, from 0, of the second-level phrases read
    backwards, ids by ``colex``, terminators first. It is the order of the
    suffixes that are whole phrases among all suffixes of reversed phrases."""
    ids = dict2.select("pid2", "len", F.posexplode("toks").alias("i", "pid"))
    each = ids.join(colex1, "pid", "left").select("pid2", (F.col("len") - F.col("i")).alias("s"), F.coalesce("colex", F.lit(0)).alias("x"))
    back = stored(each.groupBy("pid2").agg(F.sort_array(F.collect_list(F.struct("s", "x"))).alias("r")).select("pid2", F.col("r.x").alias("r")), "reversed")
    heads = [f"h{k}" for k in range(head)]
    rows = back.select("pid2", "r", F.explode(F.sequence(F.lit(1), F.size("r"))).alias("s"))
    rows = rows.select(F.col("pid2").alias("owner"), F.col("s").cast("bigint").alias("s"), (F.size("r") - F.col("s") + 1).cast("bigint").alias("rem"), *(F.coalesce(F.get("r", F.col("s") + (k - 1)), F.lit(-1)).alias(h) for k, h in enumerate(heads)))
    whole = suffix_order(stored(rows, "suffixes"), heads, head).where("s = 1").select(F.col("owner").alias("pid2"), "rank")
    return stored(running(whole, ["rank"], "colex2").select("pid2", "colex2"), "colex2")


def m_intervals(m_table: DataFrame, colex2: DataFrame) -> DataFrame:
    """``row2, len_alpha2, left, right``: each distinct second-level suffix, and
    the interval of phrases that end with it."""
    return m_table.join(colex2, "pid2").groupBy("row2").agg(F.max("len_alpha2").alias("len_alpha2"), F.min("colex2").alias("left"), F.max("colex2").alias("right"))


def hard_hard_chars(rows: DataFrame, groups: DataFrame, suffix1: DataFrame, intervals: DataFrame, dict2: DataFrame, colex2: DataFrame, ilist: DataFrame, span: int = SPAN) -> DataFrame:
    """As ``operators.bwt.hard_hard_chars``, by the intervals: of a row's
    interval those phrases whose id before the suffix is one of the group's."""
    rows = stored(rows.where("n_pids > 1").select("row1", "row2", "start", "cnt"), "several")
    chars = groups.select("row1", "grp").join(suffix1.select("grp", F.col("pid").alias("prev_pid"), "prev"), "grp").select("row1", "prev_pid", "prev")
    ends = intervals.join(rows.select("row2").distinct(), "row2").withColumns({"first": F.col("left"), "last": F.col("right")})
    phrases = dict2.join(colex2, "pid2").select("pid2", "toks", "len", "colex2")
    before = F.get("toks", (F.col("len") - F.col("len_alpha2") - 1).cast("int"))
    held = containing(phrases, ends, span, "colex2").select("row2", "pid2", before.alias("prev_pid"))
    found = rows.join(held, "row2").join(chars, ["row1", "prev_pid"]).join(ilist.select("pid2", "pos2"), "pid2")
    found = within(found.select("row1", "row2", "start", "prev", "pos2"), ["row1", "row2"], ["pos2"], "rank", rows.select("row1", "row2", F.col("cnt").alias("size")))
    return found.select((F.col("start") + F.col("rank")).alias("start"), F.col("prev").alias("ch"), F.lit(1).cast("bigint").alias("len"))
