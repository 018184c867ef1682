"""Suffix tables of both dictionaries and the tables that invert them.

A suffix is a row with its phrase and its start; its order is a number, from
``order.suffix_order``. The suffix itself is stored nowhere, so the tables grow
with the dictionaries, however long a phrase is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from ..sources.ship import ship
from .order import running, suffix_order, suffix_ranks, within

#: Symbols, and tokens, by which suffixes are first ordered.
HEAD1, HEAD2 = 32, 8


def suffix1(dict1: DataFrame, w: int) -> DataFrame:
    """``pid, s, len_alpha, prev, freq, grp``: proper phrase suffixes of ``w``
    symbols or more, the symbol before each, and a number that orders them, the
    same for equal ones."""
    ship(dict1.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pid, phrase, freq in zip(*(batch.column(c).to_pylist() for c in ("pid", "phrase", "freq"))):
                for a in range(1, len(phrase), 1 << 15):
                    b = min(len(phrase), a + (1 << 15))
                    part = phrase[a - 1 : b + HEAD1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(b - a, pid, np.int64)), pa.array(np.arange(a + 1, b + 1, dtype=np.int64)), pa.array(np.arange(len(phrase) - a, len(phrase) - b, -1, dtype=np.int64)),
                            pa.array(list(part[: b - a])), pa.array(np.full(b - a, freq, np.int64)), pa.array([part[i : i + HEAD1] for i in range(1, b - a + 1)]),
                        ],
                        names=["owner", "s", "rem", "prev", "freq", "head"],
                    )

    rows = dict1.select("pid", "phrase", "freq").mapInArrow(work, "owner bigint, s bigint, rem bigint, prev string, freq bigint, head string")
    ranked = suffix_order(stored(rows, "suffixes"), ["head"], HEAD1)
    return ranked.where(F.col("rem") >= w).select(F.col("owner").alias("pid"), "s", F.col("rem").alias("len_alpha"), "prev", "freq", F.col("rank").alias("grp"))


def groups(suffix1: DataFrame) -> DataFrame:
    """One row for each distinct suffix: its size in the text, how many symbols
    and phrases come before it, its range of the BWT, the tier it needs, and one
    phrase and start where it is found."""
    g = suffix1.groupBy("grp").agg(
        F.max("len_alpha").alias("len_alpha"), F.sum("freq").alias("cnt"), F.count_distinct("prev").alias("n_chars"), F.count("*").alias("n_pids"), F.min("prev").alias("ch"), F.min(F.struct("pid", "s")).alias("at")
    )
    g = running(g, ["grp"], "l_left", F.col("cnt"), rank="row1")
    kind = F.when(F.col("n_chars") == 1, "easy").otherwise("hard")
    return stored(g.select("row1", "grp", "len_alpha", "cnt", "n_chars", "n_pids", "l_left", (F.col("l_left") + F.col("cnt") - 1).alias("l_right"), kind.alias("kind"), "ch", F.col("at.pid").alias("pid"), F.col("at.s").alias("s")), "groups")


def spelled(rows: DataFrame, dict1: DataFrame) -> DataFrame:
    """``rows(pid, s, ...)`` with each suffix in full, ``alpha``, for those who
    want to read it."""
    return rows.join(dict1.select("pid", "phrase"), "pid").withColumn("alpha", F.expr("substring(phrase, cast(s as int))")).drop("phrase")


def m_table(dict2: DataFrame, w: int) -> DataFrame:
    """``row2, pid2, s, len_alpha2, prev_pid, freq``: proper suffixes of the
    second dictionary of ``w`` ids or more, where they start, the id before
    each, and the rank of the suffix among distinct ones."""
    size = F.col("len").cast("int")
    heads = [f"h{k}" for k in range(HEAD2)]
    rows = dict2.where(F.col("len") > 1).select("pid2", "toks", "len", "freq", F.explode(F.sequence(F.lit(2), size)).alias("s")).select(
        F.col("pid2").alias("owner"), F.col("s").cast("bigint").alias("s"), (F.col("len") - F.col("s") + 1).alias("rem"), F.get("toks", F.col("s") - 2).alias("prev_pid"), "freq",
        *(F.coalesce(F.get("toks", F.col("s") + (k - 1)), F.lit(-1)).alias(h) for k, h in enumerate(heads)),
    )
    s = suffix_order(stored(rows, "suffixes2"), heads, HEAD2).where(F.col("rem") >= w)
    s = stored(s, "suffix2")
    rows2 = stored(running(s.select("rank").distinct(), ["rank"], "row2"), "rows2")
    return stored(s.join(rows2, "rank").select("row2", F.col("owner").alias("pid2"), "s", F.col("rem").alias("len_alpha2"), "prev_pid", "freq"), "m_table")


def v_table(m: DataFrame) -> DataFrame:
    """``pid, row2, cnt``: which second-level suffixes follow a phrase, and how
    often; the leading zeros are no phrase."""
    return m.where("prev_pid > 0").groupBy(F.col("prev_pid").alias("pid"), "row2").agg(F.sum("freq").alias("cnt"))


def ilist(parse2: DataFrame) -> DataFrame:
    """``pid2, k, pos2, end_pos``: for each phrase its places in the BWT of the
    second parse, ascending, and where the text of each occurrence ends."""
    ranks = suffix_ranks(parse2.select("i", F.col("pid2").alias("x")))
    after = ranks.select((F.col("i") - 1).alias("i"), F.col("rank").alias("pos2"))
    x = parse2.join(after, "i", "left").select("pid2", F.coalesce("pos2", F.lit(0)).cast("bigint").alias("pos2"), "end_pos")
    return stored(within(x, ["pid2"], ["pos2"], "k", x.groupBy("pid2").agg(F.count("*").alias("size"))).select("pid2", "k", "pos2", "end_pos"), "ilist")


def row2_expansion(m: DataFrame, dict2: DataFrame, dict1: DataFrame, w1: int, w2: int) -> DataFrame:
    """``row2, expands``: text symbols that a second-level suffix adds before
    its last ``w2`` ids: a difference of the running sum of all phrases' ids,
    taken where the suffix starts and where the phrase's last ``w2`` ids do."""
    ids = dict2.select("pid2", F.posexplode("toks").alias("s", "pid")).select("pid2", (F.col("s") + 1).cast("bigint").alias("s"), "pid")
    sized = ids.join(dict1.select("pid", "len"), "pid", "left").select("pid2", "s", F.coalesce(F.col("len") - w1, F.lit(0)).alias("adds"))
    upto = stored(running(sized, ["pid2", "s"], "upto", F.col("adds")).select("pid2", "s", "upto"), "upto")
    each = m.groupBy("row2").agg(F.min(F.struct("pid2", "s", "len_alpha2")).alias("a")).select("row2", "a.*")
    begin = each.join(upto, ["pid2", "s"]).select("row2", "pid2", (F.col("s") + F.col("len_alpha2") - w2).alias("s"), F.col("upto").alias("begin"))
    return begin.join(upto, ["pid2", "s"]).select("row2", (F.col("upto") - F.col("begin")).cast("bigint").alias("expands"))
