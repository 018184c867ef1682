"""Division of the BWT in ranges of groups of about equal length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CHUNKS


def plan(groups: DataFrame, n: int, chunks: int) -> DataFrame:
    """``chunk, row_start, row_end, l_left, cnt``. A chunk closes after the
    group that takes it past n / chunks; so there are at most ``chunks``, and
    may be fewer. Only each chunk's end is looked up, by an aggregate."""
    if not 1 <= chunks <= 1000:
        raise ValueError("chunks must be from 1 to 1000")
    size = n // chunks if chunks > 1 else n + 1
    rows, row, left = [], 0, 0
    last = groups.agg(F.max("row1"), F.max("l_right")).first()
    while last[0] is not None and row <= last[0]:
        end = groups.where((F.col("row1") >= row) & (F.col("l_right") > left + size)).agg(F.min(F.struct("row1", "l_right"))).first()[0]
        stop, right = (end["row1"], end["l_right"]) if end else last
        rows.append((len(rows), row, stop, left, right - left + 1))
        row, left = stop + 1, right + 1
    return groups.sparkSession.createDataFrame(rows, CHUNKS)
