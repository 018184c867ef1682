"""Schemas of the results of the index, all positions and ids being 64-bit."""

from __future__ import annotations

from pyspark.sql.types import LongType, StringType, StructField, StructType


def _of(**fields) -> StructType:
    return StructType([StructField(k, v, True) for k, v in fields.items()])


_L, _S = LongType(), StringType()
RLBWT = _of(run_id=_L, ch=_S, start=_L, len=_L, row1=_L)
CHUNKS = _of(chunk=_L, row_start=_L, row_end=_L, l_left=_L, cnt=_L)
