"""Dictionaries and second parse in files, as the parser and the index exchange
them: ``.dict`` (bytes), ``.parse.dict`` and ``.parse.parse`` (32-bit numbers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.order import running
from .flat import RANGE, read_records, read_words, write_records, write_words
from .scratch import measured_broadcasts

#: Fixed value: ids of first-level phrases begin above this; numbers below are reserved,
#: and stand for terminators.
SHIFT = 10
#: Fixed value: the number written for a terminator of the second level.
DOLLAR = 2


def _numbered(words: DataFrame, name: str) -> DataFrame:
    """``name, word``: words by their place in the file, from 1, which must be
    their rank."""
    placed = running(words, ["at"], "_i_").select((F.col("_i_") + 1).alias(name), "word")
    ranked = running(placed, ["word"], "_r_")
    if not ranked.where(F.col("_r_") + 1 != F.col(name)).isEmpty():
        raise ValueError("the dictionary isn't sorted, or has a word twice")
    return ranked.drop("_r_")


def read_tables(spark: SparkSession, prefix: str, shift: int = SHIFT, range_bytes: int = RANGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``dict1(pid, phrase)``, ``dict2(pid2, toks)`` and ``parse2(i, pid2)`` of
    the files of ``prefix``. Bytes become characters of the same number; ids lose
    their shift, terminators become 0; a 0 that ends the parse is left out."""
    measured_broadcasts(spark)
    dict1 = _numbered(read_words(spark, f"{prefix}.dict", 1, range_bytes), "pid").withColumnRenamed("word", "phrase")
    ids = F.transform("word", lambda t: F.when(t < shift, 0).otherwise(t - shift).cast("bigint"))
    words = read_words(spark, f"{prefix}.parse.dict", 4, range_bytes).select("at", ids.alias("word"))
    dict2 = _numbered(words, "pid2").withColumnRenamed("word", "toks")
    parse2 = read_records(spark, f"{prefix}.parse.parse", "pid2:I", 0, range_bytes).where("pid2 > 0").select("i", "pid2")
    return dict1, dict2, parse2


def write_tables(dict1: DataFrame, dict2: DataFrame, parse2: DataFrame, prefix: str, shift: int = SHIFT) -> None:
    """The files of ``read_tables``, each in parts. Symbols beyond 255 can't be
    written; a phrase must not hold the symbols 0 and 1."""
    write_words(dict1.select((F.col("pid") - 1).alias("i"), F.col("phrase").alias("word")), f"{prefix}.dict")
    ids = F.transform("toks", lambda t: F.when(t == 0, DOLLAR).otherwise(t + shift))
    write_words(dict2.select((F.col("pid2") - 1).alias("i"), ids.alias("word")), f"{prefix}.parse.dict", 4)
    write_records(parse2.select("i", "pid2"), "pid2:I", f"{prefix}.parse.parse")
