"""The text index: every table it is made of, built on first use."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bwt, chunks, runs, samples
from .plans import colex, parse, suffixes
from .sources import corpus, given
from .sources.corpus import TILE, Text, load_table, save_tables
from .sources.scratch import measured_broadcasts, stored


class TextIndex:
    """Run-length BWT of a text collection with suffix-array samples.

    ``w1, p1``: symbols of a trigger window and its modulus; ``w2, p2``: the
    same for the parse of the parse. Results do not depend on them. An index
    that was given its dictionaries (``of_tables``) has no text: what needs it,
    ``text``, ``phrases``, ``parse1`` and ``occurrences``, raises ``ValueError``."""

    def __init__(self, text: Text | None, w1: int = 4, p1: int = 11, w2: int = 2, p2: int = 5):
        if min(w1, w2, p1, p2) < 1:
            raise ValueError("windows and moduli must be positive")
        self._text, self.w1, self.p1, self.w2, self.p2 = text, w1, p1, w2, p2

    @classmethod
    def of_table(cls, docs: DataFrame, key: str, text: str, w1: int = 4, p1: int = 11, w2: int = 2, p2: int = 5, tile: int = TILE) -> TextIndex:
        return cls(corpus.of_table(docs, key, text, w1, tile), w1, p1, w2, p2)

    @classmethod
    def of_strings(cls, spark: SparkSession, texts: list[str], w1: int = 4, p1: int = 11, w2: int = 2, p2: int = 5, tile: int = TILE) -> TextIndex:
        return cls(corpus.of_strings(spark, texts, w1, tile), w1, p1, w2, p2)

    @classmethod
    def of_fasta(cls, spark: SparkSession, path: str, w1: int = 4, p1: int = 11, w2: int = 2, p2: int = 5, tile: int = TILE) -> TextIndex:
        """A sequence for each record; records of any length."""
        return cls(corpus.of_fasta(spark, path, w1, tile), w1, p1, w2, p2)

    @classmethod
    def of_tables(cls, dict1: DataFrame, dict2: DataFrame, parse2: DataFrame, w1: int, w2: int) -> TextIndex:
        """From dictionaries and second parse that were built elsewhere:
        ``dict1(pid, phrase)``, ``dict2(pid2, toks)``, ``parse2(i, pid2)``; ids are
        the ranks of their phrases, tokens 0 stand for the terminators. The
        frequencies of first-level phrases follow from the second level."""
        measured_broadcasts(dict1.sparkSession)
        self = cls(None, w1, 1, w2, 1)
        self.dict2 = stored(dict2.join(parse2.groupBy("pid2").agg(F.count("*").alias("freq")), "pid2").select("pid2", "toks", F.size("toks").cast("bigint").alias("len"), "freq"), "dict2")
        used = self.dict2.select("freq", F.explode(F.slice("toks", F.lit(1), F.size("toks") - w2)).alias("pid")).groupBy("pid").agg(F.sum("freq").alias("freq"))
        self.dict1 = stored(dict1.join(used, "pid").select("pid", "phrase", F.length("phrase").cast("bigint").alias("len"), "freq"), "dict1")
        self.parse2 = parse.parse2(parse2.select("i", "pid2"), self.dict2, self.dict1, w1, w2)
        return self

    @classmethod
    def of_files(cls, spark: SparkSession, prefix: str, w1: int, w2: int, shift: int = given.SHIFT) -> TextIndex:
        """From the files ``prefix``.dict, .parse.dict and .parse.parse."""
        return cls.of_tables(*given.read_tables(spark, prefix, shift), w1, w2)

    @property
    def text(self) -> Text:
        if self._text is None:
            raise ValueError("this index was built from given dictionaries and has no text")
        return self._text

    @property
    def corpus(self) -> DataFrame:
        """``k, own, off``."""
        return self.text.sequences

    @cached_property
    def cuts(self) -> parse.Cuts:
        return parse.phrases1(self.text.tiles, self.w1, self.p1)

    @cached_property
    def phrases(self) -> DataFrame:
        """``tile, j, x, sep_so_far, phrase``."""
        return stored(self.cuts.phrases, "phrases")

    @property
    def occurrences(self) -> DataFrame:
        """``k, j, start, phrase``."""
        return parse.occurrences(self.cuts, self.phrases, self.corpus, self.w1, self.text.tile, "phrase").select("k", "j", "start", "phrase")

    @property
    def trigger_positions(self) -> DataFrame:
        return parse.trigger_positions(parse.occurrences(self.cuts, self.phrases, self.corpus, self.w1, self.text.tile), self.corpus, self.w1)

    @cached_property
    def dict1(self) -> DataFrame:
        return parse.dictionary1(self.phrases)

    @cached_property
    def ids(self) -> DataFrame:
        """``i, pid, tile, j, x, sep_so_far``: the first parse."""
        return parse.parse1(self.cuts, self.phrases, self.dict1)

    @property
    def parse1(self) -> DataFrame:
        """``i, pid, k, j, start, len``."""
        placed = parse.occurrences(self.cuts, self.ids.drop("i"), self.corpus, self.w1, self.text.tile, "pid")
        return placed.join(self.dict1.select("pid", "len"), "pid").select("i", "pid", "k", "j", "start", "len")

    @cached_property
    def cuts2(self) -> parse.Cuts:
        cuts = parse.phrases2(parse.tiles2(self.ids, self.dict1, self.cuts.count, self.w2, self.tile2), self.w2, self.p2)
        cuts.phrases = stored(cuts.phrases, "phrases2")
        return cuts

    #: Tokens of a tile of the second level.
    tile2 = parse.TILE2

    @cached_property
    def dict2(self) -> DataFrame:
        return parse.dictionary2(self.cuts2.phrases)

    @cached_property
    def parse2(self) -> DataFrame:
        return parse.parse2(parse.numbered2(self.cuts2, self.dict2), self.dict2, self.dict1, self.w1, self.w2)

    @cached_property
    def n(self) -> int:
        return self.dict1.agg(F.sum((F.col("len") - self.w1) * F.col("freq"))).first()[0]

    @cached_property
    def suffix1(self) -> DataFrame:
        return stored(suffixes.suffix1(self.dict1, self.w1), "suffix1")

    @cached_property
    def groups(self) -> DataFrame:
        return suffixes.groups(self.suffix1)

    @cached_property
    def m_table(self) -> DataFrame:
        return suffixes.m_table(self.dict2, self.w2)

    @cached_property
    def v_table(self) -> DataFrame:
        return suffixes.v_table(self.m_table)

    @cached_property
    def ilist(self) -> DataFrame:
        return suffixes.ilist(self.parse2)

    @cached_property
    def expansion(self) -> DataFrame:
        return suffixes.row2_expansion(self.m_table, self.dict2, self.dict1, self.w1, self.w2)

    @cached_property
    def hard_rows(self) -> DataFrame:
        return bwt.hard_rows(self.groups, self.suffix1, self.v_table)

    def pieces(self, tier: str) -> DataFrame:
        """Pieces of the BWT, ``start, ch, len, row1, tier``, of a tier."""
        if tier == "easy":
            return bwt.easy_runs(self.groups)
        if tier == "hard_easy":
            return bwt.hard_easy_runs(self.hard_rows)
        if tier == "hard_hard":
            return bwt.hard_hard_chars(self.hard_rows, self.groups, self.suffix1, self.m_table, self.ilist)
        raise ValueError(f"no tier {tier!r}")

    @cached_property
    def all_pieces(self) -> DataFrame:
        return stored(self.pieces("easy").unionByName(self.pieces("hard_easy")).unionByName(self.pieces("hard_hard")), "pieces")

    @cached_property
    def rlbwt(self) -> DataFrame:
        return stored(runs.encode(self.all_pieces), "rlbwt")

    @cached_property
    def ssa(self) -> DataFrame:
        return samples.at_run_heads(self.groups, self.rlbwt, self.suffix1, self.m_table, self.ilist, self.expansion, self.n)

    @cached_property
    def suffix_array(self) -> DataFrame:
        return samples.suffix_array(self.groups, self.suffix1, self.m_table, self.ilist, self.expansion, self.n)

    def lookup(self, positions: DataFrame) -> DataFrame:
        """``pos, sa`` of ``positions(pos)``, without the rest of the array."""
        return samples.lookup(positions, self.groups, self.suffix1, self.m_table, self.ilist, self.expansion, self.n)

    @cached_property
    def colex2(self) -> DataFrame:
        return colex.colex2(self.dict2, colex.colex1(self.dict1))

    @cached_property
    def m_intervals(self) -> DataFrame:
        return stored(colex.m_intervals(self.m_table, self.colex2), "m_intervals")

    def hard_hard_by_interval(self) -> DataFrame:
        return colex.hard_hard_chars(self.hard_rows, self.groups, self.suffix1, self.m_intervals, self.dict2, self.colex2, self.ilist)

    def _within(self, row_start: int, row_end: int) -> tuple[DataFrame, DataFrame]:
        """Groups ``row_start`` to ``row_end`` and their suffixes; these are read
        by a range of the groups' numbers, which the scan is given."""
        groups = self.groups.where(F.col("row1").between(row_start, row_end))
        low, high = groups.agg(F.min("grp"), F.max("grp")).first()
        return groups, self.suffix1.where(F.col("grp").between(low, high))

    def chunk_runs(self, row_start: int, row_end: int) -> DataFrame:
        """``start, ch, len, row1``: maximal runs of a range of groups, built from
        these groups alone; ``operators.runs.merged`` puts chunks together."""
        groups, suffix1 = self._within(row_start, row_end)
        hard = bwt.hard_rows(groups, suffix1, self.v_table)
        pieces = bwt.easy_runs(groups).unionByName(bwt.hard_easy_runs(hard)).unionByName(bwt.hard_hard_chars(hard, groups, suffix1, self.m_table, self.ilist))
        return runs.merged(pieces.select("start", "ch", "len", "row1"))

    def chunk_suffix_array(self, row_start: int, row_end: int) -> DataFrame:
        """``pos, row1, sa`` of a range of groups."""
        groups, suffix1 = self._within(row_start, row_end)
        return samples.suffix_array(groups, suffix1, self.m_table, self.ilist, self.expansion, self.n)

    def bwt(self) -> DataFrame:
        return runs.decode(self.rlbwt)

    def chunk_plan(self, chunks: int = 50) -> DataFrame:
        return chunks_plan(self.groups, self.n, chunks)

    def save(self, path: str, bwt_only: bool = False) -> None:
        """Write ``rlbwt`` and, unless ``bwt_only``, ``ssa`` as Parquet."""
        save_tables({"rlbwt": self.rlbwt} | ({} if bwt_only else {"ssa": self.ssa}), path)

    def save_flat(self, prefix: str, bwt_only: bool = False) -> None:
        """Write ``prefix``.runs and, unless ``bwt_only``, ``prefix``.ssa, in
        parts whose concatenation is the flat file."""
        corpus.write_runs(self.rlbwt, f"{prefix}.runs")
        if not bwt_only:
            corpus.write_ssa(self.ssa, f"{prefix}.ssa")


chunks_plan = chunks.plan


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    return load_table(spark, path, name)
