"""Sequences, phrases and keys that are large: nothing of them is one row or one task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions.symbols import separator
from loomtext.index import TextIndex
from loomtext.plans import order
from loomtext.plans.order import suffix_order, within


def naive(texts, w):
    t = "".join(x + separator(w) for x in texts) + "\x02" * w
    sa = sorted(range(len(t)), key=lambda i: t[i:] + t[:i])
    return t, sa, "".join(t[i - 1] for i in sa)


def doubling(t):
    """The suffix array of a circular text by prefix doubling in numpy."""
    rank = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64)
    n, step = len(rank), 1
    while True:
        key = rank * (rank.max() + 2) + np.roll(rank, -step)
        fresh = np.unique(key, return_inverse=True)[1]
        if fresh.max() == n - 1 or step > n:
            return np.argsort(fresh, kind="stable")
        rank, step = fresh, step * 2


@pytest.mark.parametrize("w1,p1,w2,p2,tile,tile2", [(3, 7, 2, 3, 5, 3), (2, 10**6 + 1, 2, 2, 4, 2), (10, 3, 5, 4, 11, 5)])
def test_tiles_make_no_difference(spark, monkeypatch, w1, p1, w2, p2, tile, tile2):
    """Triggers and phrases across borders of small tiles, at both levels;
    phrases longer than a tile, and windows about as long as one."""
    r = random.Random(tile)
    texts = ["".join(r.choice("abé") for _ in range(r.randint(0, 60))) for _ in range(4)] + ["a" * 50, ""]
    monkeypatch.setattr(TextIndex, "tile2", tile2)
    cut, whole = TextIndex.of_strings(spark, texts, w1, p1, w2, p2, tile), TextIndex.of_strings(spark, texts, w1, p1, w2, p2)
    whole.tile2 = 1 << 14
    t, sa, b = naive(texts, w1)
    assert cut.text.tiles.count() == -(-len(t) // tile)
    assert "".join(x.text for x in cut.text.tiles.orderBy("tile").collect()) == t
    for table in ("occurrences", "trigger_positions", "dict1", "parse1", "dict2", "parse2"):
        a, c = (sorted(map(tuple, getattr(x, table).collect())) for x in (cut, whole))
        assert a == c, table
    assert "".join(x.ch for x in cut.bwt().orderBy("pos").collect()) == b
    assert [x.sa for x in cut.suffix_array.orderBy("pos").collect()] == sa


def test_long_record(spark, tmp_path):
    """A record of many lines is many rows; its index is that of its symbols."""
    r = random.Random(8)
    block = ["".join(r.choice("ACGT") for _ in range(400)) for _ in range(12)]
    text = "".join(r.choice(block) for _ in range(75))
    lines = [text[i : i + 61] for i in range(0, len(text), 61)]
    (tmp_path / "a.fa").write_text("no record\n>long one\n" + "\n".join(lines) + "\n>empty\n\n>short\nAC GT\r\nAC\n")
    x = TextIndex.of_fasta(spark, str(tmp_path / "a.fa"), 4, 11, 2, 5, tile=1000)
    t = text + separator(4) + separator(4) + "ACGTAC" + separator(4) + "\x02" * 4
    assert "".join(r.text for r in x.text.tiles.orderBy("tile").collect()) == t
    assert [(r.k, r.own, r.off) for r in x.corpus.orderBy("k").collect()] == [(0, 30_004, 0), (1, 4, 30_004), (2, 10, 30_008), (3, 4, 30_018)]
    sa = doubling(t)
    assert np.array([r.sa for r in x.suffix_array.orderBy("pos").collect()]).tolist() == sa.tolist()


def test_fasta_files_in_order(spark, tmp_path):
    from loomtext.sources.corpus import from_fasta

    (tmp_path / "a.fa").write_text(">a1\nA\n")
    (tmp_path / "b.fa").write_text(">b1\nCC\n>b2\nGG" + "G" * 200 + "\n")
    (tmp_path / "c.fa").write_text(">c1\nT\n")
    assert [r.name for r in from_fasta(spark, str(tmp_path)).orderBy("doc_id").collect()] == ["a1", "b1", "b2", "c1"]
    x = TextIndex.of_fasta(spark, str(tmp_path), 2, 5)
    assert "".join(r.text for r in x.text.tiles.collect()).replace(separator(2), "|") == "A|CC|GG" + "G" * 200 + "|T|\x02\x02"


def test_one_repeated_symbol(spark):
    """One phrase of 20,000 equal symbols: its suffixes take rows, not text."""
    n = 20_000
    x = TextIndex.of_strings(spark, ["c" * n], 4, 10**9 + 7, 2, 5)
    assert x.dict1.agg(F.max("len")).first()[0] == n + 8
    assert x.suffix1.count() == n + 8 and "alpha" not in x.suffix1.columns
    assert [(r.ch, r.len) for r in x.rlbwt.orderBy("run_id").collect()] == [(c, k) for c, k in run_lengths(circular(n))]


def circular(n):
    """The transform of n times c, separator, terminators."""
    t = "c" * n + separator(4) + "\x02" * 4
    sa = doubling(t)
    return [t[i - 1] for i in sa]


def run_lengths(symbols):
    out = []
    for c in symbols:
        if out and out[-1][0] == c:
            out[-1][1] += 1
        else:
            out.append([c, 1])
    return [tuple(x) for x in out]


def test_suffix_order(spark):
    """Suffixes of many sequences, equal ones among them, against sorting."""
    r = random.Random(1)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 30))) + "$" for _ in range(12)]
    words += [words[0][3:], "a" * 40 + "$"]
    rows = [(o, s, len(x) - s, x[s : s + 2], "more") for o, x in enumerate(words) for s in range(len(x))]
    for few in (0, 10**6):
        got = suffix_order(spark.createDataFrame(rows, "owner long, s long, rem long, head string, extra string"), ["head"], 2, few).collect()
        suffix = {(o, s): words[o][s:] for o, s, *_ in rows}
        ordered = sorted(suffix.values())
        assert {(x.owner, x.s): x.rank for x in got} == {k: ordered.index(v) for k, v in suffix.items()}
        assert all(x.extra == "more" for x in got)


def test_places_in_a_hot_group(spark, monkeypatch):
    """A group of nine tenths of the rows is ranked in ranges."""
    df = spark.range(1000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(3).alias("g"), (F.col("id") * 37 % 1000).alias("v"))
    got = within(df, ["g"], ["v"], "k", df.groupBy("g").agg(F.count("*").alias("size")), few=0).collect()
    want = {}
    for r in sorted(df.collect()):
        want.setdefault(r.g, []).append(r.v)
    assert {(r.g, r.v): r.k for r in got} == {(g, v): k for g, vs in want.items() for k, v in enumerate(vs)}
    tasks = []
    kept = order.stored
    monkeypatch.setattr(order, "stored", lambda d, tag: tasks.append(d.groupBy("_p_").count().collect()) or kept(d, tag) if tag == "ranged" and "v" in d.columns else kept(d, tag))
    within(df, ["g"], ["v"], "k", df.groupBy("g").agg(F.count("*").alias("size")), few=0)
    assert max(r["count"] for r in tasks[0]) < 500


def test_index_of_given_tables_names_what_it_lacks(spark):
    dict1 = spark.createDataFrame([(1, "$$ab"), (2, "ab$$")], "pid long, phrase string")
    dict2 = spark.createDataFrame([(1, [0, 0, 1, 2, 0, 0])], "pid2 long, toks array<long>")
    x = TextIndex.of_tables(dict1, dict2, spark.createDataFrame([(0, 1)], "i long, pid2 long"), 2, 2)
    for name in ("text", "corpus", "phrases", "parse1", "occurrences", "trigger_positions"):
        with pytest.raises(ValueError, match="no text"):
            getattr(x, name)


def test_settled_suffixes_leave_the_rounds(spark, monkeypatch):
    """On ordinary text, all rounds together sort fewer rows than there are suffixes."""
    seq = [(r.i, r.pid) for r in TextIndex.of_table(spark.read.parquet("/root/testdata/sf0.001/part.parquet"), "p_partkey", "p_name").ids.select("i", "pid").collect()]
    sorted_rows = []
    kept = order.stored
    monkeypatch.setattr(order, "stored", lambda d, tag: (lambda out: sorted_rows.append(out.count()) or out if tag == "pairs" else out)(kept(d, tag)))
    got = {r.i: r.rank for r in order.suffix_ranks(spark.createDataFrame(seq, "i long, x long"), tile=100).collect()}
    values = [x for _, x in sorted(seq)]
    ordered = sorted(range(len(values)), key=lambda i: values[i:])
    assert got == {i: k + 1 for k, i in enumerate(ordered)}
    assert sorted_rows == sorted(sorted_rows, reverse=True) and sum(sorted_rows) < len(seq)
