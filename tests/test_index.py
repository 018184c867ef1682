import random

import pytest
from pyspark.sql import functions as F

from loomtext.functions.symbols import separator
from loomtext.index import TextIndex, load
from loomtext.operators import bwt, runs, samples
from loomtext.plans.order import running, suffix_ranks
from loomtext.plans.suffixes import spelled
from loomtext.sources.corpus import from_fasta, read_ssa, write_ssa


def naive(texts, w):
    t = "".join(x + separator(w) for x in texts) + "\x02" * w
    sa = sorted(range(len(t)), key=lambda i: t[i:] + t[:i])
    return t, sa, "".join(t[i - 1] for i in sa)


def heads(b):
    return [i for i in range(len(b)) if i == 0 or b[i] != b[i - 1]]


PHRASES = ["$$GAT", "ATACA", "ATTACA", "ATTAGAT", "CA$$", "CAGAT"]
PARSE = [1, 3, 6, 4, 2, 6, 3, 5]


@pytest.fixture(scope="module")
def small(spark):
    """The text GATTACAGATTAGATACAGATTACA$$ by phrases that were given by hand."""
    dict1 = spark.createDataFrame(list(enumerate(PHRASES, 1)), "pid long, phrase string")
    dict2 = spark.createDataFrame([(1, [0, 0, *PARSE, 0, 0])], "pid2 long, toks array<long>")
    return TextIndex.of_tables(dict1, dict2, spark.createDataFrame([(0, 1)], "i long, pid2 long"), 2, 2)


def test_small_fixture(small):
    assert small.n == 27
    assert "".join(r.ch for r in small.bwt().orderBy("pos").collect()) == "A$CTTTTCCGGGGAAAAA$ATATTAAA"
    assert [r.sa for r in small.suffix_array.orderBy("pos").collect()] == [25, 26, 24, 22, 15, 4, 11, 17, 6, 13, 19, 1, 8, 23, 16, 5, 12, 18, 0, 7, 21, 14, 3, 10, 20, 2, 9]
    assert [r.sa for r in small.ssa.orderBy("run_id").collect()] == [25, 26, 24, 22, 17, 13, 23, 0, 7, 21, 14, 3, 20]


def test_small_groups(small):
    got = [(r.alpha, r.cnt, r.l_left, r.l_right, r.kind) for r in spelled(small.groups, small.dict1).orderBy("row1").collect()]
    assert got == [
        ("$$", 1, 0, 0, "easy"), ("$GAT", 1, 1, 1, "easy"), ("A$$", 1, 2, 2, "easy"), ("ACA", 3, 3, 5, "easy"), ("AGAT", 3, 6, 8, "hard"), ("AT", 4, 9, 12, "easy"),
        ("CA", 3, 13, 15, "easy"), ("GAT", 4, 16, 19, "hard"), ("TACA", 3, 20, 22, "hard"), ("TAGAT", 1, 23, 23, "easy"), ("TTACA", 2, 24, 25, "easy"), ("TTAGAT", 1, 26, 26, "easy"),
    ]


CASES = [(4, 11, 2, 5, 1), (2, 3, 1, 2, 3), (1, 3, 2, 2, 1)]


@pytest.mark.parametrize("w1,p1,w2,p2,times", CASES)
def test_against_rotations(spark, w1, p1, w2, p2, times):
    r = random.Random(w1 * 100 + p1)
    texts = ["".join(r.choice("abé") for _ in range(r.randint(0, 30))) for _ in range(r.randint(2, 6))] * times + ["ababababab", ""]
    x = TextIndex.of_strings(spark, texts, w1, p1, w2, p2)
    t, sa, b = naive(texts, w1)
    assert x.n == len(t)
    assert "".join(r.ch for r in x.bwt().orderBy("pos").collect()) == b
    assert [r.sa for r in x.suffix_array.orderBy("pos").collect()] == sa
    at = heads(b)
    assert [(r.start, r.ch) for r in x.rlbwt.orderBy("run_id").collect()] == [(i, b[i]) for i in at]
    assert [r.sa for r in x.ssa.orderBy("run_id").collect()] == [sa[i] for i in at]
    again = bwt.from_suffix_array(x.text.tiles, x.suffix_array, x.n, x.text.tile)
    assert "".join(r.ch for r in again.orderBy("pos").collect()) == b
    # invariants of the tables
    assert x.groups.agg(F.sum("cnt")).first()[0] == len(t) == x.all_pieces.agg(F.sum("len")).first()[0]
    freq = {r.pid: r.freq for r in x.dict1.collect()}
    assert {r.pid: r.n for r in x.v_table.groupBy("pid").agg(F.sum("cnt").alias("n")).collect()} == freq
    assert sum(freq.values()) == x.parse1.count()
    alphas = sorted(r.alpha for r in spelled(x.groups, x.dict1).collect())
    assert not any(q.startswith(p) for p, q in zip(alphas, alphas[1:]))
    # the parse puts the text together again
    phrases = {r.pid: r.phrase for r in x.dict1.collect()}
    assert "\x02" * w1 + t == "\x02" * w1 + "".join(phrases[r.pid][w1:] for r in x.parse1.orderBy("i").collect())
    chunks = x.chunk_plan(4).orderBy("chunk").collect()
    assert len(chunks) <= 4 and sum(c.cnt for c in chunks) == len(t)
    assert [c.l_left for c in chunks[1:]] == [c.l_left + c.cnt for c in chunks[:-1]]
    # access and the share of groups that hold heads
    got = {r.pos: r.ch for r in runs.access(x.rlbwt, spark.range(len(t)).select(F.col("id").alias("pos")), span=8).collect()}
    assert "".join(got[i] for i in range(len(t))) == b
    needed = {r.row1 for r in samples.groups_with_heads(x.groups, x.rlbwt).collect()}
    assert needed == {r.row1 for r in x.groups.collect() if any(r.l_left <= i <= r.l_right for i in at)}


def test_same_result_for_other_parameters(spark):
    texts = ["banana bandana", "bandana banana", "ananas"]
    one, two = (TextIndex.of_strings(spark, texts, 4, p1, w2, p2) for p1, w2, p2 in ((2, 1, 2), (7, 3, 3)))
    assert one.bwt().orderBy("pos").collect() == two.bwt().orderBy("pos").collect()


def test_distributed_ranks(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v"), (F.col("id") % 3).alias("w"))
    found = running(df, ["v"], "s", F.col("w"), few=0, rank="n").collect()
    assert all(r.n == r.v for r in found)
    got = {r.v: r.s for r in found}
    want, total = {}, 0
    for r in sorted(df.collect()):
        want[r.v] = total
        total += r.w
    assert got == want
    seq = [1, 2, 1, 2, 1, 3, 1, 2]
    ranks = {r.i: r.rank for r in suffix_ranks(spark.createDataFrame(list(enumerate(seq)), "i long, x long"), few=0).collect()}
    order = sorted(range(len(seq)), key=lambda i: seq[i:])
    assert ranks == {i: k + 1 for k, i in enumerate(order)}


def test_sinks_and_sources(spark, tmp_path):
    x = TextIndex.of_strings(spark, ["abcabc", "abc"])
    x.save(str(tmp_path / "out"))
    assert load(spark, str(tmp_path / "out"), "rlbwt").count() == x.rlbwt.count()
    assert write_ssa(x.ssa, str(tmp_path / "x.ssa")) == 8 * (1 + x.ssa.count())
    key = lambda r: r.run_id
    assert sorted(read_ssa(spark, str(tmp_path / "x.ssa")).collect(), key=key) == sorted(x.ssa.collect(), key=key)
    (tmp_path / "f.fa").write_text(">one first\nACGT\nAC\n>two\nGG\n")
    assert [(r.name, r.text) for r in from_fasta(spark, str(tmp_path / "f.fa")).orderBy("doc_id").collect()] == [("one", "ACGTAC"), ("two", "GG")]
    (tmp_path / "g.fa").write_text("; note > here\n>one a>b > c\nAC>GT\nAC\n\n>two\n>three\r\nGG\r\n")
    assert [(r.name, r.text) for r in from_fasta(spark, str(tmp_path / "g.fa")).orderBy("doc_id").collect()] == [("one", "AC>GTAC"), ("two", ""), ("three", "GG")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load(spark, str(tmp_path / "none"), "rlbwt")


def test_null_empty_and_reserved(spark):
    from loomtext.sources.corpus import of_table

    docs = spark.createDataFrame([(1, None, "x"), (2, "a\x02b\x04", "y"), (3, "", "z")], "key long, text string, k string")
    t, _, b = naive(["", "ab", ""], 4)
    x = TextIndex.of_table(docs, "key", "text")
    assert "".join(r.ch for r in x.bwt().orderBy("pos").collect()) == b
    assert of_table(docs.limit(0), "key", "text", 4).sequences.count() == 1
    assert TextIndex.of_table(docs.limit(0), "key", "text").n == 4


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        TextIndex(None, w1=0)
    with pytest.raises(ValueError):
        TextIndex.of_strings(spark, ["a"]).chunk_plan(0)


def test_command_line(spark, tmp_path, caplog):
    from loomtext.__main__ import main, options, parsed

    spark.createDataFrame([(1, "banana"), (2, "ananas")], "k long, t string").write.parquet(str(tmp_path / "in"))
    with caplog.at_level("INFO", logger="loomtext"):
        main([str(tmp_path / "in"), "k", "t", str(tmp_path / "out"), "--chunks", "2", "--flat"])
    t, sa, b = naive(["banana", "ananas"], 4)
    assert [r.start for r in load(spark, str(tmp_path / "out"), "rlbwt").orderBy("run_id").collect()] == heads(b)
    assert [r.sa for r in load(spark, str(tmp_path / "out"), "ssa").orderBy("run_id").collect()] == [sa[i] for i in heads(b)]
    assert [r.sa for r in read_ssa(spark, str(tmp_path / "out" / "flat.ssa")).orderBy("run_id").collect()] == [sa[i] for i in heads(b)]
    assert load(spark, str(tmp_path / "out"), "chunks").agg(F.sum("cnt")).first()[0] == len(t)
    assert f"{len(t)} symbols" in caplog.text and "samples, " in caplog.text
    with pytest.raises(SystemExit):
        options().parse_args(["--version"])
    # options in a file, those of the command line first
    (tmp_path / "ini").write_text("w1 = 7\nbwt-only = true\nl1-prefix = some/prefix\n")
    a = parsed(["out", "--configure", str(tmp_path / "ini"), "--w2", "3"])
    assert (a.place, a.w1, a.w2, a.bwt_only, a.l1_prefix) == (["out"], 7, 3, True, "some/prefix")
    assert parsed(["out", "--configure", str(tmp_path / "ini"), "--w1", "5"]).w1 == 5
    for bad in (["a", "b"], ["out", "--fasta", "x", "--l1-prefix", "y"], ["out", "--fasta", "x", "--tmp-dir", str(tmp_path / "none")]):
        with pytest.raises(SystemExit):
            parsed(bad)


def test_cluster_needs_a_shared_folder(spark):
    from loomtext.sources import scratch

    class Conf:
        def get(self, key, default=None):
            return default

    def session(master):
        return type("Session", (), {"conf": Conf(), "sparkContext": type("Context", (), {"master": master})})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.work_dir(session("spark://host:7077"))
    assert scratch.work_dir(session("local[4]")).startswith("file:")
