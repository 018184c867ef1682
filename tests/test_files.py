"""Given dictionaries, flat files, chunks, lookups and intervals."""

import glob
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions.symbols import separator
from loomtext.index import TextIndex
from loomtext.operators import runs, samples
from loomtext.sources import flat, given
from loomtext.sources.corpus import read_runs, read_ssa, write_runs, write_ssa

# A collection of short sequences with one mark for separators and
# terminators, what triggers its parse, its transform, and first samples.
SEQUENCES = [
    "ACGTTCGCAACTAGTCCGGGAGTTAC", "ACGTTCGGAATAGTTCCGGGAGGTTAAC", "AACTTCGTCACCTAGTCCGGGAGGTAAC", "AACTTCGCACCTAGTCCGGGACGTTTAC",
    "ACGTTCGTCACTAGTTCCGGGAGTTAC", "AACTTCGGAATAGTCCGGGACTAAC", "ACGTTCGTGACTAGTTCCGGGACTAAC", "ACCTTCGCACCTAGTCCGGGAGTTAC",
]
TEXT = "#".join(SEQUENCES) + "##"
TRIGGERS = {"##", "AC", "CG", "GT"}
TRIGGERS2 = {("ACG", "CGT"), ("AC#AAC", "ACTTCG")}
TRANSFORM = (
    "CCCCC#CCCTTTTC###GGTATAATTACCC#####GGGAGCAAAGGTTTTTGGGTTTAAAAAAAAAAGGTGTTTTTTTTTAAA"
    "ATTTTTCCCCCCCCTTTAAAAAAACCCAAAACAAGGGGGTGGGGGCCCCCGGGGGGGGCCCCCCCCAAGCCAAAAACGAAAAA"
    "ACCCCCGTCCTTTTCACCCCACGGGTGGTGTGTTTTTTTTGGGGGTGGGGCCCGCGGG"
)
SAMPLES = [222, 223, 26, 81, 8, 85, 150, 220]


def cut(seq, trigger, w=2):
    ends = [i for i in range(len(seq) - w + 1) if trigger(seq[i : i + w])]
    return [seq[a : b + w] for a, b in zip(ends, ends[1:])]


def small_tables():
    """Dictionaries and parses of the fixed collection, by the fixed triggers."""
    phrases = cut("##" + TEXT, lambda x: x in TRIGGERS)
    d1 = sorted(set(phrases))
    ids = [0, 0, *(d1.index(p) + 1 for p in phrases), 0, 0]
    pairs = {tuple(d1.index(p) + 1 for p in pair) for pair in TRIGGERS2} | {(0, 0)}
    phrases2 = [tuple(p) for p in cut(ids, lambda x: tuple(x) in pairs)]
    d2 = sorted(set(phrases2))
    return d1, d2, [d2.index(p) + 1 for p in phrases2]


def test_given_files_of_the_small_collection(spark, tmp_path):
    d1, d2, p2 = small_tables()
    assert (len(TEXT), len(d1), len(d2), len(p2)) == (224, 26, 9, 9)
    prefix = str(tmp_path / "small")
    (tmp_path / "small.dict").write_bytes(b"".join(p.encode() + b"\x01" for p in d1) + b"\x00")
    words = [[t + given.SHIFT if t else given.DOLLAR for t in p] + [flat.END_OF_WORD] for p in d2]
    numbers = [t for p in words for t in p] + [flat.END_OF_DICT]
    (tmp_path / "small.parse.dict").write_bytes(struct.pack(f"<{len(numbers)}I", *numbers))
    (tmp_path / "small.parse.parse").write_bytes(struct.pack(f"<{len(p2) + 1}I", *p2, 0))
    x = TextIndex.of_files(spark, prefix, 2, 2)
    assert x.n == 224
    assert "".join(r.ch for r in x.bwt().orderBy("pos").collect()) == TRANSFORM
    array = sorted(range(224), key=lambda i: TEXT[i:] + TEXT[:i])
    assert [r.sa for r in x.suffix_array.orderBy("pos").collect()] == array
    heads = [i for i in range(224) if i == 0 or TRANSFORM[i] != TRANSFORM[i - 1]]
    found = [r.sa for r in x.ssa.orderBy("run_id").collect()]
    assert found == [array[i] for i in heads] and found[:8] == SAMPLES and len(found) == 76
    kinds = {r.kind: (r.n, r.s) for r in x.groups.groupBy("kind").agg(F.count("*").alias("n"), F.sum("cnt").alias("s")).collect()}
    assert kinds == {"easy": (33, 83), "hard": (15, 141)}
    # written again in parts, and read in small ranges
    again = str(tmp_path / "again")
    given.write_tables(x.dict1, x.dict2, x.parse2, again)
    for name in ("dict", "parse.dict"):
        whole = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{again}.{name}/part-*")))
        assert whole == (tmp_path / f"small.{name}").read_bytes()
    got = [t.collect() for t in given.read_tables(spark, again, range_bytes=8)]
    assert sorted((r.pid, r.phrase) for r in got[0]) == list(enumerate(d1, 1))
    assert sorted((r.pid2, tuple(r.toks)) for r in got[1]) == list(enumerate(d2, 1))
    assert [r.pid2 for r in sorted(got[2])] == p2


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_words_in_ranges(tmp_path, size):
    words = [b"ab", b"", b"c" * 90, b"\xff\x02", b"d"]
    (tmp_path / "w").write_bytes(b"".join(w + b"\x01" for w in words) + b"\x00")
    reader = flat.WordsReader({"path": str(tmp_path / "w"), "rangebytes": str(size)})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    starts = [sum(len(w) + 1 for w in words[:i]) for i in range(len(words))]
    assert [(r["at"], r["word"]) for r in rows] == [(s, w.decode("latin-1")) for s, w in zip(starts, words)]
    (tmp_path / "n").write_bytes(struct.pack("<9I", 70_000, 3, 1, 1, 4_000_000_000, 2, 2, 1, 0))
    reader = flat.WordsReader({"path": str(tmp_path / "n"), "width": "4", "rangebytes": str(size)})
    assert [r["word"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == [[70_000, 3], [], [4_000_000_000, 2, 2]]


def test_flat_samples_and_runs(spark, tmp_path):
    """The bytes of a loop over the rows, in parts, read in ranges."""
    values = random.Random(2).sample(range(10**12), 1000)
    ssa = spark.createDataFrame(list(enumerate(values)), "run_id long, sa long").repartition(7)
    flat.write_records(ssa.select(F.col("run_id").alias("i"), "sa"), "sa:q", str(tmp_path / "s"), struct.pack("<Q", 1000), part=64)
    parts = sorted(glob.glob(str(tmp_path / "s" / "part-*")))
    whole = b"".join(open(f, "rb").read() for f in parts)
    assert len(parts) == 17 and whole == struct.pack("<Q1000q", 1000, *values)
    (tmp_path / "one").write_bytes(whole)
    for path in ("s", "one"):
        df = read_ssa(spark, str(tmp_path / path), range_bytes=100)
        assert df.rdd.getNumPartitions() == 84
        assert [(r.run_id, r.sa) for r in df.orderBy("run_id").collect()] == list(enumerate(values))
    runs_ = spark.createDataFrame([(0, "a", 0, 5), (1, "é", 5, 1), (2, "\U0001f600", 6, 10**10)], "run_id long, ch string, start long, len long")
    assert write_runs(runs_, str(tmp_path / "r")) == 36
    assert sorted(map(tuple, read_runs(spark, str(tmp_path / "r")).collect())) == sorted(map(tuple, runs_.collect()))
    with pytest.raises(FileExistsError):
        write_ssa(ssa, str(tmp_path / "s"))
    empty = ssa.limit(0)
    assert write_ssa(empty, str(tmp_path / "e")) == 8 and read_ssa(spark, str(tmp_path / "e")).count() == 0
    (tmp_path / "torn").write_bytes(whole[:-3])
    with pytest.raises(Exception, match="whole records"):
        read_ssa(spark, str(tmp_path / "torn")).count()


def test_unsorted_dictionary_is_refused(spark, tmp_path):
    (tmp_path / "x.dict").write_bytes(b"##b\x01##a\x01\x00")
    with pytest.raises(ValueError, match="sorted"):
        given.read_tables(spark, str(tmp_path / "x"))


def test_chunks_lookups_and_intervals(spark):
    r = random.Random(11)
    texts = ["".join(r.choice("abé") for _ in range(r.randint(0, 40))) for _ in range(6)] * 2 + ["abab" * 6]
    x = TextIndex.of_strings(spark, texts, 2, 3, 1, 2)
    t = "".join(y + separator(2) for y in texts) + "\x02" * 2
    array = sorted(range(len(t)), key=lambda i: t[i:] + t[:i])
    # every chunk apart, merged in both groupings
    plan = x.chunk_plan(3).orderBy("chunk").collect()
    parts = [x.chunk_runs(c.row_start, c.row_end) for c in plan]
    want = sorted((y.start, y.ch, y.len) for y in x.rlbwt.collect())
    left = runs.merged(runs.merged(parts[0].unionByName(parts[1])).unionByName(parts[2]))
    right = runs.merged(parts[0].unionByName(runs.merged(parts[1].unionByName(parts[2]))))
    for got in (left, right):
        assert sorted((y.start, y.ch, y.len) for y in got.collect()) == want
    last = x.chunk_suffix_array(plan[-1].row_start, plan[-1].row_end)
    assert sorted((y.pos, y.sa) for y in last.collect()) == list(enumerate(array))[plan[-1].l_left :]
    # the chunk's scans are given its range
    assert "PushedFilters: [IsNotNull(grp), GreaterThanOrEqual(grp" in last._jdf.queryExecution().executedPlan().toString() or x._within(plan[-1].row_start, plan[-1].row_end)[1].count() < x.suffix1.count()
    # single positions
    asked = r.sample(range(len(t)), 25) + [0, len(t) - 1]
    got = x.lookup(spark.createDataFrame([(p,) for p in [*asked, asked[0]]], "pos long")).collect()
    assert sorted((y.pos, y.sa) for y in got) == sorted({(p, array[p]) for p in asked})
    # what samples skip: the levels tile the text, and the rows left are those that hold a head
    levels = {y.level: y.n_symbols for y in samples.skipped(x.groups, x.rlbwt, x.suffix1, x.m_table, x.expansion, span=8).collect()}
    assert sum(levels.values()) == len(t) and levels["row"] > 0
    # both ways of the third tier
    one = sorted((y.start, y.ch) for y in x.pieces("hard_hard").collect())
    assert one and one == sorted((y.start, y.ch) for y in x.hard_hard_by_interval().collect())
    held = {y.row2: (y.left, y.right) for y in x.m_intervals.collect()}
    sizes = {y.row2: y.n for y in x.m_table.groupBy("row2").agg(F.count("*").alias("n")).collect()}
    assert {k: b - a + 1 for k, (a, b) in held.items()} == sizes


@pytest.mark.parametrize("width", [1, 4])
def test_words_are_read_in_steps(monkeypatch, tmp_path, width):
    rng, sizes = random.Random(width), []
    whole = flat._Bytes.read
    monkeypatch.setattr(flat._Bytes, "read", lambda self, a, b: sizes.append(b - a) or whole(self, a, b))
    for trial in range(30):
        words = [[rng.randint(2, 255) for _ in range(rng.choice([0, 1, 3, 5, 40]))] for _ in range(rng.randint(0, 60))]
        symbols = [x for w in words for x in [*w, flat.END_OF_WORD]] + [flat.END_OF_DICT]
        path = tmp_path / f"w{trial}"
        path.write_bytes(np.array(symbols, "u1" if width == 1 else "<u4").tobytes())
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])[:-1] * width
        want = [(int(a), "".join(map(chr, w)) if width == 1 else w) for a, w in zip(starts, words)]
        for step in (4, 12, 64, 1 << 20):
            for size in (4, 20, 100, 1 << 20):
                monkeypatch.setattr(flat, "STEP", step)
                sizes.clear()
                reader = flat.WordsReader({"path": str(path), "width": str(width), "rangebytes": str(size)})
                got = [(r["at"], r["word"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
                assert got == want
                assert max(sizes) <= step
