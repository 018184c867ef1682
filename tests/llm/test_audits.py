"""Suffix levels, filter audit and source divergence, against brute force and SQL."""

import hashlib
import itertools
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.llm import divergence, filteraudit, suffixlevels
from loomtext.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


def by_sql(sql, **tables):
    c = duckdb.connect()
    for name, (columns, rows) in tables.items():
        c.execute(f"CREATE TABLE {name} ({columns})")
        if rows:
            c.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    r = c.execute(sql)
    return [x[0] for x in r.description], r.fetchall()


def same(df, names, rows):
    key = lambda r: tuple(map(str, r))
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=key) == sorted(rows, key=key)


@pytest.mark.parametrize("name", ["op11_suffix_levels", "op12_filter_audit", "op13_source_divergence"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    r = c.execute(SQL[name])
    same(QUERIES[name](spark, SF), [x[0] for x in r.description], r.fetchall())


# Suffix levels.


def brute(rows, length=50):
    """Bytes that a document of a smaller id has, by a dictionary of strings."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1) if i is not None else ():
            s = b[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1) if i is not None else ():
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def corpus(seed):
    r = random.Random(seed)
    say = lambda n, of="abcdé ": "".join(r.choice(of) for _ in range(n))
    line, passage, copy = "All rights reserved; this notice may not be removed by anyone.\n", say(300), say(400)
    rows = [(1, copy), (2, copy), (2, say(90)), (3, copy[:200] + "X" + copy[201:]), (7, None), (8, ""), (9, "a" * 500), (10, "a" * 49), (11, "a" * 50), (12, "ab" * 200), (13, "ab" * 25), (None, copy), (None, say(60))]
    rows += [(20 + i, say(r.randint(0, 120)) + line + say(r.randint(0, 120))) for i in range(60)]
    rows += [(100 + i, say(40) + passage[r.randint(0, 60) : 300 - r.randint(0, 60)] + say(40)) for i in range(12)]
    rows += [(130, passage[:49]), (131, passage[10:60]), (132, say(20) + passage[250:] + copy[:70]), (5, passage), (133, say(30_000)), (133, say(30_000))]
    whole = [(134, rows[-1][1][5_000:5_200] + rows[-2][1][20_000:20_100])]
    r.shuffle(rows)
    return rows + whole + rows[:2]


@pytest.mark.parametrize("batches,hot,piece", [(1, 10**9, 1 << 20), (5, 20, 1000), (7, 10**9, 77)])
def test_suffix_levels_against_brute_force(spark, batches, hot, piece):
    rows = corpus(batches)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("ver", F.lit("clash"))
    docs = suffixlevels.with_rows(df)
    got = suffixlevels.remaining(docs, suffixlevels.repeats(docs, batches, hot, 50, piece)).collect()
    key = lambda x: (str(x[0]), x[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=key) == sorted(brute(rows), key=key)


def test_levels_merge_geometrically(spark):
    family = suffixlevels.Levels()
    r = random.Random(4)
    passage = "".join(r.choice("abc") for _ in range(80))
    for i in range(7):
        docs = suffixlevels.with_rows(spark.createDataFrame([(i, "".join(r.choice("xyz") for _ in range(99)) + chr(65 + i) + passage)], "doc_id long, text string"))
        # without knowledge of what comes, all anchors are kept
        found = family.add(suffixlevels.kept(suffixlevels.suffixes(docs, suffixlevels.each_place(suffixlevels.anchors(docs))), "batch")).collect()
        ranges = suffixlevels.merged(*(np.array([f[c] for f in found]) for c in ("start", "stop"))) if found else ([], [])
        assert [(int(a), int(b)) for a, b in zip(*ranges)] == ([(100, 180)] if i else [])
        assert [size for size, *_ in family.levels] == [1 << k for k in range(3, -1, -1) if (i + 1) >> k & 1]
    whole, path = family.levels[0][1:]
    assert whole.count() == whole.distinct().count()
    family.close()
    assert not os.path.exists(path.removeprefix("file://"))


def test_equal_hashes_are_told_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffixlevels, "gram_hashes", lambda raw, width: np.zeros(max(0, len(raw) - width + 1), np.uint64))
    texts = [b"a" * 30 + b"b" * 25, b"c" * 52, b"b" * 3 + b"c" * 51]
    group = pa.record_batch({"key": pa.array([5] * 3), "span": pa.array(texts, pa.binary()), "doc_id": pa.array([1, 2, 3]), "ver": pa.array([0] * 3), "start": pa.array([10] * 3)})
    assert suffixlevels._compare(group).to_pylist() == [{"doc_id": 3, "ver": 0, "start": 13, "stop": 64}]


def test_suffix_levels_empty_table(spark):
    docs = suffixlevels.with_rows(spark.createDataFrame([], "doc_id long, text string"))
    assert suffixlevels.remaining(docs, suffixlevels.repeats(docs)).count() == 0


# Filter audit.


def test_swaps_visit_every_order():
    for n in range(1, 6):
        order, seen = list(range(n)), [tuple(range(n))]
        for k in filteraudit.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


LABELS = "doc_id long, quality int, toxic int"


def test_filter_audit_against_brute_force(spark):
    r = random.Random(3)
    texts = ["", None, "word " * 250, " ".join(f"w{i}" for i in range(230)), "ABC DEF # x", "plain\x0bwords\x1fhere", "Été " * 300, " ".join(f"W{i}$" for i in range(210)), "\t\n"]
    docs = [(r.choice([None, *range(25)]), r.choice(texts), r.choice(["en", "fr", None, ""])) for _ in range(150)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in [None, *range(0, 25, 2), 4, 4]]
    fails = []
    low = {}
    for i, t, _ in docs:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    for i, t, part in docs:
        t = t or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and low[t] < i}
        of = [x for x in labels if x[0] is not None and x[0] == i]
        fails.append((part or "", "".join(k for k, v in f.items() if v), any(x[1] == 1 for x in of), any(x[2] == 1 for x in of)))
    want, shapley = {}, {}
    for part in {f[0] for f in fails}:
        here = [f for f in fails if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = here
            for s, x in enumerate(order, 1):
                gone, failing = [f for f in left if x in f[1]], [f for f in here if x in f[1]]
                left = [f for f in left if x not in f[1]]
                want[part, order, s] = [len(left), len(gone), len(failing) - len(gone), sum(f[1] == x for f in here), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("mask", F.lit("clash")).withColumn("n", F.lit(-1))
    got = filteraudit.audit(filteraudit.cells(df, spark.createDataFrame(labels, LABELS), "lang")).collect()
    assert {(g.part, g.filter_order, g.step): list(g[3:]) for g in got} == {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in want.items()}
    empty = filteraudit.cells(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], LABELS), "lang")
    assert filteraudit.audit(empty).count() == 0


# Source divergence.
def test_terms_of_whole_arrays():
    texts = ["Ab1cD d-ab", "", None, "x", "x y", "99 _", "É\x85éÀa\u3000b\x7f\x1cZ", "tail", "tail"]
    array = pa.array(["skipped", *[t or "" for t in texts]]).slice(1)
    found, text = divergence.terms(array)
    want = [(k, re.sub("[A-Z]", lambda m: m[0].lower(), t)) for k, x in enumerate(texts) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", x or "")]
    assert list(zip(text.tolist(), [t.decode() for t in found.to_pylist()])) == want
    assert [len(x) for x in divergence.terms(pa.array([], pa.string()))] == [0, 0] == [len(x) for x in divergence.terms(pa.array(["", "1"]))]




def test_divergence_small_cases(spark):
    words = ["Tree", "tree", "été", "Été", "straße", "x-y", "ÀB", "1a2b"]
    r = random.Random(5)
    rows = [(i % 7 or None, " ".join(r.choice(words) for _ in range(r.randint(0, 12))), r.choice(["en", None, ""]), r.choice(["a", "b", "ü", None])) for i in range(120)]
    rows += [(1, "only few words", "de", "a"), (2, None, "de", "b"), (3, "", "it", None), (4, "12 34", "it", None)]
    names, want = by_sql(SQL["op13_source_divergence"], documents=("doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR", rows))
    df = spark.createDataFrame(rows, DOCS).withColumn("term", F.lit("clash")).withColumn("p", F.lit(0.5))
    same(divergence.divergence(df), names, want)
    assert {(w[0], w[4]) for w in want if w[names.index("part")] == "pair" and w[0] == "de"} == {("de", 0)}
    assert divergence.divergence(df.limit(0)).count() == 0


def test_shares_are_exact(spark):
    cases = [(0, 0, 1), (5, 17, 3), (10**13, 10**14, 10**6), (123_456_789_012, 123_456_789_013, 999_999), (2 * 10**14, 2 * 10**14, 5)]
    df = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 2) // (r.n + 2 * r.v) for r in df.collect())


def test_digest_of_what_is_left(spark):
    row = suffixlevels.query(spark, SF).where("n_removed = 0").first()
    text = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") == row.doc_id).first().text or ""
    assert row.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
