"""Near duplicates, passages, embeddings, decontamination, WARC, components."""

import itertools
import pathlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.llm import decontaminate, metricjoin, neardup, substrings, warc
from loomtext.llm._shared import by_groups, components

DOCS = "doc_id long, text string, key string, rep int, links long, shingles string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, None, 7) for i, t in rows], DOCS)


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def changed(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = "X" + str(rng.randrange(10**6))
    return ws


def classes_by_hand(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


# components ------------------------------------------------------------------
def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(30)] + [(200, 200 + k) for k in range(1, 40)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    want = classes_by_hand(edges, {x for e in edges for x in e})
    assert got == {x: r for x, r in want.items() if x in got} and set(got) >= {x for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_by_groups_gives_whole_groups(spark):
    df = spark.range(20_000).select((F.col("id") % 37).alias("g"), "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = by_groups(df, ["g"], lambda t: pa.table({"g": t.column("g")[:1], "n": [t.num_rows]}), "g long, n long").collect()
    assert sorted(map(tuple, got)) == sorted((g, len(range(g, 20_000, 37))) for g in range(37))


# near duplicates ---------------------------------------------------------------
def near_by_hand(rows):
    value, starts = neardup.sets_of(pa.array([t for _, t in rows], pa.string()))
    sets = [set(value[a:b].tolist()) for a, b in zip(starts, starts[1:])]
    links, n = [], [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links.append((a, b))
            n[a] += 1
            n[b] += 1
    return sets, links, n


def check_near(spark, rows):
    frame = docs(spark, rows)
    got = {r.doc_id: r for r in neardup.classes(frame).collect()}
    sets, links, n = near_by_hand(rows)
    ids = [i for i, _ in rows]
    assert len(got) == len(rows)
    assert {i: got[i].class_id for i in ids} == classes_by_hand([(ids[a], ids[b]) for a, b in links], ids)
    # what is listed are links, and the numbers follow from the list
    by_id = dict(zip(ids, sets))
    listed = {tuple(r) for r in neardup.pairs(frame).collect()}
    assert len(listed) == len({frozenset(x) for x in listed}) and listed <= {x for a, b in links for x in ((ids[a], ids[b]), (ids[b], ids[a]))}
    copies = {}
    for i in ids:
        copies[frozenset(by_id[i]) or i] = copies.get(frozenset(by_id[i]) or i, 0) + 1
    count = {frozenset(by_id[i]) or i: copies[frozenset(by_id[i]) or i] - 1 for i in ids}
    for a, b in listed:
        count[frozenset(by_id[a])] += copies[frozenset(by_id[b])]
        count[frozenset(by_id[b])] += copies[frozenset(by_id[a])]
    assert {i: got[i].n_links for i in ids} == {i: count[frozenset(by_id[i]) or i] for i in ids}
    assert all(got[i].n_links <= k for i, k in zip(ids, n))
    return got, n


@pytest.mark.parametrize("small,tile", [(1000, 800), (4, 3)])
def test_near_duplicates(spark, monkeypatch, small, tile):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "TILE_SETS", tile)
    rng = random.Random(5)
    rows = [(k, " ".join(words(rng, rng.randint(1, 120)))) for k in range(60)]
    base = words(rng, 150)
    rows += [(100 + k, " ".join(changed(rng, base, rng.randint(0, 5)))) for k in range(40)]
    rows += [(200 + k, " ".join(base)) for k in range(6)] + [(300, "one two"), (301, "ONE, two!"), (302, "one"), (303, "one two three"), (304, None), (305, ""), (306, "--"), (307, "z " * 60_000)]
    chain = words(rng, 120)  # each like its neighbours only
    for k in range(12):
        rows.append((400 + k, " ".join(chain)))
        chain = [*chain[5:], *words(rng, 5)]
    got, n = check_near(spark, rows)
    assert got[205].n_links >= 5 and got[300].n_links == 1 and got[411].class_id == 400


def test_near_copies_cost_rows_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 100)
    monkeypatch.setattr(neardup, "TILE_SETS", 30)
    sizes = {}
    for many in (1000, 2000, 4000):
        rng = random.Random(many)
        base = words(rng, 80)
        rows = [(k, " ".join(changed(rng, base, 1))) for k in range(many)] + [(10_000 + k, " ".join(words(rng, 60))) for k in range(50)]
        rows += [(20_000 + k, " ".join([*base[:40], *words(rng, 40)])) for k in range(50)]  # in the group's buckets, but apart
        docs_ = neardup._narrowed(docs(spark, rows))
        neardup.small_batches(spark)
        sketched = neardup._sketched(docs_)
        reps = neardup.stored(sketched.where("key is not null").select(F.col("doc_id").alias("rep"), "doc_id", "key", "n", "sketch"), "reps")
        leaves = neardup.stored(neardup.buckets(reps), "leaves")
        links, roots = neardup.connected(leaves, reps, docs_)
        sizes[many] = leaves.count(), links.count(), neardup.tiles(leaves, roots).count()
    for a, b in ((1000, 2000), (2000, 4000)):
        assert sizes[b][0] <= 2.6 * sizes[a][0], sizes  # rows of buckets
    for leaves, links, tiles in sizes.values():  # what is listed and the tiles' rows follow these
        assert links <= leaves and tiles <= (2 + neardup.CROWDED) * leaves, sizes


def joined_rows(spark, run, name):
    """Rows that the joins by ``name`` make while ``run`` works."""
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():  # the store keeps the last 1,000
        found = store.executionsList()
        return {found.apply(k).executionId() for k in range(found.size())}

    before = max(executions(), default=-1)
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    total = 0
    for at in (x for x in executions() if x > before):
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and f"[{name}#" in node.desc():
                metrics = node.metrics()
                ids = [metrics.apply(i).accumulatorId() for i in range(metrics.size()) if metrics.apply(i).name() == "number of output rows"]
                total += sum(int(values.apply(i).replace(",", "")) for i in ids if values.contains(i))
    return total


def test_joins_by_set_grow_with_the_sets(spark, monkeypatch):
    # copies too far apart to link, but likely by their sketches, in buckets of many tiles
    monkeypatch.setattr(neardup, "TILE_SETS", 12)
    monkeypatch.setattr(neardup, "CROWDED", 1000)
    rng, got = random.Random(9), {}
    base = words(rng, 120)
    for many in (60, 240):
        df = docs(spark, [(k, " ".join(changed(rng, base, 2)), ) for k in range(many)])
        got[many] = joined_rows(spark, lambda: neardup.classes(df).collect(), "rep")
    assert 0 < got[240] < 6 * got[60], got


def test_sets_of_a_bucket_are_joined_once(spark):
    # a connected group and as many sets that stand alone, in 20 buckets
    leaves = neardup.stored(spark.range(20 * 400).selectExpr("id % 20 as leaf", "id div 20 as rep", "cast(80 as bigint) as n"), "leaves")
    roots = neardup.stored(spark.range(200).selectExpr("id as rep", "cast(0 as bigint) as whole"), "roots")
    placed = []
    made = joined_rows(spark, lambda: placed.append(neardup._placed(leaves, roots).count()), "leaf")
    # once with the first of its bucket, once each with its group and its bucket's parts; and the groups
    assert placed == [20 * 399] and made <= 3.6 * 20 * 400, made


def test_recall_of_the_whole_join(spark):
    rng = random.Random(11)
    rows, near = [], []
    for k in range(400):  # pairs a little above the threshold
        ws = words(rng, 300)
        other = list(ws)
        at = rng.randrange(0, 270)
        other[at : at + 25] = words(rng, 25)
        rows += [(2 * k, " ".join(ws)), (2 * k + 1, " ".join(other))]
    sets, links, _ = near_by_hand(rows)
    near = [(rows[a][0], rows[b][0]) for a, b in links]
    likeness = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in links]
    assert len(near) >= 380 and max(likeness) < 0.85
    got = {r.doc_id: r.class_id for r in neardup.classes(docs(spark, rows)).collect()}
    assert sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near)


def test_near_duplicates_odd(spark):
    assert neardup.classes(docs(spark, [])).count() == 0 and neardup.pairs(docs(spark, [])).count() == 0
    assert neardup.stage(spark, docs(spark, []), SF).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q r s t u v"), (None, None), (3, None), (3, "")]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in neardup.classes(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (None, None, 0), (2, 2, 0), (None, None, 0), (3, 3, 0), (3, 3, 0)], key=str)
    out = neardup.stage(spark, docs(spark, rows), SF)
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([1, 2, None, None, 3, 3], key=str) and out.columns == docs(spark, []).columns


def test_rows_of_one_id_stand_for_themselves(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b), (4, c), (4, c + " tail")]
    frame = docs(spark, rows)
    got = sorted((r.doc_id, r.class_id) for r in neardup.classes(frame).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (2, 2), (3, 2), (4, 4), (4, 4)]
    left = sorted((r.doc_id, r.text) for r in neardup.stage(spark, frame, SF).collect())
    assert left[:2] == [(1, a), (2, b)] and len(left) == 3 and left[2][0] == 4


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(70)]
    got = neardup.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(70) for j in range(70) if i != j)


def test_recall_target():
    rng = np.random.default_rng(2)
    both = 0
    for _ in range(200):  # pairs at the threshold, sketched alike
        whole = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 500).astype(np.uint64)
        a, b = np.sort(whole[:450]), np.sort(whole[50:])
        s = neardup.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        nodes = [set(), set()]
        for k in range(neardup.runs()):
            row, child = neardup._children(neardup.mix(np.full(2, k + 1, np.uint64)), s)
            for i in range(2):
                nodes[i] |= set(child[row == i].tolist())
        both += bool(nodes[0] & nodes[1])
    assert both >= 0.98 * 200


# passages ------------------------------------------------------------------------
def test_compact_windows_by_hand():
    rng = np.random.default_rng(0)
    v, st = rng.integers(0, 30, 300).astype(np.uint64), np.array([0, 100, 100, 300])
    got = list(zip(*(x.tolist() for x in substrings.compact_windows(v, st, 1, 5))))
    h = {c: x for x, _, c, _ in got}
    full = dict(zip(range(300), substrings.mix(v ^ np.uint64(0x9E3779B97F4A7C15 * 2 % (1 << 64))).tolist()))
    want = []
    for d in range(3):
        for i in range(st[d], st[d + 1]):
            a = b = i
            while a > st[d] and full[a - 1] > full[i]:
                a -= 1
            while b + 1 < st[d + 1] and full[b + 1] >= full[i]:
                b += 1
            if b - a + 1 >= 5:
                want.append((a, i, b))
    assert [x[1:] for x in got] == want and all(h[c] == full[c] for c in h)
    same = substrings.compact_windows(np.full(200, 7, np.uint64), np.array([0, 200]), 0, 46)
    assert same[1].tolist() == same[2].tolist() == list(range(155))  # of equal minima the leftmost counts


def test_passages(spark):
    rng = random.Random(8)
    shared, near = words(rng, 60), words(rng, 90)
    rows = []
    for k in range(30):
        body = words(rng, 120)
        if k % 3 == 0:
            body[40:40] = shared
        if k in (4, 5):
            body[10:10] = near if k == 4 else changed(rng, near, 1)
        rows.append((k, " ".join(body)))
    rows += [(50, None), (51, ""), (52, "a b"), (None, " ".join(shared)), (53, "w " * 50_000)]
    got = {}
    for r in substrings.passages(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.end_word, r.source_id))
    assert set(got) == {3, 6, 9, 12, 15, 18, 21, 24, 27, 5}
    for k, spans in got.items():
        (a, b, source), at, n = spans[0], 40 if k != 5 else 10, 60 if k != 5 else 90
        assert len(spans) == 1 and source == (0 if k != 5 else 4) and abs(a - at) <= 4 and abs(b - at - n) <= 4
    # clean documents, the first of a passage and the others' other words stay
    out = {r.doc_id: r for r in substrings.stage(spark, docs(spark, [r for r in rows if r[0] is not None]), SF).collect()}
    assert set(out) == {i for i, _ in rows if i is not None}
    assert out[0].text == rows[0][1] and out[1].text == rows[1][1] and out[1].n_chars == 7
    assert out[3].text.split()[:40] == rows[3][1].split()[:40] and len(out[3].text.split()) <= 124 and out[3].n_chars == len(out[3].text)


def test_passages_behind_other_firsts(spark):
    rng = random.Random(3)
    passage, line, chain = words(rng, 60), words(rng, 12), words(rng, 60)
    lined = [*words(rng, 24), *line, *words(rng, 24)]

    def every(ws, step):
        at = rng.randrange(step)
        return [w if k % step != at else "X" + str(rng.randrange(10**6)) for k, w in enumerate(ws)]

    def other(ws, at):
        return [w if k != at else "Y" + str(rng.randrange(10**6)) for k, w in enumerate(ws)]

    rows = []
    for k in range(90):  # earlier variants of two passages, each unlike them and each other
        rows.append((k, [*words(rng, 50), *every(passage, 10 + k % 9), *words(rng, 50)]))
        rows.append((100 + k, [*words(rng, 50), *line, *words(rng, 50), *every(lined, 10 + k % 9), *words(rng, 9)]))
    rows += [(200 + k, [*words(rng, 30 + k), *passage, *words(rng, 40)]) for k in range(3)]
    rows += [(300 + k, [*line, *words(rng, 60 + k), *lined, *words(rng, 40), *line, *words(rng, 50)]) for k in range(3)]
    # the third is like the second, but not like the first
    near = other(chain, 30)
    rows += [(400, [*words(rng, 50), *chain, *words(rng, 50)]), (401, [*words(rng, 50), *near, *words(rng, 50)]), (402, [*words(rng, 50), *other(near, 20), *words(rng, 50)])]
    got = {r.doc_id: r for r in substrings.passages(docs(spark, [(i, " ".join(ws)) for i, ws in rows])).collect()}
    assert set(got) == {201, 202, 301, 302, 401, 402}
    for k in (1, 2):
        assert got[200 + k].source_id == 200 and abs(got[200 + k].start_word - 30 - k) <= 4 and abs(got[200 + k].end_word - 90 - k) <= 4
        assert got[300 + k].source_id == 300 and abs(got[300 + k].start_word - 72 - k) <= 4 and abs(got[300 + k].end_word - 132 - k) <= 4
    assert got[401].source_id == 400 and got[402].end_word - got[402].start_word >= 50


def places_by_hand(rows):
    """Of each row the words that near-duplicate stretches of rows of smaller ids cover."""
    n, need = substrings.LEAST, substrings.NEEDED
    value, starts = substrings._sequence(pa.array([t for _, t in rows], pa.string()))
    value = [value[a:b].tolist() for a, b in zip(starts, starts[1:])]
    out = {}
    for k, (doc, _) in enumerate(rows):
        hit = set()
        for j, (source, _) in enumerate(rows):
            if source >= doc or len(set(value[k]) & set(value[j])) < need // 2:
                continue
            mine = [value[k][i : i + n] for i in range(len(value[k]) - n + 1)]
            theirs = [value[j][i : i + n] for i in range(len(value[j]) - n + 1)]
            sets = [set(x) for x in theirs]
            for i, x in enumerate(mine):
                own = set(x)
                for y, other in zip(theirs, sets):
                    at = [p for p, v in enumerate(x) if v in other]
                    if len(at) >= need and sum(v in own for v in y) >= need:
                        hit |= set(range(i + at[0], i + at[-1] + 1))
        out[k] = {w for p in hit for w in range(p, p + substrings.WIDTH)}
    return out


def test_passages_leave_no_windows_behind(spark):
    from loomtext.sources.scratch import work_dir

    there = lambda: {p.name for p in pathlib.Path(work_dir(spark).removeprefix("file://")).iterdir()}
    before = there()
    text = " ".join(words(random.Random(5), 90))
    assert substrings.passages(docs(spark, [(1, text), (2, text)])).count() == 1
    new = {x.rsplit("-", 5)[0] for x in there() - before}
    assert "seen" in new and not new & {"windows", "first", "pairs"}, new


def test_passages_by_hand(spark):
    rng = random.Random(21)
    sources = [words(rng, 70) for _ in range(6)]
    rows = []
    for k in range(36):
        body = words(rng, rng.randint(20, 60))
        for _ in range(rng.randint(0, 2)):
            p = list(rng.choice(sources))
            kind = rng.randrange(6)
            if kind == 1:
                p = changed(rng, p, 1)
            elif kind == 2:  # words put in and taken out
                p[30:30] = words(rng, 2)
            elif kind == 3:
                del p[25:27]
            elif kind == 4:  # halves exchanged
                p = p[35:] + p[:35]
            elif kind == 5:
                p = p[10:]
            body += [*p, *words(rng, rng.randint(5, 30))]
        rows.append((k, " ".join(body)))
    want = places_by_hand(rows)
    got = {k: set() for k, _ in rows}
    for r in substrings.passages(docs(spark, rows)).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert all(got[k] <= want[k] for k in got)
    assert sum(map(len, want.values())) > 1000 and sum(map(len, got.values())) >= 0.99 * sum(map(len, want.values()))


def test_parts_of_a_passage_are_no_passage(spark):
    """34 words of one end and 34 of another, 300 words away, don't make a stretch."""
    rng = random.Random(2)
    source = words(rng, 400)
    rows = [(0, " ".join(source))]
    for k in range(1, 60):
        ws = words(rng, 30)
        at = rng.randrange(0, 20)
        rows.append((k, " ".join([*ws, *source[at : at + 34], *source[at + 334 : at + 368], *words(rng, 30)])))
    want = places_by_hand([rows[0]] + rows[1:2])[1]
    found = [r for r in substrings.passages(docs(spark, rows)).collect() if r.source_id == 0]
    assert not want and not found


def test_spans_belong_to_their_row(spark):
    rng = random.Random(6)
    one, long, clean = words(rng, 120), words(rng, 100), words(rng, 90)
    rows = [(1, " ".join(one)), (2, " ".join([*long, *one[10:70]])), (2, " ".join(clean)), (3, " ".join([*clean[5:80], *words(rng, 10)]))]
    frame = docs(spark, rows).select("*", F.lit(1).alias("_spans_"), F.lit("x").alias("ver0"), F.lit("y").alias("ver1id"), F.lit(2).alias("cuts0"))
    out = substrings.stage(spark, frame, SF).collect()
    left = {(r.doc_id, r.text[:6]): len(r.text.split()) for r in out}
    assert left[2, rows[1][1][:6]] <= 104 and left[2, rows[2][1][:6]] == 90 and left[1, rows[0][1][:6]] == 120 and [len(r.text.split()) < 20 for r in out if r.doc_id == 3] == [True]
    assert all((r._spans_, r.ver0, r.ver1id, r.cuts0) == (1, "x", "y", 2) for r in out) and out[0].__fields__ == frame.columns


def test_passages_odd(spark):
    assert substrings.passages(docs(spark, [])).count() == 0
    text = " ".join(words(random.Random(1), 80))
    rows = [(1, text), (1, text), (2, text.upper()), (3, "x " + text)]
    got = {(r.doc_id, r.source_id) for r in substrings.passages(docs(spark, rows)).collect()}
    assert got == {(2, 1), (3, 1)}
    assert substrings.stage(spark, docs(spark, []), SF).count() == 0
    kept = substrings.stage(spark, docs(spark, [(None, text), (None, None), (4, None), (4, ""), (4, "-")]), SF)
    assert kept.count() == 5
    left = substrings.stage(spark, docs(spark, rows), SF)
    assert sorted((r.doc_id, r.text[:2]) for r in left.collect()) == sorted([(1, text[:2]), (1, text[:2]), (3, "x ")])
    assert substrings.cut_words("Ab, cd. Ef!", [(1, 2)]) == "Ab, Ef!" and substrings.cut_words("a b", [(0, 2)]) == ""


def test_windows_of_many_minima_are_compared_again_together(monkeypatch):
    n, span, calls = 200, substrings.SPAN, []
    rng = np.random.default_rng(7)
    near = rng.integers(1, 1 << 32, (n, span), dtype=np.uint32)
    near[:, substrings.LEAST - 1] = 5
    near[:, 3:20] = near[0, 3:20]  # what all have
    far = near.copy()
    far[::2, 60] = 6  # of some goals a place is another
    every = np.packbits(np.ones(span, bool)).tobytes()
    rows = [(4, i, None, near[i]) for i in range(n)] + [(4, 1000 + i, every, far[i]) for i in range(n)]
    rows += [(9, 0, None, near[0])] + [(9, 1000 + i, every, far[i]) for i in range(1, n)]  # no source of these has this minimum
    whole = substrings.unaligned
    monkeypatch.setattr(substrings, "unaligned", lambda *a, **k: calls.append(len(a[0])) or whole(*a, **k))
    group = pa.table({"key": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "ver": pa.array([0] * len(rows), pa.int32()), "lo": [0] * len(rows), "left": pa.array([r[2] for r in rows], pa.binary()), "around": pa.array([r[3].tobytes() for r in rows], pa.binary())})
    found = substrings._rejoined(group).to_pylist()
    assert sorted((r["doc_id"], r["source_id"], r["a"], r["b"]) for r in found) == [(1000 + i, i, 0, span) for i in range(n)]
    assert sum(calls) >= n > 4 * len(calls)  # a call for each goal before


# embeddings -----------------------------------------------------------------------
@pytest.mark.parametrize("cell,tile", [(2000, 1500), (20, 15)])
def test_range_join(spark, monkeypatch, cell, tile):
    monkeypatch.setattr(metricjoin, "CELL", cell)
    monkeypatch.setattr(metricjoin, "TILE", tile)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * (0.1 + 0.4 * (i % 3))).astype(np.float32).tolist(), i % 2) for i in range(260)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], 1), (503, None, 0), (504, [0.0] * 8, 0), (505, [1.0] * 7 + [None], 0), (506, [1.0] * 7 + [float("nan")], 0)]
    rows += [(507, [1.0] * 8, None), (508, [float("inf")] * 8, 0), (509, [], 0), (510, [1.0, 2.0], 0), (511, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<float>, label int, cell int, rep int")
    got = {r.vec_id: r for r in metricjoin.range_join(df).collect()}
    good = [(i, np.array(v, float), k) for i, v, k in rows if v and k is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for (i, x, a), (j, y, b) in itertools.combinations(good, 2):
        if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
            links.append((i, j))
    want = classes_by_hand(links, [r[0] for r in rows])
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in e for e in links) for i in want}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert metricjoin.range_join(df.limit(0)).count() == 0


def test_range_join_extreme_norms_and_labels(spark):
    big = 1 << 40
    rows = [(1, [1e200, 1e200], big), (2, [2e200, 2e200], big), (3, [1e-200, 1e-200], big), (4, [5e-324, 0.0], big), (5, [1.0, 0.0], big), (6, [1e308, -1e308], big), (7, [1.0, 1.0], big + 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in metricjoin.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7)}
    named = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [2.0, 4.0], "a"), (3, [1.0, 2.0], "b")], "vec_id long, embedding array<double>, label string")
    assert {r.vec_id: r.component_id for r in metricjoin.range_join(named).collect()} == {1: 1, 2: 1, 3: 3}


def test_range_join_at_the_threshold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    angle = np.arccos(0.93)
    y = []
    for v in x:
        u = v / np.sqrt((v * v).sum())
        w = np.cross(u, rng.normal(size=3))
        w /= np.sqrt((w * w).sum())
        y.append((np.cos(angle) * u + np.sin(angle) * w) * rng.uniform(0.1, 9))
    y = np.array(y)
    alone = np.array([metricjoin.similar(a[None], b[None], 0.93)[0, 0] for a, b in zip(x, y)])
    assert (np.diag(metricjoin.similar(x, y, 0.93)) == alone).all() and 20 < alone.sum() < 280
    assert (np.diag(metricjoin.similar(y[:, ::1], x, 0.93)) == alone).all()


def test_cells_lose_no_pair():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    x /= np.sqrt((x * x).sum(1))[:, None]
    r = np.sqrt(2 - 2 * 0.93)
    row, cell, home = metricjoin._cells(x, x[:9], r)
    at, where = dict(zip(row[home].tolist(), cell[home].tolist())), set(zip(row.tolist(), cell.tolist()))
    close = np.argwhere(x @ x.T >= 0.93)
    assert len(at) == 400 and all((int(i), at[int(j)]) in where for i, j in close)


# decontamination ---------------------------------------------------------------------
def test_templates(spark):
    item = "We know that Peter has 5 apples and he buys 3 kg more apples today. How many apples does Peter have in total now?"
    rows = [
        (1, "Hm, well. " + item.replace("Peter", "Anna Lee").replace("5", "1,700").replace("3", "41")),
        (2, item.replace("5", "9").replace("does Peter", "does Bob")),  # not one to one
        (3, item.upper()),
        (4, "Nothing of the kind is said here, only some other words that go on for a while."),
        (5, None), (6, ""), (7, "words " * 40_000), (None, item), (8, item), (8, item),
        (9, "We know that Peter has 5 apples and he buys"),  # too little of it
    ]
    items = spark.createDataFrame([(1, item, "x"), (2, "Short 5 kg.", "x"), (3, None, "x"), (4, item, "x"), (5, "how many words of a short one", "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs(spark, rows), items).collect()}
    assert set(got) == {(d, i) for d in (1, 8) for i in (1, 4)}
    assert got[1, 1].position == 2 and got[8, 1].coverage == 1.0
    assert decontaminate.contaminated(docs(spark, []), items).count() == 0
    assert decontaminate.contaminated(docs(spark, rows), items.limit(0)).count() == 0
    plan = decontaminate.contaminated(docs(spark, rows), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_each_text_is_judged_by_itself(spark, tmp_path):
    """Rows of one id aren't added up; the text alone counts, null ids too."""
    words = [f"{a}{b}" for a in "bcdfghjkl" for b in ("alo", "emi", "onu", "ute")]
    item = " ".join(words)
    first, last = " ".join(words[:24]) + " something else", "other words here " + " ".join(words[13:])
    half, leak = " ".join(words[:15]) + " and so on", "it was said that " + item
    rows = [(3, half), (3, "and then " + " ".join(words[24:])), (4, first), (4, last), (5, leak), (5, "a clean text of the same id"), (None, leak), (None, "clean"), (6, None), (7, ""), (8, "so: What is 17 + 23? ok"), (9, "what is 17 or 23")]
    items = spark.createDataFrame([(1, item), (2, "What is 17 + 23?"), (3, "17 + 23?"), (4, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.total_windows, r.position) for r in decontaminate.contaminated(docs(spark, rows), items).collect()}
    assert got == {(4, 1): (15, 27, 0), (5, 1): (27, 27, 4), (8, 2): (1, 1, 1)}
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = docs(spark, rows).withColumns({"ver": F.lit("x"), "more": F.lit(1), "_ver_": F.lit(2), "item_id": F.lit(3)})
    left = decontaminate.stage(spark, frame, str(tmp_path))
    assert left.columns == frame.columns
    gone = {leak, first, last, rows[10][1]} if got[4, 1] else None
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(((i, t) for i, t in rows if t not in gone), key=str)
    assert decontaminate.stage(spark, frame.limit(0), str(tmp_path)).count() == 0


def test_decontamination_by_hand(spark):
    d = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    clean = lambda t: ["".join(c for c in w if c.isalpha()) for w in t.lower().split()]
    grams = lambda ws: {tuple(ws[k : k + 8]) for k in range(len(ws) - 7)}
    have = {k: grams(clean(x)) for k, x in d.items()}
    want = set()
    for i, t in items.items():
        own = grams(clean(t))
        want |= {(k, i) for k, x in have.items() if len(own & x) >= 0.5 * len(own)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.query(spark, SF).collect()} == want
    out = decontaminate.stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert {r.doc_id for r in out.collect()} == set(d) - {k for k, _ in want}


# WARC -------------------------------------------------------------------------------
RECORDS = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, part int, old string"


def record(i, url, ts, kind, etag=None, modified=None, digest=None, headers=None):
    return i, url, ts, kind, etag, modified, digest, headers, 0, "x"


def test_revisits(spark):
    h = {"content-length": "10", "content-type": "a", "etag": "e", "x": "1"}
    rows = [
        record(1, "http://www.A.com/p/?utm_source=q&b=2&a=1#f", 10, "response", "e", None, "d1", h),
        record(2, "https://a.com/p?a=1&b=2", 20, "revisit", "W/e", None, None, {"content-length": "0", "x": "2", "date": "n"}),
        record(3, "https://a.com/p?a=1&b=2", 20, "response", "f", None, "d3", h),
        record(4, "https://a.com/p?a=1&b=2", 30_000, "revisit", "e", None, None, h),
        record(5, "https://a.com/p?a=1&b=2", 30_000, "revisit", "f", None, None, None),
        record(6, "https://a.com/p?a=1&b=2", 5, "revisit", "e"),
        record(7, None, 5, "revisit", "e"), record(8, "https://a.com/p", None, "revisit", "e"), record(9, "https://a.com/p?a=1&b=2", 25, "revisit"), record(10, "https://a.com/q", 1, None),
        record(11, "not a url", 1, "response", None, "m", "d11"), record(12, "not a url", 2, "revisit", None, "m"), record(12, "not a url", 2, "revisit", None, "m"),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    for span in (warc.SPAN, 7, 1):
        got = {}
        out = warc.resolve(df, span).collect()
        for r in out:
            got[r.record_id] = (r.resolution, r.ref_id, r.digest)
        assert len(out) == len(rows)
        assert got == {
            1: ("response", None, "d1"), 2: ("resolved", 1, "d1"), 3: ("response", None, "d3"), 4: ("validator_mismatch", 3, None), 5: ("resolved", 3, "d3"), 6: ("unmatched", None, None),
            7: ("no_url", None, None), 8: ("no_time", None, None), 9: ("no_validator", 3, None), 10: ("ignored", None, None), 11: ("response", None, "d11"), 12: ("resolved", 11, "d11"),
        }
        merged = next(r.headers for r in out if r.record_id == 2)
        assert merged == {"content-length": "10", "content-type": "a", "etag": "e", "x": "2", "date": "n"}
        assert next(r.headers for r in out if r.record_id == 5) == h
    assert warc.resolve(df.limit(0)).count() == 0


# queries with SQL ------------------------------------------------------------------
@pytest.mark.parametrize("name", ["op2_warc_revisits", "op4_embedding_range_join"])
def test_sql(spark, name):
    from loomtext.llm import registry

    c = duckdb.connect()
    for t in ("pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = c.execute(registry.SQL[name])
    names = [x[0] for x in r.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(x[n] for n in names) for x in got.collect()), key=key) == sorted(map(tuple, r.fetchall()), key=key)
