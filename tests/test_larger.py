"""What has to hold for tables that are much larger than those of the tests."""

import itertools
import random

import pyarrow as pa
from pyspark.sql import functions as F

from loomtext.index import TextIndex
from loomtext.llm import neardup, substrings
from loomtext.operators import bwt, intervals, runs


def test_points_meet_few_intervals(spark):
    """The pairs that an interval join compares, with short intervals, grow
    with the points and not with the points of a fixed span times its intervals."""
    ranges = spark.range(4000).select((F.col("id") * 3).alias("first"), (F.col("id") * 3 + 2).alias("last"), "id")
    points = spark.range(12000).select(F.col("id").alias("pos"))
    span = intervals.fitting(ranges)
    assert span == 3
    compared = points.groupBy(F.floor(F.col("pos") / span)).count().where(f"count > {span}").count()
    assert compared == 0
    found = intervals.containing(points, ranges, None)
    assert found.where("id = floor(pos / 3)").count() == found.count() == 12000
    heads = runs.access(ranges.select(F.col("id").alias("run_id"), F.lit("a").alias("ch"), F.col("first").alias("start"), F.lit(3).cast("bigint").alias("len")), points)
    assert heads.count() == 12000


def test_spans_of_no_and_of_one_interval(spark):
    none = spark.createDataFrame([], "first bigint, last bigint")
    assert intervals.fitting(none) == 1 and intervals.containing(spark.range(3).withColumnRenamed("id", "pos"), none).count() == 0
    one = spark.createDataFrame([(0, 10**9)], "first bigint, last bigint")
    assert intervals.fitting(one) == intervals.WIDEST


def test_no_broadcast_by_the_size_of_files(spark):
    """Symbols of the tiles are a row each: files' sizes tell nothing of them."""
    x = TextIndex.of_strings(spark, ["banana", "ananas", "banana band"])
    again = bwt.from_suffix_array(x.text.tiles, x.suffix_array, x.n, x.text.tile)
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    assert "".join(r.ch for r in again.orderBy("pos").collect()) == "".join(r.ch for r in x.bwt().orderBy("pos").collect())


def test_passages_plan_no_broadcast_by_the_size_of_files(spark):
    static = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(static)
    spark.conf.set(static, "10485760")
    try:
        words = " ".join(f"w{i}" for i in range(120))
        found = substrings.passages(spark.createDataFrame([(1, words), (2, "other words first " + words), (3, words + " end")], "doc_id bigint, text string"))
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.doc_id, r.source_id) for r in found.collect()} == {(2, 1), (3, 1)}
        assert spark.conf.get(static) == "10485760"
    finally:
        spark.conf.set(static, before)


def test_every_link_of_a_class_counts(spark, monkeypatch):
    """Near copies that differ: each has all of its links, not those of a forest."""
    monkeypatch.setattr(neardup, "TILE_SETS", 7)
    rng = random.Random(3)
    base, rows = [f"w{i}" for i in range(150)], []
    for k in range(30):
        rows.append((k, " ".join(rng.choice("xyz") + str(k) if i in (5 + k % 9, 90) else w for i, w in enumerate(base))))
    rows += [(40, rows[3][1]), (41, rows[3][1]), (50, "of its own")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    value, starts = neardup.sets_of(pa.array([t for _, t in rows]))
    sets = [set(value[a:b].tolist()) for a, b in zip(starts, starts[1:])]
    n, pairs = dict.fromkeys((i for i, _ in rows), 0), set()
    for (i, x), (j, y) in itertools.combinations(zip(n, sets), 2):
        if len(x & y) >= 0.8 * len(x | y) - 1e-9:
            n[i] += 1
            n[j] += 1
            if x != y and max(i, j) < 40:
                pairs.add(frozenset((i, j)))
    assert max(n.values()) > 20
    assert {r.doc_id: r.n_links for r in neardup.classes(frame).collect()} == n
    listed = [frozenset(r) for r in neardup.pairs(frame).collect()]
    assert len(listed) == len(pairs) and set(listed) == pairs
