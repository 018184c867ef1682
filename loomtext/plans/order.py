"""Global ranks and running sums without a single-partition window.

Rows are range-partitioned and sorted, their partition number is stored with
them (range bounds are sampled, so a recomputed exchange could differ), each
partition's total becomes an offset of the later ones, and a window runs inside
partitions. Frames of at most ``FEW`` rows are sorted in one task instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

FEW = 500_000


def running(df: DataFrame, by: list[str], name: str, weight: Column | None = None, few: int = FEW, rank: str | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` (1) of all rows before, in
    the order of the columns ``by``, which tell rows apart; and with ``rank``,
    if named, the number of those rows."""
    spark = df.sparkSession
    weight = F.lit(1) if weight is None else weight
    df = stored(df.withColumn("_w_", weight.cast("bigint")), "rows")
    sums = {name: F.sum("_w_")} | ({rank: F.count("*")} if rank else {})
    if df.count() <= few:
        over = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({k: F.coalesce(v.over(over), F.lit(0)).cast("bigint") for k, v in sums.items()}).drop("_w_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = stored(df.repartitionByRange(n, *by).withColumn("_p_", F.spark_partition_id()), "ranged")
    totals = df.groupBy("_p_").agg(*(v.alias(f"_o_{k}") for k, v in sums.items()))  # one row a partition
    before = Window.orderBy("_p_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p_", *(F.coalesce(F.sum(f"_o_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums))
    over = Window.partitionBy("_p_").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(F.broadcast(offsets), "_p_")
    out = out.withColumns({k: (F.col(f"_o_{k}") + F.coalesce(v.over(over), F.lit(0))).cast("bigint") for k, v in sums.items()})
    return out.drop("_w_", "_p_", *(f"_o_{k}" for k in sums))


def within(df: DataFrame, group: list[str], by: list[str], name: str, sizes: DataFrame, few: int = FEW) -> DataFrame:
    """``df`` with ``name``: a row's place (from 0) among the rows of its
    ``group``, in the order of ``by``. ``sizes`` has every group once, with its
    number of rows, ``size``. Two-level: rows are ranked among all groups'
    rows in ranges, so that one group's rows are as many tasks' work as they
    need, and less the rows of the groups before."""
    first = running(sizes.select(*group, "size"), group, "_first_", F.col("size"), few).select(*group, "_first_")
    placed = running(df, [*group, *by], "_at_", few=few)
    return placed.join(first, group).withColumn(name, F.col("_at_") - F.col("_first_")).drop("_at_", "_first_")


def suffix_order(rows: DataFrame, heads: list[str], h: int, few: int = FEW, most: int = 64) -> DataFrame:
    """Ranks of the suffixes of many sequences: ``rows(owner, s, rem, ...)``
    with one row for each suffix, where it starts, and how many symbols it has;
    ``heads`` are columns that order suffixes by their first ``h`` symbols, equal
    where these are. Gives ``rank``, how many suffixes are smaller, in place of
    ``heads``; equal suffixes have one rank. A suffix that ends sorts first.

    Ranks by h symbols give those by 2h, as in prefix doubling: a suffix's rest
    after h symbols is a suffix too, found by its start. Only suffixes
    that share their first h symbols with another and go on take part in a
    round; all others are settled and only looked up. A round ranks pairs of
    ranks, so its order is one of two numbers, whatever the suffixes' lengths."""
    keys = rows.groupBy(*heads).agg(F.count("*").alias("n"), F.max("rem").alias("far"))
    keys = running(keys, heads, "rank", F.col("n"), few).select(*heads, "rank", ((F.col("n") > 1) & (F.col("far") > h)).alias("open"))
    ranked = stored(rows.join(stored(keys, "keys"), heads).drop(*heads), "ranked")
    settled = [ranked.where("not open")]
    for _ in range(most):
        tied = ranked.where("open")
        if tied.isEmpty():
            return reduce(DataFrame.unionByName, settled).drop("open")
        rest = reduce(DataFrame.unionByName, settled).unionByName(tied).select("owner", (F.col("s") - h).alias("s"), (F.col("rank") + 1).alias("rest"))
        pairs = stored(tied.drop("open").join(rest, ["owner", "s"], "left").withColumn("rest", F.coalesce("rest", F.lit(0))), "pairs")
        keys = pairs.groupBy("rank", "rest").agg(F.count("*").alias("n"), F.max("rem").alias("far"))
        keys = running(keys, ["rank", "rest"], "at", F.col("n"), few)
        first = keys.groupBy("rank").agg(F.min("at").alias("first"))
        fresh = keys.join(first, "rank").select("rank", "rest", (F.col("rank") + F.col("at") - F.col("first")).alias("fresh"), ((F.col("n") > 1) & (F.col("far") > 2 * h)).alias("open"))
        ranked = stored(pairs.join(stored(fresh, "keys"), ["rank", "rest"]).drop("rank", "rest").withColumnRenamed("fresh", "rank"), "ranked")
        settled.append(ranked.where("not open"))
        h *= 2
    raise RuntimeError("suffixes did not become settled")


def suffix_ranks(seq: DataFrame, few: int = FEW, tile: int = 1 << 14, ahead: int = 8) -> DataFrame:
    """``i, rank`` of the suffixes of the one sequence ``seq(i, x)``, whose
    ``i`` count from 0, ranks from 1; the end of the sequence, which has no row,
    ranks 0. The first ``ahead`` symbols of each come from tiles of the sequence,
    each with the beginning of the next."""
    tiles = seq.groupBy(F.floor(F.col("i") / tile).alias("tile")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("t"))
    tiles = stored(tiles.select("tile", F.col("t.x").alias("x")), "tiles")
    following = tiles.select((F.col("tile") - 1).alias("tile"), F.slice("x", 1, ahead - 1).alias("more"))
    whole = tiles.join(following, "tile", "left").select("tile", F.size("x").alias("n"), F.concat("x", F.coalesce("more", F.array().cast("array<bigint>"))).alias("x"))
    # a place beyond the end is smaller than any symbol
    each = whole.select("tile", "x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    n = seq.count()
    at = (F.col("tile") * tile + F.col("j")).cast("bigint")
    heads = [f"h{k}" for k in range(ahead)]
    rows = each.select(F.lit(0).alias("owner"), at.alias("s"), (F.lit(n) - at).alias("rem"), *(F.coalesce(F.get("x", F.col("j") + k), F.lit(-1)).alias(h) for k, h in enumerate(heads)))
    return suffix_order(rows, heads, ahead, few).select(F.col("s").alias("i"), (F.col("rank") + 1).alias("rank"))
