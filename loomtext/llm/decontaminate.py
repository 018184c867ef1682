"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become templates: words are lower-cased and rid of
punctuation, and numbers, names (capitalised words inside a sentence) and units
(after a number) turn into typed slots; neighbouring numbers or names make one
slot. Every window of ``WINDOW`` template words is hashed and joined with the
windows of the items. For each place where an item lies over a text, the values
of the slots must map one to one: the same question with other numbers or names
is caught, another question that happens to share a frame is not. A text is
contaminated by an item if ``COVERAGE`` of the item's windows are found.

Only DataFrame functions are used. The items' windows are broadcast if they are
at most ``BROADCAST_WINDOWS``, else joined by shuffle. Matches are counted on
the map side; texts are fetched again only for the few pairs that pass. What is found
in a text depends on the text alone, so texts go by two 64-bit hashes of theirs, not by
ids: copies are judged once, and rows of one id each by itself.

Items whose templates say too little, fewer than ``SHORTEST`` words or no
window that is at least half literal, are looked for word for word instead: all their
plain words, numbers and names included, in a row.

Defined cases: null and empty texts and items match nothing; an item of fewer than
``WINDOW`` words is looked for as a whole; one of fewer than ``SHORTEST_PLAIN`` plain
words is not looked for (any text may have these); repeated items are found each; of
rows of one id, the one that an item covers most is reported (on ties the first place);
very long texts are searched whole; a null id isn't reported, but the stage drops
its row if its text is contaminated; empty tables give an empty result, or all
documents; other columns are ignored, and kept by the stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_IDS, stored, table

WINDOW, SHORTEST, SHORTEST_PLAIN, COVERAGE = 10, 5, 4, 0.5
BROADCAST_WINDOWS = 2_000_000
# Units of measure and money that make a slot after a number.
UNITS = (
    "mm cm m km inch inches in ft foot feet yard yards yd mile miles mi mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent degree degrees kmh mph hz khz mhz ghz w kw watt watts v volt volts j joule joules cal kcal "
    "dollar dollars cent cents euro euros eur usd gbp yen rupee rupees peso pesos"
).split()
_NAME, _NUMBER, _UNIT = "\x01", "\x02", "\x03"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once: a column that is named and
    then used repeatedly would be put in at each use, also within a lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def marked(text: Column) -> Column:
    """The words of a text, parted by single spaces; those of slots begin with
    the mark of their type."""
    s = F.translate(F.coalesce(text, F.lit("")), "\x01\x02\x03", "   ")
    s = F.lower(F.regexp_replace(s, r"(?=\p{Lu}\p{Ll})(?<=[^\s.!?:]\s)", _NAME))
    s = F.trim(F.regexp_replace(s, "[^\\p{L}\\p{M}\\p{N}\x01]+", " "))
    s = let(s, lambda x: F.when(x.contains(_NAME), F.regexp_replace(x, " (?=\x01)(?<=\x01[^ ]{1,80} )", "_")).otherwise(x))

    def numbered(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, r" (?<=\p{N} )(?=[^ \p{N}]*+\p{N})", "_"), r"(^| )\x01?([^ \p{N}]*+\p{N}[^ ]*+)", f"$1{_NUMBER}$2")
        return F.regexp_replace(x, f"(\x02[^ ]*) ({'|'.join(UNITS)})(?= |$)", f"$1 {_UNIT}$2")

    return let(s, lambda x: F.when(x.rlike(r"\p{N}"), numbered(x)).otherwise(x))


def template(words: Column) -> Column:
    """Template words of marked words: a slot is its mark alone."""
    return F.filter(F.split(F.regexp_replace(words, "([\x01-\x03])[^ ]*", "$1"), " "), lambda w: w != "")


def plain(text: Column) -> Column:
    """All words of a text, in lower case, without punctuation."""
    s = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+", " ")
    return F.filter(F.split(s, " "), lambda w: w != "")


def _hashes(words: Column, width: int) -> Column:
    """Hashes of the windows of ``width`` words, by position."""

    def of(w: Column) -> Column:
        n = F.size(w) - (width - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, F.lit(width))))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _windows(words: Column, width: Column) -> Column:
    """Place, hash and number of literal words of each window of an item."""

    def windows(x: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(x["t"]) - x["width"]),
            lambda i: F.struct(
                i.alias("q"),
                F.xxhash64(F.transform(F.slice(x["t"], i + 1, x["width"]), lambda w: F.xxhash64(w))).alias("hash"),
                F.size(F.filter(F.slice(x["t"], i + 1, x["width"]), lambda w: ~w.isin(_NAME, _NUMBER, _UNIT))).alias("literal"),
            ),
        )

    return let(F.struct(words.alias("t"), width.alias("width")), windows)


def _items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows ``item_id, q, hash, width, total``: of the items whose templates
    are literal enough, and the plain ones of all others."""
    t = items.where("item_id is not null and text is not null").select("item_id", "text", template(marked(F.col("text"))).alias("t"))
    t = t.withColumn("width", F.least(F.size("t"), F.lit(WINDOW)))
    literal = F.filter(_windows(F.col("t"), F.col("width")), lambda x: 2 * x["literal"] >= F.col("width"))
    t = t.withColumn("w", F.when(F.size("t") >= SHORTEST, literal).otherwise(F.array().cast("array<struct<q:int,hash:bigint,literal:int>>")))
    t = stored(t.select("item_id", "text", "width", "w"), "items")
    rest = t.where(F.size("w") == 0).select("item_id", plain(F.col("text")).alias("t")).where(F.size("t") >= SHORTEST_PLAIN)
    rest = rest.withColumn("width", F.least(F.size("t"), F.lit(WINDOW))).withColumn("w", _windows(F.col("t"), F.col("width")))
    of = lambda x: x.select("item_id", "width", F.size("w").alias("total"), F.inline("w")).drop("literal")
    return of(t.where(F.size("w") > 0)), of(rest)


_VER = ["ver", "more"]


def told_apart(docs: DataFrame) -> DataFrame:
    """With two hashes of the text, null being empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"ver": F.xxhash64(text), "more": F.xxhash64(text, F.lit(1))})


def _placed(words: Column, docs: DataFrame, windows: DataFrame) -> DataFrame | None:
    """``ver, more, item_id, width, total, shift, qs``: where items lie over texts."""
    size, widths = windows.agg(F.count("*"), F.collect_set("width")).first()  # at most WINDOW widths
    if not size:
        return None
    windows = F.broadcast(windows) if size <= BROADCAST_WINDOWS else windows
    t = docs.select(*_VER, words.alias("t"))
    placed = lambda w: t.select(*_VER, F.posexplode(_hashes(F.col("t"), w)).alias("p", "hash")).join(windows.where(F.col("width") == w), "hash")
    found = reduce(DataFrame.unionByName, [placed(w) for w in sorted(widths)])
    return found.groupBy(*_VER, "item_id", "width", "total", (F.col("p") - F.col("q")).alias("shift")).agg(F.collect_set("q").alias("qs"))


def _fewer(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` with or without the texts of the stored, distinct ``found``."""
    return docs.join(F.broadcast(found) if found.count() <= BROADCAST_IDS else found, _VER, how)


_FOUND = "ver bigint, more bigint, item_id bigint, n_windows int, total_windows int, position int"


def contaminated_texts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``ver, more, item_id, n_windows, total_windows, position`` of the
    contaminated texts of ``told_apart`` documents; stored."""
    docs = docs.where("text is not null").select("text", *_VER)
    windows, exact = _items(items)
    found = _placed(template(marked(F.col("text"))), docs, windows)
    out = []
    if found is not None:
        # enough windows at all, before values are looked at
        pairs = found.groupBy(*_VER, "item_id").agg(F.max("total").alias("total"), F.collect_list(F.struct("shift", "qs", "width")).alias("places"))
        pairs = pairs.where(F.size(F.array_distinct(F.flatten("places.qs"))) >= COVERAGE * F.col("total"))
        places = stored(pairs.select(*_VER, "item_id", "total", F.inline("places")), "places")
        values = F.filter(F.split(marked(F.col("text")), " "), lambda w: w != "")
        items = items.select("item_id", values.alias("iv"))
        texts = _fewer(docs, stored(places.select(*_VER).distinct(), "ids"), "left_semi").groupBy(*_VER).agg(F.first("text").alias("text")).select(*_VER, values.alias("dv"))
        own = F.col("shift") + F.array_min("qs")
        span = F.array_max("qs") - F.array_min("qs") + F.col("width")
        slots = F.filter(
            F.arrays_zip(F.slice("iv", F.array_min("qs") + 1, span).alias("i"), F.slice("dv", own + 1, span).alias("d")),
            lambda x: x["i"].rlike("^[\x01-\x03]") & (F.substring(x["i"], 1, 1) == F.substring(x["d"], 1, 1)),
        )
        one_to_one = (F.size(F.array_distinct("slots")) == F.size(F.array_distinct("slots.i"))) & (F.size(F.array_distinct("slots")) == F.size(F.array_distinct("slots.d")))
        out.append(
            places.join(items, "item_id").join(texts, _VER)
            .select(*_VER, "item_id", "total", "qs", own.alias("own"), slots.alias("slots"))
            .where(one_to_one)
            .groupBy(*_VER, "item_id")
            .agg(F.max("total").alias("total_windows"), F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("n_windows"), F.min("own").cast("int").alias("position"))
            .where(F.col("n_windows") >= COVERAGE * F.col("total_windows"))
        )
    whole = _placed(plain(F.col("text")), docs, exact)
    if whole is not None:
        # word for word: every window at one place
        whole = whole.where(F.size("qs") == F.col("total"))
        out.append(whole.groupBy(*_VER, "item_id").agg(F.max("total").alias("total_windows"), F.max(F.size("qs")).alias("n_windows"), F.min("shift").cast("int").alias("position")))
    if not out:
        return docs.sparkSession.createDataFrame([], _FOUND)
    return stored(reduce(DataFrame.unionByName, out).select(*_VER, "item_id", "n_windows", "total_windows", "position"), "found")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_windows, total_windows, coverage, position`` of the
    contaminated documents of ``docs(doc_id, text)`` by ``items(item_id, text)``;
    position is the first template (or plain) word, from 0, where the item lies."""
    docs = told_apart(docs.select("doc_id", "text"))
    found = contaminated_texts(docs, items)
    rows = _fewer(docs.where("doc_id is not null and text is not null").select("doc_id", *_VER), stored(found.select(*_VER).distinct(), "texts"), "left_semi")
    best = rows.join(found, _VER).groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", (-F.col("position")).alias("back"), "total_windows")).alias("x"))
    best = best.select("doc_id", "item_id", "x.n_windows", "x.total_windows", (-F.col("x.back")).alias("position"))
    return best.select("doc_id", "item_id", "n_windows", "total_windows", (F.col("n_windows") / F.col("total_windows")).alias("coverage"), "position")


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose texts no benchmark item contaminates, those without
    an id too; rows of one id each by itself. Columns stay, whatever their names."""
    texts = docs.select(F.col("text").alias("text"))
    bad = contaminated_texts(told_apart(texts), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    bad = stored(bad.select(*(F.col(c).alias(f"_{c}_") for c in _VER)).distinct(), "bad")
    text = F.coalesce(docs["text"], F.lit(""))
    on = (F.xxhash64(text) == bad["_ver_"]) & (F.xxhash64(text, F.lit(1)) == bad["_more_"])
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad, on, "left_anti")
