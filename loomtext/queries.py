"""The registered queries of the text index, and the same results in plain SQL.

The index is built through the parse tables; the SQL sorts rotations of the
text itself (or, for the tables of the parse, restates their definition), so
the two share no step. All queries run over whole columns."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.symbols import BASE, PRIME
from .index import TextIndex, load
from .operators import bwt as bwt_ops
from .operators import runs, samples
from .plans import suffixes
from .sources import given
from .sources.corpus import read_runs, read_ssa, write_runs, write_ssa
from .sources.scratch import stored, work_dir

W1, P1, W2, P2 = 4, 11, 2, 5
#: Rotations are compared by so many symbols in SQL; it raises an error if any
#: two of the text's have as many in common, so that the order is always whole.
PREFIX = 256

_built: dict[tuple, TextIndex] = {}


def index(spark: SparkSession, sf_dir: str, table: str = "part", key: str = "p_partkey", text: str = "p_name") -> TextIndex:
    """The index of a column; kept for the session, as queries share tables."""
    name = (spark.sparkContext.applicationId, sf_dir, table, text)
    if name not in _built:
        _built[name] = TextIndex.of_table(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, text), key, text, W1, P1, W2, P2)
    return _built[name]


def by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length BWT of every benchmark item on its own, by sorting rotations:
    items are short, and each is a row of its own until its rotations are."""
    docs = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.concat("text", F.lit("\x02")).alias("t"))
    each = docs.select("item_id", F.posexplode(F.split("t", "")).alias("i", "ch"), "t")
    rotations = each.select("item_id", F.expr("substring(t, i + 1) || substring(t, 1, i)").alias("r"), F.expr("substring(t, if(i = 0, length(t), i), 1)").alias("ch"))
    rotations.createOrReplaceTempView("loomtext_rotations")
    return spark.sql("""
        WITH b AS (SELECT item_id, ch, row_number() OVER (PARTITION BY item_id ORDER BY r) - 1 AS pos FROM loomtext_rotations),
        h AS (SELECT *, CASE WHEN lag(ch) OVER (PARTITION BY item_id ORDER BY pos) = ch THEN 0 ELSE 1 END AS head FROM b),
        s AS (SELECT *, sum(head) OVER (PARTITION BY item_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS run FROM h)
        SELECT item_id, CAST(run AS BIGINT) AS run_id, ch, CAST(min(pos) AS BIGINT) AS start, count(*) AS len FROM s GROUP BY item_id, run, ch""")


def _class_counts(x: TextIndex) -> DataFrame:
    return x.all_pieces.groupBy("tier").agg(F.sum("len").cast("bigint").alias("n_symbols"))


def _skipped(x: TextIndex) -> DataFrame:
    needed = samples.groups_with_heads(x.groups, x.rlbwt).select("row1", F.lit(True).alias("needed"))
    return x.groups.join(needed, "row1", "left").groupBy(F.coalesce("needed", F.lit(False)).alias("needed")).agg(F.sum("cnt").cast("bigint").alias("n_symbols"), F.count("*").alias("n_groups"))


def _access(x: TextIndex) -> DataFrame:
    positions = x.rlbwt.sparkSession.range(x.n).select(F.col("id").alias("pos"))
    return runs.access(x.rlbwt, positions)


def _alphas(x: TextIndex) -> DataFrame:
    return suffixes.spelled(x.groups, x.dict1)


def _phrase_suffixes(x: TextIndex) -> DataFrame:
    return suffixes.spelled(x.suffix1, x.dict1).select("pid", "alpha", "len_alpha", "prev", "freq")


def _m_table(x: TextIndex) -> DataFrame:
    spelled = x.m_table.join(x.dict2.select("pid2", "toks", "len"), "pid2").withColumn("alpha2", F.slice("toks", F.col("s").cast("int"), F.col("len").cast("int")))
    return spelled.select("row2", F.array_join("alpha2", ",").alias("alpha2"), "pid2", "prev_pid", "freq")


def _lookup(x: TextIndex) -> DataFrame:
    """Of the first and the last position of each group."""
    return x.lookup(x.groups.select(F.explode(F.array("l_left", "l_right")).alias("pos")))


def _chunks(x: TextIndex) -> list:
    return x.chunk_plan(3).orderBy("chunk").collect()


def _rlbwt_by_chunks(x: TextIndex) -> DataFrame:
    """Runs of chunks that were built apart, put together two and two."""
    found = [x.chunk_runs(c.row_start, c.row_end) for c in _chunks(x)]
    while len(found) > 1:
        found = [runs.merged(found[i].unionByName(found[i + 1])) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
    return found[0].select("start", "ch", "len")


def _sa_by_chunks(x: TextIndex) -> DataFrame:
    found = [x.chunk_suffix_array(c.row_start, c.row_end) for c in _chunks(x)]
    return reduce(DataFrame.unionByName, found).select("pos", "sa")


def _place(x: TextIndex) -> str:
    return f"{work_dir(x.groups.sparkSession)}/flat-{uuid.uuid4().hex}"


def _given(x: TextIndex) -> TextIndex:
    """An index of the dictionaries and the parse that were written to files."""
    prefix = _place(x)
    given.write_tables(x.dict1, x.dict2, x.parse2, prefix)
    return TextIndex.of_files(x.groups.sparkSession, prefix, x.w1, x.w2)


def _flat_runs(x: TextIndex) -> DataFrame:
    path = _place(x)
    write_runs(x.rlbwt, path)
    return read_runs(x.groups.sparkSession, path)


def _flat_samples(x: TextIndex) -> DataFrame:
    path = _place(x)
    write_ssa(x.ssa, path)
    return read_ssa(x.groups.sparkSession, path)


def _saved(x: TextIndex) -> str:
    path = _place(x)
    x.save(path)
    return path


def of_fasta(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of the column written as FASTA, in several files, lines of at
    most 20 symbols, and read again by lines."""
    name = (spark.sparkContext.applicationId, sf_dir, "part", "fasta")
    if name not in _built:
        path = f"{work_dir(spark)}/fasta-{uuid.uuid4().hex}"
        rows = stored(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name"), "part")
        # lines end where a symbol does, as blanks at a line's end aren't symbols of it
        lines = F.regexp_replace(F.translate(F.coalesce("p_name", F.lit("")), " ", "_"), "(.{20})", "$1\n")
        rows.repartitionByRange(3, "p_partkey").sortWithinPartitions("p_partkey").select(F.concat(F.lit(">"), F.col("p_partkey"), F.lit(" a part\n"), lines).alias("value")).write.text(path)
        _built[name] = TextIndex.of_fasta(spark, path, W1, P1, W2, P2)
    return _built[name]


_OF = {
    "corpus_layout": lambda x: x.corpus.select("k", "own", "off"),
    "trigger_positions": lambda x: x.trigger_positions,
    "phrase_occurrences": lambda x: x.occurrences,
    "phrase_dictionary": lambda x: x.dict1,
    "parse_l1": lambda x: x.parse1,
    "phrase_suffixes": _phrase_suffixes,
    "suffix_groups": lambda x: _alphas(x).select("alpha", "len_alpha", "cnt", "n_chars", "n_pids"),
    "group_ranges": lambda x: _alphas(x).select("row1", "alpha", "l_left", "l_right"),
    "group_classes": lambda x: x.groups.groupBy("kind").agg(F.count("*").alias("n_groups"), F.sum("cnt").cast("bigint").alias("n_symbols")),
    "dictionary_l2": lambda x: x.dict2.withColumn("toks", F.array_join("toks", ",")),
    "parse_l2": lambda x: x.parse2,
    "m_table": _m_table,
    "v_table": lambda x: x.v_table,
    "inverted_lists": lambda x: x.ilist.select("pid2", "k", "pos2"),
    "end_positions": lambda x: x.ilist.select("pid2", "pos2", "end_pos"),
    "row2_expansion": lambda x: x.expansion,
    "bwt_easy_runs": lambda x: x.pieces("easy").select("start", "ch", "len"),
    "bwt_hard_easy_runs": lambda x: x.pieces("hard_easy").select("start", "ch", "len"),
    "bwt_hard_hard_chars": lambda x: x.pieces("hard_hard").select("start", "ch", "len"),
    "bwt_class_counts": _class_counts,
    "bwt_collection": lambda x: x.bwt(),
    "bwt_from_suffix_array": lambda x: bwt_ops.from_suffix_array(x.text.tiles, x.suffix_array, x.n, x.text.tile),
    "rlbwt": lambda x: x.rlbwt.select("run_id", "ch", "start", "len"),
    "run_heads": lambda x: x.rlbwt.select("run_id", "start"),
    "run_stats": lambda x: runs.stats(x.rlbwt),
    "suffix_array": lambda x: x.suffix_array.select("pos", "sa"),
    "sa_at_run_heads": lambda x: x.ssa,
    "groups_with_heads": lambda x: suffixes.spelled(samples.groups_with_heads(x.groups, x.rlbwt), x.dict1).select("row1", "alpha"),
    "skipped_portion": _skipped,
    "chunk_plan": lambda x: x.chunk_plan(50),
    "rlbwt_access": _access,
    "saved_runs_decoded": lambda x: runs.decode(load(x.groups.sparkSession, _saved(x), "rlbwt")),
    "saved_samples": lambda x: load(x.groups.sparkSession, _saved(x), "ssa"),
    "given_dictionary": lambda x: _given(x).dict1,
    "given_dictionary_l2": lambda x: _given(x).dict2.withColumn("toks", F.array_join("toks", ",")),
    "given_parse_l2": lambda x: _given(x).parse2,
    "given_rlbwt": lambda x: _given(x).rlbwt.select("run_id", "ch", "start", "len"),
    "flat_runs": _flat_runs,
    "flat_samples": _flat_samples,
    "colex_order": lambda x: x.colex2,
    "m_intervals": lambda x: x.m_intervals,
    "bwt_hard_hard_by_interval": lambda x: x.hard_hard_by_interval(),
    "sa_lookup": _lookup,
    "skipped_by_level": lambda x: samples.skipped(x.groups, x.rlbwt, x.suffix1, x.m_table, x.expansion),
    "rlbwt_by_chunks": _rlbwt_by_chunks,
    "sa_by_chunks": _sa_by_chunks,
}


def _query(make):
    return lambda spark, sf_dir: make(index(spark, sf_dir))


def _events(make):
    return lambda spark, sf_dir: make(index(spark, sf_dir, "events", "event_id", "event_type"))


QUERIES = {k: _query(f) for k, f in _OF.items()} | {
    "fasta_layout": lambda spark, sf_dir: of_fasta(spark, sf_dir).corpus.select("k", "own", "off"),
    "fasta_rlbwt": lambda spark, sf_dir: of_fasta(spark, sf_dir).rlbwt.select("run_id", "ch", "start", "len"),
    "bwt_by_document": by_document,
    "rlbwt_events": _events(_OF["rlbwt"]),
    "sa_at_run_heads_events": _events(_OF["sa_at_run_heads"]),
}


# The text and its parse.
def _text(table: str, key: str, col: str) -> str:
    end = "repeat(chr(2), " + str(W1) + ")"
    sep = f"repeat(chr(5), {W1 - 1}) || chr(4)"
    return f"""
src AS (SELECT row_number() OVER (ORDER BY {key}) - 1 AS k, coalesce({col}, '') AS t FROM {table}),
pieces AS (SELECT k, t || {sep} AS o FROM src UNION ALL SELECT (SELECT count(*) FROM src), {end}),
corpus AS (SELECT k, CASE WHEN k = 0 THEN {end} ELSE {sep} END || o AS s, length(o) AS own, o,
  CAST(sum(length(o)) OVER (ORDER BY k) - length(o) AS BIGINT) AS off FROM pieces)"""


_H1 = " + ".join(f"{pow(BASE, W1 - 1 - j)} * lead(c, {j}) OVER w" if j else f"{pow(BASE, W1 - 1)} * c" for j in range(W1))
_PARSE = f""",
chars AS (SELECT k, length(s) AS l, unnest(range(length(s))) AS i, CAST(ord(unnest(string_split(s, ''))) AS BIGINT) AS c FROM corpus),
hashed AS (SELECT k, i, l, ({_H1}) % {PRIME} AS h FROM chars WINDOW w AS (PARTITION BY k ORDER BY i)),
trig AS (SELECT k, i AS t FROM hashed WHERE i <= l - {W1} AND (i = 0 OR i = l - {W1} OR h % {P1} = 0)),
cuts AS (SELECT k, t AS a, lead(t) OVER (PARTITION BY k ORDER BY t) AS b, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS j FROM trig),
occ AS (SELECT k, j, off - {W1} + a AS start, substr(s, CAST(a + 1 AS BIGINT), CAST(b - a + {W1} AS BIGINT)) AS phrase FROM cuts JOIN corpus USING (k) WHERE b IS NOT NULL),
dict1 AS (SELECT row_number() OVER (ORDER BY phrase) AS pid, phrase, length(phrase) AS len, count(*) AS freq FROM occ GROUP BY phrase),
parse1 AS (SELECT row_number() OVER (ORDER BY k, j) - 1 AS i, pid, k, j, start, len FROM occ JOIN dict1 USING (phrase)),
suffix1 AS (SELECT pid, substr(phrase, s) AS alpha, len - s + 1 AS len_alpha, substr(phrase, s - 1, 1) AS prev, freq
  FROM (SELECT *, unnest(range(2, len - {W1} + 2)) AS s FROM dict1)),
g0 AS (SELECT alpha, max(len_alpha) AS len_alpha, CAST(sum(freq) AS BIGINT) AS cnt, count(DISTINCT prev) AS n_chars, count(*) AS n_pids FROM suffix1 GROUP BY alpha),
groups AS (SELECT row_number() OVER (ORDER BY alpha) - 1 AS row1, *, CAST(sum(cnt) OVER (ORDER BY alpha) - cnt AS BIGINT) AS l_left,
  CAST(sum(cnt) OVER (ORDER BY alpha) - 1 AS BIGINT) AS l_right, CASE WHEN n_chars = 1 THEN 'easy' ELSE 'hard' END AS kind FROM g0)"""
_H2 = " + ".join(f"{pow(BASE, W2 - 1 - j)} * lead(tok, {j}) OVER w" if j else f"{pow(BASE, W2 - 1)} * tok" for j in range(W2))
_PARSE2 = f""",
last1 AS (SELECT k, max(i) AS i FROM parse1 GROUP BY k HAVING k < (SELECT max(k) FROM parse1)),
n1 AS (SELECT count(*) AS n FROM parse1),
seq AS (SELECT i + {W2} AS g, pid AS tok, i IN (SELECT i FROM last1) AS fin FROM parse1
  UNION ALL SELECT unnest(range({W2})), 0, false UNION ALL SELECT n + {W2} + unnest(range({W2})), 0, false FROM n1),
h2 AS (SELECT g, ({_H2}) % {PRIME} AS h, lead(fin, {W2 - 1}) OVER w AS fin FROM seq WINDOW w AS (ORDER BY g)),
trig2 AS (SELECT g FROM h2, n1 WHERE g <= n + {W2} AND (g = 0 OR g = n + {W2} OR fin OR h % {P2} = 0)),
cuts2 AS (SELECT g AS a, lead(g) OVER (ORDER BY g) AS b FROM trig2),
whole AS (SELECT list(tok ORDER BY g) AS l FROM seq),
occ2 AS (SELECT a, list_slice(l, CAST(a + 1 AS BIGINT), CAST(b + {W2} AS BIGINT)) AS toks FROM cuts2, whole WHERE b IS NOT NULL),
dict2 AS (SELECT row_number() OVER (ORDER BY toks) AS pid2, toks, CAST(len(toks) AS BIGINT) AS len, count(*) AS freq FROM occ2 GROUP BY toks),
p2 AS (SELECT row_number() OVER (ORDER BY a) - 1 AS i, pid2, a, len FROM occ2 JOIN dict2 USING (toks)),
upto AS (SELECT g, CAST(sum(coalesce(d.len - {W1}, 0)) OVER (ORDER BY g) AS BIGINT) AS pos FROM seq LEFT JOIN dict1 d ON d.pid = tok),
parse2 AS (SELECT i, pid2, pos AS end_pos FROM p2 JOIN upto ON g = a + len - {W2} - 1),
s2 AS (SELECT pid2, list_slice(toks, s, len) AS alpha2, toks[s - 1] AS prev_pid, freq FROM (SELECT *, unnest(range(2, len - {W2} + 2)) AS s FROM dict2)),
m AS (SELECT dense_rank() OVER (ORDER BY alpha2) - 1 AS row2, alpha2, pid2, prev_pid, freq FROM s2),
v AS (SELECT prev_pid AS pid, row2, CAST(sum(freq) AS BIGINT) AS cnt FROM m WHERE prev_pid > 0 GROUP BY ALL),
seq2 AS (SELECT list(pid2 ORDER BY i) AS l FROM parse2),
ranks AS (SELECT j - 1 AS i, row_number() OVER (ORDER BY list_slice(l, j + 1, len(l))) - 1 AS pos2 FROM (SELECT l, unnest(range(len(l) + 1)) AS j FROM seq2)),
ilist AS (SELECT pid2, row_number() OVER (PARTITION BY pid2 ORDER BY pos2) - 1 AS k, pos2, end_pos FROM parse2 JOIN ranks USING (i)),
tiers AS (SELECT row1, row2, l_left, CAST(sum(cnt) AS BIGINT) AS cnt, count(*) AS n_pids FROM
  (SELECT row1, l_left, pid FROM groups JOIN suffix1 USING (alpha) WHERE kind = 'hard') JOIN v USING (pid) GROUP BY ALL),
hard AS (SELECT *, CAST(l_left + sum(cnt) OVER (PARTITION BY row1 ORDER BY row2) - cnt AS BIGINT) AS start FROM tiers)"""
_COLEX = """,
colex1 AS (SELECT pid, row_number() OVER (ORDER BY reverse(phrase)) AS colex FROM dict1),
back AS (SELECT pid2, list(coalesce(colex, 0) ORDER BY i DESC) AS r FROM (SELECT pid2, unnest(toks) AS pid, unnest(range(len(toks))) AS i FROM dict2) LEFT JOIN colex1 USING (pid) GROUP BY pid2),
colex2 AS (SELECT pid2, row_number() OVER (ORDER BY r) - 1 AS colex2 FROM back)"""
_BWT = f""",
t AS (SELECT string_agg(o, '' ORDER BY k) AS t FROM corpus),
tt AS (SELECT t || substr(t, 1, {PREFIX}) AS x, length(t) AS n, string_split(t, '') AS l FROM t),
rot AS (SELECT unnest(range(n)) AS sa, unnest(list_transform(range(n), lambda i: x[i + 1 : i + {PREFIX}])) AS r, unnest(list_concat([l[n]], l[1 : n - 1])) AS ch FROM tt),
told AS (SELECT CASE WHEN count(DISTINCT r) = count(*) THEN 0 ELSE error('rotations with equal beginnings') END AS apart FROM rot),
bwt AS (SELECT row_number() OVER (ORDER BY r) - 1 + apart AS pos, sa, ch FROM rot, told),
heads AS (SELECT pos, sa, ch FROM (SELECT *, lag(ch) OVER (ORDER BY pos) AS before FROM bwt) WHERE before IS NULL OR before <> ch),
rl AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS run_id, ch, pos AS start, lead(pos, 1, (SELECT count(*) FROM bwt)) OVER (ORDER BY pos) - pos AS len, sa FROM heads)"""
_PART = _text("part", "p_partkey", "p_name")


def _sql(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + _PART + "".join(more) + "\n" + select


_NEEDED = "SELECT DISTINCT row1 FROM groups JOIN rl ON rl.start BETWEEN l_left AND l_right"
SQL = {
    "corpus_layout": _sql("SELECT k, own, off FROM corpus"),
    "trigger_positions": _sql("SELECT k, t FROM trig", _PARSE),
    "phrase_occurrences": _sql("SELECT k, j, start, phrase FROM occ", _PARSE),
    "phrase_dictionary": _sql("SELECT * FROM dict1", _PARSE),
    "parse_l1": _sql("SELECT * FROM parse1", _PARSE),
    "phrase_suffixes": _sql("SELECT * FROM suffix1", _PARSE),
    "suffix_groups": _sql("SELECT * FROM g0", _PARSE),
    "group_ranges": _sql("SELECT row1, alpha, l_left, l_right FROM groups", _PARSE),
    "group_classes": _sql("SELECT kind, count(*) AS n_groups, CAST(sum(cnt) AS BIGINT) AS n_symbols FROM groups GROUP BY kind", _PARSE),
    "dictionary_l2": _sql("SELECT * REPLACE (array_to_string(toks, ',') AS toks) FROM dict2", _PARSE, _PARSE2),
    "parse_l2": _sql("SELECT * FROM parse2", _PARSE, _PARSE2),
    "m_table": _sql("SELECT * REPLACE (array_to_string(alpha2, ',') AS alpha2) FROM m", _PARSE, _PARSE2),
    "v_table": _sql("SELECT * FROM v", _PARSE, _PARSE2),
    "inverted_lists": _sql("SELECT pid2, k, pos2 FROM ilist", _PARSE, _PARSE2),
    "end_positions": _sql("SELECT pid2, pos2, end_pos FROM ilist", _PARSE, _PARSE2),
    "row2_expansion": _sql(
        f"SELECT row2, CAST(coalesce(sum(len - {W1}), 0) AS BIGINT) AS expands FROM (SELECT row2, unnest(list_concat(list_slice(alpha2, 1, len(alpha2) - {W2}), [0])) AS pid FROM (SELECT DISTINCT row2, alpha2 FROM m)) LEFT JOIN dict1 USING (pid) GROUP BY row2",
        _PARSE, _PARSE2),
    "bwt_easy_runs": _sql("SELECT l_left AS start, min(ch) AS ch, cnt AS len FROM groups JOIN bwt ON pos BETWEEN l_left AND l_right WHERE kind = 'easy' GROUP BY l_left, cnt", _PARSE, _BWT),
    "bwt_hard_easy_runs": _sql("SELECT start, min(ch) AS ch, cnt AS len FROM hard JOIN bwt ON pos BETWEEN start AND start + cnt - 1 WHERE n_pids = 1 GROUP BY start, cnt", _PARSE, _PARSE2, _BWT),
    "bwt_hard_hard_chars": _sql("SELECT pos AS start, ch, CAST(1 AS BIGINT) AS len FROM hard JOIN bwt ON pos BETWEEN start AND start + cnt - 1 WHERE n_pids > 1", _PARSE, _PARSE2, _BWT),
    "bwt_class_counts": _sql(
        "SELECT 'easy' AS tier, CAST(sum(cnt) AS BIGINT) AS n_symbols FROM groups WHERE kind = 'easy' HAVING count(*) > 0 UNION ALL SELECT CASE WHEN n_pids = 1 THEN 'hard_easy' ELSE 'hard_hard' END, CAST(sum(cnt) AS BIGINT) FROM hard GROUP BY 1",
        _PARSE, _PARSE2),
    "bwt_collection": _sql("SELECT pos, ch FROM bwt", _BWT),
    "bwt_from_suffix_array": _sql("SELECT pos, ch FROM bwt", _BWT),
    "rlbwt": _sql("SELECT run_id, ch, start, len FROM rl", _BWT),
    "run_heads": _sql("SELECT run_id, start FROM rl", _BWT),
    "run_stats": _sql("SELECT CAST(sum(len) AS BIGINT) AS n, count(*) AS r, max(len) AS longest FROM rl", _BWT),
    "suffix_array": _sql("SELECT pos, sa FROM bwt", _BWT),
    "sa_at_run_heads": _sql("SELECT run_id, sa FROM rl", _BWT),
    "groups_with_heads": _sql(f"SELECT row1, alpha FROM groups WHERE row1 IN ({_NEEDED})", _PARSE, _BWT),
    "skipped_portion": _sql(f"SELECT row1 IN ({_NEEDED}) AS needed, CAST(sum(cnt) AS BIGINT) AS n_symbols, count(*) AS n_groups FROM groups GROUP BY 1", _PARSE, _BWT),
    "chunk_plan": _sql(
        "SELECT chunk, row_start, row_end, l_left, l_right - l_left + 1 AS cnt FROM c", _PARSE,
        """,
size AS (SELECT CAST(sum(own) AS BIGINT) // 50 AS size, (SELECT max(row1) FROM groups) AS last, CAST(sum(own) AS BIGINT) AS n FROM corpus),
c AS (SELECT CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS row_start, CAST(0 AS BIGINT) AS l_left,
    coalesce((SELECT min(row1) FROM groups, size WHERE l_right > size), last) AS row_end, coalesce((SELECT min(l_right) FROM groups, size WHERE l_right > size), n - 1) AS l_right FROM size
  UNION ALL
  SELECT c.chunk + 1, c.row_end + 1, c.l_right + 1, coalesce(min(g.row1), last), coalesce(min(g.l_right), n - 1)
  FROM c, size LEFT JOIN groups g ON g.l_right > c.l_right + 1 + size.size WHERE c.row_end < last GROUP BY c.chunk, c.row_end, c.l_right, last, n)"""),
    "saved_runs_decoded": _sql("SELECT pos, ch FROM bwt", _BWT),
    "saved_samples": _sql("SELECT run_id, sa FROM rl", _BWT),
    "fasta_layout": _sql("SELECT k, own, off FROM corpus"),
    "fasta_rlbwt": "WITH " + _text("part", "p_partkey", "translate(p_name, ' ', '_')") + _BWT + "\nSELECT run_id, ch, start, len FROM rl",
    "given_dictionary": _sql("SELECT * FROM dict1", _PARSE),
    "given_dictionary_l2": _sql("SELECT * REPLACE (array_to_string(toks, ',') AS toks) FROM dict2", _PARSE, _PARSE2),
    "given_parse_l2": _sql("SELECT * FROM parse2", _PARSE, _PARSE2),
    "given_rlbwt": _sql("SELECT run_id, ch, start, len FROM rl", _BWT),
    "flat_runs": _sql("SELECT run_id, ch, start, len FROM rl", _BWT),
    "flat_samples": _sql("SELECT run_id, sa FROM rl", _BWT),
    "colex_order": _sql("SELECT * FROM colex2", _PARSE, _PARSE2, _COLEX),
    "m_intervals": _sql("SELECT row2, CAST(max(len(alpha2)) AS BIGINT) AS len_alpha2, min(colex2) AS left, max(colex2) AS right FROM m JOIN colex2 USING (pid2) GROUP BY row2", _PARSE, _PARSE2, _COLEX),
    "bwt_hard_hard_by_interval": _sql("SELECT pos AS start, ch, CAST(1 AS BIGINT) AS len FROM hard JOIN bwt ON pos BETWEEN start AND start + cnt - 1 WHERE n_pids > 1", _PARSE, _PARSE2, _BWT),
    "sa_lookup": _sql("SELECT pos, sa FROM bwt WHERE pos IN (SELECT l_left FROM groups UNION ALL SELECT l_right FROM groups)", _PARSE, _BWT),
    "skipped_by_level": _sql(
        f"""
SELECT level, count(*) AS n_rows, CAST(sum(cnt) AS BIGINT) AS n_symbols FROM (
  SELECT 'group' AS level, cnt FROM groups WHERE row1 NOT IN ({_NEEDED})
  UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM rl WHERE rl.start BETWEEN r.start AND r.start + r.cnt - 1) THEN 'expanded' ELSE 'row' END, cnt FROM every r WHERE row1 IN ({_NEEDED})) GROUP BY level""",
        _PARSE, _PARSE2, """,
wholes AS (SELECT row1, row2, l_left, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT row1, l_left, pid FROM groups JOIN suffix1 USING (alpha)) JOIN v USING (pid) GROUP BY ALL),
every AS (SELECT row1, row2, cnt, CAST(l_left + sum(cnt) OVER (PARTITION BY row1 ORDER BY row2) - cnt AS BIGINT) AS start FROM wholes)""", _BWT),
    "rlbwt_by_chunks": _sql("SELECT start, ch, len FROM rl", _BWT),
    "sa_by_chunks": _sql("SELECT pos, sa FROM bwt", _BWT),
    "rlbwt_access": _sql("SELECT pos, ch, run_id FROM (SELECT unnest(range((SELECT count(*) FROM bwt))) AS pos) JOIN rl ON pos BETWEEN start AND start + len - 1", _BWT).replace("SELECT pos, ch, run_id", "SELECT pos, rl.ch, run_id"),
    "bwt_by_document": """
WITH d AS (SELECT item_id, text || chr(2) AS t FROM benchmark),
r AS (SELECT item_id, t, unnest(range(length(t))) AS i FROM d),
b AS (SELECT item_id, substr(t, CASE WHEN i = 0 THEN length(t) ELSE i END, 1) AS ch,
  row_number() OVER (PARTITION BY item_id ORDER BY substr(t, i + 1) || substr(t, 1, i)) - 1 AS pos FROM r),
h AS (SELECT *, CASE WHEN lag(ch) OVER (PARTITION BY item_id ORDER BY pos) = ch THEN 0 ELSE 1 END AS head FROM b),
s AS (SELECT *, sum(head) OVER (PARTITION BY item_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS run FROM h)
SELECT item_id, CAST(run AS BIGINT) AS run_id, ch, min(pos) AS start, count(*) AS len FROM s GROUP BY item_id, run, ch""",
    "rlbwt_events": "WITH " + _text("events", "event_id", "event_type") + _BWT + "\nSELECT run_id, ch, start, len FROM rl",
    "sa_at_run_heads_events": "WITH " + _text("events", "event_id", "event_type") + _BWT + "\nSELECT run_id, sa FROM rl",
}
