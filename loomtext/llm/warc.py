"""Resolution of not-modified revisit records (WARC, HTTP 304).

Every revisit is joined, by canonical URL, with the latest full response that
was captured before it; if the validators agree it takes that response's
payload and its headers, updated with the permitted headers of the 304.

The as-of join is a running maximum in time order, over one row for each URL and
moment, which is made map-side. Time is cut in spans of ``SPAN`` moments: a window runs
within (URL, span), so it has at most ``SPAN`` rows however often a URL is
captured, and the last response of the spans before comes from one row per URL
and span. Records are then joined with their moment's row. Only record ids,
validators and headers are shuffled, never payloads.

Input columns of ``resolve``: record_id long, url string, ts long, kind
('response' or 'revisit'), etag, last_modified string, digest string, headers
map<string,string> with lower-case names. Others are ignored.

Defined cases (column ``resolution``): a response is 'response'; a revisit is
'resolved', or 'validator_mismatch', 'no_validator' (no validator on both
sides), 'unmatched' (no earlier response), 'no_url' or 'no_time'. A null kind,
or any other, is 'ignored'. Earlier means a smaller ts; of responses of one ts
the larger record_id counts; repeated rows give repeated results; a null digest
or headers stay null; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored, table

SPAN = 4096
# Query parameters that name no resource, and the stored headers
# that a 304 must not replace (RFC 9111, 3.2, and hop-by-hop headers).
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|sessionid|phpsessid|jsessionid)(=|$)"
UNCHANGED = ["content-length", "content-encoding", "content-type", "content-range", "connection", "proxy-connection", "keep-alive", "te", "transfer-encoding", "upgrade"]
_URL = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)[?]?([^#]*)"


def canonical(url: Column) -> Column:
    """Without scheme, www, default port, fragment, closing slashes and tracking
    parameters; the host in lower case, parameters in order. What isn't such a
    URL stays as it is."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), ":(80|443)?$", ""), "^www[0-9]*[.]", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 2), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(url, _URL, 3), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.when(url.rlike(_URL), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))).otherwise(url)


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """``record_id, canonical_url, kind, resolution, ref_id, digest, headers``."""
    r = records.select(
        "record_id", canonical(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), "kind",
        F.regexp_replace("etag", "^W/", "").alias("etag"), "last_modified", "digest", "headers",
    ).withColumn("part", F.floor(F.col("ts") / span))
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin("response", "revisit")
    apart = r.where(~F.coalesce(usable, F.lit(False)))
    r = r.where(usable)
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "digest", F.map_entries("headers").alias("entries")))
    moments = r.groupBy("canonical_url", "part", "ts").agg(F.max(full).alias("here"))
    over = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = moments.groupBy("canonical_url", "part").agg(F.max("here").alias("last")).select("canonical_url", "part", F.max("last").over(over).alias("carried"))
    within = Window.partitionBy("canonical_url", "part").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    latest = moments.withColumn("near", F.max("here").over(within)).join(before, ["canonical_url", "part"])
    # stored, so that the join below can split a moment of very many records
    latest = stored(latest.select("canonical_url", "ts", F.coalesce("near", "carried").alias("old")), "latest")
    r = r.join(latest, ["canonical_url", "ts"], "left")
    by_tag = F.col("etag").isNotNull() & F.col("old.etag").isNotNull()
    by_date = F.col("last_modified").isNotNull() & F.col("old.last_modified").isNotNull()
    agree = F.when(by_tag, F.col("etag") == F.col("old.etag")).when(by_date, F.col("last_modified") == F.col("old.last_modified"))
    resolution = (
        F.when(F.col("kind") == "response", "response")
        .when(F.col("old").isNull(), "unmatched")
        .when(agree.isNull(), "no_validator")
        .when(agree, "resolved")
        .otherwise("validator_mismatch")
    )
    r = r.withColumn("resolution", resolution)
    done = F.col("resolution") == "resolved"
    update = F.map_filter("headers", lambda k, _: ~k.isin(UNCHANGED))
    original = F.map_from_entries("old.entries")
    kept = F.map_filter(original, lambda k, _: F.coalesce(~F.map_contains_key(update, k), F.lit(True)))
    merged = F.coalesce(F.map_concat(kept, update), original, update)
    out = r.select(
        "record_id", "canonical_url", "kind", "resolution",
        F.when(F.col("kind") == "revisit", F.col("old.record_id")).alias("ref_id"),
        F.when(done, F.col("old.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(done, merged).otherwise(F.col("headers")).alias("headers"),
    )
    why = F.when(~F.coalesce(F.col("kind").isin("response", "revisit"), F.lit(False)), "ignored").when(F.col("kind") == "response", "response").when(F.col("canonical_url").isNull(), "no_url").otherwise("no_time")
    rest = apart.select("record_id", "canonical_url", "kind", why.alias("resolution"), F.lit(None).cast(r.schema["record_id"].dataType).alias("ref_id"), "digest", "headers")
    return out.unionByName(rest)


#: Captures of a page, and moments between two of them: some in one span, some not.
ROUNDS, STEP = 6, 900


def captures(pages: DataFrame) -> DataFrame:
    """``ROUNDS`` records of every page, ``STEP`` moments apart, full responses and
    304s in turn, starting at another turn for each page. A page changes between
    its rounds, and its validator with it: an ETag (weak in a 304 of an even
    round), or for every fourth page a date alone. So a 304 may follow a
    response of its version, of another, or none."""
    round_ = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ROUNDS - 1).cast("bigint"))).alias("round")
    p = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("body"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"), round_)
    version = F.floor((F.col("round") + F.col("page_id") % 2) / 2).cast("string")
    p = p.select("*", (F.col("page_id") + STEP * F.col("round")).alias("ts"), ((F.col("page_id") + F.col("round")) % 3 == 0).alias("full"), F.concat("body", F.lit("-"), version).alias("digest"))
    tag = F.when(F.col("page_id") % 4 != 0, F.concat(F.lit('"'), F.col("digest"), F.lit('"')))
    weak = F.when(~F.col("full") & (F.col("round") % 2 == 0), F.concat(F.lit("W/"), tag)).otherwise(tag)
    always = [F.lit("date"), F.col("ts").cast("string")]
    headers = F.when(F.col("full"), F.create_map(*always, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("size").cast("string"))).otherwise(F.create_map(*always, F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=60")))
    return p.select(
        (ROUNDS * F.col("page_id") + F.col("round")).alias("record_id"), "url", "ts", F.when(F.col("full"), "response").otherwise("revisit").alias("kind"), weak.alias("etag"),
        F.when(F.col("page_id") % 4 == 0, F.col("digest")).alias("last_modified"), F.when(F.col("full"), F.col("digest")).alias("digest"), headers.alias("headers"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    r = resolve(captures(table(spark, sf_dir, "pages")))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return r.select("record_id", "canonical_url", "kind", "resolution", "ref_id", "digest", shown.alias("headers"))


SQL = rf"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size,
    CASE WHEN regexp_matches(url, '{_URL}') THEN
      regexp_replace(regexp_replace(lower(regexp_extract(url, '{_URL}', 1)), ':(80|443)?$', ''), '^www[0-9]*[.]', '')
      || regexp_replace(regexp_extract(url, '{_URL}', 2), '/+$', '')
      || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '{_URL}', 3), '&'),
           lambda q: q <> '' AND NOT regexp_matches(lower(q), '{TRACKING}'))), '&'), ''), '')
    ELSE url END AS canonical_url
  FROM pages),
rec AS (
  SELECT {ROUNDS} * page_id + round AS record_id, canonical_url, page_id + {STEP} * round AS ts, (page_id + round) % 3 = 0 AS full_, page_id % 4 = 0 AS dated,
    digest || '-' || CAST((round + page_id % 2) // 2 AS VARCHAR) AS digest, size
  FROM p, (SELECT unnest(range({ROUNDS})) AS round)),
old AS (
  SELECT v.record_id, max(struct_pack(ts := r.ts, record_id := r.record_id, digest := r.digest, size := r.size, dated := r.dated)) AS r
  FROM rec v JOIN rec r ON r.canonical_url = v.canonical_url AND r.ts < v.ts WHERE r.full_ AND NOT v.full_ GROUP BY v.record_id),
told AS (
  SELECT rec.*, r, CASE WHEN full_ THEN 'response' WHEN canonical_url IS NULL THEN 'no_url' WHEN r IS NULL THEN 'unmatched' WHEN r.dated <> dated THEN 'no_validator'
    WHEN r.digest = digest THEN 'resolved' ELSE 'validator_mismatch' END AS resolution
  FROM rec LEFT JOIN old USING (record_id))
SELECT record_id, canonical_url, CASE WHEN full_ THEN 'response' ELSE 'revisit' END AS kind, resolution, r.record_id AS ref_id,
  CASE WHEN full_ OR resolution = 'resolved' THEN digest END AS digest,
  CASE WHEN full_ THEN 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts
    WHEN resolution = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || r.size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts
    ELSE 'cache-control: max-age=60' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || ts END AS headers
FROM told
"""
