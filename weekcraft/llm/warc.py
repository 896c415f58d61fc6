"""Resolution of not-modified revisits to the full responses they refer to.

A revisit (a 304 capture) is joined as of its time with the latest strictly earlier full response of the
same canonical URL. Then its validators are checked: the entity tag where the revisit has one (weak
prefixes ignored), else the modification date. A revisit that passes gets the
response's headers with the permitted ones of the 304 over them, names compared in lower case; ``PROTECTED`` headers
describe the body or the connection and stay as the response had them.

The as-of join sorts inside (URL, time slice) and carries the last response of each slice to
the next ones by a table with one row per URL and slice, so the captures of one URL, which may be
a third of all, are split by time. Only record data moves; bodies stay where they are.

status: ``resolved``, ``stale`` (the validators differ), ``unchecked`` (the revisit has no
validator or the response lacks the one it names), ``missing`` (no earlier response, or a null URL or
time). Of responses with one URL and time the largest record id counts; repeated revisits are
resolved one by one. An empty table gives an empty result.

``captures`` derives a stream of such records from the table of pages: a response per page, and a
revisit of its URL that comes before or after later captures.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weekcraft.llm.common import cut_points, read_table

#: Headers that a 304 never changes, and query parameters that do not name a resource.
PROTECTED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
             "proxy-authorization", "set-cookie", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = r"^(ref|utm_[a-z]+|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host (lower case, without www. and its scheme's default port), path without a last slash, and sorted query without tracking."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    named = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", "")
    host = F.when(F.trim(url).rlike("(?i)^https://"), F.regexp_replace(named, ":443$", "")).otherwise(F.regexp_replace(named, ":80$", ""))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda q: (q != "") & ~F.lower(q).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def resolve_revisits(records: DataFrame, slices: int | None = None) -> DataFrame:
    """Revisits of ``records`` (record_id long, url, kind 'response' or 'revisit', time long, etag,
    last_modified, headers map) with response_id, status and merged headers.
    """
    rows = records.select("record_id", "kind", F.col("time").cast("long").alias("time"), "etag", "last_modified", "headers",
                          canonical_url(F.col("url")).alias("canonical_url"))
    if slices is None:
        slices = int(max(64, rows.count() // 1_000_000))
    cuts = cut_points(rows, "time", slices)

    @F.pandas_udf("int")
    def slice_of(time: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, time.fillna(0).to_numpy().astype(np.float64), side="right").astype(np.int32))

    rows = rows.withColumn("slice", slice_of("time"))
    is_response = F.col("kind") == "response"
    full = F.struct(F.col("time"), F.col("record_id"), F.col("etag"), F.col("last_modified"), F.col("headers"))
    known = F.col("canonical_url").isNotNull() & F.col("time").isNotNull()
    # Revisits sort before responses of their time: those are not earlier.
    order = Window.partitionBy("canonical_url", "slice").orderBy("time", is_response.cast("int"), "record_id")
    here = rows.where(known).withColumn("own", F.last(F.when(is_response, full), ignorenulls=True).over(order)).where(F.col("kind") == "revisit")
    newest = F.max_by(full, F.struct("time", "record_id"))
    per_slice = rows.where(known & is_response).groupBy("canonical_url", "slice").agg(newest.alias("carried"))
    # One row per URL and slice that holds a capture; ``carried`` is the last response of the slices before.
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (rows.where(known).select("canonical_url", "slice").distinct().join(per_slice, ["canonical_url", "slice"], "left")
             .withColumn("carried", F.last("carried", ignorenulls=True).over(before)))
    found = here.join(carry, ["canonical_url", "slice"], "left").withColumn("response", F.coalesce("own", "carried")).drop("own", "carried", "slice")
    lost = rows.where(~known & (F.col("kind") == "revisit")).drop("slice").withColumn("response", F.lit(None).cast(found.schema["response"].dataType))
    return found.unionByName(lost).select(*_checked())


def _checked() -> list[Column]:
    strong = lambda c: F.regexp_replace(c, r"^W/", "")
    response = F.col("response")
    status = (F.when(response.isNull(), "missing")
              .when(F.col("etag").isNotNull(), F.when(response["etag"].isNull(), "unchecked").when(strong(F.col("etag")) == strong(response["etag"]), "resolved").otherwise("stale"))
              .when(F.col("last_modified").isNotNull(), F.when(response["last_modified"].isNull(), "unchecked")
                    .when(F.col("last_modified") == response["last_modified"], "resolved").otherwise("stale"))
              .otherwise("unchecked"))
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(response["headers"], empty), F.coalesce(F.col("headers"), empty)
    fresh = F.map_filter(new, lambda k, v: ~F.lower(k).isin(*PROTECTED))
    replaced = F.transform(F.map_keys(fresh), lambda k: F.lower(k))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(replaced, F.lower(k))), fresh)
    return [F.col("record_id").alias("revisit_id"), "canonical_url", "time", response["record_id"].alias("response_id"), response["time"].alias("response_time"),
            status.alias("status"), F.when(status == "resolved", merged).alias("headers")]


def captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl made from pages: response 2 * page_id at minute page_id, revisit 2 * page_id + 1.

    The revisit comes 30 s to 70 min after its page (every 11th 30 s before it). Every 5th names another entity
    tag, every 7th only a date, every 13th nothing.
    """
    p = F.col("page_id")
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), F.floor(p / 50).cast("string"))
    page = pages.select(p.cast("long").alias("page_id"), "url", tag.alias("tag"), day.alias("day"), F.length(F.coalesce(F.col("html"), F.lit(""))).cast("string").alias("size"))
    p = F.col("page_id")
    text = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    responses = page.select(
        (2 * p).alias("record_id"), "url", F.lit("response").alias("kind"), (60 * p).alias("time"), F.col("tag").alias("etag"), F.col("day").alias("last_modified"),
        text("cache-control", "max-age=60", "content-length", F.col("size"), "content-type", "text/html", "date", (60 * p).cast("string"), "etag", F.col("tag")).alias("headers"))
    at = F.when(p % 11 == 0, 60 * p - 30).otherwise(60 * p + 30 + (p % 8) * 600)
    named = F.when((p % 7 == 0) | (p % 13 == 0), F.lit(None)).when(p % 5 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    revisits = page.select(
        (2 * p + 1).alias("record_id"), F.regexp_replace("url", "#.*$", "").alias("url"), F.lit("revisit").alias("kind"), at.alias("time"), named.alias("etag"),
        F.when(p % 13 != 0, F.col("day")).alias("last_modified"),
        text("cache-control", "max-age=600", "content-length", "0", "content-type", "text/plain", "date", at.cast("string"), "x-cache", "HIT").alias("headers"))
    return responses.unionByName(revisits)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-modified revisits resolved to the latest earlier full response of their canonical URL, headers merged."""
    found = resolve_revisits(captures(read_table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.withColumn("headers", lines)


ORACLE = {"op3_warc_revisits": r"""
WITH p AS (SELECT page_id, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || CAST(page_id // 50 AS VARCHAR) AS day,
             CAST(length(coalesce(html, '')) AS VARCHAR) AS size, regexp_replace(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '#.*$', '') AS rest,
             regexp_matches(trim(url), '(?i)^https://') AS tls FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), CASE WHEN tls THEN ':443$' ELSE ':80$' END, '')
             || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
             list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
               lambda q: q <> '' AND NOT regexp_matches(lower(q), '^(ref|utm_[a-z]+|fbclid|gclid)(=|$)'))) AS q FROM p),
u AS (SELECT page_id, tag, day, size, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM c),
r AS (SELECT url, 60 * page_id AS t, max(2 * page_id) AS id, arg_max(tag, page_id) AS tag, arg_max(day, page_id) AS day, arg_max(size, page_id) AS size FROM u GROUP BY 1, 2),
v AS (SELECT url, 2 * page_id + 1 AS id, CASE WHEN page_id % 11 = 0 THEN 60 * page_id - 30 ELSE 60 * page_id + 30 + (page_id % 8) * 600 END AS t,
        CASE WHEN page_id % 7 = 0 OR page_id % 13 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"changed"' ELSE tag END AS tag,
        CASE WHEN page_id % 13 <> 0 THEN day END AS day FROM u),
j AS (SELECT v.*, r.id AS rid, r.t AS rt, r.tag AS rtag, r.day AS rday, r.size AS rsize FROM v ASOF LEFT JOIN r ON v.url = r.url AND v.t > r.t),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'missing' WHEN tag IS NOT NULL THEN CASE WHEN tag = rtag THEN 'resolved' ELSE 'stale' END
        WHEN day IS NOT NULL THEN CASE WHEN day = rday THEN 'resolved' ELSE 'stale' END ELSE 'unchecked' END AS status FROM j)
SELECT id AS revisit_id, url AS canonical_url, t AS time, rid AS response_id, rt AS response_time, status,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || rsize || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || CAST(t AS VARCHAR) || chr(10) || 'etag: ' || rtag || chr(10) || 'x-cache: HIT' END AS headers
FROM s
"""}
