"""Resolving not-modified revisits of a web archive.

A revisit record says that a page had not changed. Its content is that of the latest earlier full response of the same
canonical url, if the validators agree; the headers of the revisit then update those of the response, except
those that describe the stored body. The as-of join sorts all records by url and time into ranges of even size, which
may cut through a url, looks back within each range, and carries the last response over from the ranges before:
a url with a third of all records is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise

RANGE_ROWS = 20_000
# Headers that describe the stored body and so stay the response's.
BODY_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")
# Query parameters that do not choose the content.
TRACKING = "utm_[^&=]*|ref|gclid|fbclid"


def canonical_url(url: Column) -> Column:
    """Url without fragment, scheme, ``www.``, default port, tracking parameters and final slashes; host in lower case.

    Null stays null, and so urls that are null belong together with nothing.
    """
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^[^/?]*", 0)
    rest = F.substr(bare, F.length(host) + 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(host), "^www[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(rest, f"([?&])(?:{TRACKING})=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), "[?]&+", "?"), "[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, "/+$", ""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, url_key, status, refers_to, headers) for every revisit of ``records``.

    ``records``: record_id, kind ('response' or 'revisit'), url, time, etag, last_modified, headers (map, names in any
    case). Earlier means a smaller (time, record_id). status is 'resolved'; 'mismatch' where the latest earlier
    response has another validator: the etags differ where both have one, else the last-modified times where both have one;
    'unchecked' where they share no validator; or 'missing' without an earlier response, a url or a time. Only
    resolved revisits refer to a response and have headers: the response's, updated by the revisit's
    but for those in BODY_HEADERS, names in lower case (of names equal but for case, the greatest value).
    Records of other kinds, and null kinds, are ignored. A record that occurs twice is answered twice. An empty table gives no rows.
    """
    spark = records.sparkSession
    lowered = F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    best = F.aggregate(
        F.array_sort(lowered), F.create_map().cast("map<string,string>"),
        lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e))),
    )
    rows = records.where("kind in ('response', 'revisit')").select(
        "record_id", "kind", canonical_url(F.col("url")).alias("url_key"), "time", "etag", "last_modified",
        F.coalesce(best, F.create_map().cast("map<string,string>")).alias("headers"),
    )
    dated = "url_key is not null and time is not null"
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    order = ["time", "record_id"]
    spread = rows.where(dated).repartitionByRange(ranges, "url_key", *order).withColumn("part", F.spark_partition_id())
    spread = materialise(spread, "captures")

    response = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "headers"))
    inside = Window.partitionBy("url_key", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = spread.withColumn("near", F.last(response, ignorenulls=True).over(inside))
    place = F.when(F.col("kind") == "response", F.struct(*order))
    ends = spread.groupBy("url_key", "part").agg(F.max_by(response, place).alias("end"))
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url_key", "part", F.last("end", ignorenulls=True).over(before).alias("carried"))
    met = near.where("kind = 'revisit'").join(carried, ["url_key", "part"]).withColumn("found", F.coalesce("near", "carried"))
    met = met.unionByName(rows.where(f"kind = 'revisit' and not ({dated})"), allowMissingColumns=True)

    same_etag = F.col("etag") == F.col("found.etag")
    same_time = F.col("last_modified") == F.col("found.last_modified")
    status = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.coalesce(same_etag, same_time).isNull(), "unchecked")
        .when(F.coalesce(same_etag, same_time), "resolved")
        .otherwise("mismatch")
    )
    fresh = F.map_filter("headers", lambda k, _: ~k.isin(*BODY_HEADERS))
    kept = F.map_filter("found.headers", lambda k, _: ~F.map_contains_key(fresh, k))
    done = F.col("status") == "resolved"
    return met.withColumn("status", status).select(
        "record_id", "url_key", "status", F.when(done, F.col("found.record_id")).alias("refers_to"), F.when(done, F.map_concat(kept, fresh)).alias("headers")
    )


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of a crawl of ``pages``, all derived from the pages' own columns.

    Each page was fetched once, at a time that follows from its id, and asked for again under another spelling of its
    url, at a time that follows from the content's digest and may lie before the fetch. The digest also
    says which validators were sent and whether the content had changed.
    """
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    letter = F.substr(digest, F.lit(1), F.lit(1))
    first = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60)
    day = F.concat(F.lit("day-"), F.substr(digest, F.lit(2), F.lit(2)))
    size = F.length(F.coalesce("html", F.lit(""))).cast("string")
    pages = pages.select("page_id", "url", "html")
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", first.alias("time"), digest.alias("etag"), day.alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), size, F.lit("ETag"), digest, F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
    )
    again = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60 + F.when(letter == "0", -30).otherwise(3600))
    etag = F.when(letter.isin("1", "2"), None).when(letter == "3", F.lit("changed")).otherwise(digest)
    modified = F.when(letter == "1", None).otherwise(day)
    asked = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat("url", F.lit("#again")).alias("url"), again.alias("time"), etag.alias("etag"), modified.alias("last_modified"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.concat(F.lit("max-age=6"), letter), F.lit("Date"), again.cast("long").cast("string")).alias("headers"),
    )
    return full.unionByName(asked)


def header_text(headers: Column) -> Column:
    """Headers as one line of name=value in order of the names."""
    pairs = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(pairs, ";")


CHECK_SQL = f"""
with p as (select page_id, url, coalesce(html, '') as html, md5(coalesce(html, '')) as d from pages),
records as (
    select page_id * 2 as record_id, 'response' as kind, url, 1700000000 + page_id * 60 as time, d as etag,
        'day-' || substr(d, 2, 2) as last_modified, length(html) as size, d from p
    union all
    select page_id * 2 + 1, 'revisit', url || '#again', 1700000000 + page_id * 60 + case when substr(d, 1, 1) = '0' then -30 else 3600 end,
        case when substr(d, 1, 1) in ('1', '2') then null when substr(d, 1, 1) = '3' then 'changed' else d end,
        case when substr(d, 1, 1) = '1' then null else 'day-' || substr(d, 2, 2) end, 0, d from p),
bare as (select *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as b from records),
cut as (select *, regexp_extract(b, '^[^/?]*') as h from bare),
tail as (select *, regexp_replace(substr(b, length(h) + 1), '([?&])(?:{TRACKING})=[^&]*', '\\1', 'g') as r from cut),
clean as (select *, regexp_replace(regexp_replace(lower(h), '^www[.]', ''), ':(80|443)$', '')
    || regexp_replace(regexp_replace(regexp_replace(regexp_replace(r, '&&+', '&', 'g'), '[?]&+', '?', 'g'), '[?&]+$', ''), '/+$', '') as url_key from tail),
met as (select *, last_value(case when kind = 'response' then {{'id': record_id, 'etag': etag, 'lm': last_modified, 'size': size}} end ignore nulls)
    over (partition by url_key order by time, record_id rows between unbounded preceding and 1 preceding) as f from clean),
told as (select *, case when f is null then 'missing' when coalesce(etag = f.etag, last_modified = f.lm) is null then 'unchecked'
    when coalesce(etag = f.etag, last_modified = f.lm) then 'resolved' else 'mismatch' end as status from met where kind = 'revisit')
select record_id, url_key, status, case when status = 'resolved' then f.id end as refers_to,
    case when status = 'resolved' then 'cache-control=max-age=6' || substr(d, 1, 1) || ';content-length=' || f.size || ';content-type=text/html;date='
        || time || ';etag=' || f.etag end as headers
from told
"""
