"""Not-modified revisit records resolved to the responses they refer to.

A revisit gets the latest earlier full response of the same canonical URL (an as-of join), its
validators are checked, and of its headers those a 304 may update replace the response's. The as-of
join runs in two steps, over chunks of time per URL and inside a chunk, so that a URL with a large
part of all records is no single task; only headers and digests are moved, never payloads.

``status`` is resolved (validators agree), mismatch, unverified (no validator in common) or orphan
(no earlier response). Of responses at one time the larger record id is taken. A null URL or date
makes an orphan. Header names are matched without case, and of names that differ only in case the
first one of the map counts; null headers are none. Repeated rows repeat. Columns other than those
named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SECONDS = 6 * 3600
# The headers a 304 response updates.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Host and path in one spelling: no scheme, www., default port, fragment, tracking parameters
    or final slash; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(/[^?]*)?", 1), r"/+$", "")
    asked = F.filter(
        F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"),
        lambda p: (p != "") & ~F.lower(p).rlike(r"^(?:utm_[a-z]*|ref|fbclid|gclid)(?:=|$)"),
    )
    query = F.array_join(F.array_sort(asked), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), r"^W/", "")


def _lower_names(headers: Column) -> Column:
    """``headers`` with names in lower case; of names that become equal the first one stays."""
    names = F.transform(F.map_keys(headers), F.lower)
    values = F.map_values(headers)
    once = F.array_distinct(names)
    first = F.transform(once, lambda k: F.get(values, (F.array_position(names, k) - 1).cast("int")))
    return F.when(F.size(once) == F.size(names), F.map_from_arrays(names, values)).otherwise(
        F.map_from_arrays(once, first)
    )


def resolve(records: DataFrame) -> DataFrame:
    """Every revisit of ``records`` (record_id, type, url, date, headers, digest) with url_key,
    status, refers_to, digest and headers (map) after merging."""
    lower = _lower_names(F.coalesce("headers", F.create_map().cast("map<string,string>")))
    rows = records.select(
        "record_id",
        (F.col("type") == "response").alias("full"),
        canonical_url(F.col("url")).alias("url_key"),
        F.col("date"),
        lower.alias("headers"),
        "digest",
    ).where(F.col("full") | (F.col("type") == "revisit"))
    usable = F.col("url_key").isNotNull() & F.col("date").isNotNull()
    lost = rows.where(~usable & ~F.col("full")).withColumn("found", F.lit(None).cast(
        "struct<record_id:string,headers:map<string,string>,digest:string>"
    ))
    rows = (
        rows.where(usable)
        .withColumn("chunk", F.floor(F.unix_timestamp("date") / CHUNK_SECONDS))
        .where("chunk is not null")
        .repartition("url_key", "chunk")  # one exchange serves both uses of the rows
    )
    response = F.when(
        F.col("full"),
        F.struct(F.col("record_id").cast("string").alias("record_id"), "headers", "digest"),
    )
    before = Window.partitionBy("url_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy("url_key", "chunk")
        .agg(F.max_by(response, F.when(F.col("full"), F.struct("date", "record_id"))).alias("latest"))
        .select("url_key", "chunk", F.last("latest", ignorenulls=True).over(before).alias("carried"))
    )
    # A response is not earlier than a revisit of the same time.
    inside = Window.partitionBy("url_key", "chunk").orderBy("date", "full", "record_id")
    near = F.last(response, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    found = (
        rows.withColumn("near", near)
        .where("not full")
        .join(carried, ["url_key", "chunk"])
        .withColumn("found", F.coalesce("near", "carried"))
        .drop("near", "carried", "chunk")
    )
    own, theirs = F.col("headers"), F.col("found.headers")
    modified = [F.try_element_at(h, F.lit("last-modified")) for h in (own, theirs)]
    agree = F.coalesce(_tag(own) == _tag(theirs), modified[0] == modified[1])
    status = (
        F.when(F.col("found").isNull(), "orphan")
        .when(agree, "resolved")
        .when(agree.isNull(), "unverified")
        .otherwise("mismatch")
    )
    updates = F.map_filter(own, lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(theirs, lambda k, _: ~F.array_contains(F.map_keys(updates), k))
    resolved = F.col("status") == "resolved"
    return found.unionByName(lost).withColumn("status", status).select(
        "record_id",
        "url_key",
        "date",
        "status",
        F.when(F.col("status") != "orphan", F.col("found.record_id")).alias("refers_to"),
        F.when(resolved, F.col("found.digest")).alias("digest"),
        F.when(resolved, F.map_concat(kept, updates)).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Records derived from ``pages``: a response per page, a minute apart, and four revisits: one
    before it, one each with the same, a weak and a foreign entity tag after it."""
    day = 86400
    at = F.lit(1704067200) + F.col("page_id") * 60
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))

    def record(name: str, type_: str, shift: int, tag: Column, extra: dict[str, str]) -> Column:
        headers = {"ETag": tag, "Date": (at + shift).cast("string")}
        headers |= {k: F.lit(v) for k, v in extra.items()}
        return F.struct(
            F.concat(F.lit(f"{name}-"), F.col("page_id").cast("string")).alias("record_id"),
            F.lit(type_).alias("type"),
            F.timestamp_seconds(at + shift).alias("date"),
            F.create_map(*(x for k, v in headers.items() for x in (F.lit(k), v))).alias("headers"),
        )

    fresh = {"Cache-Control": "max-age=60", "Content-Length": "0", "Set-Cookie": "seen=1"}
    made = F.array(
        record("full", "response", 0, etag, {"Content-Type": "text/html", "Cache-Control": "no-cache"}),
        record("early", "revisit", -day, etag, fresh),
        record("same", "revisit", 3600, etag, fresh),
        record("weak", "revisit", day, F.concat(F.lit("W/"), etag), {"Vary": "Accept"}),
        record("other", "revisit", 7 * day, F.lit('"other"'), fresh),
    )
    return pages.select("url", F.md5(F.coalesce("html", F.lit(""))).alias("payload"), F.explode(made).alias("r")).select(
        "r.record_id", "r.type", "url", "r.date", "r.headers",
        F.when(F.col("r.type") == "response", F.col("payload")).alias("digest"),
    )


def report(pages: DataFrame) -> DataFrame:
    """The resolved revisits with headers as sorted lines."""
    lines = F.array_join(
        F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n"
    )
    return resolve(captures(pages)).select(
        "record_id", "url_key", F.unix_timestamp("date").alias("seconds"), "status", "refers_to", "digest",
        lines.alias("headers"),
    )
