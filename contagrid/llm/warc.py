"""Resolution of not-modified revisits: each takes the body of the latest earlier full response of its address.

The as-of join by canonical URL is two passes of windows over captures dealt by ranges of URL and time, so that a URL
with a third of all captures, even all at one time, is no single task's work: within a URL and a range,
and over one row for each URL and range, which carries the last response on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contagrid.llm.common import hot_split_join, written

#: Headers a not-modified response may update; those that describe the body stay the stored ones.
PERMITTED = ("age", "cache-control", "date", "expires", "set-cookie", "vary", "via", "warning", "x-cache")
#: Query parameters that don't choose a page.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, tracking parameters and a last slash dropped; host in lower case."""
    bare = F.regexp_replace(F.trim(url), "(?s)#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    rest = F.regexp_extract(bare, r"(?s)^[^/?]*(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _weak(etag: Column) -> Column:
    """Entity tags compare weakly: without the mark of a weak one."""
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit of ``records``: record_id, url_key, outcome, response_id, digest, headers.

    ``records``: record_id, url, captured_at (timestamp), kind (``response`` or
    ``revisit``), status (int), digest (of the body) and headers (map with lower-case
    names). Full responses have kind response and status 200. A revisit refers to the
    latest of its canonical URL that is earlier, or of the same time and a smaller record_id;
    among equals the largest record_id. outcome is

    * ``resolved``: a validator both have is the same: the digest, else the entity
      tag (compared weakly), else last-modified;
    * ``changed``: the first validator both have differs;
    * ``unchecked``: they share no validator; taken as it is the latest;
    * ``missing``: there is no earlier response, or the URL or time is null.

    Resolved and unchecked revisits carry the response's headers with the permitted
    ones of their own over them and the response's digest; others have nulls.
    Repeated rows give repeated rows; columns besides those named are ignored; an
    empty table gives an empty result.
    """
    slim = records.select(
        "record_id", "captured_at", "kind", "status", "digest",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        canonical_url(F.col("url")).alias("url_key"),
    )
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    used = slim.where(full | (F.col("kind") == "revisit"))
    at = F.struct("captured_at", "record_id")
    timed = used.where("url_key IS NOT NULL AND captured_at IS NOT NULL")
    # Written, so that both passes and a repeated task see the same ranges.
    ranged = timed.repartitionByRange("url_key", "captured_at", "record_id").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "warc-ranges")
    response = F.when(full, F.struct("captured_at", "record_id", "digest", "headers"))
    part = Window.partitionBy("url_key", "part").orderBy("captured_at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("response", F.last(response, ignorenulls=True).over(part)).where(~full)

    ends = ranged.groupBy("url_key", "part").agg(F.max_by(response, F.when(full, at)).alias("response"))
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url_key", "part", F.last("response", ignorenulls=True).over(before).alias("carried")).where("carried IS NOT NULL")
    joined = hot_split_join(within, carried, ["url_key", "part"], "left")
    found = joined.withColumn("response", F.coalesce("response", "carried")).drop("carried", "part")
    lost = used.where((F.col("kind") == "revisit") & (F.col("url_key").isNull() | F.col("captured_at").isNull()))
    found = found.unionByName(lost.withColumn("response", F.lit(None).cast(found.schema["response"].dataType)))

    theirs, own = F.col("response.headers"), F.col("headers")
    same = F.coalesce(
        F.col("digest") == F.col("response.digest"),
        _weak(own["etag"]) == _weak(theirs["etag"]),
        own["last-modified"] == theirs["last-modified"],
    )
    outcome = (
        F.when(F.col("response").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("changed")
    )
    taken = F.col("outcome").isin("resolved", "unchecked")
    permitted = F.map_filter(own, lambda name, _: name.isin(*PERMITTED))
    stored = F.map_filter(theirs, lambda name, _: ~F.map_contains_key(permitted, name))
    return found.withColumn("outcome", outcome).select(
        "record_id", "url_key", "outcome",
        F.when(taken, F.col("response.record_id")).alias("response_id"),
        F.when(taken, F.col("response.digest")).alias("digest"),
        F.when(taken, F.map_concat(stored, permitted)).alias("headers"),
    )


#: Visits of a page in ``crawl``: responses at the even ones, revisits between them.
VISITS = 6


def crawl(pages: DataFrame) -> DataFrame:
    """Captures of ``pages`` (page_id, url, html) as records for ``resolve_revisits``: six visits each, an hour apart, pages a minute apart.

    So pages with one canonical URL are captured in turns. Visits 0, 2 and 4 are responses; where 5 divides
    page_id plus the visit's number they fail with status 503. A page whose id leaves 0 on division by 3
    has a new body from visit 2 on, one that leaves 1 from visit 4 on. A response has the digest of its body, an entity
    tag made of it and a last-modified. Visits 1, 3 and 5 are revisits that name what the client has: the body of the visit
    before; at visit 3 of an even page_id still that of visit 0. By page_id plus the visit's number, modulo 4, they name it
    by digest, entity tag, last-modified or not at all. record_id is six times page_id plus the visit's number; a
    null page_id gives records without id or time.
    """
    html = F.coalesce("html", F.lit(""))
    digests = F.array(*[F.sha2(F.concat(html, F.lit("\n" * v)).cast("binary"), 256) for v in (0, 1)])
    slim = pages.select("page_id", "url", F.octet_length(html).alias("octets"), digests.alias("digests"))
    page, rest = F.col("page_id"), F.coalesce(F.col("page_id") % 3, F.lit(2))
    at2, at4 = (rest == 0).cast("int"), (rest <= 1).cast("int")
    stale = F.coalesce(page % 2, F.lit(0))
    version = (F.lit(0), F.lit(0), at2, at2 * stale, at4, at4)

    def record(k: int) -> Column:
        body = F.get("digests", version[k])
        tag = F.concat(F.lit('"'), F.left(body, F.lit(16)), F.lit('"'))
        modified = F.concat(F.lit("version "), version[k].cast("string"))
        date = F.lit(f"visit {k}")
        if k % 2 == 0:
            headers = F.create_map(
                F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("last-modified"), modified,
                F.lit("content-length"), (F.col("octets") + version[k]).cast("string"), F.lit("date"), date,
            )
            status = F.when((page + k) % 5 == 0, 503).otherwise(200)
            return F.struct((page * VISITS + k).alias("record_id"), F.lit(k).alias("visit"), F.lit("response").alias("kind"), status.alias("status"), body.alias("digest"), headers.alias("headers"))
        by = (page + k) % 4
        named = F.when(by == 1, F.create_map(F.lit("etag"), tag)).when(by == 2, F.create_map(F.lit("last-modified"), modified)).otherwise(F.create_map().cast("map<string,string>"))
        headers = F.map_concat(F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), date), named)
        return F.struct((page * VISITS + k).alias("record_id"), F.lit(k).alias("visit"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.when(by == 0, body).alias("digest"), headers.alias("headers"))

    records = slim.select("url", "page_id", F.explode(F.array(*[record(k) for k in range(VISITS)])).alias("r"))
    return records.select("url", "r.*", F.timestamp_seconds(page * 60 + F.col("r.visit") * 3600).alias("captured_at")).drop("visit")
