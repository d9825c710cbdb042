"""Revisit resolution: a capture that says "not modified" gets the response it refers to.

Records are matched by canonical URL to the latest earlier full response. The match holds
if the validators agree: an ETag in both has to be equal (weakly compared, as a 304 answer
is), a payload digest in both has to be equal, and where neither is in both, an equal
Last-Modified will do. A resolved revisit gets the response's headers, updated by those of
its own that a 304 answer may change, and points to the response that holds the payload.

The as-of step carries record numbers and validators only. Time is cut into slices at
quantiles of the captures' times, so a record dated 1970 or 9999 moves no cut; inside
(URL, slice) a window finds the latest response, and where there is none the latest one of
an earlier slice is taken from a table of one row per (URL, slice). So a URL with a third
of all captures is spread over its slices; captures of one microsecond stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.ranking import even_parts

SLICES = 256
#: Header fields that a not-modified answer may update (RFC 9110, 15.4.5; RFC 9111, 3.2).
UPDATED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")


def canonical_url(url: Column) -> Column:
    """Scheme and www. off, host lower-cased without default port, no fragment, no tracking parameters, sorted query.

    Null stays null. A trailing / of the path is dropped; an empty query too.
    """
    bare = F.regexp_replace(F.regexp_replace(url, r"#(?s:.*)$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www[0-9]*\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?((?s:.*))$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^utm_[a-z]+=")))
    return F.when(F.size(kept) > 0, F.concat(host, path, F.lit("?"), F.array_join(kept, "&"))).otherwise(F.concat(host, path))


def header(headers: Column, name: str) -> Column:
    """The first value of a header field, null without one."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def merged_headers(old: Column, new: Column) -> Column:
    """``old`` with its updatable fields replaced by those in ``new``, sorted by lower-cased name."""
    names = [F.lit(n) for n in UPDATED]
    low = lambda hs: F.transform(hs, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    fresh = F.filter(low(new), lambda h: h["name"].isin(*names))
    fresh_names = F.transform(fresh, lambda h: h["name"])
    return F.array_sort(F.concat(F.filter(low(old), lambda h: ~F.array_contains(fresh_names, h["name"])), fresh))


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """A row per revisit of ``records``: ``record_id, url, response_id, outcome, headers``.

    ``records(record_id long, kind, url, at timestamp, status int, headers
    array<struct<name, value>>, digest)``, with kind ``response`` or ``revisit``; a full
    response has status 200 and a payload digest. ``outcome`` is ``resolved``; ``mismatch``
    if the latest earlier response has other validators; ``unchecked`` if no validator is in
    both; ``missing`` if there is no earlier response. Only ``resolved`` rows have merged
    ``headers``. "Earlier" is by (at, record_id), so ties in time go by number. Records
    without url, time or number are no candidates; a revisit without url or time is
    ``missing``. Null headers count as none. Repeated rows of a response are one; each
    repeated revisit is answered, and different revisits that share a number get each other's
    answers too, a row per answer. Other columns are not returned, whatever their names; an
    empty table gives an empty one.
    """
    kind = (F.when((F.col("kind") == "response") & (F.col("status") == 200) & F.col("digest").isNotNull(), F.lit(1))
            .when(F.col("kind") == "revisit", F.lit(2)))
    none = F.lit([]).cast("array<struct<name:string,value:string>>")
    rows = records.select(
        "record_id", kind.alias("k"), canonical_url(F.col("url")).alias("url"), F.col("at").cast("timestamp").alias("at"),
        F.coalesce("headers", none).alias("headers"), "digest").where("k is not null")
    etag = F.regexp_replace(header(F.col("headers"), "etag"), "^W/", "")
    slim = rows.select("record_id", "k", "url", "at", etag.alias("etag"), header(F.col("headers"), "last-modified").alias("modified"), "digest",
                       F.unix_micros("at").alias("us"))
    dated = slim.where("url is not null and at is not null and record_id is not null")
    placed = dated.withColumn("slice", even_parts(dated, "us", slices))
    full = F.when(F.col("k") == 1, F.struct("us", "record_id", "etag", "modified", "digest"))
    last = placed.groupBy("url", "slice").agg(F.max(full).alias("last"))
    before = W.partitionBy("url").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("url", "slice", F.max("last").over(before).alias("carried"))
    inside = W.partitionBy("url", "slice").orderBy("us", "record_id", "k").rowsBetween(W.unboundedPreceding, -1)
    matched = (placed.withColumn("near", F.max(full).over(inside)).where("k = 2").join(carried, ["url", "slice"])
               .withColumn("hit", F.coalesce("near", "carried")))
    both = lambda name: F.col(name).isNotNull() & F.col(f"hit.{name}").isNotNull()
    equal = lambda name: F.col(name) == F.col(f"hit.{name}")
    strong = both("etag") | both("digest")
    agrees = (~both("etag") | equal("etag")) & (~both("digest") | equal("digest")) & (strong | equal("modified"))
    outcome = (F.when(F.col("hit").isNull(), "missing").when(~strong & ~both("modified"), "unchecked")
               .when(agrees, "resolved").otherwise("mismatch"))
    judged = matched.select("record_id", outcome.alias("outcome"), F.col("hit.record_id").alias("response_id")).distinct()
    heads = rows.where("k = 1").groupBy(F.col("record_id").alias("response_id")).agg(F.min("headers").alias("old"))
    out = (rows.where("k = 2").join(judged, "record_id", "left").join(heads, "response_id", "left"))
    outcome = F.coalesce("outcome", F.lit("missing"))
    return out.select("record_id", "url", "response_id", outcome.alias("outcome"),
                      F.when(outcome == "resolved", merged_headers(F.col("old"), F.col("headers"))).alias("headers"))
