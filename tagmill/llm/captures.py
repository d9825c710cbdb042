"""A crawl log derived from the given pages, to have revisits to resolve.

Each page is captured several times under variants of its URL: a full response, answers
"not modified" with validators that agree, differ or are lacking, and for some a later full
response with changed content. All choices are taken from md5 of the page number, so SQL
can build the same log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def captures(pages: DataFrame) -> DataFrame:
    """``(record_id, kind, url, at, status, headers, digest)``, seven records per page."""
    bits = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 8), 16, 10).cast("long")
    base = pages.select("page_id", "url", F.md5("html").alias("digest"), bits.alias("b"))
    events = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("e"))
    full = F.col("e").isin(0, 3)
    version = F.when(F.col("e") >= 3, F.lit("b")).otherwise(F.lit("a"))
    day = F.col("b") % 300 + F.col("e") * (1 + F.col("b") % 3)
    etag = F.concat(F.lit('"'), F.substring("digest", 1, 8), version, F.lit('"'))
    shown = F.when((F.col("e") + F.col("b")) % 5 == 0, F.lit('"other"')).when((F.col("e") + F.col("b")) % 2 == 0, F.concat(F.lit("W/"), etag)).otherwise(etag)
    named = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    response = F.array(named("Content-Type", F.lit("text/html")), named("ETag", etag), named("Cache-Control", F.lit("max-age=60")), named("Date", day))
    bare = F.array(named("Date", day), named("Server", F.lit("edge")))
    revisit = F.when((F.col("e") + F.col("b")) % 7 == 0, bare).otherwise(
        F.array(named("Date", day), named("ETag", shown), named("Cache-Control", F.lit("max-age=90")), named("Server", F.lit("edge"))))
    return events.select(
        (F.col("page_id") * 10 + F.col("e")).alias("record_id"), F.when(full, "response").otherwise("revisit").alias("kind"),
        F.concat("url", F.when(F.col("e") == 2, "#again").otherwise("")).alias("url"),
        F.timestamp_seconds(day * 86400).alias("at"), F.when(full, 200).otherwise(304).alias("status"),
        F.when(full, response).otherwise(revisit).alias("headers"), F.when(full, F.concat("digest", version)).alias("digest"))
