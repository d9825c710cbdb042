"""URL filtering against a rule list, with DataFrame functions only.

A URL is expanded into every host suffix at a label boundary, combined with a prefix of
its path for each length that a rule path has; a rule fits exactly if one of these
expressions is its own. Expressions meet the rules over the first four bytes of their
SHA-256 in an equi-join, the full digest is compared next, and the longest rule wins.

Each distinct (host, path) is judged once, so a URL or host that makes up a third of all
rows costs one judgement; the verdicts go back to the rows by an equi-join that adaptive
execution can split. Only verdicts of URLs that some rule fits take part.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT = "allow"


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From the first :// to the next /, ? or #, A-Z lower-cased; empty without :// or url."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return _ascii_lower(host)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without :// or url."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` per row of ``pages(page_id, url)``.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains where the url's
    path starts with its path. Among the rules that fit, the longest host + path wins; of
    two equal ones ``block`` (the later verdict in the alphabet). ``rule`` is host + path.
    Without a rule that fits, ``rule`` is null and the verdict is ``default``. A null url or
    one without ``://`` has an empty host and path, which no rule with a host fits. Rules
    with a null in any column are left out. Repeated rows and null page_ids are judged row
    by row; extra columns are not returned.
    """
    split = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    known = rules.select(_ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).dropna()
    keyed = known.select("*", F.sha2(F.concat_ws(" ", "rule_host", "rule_path"), 256).alias("digest"))
    keyed = keyed.select("rule_host", "rule_path", "rule_verdict", "digest", F.substring("digest", 1, 8).alias("short"))
    # Labels in the host and length of the path: the shapes that expressions can need.
    # A host has 127 labels at most and a path is as long as a rule's, however many rules there are.
    shapes = known.select(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("length")).distinct()
    shapes = F.from_json(F.lit(json.dumps([row.asDict() for row in shapes.collect()])), "array<struct<labels:int,length:int>>")
    urls = split.select("host", "path").where("host != ''").distinct()
    labels = F.split("host", r"\.")
    expressions = F.transform(
        F.filter(shapes, lambda s: (s["labels"] <= F.size(labels)) & (s["length"] <= F.length("path"))),
        lambda s: F.concat_ws(" ", F.array_join(F.slice(labels, F.size(labels) - s["labels"] + 1, s["labels"]), "."),
                              F.substring(F.col("path"), F.lit(1), s["length"])))
    expanded = urls.select("host", "path", F.explode(expressions).alias("expression"))
    hashed = expanded.select("host", "path", F.sha2("expression", 256).alias("full"))
    fits = (hashed.withColumn("short", F.substring("full", 1, 8)).join(keyed, "short").where("full = digest")
            .select("host", "path", F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), "rule_verdict",
                                             F.concat("rule_host", "rule_path").alias("rule")).alias("fit")))
    best = fits.groupBy("host", "path").agg(F.max("fit").alias("fit"))
    return split.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.rule_verdict", F.lit(default)).alias("verdict"))
