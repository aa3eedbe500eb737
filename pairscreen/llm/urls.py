"""URL filters in the manner of safe-browsing lists.

A URL is expanded into every (host suffix, path prefix) that a rule could
name: of as many labels and characters as some rule has. Expressions meet the rules on the first 32 bits of their digests; the
whole digest then confirms, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path. Without ``://``, or NULL: both empty."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def expressions(pairs: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """One row for every host suffix and path prefix of one of ``shapes``, a
    number of labels and one of characters: ``host, path, digest``."""
    listed = F.array(*[F.struct(F.lit(labels).alias("labels"), F.lit(size).alias("size")) for labels, size in shapes])
    fits = F.filter(listed, lambda s: (s.labels <= F.col("_labels")) & (s["size"] <= F.col("_size")))
    measured = pairs.withColumn("_labels", _labels(F.col("host"))).withColumn("_size", F.length("path"))
    return measured.withColumn("_shape", F.explode(fits)).select(
        "host", "path", _digest(F.expr("substring_index(host, '.', -_shape.labels)"),
                                F.substr("path", F.lit(1), F.col("_shape.size"))).alias("digest"))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All rows of ``pages`` with ``host, path, rule, verdict`` added; columns
    of these names are replaced.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all
    subdomains if the URL's path starts with the rule's, character by
    character. The longest rule (host and path) wins; of equally long ones the
    longer path, then the verdict and the text that sort last (``block`` before
    ``allow``). Rules with a NULL or empty host fit nothing; a NULL path is
    empty. Without a fitting rule, ``rule`` is NULL and ``verdict`` is
    ``default``. The driver receives the distinct shapes of rules (labels of the host, length of the path),
    and a URL is expanded into these only, however long its host. Repeated URLs
    are judged once, so a hot URL or host costs one row before the join.
    """
    host, path = url_host_path(F.col(url_col))
    new = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in new]
    # whole rows in one column, so that no column of theirs can clash
    rows = pages.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"),
                        host.alias("host"), path.alias("path"))
    columns = [F.col("row").getField(c).alias(c) for c in kept] + ["host", "path"]
    named = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> ''").withColumn(
        "rule", F.concat("host", "path")).withColumn("digest", _digest(F.col("host"), F.col("path")))
    shapes = sorted(tuple(r) for r in named.select(_labels(F.col("host")), F.length("path")).distinct().collect())
    if not shapes:
        return rows.select(*columns, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    listed = named.select(
        F.substring("digest", 1, 8).alias("_prefix"), F.col("digest").alias("_whole"),
        F.struct(F.length("rule").alias("size"), F.length("path").alias("path_size"), "verdict", "rule").alias("found"))
    pairs = rows.filter("host <> ''").select("host", "path").distinct()
    hits = expressions(pairs, shapes).withColumn("_prefix", F.substring("digest", 1, 8)).join(
        listed, "_prefix").filter("digest = _whole")
    best = hits.groupBy("host", "path").agg(F.max("found").alias("found"))
    return rows.join(best, ["host", "path"], "left").select(
        *columns, F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
