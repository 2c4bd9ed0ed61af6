"""URL filtering with pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with literal tokens it can't match without.
Token frequencies over all urls name each rule's rarest token; a url's tokens fetch the rules filed
under them, and only those run. Of the rules that fit, the longest name wins (ties: the first name).

Null urls and urls without ``://`` have an empty host and path, and no rule. Different urls are
judged once, so repeated ones are no hot spot. The frequency table that is read back holds rule
tokens only. Columns besides ``page_id`` and ``url`` are not read.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, columns_of, small


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool   # named in results; other rules only give the verdict


def host_rule(place: str, verdict: str) -> Rule:
    """A host with its subdomains and the start of a path, like ``example.net/en/``."""
    host, path = place.split("/", 1)
    quoted = [re.sub(r"([^A-Za-z0-9_])", r"\\\1", x) for x in (host, "/" + path)]
    return Rule(place, verdict, rf"^([^/]*\.)?{quoted[0]}{quoted[1]}", tuple(re.findall("[a-z0-9]+", host)), True)


def pattern_rule(name: str, verdict: str, pattern: str, *tokens: str) -> Rule:
    return Rule(name, verdict, pattern, tokens, False)


def parts(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return ascii_lower(rest), path


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per page."""
    columns_of(pages, ["page_id", "url"])
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    sites = pages.select(host.alias("host"), path.alias("path")).distinct().withColumn("place", F.concat("host", "path"))
    words = sites.select("host", "path", "place", F.explode(_tokens(F.col("place"))).alias("token"))
    known = sorted({t for r in rules for t in r.tokens})
    count = {r["token"]: r["n"] for r in words.filter(F.col("token").isin(known)).groupBy("token").agg(F.count("*").alias("n")).collect()}
    filed = spark.createDataFrame(
        [(min(r.tokens, key=lambda t: (count.get(t, 0), t)), r.name, r.verdict, r.pattern, r.listed) for r in rules],
        "token string, name string, verdict string, pattern string, listed boolean")
    fits = words.join(small(filed), "token").filter(F.expr("regexp_like(place, pattern)"))
    best = fits.groupBy("host", "path").agg(
        F.min(F.when(F.col("listed"), F.struct((-F.length("name")).alias("l"), "name", "verdict"))).alias("listed"),
        F.min(F.when(~F.col("listed"), F.struct((-F.length("name")).alias("l"), "name", "verdict"))).alias("other"))
    every = pages.select("page_id", host.alias("host"), path.alias("path"))
    return every.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("listed.name").alias("rule"),
        F.coalesce("listed.verdict", "other.verdict", F.lit(default)).alias("verdict"))
