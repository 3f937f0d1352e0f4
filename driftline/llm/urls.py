"""URL filters by a temporal list join.

A list is a log of dated changes: (pattern, action, day), where a pattern is a
host ("a.example", which covers its subdomains) or a host with a path beginning
("a.example/b/"), and action is "add" or "remove". intervals() turns each
pattern's changes into validity intervals; blocked() evaluates every capture
(url, fetched) against the entries that were active when it was fetched: the
keys a URL can match by (its host and the domains above it, its path's
beginnings) are joined with patterns, and the as-of condition keeps the interval
that holds the fetch day. DataFrame functions only.

Scale: keys are made where captures are read. A URL gets keys only for the
numbers of host labels and path levels that the list has, so even one with
thousands of levels gets few. Keys join on equality; answers are summed up by
URL and day, so a host with very many captures is no group of its own. The list
is the other side of the join and is cut off as a durable table, so that Spark
may broadcast it where it is small and split a crowded host's captures between
tasks where it is not.

Edge cases: null or malformed URLs and null fetch days match nothing; repeated
captures are answered once each; several changes of a pattern on one day count
as the last by action's order, "remove" after "add"; removing what is not listed
has no effect; an entry that is never removed stays valid. An empty list blocks
nothing. Extra columns pass through, those named blocked, matched, u or t give
way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import durable


def host(url: Column) -> Column:
    """The host in lower case, without user, port and a dot at its end; empty if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(found, r"\.$", "")


def path(url: Column) -> Column:
    """The path as it is written, without query and fragment."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys(url: Column, labels_in: list[int] | None = None, levels_in: list[int] | None = None) -> Column:
    """The patterns that would match a URL: all, or those with so many host labels and path levels (slashes) as named."""
    labels = F.split(host(url), r"\.")
    names = F.sequence(F.lit(1), F.size(labels)) if labels_in is None else F.array(*map(F.lit, labels_in)).cast("array<int>")
    names = F.filter(names, lambda n: (n >= 1) & (n <= F.size(labels)))
    domains = F.transform(names, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    levels = F.split(path(url), "/")
    depths = F.sequence(F.lit(1), F.greatest(F.size(levels) - 1, F.lit(1))) if levels_in is None else F.array(*map(F.lit, levels_in)).cast("array<int>")
    depths = F.filter(depths, lambda n: (n >= 1) & (n <= F.greatest(F.size(levels) - 1, F.lit(1))))
    begins = F.transform(depths, lambda n: F.concat(F.array_join(F.slice(levels, 1, n), "/"), F.lit("/")))
    under = F.flatten(F.transform(domains, lambda d: F.transform(begins, lambda b: F.concat(d, b))))
    whole = F.transform(domains, lambda d: F.concat(d, path(url)))
    return F.array_distinct(F.concat(domains, under, whole))


def shapes(patterns: DataFrame) -> tuple[list[int], list[int]]:
    """The numbers of host labels and of path levels that patterns have; a small number each."""
    hosts = F.substring_index("pattern", "/", 1)
    found = patterns.agg(F.collect_set(F.size(F.split(hosts, r"\."))).alias("labels"), F.collect_set(F.size(F.split("pattern", "/")) - 1).alias("levels")).first()
    return sorted(found["labels"]), sorted(found["levels"])


def intervals(changes: DataFrame) -> DataFrame:
    """(pattern, since, until) from (pattern, action, day): valid from since, up to but not on until (null: for good)."""
    by_day = changes.where("pattern is not null and day is not null").groupBy("pattern", "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("pattern").orderBy("day")
    turns = by_day.withColumn("before", F.lag("action").over(order)).where(~F.col("before").eqNullSafe(F.col("action")))
    closed = turns.withColumn("until", F.lead("day").over(order))
    return closed.where("action = 'add'").select("pattern", F.col("day").alias("since"), "until")


def blocked(captures: DataFrame, changes: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with blocked (boolean) and matched (the longest active pattern that matches, null if none)."""
    valid = durable(intervals(changes))
    labels, levels = shapes(valid)
    rows = captures.drop("blocked", "matched", "u", "t")
    asked = rows.select(F.col(url).alias("u"), F.col(fetched).alias("t")).where("u is not null and t is not null")
    asked = asked.where(host(F.col("u")) != "").select("u", "t", F.explode(keys(F.col("u"), labels, levels)).alias("pattern"))
    active = (F.col("since") <= F.col("t")) & (F.col("until").isNull() | (F.col("t") < F.col("until")))
    hits = asked.join(valid, "pattern").where(active)
    longest = F.max(F.struct(F.char_length("pattern").alias("n"), F.col("pattern").alias("p")))
    verdict = durable(hits.groupBy("u", "t").agg(longest.alias("best")).select("u", "t", F.col("best.p").alias("matched")))
    joined = rows.join(verdict, (rows[url] == verdict["u"]) & (rows[fetched] == verdict["t"]), "left").drop("u", "t")
    return joined.withColumn("blocked", F.col("matched").isNotNull())
