"""Robots rules from the texts of robots.txt files, and whether paths may be fetched under them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _lines(files: DataFrame) -> DataFrame:
    """(site, at, field, value) of a file's lines that say something: comments are cut, names are in small letters."""
    line = files.select("site", F.posexplode(F.split("body", "\\r\\n|\\r|\\n")).alias("at", "line")).withColumn("line", F.regexp_replace("line", "#.*", ""))
    at = F.instr("line", ":")
    told = line.filter(at > 0).select("site", "at", F.lower(F.btrim(F.substring("line", F.lit(1), at - 1), F.lit(" \t"))).alias("field"), F.btrim(F.substring("line", at + 1, F.length("line")), F.lit(" \t")).alias("value"))
    return told.filter(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))


def _ours(files: DataFrame, agent: str) -> DataFrame:
    """The lines of the groups that are meant for the agent. Consecutive user-agent lines head one group. Groups that
    name the agent, or a part of its name, come before those for everyone, wherever they stand in the file."""
    order = Window.partitionBy("site").orderBy("at")  # a file's lines
    head = F.col("field") == "user-agent"
    starts = head & ~F.coalesce(F.lag("field").over(order) == "user-agent", F.lit(False))
    lines = _lines(files).withColumn("group", F.sum(starts.cast("int")).over(order))
    name = F.lower("value")
    ours = head & (name != "*") & (name != "") & F.contains(F.lit(agent.lower()), name)
    groups = lines.groupBy("site", "group").agg(F.bool_or(ours).alias("named"), F.bool_or(head & (name == "*")).alias("everyone"))
    sites = groups.groupBy("site").agg(F.bool_or("named").alias("any_named"))
    chosen = groups.join(sites, "site").filter(F.when(F.col("any_named"), F.col("named")).otherwise(F.col("everyone"))).select("site", "group")
    return lines.join(chosen, ["site", "group"])


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(site, pattern, allow) for an agent from the files (site, body) of all sites. A body that is null could not be
    read: nothing of the site may be fetched. Rules without a pattern say nothing, and so does a file that has no group
    for the agent nor for everyone."""
    rules = _ours(files, agent).filter(F.col("field").isin("allow", "disallow") & (F.col("value") != ""))
    unread = files.filter(F.col("body").isNull()).select("site", F.lit("/").alias("pattern"), F.lit(False).alias("allow"))
    return rules.select("site", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allow")).unionByName(unread)


def crawl_delays(files: DataFrame, agent: str) -> DataFrame:
    """(site, seconds) where the last number that a site's rules for the agent give says how long to wait, rounded up."""
    told = _ours(files, agent).filter("field = 'crawl-delay'").withColumn("seconds", F.ceil(F.expr("try_cast(value AS double)")).cast("int"))
    return told.filter("seconds is not null").groupBy("site").agg(F.max_by("seconds", "at").alias("seconds"))


def _wild(pattern: Column) -> Column:
    return pattern.contains("*") | pattern.endswith("$")


def robots_allows(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """``paths`` (site, path and more) with ``allowed``: the longest pattern that fits decides, allowing wins ties, and
    no rule allows. ``*`` and a final ``$`` are wild cards; an empty path is the root.

    Patterns without wild cards are prefixes: a path is cut to each length that its site's patterns have, and meets them
    by equality. A site's patterns with wild cards are tried one by one.
    """
    once = rules.filter(F.col("pattern") != "").groupBy("site", "pattern").agg(F.bool_or("allow").alias("allow")).withColumn("n", F.length("pattern"))
    prefixes, wild = once.filter(~_wild(F.col("pattern"))), once.filter(_wild(F.col("pattern")))
    path = F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path"))
    asked = paths.select("site", "path", path.alias("whole")).distinct()
    lengths = prefixes.groupBy("site").agg(F.collect_set("n").alias("lengths"))
    cut = asked.join(lengths, "site").select("site", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("whole"))).alias("n"), "whole")
    met = cut.withColumn("pattern", F.substring(F.col("whole"), F.lit(1), F.col("n"))).join(prefixes.select("site", "pattern", "allow"), ["site", "pattern"]).select("site", "path", "n", "allow")
    quoted = F.regexp_replace("pattern", "([.?+^()\\[\\]{}|\\\\]|\\$(?!$))", "\\\\$1")
    rx = F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")))
    book = wild.groupBy("site").agg(F.collect_list(F.struct(rx.alias("rx"), "n", "allow")).alias("rules"))  # a file's lines
    tried = asked.join(book, "site").select("site", "path", F.explode(F.filter("rules", lambda r: F.regexp_like(F.col("whole"), r["rx"]))).alias("r")).select("site", "path", "r.n", "r.allow")
    best = met.unionByName(tried).groupBy("site", "path").agg(F.max(F.struct("n", "allow")).alias("best"))
    return paths.join(best, ["site", "path"], "left").withColumn("allowed", F.coalesce(F.col("best.allow"), F.lit(True))).drop("best").select(*paths.columns, "allowed")
