"""robots.txt and sitemaps as sources: parsed texts become rows, decisions become joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.urls import default_sitemap, in_prefix, normalize_url, origin_of

SITEMAP_DOCUMENTS = 20


def robots_lines(robots: DataFrame) -> DataFrame:
    """(origin, n, field, value) of every `field: value` line, comments cut off. robots: (origin, body); a null body has none."""
    line = robots.select("origin", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("n", "line"))
    clean = F.trim(F.regexp_replace("line", r"#.*$", ""))
    return line.filter(F.contains(clean, F.lit(":"))).select("origin", "n", F.lower(F.trim(F.split(clean, ":", 2)[0])).alias("field"), F.trim(F.split(clean, ":", 2)[1]).alias("value"))


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(origin, rules, crawl_delay, sitemaps) for one agent, one row for each origin that has a robots.txt.

    Lines are grouped by the user-agent lines above them; the groups that name the agent count, else those for `*`. A
    file is one origin's and small, so its lines are folded in order inside one row.
    """
    lines = robots_lines(robots).groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("n", "field", "value"))).alias("lines"))
    rule = "struct<agents:array<string>,allow:boolean,path:string,delay:double>"
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("open"), F.array().cast(f"array<{rule}>").alias("rules"))

    def step(s: Column, x: Column) -> Column:
        named = x["field"] == "user-agent"
        agents = F.when(named & s["open"], F.concat(s["agents"], F.array(F.lower(x["value"])))).when(named, F.array(F.lower(x["value"]))).otherwise(s["agents"])
        row = F.struct(s["agents"].alias("agents"), F.when(x["field"] == "allow", True).when(x["field"] == "disallow", False).alias("allow"), x["value"].alias("path"), F.when(x["field"] == "crawl-delay", x["value"].try_cast("double")).alias("delay"))
        keep = x["field"].isin("allow", "disallow", "crawl-delay")
        return F.struct(agents.alias("agents"), F.when(named, True).when(keep, False).otherwise(s["open"]).alias("open"), F.when(keep, F.concat(s["rules"], F.array(row))).otherwise(s["rules"]).alias("rules"))

    folded = lines.select("origin", F.aggregate("lines", start, step, lambda s: s["rules"]).alias("all"), F.transform(F.filter("lines", lambda x: x["field"] == "sitemap"), lambda x: x["value"]).alias("sitemaps"))
    own = F.filter("all", lambda r: F.exists(r["agents"], lambda a: (a != "*") & F.contains(F.lit(agent.lower()), a)))
    mine = F.when(F.size(own) > 0, own).otherwise(F.filter("all", lambda r: F.array_contains(r["agents"], "*")))
    rules = F.filter(F.col("mine"), lambda r: r["allow"].isNotNull() & (r["path"] != ""))
    delay = F.filter(F.transform("mine", lambda r: r["delay"]), lambda d: d.isNotNull())
    return folded.withColumn("mine", mine).select("origin", F.transform(rules, lambda r: F.struct(r["allow"].alias("allow"), r["path"].alias("path"))).alias("rules"), F.round(F.try_element_at(delay, F.lit(1))).cast("long").alias("crawl_delay"), "sitemaps")


def _matches(path: Column, rule: Column) -> Column:
    """Prefix match with `*` and a closing `$`."""
    quoted = F.regexp_replace(rule, r"([.+?^(){}\[\]|\\])", r"\\$1")
    return F.rlike(path, F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\$(?!$)", r"\\$")))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, ...) with `allowed`: the longest matching rule decides, allow on a tie; no rule or no file allows."""
    path = F.coalesce(F.nullif(F.regexp_extract(normalize_url("url"), r"^[a-z]+://[^/]+(/.*)$", 1), F.lit("")), F.lit("/"))
    hits = F.filter("rules", lambda r: _matches(F.col("_path"), r["path"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow"))))
    joined = urls.withColumn("_origin", origin_of("url")).withColumn("_path", path).join(rules.select(F.col("origin").alias("_origin"), "rules"), "_origin", "left")
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_origin", "_path", "rules")


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """(sitemap, is_index, loc): every loc of each document (sitemap, body)."""
    return _located(sitemaps).drop("pos")


def _located(sitemaps: DataFrame) -> DataFrame:
    """(sitemap, is_index, loc, pos): every loc of each document (sitemap, body) in order, trimmed, empty ones dropped.

    Namespaces are ignored. A body that is not well-formed is read by pattern instead of by XPath.
    """
    body = F.col("body")
    locs = F.regexp_extract_all(body, F.lit(r"(?is)<(?:[\w.-]+:)?loc(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?loc\s*>"), F.lit(1))
    root = F.regexp_extract(body, r"(?s)^(?:\s|﻿|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<(?:[\w.-]+:)?([\w.-]+)", 1)
    entity = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, r"^<!\[CDATA\[|\]\]>$", ""), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return sitemaps.select("sitemap", (root == "sitemapindex").alias("is_index"), F.posexplode(locs).alias("pos", "loc")).withColumn("loc", F.trim(entity(F.trim("loc")))).filter("loc <> ''")


def sitemap_candidates(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """(url_prefix, pos, sitemap): those robots.txt lists in order, then the default place if it is not among them."""
    base = targets.select("url_prefix", origin_of("url_prefix").alias("origin"), default_sitemap("url_prefix").alias("_d"))
    listed = base.join(rules.select("origin", "sitemaps"), "origin", "left")
    every = F.array_distinct(F.concat(F.coalesce("sitemaps", F.array().cast("array<string>")), F.array("_d")))
    return listed.select("url_prefix", F.posexplode(every).alias("pos", "sitemap"))


def sitemap_seeds(candidates: DataFrame, documents: DataFrame, rules: DataFrame, most: int | None = 10_000, most_documents: int = SITEMAP_DOCUMENTS) -> DataFrame:
    """(url_prefix, url, ord): the first `most` pages (None: all) that sitemaps name for each prefix, in the order in which they are found.

    documents: (sitemap, body) as fetched. The first `most_documents` candidates are read in order; then those that their
    index documents name, one level deep, while no more than `most_documents` are read or waiting in all. URLs are
    normalized, kept in prefix and by robots.txt, and each once. A prefix's documents are few, and a document's size is
    bounded, so windows by prefix are too.
    """
    locs = _located(documents)
    nth = lambda *order: F.row_number().over(Window.partitionBy("url_prefix").orderBy(*order))
    once = lambda df, key, order: df.groupBy("url_prefix", key).agg(F.min(order).alias("_o"))
    first = once(candidates, "sitemap", "pos").withColumn("at", nth("_o") - 1).filter(F.col("at") < most_documents).select("url_prefix", "sitemap", "at")
    readable = lambda df: allowed(df.withColumnRenamed("sitemap", "url"), rules).filter("allowed").drop("allowed").withColumnRenamed("url", "sitemap")
    read = readable(first).join(locs, "sitemap")
    # a child counts against the limit even where it is a candidate that comes later; then it is read as that
    seen = first.select("url_prefix", F.col("sitemap").alias("loc"), F.col("at").alias("_seen"))
    children = read.filter("is_index").select("url_prefix", "at", "pos", "loc").join(seen, ["url_prefix", "loc"], "left").filter("_seen is null or _seen > at")
    waiting = children.withColumn("_n", nth("at", "pos")).filter(F.col("_n") + F.col("at") < most_documents).filter("_seen is null")
    second = once(waiting, "loc", "_n").select("url_prefix", F.col("loc").alias("sitemap"), F.col("_o").alias("at"))
    found = [df.filter("not is_index").select("url_prefix", F.lit(k).alias("round"), "at", "pos", "loc") for k, df in ((1, read), (2, readable(second).join(locs, "sitemap")))]
    urls = found[0].unionByName(found[1]).select("url_prefix", normalize_url("loc").alias("url"), F.struct("round", "at", "pos").alias("_o"))
    fine = allowed(once(urls.filter("url is not null").filter(in_prefix("url", "url_prefix")), "url", "_o"), rules).filter("allowed")
    numbered = fine.withColumn("ord", nth("_o") - 1).select("url_prefix", "url", "ord")
    return numbered if most is None else numbered.filter(F.col("ord") < most)
