"""Crawling as data: which targets are due, what a fetch means for a page, link splits, and the level-wise frontier."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.html import parsed_page
from tarn.functions.scalars import content_hash, fetch_outcome
from tarn.functions.urls import host_of, in_prefix, is_blacklisted, normalize_url, split_links

PAGES_PER_RUN = 1000
SITEMAP_SEEDS = 10_000
THROTTLED_MOST = 5


def checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tarn-checkpoint-"))
    return df.checkpoint()


def due_targets(targets: DataFrame, collections: DataFrame, now: int) -> DataFrame:
    """Enabled targets whose interval has passed, or that were never crawled, with their collection's name."""
    due = F.col("last_crawled_at").isNull() | (F.col("last_crawled_at") + F.col("recrawl_interval_s") <= now)
    names = collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection"))
    return targets.filter(F.col("enabled") & due).join(names, "collection_id")


def outcomes(fetches: DataFrame, pages: DataFrame) -> DataFrame:
    """fetches with `outcome` and the page row known before (prefix `old_`)."""
    old = pages.select("collection_id", "url", *[F.col(c).alias(f"old_{c}") for c in ("etag", "last_modified", "content_hash", "last_status", "last_crawled_at", "indexed_content_hash")])
    return fetches.withColumn("outcome", fetch_outcome("status", "content_type")).join(old, ["collection_id", "url"], "left")


def page_rows(seen: DataFrame, now: int) -> DataFrame:
    """What each outcome writes: a fresh page its new validators and hash; 304 and other statuses keep what was known;
    throttled answers and errors write nothing. indexed_content_hash is never touched here."""
    fresh = F.col("outcome") == "fresh"
    keep = lambda c: F.when(fresh, F.col(c)).otherwise(F.col(f"old_{c}"))
    return seen.filter(F.col("outcome").isin("fresh", "not_modified", "other_status")).select(
        "collection_id", "url", *[keep(c).alias(c) for c in ("etag", "last_modified", "content_hash")], F.col("status").cast("int").alias("last_status"), F.lit(now).cast("long").alias("last_crawled_at"), F.col("old_indexed_content_hash").alias("indexed_content_hash")
    )


def merge_pages(pages: DataFrame, written: DataFrame) -> DataFrame:
    """crawled_pages after a crawl: one row for each collection and url."""
    return pages.join(written.select("collection_id", "url"), ["collection_id", "url"], "left_anti").select(*written.columns).unionByName(written)


def needs_index(seen: DataFrame) -> DataFrame:
    """Fresh pages whose content is not what was last indexed; a page never indexed always is one."""
    return seen.filter((F.col("outcome") == "fresh") & ~F.col("old_indexed_content_hash").eqNullSafe(F.col("content_hash")))


def run_stats(seen: DataFrame) -> DataFrame:
    """One row: fetched (any answer but throttling and errors), indexed, not_modified, errored (no HTML, no answer, or not allowed)."""
    return seen.agg(
        F.count_if(F.col("outcome").isin("fresh", "not_modified", "other_status")).alias("fetched"),
        F.count_if((F.col("outcome") == "fresh") & ~F.col("old_indexed_content_hash").eqNullSafe(F.col("content_hash"))).alias("indexed"),
        F.count_if(F.col("outcome") == "not_modified").alias("not_modified"),
        F.count_if(F.col("outcome").isin("not_html", "error", "disallowed")).alias("errored"),
    )


def index_url(requested: Column, final: Column, canonical: Column, prefix: Column) -> Column:
    """The url a page is indexed under: where it redirected to if in prefix, else its canonical link if in prefix, else as asked."""
    redirect = F.when((final != requested) & in_prefix(final, prefix), normalize_url(final))
    own = F.when(in_prefix(canonical, prefix), normalize_url(canonical))
    return F.coalesce(redirect, own, normalize_url(requested), requested)


def extracted(fetches: DataFrame) -> DataFrame:
    """Fresh fetches with title, text, canonical, links and content_hash. The parse runs once, before any filter on it."""
    page = fetches.filter(F.col("outcome") == "fresh").withColumn("_page", parsed_page("body", F.coalesce("final_url", "url")))
    return page.select("*", "_page.*").drop("_page").withColumn("content_hash", content_hash("title", "text"))


def page_links(parsed: DataFrame) -> DataFrame:
    """(collection_id, source_url, target_url, link_text, pos) of every link, in order."""
    return parsed.select("collection_id", F.col("url").alias("source_url"), F.posexplode("links").alias("pos", "l")).select("collection_id", "source_url", F.col("l.url").alias("target_url"), F.col("l.text").alias("link_text"), "pos")


def link_fates(links: DataFrame, targets: DataFrame) -> DataFrame:
    """links with `fate`: follow (in some prefix of the collection), outlink (to be suggested), or ignored (blacklisted or no host)."""
    split = split_links(links, targets)
    outlink = host_of("target_url").isNotNull() & ~is_blacklisted("target_url")
    return split.withColumn("fate", F.when(F.col("in_prefix"), "follow").when(outlink, "outlink").otherwise("ignored")).drop("in_prefix")


def frontier(seeds: DataFrame, links: DataFrame, max_pages: int = PAGES_PER_RUN) -> DataFrame:
    """(url, level, ord): the order in which a breadth-first crawl of one prefix visits pages, at most `max_pages`.

    seeds: (url, pos). links: (source_url, target_url, pos), all in prefix. `ord` counts visits from 0. Within a level
    pages come in the order of the page that first linked them and of the link on it, as from a queue. Each level is
    one join of the new pages with their links and one anti-join with the pages seen, cut off from its lineage; it goes
    on until no page is new or the cap is reached.
    """
    first = lambda df, order: df.groupBy("url").agg(F.min(order).alias("_o"))

    def numbered(df: DataFrame, level: int, base: int) -> DataFrame:
        """The next pages in order, no more than the run may still visit: a bounded top-k, so one task may number it."""
        top = df.orderBy("_o").limit(max_pages - base)
        return top.select("url", F.lit(level).alias("level"), (F.lit(base - 1) + F.row_number().over(Window.orderBy("_o"))).cast("long").alias("ord"))

    seen = level_rows = checkpointed(numbered(first(seeds.select("url", F.col("pos").alias("p")), F.struct("p")), 0, 0))
    count = seen.count()
    level = 0
    while count < max_pages:
        level += 1
        out = links.join(level_rows.select(F.col("url").alias("source_url"), "ord"), "source_url").select(F.col("target_url").alias("url"), "ord", "pos")
        level_rows = checkpointed(numbered(first(out.join(seen, "url", "left_anti"), F.struct("ord", "pos")), level, count))
        added = level_rows.count()
        if not added:
            break
        seen, count = seen.unionByName(level_rows), count + added
    return seen


FETCHED = ("fresh", "not_modified", "other_status")
#: The longest that a throttled crawl waits before it asks again.
LONGEST_WAIT = 120


def followed(parsed: DataFrame) -> DataFrame:
    """(source_url, target_url, pos): what a crawl visits next from fresh pages (url, url_prefix, final_url, canonical, links).

    Where a page redirected to comes first (-2), then its canonical url (-1), then its links, each in prefix and once.
    """
    own = normalize_url("url")
    redirect = normalize_url("final_url")
    canonical = normalize_url("canonical")
    within = lambda c, *others: F.when(in_prefix(c, F.col("url_prefix")) & ~reduce(Column.__or__, [c.eqNullSafe(o) for o in others]), c)
    heads = F.array(F.struct(F.lit(-2).alias("pos"), within(redirect, own).alias("target_url")), F.struct(F.lit(-1).alias("pos"), within(canonical, own, redirect).alias("target_url")))
    first = parsed.select(F.col("url").alias("source_url"), F.explode(heads).alias("h")).select("source_url", "h.target_url", "h.pos").filter("target_url is not null")
    each = parsed.select("url", "url_prefix", F.posexplode("links").alias("pos", "l")).select(F.col("url").alias("source_url"), "url_prefix", normalize_url(F.col("l.url")).alias("target_url"), "pos")
    links = each.filter(in_prefix(F.col("target_url"), F.col("url_prefix"))).select("source_url", "target_url", "pos")
    return first.unionByName(links).groupBy("source_url", "target_url").agg(F.min("pos").alias("pos"))


def crawl_runs(seeds: DataFrame, answers: DataFrame, links: DataFrame, max_pages: int = PAGES_PER_RUN, most: int = THROTTLED_MOST) -> DataFrame:
    """(run, ord, level, url, outcome, throttled, waited): the visits of breadth-first crawls, each in its own order.

    seeds: (run, url, pos). answers: (url, throttled, retry_after, outcome): how often a page answers 429 before it answers
    otherwise. links: (source_url, target_url, pos), with redirects and canonical urls among them (see `followed`).

    A throttled page is asked again at once, after retry_after or 1, 2, 4, 8 seconds; `most` throttled answers without a
    page fetched between them end the run ("aborted"), as do `max_pages` pages fetched. Errors count for neither; a page
    without an answer is one. Only fresh pages lead on. The runs go level by level, all at once: one join of a level's
    fresh pages with their links, which are partitioned by source once, and one anti-join with the pages seen; order,
    cap and throttling are windows over a run's level.
    """
    outgoing = links.select("source_url", F.col("target_url").alias("url"), "pos").repartition("source_url").persist()
    order = Window.partitionBy("run").orderBy("_o")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ok = F.col("outcome").isin(*FETCHED).cast("long")
    so_far = lambda f, c, w: F.coalesce(f(c).over(w), F.lit(0))

    def visited(queue: DataFrame, state: DataFrame, level: int) -> DataFrame:
        asked = queue.join(answers, "url", "left").withColumn("outcome", F.coalesce("outcome", F.lit("error"))).withColumn("throttled", F.coalesce("throttled", F.lit(0)).cast("long"))
        counted = asked.join(state, "run").withColumn("_good", ok).withColumn("_done", so_far(F.sum, "_good", earlier)).withColumn("_n", F.row_number().over(order))
        # throttled answers since the last page fetched; what earlier levels left counts until the first page of this one
        strip = Window.partitionBy("run", "_done").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
        hits = counted.withColumn("_hits", F.sum("throttled").over(strip) + F.when(F.col("_done") == 0, F.col("carry")).otherwise(0))
        ends = hits.withColumn("_ends", (F.col("_hits") >= most).cast("int")).withColumn("_ended", so_far(F.max, "_ends", earlier))
        here = ends.filter((F.col("_ended") == 0) & (F.col("fetched") + F.col("_done") < max_pages))
        before, after = F.col("_hits") - F.col("throttled"), F.least(F.col("_hits"), F.lit(most - 1))
        waits = F.when(F.col("retry_after").isNotNull(), (after - before) * F.least(F.col("retry_after"), F.lit(LONGEST_WAIT))).otherwise((F.pow(F.lit(2), after) - F.pow(F.lit(2), before)).cast("long"))
        return here.select(
            "run", (F.col("visits") + F.col("_n") - 1).cast("long").alias("ord"), F.lit(level).alias("level"), "url", F.when(F.col("_ends") == 1, "aborted").otherwise(F.col("outcome")).alias("outcome"), (after - before).alias("throttled"),
            F.when(F.col("throttled") > 0, waits).otherwise(0).cast("long").alias("waited"), F.when((F.col("_good") == 1) & (F.col("_ends") == 0), 0).otherwise(F.col("_hits")).cast("long").alias("carry"),
        )

    def next_state(state: DataFrame, at: DataFrame) -> DataFrame:
        new = at.groupBy("run").agg(F.count("*").alias("_v"), F.sum(ok).alias("_f"), F.max_by("carry", "ord").alias("_c"), F.max((F.col("outcome") == "aborted").cast("int")).alias("_a"))
        left = state.join(new, "run").filter(F.col("_a") == 0)
        return left.select("run", (F.col("visits") + F.col("_v")).alias("visits"), (F.col("fetched") + F.col("_f")).alias("fetched"), F.col("_c").alias("carry")).filter(F.col("fetched") < max_pages)

    try:
        zero = F.lit(0).cast("long")
        state = seeds.select("run").distinct().select("run", zero.alias("visits"), zero.alias("fetched"), zero.alias("carry"))
        queue = seeds.groupBy("run", "url").agg(F.min(F.struct(F.lit(0).cast("long").alias("ord"), F.col("pos"))).alias("_o"))
        at, level = checkpointed(visited(queue, state, 0)), 0
        seen = at
        while not at.isEmpty():
            level += 1
            state = checkpointed(next_state(state, at))
            fresh = at.filter("outcome = 'fresh'").join(state.select("run"), "run", "left_semi")
            out = outgoing.join(fresh.select("run", F.col("url").alias("source_url"), "ord"), "source_url")
            queue = out.groupBy("run", "url").agg(F.min(F.struct("ord", "pos")).alias("_o")).join(seen.select("run", "url"), ["run", "url"], "left_anti")
            at = checkpointed(visited(queue, state, level))
            seen = seen.unionByName(at)
    finally:
        outgoing.unpersist()
    return seen.drop("carry")


def run_ends(visits: DataFrame, max_pages: int = PAGES_PER_RUN) -> DataFrame:
    """(run, fetched, errored, throttled, waited, ended): how each run of `crawl_runs` went and why it ended."""
    good = F.col("outcome").isin(*FETCHED)
    return visits.groupBy("run").agg(
        F.count_if(good).alias("fetched"), F.count_if(~good & (F.col("outcome") != "aborted")).alias("errored"), F.sum("throttled").alias("throttled"), F.sum("waited").alias("waited"),
        F.when(F.max(F.col("outcome") == "aborted"), "aborted").when(F.count_if(good) >= max_pages, "cap").otherwise("done").alias("ended"),
    )


def reached(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(url, level): every page that the seeds (url) lead to by links (source_url, target_url), until no page is new.

    Each level is one join and one anti-join; the links are partitioned by source once, for all levels. Without an order
    of visits no page has to be numbered.
    """
    outgoing = links.select("source_url", F.col("target_url").alias("url")).repartition("source_url").persist()
    try:
        at, level = checkpointed(seeds.select("url", F.lit(0).alias("level")).distinct()), 0
        seen = at
        while not at.isEmpty():
            level += 1
            out = outgoing.join(at.select(F.col("url").alias("source_url")), "source_url").select("url").distinct()
            at = checkpointed(out.join(seen, "url", "left_anti").select("url", F.lit(level).alias("level")))
            seen = seen.unionByName(at)
    finally:
        outgoing.unpersist()
    return seen


def throttle_aborts(fetches: DataFrame, most: int = THROTTLED_MOST) -> DataFrame:
    """(collection_id, aborted_at): the first fetch, by `seq`, at which `most` throttled answers had come in a row."""
    w = Window.partitionBy("collection_id").orderBy("seq")
    hit = F.col("status") == 429
    island = F.sum(F.when(hit, 0).otherwise(1)).over(w)
    runs = fetches.withColumn("_i", island).withColumn("_r", F.sum(F.when(hit, 1).otherwise(0)).over(Window.partitionBy("collection_id", "_i").orderBy("seq")))
    return runs.filter(F.col("_r") >= most).groupBy("collection_id").agg(F.min("seq").alias("aborted_at"))


def retargeted(targets: DataFrame, redirects: DataFrame) -> DataFrame:
    """targets with url_prefix moved to its canonical form; a move onto a prefix that is (or becomes) taken is skipped."""
    moves = targets.join(redirects, "url_prefix", "left").withColumn("_to", F.coalesce("canonical", "url_prefix"))
    taken = Window.partitionBy("collection_id", "_to")
    rivals = moves.withColumn("_own", F.max((F.col("_to") == F.col("url_prefix")).cast("int")).over(taken)).withColumn("_k", F.row_number().over(taken.orderBy(F.desc(F.col("_to") == F.col("url_prefix")), "id")))
    free = (F.col("_k") == 1) | (F.col("_to") == F.col("url_prefix"))
    return rivals.withColumn("url_prefix", F.when(free, F.col("_to")).otherwise(F.col("url_prefix"))).select(*targets.columns)
