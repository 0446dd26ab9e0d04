"""Crawl closure: pages reached over allowed same-site links.

The first ROUNDS rounds are plain breadth-first search: the frontier is joined to
the edges of its pages, what was seen is dropped (anti-join), and only the new
frontier is written. A site that is deeper than that has long chains of pages
(archives, calendars), and a round for each page of a chain would be as many jobs
as pages. So what is left is contracted:

* A page with one link to it, among links to pages not yet reached, can be reached
  in one way only. Its distance to the page that this way comes from, over as many
  such pages as there are, is found by pointer jumping: every jump doubles the way,
  so a chain of n pages takes log2(n) jumps. Pages whose way never ends stand in a
  circle that nothing leads into; they are not reached.
* Links to pages with several links to them become links between the pages where
  such ways begin, with the length of the way. Least distances over these are found
  in rounds in which only pages that came nearer send on.
* Contracted pages get the distance of the page their way comes from and the way's.

All tables are written to the shared folder, so plans stay short and a lost executor
costs no earlier round.
"""

from __future__ import annotations

import itertools
import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..plans.options import AuditOptions, SiteContext
from ..sources.tables import StartPage
from ..storage import stored
from .labels import fetch_flags, flag, packed

#: Plain rounds; tables of a union before they are merged.
ROUNDS, MERGED = 8, 32


@dataclass
class Timer:
    """Ends a search after some seconds; `expired` says whether it did."""

    seconds: float | None = None
    expired: bool = False

    def __post_init__(self):
        self._end = None if self.seconds is None else time.monotonic() + self.seconds

    def over(self) -> bool:
        self.expired = self.expired or (self._end is not None and time.monotonic() >= self._end)
        return self.expired


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, timer: Timer | None = None) -> DataFrame:
    """node, depth for everything reached from seeds(node) over edges(src, dst),
    each node at its least depth; with max_depth, only up to that depth. When the
    timer ends the search, what was reached by then."""
    timer = timer or Timer()
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    frontier = stored(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen = [frontier]
    for depth in range(1, (ROUNDS if max_depth is None else min(max_depth, ROUNDS)) + 1):
        if timer.over():
            break
        new = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, seen)
        frontier = stored(new.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return known
        seen.append(frontier)
    known = reduce(DataFrame.unionByName, seen)
    if timer.over() or (max_depth is not None and max_depth <= ROUNDS):
        return known
    far = _contracted(edges, known, frontier, timer)
    return known.unionByName(far if max_depth is None else far.where(F.col("depth") <= max_depth))


def _contracted(edges: DataFrame, known: DataFrame, frontier: DataFrame, timer: Timer) -> DataFrame:
    """node, depth of what is reached beyond the known nodes."""
    # Known nodes but the frontier have been left by all their edges already.
    rest = stored(edges.where("src <> dst").distinct().join(known.select(F.col("node").alias("dst")), "dst", "left_anti"), "rest")
    by_target = rest.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("up"))
    way = stored(by_target.where("n = 1").select(F.col("dst").alias("node"), "up", F.lit(1).cast("long").alias("dist")), "way")
    most = way.count()
    for jump in itertools.count(1):
        # A way that is not at its end after 2 ** jump > most steps is a circle.
        further = way.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"))
        way = stored(way.join(further, "up", "left").select("node", F.coalesce("up2", "up").alias("up"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.col("up2").isNotNull().alias("going")), "way")
        if timer.over() or (1 << jump) > most or way.where("going").isEmpty():
            break
        way = way.drop("going")
    ends = way.select(F.col("node").alias("end"))
    way = stored(way.select("node", "up", "dist").join(ends, way["up"] == ends["end"], "left_anti"), "way")
    crossings = rest.join(way.select(F.col("node").alias("dst")), "dst", "left_anti")
    starts = crossings.join(way.withColumnRenamed("node", "src"), "src", "left").select(F.coalesce("up", "src").alias("src"), "dst", (F.coalesce("dist", F.lit(0)) + 1).alias("dist"))
    links = stored(starts.groupBy("src", "dst").agg(F.min("dist").alias("dist")), "links")
    nearer = stored(frontier.select("node", F.col("depth").cast("long").alias("depth")), "nearer")
    found = [nearer]
    while not timer.over():
        offers = nearer.join(links, nearer["node"] == links["src"]).select(F.col("dst").alias("node"), (F.col("depth") + F.col("dist")).alias("depth")).groupBy("node").agg(F.min("depth").alias("depth"))
        best = reduce(DataFrame.unionByName, found).groupBy("node").agg(F.min("depth").alias("had"))
        nearer = stored(offers.join(best, "node", "left").where("had is null or depth < had").select("node", "depth"), "nearer")
        if nearer.isEmpty():
            break
        found = [*found, nearer] if len(found) < MERGED else [stored(reduce(DataFrame.unionByName, [*found, nearer]).groupBy("node").agg(F.min("depth").alias("depth")), "nearer")]
    best = stored(reduce(DataFrame.unionByName, found).groupBy("node").agg(F.min("depth").alias("depth")), "best")
    inner = way.join(best.withColumnRenamed("node", "up"), "up").select("node", (F.col("depth") + F.col("dist")).alias("depth"))
    outer = best.join(frontier.select("node"), "node", "left_anti")
    return outer.unionByName(inner).select("node", F.col("depth").cast("int").alias("depth"))


def crawl(flagged: DataFrame, rules: DataFrame, site: SiteContext, options: AuditOptions = AuditOptions(), fetches: DataFrame | None = None, timer: Timer | None = None) -> DataFrame:
    """group_name, depth and bits (visited, robotsDisallowed and, with fetches,
    the outcome of each visit) of the link targets reached from the start page.
    flagged has the elements of parsed pages (tables.parsed): others are reached
    but have no links. Targets on another port of the host are neither visited
    nor refused. Refused targets count where a reached page links to them. A crawl
    that the options' deadline ends is incomplete: timer.expired says so."""
    from .robots import allowed, path_of

    timer = timer or Timer(options.deadline)
    links = flagged.where((F.col("kind") == "link") & flag("internal") & (F.col("url_scheme") == site.scheme))
    chosen = "selected" in flagged.columns  # groups of selected links keep their fragment
    target = urls.without_fragment(F.col("url_prop")) if chosen else F.col("group_name")
    links = urls.with_normalised(links.select("document", "group_name", "url_prop"), F.col("document"), "_page").select(
        urls.without_fragment(F.col("_page")).alias("src"), target.alias("dst"), "group_name", "url_prop"
    )
    own = rules.where(F.col("origin") == site.origin).select("allow", "disallow")
    none = F.expr("cast(array() as array<string>)")
    user = F.array(*map(F.lit, options.disallow)) if options.disallow else none
    policy = own.agg(F.coalesce(F.flatten(F.collect_list("allow")), none).alias("allow"), F.concat(F.coalesce(F.flatten(F.collect_list("disallow")), none), user).alias("disallow"))
    # The policy is one row for the site, joined by a constant key.
    decided = links.withColumn("_one", F.lit(1)).join(F.broadcast(policy.withColumn("_one", F.lit(1))), "_one")
    path = path_of(F.col("url_prop"), site.origin)
    may = decided.where(path.isNotNull()).withColumn("may", F.lit(True) if options.ignore_robots and not options.disallow else allowed(path, F.col("allow"), F.col("disallow")))
    # Pages are read once: rounds join the decided links, not the pages.
    may = stored(may.select("src", "dst", "may", "group_name").distinct(), "decided")
    edges = may.where("may").select("src", "dst")
    start = StartPage(site.start_page).row(flagged.sparkSession).select(urls.without_fragment(F.col("url")).alias("node"))
    limit = options.max_depth if options.recursive else 1
    reached = closure(edges, start, limit, timer)
    read = reached if limit is None else reached.where(F.col("depth") < limit)
    refused = may.where("not may").join(read, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("group_name")).distinct().withColumn("refused", F.lit(True))
    out = reached.select(F.col("node").alias("group_name"), "depth").join(refused, "group_name", "full")
    if chosen:
        marked = may.where("group_name <> dst").select(F.col("dst").alias("bare"), F.col("group_name").alias("marked")).distinct()
        out = out.unionByName(out.join(marked, F.col("group_name") == F.col("bare")).select(F.col("marked").alias("group_name"), "depth", "refused"))
    out = out.select("group_name", "depth", packed({"visited": F.col("depth").isNotNull(), "robotsDisallowed": F.col("refused")}).alias("bits"))
    if fetches is None:
        return out
    outcome = fetch_flags(fetches).groupBy("group_name").agg(F.bit_or("bits").alias("more"))
    both = out.join(outcome, "group_name", "left")
    more = F.when(F.col("depth").isNotNull(), F.coalesce("more", F.lit(0))).otherwise(F.lit(0))
    return both.select("group_name", "depth", F.col("bits").bitwiseOR(more.cast("long")).alias("bits"))
