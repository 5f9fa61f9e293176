"""Paths over a code graph: level-synchronous search written to the shared folder between levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import CodeGraph, named
from graphloom.shared import Scratch

CALLABLE = ("function", "method")


def _links(g: CodeGraph, types: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (source, target) with both ends among the nodes (of the types ``keep``)."""
    ids = g.of(*keep).select(F.col("id").alias("k"))
    e = g.rel(*types).select("source", "target").distinct()
    return e.join(ids, F.col("source") == F.col("k"), "left_semi").join(ids, F.col("target") == F.col("k"), "left_semi")


def reach(links: DataFrame, starts: DataFrame, most: int, *, scratch: Scratch | None = None) -> DataFrame:
    """start, node, distance: every node reached from each start in at most ``most`` steps, at its least distance.

    ``starts`` has the columns start and node (distance 0). Each level joins the frontier with the links and leaves out
    what was met before; the search ends when a frontier is empty.
    """
    scratch = scratch or Scratch(links.sparkSession, "reach")
    links, _, _ = scratch.cut(links)
    frontier, seen, _ = scratch.cut(starts.select("start", "node").distinct(), n=F.count(F.lit(1)))
    met = frontier.withColumn("distance", F.lit(0))
    for level in range(1, most + 1):
        if not seen["n"]:
            break
        step = frontier.join(links, F.col("node") == F.col("source")).select("start", F.col("target").alias("node")).distinct()
        fresh = step.join(met.select("start", "node"), ["start", "node"], "left_anti")
        frontier, seen, _ = scratch.cut(fresh, n=F.count(F.lit(1)))
        met = met.unionAll(frontier.withColumn("distance", F.lit(level)))
    return met


def reach_paths(links: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """start, node, path: as ``reach``, with the ids of one shortest path each, the least of them."""
    scratch = Scratch(links.sparkSession, "reach")
    links, _, _ = scratch.cut(links)
    frontier, seen, _ = scratch.cut(starts.select("start", "node").distinct().withColumn("path", F.array("node")), n=F.count(F.lit(1)))
    met, found = frontier.select("start", "node"), frontier
    for _ in range(most):
        if not seen["n"]:
            break
        step = frontier.join(links, F.col("node") == F.col("source")).select("start", F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        best = step.groupBy("start", "node").agg(F.min("path").alias("path")).join(met, ["start", "node"], "left_anti")
        frontier, seen, _ = scratch.cut(best, n=F.count(F.lit(1)))
        met, found = met.unionAll(frontier.select("start", "node")), found.unionAll(frontier)
    return found


def distances_to(g: CodeGraph, name: str, most: int = 10) -> DataFrame:
    """Least number of calls, 1 .. most, from every function and method to those of a name."""
    links = _links(g, ("calls",), CALLABLE)
    ends = g.of(*CALLABLE).where((F.col("full_name") == name) | (F.col("label") == name)).select(F.col("id").alias("start"), F.col("id").alias("node"))
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"))
    found = reach(back, ends, most).where(F.col("start") != F.col("node"))
    return found.groupBy(F.col("node").alias("id")).agg(F.min("distance").alias("length"))


def trace_call_path(g: CodeGraph, start: str, end: str, most: int = 10, limit: int = 5, types: tuple[str, ...] = ("calls",), keep: tuple[str, ...] = CALLABLE) -> DataFrame:
    """start, end, path (full names), labels, length of the shortest path of each pair of nodes of the two names.

    Start and end differ. Of several shortest paths the one of the least ids holds. The frontier keeps one path a node.
    """
    scratch = Scratch(g.nodes.sparkSession, "trace")
    links, _, _ = scratch.cut(_links(g, types, keep))
    hit = lambda n: (F.col("full_name") == n) | (F.col("label") == n)
    ends, _, _ = scratch.cut(g.of(*keep).where(hit(end)).select(F.col("id").alias("end")))
    begin = g.of(*keep).where(hit(start)).select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"))
    frontier, seen, _ = scratch.cut(begin, n=F.count(F.lit(1)))
    met = frontier.select("start", "node")
    hits = None
    for _ in range(most):
        if not seen["n"]:
            break
        step = frontier.join(links, F.col("node") == F.col("source")).select("start", F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        best = step.groupBy("start", "node").agg(F.min("path").alias("path")).join(met, ["start", "node"], "left_anti")
        frontier, seen, _ = scratch.cut(best, n=F.count(F.lit(1)))
        met = met.unionAll(frontier.select("start", "node"))
        here = frontier.join(ends, F.col("node") == F.col("end"))
        hits = here if hits is None else hits.unionAll(here)
    if hits is None:
        return g.nodes.sparkSession.createDataFrame([], "start string, end string, path array<string>, labels array<string>, length int")
    top = hits.select("start", "end", "path", (F.size("path") - 1).alias("length")).orderBy("length", "start", "end").limit(limit)
    # names along the few paths kept
    steps = top.select("start", "end", "length", F.posexplode("path").alias("pos", "id")).join(g.nodes.select("id", "full_name", "label"), "id")
    lists = steps.groupBy("start", "end", "length").agg(F.sort_array(F.collect_list(F.struct("pos", "full_name", "label"))).alias("s"))
    return lists.select("start", "end", F.transform("s", lambda x: x["full_name"]).alias("path"), F.transform("s", lambda x: x["label"]).alias("labels"), "length")


def path_nodes(g: CodeGraph, start: str, end: str, **how) -> DataFrame:
    """Distinct labels on the shortest paths, in order of the label."""
    return trace_call_path(g, start, end, **how).select(F.explode("labels").alias("label")).distinct().orderBy("label")


def path_goroutines(g: CodeGraph, start: str, end: str, most: int = 10) -> DataFrame:
    """Nodes on shortest paths over any edge type, with the goroutines they spawn, if any."""
    paths = trace_call_path(g, start, end, most, types=(), keep=()).select(F.explode("path").alias("full_name")).distinct()
    spawned = g.hop("spawns_goroutine").select("s_full_name", F.col("t_label").alias("spawned"))
    return paths.join(spawned, F.col("full_name") == F.col("s_full_name"), "left").select("full_name", "spawned").distinct()


def reachable(g: CodeGraph, source: Column, target: Column, most: int = 5, limit: int | None = None) -> DataFrame:
    """start, node, distance, path (ids) for nodes of ``source`` that reach nodes of ``target`` in 1 .. most calls."""
    starts = g.nodes.where(source).select(F.col("id").alias("start"), F.col("id").alias("node"))
    found = reach_paths(_links(g, ("calls",)), starts, most).withColumn("distance", F.size("path") - 1).where("distance > 0")
    out = found.join(g.nodes.where(target).select(F.col("id").alias("node")), "node", "left_semi").select("start", "node", "distance", "path")
    return out.orderBy("distance", "start", "node").limit(limit) if limit else out


def impact_transitive(g: CodeGraph, node: str, most: int = 5, types: tuple[str, ...] = ("calls", "uses", "implements", "embeds", "returns", "parameter_type", "constructs", "imports")) -> DataFrame:
    """id, distance of everything that depends on ``node`` within ``most`` steps."""
    links = _links(g, types).select(F.col("target").alias("source"), F.col("source").alias("target"))
    starts = g.nodes.where(named(node)).select(F.col("id").alias("start"), F.col("id").alias("node"))
    return reach(links, starts, most).where("distance > 0").groupBy(F.col("node").alias("id")).agg(F.min("distance").alias("distance"))


def on_cycles(g: CodeGraph, rel: str = "calls") -> DataFrame:
    """id of nodes on a closed trail of 2 to 5 relationships.

    A closed trail without self-loops holds a simple cycle of that length or less, which meets half way: v reaches u in
    k steps and u reaches v in k or k - 1. Two parallel self-loops are a trail of length 2 of their own.
    """
    scratch = Scratch(g.nodes.sparkSession, "cycles")
    every, _, _ = scratch.cut(g.rel(rel).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")))
    ids = g.nodes.select(F.col("id").alias("k"))
    e = every.where("source <> target").select("source", "target").join(ids, F.col("source") == F.col("k"), "left_semi").join(ids, F.col("target") == F.col("k"), "left_semi")
    one, seen, _ = scratch.cut(e, n=F.count(F.lit(1)))
    while seen["n"]:  # a node without a way in or out is on no cycle
        left = one.join(one.select(F.col("source").alias("k")), F.col("target") == F.col("k"), "left_semi").join(one.select(F.col("target").alias("k")), F.col("source") == F.col("k"), "left_semi")
        before = seen["n"]
        one, seen, _ = scratch.cut(left, n=F.count(F.lit(1)))
        if seen["n"] > 0.9 * before:
            break
    step = lambda far: far.join(one.select(F.col("source").alias("m"), F.col("target").alias("t")), F.col("target") == F.col("m")).select("source", F.col("t").alias("target")).distinct()
    two, _, _ = scratch.cut(step(one))
    three, _, _ = scratch.cut(step(two))
    back = lambda d: d.select(F.col("target").alias("source"), F.col("source").alias("target"))
    found = None
    for there, again in ((one, one), (two, one), (two, two), (three, two)):
        met = there.join(back(again), ["source", "target"], "left_semi").select(F.col("source").alias("id"))
        found = met if found is None else found.unionAll(met)
    loops = every.where("source = target AND n > 1").select(F.col("source").alias("id")).join(ids, F.col("id") == F.col("k"), "left_semi")
    return found.unionAll(loops).distinct()


def import_chains(g: CodeGraph, least: int = 3, most: int = 6, limit: int = 10) -> DataFrame:
    """start, end, length of the longest walks of 3 to 6 imports between different packages (distinct end points)."""
    scratch = Scratch(g.nodes.sparkSession, "chains")
    one, _, _ = scratch.cut(_links(g, ("imports",)))
    walk, parts = one, []
    for length in range(2, most + 1):
        nxt = walk.join(one.select(F.col("source").alias("m"), F.col("target").alias("t")), F.col("target") == F.col("m")).select("source", F.col("t").alias("target")).distinct()
        walk, _, _ = scratch.cut(nxt)
        if length >= least:
            parts.append(walk.where("source <> target").select(F.col("source").alias("start"), F.col("target").alias("end"), F.lit(length).alias("length")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.orderBy(F.desc("length"), "start", "end").limit(limit)
