"""Parent-child links of unknown depth to full hierarchies.

1. Leaves are peeled in doubling rounds. After k rounds of peeling leaves one by one, the nodes with a descendant k steps
   down are left; round j has the nodes with one 2^j steps down, so a chain of any length is gone in log2 rounds. What
   never goes away are the loops. Each loop is cut above its smallest id, which makes a tree of all that hangs on it.
2. Every tree becomes an Euler tour, a linked list of entries and exits (a leaf is one element that counts for two).
3. Parallel list ranking by pointer doubling gives every element its distance to the end of its list and the sum of
   up and down steps on the way: entry, exit, depth and root in log2(tour length) rounds. Elements that have reached the
   end of their list take no part in later rounds.

Descendants of a node are the rows of its tree whose entry lies inside its (entry, exit) interval.
Each round is a join written to the shared folder; nothing is collected but counters. Joins on the root of a tree have one
row a tree on one side, so that a tree of most nodes is left to the skew join of adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.canonical import canonical_type, present
from graphloom.shared import Scratch, row_count

#: children of one node are chained in at least so many slots, more where a slot could hold more than SLOT_ROWS
SLOTS, SLOT_ROWS = 256, 1 << 20
BLOCK = 4096
#: tables of finished elements that are kept apart while lists are ranked
DONE_PARTS = 4


class HashCollision(RuntimeError):
    """Two ids share a 63-bit number; the caller tries another seed."""


def _number(c: Column, seed: int) -> Column:
    """A 63-bit number of an id, with the lowest bit free to tell entry from exit."""
    return F.xxhash64(F.lit(seed), c).bitwiseAND(F.lit(-2))


class Forest:
    """The hierarchy of a table of links.

    ``parent`` and ``child`` are string columns. Defined cases:

    * links with a null, empty or blank end are ignored; repeated links count once; surrounding blanks are kept;
    * of several parents of a node the smallest id holds; the links left out so are in ``extra_parents`` and counted in
      ``extra`` (a forest has none);
    * a link from a node to itself is a loop of one node;
    * nodes on a loop, or below one, get depth -1, the smallest id on the loop as root, and null entry and exit;
      with ``loops=True`` the results cover them too: each loop is cut above its smallest id, which makes a tree of
      all that hangs on it, and what the cut link would have reached is added by going round;
    * a root has depth 0 and itself as root; no links give an empty forest; other columns are not read.
    """

    def __init__(self, links: DataFrame, parent: Column, child: Column):
        self.spark = links.sparkSession
        self.scratch = Scratch(self.spark, "forest")
        self.usable = links.select(parent.alias("parent"), child.alias("child")).where(present(F.col("parent")) & present(F.col("child")))
        one = self.usable.groupBy("child").agg(F.min("parent").alias("parent"), F.max("parent").alias("other"))
        self.links, stats, _ = self.scratch.cut(one, n=F.count(F.lit(1)), extra=F.sum((F.col("parent") != F.col("other")).cast("long")))
        self.size, self.extra = stats["n"], stats["extra"]
        self._open = None
        for seed in (11, 23, 37):
            try:
                self._build(seed)
                return
            except HashCollision:
                continue
        raise HashCollision("three seeds gave equal numbers to different ids")

    def extra_parents(self) -> DataFrame:
        """node_id, parent_id, kept_id: the links to other parents than the one that holds, each once."""
        held = self.links.where(F.col("parent") != F.col("other")).select("child", F.col("parent").alias("kept_id"))
        links = self.usable.join(held, "child").where(F.col("parent") != F.col("kept_id"))
        return links.select(F.col("child").alias("node_id"), F.col("parent").alias("parent_id"), "kept_id").distinct()

    # ---- ids

    def _build(self, seed: int) -> None:
        cut = self.scratch.cut
        ends = self.links.select(F.col("child").alias("id"), F.lit(1).alias("below")).unionAll(self.links.select(F.col("parent").alias("id"), F.lit(0).alias("below")))
        names = ends.groupBy(_number(F.col("id"), seed).alias("n")).agg(F.min("id").alias("id"), F.max("id").alias("other"), F.max("below").alias("below"))
        self.names, seen, _ = cut(names, clash=F.sum(F.when(F.col("id") != F.col("other"), 1).otherwise(0)), roots=F.sum(1 - F.col("below")))
        if seen["clash"]:
            raise HashCollision
        up = self.links.select(_number(F.col("child"), seed).alias("n"), _number(F.col("parent"), seed).alias("p"))
        self.up, _, _ = cut(up)
        self.ring, self.cuts = self._loops(self._peel())
        up, tops = self.up, self.names.where("below = 0").select("n")
        if self.cuts is not None:
            up, tops = up.join(self.cuts.select("n"), "n", "left_anti"), tops.unionAll(self.cuts.select("n"))
        self.tours = self._rank(self._successors(up, tops)) if self.size else None

    # ---- peeling

    def _peel(self) -> DataFrame | None:
        """The nodes on loops (n), or None if there are none."""
        # jump: the node 2^j above, of the nodes that 2^j rounds of peeling leave, as far as there is one so far up
        jump, count, old = self.up, self.size, None
        while count:
            left = jump.select(F.col("p").alias("n")).distinct()
            further = jump.join(left, "n", "left_semi").alias("a").join(jump.alias("b"), F.col("a.p") == F.col("b.n")).select(F.col("a.n").alias("n"), F.col("b.p").alias("p"))
            jump, seen, path = self.scratch.cut(further, n=F.count(F.lit(1)))
            if old:
                self.scratch.drop(old)
            old = path
            if seen["n"] == count:  # no leaf was left to peel, and no node lacks an ancestor: these are loops
                return jump.select("n")
            count = seen["n"]
        return None

    def _loops(self, ring: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
        """n of the nodes on loops; and n of the smallest id on each."""
        if ring is None:
            return None, None
        around = self.up.join(ring, "n", "left_semi")
        start = around.join(self.names.select("n", "id"), "n").select("n", F.col("p").alias("next"), "p", "id", F.col("id").alias("low"))
        state, _, old = self.scratch.cut(start)
        while True:
            # low: smallest id among the node and the 2^j - 1 next ones above it; p: the node 2^j above
            a, b = state.alias("a"), state.alias("b")
            paired = a.join(b, F.col("a.p") == F.col("b.n")).select("a.n", "a.next", F.col("b.p").alias("p"), "a.id", F.least("a.low", "b.low").alias("low"))
            nxt, _, path = self.scratch.cut(paired)
            beside = nxt.alias("a").join(nxt.alias("b"), F.col("a.next") == F.col("b.n")).where(F.col("a.low") != F.col("b.low"))
            if not row_count(beside.select("a.n")):  # equal windows all the way round cover the loop
                return nxt.select("n"), nxt.where(F.col("id") == F.col("low")).select("n")
            self.scratch.drop(old)
            state, old = nxt, path

    # ---- Euler tours

    def _successors(self, up: DataFrame, tops: DataFrame) -> DataFrame:
        """e, nxt (0 at the end of a list), w (step), c (elements it stands for) for the tours of the trees below ``tops``."""
        # brothers are chained in the order of their numbers; a node with very many children is split into slots
        bits = max(SLOTS, self.size // SLOT_ROWS).bit_length() - 1
        slotted = up.select("n", "p", F.shiftright("n", 64 - bits).alias("slot"))
        heads = slotted.groupBy("p", "slot").agg(F.min("n").alias("head"))
        inside = Window.partitionBy("p", "slot").orderBy("n")
        over = Window.partitionBy("p").orderBy("slot")  # one row a slot of a node
        heads = heads.select("p", "slot", F.lead("head").over(over).alias("after"), F.first("head").over(over).alias("first"))
        heads, _, _ = self.scratch.cut(heads)
        kids = slotted.select("*", F.lead("n").over(inside).alias("brother"))
        kids = kids.join(heads.select("p", "slot", "after"), ["p", "slot"], "left")
        kids = kids.select("n", "p", F.coalesce("brother", "after").alias("brother"))
        firsts = heads.groupBy("p").agg(F.first("first").alias("first"))
        roots = tops.select("n", F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("brother"))
        nodes = kids.unionAll(roots).join(firsts.withColumnRenamed("p", "q"), F.col("n") == F.col("q"), "left")
        leave = F.coalesce(F.col("brother"), F.col("p").bitwiseOR(F.lit(1)), F.lit(0))
        leaf = F.col("first").isNull()
        enter = F.struct(
            F.col("n").alias("e"),
            F.when(leaf, leave).otherwise(F.col("first")).alias("nxt"),
            F.when(leaf, 0).otherwise(1).cast("long").alias("w"),
            F.when(leaf, 2).otherwise(1).cast("long").alias("c"),
        )
        out = F.struct(F.col("n").bitwiseOR(F.lit(1)).alias("e"), leave.alias("nxt"), F.lit(-1).cast("long").alias("w"), F.lit(1).cast("long").alias("c"))
        return nodes.select(F.explode(F.when(leaf, F.array(enter)).otherwise(F.array(enter, out))).alias("x")).select("x.*")

    def _rank(self, elements: DataFrame) -> DataFrame:
        """e, end, w, c: the last element of its list, the steps and the elements from e to it, both included."""
        start = elements.select("e", "nxt", F.col("e").alias("end"), "w", "c", (F.col("nxt") == 0).alias("shut"))
        table, seen, path = self.scratch.cut(start, by="shut", open=F.sum((F.col("nxt") != 0).cast("long")))
        running, done = table.where("NOT shut"), [table.where("shut")]
        while seen["open"]:
            every = running
            for d in done:
                every = every.unionAll(d)
            a, b = running.alias("a"), every.alias("b")
            ahead = a.join(b, F.col("a.nxt") == F.col("b.e")).select(
                F.col("a.e").alias("e"),
                F.col("b.nxt").alias("nxt"),
                F.col("b.end").alias("end"),
                (F.col("a.w") + F.col("b.w")).alias("w"),
                (F.col("a.c") + F.col("b.c")).alias("c"),
                (F.col("b.nxt") == 0).alias("shut"),
            )
            table, seen, new = self.scratch.cut(ahead, by="shut", open=F.sum((F.col("nxt") != 0).cast("long")))
            self.scratch.drop(f"{path}/shut=false")
            running, path = table.where("NOT shut"), new
            done.append(table.where("shut"))
            if len(done) > DONE_PARTS:  # many small tables cost more to list than one to write
                merged = done[0]
                for d in done[1:]:
                    merged = merged.unionAll(d)
                done = [self.scratch.cut(merged)[0]]
        every = done[0]
        for d in done[1:]:
            every = every.unionAll(d)
        return every

    # ---- results

    def _intervals(self) -> DataFrame:
        """n, root (number), depth, entry, exit of every node of a tree or a cut loop, and whether it is of a loop.
        Entries and exits count from 0 within a tree."""
        one = self.tours.select(
            F.col("e").bitwiseAND(F.lit(-2)).alias("n"),
            F.col("end").bitwiseAND(F.lit(-2)).alias("root"),
            F.when(F.col("e").bitwiseAND(F.lit(1)) == 0, F.struct("c", "w")).alias("enter"),
            F.when(F.col("e").bitwiseAND(F.lit(1)) == 1, F.col("c")).alias("leave"),
        )
        node = one.groupBy("n", "root").agg(F.max("enter").alias("enter"), F.max("leave").alias("leave"))
        totals = node.where(F.col("n") == F.col("root")).select(F.col("root").alias("t"), F.col("enter.c").alias("total"))
        placed = node.join(totals, F.col("root") == F.col("t"))
        entry = F.col("total") - F.col("enter.c")
        placed = placed.select("n", "root", (-F.col("enter.w")).cast("int").alias("depth"), entry.alias("entry"), F.coalesce(F.col("total") - F.col("leave"), entry + 1).alias("exit"))
        if self.cuts is None:
            return placed.withColumn("looped", F.lit(False))
        return placed.join(self.cuts.select(F.col("n").alias("cut")), F.col("root") == F.col("cut"), "left").withColumn("looped", F.col("cut").isNotNull()).drop("cut")

    def _opened(self) -> DataFrame:
        """``_intervals`` with, for nodes on a loop, its length (lap) and the places of its whole tour (total)."""
        if self._open is None:
            placed, _, _ = self.scratch.cut(self._intervals())
            none = F.lit(None).cast("long")
            if self.ring is None:
                self._open = placed.withColumns({"lap": none, "total": none})
            else:
                on = placed.where("looped").join(self.ring, "n", "left_semi").select("n", "root", "exit")
                laps = on.groupBy("root").agg(F.count(F.lit(1)).alias("lap"), (F.max("exit") + 1).alias("total"))
                self._open, _, _ = self.scratch.cut(placed.join(on.join(laps, "root").select("n", "lap", "total"), "n", "left"))
        return self._open

    def _empty(self, fields: str) -> DataFrame:
        return self.spark.createDataFrame([], fields)

    def _named(self, df: DataFrame) -> DataFrame:
        """Numbers n and r to node_id and root_id, and whether the root is the cut of a loop; roots are the smaller table."""
        names = self.names.select("n", F.col("id").alias("node_id"))
        roots = self.names.where("below = 0").select(F.col("n").alias("rn"), F.col("id").alias("root_id"), F.lit(False).alias("looped"))
        if self.cuts is not None:
            roots = roots.unionAll(self.cuts.join(self.names, "n").select("n", "id", F.lit(True)))
        return df.join(names, "n").join(roots, F.col("r") == F.col("rn"))

    def depths(self) -> DataFrame:
        """node_id, root_id, depth of every node: what needs no interval is read off the ranks of the entries alone."""
        if self.tours is None:
            return self._empty("node_id string, root_id string, depth int")
        enter = self.tours.where(F.col("e").bitwiseAND(F.lit(1)) == 0)
        ranked = enter.select(F.col("e").alias("n"), F.col("end").bitwiseAND(F.lit(-2)).alias("r"), (-F.col("w")).cast("int").alias("steps"))
        return self._named(ranked).select("node_id", "root_id", F.when(F.col("looped"), -1).otherwise(F.col("steps")).alias("depth"))

    def nodes(self, loops: bool = False) -> DataFrame:
        """node_id, parent_id, root_id, depth, entry, exit, descendants of every node that is an end of a link.

        With ``loops``, nodes on and below loops have descendants, and entry and exit in the tour of the cut loop. A
        node on a loop has all others of the loop and below it as descendants, more than its interval holds.
        """
        if self.tours is None:
            return self._empty("node_id string, parent_id string, root_id string, depth int, entry long, exit long, descendants long")
        inside = ((F.col("exit") - F.col("entry") - 1) / 2).cast("long")
        placed = self._named(self._opened().drop("looped").withColumnRenamed("root", "r"))
        shown = F.lit(True) if loops else ~F.col("looped")
        count = F.coalesce((F.col("total") / 2 - 1).cast("long"), inside)
        every = placed.select(
            "node_id", "root_id", F.when(F.col("looped"), -1).otherwise(F.col("depth")).alias("depth"), *[F.when(shown, c).alias(k) for k, c in (("entry", F.col("entry")), ("exit", F.col("exit")), ("descendants", count))]
        )
        up = self.links.select(F.col("child").alias("c"), F.col("parent").alias("parent_id"))
        return every.join(up, F.col("node_id") == F.col("c"), "left").select("node_id", "parent_id", "root_id", "depth", "entry", "exit", "descendants")

    def paths(self, loops: bool = False) -> DataFrame:
        """node_id, path: ids from the root down to the node. Nodes on or below loops are left out.

        With ``loops`` they are there too, with the path from the smallest id on the loop, and a third column, ring,
        has the number of ids at the start of the path that are on a loop (0 in a tree).
        Paths are put together by doubling, so a chain of length L takes log2(L) rounds.
        """
        links, names = self.links.withColumn("ring", F.lit(0)), self.names
        tops = names.where("below = 0").select("id", F.lit(0).alias("ring"))
        if self.cuts is not None:
            on = self.ring.join(names.select("n", "id"), "n").select(F.col("id").alias("child"), F.lit(1).alias("one"))
            cuts = self.cuts.join(names.select("n", "id"), "n").select(F.col("id").alias("child"))
            links = self.links.join(cuts, "child", "left_anti").join(on, "child", "left").select("child", "parent", F.coalesce("one", F.lit(0)).alias("ring"))
            tops = tops.unionAll(cuts.select(F.col("child").alias("id"), F.lit(1).alias("ring")))
        start = links.select(F.col("child").alias("node_id"), F.col("parent").alias("up"), F.array("child").alias("path"), "ring")
        roots = tops.select(F.col("id").alias("node_id"), F.lit(None).cast("string").alias("up"), F.array("id").alias("path"), "ring")
        state, seen, old = self.scratch.cut(start.unionAll(roots), open=F.sum(F.col("up").isNotNull().cast("long")))
        while seen["open"]:
            a, b = state.alias("a"), state.alias("b")
            joined = a.join(b, F.col("a.up") == F.col("b.node_id"), "left")
            met = F.col("b.node_id").isNotNull()
            path = F.when(met, F.concat("b.path", "a.path")).otherwise(F.col("a.path"))
            ring = F.when(met, F.col("b.ring") + F.col("a.ring")).otherwise(F.col("a.ring"))
            nxt = joined.select(F.col("a.node_id").alias("node_id"), F.col("b.up").alias("up"), path.alias("path"), ring.alias("ring"))
            state, seen, at = self.scratch.cut(nxt, open=F.sum(F.col("up").isNotNull().cast("long")))
            self.scratch.drop(old)
            old = at
        # a path begins with a node of the loop exactly where its node is on or below one
        return state.select("node_id", "path", "ring") if loops else state.where("ring = 0").select("node_id", "path")

    def descendants(self, requests: DataFrame, node: Column, max_depth: Column, keep: list[str], loops: bool = False) -> DataFrame:
        """``keep`` columns of each request with descendant_id and distance (1 .. max_depth) of its node.

        Requests whose node is unknown give no rows; a null max_depth means no bound. Those whose node is on or below a
        loop give rows only with ``loops``: each other node that links lead down to once, at its least distance. Tours
        are laid end to end in blocks of BLOCK places, a request asks only the blocks its interval meets, and block
        numbers are the join key: no tree, however large, meets in one task. A node on a loop asks for what lies outside
        its interval as well, which is reached by going round to the place of the cut.
        """
        if self.tours is None:
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.select(*keep).schema.fields)
            return self._empty(f"{fields}, descendant_id string, distance int")
        placed = self._opened() if loops else self._opened().where("NOT looped")
        asked = requests.select(*[F.col(c).alias(f"k_{c}") for c in keep], node.alias("wanted"), max_depth.cast("int").alias("most"))
        at = self.names.select("n", F.col("id").alias("wanted"))
        span = lambda low, high, shift: F.struct(low.alias("low"), high.alias("high"), shift.cast("int").alias("shift"))
        own = span(F.col("entry") + 1, F.col("exit") - 1, -F.col("depth"))
        round_ = F.col("lap") - F.col("depth")
        before, after = span(F.lit(0).cast("long"), F.col("entry") - 1, round_), span(F.col("exit") + 1, F.col("total") - 1, round_)
        spans = F.when(F.col("lap").isNull(), F.array(own)).otherwise(F.array(own, before, after))
        spot = asked.join(at, "wanted").join(placed, "n").select(*[f"k_{c}" for c in keep], "most", "root", F.explode(spans).alias("s")).select("*", "s.*").drop("s")
        spot = spot.where((F.col("low") <= F.col("high")) & (F.col("most").isNull() | (F.col("shift") <= F.col("most"))))
        spot = spot.withColumn("block", F.explode(F.sequence(F.expr(f"low div {BLOCK}"), F.expr(f"high div {BLOCK}"))))
        below = placed.select(F.col("n"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("entry").alias("x"), F.expr(f"entry div {BLOCK}").alias("blk"))
        near = (F.col("root") == F.col("r")) & (F.col("block") == F.col("blk")) & F.col("x").between(F.col("low"), F.col("high"))
        distance = F.col("d") + F.col("shift")
        met = spot.join(below, near).where(F.col("most").isNull() | (distance <= F.col("most")))
        named = met.join(self.names.select("n", F.col("id").alias("descendant_id")), "n")
        return named.select(*[F.col(f"k_{c}").alias(c) for c in keep], "descendant_id", distance.alias("distance"))


def parent_child(edges: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Structural links of an edge table as (rows, parent, child): of has_* edges the source is the parent, of
    method_of and embeds the target; other types are no links."""
    kind = canonical_type(F.col("type"))
    rows = edges.select("source", "target", kind.alias("kind")).where(F.col("kind").isin("has_method", "has_field", "has_parameter", "method_of", "embeds"))
    down = F.col("kind").isin("has_method", "has_field", "has_parameter")
    return rows, F.when(down, F.col("source")).otherwise(F.col("target")), F.when(down, F.col("target")).otherwise(F.col("source"))
