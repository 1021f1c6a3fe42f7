"""Iterative graph operators as frontier loops over tables (G1-G17, L2, L6, L11-L13). Each round is written to the shared
folder, which ends its lineage; only counts reach the driver. Edges have (src, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..scratch import drop_table, write_table


def _together(parts: list[DataFrame], label: str) -> DataFrame:
    """One written table of all rounds; those of the rounds go."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = write_table(out, label)
    for p in parts:
        drop_table(p)
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals both sides: a loop has so many joins that what Spark broadcasts in each, all through the
    driver, adds up, however small the table."""
    return df.hint("merge")


def reach(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(seed, node, dist): all nodes reached from each seed along edges, with the shortest distance;
    the seed itself has 0. ``most`` bounds the hops. Cycles end, as nodes seen before are not followed."""
    e = edges.select("src", "dst").distinct()
    parts = [write_table(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("dist")).distinct(), "reach")]
    hop = 0
    while most is None or hop < most:
        hop += 1
        step = parts[-1].join(e, F.col("node") == e.src).select("seed", F.col("dst").alias("node")).distinct()
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        new = write_table(step.join(known.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("dist", F.lit(hop)), "reach")
        parts.append(new)
        if new.isEmpty():
            break
    return _together(parts, "reached")


def peel(edges: DataFrame) -> DataFrame:
    """G1: the edges left after taking away, again and again, those whose source has no way in or whose target has no way
    out; none are left if and only if there is no cycle. Other columns stay."""
    e, n = _counted(edges.dropDuplicates(["src", "dst"]), "peel", "true")
    while n:
        ins, outs = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
        nxt, m = _counted(e.join(shuffled(ins), "src", "left_semi").join(shuffled(outs), "dst", "left_semi").select(*edges.columns), "peel", "true")
        drop_table(e)
        e = nxt
        if m == n:
            break
        n = m
    return e


def compress(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chains become edges. Of ``edges`` (src, dst, w), one row a pair, the nodes with one way in and one way out are taken
    away: (edges left, with the greatest weight of each pair; chained (node, head, anchor, dist); ends (head, next)). A
    chain is known by its first node (head) and runs from anchor, dist before the node, to next. The nodes of a cycle
    that no edge enters or leaves have a null anchor, and the smallest of them as head.

    Each node points to the one before it and pointers are doubled, so that a chain of n nodes takes log2(n) rounds.
    """
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"), F.min("src").alias("prev"), F.max("w").alias("w"))
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"), F.min("dst").alias("next"), F.max("w").alias("w_out"))
    inner = write_table(ins.join(shuffled(outs), "node").where("i = 1 and o = 1").select("node", "prev", "w", "next", "w_out"), "chain-nodes")
    known = inner.select(F.col("node").alias("k"))
    first = F.col("k").isNull()
    start = inner.join(shuffled(known), inner.prev == known.k, "left").select("node", F.when(first, F.col("node")).otherwise(F.col("prev")).alias("head"), F.col("prev").alias("anchor"), F.col("w").alias("dist"), F.col("node").alias("least"), first.alias("done"))
    ptr, open_ = _counted(start, "chain-pointers", "not done")
    for _ in range(inner.count().bit_length() + 1):  # afterwards only the nodes of cycles are not done
        if not open_:
            break
        on = ptr.select(F.col("node").alias("at"), *[F.col(c).alias(f"{c}_") for c in ("head", "anchor", "dist", "least", "done")])
        far = ptr.where("not done").join(shuffled(on), F.col("anchor") == F.col("at")).select("node", F.col("head_").alias("head"), F.col("anchor_").alias("anchor"), (F.col("dist") + F.col("dist_")).alias("dist"), F.least("least", "least_").alias("least"), F.col("done_").alias("done"))
        nxt, open_ = _counted(ptr.where("done").unionByName(far), "chain-pointers", "not done")
        drop_table(ptr)
        ptr = nxt
    chained = ptr.select("node", F.when(F.col("done"), F.col("head")).otherwise(F.col("least")).alias("head"), F.when(F.col("done"), F.col("anchor")).alias("anchor"), "dist")
    last = inner.join(shuffled(known), inner.next == known.k, "left_anti").select("node", "next", "w_out").join(shuffled(chained), "node")
    kept = edges.join(shuffled(known), edges.src == known.k, "left_anti").join(shuffled(known), edges.dst == known.k, "left_anti").select("src", "dst", "w")
    merged = kept.unionByName(last.select(F.col("anchor").alias("src"), F.col("next").alias("dst"), (F.col("dist") + F.col("w_out")).alias("w")))
    left = write_table(merged.groupBy("src", "dst").agg(F.max("w").alias("w")), "chain-edges")
    return left, chained, last.select("head", "next")


def _counted(df: DataFrame, label: str, condition: str) -> tuple[DataFrame, int]:
    """``df`` written, and how many of its rows meet the condition, seen while they were written."""
    seen = Observation()
    out = write_table(df.observe(seen, F.count(F.when(F.expr(condition), 1)).alias("n")), label)
    return out, seen.get["n"]


def _inner_nodes(edges: DataFrame) -> tuple[int, int]:
    """How many nodes there are, and how many of them have one way in and one way out."""
    ways = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return ways.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).agg(F.count("*"), F.count(F.expr("case when i = 1 and o = 1 then 1 end"))).first()


def _layers(edges: DataFrame) -> DataFrame:
    """(node, depth): the longest way to each node of weighted ``edges`` (src, dst, w) that no cycle leads to. A node is ready
    once all its ways in have arrived, so a round sends along the edges of the nodes just ready and rewrites only those
    that have begun to arrive."""
    need = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("need"))
    e = write_table(edges.join(shuffled(need), edges.dst == need.node).select("src", "dst", "w", "need"), "depth-edges")
    zero = F.lit(0).cast("long")
    begin = edges.select(F.col("src").alias("node")).distinct().join(shuffled(need), "node", "left_anti").select("node", F.lit(0).alias("depth"), zero.alias("got"), zero.alias("need"))
    rounds = []
    while True:
        now, ready = _counted(begin if not rounds else arrived, "depth", "got = need")
        rounds.append(now)
        if not ready:
            break
        sent = now.where("got = need").join(shuffled(e.withColumnRenamed("need", "of")), F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("depth") + F.col("w")).alias("depth"), F.lit(1).cast("long").alias("got"), F.col("of").alias("need"))
        arrived = sent.unionByName(now.where("got < need")).groupBy("node").agg(F.max("depth").alias("depth"), F.sum("got").alias("got"), F.max("need").alias("need"))
    drop_table(e)
    done = [r.where("got = need").select("node", "depth") for r in rounds]
    out = write_table(reduce(DataFrame.unionByName, done), "depths")
    for r in rounds:
        drop_table(r)
    return out


def depth(edges: DataFrame) -> DataFrame:
    """(node, depth): the longest path that leads to a node (roots have 0); null for the nodes of cycles and those
    that a cycle leads to, which have no longest path.

    Nodes without a way out are set aside, as they lengthen no path to others, and chains become weighted edges, as long as
    that takes a quarter of the nodes away. Only what is left goes by layers; then the chains and what was set aside follow.
    """
    e = write_table(edges.select("src", "dst").distinct().withColumn("w", F.lit(1)), "depth-edges")
    aside = []
    while True:
        on = e.select(F.col("src").alias("dst")).distinct()
        rest = write_table(e.join(shuffled(on), "dst", "left_semi").select("src", "dst", "w"), "depth-rest")
        ends = e.join(shuffled(on), "dst", "left_anti")
        nodes, inner = _inner_nodes(rest)
        if inner * 4 < nodes or not nodes:
            break
        e, chained, _ = compress(rest)
        aside.append((ends, chained))
    found = _layers(rest) if nodes else None
    known = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
    known = known.join(shuffled(found), "node", "left") if nodes else known.withColumn("depth", F.lit(None).cast("int"))
    for ends, chained in [(ends, None), *reversed(aside)]:
        if chained is not None:
            at = known.select(F.col("node").alias("anchor"), F.col("depth").alias("before"))
            known = known.unionByName(chained.join(shuffled(at), "anchor", "left").select("node", (F.col("before") + F.col("dist")).alias("depth")))
        # a node that has ways to ends only, and none in, is not known yet
        alone = ends.select(F.col("src").alias("node")).distinct().join(shuffled(known), "node", "left_anti").select("node", F.lit(0).alias("depth"))
        known = write_table(known.unionByName(alone), "depths")
        at = known.select(F.col("node").alias("src"), F.col("depth").alias("before"))
        known = known.unionByName(ends.join(shuffled(at), "src").groupBy(F.col("dst").alias("node")).agg(F.when(F.count("before") == F.count("*"), F.max(F.col("before") + F.col("w"))).alias("depth")))
    return known


def components(edges: DataFrame) -> DataFrame:
    """G1: (component, node): the strongly connected components that hold a cycle, each known by its smallest node; a node
    alone is one only with an edge to itself.

    First chains become edges and what no cycle leads to, or what leads to none, is left out, in turn: a chain belongs to the
    component of its two ends if they are in one. Then in rounds every node gets the pivot (smallest hash, another
    each round) of all nodes that reach it; what a pivot reaches and what reaches it back is a component. Edges between nodes
    of different pivots are in none, so they go too, and every pivot's part is searched at once.
    """
    left, levels = write_table(edges.select("src", "dst").distinct().withColumn("w", F.lit(1)), "scc-edges"), []
    while True:
        left, chained, ends = compress(left)
        levels.append((chained, ends))
        left = peel(left)
        nodes, inner = _inner_nodes(left)
        if inner * 4 < nodes or not nodes:
            break
    found, k = [], 0
    while not left.isEmpty():
        k += 1
        pivot = F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("pivot"))
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colour = _spread(nodes.withColumn("c", pivot), left)
        same = colour.select(F.col("node").alias("n"), F.col("c").alias("c2"))
        within = left.join(shuffled(colour), left.src == colour.node).select("src", "dst", "c").join(shuffled(same), F.col("dst") == F.col("n")).where("c = c2")
        within = write_table(within.select("src", "dst", "c"), "scc-within")
        member = _backward(colour.where("node = c.pivot").select("node", "c"), within)
        found.append(member)
        gone = member.select(F.col("node").alias("g"))
        left = write_table(within.join(shuffled(gone), within.src == gone.g, "left_anti").join(shuffled(gone), within.dst == gone.g, "left_anti").select("src", "dst"), "scc-left")
    of = reduce(DataFrame.unionByName, [f.select(F.col("c.pivot").alias("c"), "node") for f in found]) if found else None
    for chained, ends in reversed(levels):
        rings = chained.where("anchor is null").select(F.col("head").alias("c"), "node")
        if of is not None:
            a, b = (of.select(F.col("node").alias(n), F.col("c").alias(m)) for n, m in (("anchor", "c"), ("next", "c_end")))
            rings = rings.unionByName(of).unionByName(ends.join(shuffled(b), "next").join(shuffled(chained), "head").join(shuffled(a), "anchor").where("c = c_end").select("c", "node"))
        of = write_table(rings, "scc")
    cycles = of
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
    sizes = cycles.join(shuffled(loops), "node", "left").groupBy("c").agg(F.min("node").alias("component"), F.count("*").alias("n"), F.count("loop").alias("loops"))
    return cycles.join(shuffled(sizes.where("n > 1 or loops > 0")), "c").select("component", "node")


#: Steps of a loop that one job takes, where a step is cheap beside the job around it.
STEPS = 3


def _spread(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, c): the least c of all nodes that reach a node along ``edges``. A step sends only what changed in the last one."""
    e = edges.select("src", "dst").where("src <> dst")
    now, changed = _counted(colour.withColumn("new", F.lit(True)), "scc-colour", "new")
    while changed:
        nxt = now
        for _ in range(STEPS):
            sent = nxt.where("new").join(shuffled(e), F.col("node") == e.src).select(F.col("dst").alias("node"), "c", F.lit(None).cast(nxt.schema["c"].dataType).alias("own"))
            both = nxt.select("node", "c", F.col("c").alias("own")).unionByName(sent).groupBy("node").agg(F.min("c").alias("c"), F.max("own").alias("own"))
            nxt = both.select("node", "c", (F.col("c") < F.col("own")).alias("new"))
        nxt, changed = _counted(nxt, "scc-colour", "new")
        drop_table(now)
        now = nxt
    return now.select("node", "c")


def _backward(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, c): the nodes from which edges (src, dst, c) of its own colour lead to a seed, and the seeds."""
    now, new = _counted(seeds.withColumn("new", F.lit(True)), "scc-back", "new")
    while new:
        nxt = now
        for _ in range(STEPS):
            last = nxt.where("new").select(F.col("node").alias("dst"))
            more = edges.where("src <> dst").join(shuffled(last), "dst").select(F.col("src").alias("node"), "c", F.lit(True).alias("new"))
            nxt = nxt.withColumn("new", F.lit(False)).unionByName(more).groupBy("node").agg(F.min("c").alias("c"), F.min("new").alias("new"))
        nxt, new = _counted(nxt, "scc-back", "new")
        drop_table(now)
        now = nxt
    return now.select("node", "c")


def cycle_members(edges: DataFrame) -> DataFrame:
    """G1: (node): nodes that reach themselves. The residue of peeling also has bridges between cycles; these do not."""
    return components(edges).select("node")


def chain_length(edges: DataFrame) -> DataFrame:
    """One row: the mean, over nodes with an edge out, of the longest path from them (edges run to prerequisites)."""
    back = depth(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    has = edges.select(F.col("src").alias("node")).distinct()
    return back.join(has, "node", "left_semi").agg(F.round(F.avg("depth"), 6).alias("avg_chain_length"), F.max("depth").alias("longest"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes to which no edge leads."""
    return nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def expand(edges: DataFrame, seeds: DataFrame, most: int, both: bool = False) -> DataFrame:
    """Nodes around the seeds by layer, down the edges or both ways."""
    e = edges.select("src", "dst")
    return reach(e.union(e.select("dst", "src")) if both else e, seeds, most)


def nested_tree(edges: DataFrame, roots: DataFrame, levels: int) -> DataFrame:
    """(node, tree): the tree below each root (node), ``levels`` deep, as nested structs (node, children), the children
    sorted; those at the last level have their node alone. One round a level, from the last one up."""
    layer = expand(edges, roots.select(F.col("node").alias("seed")), levels).select("node", "dist").distinct()
    e = edges.select("src", "dst").distinct()
    below = layer.where(F.col("dist") == levels).select("node", F.struct("node").alias("tree")).distinct()
    for k in range(levels - 1, -1, -1):
        kids = e.join(below, e.dst == below.node).groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("tree")).alias("children"))
        here = layer.where(F.col("dist") == k).select("node").distinct().join(kids, "node", "left")
        empty = F.array().cast(f"array<{below.schema['tree'].dataType.simpleString()}>")
        below = here.select("node", F.struct("node", F.coalesce("children", empty).alias("children")).alias("tree"))
    return below


def siblings(member: DataFrame, seeds: DataFrame, most: int = 1) -> DataFrame:
    """Instances that share a class with the seeds, layer by layer. member (node, cls)."""
    known = seeds.select("node").distinct().withColumn("layer", F.lit(0))
    for k in range(1, most + 1):
        classes = known.select("node").join(member, "node").select("cls").distinct()
        more = member.join(classes, "cls").select("node").distinct().join(known.select("node"), "node", "left_anti")
        known = write_table(known.unionByName(more.withColumn("layer", F.lit(k))), "siblings")
    return known


def propagate(edges: DataFrame, seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, subject): the tag of the nearest seed up the containment edges; ties to the seed first in order; the
    rest are ``unknown``. seeds (node, subject, ord)."""
    e = edges.select("src", "dst").distinct()
    parts = [write_table(seeds.groupBy("node").agg(F.min(F.struct("ord", "subject")).alias("s")), "tags")]
    while True:
        known = parts[0].select("node")
        for p in parts[1:]:
            known = known.unionByName(p.select("node"))
        new = write_table(parts[-1].join(e, F.col("node") == e.src).groupBy(F.col("dst").alias("node")).agg(F.min("s").alias("s")).join(known, "node", "left_anti"), "tags")
        parts.append(new)
        if new.isEmpty():
            break
    known = _together(parts, "tagged")
    return nodes.join(known, "node", "left").select("node", F.coalesce("s.subject", F.lit("unknown")).alias("subject"))


def bounded_paths(edges: DataFrame, most: int = 3) -> DataFrame:
    """(src, dst, hops, path): every path of one to ``most`` edges."""
    e = edges.select("src", "dst").distinct()
    step = e.select("src", "dst", F.lit(1).alias("hops"), F.array("src", "dst").alias("path"))
    out = step
    for k in range(2, most + 1):
        n = e.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
        step = step.join(n, "dst").select("src", F.col("next").alias("dst"), F.lit(k).alias("hops"), F.concat("path", F.array("next")).alias("path"))
        out = out.unionByName(step)
    return out


def children_map(edges: DataFrame) -> DataFrame:
    """(parent, children): the children of each node, sorted."""
    return edges.groupBy(F.col("src").alias("parent")).agg(F.sort_array(F.collect_set("dst")).alias("children"))


class Jumps:
    """Ancestors at distances of powers of two in a forest (node, parent), one written table a power: (node, up, d), where d is
    the power or, if the root is nearer, the distance to the root. Each table is the one before it joined to itself, so a
    forest of depth n takes log2(n) rounds. ``of`` gives None for what is no forest: two parents, or a cycle."""

    def __init__(self, parents: DataFrame):
        p = parents.select("node", "parent").distinct()
        nodes = p.select("node").union(p.where("parent is not null").select("parent")).distinct()
        level = nodes.join(shuffled(p.where("parent is not null")), "node", "left").select("node", F.coalesce("parent", "node").alias("up"), F.col("parent").isNotNull().cast("long").alias("d"))
        now, more = _counted(level, "jumps", "d > 0")
        self.tables, self.n = [now], now.count()
        # as long as a jump twice as far gets anyone further
        while more and 2 ** len(self.tables) <= 4 * self.n:
            last = self.tables[-1].select("node", "up", F.col("d").alias("done"))
            far = self.tables[-1].select(F.col("node").alias("at"), F.col("up").alias("up2"), F.col("d").alias("d2"))
            nxt, more = _counted(last.join(shuffled(far), F.col("up") == F.col("at")).select("node", F.col("up2").alias("up"), (F.col("done") + F.col("d2")).alias("d"), (F.col("d2") > 0).alias("moved")), "jumps", "moved")
            if more:
                self.tables.append(nxt.drop("moved"))
        self.cyclic = bool(more)  # nobody can be further from a root than there are nodes

    @classmethod
    def of(cls, parents: DataFrame) -> Jumps | None:
        most = parents.where("parent is not null").distinct().groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        if not most.isEmpty():
            return None
        out = cls(parents)
        return None if out.cyclic else out

    def depths(self) -> DataFrame:
        """(node, root, depth)"""
        return self.tables[-1].select("node", F.col("up").alias("root"), F.col("d").alias("depth"))

    def _jump(self, rows: DataFrame, col: str, k: int, condition) -> DataFrame:
        """``rows`` whose ``col`` is 2^k further up where the condition holds."""
        t = self.tables[k].select(F.col("node").alias("__at"), F.col("up").alias("__up"))
        return rows.join(shuffled(t), F.col(col) == F.col("__at")).select(*[F.when(condition, F.col("__up")).otherwise(F.col(c)).alias(c) if c == col else c for c in rows.columns])

    def ancestors_at(self, rows: DataFrame, col: str, distance: str) -> DataFrame:
        """``rows`` whose ``col`` is so many steps further up, at most the root; one join for each power of two in use."""
        most = rows.agg(F.coalesce(F.max(distance), F.lit(0))).first()[0]
        for k in range(min(len(self.tables), int(most).bit_length())):
            rows = self._jump(rows, col, k, F.col(distance).bitwiseAND(1 << k) > 0)
        return rows

    def common(self, pairs: DataFrame) -> DataFrame:
        """(a, b, ancestor, da, db): the lowest common ancestor of each pair that has one: the deeper end goes up to the depth of
        the other, then both go up, the farthest jumps first, as long as they do not meet."""
        d = self.depths()
        ends = pairs.select("a", "b").distinct()
        for c in ("a", "b"):
            ends = ends.join(shuffled(d.select(F.col("node").alias(f"__{c}"), F.col("root").alias(f"root_{c}"), F.col("depth").alias(f"depth_{c}"))), F.col(c) == F.col(f"__{c}")).drop(f"__{c}")
        ends = ends.where("root_a = root_b").drop("root_a", "root_b")
        deep = F.col("depth_a") >= F.col("depth_b")
        ends = ends.select("*", F.when(deep, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(deep, F.col("b")).otherwise(F.col("a")).alias("y"), F.abs(F.col("depth_a") - F.col("depth_b")).alias("more"))
        ends = write_table(self.ancestors_at(write_table(ends, "jump-pairs"), "x", "more"), "jump-pairs")
        for k in range(len(self.tables) - 1, -1, -1):
            t = self.tables[k]
            up = ends.join(shuffled(t.select(F.col("node").alias("x"), F.col("up").alias("ux"))), "x").join(shuffled(t.select(F.col("node").alias("y"), F.col("up").alias("uy"))), "y")
            go = F.col("ux") != F.col("uy")
            ends = write_table(up.select("a", "b", "depth_a", "depth_b", F.when(go, F.col("ux")).otherwise(F.col("x")).alias("x"), F.when(go, F.col("uy")).otherwise(F.col("y")).alias("y")), "jump-pairs")
        met = self._jump(ends.withColumn("ancestor", F.col("x")), "ancestor", 0, F.col("x") != F.col("y"))
        low = met.join(shuffled(d.select(F.col("node").alias("ancestor"), "depth")), "ancestor")
        return low.select("a", "b", "ancestor", (F.col("depth_a") - F.col("depth")).cast("int").alias("da"), (F.col("depth_b") - F.col("depth")).cast("int").alias("db"))


def ancestor_pairs(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """G3 for stated pairs: (a, b, dist): those of which b is a itself or an ancestor of a, in a forest (node, parent)."""
    jumps = Jumps.of(parents)
    if jumps is None:
        up = parents.where("parent is not null").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
        met = reach(up, pairs.select(F.col("a").alias("seed")))
        return pairs.select("a", "b").distinct().join(shuffled(met), (F.col("a") == F.col("seed")) & (F.col("b") == F.col("node"))).select("a", "b", "dist")
    d = jumps.depths().select("node", "depth")
    a, b = (d.select(F.col("node").alias(c), F.col("depth").alias(f"depth_{c}")) for c in ("a", "b"))
    asked = pairs.select("a", "b").distinct().join(shuffled(a), "a").join(shuffled(b), "b").withColumn("dist", F.col("depth_a") - F.col("depth_b")).where("dist >= 0").withColumn("x", F.col("a"))
    return jumps.ancestors_at(write_table(asked, "jump-pairs"), "x", "dist").where("x = b").select("a", "b", F.col("dist").cast("int").alias("dist"))


def lowest_common(edges: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b, ancestor, da, db): common ancestors of each pair with the smallest larger distance. Edges run down.

    In a forest that is one node, found by jumps. Where nodes have several parents, or in cycles, all ancestors of the ends
    are compared.
    """
    jumps = Jumps.of(edges.select(F.col("dst").alias("node"), F.col("src").alias("parent")))
    if jumps is not None:
        return jumps.common(pairs) if most is None else jumps.common(pairs).where(F.greatest("da", "db") <= most)
    up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ends = pairs.select(F.col("a").alias("seed")).union(pairs.select("b")).distinct()
    anc = write_table(reach(up, ends, most), "ancestors")
    x = anc.select(F.col("seed").alias("a"), F.col("node").alias("ancestor"), F.col("dist").alias("da"))
    y = anc.select(F.col("seed").alias("b"), F.col("node").alias("ancestor"), F.col("dist").alias("db"))
    both = pairs.select("a", "b").distinct().join(shuffled(x), "a").join(shuffled(y), ["b", "ancestor"]).withColumn("level", F.greatest("da", "db"))
    best = both.groupBy("a", "b").agg(F.min("level").alias("level"))
    return both.join(shuffled(best), ["a", "b", "level"]).select("a", "b", "ancestor", "da", "db")


def common_scores(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ancestor, score): sum over pairs of 169 / (m n) ln(depth) / children; a pair with a zero distance counts nothing."""
    lca = lowest_common(edges, pairs)
    d = depth(edges).select(F.col("node").alias("ancestor"), "depth")
    kids = edges.groupBy(F.col("src").alias("ancestor")).agg(F.count_distinct("dst").alias("kids"))
    s = lca.join(shuffled(d), "ancestor").join(shuffled(kids), "ancestor").where("da > 0 and db > 0 and depth > 0")
    return s.groupBy("ancestor").agg(F.round(F.sum(F.lit(169.0) / (F.col("da") * F.col("db")) * F.log(F.col("depth").cast("double")) / F.col("kids")), 6).alias("score"))


def root_paths(parents: DataFrame, seeds: DataFrame) -> DataFrame:
    """Each seed's path to its root as an array, in a forest (node, parent). A path that would meet a node again ends."""
    up = parents.where("parent is not null")
    ways = [write_table(seeds.select("seed", F.array("seed").alias("path"), F.col("seed").alias("top")).distinct(), "paths")]
    ends = []
    while not ways[-1].isEmpty():
        nxt = ways[-1].join(up, F.col("top") == up.node, "left").withColumn("more", F.col("parent").isNotNull() & ~F.array_contains("path", F.col("parent")))
        nxt = write_table(nxt.select("seed", "more", F.when(F.col("more"), F.concat("path", F.array("parent"))).otherwise(F.col("path")).alias("path"), F.when(F.col("more"), F.col("parent")).otherwise(F.col("top")).alias("top")), "paths")
        ends.append(nxt)
        ways.append(nxt.where("more").drop("more"))
    if not ends:
        return ways[0].select("seed", "path")
    out = ends[0].where("not more")
    for p in ends[1:]:
        out = out.unionByName(p.where("not more"))
    out = write_table(out.select("seed", "path"), "root-paths")
    for p in (ways[0], *ends):
        drop_table(p)
    return out


def weighted_common(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ancestor, score): the lowest common node of two root paths, scored by the root of the product of what
    each path keeps after the common end is trimmed; zero when one is the ancestor of the other. In a forest the kept parts
    are the distances to the lowest common ancestor; paths are written out only where there are cycles."""
    jumps = Jumps.of(parents)
    if jumps is not None:
        return jumps.common(pairs).select("a", "b", "ancestor", F.round(F.sqrt((F.col("da") * F.col("db")).cast("double")), 6).alias("score"))
    seeds = pairs.select(F.col("a").alias("seed")).union(pairs.select("b")).distinct()
    p = root_paths(parents, seeds)
    j = pairs.join(p.select(F.col("seed").alias("a"), F.col("path").alias("pa")), "a").join(p.select(F.col("seed").alias("b"), F.col("path").alias("pb")), "b")
    common = F.array_intersect("pa", "pb")
    m, n = F.size("pa") - F.size(common), F.size("pb") - F.size(common)
    return j.where(F.size(common) > 0).select("a", "b", F.get(common, 0).alias("ancestor"), F.round(F.sqrt((m * n).cast("double")), 6).alias("score"))


def hierarchy_codes(parents: DataFrame) -> DataFrame:
    """(node, code): 1-based places among siblings from the root down, joined by '-'. A forest (node, parent)."""
    w = Window.partitionBy("parent").orderBy("node")
    placed = parents.withColumn("k", F.row_number().over(w).cast("string"))
    layer = write_table(placed.where("parent is null").select("node", F.col("k").alias("code")), "codes")
    parts = [layer]
    while True:
        up = layer.select(F.col("node").alias("parent"), F.col("code").alias("above"))
        layer = write_table(placed.join(up, "parent").select("node", F.concat_ws("-", "above", "k").alias("code")), "codes")
        if layer.isEmpty():
            return _together(parts, "hierarchy-codes")
        parts.append(layer)


def network(triples: DataFrame, predicate: str) -> tuple[DataFrame, DataFrame]:
    """Distinct node and edge tables of one predicate."""
    e = triples.where(F.col("p") == predicate).select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), e


def ancestors(parents: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, dist): each seed and all above it, in a forest (node, parent). What is known up to 2^k steps is
    joined with the jumps of 2^k, so a row is made once and read once a doubling. What is no forest goes hop by hop."""
    jumps = Jumps.of(parents)
    if jumps is None:
        return reach(parents.where("parent is not null").select(F.col("node").alias("src"), F.col("parent").alias("dst")), seeds)
    parts = [write_table(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("dist")).distinct(), "ancestors")]
    for k, table in enumerate(jumps.tables):
        # a jump that the root cut short ends where a shorter one ends, too
        far = table.where(F.col("d") == 1 << k).select(F.col("node").alias("at"), "up").hint("merge")
        known = reduce(DataFrame.unionByName, parts)
        parts.append(write_table(known.join(shuffled(far), F.col("node") == F.col("at")).select("seed", F.col("up").alias("node"), (F.col("dist") + F.lit(1 << k)).cast("int").alias("dist")), "ancestors"))
    return reduce(DataFrame.unionByName, parts)


def learning_path(edges: DataFrame, targets: DataFrame, mastered: DataFrame) -> DataFrame:
    """(target, node, step): the prerequisites of each target and itself, without what is mastered, in an order
    in which every prerequisite comes first (its depth, then its name); what cycles keep from having a depth comes last.
    Edges run from prerequisite to dependent."""
    need = ancestors(edges.select(F.col("dst").alias("node"), F.col("src").alias("parent")), targets.select(F.col("target").alias("seed"))).select(F.col("seed").alias("target"), "node")
    left = need.join(mastered.select("node").distinct(), "node", "left_anti").join(depth(edges).withColumn("in_graph", F.lit(True)), "node", "left")
    w = Window.partitionBy("target").orderBy((F.col("in_graph") & F.col("depth").isNull()).eqNullSafe(True), F.coalesce("depth", F.lit(0)), "node")
    return left.select("target", "node", F.row_number().over(w).cast("long").alias("step"))


def teaching_sequence(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, step): topological layers of the graph restricted to ``nodes``; those of one step may run side by side.
    Null for nodes of cycles and what they lead to."""
    n = nodes.select("node").distinct()
    inner = edges.join(n, edges.src == n.node, "left_semi").join(n, edges.dst == n.node, "left_semi").select("src", "dst")
    d = depth(inner).withColumn("in_graph", F.lit(True))
    return n.join(d, "node", "left").select("node", F.when(F.col("in_graph"), F.col("depth") + 1).otherwise(1).alias("step"))


def central(rows: DataFrame) -> DataFrame:
    """(grp, uri): URIs that every row (grp, row, s, o) of a group touches."""
    ends = rows.select("grp", "row", F.col("s").alias("uri")).union(rows.select("grp", "row", "o")).distinct()
    n = rows.groupBy("grp").agg(F.count_distinct("row").alias("n"))
    return ends.groupBy("grp", "uri").agg(F.count("*").alias("m")).join(n, "grp").where("m = n").select("grp", "uri")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` (either way) of each seed, and the edges among them."""
    nodes = expand(edges, seeds, hops, both=True)
    ids = nodes.select("node").distinct()
    return nodes, edges.join(ids, edges.src == ids.node, "left_semi").join(ids, edges.dst == ids.node, "left_semi")
