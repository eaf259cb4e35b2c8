"""Graph traversal by level-synchronous frontier joins.

Every loop joins the frontier with the edges, keeps what is new by an anti join with what was seen, and cuts the
lineage through the checkpoint folder; it stops when the frontier is empty or a depth bound is reached. Keys are
(project, id); edges are (project, source, target, edge_type). Nothing is collected but one emptiness bit a round. blast_radius() and
on_short_cycles() work project by project, and collect the names of the largest.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, hot_keys, salted_join
from .graph import of_types

KEY = ["project", "id"]
#: A project of more dependencies than this, repeats included, isn't gathered in one task to count its dependents.
WHOLE_EDGES = 1_000_000
#: Bits held by such a task over all components of a project (64 MB, or 64 bits a component where that is more).
HELD_BITS = 2**29


def _directed(edges: DataFrame, direction: str, types: tuple[str, ...] | None) -> DataFrame:
    """project, from, to, edge_type along the direction, loops and repeats left out."""
    e = of_types(edges, types)
    out = e.select("project", F.col("source").alias("from"), F.col("target").alias("to"), "edge_type")
    into = e.select("project", F.col("target").alias("from"), F.col("source").alias("to"), "edge_type")
    chosen = {"out": out, "in": into}.get(direction)
    chosen = out.unionByName(into) if chosen is None else chosen
    return chosen.where(F.col("from") != F.col("to"))


def _ahead(step: DataFrame, frontier: DataFrame, hot: list[tuple]) -> DataFrame:
    """The steps that go on from the frontier, one row of which meets all steps of its node."""
    at = frontier.withColumnRenamed("id", "from")
    return salted_join(step, at, ["project", "from"], "inner", "to", hot=hot) if hot else at.join(step, ["project", "from"])


def levels(edges: DataFrame, seeds: DataFrame, direction: str = "out", types: tuple[str, ...] | None = None, max_depth: int | None = None, with_path: bool = False) -> DataFrame:
    """project, id, depth (and path) of every node reached from any seed (project, id); seeds have depth 0.

    with_path keeps one shortest path from a seed as ids joined by ' > '; among paths of one length the smallest."""
    step = _directed(edges, direction, types).groupBy("project", "from", "to").agg(F.min("edge_type").alias("edge_type")) if with_path else _directed(edges, direction, types).select("project", "from", "to").distinct()
    step = cut(step)
    hot = hot_keys(step, ["project", "from"])  # hubs, spread in every round
    start = seeds.select(*KEY).distinct().withColumn("depth", F.lit(0))
    frontier = cut(start.withColumn("path", F.col("id")) if with_path else start)
    seen = frontier
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = _ahead(step, frontier, hot)
        if with_path:
            new = reached.groupBy("project", F.col("to").alias("id")).agg(F.min(F.concat_ws(" > ", "path", "to")).alias("path")).withColumn("depth", F.lit(depth))
            new = new.select("project", "id", "depth", "path")
        else:
            new = reached.select("project", F.col("to").alias("id")).distinct().withColumn("depth", F.lit(depth))
        frontier = cut(new.join(seen.select(*KEY), KEY, "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = cut(seen)
    return seen


def reachable(edges: DataFrame, seeds: DataFrame, direction: str = "out", types: tuple[str, ...] | None = None, max_depth: int | None = None) -> DataFrame:
    """Nodes reached from the seeds, without the seeds."""
    return levels(edges, seeds, direction, types, max_depth).where("depth > 0")


def diff_impact(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Nodes that depend on changed nodes, directly or not, over all edge types: project, id, depth, path, risk_score,
    high_risk; changed nodes themselves are left out. Riskiest first is an ordering for the reader."""
    hit = levels(edges, changed, "in", with_path=True).where("depth > 0")
    return hit.join(nodes.select(*KEY, "label", "risk_score"), KEY).withColumn("high_risk", F.coalesce(F.col("risk_score") >= 0.7, F.lit(False)))


def changed_nodes(nodes: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """(project, id) of nodes whose file, or id, is or ends in one of the changed files (project, changed). strict:
    only at a path step. The join is on the last path step, the rest of the suffix is checked."""
    tail = lambda c: F.substring_index(c, "/", -1)
    v = nodes.select(*KEY, F.explode(F.array_distinct(F.filter(F.array(F.col("file"), F.col("id")), lambda p: p.isNotNull()))).alias("path")).withColumn("tail", tail("path"))
    ends = F.col("path").endswith(F.col("changed"))
    if strict:
        ends = (F.col("path") == F.col("changed")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("changed"))) | F.col("path").endswith(F.concat(F.lit(":"), F.col("changed")))
    wanted = files.where("changed <> ''").select("project", "changed").distinct().withColumn("tail", tail("changed"))
    return v.join(wanted, ["project", "tail"]).where(ends).select(*KEY).distinct()


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 10, types: tuple[str, ...] | None = None) -> DataFrame:
    """One undirected shortest path for each pair (project, start, goal): n_edges and path, the smallest among equals;
    pairs farther apart than max_depth have none. A pair's search stops when its goal is met."""
    step = cut(_directed(edges, "both", types).select("project", "from", "to").distinct())
    pairs = cut(pairs.select("project", "start", "goal").distinct())
    frontier = cut(pairs.select("project", "start", "goal", F.col("start").alias("id"), F.col("start").alias("path")))
    seen = frontier.select("project", "start", "goal", "id")
    found = frontier.where("id = goal").withColumn("n_edges", F.lit(0))
    key = ["project", "start", "goal"]
    for depth in range(1, max_depth + 1):
        open_ = frontier.join(found.select(*key), key, "left_anti")
        new = (
            open_.withColumnRenamed("id", "from").join(step, ["project", "from"]).groupBy(*key, F.col("to").alias("id"))
            .agg(F.min(F.concat_ws(" > ", "path", "to")).alias("path")).join(seen, [*key, "id"], "left_anti")
        )
        frontier = cut(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select(*key, "id"))
        found = cut(found.unionByName(frontier.where("id = goal").withColumn("n_edges", F.lit(depth)).select(*found.columns)))
    return found.select(*key, "n_edges", "path")


def blast_radius(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """project, id, n_dependents, blast of every node: the nodes that reach it (itself too when it lies on a cycle) and
    their share of the project's nodes, at most 1. Edges without a project or an end are left out.

    The dependents of a project of up to WHOLE_EDGES edges are counted in one task, as bits passed along the graph of its
    strongly connected components, so no pair is listed. The closure of a larger one is made by joins."""
    step, rest = _whole_projects(of_types(edges, types).select("project", F.col("source").alias("up"), F.col("target").alias("down")).dropna())

    def counts(project, names, ups, downs):
        return pa.record_batch([pa.array([project] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(dependent_counts(len(names), ups, downs, HELD_BITS), pa.int64())], names=[*KEY, "n_dependents"])

    counted = _each_project(step, counts, "project string, id string, n_dependents long")
    return _shares(nodes, counted if rest is None else counted.unionByName(_closure(rest)))


def on_short_cycles(edges: DataFrame, types: tuple[str, ...] = ("imports", "depends_on"), longest: int = 6) -> DataFrame:
    """(project, id) of the nodes of simple_cycles(), which are those whose shortest cycle has at most ``longest`` edges.
    No cycle is listed but in projects of more than WHOLE_EDGES edges."""
    e = of_types(edges, types).where("source <> target")
    step, rest = _whole_projects(e.select("project", F.col("source").alias("up"), F.col("target").alias("down")).dropna())

    def met(project, names, ups, downs):
        found = [names[v] for v in short_cycle_nodes(len(names), ups, downs, longest, HELD_BITS)]
        return pa.record_batch([pa.array([project] * len(found), pa.string()), pa.array(found, pa.string())], names=KEY)

    found = _each_project(step, met, "project string, id string")
    if rest is None:
        return found
    listed = simple_cycles(rest.select("project", F.col("up").alias("source"), F.col("down").alias("target"), F.lit(types[0]).alias("edge_type")), types, longest)
    return found.unionByName(listed.select("project", F.explode("cycle").alias("id")).distinct())


def _whole_projects(step: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The edges of projects of up to WHOLE_EDGES edges, and those of larger ones if there are any."""
    large = step.groupBy("project").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE_EDGES).select("project").collect()
    if not large:
        return step, None
    names = F.broadcast(step.sparkSession.createDataFrame(large, "project string"))  # at most one in WHOLE_EDGES edges
    return step.join(names, "project", "left_anti"), step.join(names, "project", "left_semi")


def _closure(step: DataFrame) -> DataFrame:
    """project, id, n_dependents by a semi-naive closure over pairs; its size is the number of (node, dependent) pairs."""
    step = cut(step.distinct())
    frontier = cut(step.select("project", "up", F.col("down").alias("id")))
    seen, rounds = frontier, 0
    while True:
        rounds += 1
        ahead = frontier.withColumnRenamed("up", "mid").join(step.select("project", "up", F.col("down").alias("mid")), ["project", "mid"]).select("project", "up", "id").distinct()
        frontier = cut(ahead.join(seen, ["project", "up", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if rounds % 8 == 0:
            seen = cut(seen)
    return seen.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_dependents"))


def _each_project(step: DataFrame, made, ddl: str) -> DataFrame:
    """The batches that made(project, names, ups, downs) gives for the edges (project, up, down) of each project, whose ends
    are places in names."""

    def run(batches):
        at, number, ups, downs = None, {}, array("i"), array("i")
        for b in batches:
            for project, up, down in zip(*(b.column(i).to_pylist() for i in range(3))):
                if project != at:
                    if number:
                        yield made(at, list(number), ups, downs)
                    at, number, ups, downs = project, {}, array("i"), array("i")
                ups.append(number.setdefault(up, len(number)))
                downs.append(number.setdefault(down, len(number)))
        if number:
            yield made(at, list(number), ups, downs)

    return step.repartition("project").sortWithinPartitions("project").mapInArrow(run, ddl)


def dependent_counts(n: int, ups, downs, bits: int) -> list[int]:
    """For each of the nodes 0 to n - 1 the number of nodes that reach it along the edges ups -> downs.

    Components come in topological order, each with one bit a node. A block of at most about ``bits`` bits over all
    components is passed on at a time, so the memory is bounded whatever the graph; long chains take no more rounds."""
    ups, downs = np.asarray(ups, np.int64), np.asarray(downs, np.int64)
    part = np.array(_components(n, ups, downs), np.int64)
    m = int(part.max()) + 1
    above, below = part[ups], part[downs]
    cyclic = np.zeros(m, bool)
    cyclic[above[above == below]] = True
    pairs = np.unique((below * m + above)[above != below])
    first = np.searchsorted(pairs, np.arange(m + 1) * m).tolist()
    above, cyclic = (pairs % m).tolist(), cyclic.tolist()
    place = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=m))])
    width = max(bits // m, 64)
    counts = [0] * m
    places = place.tolist()
    for low in range(0, n, width):
        high = min(low + width, n)
        begin = int(np.searchsorted(place, low, side="right")) - 1  # nothing before it is reached from the block
        held = [0] * m
        for c in range(begin, m):
            got = 0
            for u in above[first[c] : first[c + 1]]:
                got |= held[u]
            x, y = max(places[c], low), min(places[c + 1], high)
            own = got | ((1 << (y - low)) - (1 << (x - low))) if x < y else got
            counts[c] += (own if cyclic[c] else got).bit_count()
            held[c] = own
    return [counts[c] for c in part.tolist()]


def short_cycle_nodes(n: int, ups, downs, longest: int, bits: int) -> list[int]:
    """The nodes with a way back to themselves of 2 to ``longest`` edges ups -> downs: in each strongly connected component
    bits of its nodes, a block at a time, are passed on that many times."""
    ups, downs = np.asarray(ups, np.int64), np.asarray(downs, np.int64)
    part = np.array(_components(n, ups, downs), np.int64)
    inner = (part[ups] == part[downs]) & (ups != downs)
    pairs = np.unique(np.stack([part[ups], ups, downs], 1)[inner], axis=0)
    found = []
    for edges in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1) if len(pairs) else []:
        members, place = np.unique(edges[:, 1:], return_inverse=True)
        size, place = len(members), place.reshape(-1, 2).tolist()
        if size <= longest:  # any cycle there is as short
            found += members.tolist()
            continue
        before = [[] for _ in range(size)]
        for u, v in place:
            before[v].append(u)
        width = max(bits // size, 64)
        for low in range(0, size, width):
            left = range(low, min(low + width, size))
            held = [1 << (v - low) if v in left else 0 for v in range(size)]
            for _ in range(longest):
                ahead = []
                for near in before:
                    got = 0
                    for u in near:
                        got |= held[u]
                    ahead.append(got)
                held = ahead
                found += [int(members[v]) for v in left if held[v] >> (v - low) & 1]
                left = [v for v in left if not held[v] >> (v - low) & 1]
                if not left:
                    break
    return found


def _components(n: int, ups: np.ndarray, downs: np.ndarray) -> list[int]:
    """The strongly connected component of each node, numbered so that edges between components lead to higher ones
    (Tarjan's algorithm against the edges, without recursion)."""
    before = ups[np.argsort(downs, kind="stable")].tolist()
    first = np.concatenate([[0], np.cumsum(np.bincount(downs, minlength=n))]).tolist()
    following, met, low, part = first[:n], [0] * n, [0] * n, [-1] * n
    open_, clock, found = [], 0, 0
    for root in range(n):
        if met[root]:
            continue
        clock += 1
        met[root] = low[root] = clock
        open_.append(root)
        path = [root]
        while path:
            v = path[-1]
            if following[v] < first[v + 1]:
                u = before[following[v]]
                following[v] += 1
                if not met[u]:
                    clock += 1
                    met[u] = low[u] = clock
                    open_.append(u)
                    path.append(u)
                elif part[u] < 0:
                    low[v] = min(low[v], met[u])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == met[v]:
                u = None
                while u != v:
                    u = open_.pop()
                    part[u] = found
                found += 1
    return part


def _shares(nodes: DataFrame, counted: DataFrame) -> DataFrame:
    sizes = nodes.groupBy("project").agg(F.count(F.lit(1)).alias("n_nodes"))
    joined = nodes.select(*KEY).join(sizes, "project").join(counted, KEY, "left")
    n = F.coalesce("n_dependents", F.lit(0))
    return joined.select(*KEY, n.cast("long").alias("n_dependents"), F.round(F.least(n / F.col("n_nodes"), F.lit(1.0)), 6).alias("blast"))


def blast_radius_approx(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] | None = None, bits: int = 11) -> DataFrame:
    """blast_radius() with a distinct-count sketch for each node passed along the edges until nothing grows: one sketch
    an edge and round, for graphs whose closure is too large to list."""
    step = cut(of_types(edges, types).select("project", F.col("source").alias("up"), F.col("target").alias("id")).distinct())
    own = step.groupBy(*KEY).agg(F.hll_sketch_agg("up", bits).alias("sketch"))
    state = cut(own.withColumn("size", F.hll_sketch_estimate("sketch")))
    while True:
        sent = step.join(state.select("project", F.col("id").alias("up"), "sketch"), ["project", "up"]).select(*KEY, "sketch")
        grown = sent.unionByName(state.select(*KEY, "sketch")).groupBy(*KEY).agg(F.hll_union_agg("sketch").alias("sketch")).withColumn("size", F.hll_sketch_estimate("sketch"))
        grown = cut(grown)
        more = grown.join(state.select(*KEY, F.col("size").alias("was")), KEY, "left").where(F.coalesce("was", F.lit(-1)) < F.col("size"))
        state = grown
        if more.isEmpty():
            break
    return _shares(nodes, state.select(*KEY, F.col("size").alias("n_dependents")))


def simple_cycles(edges: DataFrame, types: tuple[str, ...] = ("imports", "depends_on"), longest: int = 6) -> DataFrame:
    """project, n (length) and cycle (ids from the smallest on) of every simple cycle of 2 to ``longest`` edges, once.

    Nodes that can't lie on a cycle are peeled off first. Paths then grow only through ids above their first, so
    each cycle is found from its smallest node; the rounds are bounded by the length."""
    e = cut(of_types(edges, types).where("source <> target").select("project", F.col("source").alias("from"), F.col("target").alias("to")).distinct())
    for _ in range(20):
        heads, tails = e.select("project", F.col("to").alias("from")).distinct(), e.select("project", F.col("from").alias("to")).distinct()
        kept = cut(e.join(heads, ["project", "from"], "left_semi").join(tails, ["project", "to"], "left_semi").select("project", "from", "to"))
        same = kept.count() == e.count()
        e = kept
        if same:
            break
    paths = e.where("from < to").select("project", F.col("from").alias("first"), F.col("to").alias("last"), F.array("from", "to").alias("cycle"))
    found = None
    for n in range(2, longest + 1):
        closing = e.select("project", F.col("from").alias("last"), F.col("to").alias("first"))
        closed = paths.join(closing, ["project", "last", "first"], "left_semi").select("project", F.lit(n).alias("n"), "cycle")
        found = closed if found is None else found.unionByName(closed)
        if n < longest:
            ahead = paths.join(e.withColumnRenamed("from", "last"), ["project", "last"]).where((F.col("to") > F.col("first")) & ~F.array_contains("cycle", F.col("to")))
            paths = cut(ahead.select("project", "first", F.col("to").alias("last"), F.concat("cycle", F.array("to")).alias("cycle")))
    return found


def topological_levels(edges: DataFrame, types: tuple[str, ...] = ("calls", "imports", "depends_on")) -> DataFrame:
    """project, id, level of the nodes Kahn's peel can order: a node's level is the longest path that leads to it.
    Nodes on a cycle or behind one have no level."""
    e = cut(of_types(edges, types).where("source <> target").select("project", "source", "target").distinct())
    left = cut(e.select("project", F.explode(F.array("source", "target")).alias("id")).distinct())
    done, level = None, 0
    while True:
        blocked = e.select("project", F.col("target").alias("id")).distinct()
        free = cut(left.join(blocked, KEY, "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        gone = free.select("project", F.col("id"))
        left = cut(left.join(gone, KEY, "left_anti"))
        e = cut(e.join(gone.withColumnRenamed("id", "source"), ["project", "source"], "left_anti").select("project", "source", "target"))
        level += 1
    return done if done is not None else left.withColumn("level", F.lit(0))


def tours(nodes: DataFrame, edges: DataFrame, starts: DataFrame, steps: int = 10, walk: int = 12) -> DataFrame:
    """project, pos, id: for each project a walk over files from its best start (project, id, rank), breadth first by
    imports, of the first ``walk`` files seen ``steps`` kept; projects whose walk has one file give none. pos is
    by depth, then id."""
    files = nodes.where("node_type = 'file'").select(*KEY)
    e = of_types(edges, ("imports",)).join(files.withColumnRenamed("id", "target"), ["project", "target"], "left_semi").select("project", "source", "target", "edge_type")
    first = starts.join(files, KEY, "left_semi").groupBy("project").agg(F.min_by("id", F.struct("rank", "id")).alias("id"))
    seen = levels(e, first, "out", max_depth=walk - 1)  # a walk of so many files goes no deeper
    w = Window.partitionBy("project").orderBy("depth", "id")
    ranked = seen.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= min(steps, walk))
    size = ranked.groupBy("project").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    return ranked.join(size, "project").select("project", "pos", "id", "depth")
