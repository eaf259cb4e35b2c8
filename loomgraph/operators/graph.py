"""Relational operators over the nodes and edges of property graphs, one graph for each project.

nodes: (project, id, ...), edges: (project, source, target, edge_type, weight, ord). normalize() gives both in
canonical form; the other operators expect that form. Joins are on (project, id); a hot target is salted where
the larger side is joined to single rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..session import HOT_ROWS, cut, hot_keys, salted_join
from .orphans import canonical_id

KEY = ["project", "id"]


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """The last row (largest ord) of each (project, canonical id), all columns. Rows without an id are left out."""
    whole = F.struct(*[c for c in nodes.columns if c not in ("project", "id")])
    picked = nodes.where(F.col("id").isNotNull()).select("project", canonical_id("id").alias("id"), whole.alias("_row")).groupBy(*KEY).agg(F.max_by("_row", F.coalesce(F.col("_row.ord"), F.lit(-1))).alias("_row"))
    return picked.select("project", "id", "_row.*")


def first_edges(edges: DataFrame) -> DataFrame:
    """The first edge (smallest ord, then id) of each (project, source, target, type) with canonical ends."""
    ends = edges.select("project", canonical_id("source").alias("source"), canonical_id("target").alias("target"), "edge_type", "weight", "ord", "edge_id").where(
        F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != "") & (F.col("target") != "")
    )
    first = F.min(F.struct(F.coalesce("ord", F.lit(2**62)).alias("ord"), "edge_id", "weight")).alias("_row")
    return ends.groupBy("project", "source", "target", "edge_type").agg(first).select("project", "source", "target", "edge_type", "_row.*")


def live_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes of the project."""
    ids = nodes.select("project", "id")
    there = salted_join(edges, ids.withColumnRenamed("id", "target"), ["project", "target"], "left_semi", "source")
    return salted_join(there, ids.withColumnRenamed("id", "source"), ["project", "source"], "left_semi", "target")


def flip_tests(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """tested_by edges that point at a test file turned round, so that they run from test to source."""
    path = F.coalesce("file", "label", F.lit(""))
    tests = nodes.where(P.is_test_path(path)).select("project", F.col("id").alias("target"), F.lit(True).alias("_test"))
    turn = (F.col("edge_type") == "tested_by") & F.coalesce("_test", F.lit(False))
    joined = edges.join(tests, ["project", "target"], "left")
    return joined.select(
        "project", F.when(turn, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(turn, F.col("source")).otherwise(F.col("target")).alias("target"),
        *[c for c in edges.columns if c not in ("project", "source", "target")],
    )


def plain_edges(edges: DataFrame, nodes: DataFrame, types: tuple[str, ...] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """project, source, target, edge_type of the normalised edges of the latest nodes, each row shuffled by its source and
    by its target once. Only projects of hot_rows edges can have hot ends; the others' are not looked for."""
    kinds = of_types(edges, types)
    ends = kinds.select("project", canonical_id("source").alias("source"), canonical_id("target").alias("target"), "edge_type").where("project is not null and source <> '' and target <> ''")
    large = ends.groupBy("project").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_rows).select("project").collect()
    hot: dict[str, list] = {"source": [], "target": []}
    if large:
        within = ends.join(F.broadcast(edges.sparkSession.createDataFrame(large, "project string")), "project", "left_semi")
        hot = {end: hot_keys(within, ["project", end], hot_rows) for end in hot}
    first = (ends if hot["source"] else ends.repartition("project", "source")).distinct()
    ids = nodes.select("project", F.col("id").alias("source"))
    there = salted_join(first, ids, ["project", "source"], "left_semi", "target", hot=hot["source"])
    tests = nodes.select("project", F.col("id").alias("target"), P.is_test_path(F.coalesce("file", "label", F.lit(""))).alias("_test"))
    joined = salted_join(there, tests, ["project", "target"], "inner", "source", hot=hot["target"])
    turn = (F.col("edge_type") == "tested_by") & F.coalesce("_test", F.lit(False))
    return joined.select("project", F.when(turn, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(turn, F.col("source")).otherwise(F.col("target")).alias("target"), "edge_type")


def normalize(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical ids, last row of each node, first of each edge, no dangling edges, tests pointing at sources."""
    v = cut(latest_nodes(nodes))
    return v, flip_tests(live_edges(cut(first_edges(edges)), v), v)


def normalization_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per project: nodes with a doubled prefix, repeated nodes, repeated edges, dangling edges, turned tests."""
    v = cut(latest_nodes(nodes))
    first = cut(first_edges(edges))
    live = live_edges(first, v)
    tests = v.where(P.is_test_path(F.coalesce("file", "label", F.lit("")))).select("project", F.col("id").alias("target"))
    turned = live.where("edge_type = 'tested_by'").join(tests, ["project", "target"], "left_semi")
    written = edges.where("source <> '' and target <> ''")

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("project").agg(F.count(F.lit(1)).alias("n")).select("project", F.lit(name).alias("what"), "n")

    doubled = nodes.where(F.col("id") != canonical_id("id"))
    parts = [count(doubled, "double_prefix"), count(nodes.where("id is not null"), "nodes"), count(v, "kept_nodes"), count(written, "edges"), count(first, "kept_edges"), count(live, "live_edges"), count(turned, "turned")]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    by = {w: F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)) for w in ("double_prefix", "nodes", "kept_nodes", "edges", "kept_edges", "live_edges", "turned")}
    return whole.groupBy("project").agg(
        by["double_prefix"].alias("double_prefix"), (by["nodes"] - by["kept_nodes"]).alias("deduped_nodes"), (by["edges"] - by["kept_edges"]).alias("deduped_edges"),
        (by["kept_edges"] - by["live_edges"]).alias("dangling_edges"), by["turned"].alias("tested_by_fixed"),
    )


def of_types(edges: DataFrame, types: tuple[str, ...] | None) -> DataFrame:
    return edges if types is None else edges.where(F.col("edge_type").isin(*types))


def degrees(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """project, id, in_degree, out_degree, degree of every node. One aggregation over both ends, combined map-side."""
    e = of_types(edges, types)
    ends = e.select("project", F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    counted = ends.select("project", "x.*").groupBy(*KEY).agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    zero = F.lit(0).cast("long")
    out, into = F.coalesce("out_degree", zero), F.coalesce("in_degree", zero)
    return nodes.select(*KEY).join(counted, KEY, "left").select(*KEY, into.alias("in_degree"), out.alias("out_degree"), (into + out).alias("degree"))


def neighbors(edges: DataFrame, seeds: DataFrame, direction: str = "both") -> DataFrame:
    """project, id, neighbor, direction ('out' or 'in'), edge_type of each seed (project, id); a loop is out only."""
    parts = []
    if direction in ("out", "both"):
        parts.append(edges.select("project", F.col("source").alias("id"), F.col("target").alias("neighbor"), F.lit("out").alias("direction"), "edge_type"))
    if direction in ("in", "both"):
        parts.append(edges.where("source <> target").select("project", F.col("target").alias("id"), F.col("source").alias("neighbor"), F.lit("in").alias("direction"), "edge_type"))
    joined = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return joined.join(seeds.select(*KEY).distinct(), KEY, "left_semi")


def incident_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges with a seed at either end, once each."""
    ids = seeds.select("project", F.col("id")).distinct()
    a = edges.join(ids.withColumnRenamed("id", "source"), ["project", "source"], "left_semi").select(*edges.columns)
    b = edges.join(ids.withColumnRenamed("id", "target"), ["project", "target"], "left_semi").select(*edges.columns)
    return a.unionByName(b).distinct()


def resolve_ids(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (project, asked) -> asked, id: the exact id, else with the file prefix, else its path, else the first
    node in order whose id ends in the text. The suffix tier joins on the last path step and checks the rest."""
    v = nodes.select("project", "id", "file", "ord")
    bare = F.regexp_replace("asked", r"^file:", "")
    w = wanted.select("project", "asked").distinct()
    exact = F.explode(F.array_distinct(F.array(F.struct(F.lit(1).alias("tier"), F.col("asked").alias("id")), F.struct(F.lit(2).alias("tier"), F.concat(F.lit("file:"), F.col("asked")).alias("id")), F.struct(F.lit(3).alias("tier"), bare.alias("id")))))
    first = w.withColumn("x", exact).select("project", "asked", "x.*").join(v.select("project", "id", "ord"), KEY)
    tail = lambda c: F.substring_index(c, "/", -1)
    ends = v.select("project", "id", "ord", F.explode(F.array_distinct(F.array(tail(F.col("id")), tail(F.coalesce("file", "id"))))).alias("tail"), "file")
    suffix = w.withColumn("tail", tail(F.col("asked"))).join(ends, ["project", "tail"]).where(F.col("id").endswith(F.col("asked")) | F.col("file").endswith(F.col("asked"))).select("project", "asked", F.lit(4).alias("tier"), "id", "ord")
    return first.select("project", "asked", "tier", "id", "ord").unionByName(suffix).groupBy("project", "asked").agg(F.min_by("id", F.struct("tier", "ord", "id")).alias("id"))


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (first of each key) with an end that is no node; missing_source and missing_target say which."""
    ids = nodes.select("project", "id").withColumn("_there", F.lit(True))
    e = cut(first_edges(edges))
    e = salted_join(e, ids.withColumnsRenamed({"id": "source", "_there": "_s"}), ["project", "source"], "left", "target")
    e = salted_join(e, ids.withColumnsRenamed({"id": "target", "_there": "_t"}), ["project", "target"], "left", "source")
    return e.where(F.col("_s").isNull() | F.col("_t").isNull()).select("project", "source", "target", "edge_type", F.col("_s").isNull().alias("missing_source"), F.col("_t").isNull().alias("missing_target"))


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of any type without an edge."""
    ends = edges.select("project", F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.select("project", "id", "node_type").join(ends, KEY, "left_anti")


def nodes_without_tests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """File, function and class nodes outside test files that no tested_by edge points at."""
    tested = edges.where("edge_type = 'tested_by'").select("project", F.col("target").alias("id")).distinct()
    code = nodes.where(F.col("node_type").isin("file", "function", "class") & ~P.is_test_path(F.coalesce("file", "id")))
    return code.select("project", "id", "node_type").join(tested, KEY, "left_anti")


def directly_tested(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, id) at the target of a tested_by or calls edge from a test node."""
    tests = nodes.where(P.is_test_label("label")).select("project", F.col("id").alias("source"))
    return edges.where(F.col("edge_type").isin("tested_by", "calls")).join(tests, ["project", "source"], "left_semi").select("project", F.col("target").alias("id")).distinct()


def layer_map(nodes: DataFrame, layers: DataFrame) -> DataFrame:
    """project, id, layer: the node's own layer, else the name of the first layer (by id) listing it; repeated layer
    rows count once."""
    listed = layers.select("project", F.col("id").alias("layer_id"), "layer_name", F.explode("node_ids").alias("m")).where("m is not null and m <> ''")
    first = listed.select("project", canonical_id("m").alias("id"), "layer_id", "layer_name").groupBy(*KEY).agg(F.min_by(F.lower("layer_name"), "layer_id").alias("_listed"))
    return nodes.select("project", "id", "layer").join(first, KEY, "left").select(*KEY, F.coalesce("layer", "_listed").alias("layer"))


def with_end_columns(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Edges with columns of both ends, as source_<c> and target_<c>."""
    for end in ("target", "source"):
        side = nodes.select("project", F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        edges = salted_join(edges, side, ["project", end], "inner", "source" if end == "target" else "target")
    return edges


def layer_edges(edges: DataFrame, layers_of: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """project, source_layer, target_layer, n_edges between different layers."""
    e = with_end_columns(of_types(edges, types).select("project", "source", "target", "edge_type"), layers_of.where("layer is not null"), ["layer"])
    return e.where("source_layer <> target_layer").groupBy("project", "source_layer", "target_layer").agg(F.count(F.lit(1)).alias("n_edges"))


def adjacency_cells(nodes: DataFrame, edges: DataFrame, layers_of: DataFrame, size: int = 120) -> DataFrame:
    """Matrix cells among the ``size`` best connected nodes of each project: row and column index by layer rank and
    label, the summed weights (1 when null) and the type of the last edge."""
    top = degrees(nodes, edges).withColumn("_n", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("degree"), "id"))).where(F.col("_n") <= size)
    known = top.join(nodes.select(*KEY, "label"), KEY).join(layers_of.select(*KEY, "layer"), KEY, "left")
    order = Window.partitionBy("project").orderBy(F.coalesce(P.layer_rank("layer"), F.lit(99)), "label", "id")
    place = known.select(*KEY, (F.row_number().over(order) - 1).alias("at"))
    cells = edges.join(place.withColumnsRenamed({"id": "source", "at": "row_index"}), ["project", "source"]).join(place.withColumnsRenamed({"id": "target", "at": "column_index"}), ["project", "target"])
    return cells.groupBy("project", "row_index", "column_index").agg(
        F.round(F.sum(F.coalesce("weight", F.lit(1.0))), 6).alias("weight"), F.max_by("edge_type", F.struct("ord", "edge_type")).alias("last_type"), F.count(F.lit(1)).alias("n_edges")
    )


def layer_stats(nodes: DataFrame, layers_of: DataFrame) -> DataFrame:
    """project, layer, members, high_risk, with_smells."""
    v = nodes.select(*KEY, "risk_score", F.size(F.coalesce("structural_warnings", F.array())).alias("w")) if "structural_warnings" in nodes.columns else nodes
    return v.join(layers_of.select(*KEY, "layer"), KEY).where("layer is not null").groupBy("project", "layer").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("risk_score") >= 0.7).alias("high_risk"), F.count_if(F.col("w") > 0).alias("with_smells")
    )


def facet_filter(nodes: DataFrame, node_types=None, complexities=None, layers=None, tiers=None) -> DataFrame:
    """Nodes that pass every facet set given."""
    for column, allowed in (("node_type", node_types), ("complexity", complexities), ("layer", layers)):
        if allowed is not None:
            nodes = nodes.where(F.col(column).isin(*allowed))
    return nodes if tiers is None else nodes.where(P.risk_tier("risk_score").isin(*tiers))


def edge_facet(edges: DataFrame, categories: list[str]) -> DataFrame:
    from ..model import EDGE_CATEGORIES

    return edges.where(F.col("edge_type").isin(*[t for c in categories for t in EDGE_CATEGORIES[c]]))


def treemap(nodes: DataFrame, path: Column | str = "file", lines: Column | str | None = None) -> DataFrame:
    """project, folder, depth, n_files, n_lines summed over every folder prefix of the file paths ('' is the root)."""
    p = F.col(path) if isinstance(path, str) else path
    size = F.coalesce(F.col(lines) if isinstance(lines, str) else lines, F.lit(0)) if lines is not None else F.coalesce(F.col("end_line"), F.lit(1))
    files = nodes.where((F.col("node_type") == "file") & p.isNotNull()).select("project", F.split(p, "/").alias("steps"), size.cast("long").alias("n"))
    depth = F.explode(F.sequence(F.lit(0), F.size("steps") - 1)).alias("depth")
    folders = files.select("project", "steps", "n", depth)
    name = F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.expr("slice(steps, 1, depth)"), "/"))
    return folders.groupBy("project", name.alias("folder"), "depth").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_lines"))


def path_tree(nodes: DataFrame) -> DataFrame:
    """One node for each path (files before other types, then order), with its folder and name."""
    best = Window.partitionBy("project", "file").orderBy(F.when(F.col("node_type") == "file", 0).otherwise(1), "ord", "id")
    picked = nodes.where("file is not null and file <> ''").withColumn("_n", F.row_number().over(best)).where("_n = 1")
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    return picked.select("project", folder.alias("folder"), F.substring_index("file", "/", -1).alias("name"), "id", "node_type")


def force_links(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with a size of 1 + 3 * risk and a tier, and one link for each (source, target) without loops."""
    drawn = nodes.select(*KEY, "node_type", F.round(1 + 3 * F.coalesce("risk_score", F.lit(0.0)), 6).alias("size"), P.risk_tier("risk_score", null_tier="none").alias("tier"))
    links = edges.where("source <> target").groupBy("project", "source", "target").agg(F.min_by("edge_type", F.struct("ord", "edge_type")).alias("edge_type"))
    return drawn, links


def duplicate_targets(edges: DataFrame, types: tuple[str, ...], least: int) -> DataFrame:
    """project, id, target for sources with more than ``least`` distinct targets of these types."""
    e = of_types(edges, types).where("source <> target").select("project", F.col("source").alias("id"), "target").distinct()
    many = e.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return e.join(many, KEY)


def domain_fields(domains: DataFrame) -> DataFrame:
    """project, id, label, flow_count, entity_count of domains with array columns."""
    return domains.select("project", "id", "label", F.size(F.coalesce("flows", F.array())).alias("flow_count"), F.size(F.coalesce("entities", F.array())).alias("entity_count"))
