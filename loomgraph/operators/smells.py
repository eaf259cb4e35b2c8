"""Structural smells, each one DataFrame (project, node_id, category, severity, heuristic, related_node_ids)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import predicates as P
from . import graph, traversal

KEY = ["project", "id"]
IMPORTS = ("imports", "depends_on")


def _warning(df: DataFrame, category: str, severity, heuristic, related=None) -> DataFrame:
    s = F.lit(severity) if isinstance(severity, str) else severity
    h = F.lit(heuristic) if isinstance(heuristic, str) else heuristic
    r = F.array().cast("array<string>") if related is None else related
    return df.select("project", F.col("id").alias("node_id"), F.lit(category).alias("category"), s.alias("severity"), h.alias("heuristic"), r.alias("related_node_ids"))


def god_nodes(nodes: DataFrame, edges: DataFrame, out_degree: int = model.GOD_OUT_DEGREE, functions: int = model.GOD_FUNCTIONS) -> DataFrame:
    """Files, classes and modules with many outgoing edges, or many contained functions: up to two warnings a node."""
    kinds = nodes.where(F.col("node_type").isin("file", "class", "module")).select(*KEY)
    out = graph.degrees(nodes, edges).join(kinds, KEY, "left_semi").where(F.col("out_degree") > out_degree)
    inner = nodes.where("node_type = 'function'").select("project", F.col("id").alias("target"))
    held = edges.where("edge_type = 'contains'").join(inner, ["project", "target"], "left_semi").groupBy("project", F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > functions).join(kinds, KEY, "left_semi")
    return _warning(out, "god_node", "high", f"out_degree > {out_degree}").unionByName(_warning(held, "god_node", "high", f"function_count > {functions}"))


def circular_dependencies(edges: DataFrame, longest: int = model.CYCLE_LENGTH) -> DataFrame:
    """Members of simple import cycles, one warning for each (node, cycle length): the one with the smallest cycle."""
    cycles = traversal.simple_cycles(edges, IMPORTS, longest)
    members = cycles.select("project", "n", "cycle", F.explode("cycle").alias("id"))
    one = members.groupBy(*KEY, "n").agg(F.min("cycle").alias("cycle"))
    severity = F.when(F.col("n") <= 3, "high").otherwise("medium")
    return _warning(one, "circular_dependency", severity, F.concat(F.lit("cycle_length = "), F.col("n").cast("string")), F.array_except("cycle", F.array("id")))


def orphan_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files without an edge that are no entry points."""
    bare = graph.orphan_nodes(nodes.where((F.col("node_type") == "file") & ~P.is_entry_point(F.coalesce("file", "id"))), edges)
    return _warning(bare, "orphan_node", "low", "degree = 0")


def over_connected(nodes: DataFrame, edges: DataFrame, degree: int = model.OVER_CONNECTED) -> DataFrame:
    return _warning(graph.degrees(nodes, edges).where(F.col("degree") > degree), "over_connected", "medium", f"total_degree > {degree}")


def unstable_interfaces(nodes: DataFrame, edges: DataFrame, changes: DataFrame, frequency: int = model.UNSTABLE_CHANGES, in_degree: int = model.UNSTABLE_IN_DEGREE) -> DataFrame:
    """Nodes that change often and many depend on. changes: (project, id, change_frequency)."""
    hot = graph.degrees(nodes, edges).where(F.col("in_degree") > in_degree).join(changes.where(F.col("change_frequency") > frequency), KEY)
    return _warning(hot, "unstable_interface", "high", f"change_frequency > {frequency} and in_degree > {in_degree}")


def overlapping(sets: DataFrame, group: list[str], least: Column) -> DataFrame:
    """sets (*group, id, item), rows distinct -> *group, a, b, na, nb, k: the pairs a < b of a group that may share ``least``
    items, with the sizes of their sets and the number k they share. least: the overlap a set of size n needs.

    Prefix filtering: with every set's items in one order, the rarest first, two sets that share m items share one among
    the first n - m + 1 of each. Items held by nearly all come last, so they bring no pairs together, and nothing is lost."""
    by = [*group, "id"]
    sizes = sets.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    common = sets.groupBy(*group, "item").agg(F.count(F.lit(1)).alias("_held"))
    order = Window.partitionBy(*by).orderBy("_held", "item")
    first = sets.join(common, [*group, "item"]).join(sizes, by).withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= F.col("n") - least + 1).select(*by, "item", "n")
    a, b = first.withColumnsRenamed({"id": "a", "n": "na"}), first.withColumnsRenamed({"id": "b", "n": "nb"})
    met = a.join(b, [*group, "item"]).where("a < b").select(*group, "a", "b", "na", "nb").distinct()
    whole = met.join(sets.withColumnRenamed("id", "a"), [*group, "a"]).join(sets.withColumnRenamed("id", "b"), [*group, "b", "item"])
    return whole.groupBy(*group, "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("k"))


def duplicate_logic(nodes: DataFrame, edges: DataFrame, shared: int = 2) -> DataFrame:
    """Functions of one signature (parameters in twos; complexity, null counting as simple) called by ``shared`` or more of the same nodes.
    Pairs meet by overlapping(); severity goes by the size of the signature's group."""
    params = F.col("metadata").getItem("param_count").try_cast("int") if "metadata" in nodes.columns else F.lit(None).cast("int")
    signature = F.concat_ws("|", F.floor(F.coalesce(params, F.lit(0)) / 2).cast("string"), F.when(F.col("complexity") == "complex", "2").when(F.col("complexity") == "moderate", "1").otherwise("0"))
    f = nodes.where("node_type = 'function'").select("project", F.col("id").alias("target"), signature.alias("sig"))
    calls = edges.where("edge_type = 'calls'").select("project", "source", "target").distinct().join(f, ["project", "target"])
    pairs = overlapping(calls.select("project", "sig", F.col("target").alias("id"), F.col("source").alias("item")), ["project", "sig"], F.lit(shared)).where(F.col("k") >= shared)
    sizes = f.groupBy("project", "sig").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.select("project", "sig", F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select("project", "sig", F.col("b").alias("id"), F.col("a").alias("other")))
    grouped = both.groupBy("project", "sig", "id").agg(F.array_sort(F.collect_set("other")).alias("others")).join(sizes, ["project", "sig"])
    severity = F.when(F.col("size") > 4, "high").when(F.col("size") > 2, "medium").otherwise("low")
    return _warning(grouped, "duplicate_logic", severity, f"shared_callers >= {shared}", F.col("others"))


def unclear_coupling(nodes: DataFrame, edges: DataFrame, imports: int = model.COUPLING_IMPORTS, share: float = model.COUPLING_SHARE) -> DataFrame:
    """Pairs of files or modules with more than ``imports`` import targets each that share more than ``share`` of the
    larger set and no edge of their own. Pairs meet by overlapping(), so a target imported by nearly all makes no pairs."""
    kinds = nodes.where(F.col("node_type").isin("file", "module")).select(*KEY)
    t = graph.duplicate_targets(edges, ("imports",), imports).join(kinds, KEY, "left_semi")
    sets = t.select("project", "id", F.col("target").alias("item"))
    pairs = overlapping(sets, ["project"], F.floor(F.col("n") * F.lit(share)) + 1).where(F.col("k") / F.greatest("na", "nb") > share)
    direct = edges.select("project", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    apart = pairs.join(direct, ["project", "a", "b"], "left_anti")
    return _warning(apart.withColumnRenamed("a", "id"), "unclear_coupling", "medium", f"shared_imports > {share}", F.array("b"))


def low_cohesion(edges: DataFrame, domain_of: DataFrame, domains: int = model.COHESION_DOMAINS, share: float = model.COHESION_SHARE) -> DataFrame:
    """Nodes whose contained functions spread over many domains without a main one. domain_of: (project, id, domain)."""
    held = edges.where("edge_type = 'contains'").select("project", F.col("source").alias("id"), F.col("target")).distinct()
    counts = held.join(domain_of.select("project", F.col("id").alias("target"), "domain"), ["project", "target"]).groupBy(*KEY, "domain").agg(F.count(F.lit(1)).alias("n"))
    spread = counts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("domains"), (F.max("n") / F.sum("n")).alias("main"))
    return _warning(spread.where((F.col("domains") >= domains) & (F.col("main") < share)), "low_cohesion", "medium", f"domains >= {domains} and main_share < {share}")


def name_duplicates(nodes: DataFrame) -> DataFrame:
    """Functions and classes whose label is used three or more times in three or more files of a project."""
    named = nodes.where(F.col("node_type").isin("function", "class") & (F.trim("label") != "")).select(*KEY, F.lower(F.trim("label")).alias("name"), "file")
    groups = named.groupBy("project", "name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files")).where("n >= 3 and files >= 3")
    w = Window.partitionBy("project", "name").orderBy("id")
    first = named.withColumn("_k", F.row_number().over(w)).where("_k <= 6").groupBy("project", "name").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    joined = named.join(groups, ["project", "name"]).join(first, ["project", "name"])
    severity = F.when(F.col("n") >= 5, "high").otherwise("medium")
    return _warning(joined, "name_duplicate", severity, "same_name >= 3", F.slice(F.filter("ids", lambda x: x != F.col("id")), 1, 5))


def layer_violations(edges: DataFrame, layers_of: DataFrame) -> DataFrame:
    """Imports from a lower-ranked layer to a higher one: one warning for each (source, target)."""
    e = graph.with_end_columns(edges.where("edge_type = 'imports'").select("project", "source", "target"), layers_of.where("layer is not null"), ["layer"])
    gap = P.layer_rank("target_layer") - P.layer_rank("source_layer")
    bad = e.withColumn("gap", gap).where("gap > 0")
    return _warning(bad.withColumnRenamed("source", "id"), "layer_violation", F.when(F.col("gap") >= 3, "high").otherwise("medium"), F.concat_ws(" -> ", "source_layer", "target_layer"), F.array("target"))


def path_layers(nodes: DataFrame) -> DataFrame:
    """project, id, layer of files by their path."""
    return nodes.where("node_type = 'file'").select(*KEY, P.layer_of_path(F.coalesce("file", "id")).alias("layer"))


def all_smells(nodes: DataFrame, edges: DataFrame, changes: DataFrame, domain_of: DataFrame | None = None) -> DataFrame:
    """All smells, one for each (node, category, heuristic); layer violations for each target too."""
    found = [god_nodes(nodes, edges), circular_dependencies(edges), orphan_files(nodes, edges), over_connected(nodes, edges), unstable_interfaces(nodes, edges, changes), duplicate_logic(nodes, edges), unclear_coupling(nodes, edges), name_duplicates(nodes)]
    if domain_of is not None:
        found.append(low_cohesion(edges, domain_of))
    whole = reduce(DataFrame.unionByName, found)
    key = ["project", "node_id", "category", "heuristic"]
    one = whole.groupBy(*key).agg(F.min(F.struct("severity", "related_node_ids")).alias("x")).select("project", "node_id", "category", "x.severity", "heuristic", "x.related_node_ids")
    return one.unionByName(layer_violations(edges, path_layers(nodes)))


def smell_summary(warnings: DataFrame) -> DataFrame:
    """project, category, severity, n_warnings, n_nodes."""
    return warnings.groupBy("project", "category", "severity").agg(F.count(F.lit(1)).alias("n_warnings"), F.countDistinct("node_id").alias("n_nodes"))
