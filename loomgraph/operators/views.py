"""Derived tables a reader of the graph looks at: counts, lists, scalings, summaries and the review of tours.

Windows are never opened over a whole project: extremes and counts are aggregated first and joined back, as there is one
row a project. Lists shown for one node are cut at the stated length, which is the feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from . import graph

KEY = ["project", "id"]


def tour_counts(steps: DataFrame) -> DataFrame:
    """steps (project, tour_id, node_ids) -> project, id, n_tours: in how many tours a node appears, once a tour."""
    each = steps.select("project", "tour_id", F.explode("node_ids").alias("id")).where("id is not null and id <> ''")
    return each.groupBy(*KEY).agg(F.countDistinct("tour_id").alias("n_tours"))


def pattern_histogram(nodes: DataFrame) -> DataFrame:
    """project, pattern, n: nodes that show each design pattern; a pattern listed twice on a node counts twice."""
    return nodes.select("project", F.explode("detected_patterns").alias("pattern")).where("pattern is not null").groupBy("project", "pattern").agg(F.count(F.lit(1)).alias("n"))


def circular_participants(nodes: DataFrame) -> DataFrame:
    """project, id: nodes with a warning of a circular dependency, and the nodes those name."""
    warned = nodes.select(*KEY, F.explode("structural_warnings").alias("w")).where("w.category = 'circular_dependency'")
    ids = F.concat(F.array("id"), F.coalesce("w.related_node_ids", F.array().cast("array<string>")))
    return warned.select("project", F.explode(ids).alias("id")).where("id is not null and id <> ''").distinct()


def schema_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project, path, message of each value that doesn't fit the schema; a path holds the row's number."""
    def bad(df: DataFrame, where: Column, path: Column, message: str) -> DataFrame:
        return df.where(where).select("project", path.alias("path"), F.lit(message).alias("message"))

    at = lambda name, row, column: F.concat_ws(".", F.lit(name), F.col(row).cast("string"), F.lit(column))
    outside = lambda column, allowed: ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    parts = [
        bad(nodes, F.coalesce("id", F.lit("")) == "", at("nodes", "ord", "id"), "Required"), bad(nodes, F.col("label").isNull(), at("nodes", "ord", "label"), "Required"),
        bad(nodes, outside("node_type", model.NODE_TYPES), at("nodes", "ord", "node_type"), "Unknown value"),
        bad(nodes, F.col("complexity").isNotNull() & outside("complexity", model.COMPLEXITIES), at("nodes", "ord", "complexity"), "Unknown value"),
        bad(edges, F.coalesce("source", F.lit("")) == "", at("edges", "ord", "source"), "Required"), bad(edges, F.coalesce("target", F.lit("")) == "", at("edges", "ord", "target"), "Required"),
        bad(edges, outside("edge_type", model.EDGE_TYPES), at("edges", "ord", "edge_type"), "Unknown value"),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def issue_shapes(issues: DataFrame, top: int = 3) -> DataFrame:
    """issues (project, path, message) -> project, rank, shape, n: the commonest shapes, row numbers collapsed. Ties go to the
    smaller text. There are as many shapes as columns and messages, so the ranking is over few rows."""
    shape = F.concat(F.when(F.col("path") == "", "<root>").otherwise(F.regexp_replace("path", r"(^|\.)\d+(?=\.|$)", "$1[]")), F.lit(": "), F.col("message"))
    counted = issues.groupBy("project", shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("project").orderBy(F.desc("n"), "shape")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def node_sizes(nodes: DataFrame, edges: DataFrame, least: float = 5.0, span: float = 15.0, none: float = 8.0) -> DataFrame:
    """project, id, size: in-degree scaled to least .. least + span by the project's largest; ``none`` without any edge."""
    d = graph.degrees(nodes, edges).select(*KEY, "in_degree")
    most = d.groupBy("project").agg(F.max("in_degree").alias("most"))
    size = F.when(F.col("most") == 0, F.lit(none)).otherwise(F.lit(least) + F.col("in_degree") / F.nullif(F.col("most"), F.lit(0)) * span)
    return d.join(most, "project").select(*KEY, F.round(size, 6).alias("size"))


def scaled(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """df with ``scaled``, the value between the group's least (0) and greatest (1); 0 where all are equal."""
    ends = df.groupBy(*group).agg(F.min(value).alias("_least"), F.max(value).alias("_most"))
    share = (F.col(value) - F.col("_least")) / F.when(F.col("_most") == F.col("_least"), F.lit(1.0)).otherwise(F.col("_most") - F.col("_least"))
    return df.join(ends, group).withColumn("scaled", F.round(share, 6)).drop("_least", "_most")


def call_metadata(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls: resolve_calls(); functions (project, path, name, exported) -> project, path, name, internal_calls,
    external_calls, n_callers, is_unused of functions that call or are called; calls of the own name don't count."""
    known = calls.where((F.col("caller") != F.col("callee")) | (F.col("path") != F.col("to_path")))
    n = lambda inner: F.sum(F.when(F.col("internal") == inner, F.col("n")).otherwise(0)).cast("long")
    made = known.groupBy("project", "path", F.col("caller").alias("name")).agg(n(True).alias("internal_calls"), n(False).alias("external_calls"))
    got = known.groupBy("project", F.col("to_path").alias("path"), F.col("callee").alias("name")).agg(F.countDistinct("path", "caller").alias("n_callers"))
    of = functions.groupBy("project", "path", "name").agg(F.max(F.coalesce("exported", F.lit(False))).alias("exported"))
    at = ["project", "path", "name"]
    whole = made.join(got, at, "full").join(of, at)
    zero = F.lit(0).cast("long")
    callers = F.coalesce("n_callers", zero)
    return whole.select(*at, F.coalesce("internal_calls", zero).alias("internal_calls"), F.coalesce("external_calls", zero).alias("external_calls"), callers.alias("n_callers"), ((callers == 0) & ~F.col("exported")).alias("is_unused"))


def layer_members(layers_of: DataFrame) -> DataFrame:
    """project, layer, n_members, id: a row for each member of each layer object; 'general' is none, and layers without
    members have no rows. One row a member, so that no layer is gathered in one place."""
    kept = layers_of.where("layer is not null and layer <> 'general'").select("project", "layer", "id")
    return kept.join(kept.groupBy("project", "layer").agg(F.count(F.lit(1)).alias("n_members")), ["project", "layer"]).select("project", "layer", "n_members", "id")


def summaries(nodes: DataFrame) -> DataFrame:
    """project, summary, bucket, n: smells by category, security findings by severity and category, risk tiers (a missing
    score counts as low), recomputed from the nodes."""
    smells = nodes.select("project", F.explode("structural_warnings").alias("w")).select("project", F.lit("smell").alias("summary"), F.col("w.category").alias("bucket"))
    found = nodes.select("project", F.explode("security_warnings").alias("w"))
    severity = found.where(F.col("w.severity").isin(*model.SEVERITIES)).select("project", F.lit("security_severity").alias("summary"), F.col("w.severity").alias("bucket"))
    category = found.select("project", F.lit("security_category").alias("summary"), F.col("w.category").alias("bucket"))
    r = F.coalesce("risk_score", F.lit(0.0))
    risk = nodes.select("project", F.lit("risk").alias("summary"), F.when(r >= 0.7, "high").when(r >= 0.4, "medium").otherwise("low").alias("bucket"))
    return smells.unionByName(severity).unionByName(category).unionByName(risk).groupBy("project", "summary", F.coalesce("bucket", F.lit("")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def file_search(nodes: DataFrame, text: str) -> DataFrame:
    """project, id, file of the nodes whose file name or path holds the text, case aside; an empty text finds all."""
    return nodes.where(F.col("file").isNotNull() & F.contains(F.lower("file"), F.lit(text.lower()))).select(*KEY, "file")


def domain_graph(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """flows (project, domain, flow_id) -> (nodes: project, id, kind, label; edges: project, source, target): a node for each
    domain and flow, an edge from each domain to its flows."""
    domain, flow = F.concat(F.lit("domain:"), F.col("domain")), F.concat(F.lit("flow:"), F.col("flow_id"))
    each = flows.select("project", "domain", "flow_id").distinct()
    nodes = each.select("project", domain.alias("id"), F.lit("domain").alias("kind"), F.col("domain").alias("label")).distinct()
    inner = each.where("flow_id is not null").select("project", flow.alias("id"), F.lit("flow").alias("kind"), F.col("flow_id").alias("label")).distinct()
    return nodes.unionByName(inner), each.where("flow_id is not null").select("project", domain.alias("source"), flow.alias("target"))


def link_lists(edges: DataFrame, seeds: DataFrame, most: int = 12) -> DataFrame:
    """project, id, direction, pos, other, edge_type: the first links out of and into each seed (project, id), in order of
    the edges; ``most`` a direction are shown."""
    ends = edges.select("project", "ord", "edge_type", F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit("out").alias("direction"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.lit("in").alias("direction"), F.col("source").alias("other")),
    )).alias("x")).select("project", "x.*", "ord", "edge_type")
    w = Window.partitionBy(*KEY, "direction").orderBy("ord", "other", "edge_type")  # the rank limit is applied before the shuffle
    shown = ends.join(seeds.select(*KEY).distinct(), KEY, "left_semi").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)
    return shown.select(*KEY, "direction", "pos", "other", "edge_type")


def sort_by(df: DataFrame, column: str, descending: bool = False, ties: tuple[str, ...] = ("project", "id")) -> DataFrame:
    """Rows in the order of a column chosen by the reader, nulls last, then by the ties."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r} to sort by")
    return df.orderBy(F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last(), *ties)


def tour_issues(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """steps (project, tour_id, pos, node_ids) -> project, tour_id, missing_id: nodes a step names that don't exist."""
    each = steps.select("project", "tour_id", F.explode("node_ids").alias("id")).where("id is not null and id <> ''").withColumn("id", graph.canonical_id("id")).distinct()
    return each.join(nodes.select(*KEY), KEY, "left_anti").select("project", "tour_id", F.col("id").alias("missing_id"))


def repaired_tours(steps: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """The steps all of whose nodes exist, of the tours that keep ``least`` such steps; steps without nodes go."""
    at = ["project", "tour_id", "pos"]
    each = steps.select(*at, F.explode("node_ids").alias("id")).withColumn("id", graph.canonical_id("id"))
    whole = each.join(nodes.select(*KEY).withColumn("_there", F.lit(True)), KEY, "left").groupBy(*at).agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("whole")).where("whole").drop("whole")
    kept = whole.groupBy("project", "tour_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    return steps.join(whole, at, "left_semi").join(kept, ["project", "tour_id"], "left_semi")
