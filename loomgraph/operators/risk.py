"""Risk scores, health grades and integrity review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import predicates as P
from . import graph

KEY = ["project", "id"]


def risk_scores(nodes: DataFrame, edges: DataFrame, blast: DataFrame, changes: DataFrame | None = None, tour_counts: DataFrame | None = None, circular: DataFrame | None = None, weights: dict | None = None) -> DataFrame:
    """project, id, blast, coupling, test_gap, churn, risk, factors of nodes that are neither configuration nor tests.

    blast: (project, id, blast). changes: (project, id, change_frequency, recent_commits, n_authors). tour_counts:
    (project, id, n_tours). circular: (project, id) on a cycle. Missing tables count as none."""
    w = weights or model.RISK_WEIGHTS
    v = nodes.where((F.col("node_type") != "config") & ~P.is_test_label("label")).select(*KEY, F.size(F.coalesce("structural_warnings", F.array())).alias("n_warnings") if "structural_warnings" in nodes.columns else F.lit(0).alias("n_warnings"))
    v = v.join(graph.degrees(nodes, edges), KEY).join(blast.select(*KEY, "blast"), KEY, "left")
    v = v.join(graph.directly_tested(nodes, edges).withColumn("tested", F.lit(True)), KEY, "left")
    v = v.join(circular.select(*KEY).distinct().withColumn("circular", F.lit(True)), KEY, "left") if circular is not None else v.withColumn("circular", F.lit(False))
    v = v.join(changes.select(*KEY, "change_frequency", "recent_commits", "n_authors"), KEY, "left") if changes is not None else v.withColumns({c: F.lit(0) for c in ("change_frequency", "recent_commits", "n_authors")})
    v = v.join(tour_counts.select(*KEY, "n_tours"), KEY, "left") if tour_counts is not None else v.withColumn("n_tours", F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    one = F.lit(1.0)
    v = v.withColumn("blast", F.coalesce("blast", F.lit(0.0)))
    v = v.withColumn("coupling", F.least(F.least(F.col("degree") / model.COUPLING_CAP, one) + F.when(F.coalesce("circular", F.lit(False)), 0.2).otherwise(0.0), one))
    v = v.withColumn("test_gap", F.when(F.coalesce("tested", F.lit(False)), 0.0).otherwise(0.5 + F.least(F.col("blast") / 2, F.lit(0.5))))
    v = v.withColumn("churn", F.least(zero("change_frequency") / model.CHURN_CAP, one))
    risk = F.least(F.greatest(w["blast"] * F.col("blast") + w["coupling"] * F.col("coupling") + w["test_gap"] * F.col("test_gap") + w["churn"] * F.col("churn"), F.lit(0.0)), one)
    rules = [
        (F.col("coupling") > 0.6, "high_coupling"), (F.col("test_gap") > 0.5, "no_test_coverage"), (F.col("churn") > 0.5, "frequent_changes"), (F.col("blast") > 0.5, "large_blast_radius"),
        ((zero("n_tours") >= 2) & (F.col("blast") > 0.3), "critical_path"), ((zero("n_authors") == 1) & (zero("change_frequency") > 5), "single_author"), (zero("recent_commits") >= 3, "recent_churn"),
        (zero("n_warnings") > 0, "has_structural_warnings"),
    ]
    factors = F.array_compact(F.array(*[F.when(rule, name) for rule, name in rules]))
    rounded = lambda c: F.round(F.col(c), 9).alias(c)
    return v.select(*KEY, rounded("blast"), rounded("coupling"), rounded("test_gap"), rounded("churn"), F.round(risk, 9).alias("risk"), factors.alias("factors"))


def risk_summary(scores: DataFrame, column: str = "risk") -> DataFrame:
    return scores.groupBy("project", P.risk_tier(column, null_tier="none").alias("tier")).agg(F.count(F.lit(1)).alias("n_nodes"))


def health_score(n_nodes: Column, orphans: Column, circular: Column, god: Column, security: Column, coupling: Column | float = 0.0) -> dict[str, Column]:
    """The five capped penalties, the score and the grade as columns."""
    zero = lambda c: F.coalesce(c if isinstance(c, Column) else F.lit(c), F.lit(0))
    dead = F.least(F.lit(20.0), zero(orphans) / F.greatest(zero(n_nodes), F.lit(1)) * 100)
    p = {
        "dead_code_penalty": dead, "circular_penalty": F.least(F.lit(20.0), zero(circular) * 5.0), "god_node_penalty": F.least(F.lit(15.0), zero(god) * 3.0),
        "coupling_penalty": F.least(F.lit(15.0), F.greatest(F.lit(0.0), zero(coupling) - 3) * 2), "security_penalty": F.least(F.lit(20.0), zero(security) * 5.0),
    }
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - sum(p.values(), F.lit(0.0))))
    half_up = lambda c: F.floor(c + 0.5).cast("int")
    return {"score": half_up(score), "grade": P.grade(score), **{k: half_up(v) for k, v in p.items()}}


def health_report(nodes: DataFrame, edges: DataFrame, smells: DataFrame, security: DataFrame) -> DataFrame:
    """One row a project: sizes, orphans, smell and security counts, risk tiers, score, grade and penalties.
    smells: (project, node_id, category), security: (project, severity)."""
    size = nodes.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_nodes"), *[F.count_if(P.risk_tier("risk_score") == t).alias(f"risk_{t}") for t in ("high", "medium", "low")]
    )
    n_edges = edges.groupBy("project").agg(F.count(F.lit(1)).alias("n_edges"))
    bare = graph.orphan_nodes(nodes, edges).groupBy("project").agg(F.count(F.lit(1)).alias("n_orphans"))
    untested = graph.nodes_without_tests(nodes, edges).groupBy("project").agg(F.count(F.lit(1)).alias("n_untested"))
    smelly = smells.groupBy("project").agg(F.count(F.lit(1)).alias("n_smells"), F.count_if(F.col("category") == "circular_dependency").alias("n_circular"), F.count_if(F.col("category") == "god_node").alias("n_god"))
    unsafe = security.groupBy("project").agg(F.count(F.lit(1)).alias("n_security"), F.count_if(F.col("severity") == "high").alias("n_security_high"))
    whole = reduce(lambda a, b: a.join(b, "project", "left"), [size, n_edges, bare, untested, smelly, unsafe])
    counts = [c for c in whole.columns if c.startswith("n_") or c.startswith("risk_")]
    whole = whole.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in counts})
    s = health_score(F.col("n_nodes"), F.col("n_orphans"), F.col("n_circular"), F.col("n_god"), F.col("n_security_high"))
    return whole.select("project", *counts, *[c.alias(k) for k, c in s.items()])


def integrity_issues(nodes: DataFrame, edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Raw tables in, issues out: project, rule, severity, subject, n. Rules: unknown types, missing ends, loops,
    repeated node ids, files without summary, layers that list missing nodes."""
    ids = nodes.where("id is not null").select("project", graph.canonical_id("id").alias("id")).distinct()
    v = graph.latest_nodes(nodes)
    first = edges.dropDuplicates(["edge_id"])

    def issues(df: DataFrame, rule: str, severity: str, subject) -> DataFrame:
        return df.groupBy("project", subject.alias("subject")).agg(F.count(F.lit(1)).alias("n")).select("project", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "subject", "n")

    ends = first.select("project", F.explode(F.array("source", "target")).alias("id")).where("id is not null and id <> ''").withColumn("id", graph.canonical_id("id"))
    members = layers.dropDuplicates(["project", "id"]).select("project", F.col("id").alias("layer_id"), F.explode("node_ids").alias("m")).where("m is not null and m <> ''").select("project", "layer_id", graph.canonical_id("m").alias("id"))
    parts = [
        issues(v.where(~F.col("node_type").isin(*model.NODE_TYPES) | F.col("node_type").isNull()), "unknown_node_type", "critical", F.coalesce("node_type", F.lit("null"))),
        issues(first.where(~F.col("edge_type").isin(*model.EDGE_TYPES) | F.col("edge_type").isNull()), "unknown_edge_type", "critical", F.coalesce("edge_type", F.lit("null"))),
        issues(ends.join(ids, KEY, "left_anti"), "missing_endpoint", "critical", F.col("id")),
        issues(first.where(graph.canonical_id("source") == graph.canonical_id("target")), "self_edge", "warning", graph.canonical_id("source")),
        issues(nodes.where("id is not null").select("project", graph.canonical_id("id").alias("id")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "repeated_node", "critical", F.lit("all")),
        issues(v.where("node_type = 'file' and coalesce(summary, '') = ''"), "file_without_summary", "warning", F.lit("all")),
        issues(members.join(ids, KEY, "left_anti"), "layer_missing_node", "warning", F.col("layer_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def repaired(nodes: DataFrame, edges: DataFrame, layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, layers) with dangling edges, loops and missing members taken out; for graphs with a critical issue."""
    v = graph.latest_nodes(nodes)
    kept = graph.live_edges(graph.first_edges(edges), v).where("source <> target")
    members = layers.dropDuplicates(["project", "id"]).select("project", F.col("id").alias("layer_id"), "layer_name", F.posexplode_outer("node_ids").alias("pos", "m"))
    there = members.withColumn("id", graph.canonical_id("m")).join(v.select(*KEY).withColumn("_t", F.lit(True)), KEY, "left")
    ids = F.array_sort(F.collect_list(F.when(F.col("_t"), F.struct("pos", "id"))))
    return kept, there.groupBy("project", "layer_id", "layer_name").agg(F.transform(ids, lambda x: x["id"]).alias("node_ids"))
