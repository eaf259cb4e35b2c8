"""The query tools over a graph: each takes DataFrames and plain arguments and returns DataFrames; faults of the input
raise ToolError with a code."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, merge, risk, search, traversal
from ..sources import stores

KEY = ["project", "id"]
MAX_FILES, MAX_PATH = 500, 500


class ToolError(ValueError):
    """A fault of the caller: code is GRAPH_NOT_FOUND, NODE_NOT_FOUND, INVALID_INPUT, TOUR_NOT_FOUND, NO_TOURS,
    DOMAIN_NOT_FOUND or MISSING_RESPONSE."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


def _one(nodes: DataFrame, project: str, asked: str) -> str:
    wanted = nodes.sparkSession.createDataFrame([(project, asked)], "project string, asked string")
    row = graph.resolve_ids(nodes, wanted).first()
    if row is None:
        raise ToolError("NODE_NOT_FOUND", asked)
    return row["id"]


def query(nodes: DataFrame, text: str, limit: int = 10, node_types: list[str] | None = None, semantic: bool = False) -> DataFrame:
    """Ranked search by keywords, or by term vectors."""
    if not text or not text.strip():
        raise ToolError("INVALID_INPUT", "empty query")
    limit = max(1, min(int(limit), 500))
    if semantic:
        hits = search.term_search(nodes, KEY, F.concat_ws(" ", "label", "summary"), text, limit, 0.25)
        return hits.join(nodes.select(*KEY, "label", "node_type"), KEY, "left")
    return search.keyword_search(nodes, text, limit, node_types)


def node(nodes: DataFrame, edges: DataFrame, layers_of: DataFrame, project: str, asked: str) -> dict[str, DataFrame]:
    """The node, its neighbours with direction and type, its degrees, and the nodes of its layer."""
    found = nodes.where((F.col("project") == project) & (F.col("id") == _one(nodes, project, asked)))
    around = graph.neighbors(edges.where(F.col("project") == project), found).join(nodes.select("project", F.col("id").alias("neighbor"), "label", "node_type"), ["project", "neighbor"])
    own = layers_of.join(found.select(*KEY), KEY, "left_semi").select("project", "layer")
    mates = layers_of.join(own, ["project", "layer"], "left_semi").join(found.select(*KEY), KEY, "left_anti")
    return {"node": found, "neighbors": around, "degrees": graph.degrees(found, edges.where(F.col("project") == project)), "layer_mates": mates}


def diff_impact(nodes: DataFrame, edges: DataFrame, project: str, files: list[str]) -> DataFrame:
    """Nodes affected by changed files, riskiest first."""
    if not files or len(files) > MAX_FILES or any(not f or len(f) > MAX_PATH for f in files):
        raise ToolError("INVALID_INPUT", "give 1 to 500 paths of at most 500 characters")
    wanted = nodes.sparkSession.createDataFrame([(project, f) for f in files], "project string, changed string")
    changed = traversal.changed_nodes(nodes, wanted)
    return traversal.diff_impact(nodes, edges, changed).orderBy(F.desc_nulls_last("risk_score"), "depth", "id")


def tour(steps: DataFrame, nodes: DataFrame, project: str, tour_id: str | None = None, persona: str = "junior") -> DataFrame:
    """Steps of a tour (project, tour_id, pos, id) for a reader; the first tour when none is named."""
    mine = steps.where(F.col("project") == project)
    first = mine.agg(F.min("tour_id")).first()[0]
    if first is None:
        raise ToolError("NO_TOURS")
    picked = mine.where(F.col("tour_id") == (tour_id or first))
    if tour_id and picked.isEmpty():
        raise ToolError("TOUR_NOT_FOUND", tour_id)
    return merge.persona_steps(picked, nodes, persona).join(nodes.select(*KEY, "label"), KEY, "left").orderBy("step_no")


def domain(domains: DataFrame, project: str, asked: str | None = None) -> DataFrame:
    """All domains (project, id, label, ...), or the first whose label or id is the text, else whose label holds it."""
    mine = domains.where(F.col("project") == project)
    if asked is None:
        return mine
    q = asked.lower()
    tier = F.when((F.lower("label") == q) | (F.lower("id") == q), 0).when(F.lower("label").contains(q), 1)
    hit = mine.withColumn("_t", tier).where("_t is not null").orderBy("_t", "ord").limit(1).drop("_t")
    if hit.isEmpty():
        raise ToolError("DOMAIN_NOT_FOUND", asked)
    return hit


def health(nodes: DataFrame, edges: DataFrame, smells: DataFrame, security: DataFrame, history: DataFrame | None = None, top: int = 10) -> dict[str, DataFrame]:
    """The health report, the riskiest nodes, and the last snapshots."""
    out = {"report": risk.health_report(nodes, edges, smells, security), "riskiest": nodes.where("risk_score is not null").orderBy(F.desc("risk_score"), "ord").limit(top).select(*KEY, "risk_score")}
    if history is not None:
        out["history"] = stores.last_history(history, 30)
    return out


def why(nodes: DataFrame, contexts: DataFrame, annotations: DataFrame, project: str, asked: str) -> DataFrame:
    """A node with what is known of its decisions (project, file, ...) and its annotations (project, node_id, ...)."""
    found = nodes.where((F.col("project") == project) & (F.col("id") == _one(nodes, project, asked))).select(*KEY, "label", "file", "summary")
    notes = annotations.select("project", F.col("node_id").alias("id"), F.col("content").alias("annotation"), "annotated_at")
    return found.join(contexts, ["project", "file"], "left").join(notes, KEY, "left")


def annotate(spark: SparkSession, path: str, nodes: DataFrame, project: str, asked: str, content: str, tags: list[str] | None = None, at: datetime | None = None) -> DataFrame:
    if not (content or "").strip():
        raise ToolError("INVALID_INPUT", "empty annotation")
    return stores.annotate(spark, path, project, _one(nodes, project, asked), content, tags, at)


def respond(spark: SparkSession, path: str, response: str, question: str | None = None, at: datetime | None = None) -> DataFrame:
    if not (response or "").strip():
        raise ToolError("MISSING_RESPONSE")
    return stores.respond(spark, path, response, question, at)
