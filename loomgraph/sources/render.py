"""Rendered reports: Mermaid diagrams and Markdown from small, already reduced results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph

LINKS = ("imports", "depends_on", "calls")


def _shown(df: DataFrame, order: list, most: int) -> tuple[list, int]:
    """(the first rows, how many more there are)."""
    rows = df.orderBy(*order).limit(most).collect()
    return rows, df.count() - most if len(rows) == most else 0


def mermaid_layers(edges: DataFrame, layers_of: DataFrame, project: str, most: int = 500) -> str:
    """A flow chart of the layers of a project, with counted links; a comment says how many links are left out."""
    rows, more = _shown(graph.layer_edges(edges.where(F.col("project") == project), layers_of, LINKS), ["source_layer", "target_layer"], most)
    names = sorted({x for r in rows for x in (r.source_layer, r.target_layer)})
    return "\n".join(["graph TD", *[f"  {n}[{n}]" for n in names], *[f"  {r.source_layer} -->|{r.n_edges}| {r.target_layer}" for r in rows], *([f"  %% {more} more links"] if more else [])])


def _rest(more: int) -> list[str]:
    return [f"- and {more} more"] if more else []


def mermaid_files(nodes: DataFrame, edges: DataFrame, project: str, top: int = 30) -> str:
    """A flow chart of the ``top`` files by import degree and the links among them."""
    files = nodes.where((F.col("project") == project) & (F.col("node_type") == "file")).select("project", "id", "label")
    e = edges.where((F.col("project") == project) & (F.col("edge_type") == "imports"))
    best = graph.degrees(files, e).join(files, ["project", "id"]).orderBy(F.desc("degree"), "id").limit(top)
    picked = [(r.id, r.label) for r in best.collect()]
    place = {i: k for k, (i, _) in enumerate(picked)}
    inside = e.where(F.col("source").isin(*place) & F.col("target").isin(*place) & (F.col("source") != F.col("target"))).select("source", "target").distinct().orderBy("source", "target").collect() if place else []
    return "\n".join(["graph LR", *[f'  n{k}["{(label or i).replace(chr(34), chr(39))}"]' for k, (i, label) in enumerate(picked)], *[f"  n{place[r.source]} --> n{place[r.target]}" for r in inside]])


def markdown_report(nodes: DataFrame, edges: DataFrame, layers_of: DataFrame, project: str, risky: float = 0.7, rows: int = 200) -> str:
    """Counts, layers and risky nodes of a project; a list that isn't shown whole says how many rows are left out."""
    v = nodes.where(F.col("project") == project)
    types, more_types = _shown(v.groupBy("node_type").count(), ["node_type"], 100)
    layers = layers_of.where((F.col("project") == project) & F.col("layer").isNotNull()).groupBy("layer").count()
    layers, more_layers = _shown(layers, ["layer"], 100)
    hot, more_hot = _shown(v.where(F.col("risk_score") >= risky).select("id", "risk_score"), [F.desc("risk_score"), "id"], rows)
    n_nodes = v.count()
    n_edges = edges.where(F.col("project") == project).count()
    out = [f"# {project}", "", f"{n_nodes} nodes, {n_edges} edges", "", "## Nodes", *[f"- {t.node_type}: {t['count']}" for t in types], *_rest(more_types)]
    out += ["", "## Layers", *[f"- {x.layer}: {x['count']}" for x in layers], *_rest(more_layers), "", "## High risk", *[f"- {r.id} ({r.risk_score:.2f})" for r in hot], *_rest(more_hot)]
    return "\n".join(out) + "\n"
