"""Merging graphs: packages of a workspace, passes, enrichment, chunk overlays; cleaning of assembled records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions.text import slug, to_int, unit

KEY = ["project", "id"]
EDGE_KEY = ["project", "source", "target", "edge_type"]


def merge_packages(parts: dict[str, tuple[DataFrame, DataFrame]], project: str) -> tuple[DataFrame, DataFrame]:
    """Graphs of packages as one graph: ids get the package as prefix, repeats within a package go to the first."""
    nodes, edges = [], []
    for name, (v, e) in parts.items():
        nodes.append(v.withColumn("id", F.concat_ws(":", F.lit(name), F.col("id"))).withColumn("project", F.lit(project)))
        edges.append(e.withColumns({c: F.concat_ws(":", F.lit(name), F.col(c)) for c in ("source", "target")}).withColumn("project", F.lit(project)))
    v = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), nodes)
    e = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), edges)
    return _first(v, KEY), _first(e, EDGE_KEY)


def merge_projects(nodes: DataFrame, edges: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """merge_packages() where each project of one table is a package: no list of them is needed, however many there are."""
    named = lambda df, *ids: df.withColumns({c: F.concat_ws(":", "project", c) for c in ids}).withColumn("project", F.lit(project))
    return _first(named(nodes, "id"), KEY), _first(named(edges, "source", "target"), EDGE_KEY, ("edge_id", "weight"))


def _first(df: DataFrame, key: list[str], ties: tuple[str, ...] = ()) -> DataFrame:
    w = Window.partitionBy(*key).orderBy("ord", *ties)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_passes(base: DataFrame, updated: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the update win over rows of the base with the same key; rows of either alone stay."""
    both = base.withColumn("_v", F.lit(0)).unionByName(updated.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc("_v"), F.desc("ord"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_v")


def keep_enrichment(fresh: DataFrame, previous: DataFrame, columns: list[str]) -> DataFrame:
    """Fresh structure with the earlier values of the enriched columns where there were any."""
    old = previous.select(*KEY, *[F.col(c).alias(f"_old_{c}") for c in columns])
    joined = fresh.join(old, KEY, "left")
    return joined.select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in columns else F.col(c) for c in fresh.columns])


def apply_overlay(nodes: DataFrame, overlay: DataFrame, columns: list[str], only_missing: bool = False) -> DataFrame:
    """Values of an overlay (project, id, columns) that aren't null replace those of the nodes; only_missing: fill nulls."""
    new = overlay.select(*KEY, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = nodes.join(new, KEY, "left")
    pick = lambda c: F.coalesce(c, f"_new_{c}") if only_missing else F.coalesce(f"_new_{c}", c)
    return joined.select(*[pick(c).alias(c) if c in columns else F.col(c) for c in nodes.columns])


def assemble_chunks(chunks: list[DataFrame], key: list[str]) -> DataFrame:
    """Chunks with drifting columns as one table; the last chunk wins for a key."""
    rows = [c.withColumn("_chunk", F.lit(i)) for i, c in enumerate(chunks)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    w = Window.partitionBy(*key).orderBy(F.desc("_chunk"))
    return whole.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_chunk")


def _allowed(column: Column | str, allowed: tuple[str, ...], default: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def clean_commits(column: str) -> Column:
    """Commits with a sha; other fields default to ''."""
    kept = F.filter(F.coalesce(column, F.array()), lambda c: F.coalesce(c["sha"], F.lit("")) != "")
    text = lambda c, k: F.coalesce(c[k], F.lit("")).alias(k)
    return F.transform(kept, lambda c: F.struct(c["sha"].alias("sha"), text(c, "date"), text(c, "message"), text(c, "author")))


def clean_warnings(column: str) -> Column:
    """Warnings of a known category; an unknown severity becomes medium."""
    kept = F.filter(F.coalesce(column, F.array()), lambda w: w["category"].isin(*model.SMELLS))
    return F.transform(kept, lambda w: F.struct(
        w["category"].alias("category"), F.when(w["severity"].isin(*model.SEVERITIES), w["severity"]).otherwise("medium").alias("severity"), F.coalesce(w["description"], F.lit("")).alias("description"),
        F.coalesce(w["related_node_ids"], F.array().cast("array<string>")).alias("related_node_ids"), F.coalesce(w["heuristic"], F.lit("")).alias("heuristic"),
    ))


def clean_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): nodes without an id are rejected; the label falls back to the name, then the last step of the
    id; unknown complexities become null, unknown risk factors go, scores are kept within 0 and 1."""
    has_id = F.coalesce("id", F.lit("")) != ""
    last = F.regexp_extract("id", r"([^/:]+)$", 1)
    columns = {
        "label": F.coalesce(F.nullif(F.col("label"), F.lit("")), F.nullif(F.col("node_name"), F.lit("")), F.nullif(last, F.lit("")), F.col("id")), "complexity": _allowed("complexity", model.COMPLEXITIES),
        "risk_factors": F.filter(F.coalesce("risk_factors", F.array().cast("array<string>")), lambda f: f.isin(*model.RISK_FACTORS)),
        "risk_score": F.when(F.col("risk_score").cast("string").try_cast("double").isNotNull(), unit("risk_score")), "structural_warnings": clean_warnings("structural_warnings"),
    }
    return nodes.where(has_id).withColumns({k: v for k, v in columns.items() if k in nodes.columns}), nodes.where(~has_id)


def clean_layers(layers: DataFrame) -> DataFrame:
    """Layers from a name or an object: the id falls back to a slug of the name, the name to the id."""
    named = F.coalesce(F.nullif(F.col("layer_name"), F.lit("")), F.col("id"))
    return layers.withColumn("layer_name", named).withColumn("id", F.coalesce(F.nullif(F.col("id"), F.lit("")), F.concat(F.lit("layer:"), slug(named)))).withColumn("node_ids", F.array_distinct(F.filter(F.coalesce("node_ids", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")))


def clean_steps(steps: DataFrame, most: int = 15) -> DataFrame:
    """Tour steps (project, tour_id, pos, node_id, node_ids, step_title, title, explanation, description): aliases are
    folded, steps without a node dropped, at most ``most`` kept and numbered from 1."""
    ids = F.filter(F.concat(F.array("node_id"), F.coalesce("node_ids", F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != "")
    folded = steps.select("project", "tour_id", "pos", F.array_distinct(ids).alias("node_ids"), F.coalesce(F.nullif(F.col("step_title"), F.lit("")), F.col("title"), F.lit("")).alias("step_title"), F.coalesce(F.nullif(F.col("explanation"), F.lit("")), F.col("description"), F.lit("")).alias("explanation"))
    w = Window.partitionBy("project", "tour_id").orderBy("pos")
    return folded.where(F.size("node_ids") > 0).withColumn("step_no", F.row_number().over(w)).where(F.col("step_no") <= most).drop("pos")


def clean_domain_steps(steps: DataFrame) -> DataFrame:
    """Domain steps: weights within 0 and 1, 0.5 when missing or no number; labels fall back to the id."""
    return steps.withColumn("weight", unit("weight")).withColumn("label", F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("id")))


def clean_history(df: DataFrame) -> DataFrame:
    """Decision contexts: commits need a sha, the frequency is an integer."""
    return df.withColumn("commits", clean_commits("commits")).withColumn("change_frequency", to_int("change_frequency"))


def persona_steps(steps: DataFrame, nodes: DataFrame, persona: str) -> DataFrame:
    """Steps (project, tour_id, pos, id) for a reader: junior all; senior and experienced without the first; pm domain,
    service and flow nodes; non-technical these and files that are entry points. Numbered anew as step_no."""
    from ..functions import predicates as P

    joined = steps.join(nodes.select(*KEY, "node_type", "file"), KEY, "left")
    w = Window.partitionBy("project", "tour_id").orderBy("pos")
    if persona in ("senior", "experienced"):
        joined = joined.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")
    elif persona in ("pm", "non-technical"):
        wanted = F.col("node_type").isin("domain", "service", "flow")
        if persona == "non-technical":
            wanted = wanted | ((F.col("node_type") == "file") & P.is_entry_point(F.coalesce("file", "id")))
        joined = joined.where(wanted)
    return joined.withColumn("step_no", F.row_number().over(w)).select("project", "tour_id", "step_no", "id", "node_type")
