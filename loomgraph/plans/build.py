"""From files and commits to a scored graph: one lazy plan, written at the graph and after the closure."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import extract, graph, history, risk, smells, traversal
from ..session import cut

KEY = ["project", "id"]


@dataclass
class Built:
    """The tables of an analysed graph; a pass that failed leaves its table out and its error in problems."""

    nodes: DataFrame
    edges: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    problems: dict[str, str] = field(default_factory=dict)


def skeleton(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that follow from the text alone: files, their functions and classes, contains, imports and calls.
    files: (project, path, lang_name, content, size_lines)."""
    known = files.where("content is not null and path is not null").dropDuplicates(["project", "path"])
    kinds = F.when(P.file_category(F.col("language")) == "config", "config").when(P.file_category(F.col("language")) == "document", "document").otherwise("file")
    base = extract.with_language(known)
    file_nodes = base.select(
        "project", F.concat(F.lit("file:"), F.col("path")).alias("id"), kinds.alias("node_type"), F.substring_index("path", "/", -1).alias("label"), F.col("path").alias("file"), F.lit(1).alias("start_line"),
        F.col("size_lines").alias("end_line"), P.file_complexity("size_lines").alias("complexity"), F.lit(0).cast("long").alias("ord"),
    )
    found = cut(extract.symbol_ends(extract.symbols(known), known))
    own = F.concat(F.col("kind"), F.lit(":"), F.col("path"), F.lit(":"), F.col("name"))
    symbol_nodes = found.select(
        "project", own.alias("id"), F.col("kind").alias("node_type"), F.col("name").alias("label"), F.col("path").alias("file"), F.col("line_no").alias("start_line"), "end_line",
        P.symbol_complexity(F.col("end_line") - F.col("line_no") + 1).alias("complexity"), F.col("line_no").cast("long").alias("ord"),
    )
    nodes = graph.latest_nodes(file_nodes.unionByName(symbol_nodes))
    contains = found.select("project", F.concat(F.lit("file:"), F.col("path")).alias("source"), own.alias("target"), F.lit("contains").alias("edge_type")).distinct()
    targets = cut(extract.import_targets(extract.imports(known), known))
    plain = contains.unionByName(extract.import_edges(targets)).withColumn("weight", F.lit(None).cast("double"))
    edges = plain.unionByName(call_edges(found, known, targets)).withColumns({"ord": F.lit(0).cast("long"), "edge_id": F.xxhash64("source", "target", "edge_type")})
    return nodes, edges


def function_bodies(found: DataFrame, files: DataFrame) -> DataFrame:
    """project, path, name, line_no, body: the lines of each function of symbol_ends(). Each text meets its functions once."""
    spans = found.where("kind = 'function'").groupBy("project", "path").agg(F.collect_list(F.struct("name", "line_no", "end_line")).alias("spans"))
    body = lambda rows, x: F.array_join(F.slice(rows, x["line_no"], x["end_line"] - x["line_no"] + 1), "\n")
    # the outer lambda binds the lines, so that a text is split once and not once a function
    of = F.transform(F.array(F.split("content", "\n")), lambda rows: F.transform("spans", lambda x: F.struct(x["name"].alias("name"), x["line_no"].alias("line_no"), body(rows, x).alias("body"))))
    return spans.join(files.select("project", "path", "content"), ["project", "path"]).select("project", "path", F.inline(of[0]))


def call_edges(found: DataFrame, files: DataFrame, targets: DataFrame) -> DataFrame:
    """Calls between functions as edges, weighted by their number; of functions of one name in a file the first that has
    the call counts. Calls of the own name are no edges."""
    place = F.struct("project", "path", F.col("name").alias("caller"), "line_no").alias("at")
    sites = extract.call_sites(function_bodies(found, files).select(place, "body"), "at").select("at.*", "callee", "n").where("caller <> callee")
    calls = sites.groupBy("project", "path", "caller", "callee").agg(F.min_by("n", "line_no").alias("n"))
    own = lambda path, name: F.concat(F.lit("function:"), F.col(path), F.lit(":"), F.col(name))
    return extract.resolve_calls(calls, found, targets).select("project", own("path", "caller").alias("source"), own("to_path", "callee").alias("target"), F.lit("calls").alias("edge_type"), F.col("n").cast("double").alias("weight"))


def analyse(nodes: DataFrame, edges: DataFrame, commits: DataFrame | None = None, files: DataFrame | None = None, domain_of: DataFrame | None = None) -> Built:
    """Layers, domains, security, history, cycles, smells and risk of a normalised graph, in the order their inputs need:
    history, layers and domains, then smells, then blast radius, then risk. files: the texts of skeleton(), which the
    security pass reads. domain_of: (project, id, domain) known besides the folders, such as domains of functions."""
    out = Built(cut(nodes), cut(edges))
    empty_changes = out.nodes.sparkSession.createDataFrame([], "project string, id string, change_frequency int, recent_commits int, n_authors int")

    def attempt(name: str, make):
        try:
            out.tables[name] = cut(make())  # a pass that fails fails here
        except Exception as e:  # noqa: BLE001 - a failed pass is skipped, the others go on
            out.problems[name] = str(e)[:500]

    attempt("layers", lambda: smells.path_layers(out.nodes))
    attempt("domains", lambda: domains(out.nodes, out.edges))
    if "domains" in out.tables:
        of_folders = out.tables["domains"].select(*KEY, "domain")
        domain_of = of_folders if domain_of is None else of_folders.unionByName(domain_of.select(*KEY, "domain")).distinct()
    if files is not None:
        attempt("security", lambda: security(out.nodes, files))
    changes = empty_changes
    if commits is not None:
        timed = history.commit_times(commits)
        now = timed.agg(F.max("at")).first()[0]
        if now is not None:
            attempt("decision_context", lambda: history.decision_context(timed, now))
            recent = lambda days: F.count_if(F.col("at") >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS")).cast("int")
            changes = timed.groupBy("project", F.concat(F.lit("file:"), F.col("file")).alias("id")).agg(recent(90).alias("change_frequency"), recent(14).alias("recent_commits"), F.countDistinct(F.when(F.col("author") != "", F.col("author"))).cast("int").alias("n_authors"))
    attempt("cycles", lambda: traversal.simple_cycles(out.edges))
    attempt("smells", lambda: smells.all_smells(out.nodes, out.edges, changes, domain_of))
    attempt("blast", lambda: traversal.blast_radius(out.nodes, out.edges))
    if "blast" in out.tables:
        circular = out.tables["cycles"].select("project", F.explode("cycle").alias("id")).distinct() if "cycles" in out.tables else None
        attempt("risk", lambda: risk.risk_scores(out.nodes, out.edges, out.tables["blast"], changes, None, circular))
    starts = out.nodes.where("node_type = 'file'").select(*KEY, F.when(P.is_entry_point(F.coalesce("file", "id")), 0).otherwise(1).alias("rank"))
    attempt("tours", lambda: traversal.tours(out.nodes, out.edges, starts))
    return out


def security(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """project, id and security_findings() of the texts of the file nodes."""
    texts = files.where("content is not null and path is not null").dropDuplicates(["project", "path"]).select("project", F.concat(F.lit("file:"), F.col("path")).alias("id"), "content")
    scanned = texts.join(nodes.where("node_type = 'file'").select(*KEY), KEY, "left_semi").select(F.struct(*KEY).alias("at"), "content")
    return extract.security_findings(scanned, "at").select("at.*", "rule", "category", "severity", "line", "snippet", "pattern", "description")


def domains(nodes: DataFrame, edges: DataFrame, most: int = 8, least_files: int = 2, steps: int = 8, flat: int = 6) -> DataFrame:
    """project, domain, n_files, step_no, id, weight: folders of the second path step with two files or more, the ``most``
    largest of each project; each has one flow of its files in dependency order, evenly weighted from 0 to 1. With fewer than two links inside
    it is one of the first ``flat`` files by id, weighted by their place among all."""
    from pyspark.sql import Window

    parts = F.split(F.col("file"), "/")
    files = nodes.where((F.col("node_type") == "file") & (F.size(parts) >= 2)).select(*KEY, parts[1].alias("domain"))
    sizes = files.groupBy("project", "domain").agg(F.count(F.lit(1)).alias("n_files")).where(F.col("n_files") >= least_files)
    top = sizes.withColumn("_n", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("n_files"), "domain"))).where(F.col("_n") <= most).drop("_n")
    member = files.join(top, ["project", "domain"])
    place = member.select("project", F.col("id"), "domain")
    inner = edges.join(place.withColumnsRenamed({"id": "source", "domain": "d1"}), ["project", "source"]).join(place.withColumnsRenamed({"id": "target", "domain": "d2"}), ["project", "target"]).where("d1 = d2").select("project", "source", "target", "edge_type")
    inner = cut(inner.where(F.col("edge_type").isin("calls", "imports", "depends_on")))
    linked = inner.join(place.withColumnRenamed("id", "source"), ["project", "source"]).groupBy("project", "domain").agg(F.count(F.lit(1)).alias("_links"))
    member = member.join(linked, ["project", "domain"], "left").withColumn("_flat", F.coalesce("_links", F.lit(0)) < 2)
    level = traversal.topological_levels(inner)
    w = Window.partitionBy("project", "domain").orderBy(F.when(F.col("_flat"), 0).otherwise(F.coalesce("level", F.lit(0))), "id")
    ranked = member.join(level, KEY, "left").withColumn("step_no", F.row_number().over(w)).where(F.col("step_no") <= F.when(F.col("_flat"), flat).otherwise(steps))
    last = F.when(F.col("_flat"), F.col("n_files")).otherwise(F.least(F.col("n_files"), F.lit(steps))) - 1
    return ranked.select("project", "domain", "n_files", "step_no", "id", F.round((F.col("step_no") - 1) / F.greatest(last, F.lit(1)), 6).alias("weight"))


def snapshot(nodes: DataFrame, edges: DataFrame, smell_rows: DataFrame, security: DataFrame, at) -> DataFrame:
    """One history row a project: health, sizes, risk tiers, smell and security counts."""
    report = risk.health_report(nodes, edges, smell_rows, security)
    return report.select("project", F.lit(at).alias("at"), "score", "grade", "n_nodes", "n_edges", "risk_high", "risk_medium", "risk_low", "n_smells", "n_security")
