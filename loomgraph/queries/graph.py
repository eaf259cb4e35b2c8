"""Queries over the property graph of the nodes and edges tables: relations, traversal, smells, risk, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import graph, risk, smells, traversal, views
from ..session import cut, keep, table

KEY = ["project", "id"]
_COLUMNS = ["project", "id", "node_type", "label", "file", "summary", "complexity", "layer", "risk_score", "risk_factors", "structural_warnings", "security_warnings", "metadata", "end_line", "tags", "ord"]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_HELD: dict[tuple[str, str, str], DataFrame] = {}


def _held(spark: SparkSession, d: str, what: str, make) -> DataFrame:
    """What was made for a folder in this application, once: the tables are read-only, and nearly every query of a session
    starts from the same normalised graph, which lies in the checkpoint folder."""
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """Normalise anew at the next query, for folders whose tables have changed."""
    _HELD.clear()


def load_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each node."""
    return _held(spark, d, "nodes", lambda: cut(graph.latest_nodes(table(spark, d, "nodes").select(*_COLUMNS))))


def load_edges(spark: SparkSession, d: str) -> DataFrame:
    """The first of each edge with both ends, tests turned."""

    def make():
        v = load_nodes(spark, d)
        return cut(graph.flip_tests(graph.live_edges(cut(graph.first_edges(table(spark, d, "edges"))), v), v))

    return _held(spark, d, "edges", make)


def load(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The normalised graph."""
    return load_nodes(spark, d), load_edges(spark, d)


def load_plain(spark: SparkSession, d: str, types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """The normalised graph with the columns that closures and scores need, and edges of the types only. Where the whole
    one is at hand, that."""
    if (spark.sparkContext.applicationId, d, "edges") in _HELD:
        v, e = load(spark, d)
        return v, graph.of_types(e, types)
    columns = ["project", "id", "node_type", "label", "file", "structural_warnings", "ord"]
    v = _held(spark, d, "plain nodes", lambda: keep(graph.latest_nodes(table(spark, d, "nodes").select(*columns))))
    return v, _held(spark, d, f"plain edges {types}", lambda: keep(graph.plain_edges(table(spark, d, "edges"), v, types)))


def domain_of(v: DataFrame) -> DataFrame:
    """A function's domain: the second step of its path."""
    step = F.split(F.col("file"), "/")
    return v.where("node_type = 'function' and file is not null").where(F.size(step) >= 2).select(*KEY, step[1].alias("domain"))


def layer_steps(spark: SparkSession, d: str) -> DataFrame:
    """(project, tour_id, pos, node_ids) of the layers read as tours with one step a member."""
    rows = table(spark, d, "layers").select("project", F.col("id").alias("tour_id"), F.posexplode("node_ids").alias("pos", "m")).where("m is not null and m <> ''")
    return rows.select("project", "tour_id", "pos", F.array(graph.canonical_id("m")).alias("node_ids")).distinct()


def changes_of(spark: SparkSession, d: str) -> DataFrame:
    """(project, id, change_frequency, recent_commits, n_authors) of file nodes from the commits: 90 and 14 days
    before the last commit loaded."""
    from ..operators.history import commit_times

    c = commit_times(table(spark, d, "commits"))
    now = c.agg(F.max("at").alias("now")).first()["now"]
    ago = lambda days: F.col("at") >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS")
    return c.groupBy("project", F.concat(F.lit("file:"), F.col("file")).alias("id")).agg(
        F.count_if(ago(90)).cast("int").alias("change_frequency"), F.count_if(ago(14)).cast("int").alias("recent_commits"), F.countDistinct(F.when(F.col("author") != "", F.col("author"))).cast("int").alias("n_authors")
    )


_CANON = "CASE WHEN regexp_matches({0}, '^[A-Za-z_]+:[A-Za-z_]+:') AND split_part({0}, ':', 1) = split_part({0}, ':', 2) THEN substr({0}, length(split_part({0}, ':', 1)) + 2) ELSE {0} END"
GRAPH_SQL = f"""
WITH RECURSIVE V AS (
  SELECT project, {_CANON.format("id")} AS id, node_type, label, file, summary, complexity, layer, risk_score, risk_factors, structural_warnings, security_warnings, metadata, end_line, tags, ord
  FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project, {_CANON.format("id")} ORDER BY ord DESC NULLS LAST) = 1
), E0 AS (
  SELECT project, {_CANON.format("source")} AS source, {_CANON.format("target")} AS target, edge_type, weight, ord, edge_id FROM edges WHERE source <> '' AND target <> ''
  QUALIFY row_number() OVER (PARTITION BY project, {_CANON.format("source")}, {_CANON.format("target")}, edge_type ORDER BY ord, edge_id, weight) = 1
), E1 AS (
  SELECT e.* FROM E0 e WHERE EXISTS (SELECT 1 FROM V WHERE V.project = e.project AND V.id = e.source) AND EXISTS (SELECT 1 FROM V WHERE V.project = e.project AND V.id = e.target)
), T AS (SELECT project, id FROM V WHERE regexp_matches(coalesce(file, label, ''), '\\.test\\.|\\.spec\\.|__tests__')),
E AS (
  SELECT e.project, CASE WHEN t.id IS NULL THEN e.source ELSE e.target END AS source, CASE WHEN t.id IS NULL THEN e.target ELSE e.source END AS target, e.edge_type, e.weight, e.ord, e.edge_id
  FROM E1 e LEFT JOIN T t ON e.edge_type = 'tested_by' AND t.project = e.project AND t.id = e.target
), D AS (
  SELECT V.project, V.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree FROM V
  LEFT JOIN (SELECT project, source AS id, count(*) AS n FROM E GROUP BY 1, 2) o USING (project, id)
  LEFT JOIN (SELECT project, target AS id, count(*) AS n FROM E GROUP BY 1, 2) i USING (project, id)
)"""
_LAYERS_SQL = f""", L AS (
  SELECT V.project, V.id, coalesce(V.layer, l.listed) AS layer FROM V LEFT JOIN (
    SELECT project, {_CANON.format("m")} AS id, lower(min_by(layer_name, layer_id)) AS listed FROM (SELECT project, id AS layer_id, layer_name, unnest(node_ids) AS m FROM layers) WHERE m <> '' GROUP BY 1, 2
  ) l USING (project, id)
)"""


@query(GRAPH_SQL + " SELECT project, id, in_degree, out_degree, degree FROM D ORDER BY degree DESC, project, id LIMIT 50")
def degree_topk(spark, d):
    v, e = load(spark, d)
    return graph.degrees(v, e).orderBy(F.desc("degree"), "project", "id").limit(50)


@query(GRAPH_SQL + " SELECT project, source, target, edge_type FROM E")
def normalized_edges(spark, d):
    return load_edges(spark, d).select("project", "source", "target", "edge_type")


@query(GRAPH_SQL + """, c AS (
  SELECT project, count(*) FILTER (id <> """ + _CANON.format("id") + """) AS double_prefix, count(id) AS n FROM nodes GROUP BY 1
), k AS (SELECT project, count(*) AS n FROM V GROUP BY 1), w AS (SELECT project, count(*) AS n FROM edges WHERE source <> '' AND target <> '' GROUP BY 1),
f AS (SELECT project, count(*) AS n FROM E0 GROUP BY 1), l AS (SELECT project, count(*) AS n FROM E1 GROUP BY 1),
tf AS (SELECT e.project, count(*) AS n FROM E1 e JOIN T ON T.project = e.project AND T.id = e.target WHERE edge_type = 'tested_by' GROUP BY 1)
SELECT c.project, double_prefix, c.n - k.n AS deduped_nodes, coalesce(w.n, 0) - coalesce(f.n, 0) AS deduped_edges, coalesce(f.n, 0) - coalesce(l.n, 0) AS dangling_edges, coalesce(tf.n, 0) AS tested_by_fixed
FROM c LEFT JOIN k USING (project) LEFT JOIN w USING (project) LEFT JOIN f USING (project) LEFT JOIN l USING (project) LEFT JOIN tf USING (project)""")
def normalization_report(spark, d):
    return graph.normalization_report(table(spark, d, "nodes"), table(spark, d, "edges"))


@query(GRAPH_SQL + """, S AS (SELECT project, id FROM V WHERE risk_score >= 0.7)
SELECT project, source AS id, target AS neighbor, 'out' AS direction, edge_type FROM E SEMI JOIN S ON S.project = E.project AND S.id = E.source
UNION ALL SELECT project, target, source, 'in', edge_type FROM E SEMI JOIN S ON S.project = E.project AND S.id = E.target WHERE source <> target""")
def neighbors_both(spark, d):
    """Neighbours of all high-risk nodes."""
    v, e = load(spark, d)
    return graph.neighbors(e, v.where("risk_score >= 0.7"))


@query(GRAPH_SQL + _LAYERS_SQL + """, A AS (SELECT project, node_id AS id, 1 AS noted FROM file_git), M AS (SELECT project, layer, count(*) AS members FROM L WHERE layer IS NOT NULL GROUP BY 1, 2)
SELECT D.project, D.id, V.node_type, V.label, L.layer, CASE WHEN L.layer IS NULL THEN 0 ELSE M.members - 1 END AS layer_mates, in_degree, out_degree, A.id IS NOT NULL AS has_history
FROM D JOIN V USING (project, id) JOIN L USING (project, id) LEFT JOIN M ON M.project = L.project AND M.layer = L.layer LEFT JOIN A ON A.project = D.project AND A.id = D.id""")
def node_detail(spark, d):
    """Every node with its layer, number of layer mates, degrees, and whether history is known."""
    v, e = load(spark, d)
    layers_of = graph.layer_map(v, table(spark, d, "layers"))
    mates = layers_of.where("layer is not null").groupBy("project", "layer").agg((F.count(F.lit(1)) - 1).alias("layer_mates"))
    known = table(spark, d, "file_git").select("project", F.col("node_id").alias("id")).distinct().withColumn("has_history", F.lit(True))
    whole = v.select(*KEY, "node_type", "label").join(layers_of, KEY).join(mates, ["project", "layer"], "left").join(graph.degrees(v, e), KEY).join(known, KEY, "left")
    return whole.select(*KEY, "node_type", "label", "layer", F.coalesce("layer_mates", F.lit(0)).alias("layer_mates"), "in_degree", "out_degree", F.coalesce("has_history", F.lit(False)).alias("has_history"))


@query(GRAPH_SQL + """, W AS (SELECT DISTINCT project, file AS asked FROM commits WHERE file <> ''), C AS (
  SELECT W.project, asked, V.id, V.ord, CASE WHEN V.id = asked THEN 1 WHEN V.id = 'file:' || asked THEN 2 WHEN V.id = regexp_replace(asked, '^file:', '') THEN 3 ELSE 4 END AS tier
  FROM W JOIN V ON V.project = W.project AND (V.id = asked OR V.id = 'file:' || asked OR V.id = regexp_replace(asked, '^file:', '') OR ends_with(V.id, asked) OR ends_with(V.file, asked))
) SELECT project, asked, id FROM C QUALIFY row_number() OVER (PARTITION BY project, asked ORDER BY tier, ord, id) = 1""")
def resolve_node_id(spark, d):
    """The node each file named in the commits stands for."""
    v = load_nodes(spark, d)
    return graph.resolve_ids(v, table(spark, d, "commits").where("file <> ''").select("project", F.col("file").alias("asked")))


@query(GRAPH_SQL + """ SELECT e.project, source, target, edge_type, s.id IS NULL AS missing_source, t.id IS NULL AS missing_target FROM E0 e
LEFT JOIN V s ON s.project = e.project AND s.id = e.source LEFT JOIN V t ON t.project = e.project AND t.id = e.target WHERE s.id IS NULL OR t.id IS NULL""")
def dangling_edges(spark, d):
    return graph.dangling_edges(table(spark, d, "edges"), graph.latest_nodes(table(spark, d, "nodes").select(*_COLUMNS)))


@query(GRAPH_SQL + " SELECT project, id, V.node_type FROM V JOIN D USING (project, id) WHERE degree = 0")
def orphan_nodes(spark, d):
    return graph.orphan_nodes(*load(spark, d))


@query(GRAPH_SQL + """ SELECT project, id, node_type FROM V WHERE node_type IN ('file', 'function', 'class') AND NOT regexp_matches(coalesce(file, id), '\\.test\\.|\\.spec\\.|__tests__')
AND NOT EXISTS (SELECT 1 FROM E WHERE edge_type = 'tested_by' AND E.project = V.project AND E.target = V.id)""")
def nodes_without_tests(spark, d):
    return graph.nodes_without_tests(*load(spark, d))


@query(GRAPH_SQL + """ SELECT DISTINCT project, target AS id FROM E WHERE edge_type IN ('tested_by', 'calls')
AND EXISTS (SELECT 1 FROM V WHERE V.project = E.project AND V.id = E.source AND regexp_matches(V.label, '\\.(test|spec)\\.[jt]sx?$'))""")
def directly_tested(spark, d):
    return graph.directly_tested(*load(spark, d))


def _layer_case(column: str) -> str:
    from ..model import LAYER_PATTERNS

    text = f"lower(replace({column}, '\\', '/'))"
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{name}'" for name, p in LAYER_PATTERNS) + " ELSE 'general' END"


@query(GRAPH_SQL + f" SELECT project, id, {_layer_case('coalesce(file, id)')} AS layer FROM V WHERE node_type = 'file'")
def layer_assign(spark, d):
    return smells.path_layers(load_nodes(spark, d))


_RANK = "CASE {0} WHEN 'infrastructure' THEN 0 WHEN 'config' THEN 1 WHEN 'schema' THEN 2 WHEN 'data' THEN 3 WHEN 'domain' THEN 4 WHEN 'api' THEN 5 WHEN 'ui' THEN 6 END"
_VIOLATIONS = f""", P AS (SELECT project, id, {_layer_case('coalesce(file, id)')} AS layer FROM V WHERE node_type = 'file'),
X AS (SELECT e.project, e.source, e.target, s.layer AS sl, t.layer AS tl, {_RANK.format('t.layer')} - {_RANK.format('s.layer')} AS gap FROM E e
  JOIN P s ON s.project = e.project AND s.id = e.source JOIN P t ON t.project = e.project AND t.id = e.target WHERE edge_type = 'imports')
"""


@query(GRAPH_SQL + _VIOLATIONS + " SELECT project, source AS node_id, target, CASE WHEN gap >= 3 THEN 'high' ELSE 'medium' END AS severity, sl || ' -> ' || tl AS heuristic FROM X WHERE gap > 0")
def layer_violations(spark, d):
    v, e = load(spark, d)
    return smells.layer_violations(e, smells.path_layers(v)).select("project", "node_id", F.col("related_node_ids")[0].alias("target"), "severity", "heuristic")


@query(GRAPH_SQL + _LAYERS_SQL + """ SELECT E.project, s.layer AS source_layer, t.layer AS target_layer, count(*) AS n_edges FROM E
JOIN L s ON s.project = E.project AND s.id = E.source JOIN L t ON t.project = E.project AND t.id = E.target WHERE s.layer <> t.layer GROUP BY 1, 2, 3""")
def layer_edge_matrix(spark, d):
    v, e = load(spark, d)
    return graph.layer_edges(e, graph.layer_map(v, table(spark, d, "layers")))


@query(GRAPH_SQL + _LAYERS_SQL + f""", top AS (SELECT project, id FROM D QUALIFY row_number() OVER (PARTITION BY project ORDER BY degree DESC, id) <= 120),
place AS (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY coalesce({_RANK.format('L.layer')}, 99), label, id) - 1 AS at FROM top JOIN V USING (project, id) JOIN L USING (project, id))
SELECT E.project, CAST(r.at AS INTEGER) AS row_index, CAST(c.at AS INTEGER) AS column_index, round(sum(coalesce(weight, 1.0)), 6) AS weight, arg_max(edge_type, {{'o': E.ord, 't': edge_type}}) AS last_type, count(*) AS n_edges
FROM E JOIN place r ON r.project = E.project AND r.id = E.source JOIN place c ON c.project = E.project AND c.id = E.target GROUP BY 1, 2, 3""")
def adjacency_cells(spark, d):
    v, e = load(spark, d)
    return graph.adjacency_cells(v, e, graph.layer_map(v, table(spark, d, "layers")))


@query(GRAPH_SQL + _LAYERS_SQL + """ SELECT project, L.layer, count(*) AS members, count(*) FILTER (risk_score >= 0.7) AS high_risk, count(*) FILTER (len(structural_warnings) > 0) AS with_smells
FROM V JOIN L USING (project, id) WHERE L.layer IS NOT NULL GROUP BY 1, 2""")
def layer_stats(spark, d):
    v = load_nodes(spark, d)
    return graph.layer_stats(v, graph.layer_map(v, table(spark, d, "layers")))


@query(GRAPH_SQL + """, f AS (SELECT project, string_split(file, '/') AS s, coalesce(end_line, 1) AS n FROM V WHERE node_type = 'file' AND file IS NOT NULL),
x AS (SELECT project, s, n, unnest(range(0, len(s))) AS depth FROM f)
SELECT project, array_to_string(s[1:depth], '/') AS folder, CAST(depth AS INTEGER) AS depth, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_lines FROM x GROUP BY 1, 2, 3""")
def treemap_rollup(spark, d):
    return graph.treemap(load_nodes(spark, d))


@query(GRAPH_SQL + """ SELECT project, id, node_type, complexity FROM V WHERE node_type IN ('file', 'class') AND complexity IN ('complex') AND risk_score >= 0.4""")
def facet_filter(spark, d):
    v = load_nodes(spark, d)
    return graph.facet_filter(v, node_types=["file", "class"], complexities=["complex"], tiers=["high", "medium"]).select(*KEY, "node_type", "complexity")


@query(GRAPH_SQL + """ SELECT project, source, target, arg_min(edge_type, {'o': ord, 't': edge_type}) AS edge_type FROM E WHERE source <> target GROUP BY 1, 2, 3""")
def force_links(spark, d):
    return graph.force_links(*load(spark, d))[1]


@query(GRAPH_SQL + """ SELECT project, regexp_extract(file, '^(.*)/[^/]*$', 1) AS folder, string_split(file, '/')[-1] AS name, id, node_type FROM V WHERE file <> ''
QUALIFY row_number() OVER (PARTITION BY project, file ORDER BY CASE WHEN node_type = 'file' THEN 0 ELSE 1 END, ord, id) = 1""")
def path_tree(spark, d):
    return graph.path_tree(load_nodes(spark, d))


def _seeds(v: DataFrame) -> DataFrame:
    """The riskiest file of each project."""
    return v.where("node_type = 'file'").groupBy("project").agg(F.min_by("id", F.struct(-F.coalesce("risk_score", F.lit(-1.0)), "id")).alias("id"))


_SEEDS = ", S AS (SELECT project, id FROM V WHERE node_type = 'file' QUALIFY row_number() OVER (PARTITION BY project ORDER BY coalesce(risk_score, -1.0) DESC, id) = 1)"


@query(GRAPH_SQL + _SEEDS + ", R AS (SELECT project, id FROM S UNION SELECT E.project, E.target FROM R JOIN E ON E.project = R.project AND E.source = R.id) SELECT project, id FROM R EXCEPT SELECT project, id FROM S")
def reachable_out(spark, d):
    """Nodes reached from the riskiest file of each project."""
    v, e = load(spark, d)
    return traversal.reachable(e, _seeds(v)).select(*KEY)


@query(GRAPH_SQL + _SEEDS + ", R AS (SELECT project, id FROM S UNION SELECT E.project, E.source FROM R JOIN E ON E.project = R.project AND E.target = R.id) SELECT project, id FROM R EXCEPT SELECT project, id FROM S")
def reachable_in(spark, d):
    v, e = load(spark, d)
    return traversal.reachable(e, _seeds(v), "in").select(*KEY)


_IMPACT = _SEEDS + """, R AS (SELECT project, id, 0 AS depth FROM S UNION SELECT E.project, E.source, depth + 1 FROM R JOIN E ON E.project = R.project AND E.target = R.id WHERE depth < 40),
B AS (SELECT project, id, min(depth) AS depth FROM R GROUP BY 1, 2)"""


@query(GRAPH_SQL + _IMPACT + " SELECT B.project, B.id, B.depth, V.label, V.risk_score, coalesce(V.risk_score >= 0.7, false) AS high_risk FROM B JOIN V USING (project, id) WHERE depth > 0")
def diff_impact(spark, d):
    """Nodes that depend on the riskiest file of each project, with their distance."""
    v, e = load(spark, d)
    return traversal.diff_impact(v, e, _seeds(v)).drop("path")


@query(GRAPH_SQL + _IMPACT + """, G AS (SELECT DISTINCT E.project, t.id AS a, s.id AS b, s.depth FROM E JOIN B t ON t.project = E.project AND t.id = E.target JOIN B s ON s.project = E.project AND s.id = E.source WHERE s.depth = t.depth + 1),
Q AS (SELECT project, id, 0 AS depth, id AS path FROM S UNION ALL SELECT G.project, G.b, G.depth, min(Q.path || ' > ' || G.b) FROM Q JOIN G ON G.project = Q.project AND G.a = Q.id AND G.depth = Q.depth + 1 GROUP BY 1, 2, 3)
SELECT project, id, depth, path FROM Q WHERE depth > 0""")
def diff_impact_paths(spark, d):
    """One shortest path for each impacted node."""
    v, e = load(spark, d)
    return traversal.diff_impact(v, e, _seeds(v)).select(*KEY, "depth", "path")


@query(GRAPH_SQL + """, G AS (SELECT project, arg_min(id, {'d': -degree, 'i': id}) AS start, arg_max(id, {'d': -degree, 'i': id}) AS goal FROM D JOIN V USING (project, id) WHERE node_type = 'file' AND degree > 0 GROUP BY 1),
U AS (SELECT project, source AS a, target AS b FROM E WHERE source <> target UNION SELECT project, target, source FROM E WHERE source <> target),
R AS (SELECT project, start AS id, 0 AS n FROM G UNION SELECT U.project, U.b, n + 1 FROM R JOIN U ON U.project = R.project AND U.a = R.id WHERE n < 10)
SELECT G.project, start, goal, CAST(min(n) AS INTEGER) AS n_edges FROM G JOIN R ON R.project = G.project AND R.id = G.goal GROUP BY 1, 2, 3""")
def shortest_path(spark, d):
    """From the best to the least connected file of each project."""
    v, e = load(spark, d)
    at = graph.degrees(v, e).where("degree > 0").join(v.where("node_type = 'file'").select(*KEY), KEY, "left_semi")
    by = F.struct(-F.col("degree"), F.col("id"))
    ends = at.groupBy("project").agg(F.min_by("id", by).alias("start"), F.max_by("id", by).alias("goal"))
    return traversal.shortest_paths(e, ends).drop("path")


@query(GRAPH_SQL + """, I AS (SELECT DISTINCT project, source, target FROM E WHERE edge_type IN ('imports', 'depends_on')), C AS (SELECT project, source AS up, target AS id FROM I UNION SELECT C.project, I.source, C.id FROM C JOIN I ON I.project = C.project AND I.target = C.up),
n AS (SELECT project, count(*) AS k FROM V GROUP BY 1), k AS (SELECT project, id, count(*) AS k FROM C GROUP BY 1, 2)
SELECT V.project, V.id, coalesce(k.k, 0) AS n_dependents, round(least(coalesce(k.k, 0) / n.k, 1.0), 6) AS blast FROM V JOIN n ON n.project = V.project LEFT JOIN k ON k.project = V.project AND k.id = V.id""")
def blast_radius(spark, d):
    """Transitive importers of every node."""
    v, e = load_plain(spark, d, ("imports", "depends_on"))
    return traversal.blast_radius(v, e)


@query(GRAPH_SQL + """, I AS (SELECT DISTINCT project, source, target FROM E WHERE edge_type IN ('imports', 'depends_on') AND source <> target),
W AS (SELECT project, source AS first, target AS last, [source, target] AS cycle FROM I WHERE source < target
  UNION ALL SELECT W.project, first, I.target, list_append(cycle, I.target) FROM W JOIN I ON I.project = W.project AND I.source = W.last AND I.target > first AND NOT list_contains(cycle, I.target) WHERE len(cycle) < 6)
SELECT W.project, CAST(len(cycle) AS INTEGER) AS n, array_to_string(cycle, ' > ') AS cycle FROM W JOIN I ON I.project = W.project AND I.source = W.last AND I.target = W.first""")
def circular_dependencies(spark, d):
    e = load_edges(spark, d)
    return traversal.simple_cycles(e).select("project", "n", F.array_join("cycle", " > ").alias("cycle"))


@query()
def topological_order(spark, d):
    """Peel level of every node that can be ordered by its dependencies."""
    return traversal.topological_levels(load_edges(spark, d))


def _starts(v: DataFrame) -> DataFrame:
    path = F.coalesce("file", "id")
    return v.where("node_type = 'file'").select(*KEY, F.when(P.is_entry_point(path), 0).otherwise(1).alias("rank"))


@query()
def tour_steps(spark, d):
    v, e = load(spark, d)
    return traversal.tours(v, e, _starts(v)).drop("depth")


@query(GRAPH_SQL + """ SELECT project, id, round(risk_score, 6) AS risk_score, row_number() OVER (PARTITION BY project ORDER BY risk_score DESC, ord) AS pos FROM V WHERE node_type = 'file' AND risk_score > 0.4
QUALIFY row_number() OVER (PARTITION BY project ORDER BY risk_score DESC, ord) <= 8 AND count(*) OVER (PARTITION BY project) >= 2""")
def risk_tour(spark, d):
    """The up to eight riskiest files of each project, riskiest first; projects with one such file have no tour."""
    from pyspark.sql import Window

    v = load_nodes(spark, d)
    files = v.where("node_type = 'file' and risk_score > 0.4")
    many = files.groupBy("project").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").drop("_n")
    # only the eight best of each task are shuffled
    best = files.withColumn("pos", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("risk_score"), "ord"))).where("pos <= 8")
    return best.join(many, "project", "left_semi").select(*KEY, F.round("risk_score", 6).alias("risk_score"), F.col("pos").cast("long").alias("pos"))


@query(GRAPH_SQL + """ SELECT project, id AS node_id, 'out_degree > 20' AS heuristic FROM D JOIN V USING (project, id) WHERE node_type IN ('file', 'class', 'module') AND out_degree > 20
UNION ALL SELECT E.project, E.source, 'function_count > 25' FROM E JOIN V t ON t.project = E.project AND t.id = E.target AND t.node_type = 'function' JOIN V s ON s.project = E.project AND s.id = E.source AND s.node_type IN ('file', 'class', 'module')
WHERE edge_type = 'contains' GROUP BY 1, 2 HAVING count(*) > 25""")
def god_nodes(spark, d):
    return smells.god_nodes(*load(spark, d)).select("project", "node_id", "heuristic")


@query(GRAPH_SQL + " SELECT project, id AS node_id, 'medium' AS severity FROM D WHERE degree > 30")
def over_connected(spark, d):
    return smells.over_connected(*load(spark, d)).select("project", "node_id", "severity")


@query(GRAPH_SQL + """ SELECT project, id AS node_id FROM D JOIN V USING (project, id) WHERE degree = 0 AND node_type = 'file' AND NOT regexp_matches(lower(coalesce(file, id)), '(^|[/:])(index|main|app|server|cli)\\.[^/.]+$')""")
def orphan_files(spark, d):
    return smells.orphan_files(*load(spark, d)).select("project", "node_id")


@query(GRAPH_SQL + """, f AS (SELECT project, id, concat_ws('|', CAST(floor(coalesce(TRY_CAST(metadata['param_count'] AS INTEGER), 0) / 2) AS BIGINT), CASE complexity WHEN 'complex' THEN '2' WHEN 'moderate' THEN '1' ELSE '0' END) AS sig FROM V WHERE node_type = 'function'),
c AS (SELECT DISTINCT E.project, E.source, f.id, f.sig FROM E JOIN f ON f.project = E.project AND f.id = E.target WHERE edge_type = 'calls'),
p AS (SELECT a.project, a.sig, a.id AS a, b.id AS b FROM c a JOIN c b ON a.project = b.project AND a.source = b.source AND a.sig = b.sig AND a.id < b.id GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
s AS (SELECT project, sig, count(*) AS size FROM f GROUP BY 1, 2)
SELECT project, node_id, CASE WHEN size > 4 THEN 'high' WHEN size > 2 THEN 'medium' ELSE 'low' END AS severity, n_related FROM (SELECT project, sig, id AS node_id, count(*) AS n_related FROM (SELECT project, sig, a AS id FROM p UNION ALL SELECT project, sig, b FROM p) GROUP BY 1, 2, 3) JOIN s USING (project, sig)""")
def duplicate_logic(spark, d):
    return smells.duplicate_logic(*load(spark, d)).select("project", "node_id", "severity", F.size("related_node_ids").cast("long").alias("n_related"))


@query(GRAPH_SQL + """, im AS (SELECT DISTINCT E.project, E.source AS id, E.target FROM E JOIN V ON V.project = E.project AND V.id = E.source AND V.node_type IN ('file', 'module') WHERE edge_type = 'imports' AND E.source <> E.target),
n AS (SELECT project, id, count(*) AS n FROM im GROUP BY 1, 2 HAVING count(*) > 3), m AS (SELECT im.*, n.n FROM im JOIN n USING (project, id)),
p AS (SELECT a.project, a.id AS node_id, b.id AS related, a.n AS na, b.n AS nb, count(*) AS k FROM m a JOIN m b ON a.project = b.project AND a.target = b.target AND a.id < b.id GROUP BY 1, 2, 3, 4, 5)
SELECT project, node_id, related FROM p WHERE k / greatest(na, nb) > 0.4 AND NOT EXISTS (SELECT 1 FROM E WHERE E.project = p.project AND (E.source = node_id AND E.target = related OR E.source = related AND E.target = node_id))""")
def unclear_coupling(spark, d):
    return smells.unclear_coupling(*load(spark, d)).select("project", "node_id", F.col("related_node_ids")[0].alias("related"))


@query(GRAPH_SQL + """, dom AS (SELECT project, id, string_split(file, '/')[2] AS domain FROM V WHERE node_type = 'function' AND len(string_split(file, '/')) >= 2),
c AS (SELECT h.project, h.source AS id, domain, count(*) AS n FROM (SELECT DISTINCT project, source, target FROM E WHERE edge_type = 'contains') h JOIN dom ON dom.project = h.project AND dom.id = h.target GROUP BY 1, 2, 3)
SELECT project, id AS node_id, count(*) AS domains FROM c GROUP BY 1, 2 HAVING count(*) >= 3 AND max(n) / sum(n) < 0.5""")
def low_cohesion(spark, d):
    """Nodes whose contained functions come from three or more domains without a main one."""
    v, e = load(spark, d)
    held = e.where("edge_type = 'contains'").select("project", F.col("source").alias("node_id"), F.col("target").alias("id")).distinct().join(domain_of(v), KEY)
    found = smells.low_cohesion(e, domain_of(v))
    return found.select("project", "node_id").join(held.groupBy("project", "node_id").agg(F.countDistinct("domain").alias("domains")), ["project", "node_id"])


@query(GRAPH_SQL + """, f AS (SELECT project, id, lower(trim(label)) AS name, file FROM V WHERE node_type IN ('function', 'class') AND trim(label) <> ''), g AS (SELECT project, name, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT file) >= 3)
SELECT project, id AS node_id, CASE WHEN n >= 5 THEN 'high' ELSE 'medium' END AS severity FROM f JOIN g USING (project, name)""")
def name_duplicates(spark, d):
    return smells.name_duplicates(load_nodes(spark, d)).select("project", "node_id", "severity")


@query()
def all_smells(spark, d):
    v, e = load(spark, d)
    found = smells.all_smells(v, e, changes_of(spark, d), domain_of(v))
    return found.withColumn("related_node_ids", F.array_join("related_node_ids", ","))


@query("""WITH x AS (SELECT project, id, unnest(structural_warnings) AS w FROM (SELECT project, id, structural_warnings FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project, """ + _CANON.format("id") + """ ORDER BY ord DESC) = 1))
SELECT project, w.category AS category, w.severity AS severity, count(*) AS n_warnings, count(DISTINCT """ + _CANON.format("id") + """) AS n_nodes FROM x GROUP BY 1, 2, 3""")
def smell_summary(spark, d):
    """The warnings recorded on the nodes."""
    v = load_nodes(spark, d)
    w = v.select("project", F.col("id").alias("node_id"), F.explode("structural_warnings").alias("w")).select("project", "node_id", "w.category", "w.severity")
    return smells.smell_summary(w)


_RISK = """, CM AS (SELECT DISTINCT commit_id, project, file, commit_date, author FROM commits),
CK AS (SELECT *, CASE WHEN regexp_matches(commit_date, '[+-][0-9]{2}:?[0-9]{2}$') THEN CAST(regexp_replace(replace(commit_date, 'T', ' '), ' ?([+-][0-9]{2}):?([0-9]{2})$', '\\1:\\2') AS TIMESTAMPTZ) AT TIME ZONE 'UTC'
  ELSE TRY_CAST(replace(replace(commit_date, 'T', ' '), 'Z', '') AS TIMESTAMP) END AS moment FROM CM),
CH AS (SELECT project, 'file:' || file AS id, count(*) FILTER (moment >= (SELECT max(moment) FROM CK) - INTERVAL 90 DAY) AS freq, count(*) FILTER (moment >= (SELECT max(moment) FROM CK) - INTERVAL 14 DAY) AS recent,
  count(DISTINCT CASE WHEN author <> '' THEN author END) AS n_authors FROM CK WHERE file IS NOT NULL GROUP BY 1, 2),
A AS (SELECT DISTINCT project, source, target FROM E), C AS (SELECT project, source AS up, target AS id FROM A UNION SELECT C.project, A.source, C.id FROM C JOIN A ON A.project = C.project AND A.target = C.up),
NN AS (SELECT project, count(*) AS k FROM V GROUP BY 1), CC AS (SELECT project, id, count(*) AS k FROM C GROUP BY 1, 2),
I AS (SELECT DISTINCT project, source, target FROM E WHERE edge_type IN ('imports', 'depends_on') AND source <> target),
W AS (SELECT project, source AS first, target AS last, [source, target] AS cycle FROM I WHERE source < target
  UNION ALL SELECT W.project, first, I.target, list_append(cycle, I.target) FROM W JOIN I ON I.project = W.project AND I.source = W.last AND I.target > first AND NOT list_contains(cycle, I.target) WHERE len(cycle) < 6),
X AS (SELECT DISTINCT project, unnest(cycle) AS id FROM (SELECT W.project, cycle FROM W JOIN I ON I.project = W.project AND I.source = W.last AND I.target = W.first)),
TT AS (SELECT DISTINCT project, target AS id FROM E WHERE edge_type IN ('tested_by', 'calls') AND EXISTS (SELECT 1 FROM V WHERE V.project = E.project AND V.id = E.source AND regexp_matches(V.label, '\\.(test|spec)\\.[jt]sx?$'))),
Y AS (SELECT project, """ + _CANON.format("m") + """ AS id, count(DISTINCT tour_id) AS n_tours FROM (SELECT project, id AS tour_id, unnest(node_ids) AS m FROM layers) WHERE m <> '' GROUP BY 1, 2),
P AS (SELECT V.project, V.id, coalesce(len(structural_warnings), 0) AS n_warnings, degree, X.id IS NOT NULL AS circular, TT.id IS NOT NULL AS tested, coalesce(freq, 0) AS freq, coalesce(recent, 0) AS recent, coalesce(n_authors, 0) AS n_authors,
  coalesce(n_tours, 0) AS n_tours, round(least(coalesce(CC.k, 0) / NN.k, 1.0), 6) AS blast FROM V JOIN D USING (project, id) JOIN NN ON NN.project = V.project LEFT JOIN CC ON CC.project = V.project AND CC.id = V.id
  LEFT JOIN X ON X.project = V.project AND X.id = V.id LEFT JOIN TT ON TT.project = V.project AND TT.id = V.id LEFT JOIN CH ON CH.project = V.project AND CH.id = V.id LEFT JOIN Y ON Y.project = V.project AND Y.id = V.id
  WHERE node_type <> 'config' AND NOT coalesce(regexp_matches(label, '\\.(test|spec)\\.[jt]sx?$'), false)),
R AS (SELECT *, least(least(degree / 40.0, 1.0) + CASE WHEN circular THEN 0.2 ELSE 0.0 END, 1.0) AS coupling, CASE WHEN tested THEN 0.0 ELSE 0.5 + least(blast / 2, 0.5) END AS test_gap, least(freq / 20.0, 1.0) AS churn FROM P)
SELECT project, id, blast, round(coupling, 9) AS coupling, round(test_gap, 9) AS test_gap, round(churn, 9) AS churn, round(least(greatest(0.35 * blast + 0.25 * coupling + 0.25 * test_gap + 0.15 * churn, 0.0), 1.0), 9) AS risk,
array_to_string(list_filter([CASE WHEN coupling > 0.6 THEN 'high_coupling' END, CASE WHEN test_gap > 0.5 THEN 'no_test_coverage' END, CASE WHEN churn > 0.5 THEN 'frequent_changes' END, CASE WHEN blast > 0.5 THEN 'large_blast_radius' END,
  CASE WHEN n_tours >= 2 AND blast > 0.3 THEN 'critical_path' END, CASE WHEN n_authors = 1 AND freq > 5 THEN 'single_author' END, CASE WHEN recent >= 3 THEN 'recent_churn' END, CASE WHEN n_warnings > 0 THEN 'has_structural_warnings' END], lambda f: f IS NOT NULL), ',') AS factors FROM R"""


@query(GRAPH_SQL + _RISK)
def risk_scores(spark, d):
    """Risk of every node over all edges, layers read as tours, with its factors."""
    v, e = load_plain(spark, d)
    blast, circular = traversal.blast_radius(v, e), traversal.on_short_cycles(e)
    found = risk.risk_scores(v, e, blast, changes_of(spark, d), views.tour_counts(layer_steps(spark, d)), circular)
    return found.withColumn("factors", F.array_join("factors", ","))


@query(GRAPH_SQL + " SELECT project, CASE WHEN risk_score IS NULL THEN 'none' WHEN risk_score >= 0.7 THEN 'high' WHEN risk_score >= 0.4 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n_nodes FROM V GROUP BY 1, 2")
def risk_tiers(spark, d):
    return risk.risk_summary(load_nodes(spark, d), "risk_score")


@query(GRAPH_SQL + """, sz AS (SELECT project, count(*) AS n_nodes, count(*) FILTER (risk_score >= 0.7) AS risk_high, count(*) FILTER (risk_score >= 0.4 AND risk_score < 0.7) AS risk_medium, count(*) FILTER (risk_score < 0.4) AS risk_low FROM V GROUP BY 1),
ne AS (SELECT project, count(*) AS n FROM E GROUP BY 1), bo AS (SELECT project, count(*) AS n FROM D WHERE degree = 0 GROUP BY 1),
un AS (SELECT project, count(*) AS n FROM V WHERE node_type IN ('file', 'function', 'class') AND NOT regexp_matches(coalesce(file, id), '\\.test\\.|\\.spec\\.|__tests__') AND NOT EXISTS (SELECT 1 FROM E WHERE edge_type = 'tested_by' AND E.project = V.project AND E.target = V.id) GROUP BY 1),
sm AS (SELECT project, count(*) AS n, count(*) FILTER (w.category = 'circular_dependency') AS c, count(*) FILTER (w.category = 'god_node') AS g FROM (SELECT project, unnest(structural_warnings) AS w FROM V) GROUP BY 1),
se AS (SELECT project, count(*) AS n, count(*) FILTER (w.severity = 'high') AS h FROM (SELECT project, unnest(security_warnings) AS w FROM V) GROUP BY 1),
a AS (SELECT sz.*, coalesce(ne.n, 0) AS n_edges, coalesce(bo.n, 0) AS n_orphans, coalesce(un.n, 0) AS n_untested, coalesce(sm.n, 0) AS n_smells, coalesce(sm.c, 0) AS n_circular, coalesce(sm.g, 0) AS n_god, coalesce(se.n, 0) AS n_security, coalesce(se.h, 0) AS n_security_high
  FROM sz LEFT JOIN ne USING (project) LEFT JOIN bo USING (project) LEFT JOIN un USING (project) LEFT JOIN sm USING (project) LEFT JOIN se USING (project)),
p AS (SELECT *, least(20.0, n_orphans / greatest(n_nodes, 1) * 100) AS dp, least(20.0, n_circular * 5.0) AS cp, least(15.0, n_god * 3.0) AS gp, least(20.0, n_security_high * 5.0) AS sp FROM a),
q AS (SELECT *, greatest(0.0, least(100.0, 100.0 - (dp + cp + gp + 0.0 + sp))) AS sc FROM p)
SELECT project, n_nodes, risk_high, risk_medium, risk_low, n_edges, n_orphans, n_untested, n_smells, n_circular, n_god, n_security, n_security_high, CAST(floor(sc + 0.5) AS INTEGER) AS score,
CASE WHEN sc >= 90 THEN 'A' WHEN sc >= 80 THEN 'B' WHEN sc >= 70 THEN 'C' WHEN sc >= 60 THEN 'D' ELSE 'F' END AS grade, CAST(floor(dp + 0.5) AS INTEGER) AS dead_code_penalty, CAST(floor(cp + 0.5) AS INTEGER) AS circular_penalty,
CAST(floor(gp + 0.5) AS INTEGER) AS god_node_penalty, 0 AS coupling_penalty, CAST(floor(sp + 0.5) AS INTEGER) AS security_penalty FROM q""")
def health_report(spark, d):
    v, e = load(spark, d)
    w = v.select("project", F.col("id").alias("node_id"), F.explode("structural_warnings").alias("w")).select("project", "node_id", "w.category")
    s = v.select("project", F.explode("security_warnings").alias("w")).select("project", "w.severity")
    return risk.health_report(v, e, w, s)


def _integrity_sql() -> str:
    from ..model import EDGE_TYPES, NODE_TYPES

    listed = lambda values: ", ".join(f"'{v}'" for v in values)
    return GRAPH_SQL + f""", F1 AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY edge_id) = 1), H AS (SELECT project, unnest([source, target]) AS x FROM F1),
M AS (SELECT project, layer_id, {_CANON.format("m")} AS id FROM (SELECT project, id AS layer_id, unnest(node_ids) AS m FROM (SELECT * FROM layers QUALIFY row_number() OVER (PARTITION BY project, id) = 1)) WHERE m <> ''), Z AS (
  SELECT project, 'unknown_node_type' AS rule, 'critical' AS severity, coalesce(node_type, 'null') AS subject FROM V WHERE coalesce(node_type NOT IN ({listed(NODE_TYPES)}), true)
  UNION ALL SELECT project, 'unknown_edge_type', 'critical', coalesce(edge_type, 'null') FROM F1 WHERE coalesce(edge_type NOT IN ({listed(EDGE_TYPES)}), true)
  UNION ALL SELECT project, 'missing_endpoint', 'critical', id FROM (SELECT project, {_CANON.format("x")} AS id FROM H WHERE x <> '') h WHERE NOT EXISTS (SELECT 1 FROM V WHERE V.project = h.project AND V.id = h.id)
  UNION ALL SELECT project, 'self_edge', 'warning', {_CANON.format("source")} FROM F1 WHERE {_CANON.format("source")} = {_CANON.format("target")}
  UNION ALL SELECT project, 'repeated_node', 'critical', 'all' FROM (SELECT project, {_CANON.format("id")} AS id FROM nodes WHERE id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
  UNION ALL SELECT project, 'file_without_summary', 'warning', 'all' FROM V WHERE node_type = 'file' AND coalesce(summary, '') = ''
  UNION ALL SELECT project, 'layer_missing_node', 'warning', layer_id FROM M WHERE NOT EXISTS (SELECT 1 FROM V WHERE V.project = M.project AND V.id = M.id)
) SELECT project, rule, severity, subject, count(*) AS n FROM Z GROUP BY 1, 2, 3, 4"""


@query(_integrity_sql())
def integrity_issues(spark, d):
    return risk.integrity_issues(table(spark, d, "nodes"), table(spark, d, "edges"), table(spark, d, "layers"))
