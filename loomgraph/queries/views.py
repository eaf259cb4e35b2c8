"""Queries of the views of the graph: counts, lists, scalings, summaries, calls and tours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract, graph, views
from ..session import table
from .graph import _CANON, GRAPH_SQL, KEY, layer_steps, load, load_nodes

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_STEPS = f""", Y AS (SELECT DISTINCT project, id AS tour_id, unnest(range(0, len(node_ids))) AS pos, unnest(node_ids) AS m FROM layers), Z AS (SELECT DISTINCT project, tour_id, pos, {_CANON.format("m")} AS id FROM Y WHERE m <> '')"""


@query(GRAPH_SQL + _STEPS + " SELECT project, id, count(DISTINCT tour_id) AS n_tours FROM Z GROUP BY 1, 2")
def tour_counts(spark, d):
    """In how many tours each node appears; the layers are read as tours."""
    return views.tour_counts(layer_steps(spark, d))


@query(GRAPH_SQL + _STEPS + " SELECT DISTINCT project, tour_id, id AS missing_id FROM Z WHERE NOT EXISTS (SELECT 1 FROM V WHERE V.project = Z.project AND V.id = Z.id)")
def tour_issues(spark, d):
    """Steps that name nodes that don't exist."""
    return views.tour_issues(layer_steps(spark, d), load_nodes(spark, d))


@query(GRAPH_SQL + _STEPS + """, there AS (SELECT Z.*, V.id IS NOT NULL AS there FROM Z LEFT JOIN V USING (project, id)), ok AS (SELECT project, tour_id, pos FROM there GROUP BY 1, 2, 3 HAVING bool_and(there)),
kept AS (SELECT project, tour_id FROM ok GROUP BY 1, 2 HAVING count(*) >= 2) SELECT project, tour_id, CAST(pos AS INTEGER) AS pos, id FROM Z SEMI JOIN ok USING (project, tour_id, pos) SEMI JOIN kept USING (project, tour_id)""")
def repaired_tours(spark, d):
    """The tours without steps that lead nowhere."""
    return views.repaired_tours(layer_steps(spark, d), load_nodes(spark, d)).select("project", "tour_id", "pos", F.explode("node_ids").alias("id"))


def _latest_patterns(spark, d):
    return graph.latest_nodes(table(spark, d, "nodes").select(*KEY, "detected_patterns", "ord"))


@query(f"""WITH n AS (SELECT project, detected_patterns FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project, {_CANON.format("id")} ORDER BY ord DESC NULLS LAST) = 1)
SELECT project, pattern, count(*) AS n FROM (SELECT project, unnest(detected_patterns) AS pattern FROM n) WHERE pattern IS NOT NULL GROUP BY 1, 2""")
def pattern_histogram(spark, d):
    return views.pattern_histogram(_latest_patterns(spark, d))


@query(GRAPH_SQL + """, w AS (SELECT project, id, unnest(structural_warnings) AS w FROM V), c AS (SELECT * FROM w WHERE w.category = 'circular_dependency')
SELECT DISTINCT project, id FROM (SELECT project, id FROM c UNION ALL SELECT project, unnest(w.related_node_ids) FROM c) WHERE id <> ''""")
def circular_participants(spark, d):
    return views.circular_participants(load_nodes(spark, d))


def _shapes_sql() -> str:
    from .. import model

    listed = lambda values: ", ".join(f"'{v}'" for v in values)
    return f"""WITH x AS (
  SELECT project, 'nodes.[].id: Required' AS shape FROM nodes WHERE coalesce(id, '') = '' UNION ALL SELECT project, 'nodes.[].label: Required' FROM nodes WHERE label IS NULL
  UNION ALL SELECT project, 'nodes.[].node_type: Unknown value' FROM nodes WHERE coalesce(node_type NOT IN ({listed(model.NODE_TYPES)}), true)
  UNION ALL SELECT project, 'nodes.[].complexity: Unknown value' FROM nodes WHERE complexity NOT IN ({listed(model.COMPLEXITIES)})
  UNION ALL SELECT project, 'edges.[].source: Required' FROM edges WHERE coalesce(source, '') = '' UNION ALL SELECT project, 'edges.[].target: Required' FROM edges WHERE coalesce(target, '') = ''
  UNION ALL SELECT project, 'edges.[].edge_type: Unknown value' FROM edges WHERE coalesce(edge_type NOT IN ({listed(model.EDGE_TYPES)}), true)
) SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, shape) AS INTEGER) AS rank, shape, count(*) AS n FROM x GROUP BY 1, 3 QUALIFY row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, shape) <= 3"""


@query(_shapes_sql())
def issue_shapes(spark, d):
    """The three commonest ways in which rows of a project miss the schema."""
    issues = views.schema_issues(table(spark, d, "nodes"), table(spark, d, "edges"))
    return views.issue_shapes(issues).select("project", "rank", "shape", "n")


@query(GRAPH_SQL + ", m AS (SELECT project, max(in_degree) AS most FROM D GROUP BY 1) SELECT project, id, round(CASE WHEN most = 0 THEN 8.0 ELSE 5 + in_degree / nullif(most, 0) * 15 END, 6) AS size FROM D JOIN m USING (project)")
def node_sizes(spark, d):
    return views.node_sizes(*load(spark, d))


@query(GRAPH_SQL + """, m AS (SELECT project, min(degree) AS lo, max(degree) AS hi FROM D GROUP BY 1) SELECT project, id, round((degree - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END, 6) AS scaled FROM D JOIN m USING (project)""")
def scaled_degrees(spark, d):
    v, e = load(spark, d)
    return views.scaled(graph.degrees(v, e), ["project"], "degree").select(*KEY, "scaled")


def _calls(spark, d):
    """(calls, functions): call sites of the functions table resolved in the same file, else over the imports of the graph."""
    f = table(spark, d, "functions").select("fn_id", "project", F.col("file_path").alias("path"), "fn_name", "body", "exported").where("body is not null").dropDuplicates(["fn_id"])
    sites = extract.call_sites(f).join(f.select("fn_id", "project", "path", F.col("fn_name").alias("caller")), "fn_id").groupBy("project", "path", "caller", "callee").agg(F.sum("n").alias("n"))
    v, e = load(spark, d)
    files = v.where("node_type = 'file' and file is not null").select("project", "id", "file")
    ends = graph.with_end_columns(e.where("edge_type = 'imports'").select("project", "source", "target"), files, ["file"])
    targets = ends.select("project", F.col("source_file").alias("path"), F.col("target_file").alias("raw"), F.col("target_file").alias("target")).where("path <> target").distinct()
    symbols = f.select("project", "path", F.lit("function").alias("kind"), F.col("fn_name").alias("name"), "exported")
    return extract.resolve_calls(sites, symbols, targets), symbols.select("project", "path", "name", "exported")


def _calls_sql() -> str:
    from .content import _STRIP

    return GRAPH_SQL + f""", f AS (SELECT DISTINCT fn_id, project, file_path AS path, fn_name, body, exported FROM functions WHERE body IS NOT NULL),
x AS (SELECT project, path, fn_name AS caller, unnest(regexp_extract_all({_STRIP}, '(?:\\.\\s*)?\\b([A-Za-z_$][\\w$]*)\\s*\\(', 1)) AS callee FROM f),
s AS (SELECT project, path, caller, callee, count(*) AS n FROM x WHERE callee NOT IN ({", ".join(repr(y) for y in extract.NO_CALLS)}) GROUP BY 1, 2, 3, 4),
im AS (SELECT DISTINCT e.project, a.file AS path, b.file AS target FROM E e JOIN V a ON a.project = e.project AND a.id = e.source AND a.node_type = 'file' JOIN V b ON b.project = e.project AND b.id = e.target AND b.node_type = 'file' WHERE edge_type = 'imports' AND a.file <> b.file),
c AS (SELECT s.*, s.path AS to_path, true AS internal FROM s WHERE EXISTS (SELECT 1 FROM f WHERE f.project = s.project AND f.path = s.path AND f.fn_name = s.callee)
  UNION ALL SELECT s.*, im.target, false FROM s JOIN im ON im.project = s.project AND im.path = s.path WHERE EXISTS (SELECT 1 FROM f WHERE f.project = s.project AND f.path = im.target AND f.fn_name = s.callee AND f.exported)),
r AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY project, path, caller, callee ORDER BY CASE WHEN internal THEN 0 ELSE 1 END, to_path) = 1)"""


@query(_calls_sql() + " SELECT project, path, caller, callee, CAST(n AS BIGINT) AS n, to_path, internal FROM r")
def resolved_calls(spark, d):
    """Calls of the functions table to functions of the same file, else of an imported one."""
    return _calls(spark, d)[0]


@query(_calls_sql() + """, k AS (SELECT * FROM r WHERE caller <> callee OR path <> to_path), m AS (SELECT project, path, caller AS name, sum(CASE WHEN internal THEN n ELSE 0 END) AS ic, sum(CASE WHEN internal THEN 0 ELSE n END) AS ec FROM k GROUP BY 1, 2, 3),
g AS (SELECT project, to_path AS path, callee AS name, count(DISTINCT (path, caller)) AS nc FROM k GROUP BY 1, 2, 3), o AS (SELECT project, path, fn_name AS name, bool_or(coalesce(exported, false)) AS exported FROM f GROUP BY 1, 2, 3)
SELECT project, path, name, CAST(coalesce(ic, 0) AS BIGINT) AS internal_calls, CAST(coalesce(ec, 0) AS BIGINT) AS external_calls, coalesce(nc, 0) AS n_callers, coalesce(nc, 0) = 0 AND NOT exported AS is_unused FROM (SELECT * FROM m FULL JOIN g USING (project, path, name)) JOIN o USING (project, path, name)""")
def call_metadata(spark, d):
    """Internal and external calls and distinct callers of each function that calls or is called."""
    return views.call_metadata(*_calls(spark, d))


@query(GRAPH_SQL + """, l AS (SELECT project, id, layer FROM V WHERE layer <> 'general'), n AS (SELECT project, layer, count(*) AS n_members FROM l GROUP BY 1, 2) SELECT project, layer, n_members, id FROM l JOIN n USING (project, layer)""")
def layer_members(spark, d):
    return views.layer_members(load_nodes(spark, d).select(*KEY, "layer"))


@query(GRAPH_SQL + """, s AS (SELECT project, unnest(structural_warnings) AS w FROM V), q AS (SELECT project, unnest(security_warnings) AS w FROM V), x AS (
  SELECT project, 'smell' AS summary, w.category AS bucket FROM s UNION ALL SELECT project, 'security_severity', w.severity FROM q WHERE w.severity IN ('low', 'medium', 'high') UNION ALL SELECT project, 'security_category', w.category FROM q
  UNION ALL SELECT project, 'risk', CASE WHEN coalesce(risk_score, 0) >= 0.7 THEN 'high' WHEN coalesce(risk_score, 0) >= 0.4 THEN 'medium' ELSE 'low' END FROM V
) SELECT project, summary, coalesce(bucket, '') AS bucket, count(*) AS n FROM x GROUP BY 1, 2, 3""")
def summaries(spark, d):
    """Smell, security and risk summaries recomputed from the nodes."""
    return views.summaries(load_nodes(spark, d))


@query(GRAPH_SQL + " SELECT project, id, file FROM V WHERE contains(lower(file), 'parser')")
def file_search(spark, d):
    return views.file_search(load_nodes(spark, d), "Parser")


@query("""SELECT DISTINCT project, 'domain:' || layer_name AS source, 'flow:' || id AS target FROM layers WHERE layer_name IS NOT NULL AND id IS NOT NULL""")
def domain_flow_edges(spark, d):
    """Edges from domains to their flows; each layer name is read as a domain and each layer as a flow."""
    flows = table(spark, d, "layers").where("layer_name is not null").select("project", F.col("layer_name").alias("domain"), F.col("id").alias("flow_id"))
    return views.domain_graph(flows)[1]


@query(GRAPH_SQL + """, S AS (SELECT project, id FROM V WHERE risk_score >= 0.7), x AS (SELECT project, source AS id, 'out' AS direction, target AS other, edge_type, ord FROM E UNION ALL SELECT project, target, 'in', source, edge_type, ord FROM E)
SELECT project, id, direction, CAST(row_number() OVER (PARTITION BY project, id, direction ORDER BY ord, other, edge_type) AS INTEGER) AS pos, other, edge_type FROM x SEMI JOIN S USING (project, id)
QUALIFY row_number() OVER (PARTITION BY project, id, direction ORDER BY ord, other, edge_type) <= 12""")
def link_lists(spark, d):
    """The first twelve links each way of all high-risk nodes."""
    v, e = load(spark, d)
    return views.link_lists(e, v.where("risk_score >= 0.7"))


@query(GRAPH_SQL + " SELECT project, id, complexity FROM V ORDER BY complexity DESC NULLS LAST, project, id LIMIT 100")
def sorted_nodes(spark, d):
    """The first hundred nodes in the order of a chosen column."""
    return views.sort_by(load_nodes(spark, d).select(*KEY, "complexity"), "complexity", descending=True).limit(100)
