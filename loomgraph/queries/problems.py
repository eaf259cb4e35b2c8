"""Queries of the general problems: nested records (p1), orphan references (p5), drifting schemas (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, nested, orphans
from ..session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    shredded = nested.shred(table(spark, d, "raw_graphs"), with_fields=False)
    return shredded.select("record_id", "kind", "path", "child_id")


def _flat(kind: str, name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.flat_table(nested.shred(table(spark, d, "raw_graphs")), kind, nested.TABLES[kind])

    query.__name__ = name
    query.__doc__ = f"The flat table of kind {kind} with the link to its parent."
    return query


FLAT = [_flat(k, f"p1_{n}") for k, n in (("commit", "commits"), ("step", "steps"), ("node", "nodes"), ("author", "authors"), ("warning", "warnings"), ("related", "related"), ("domain", "domains"), ("flow", "flows"), ("step_node", "step_nodes"))]


def p1_table_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table by schema path."""
    shredded = nested.shred(table(spark, d, "raw_graphs"), with_fields=False)
    return shredded.groupBy("kind", "schema_path").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("record_id").alias("n_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "nodes"), table(spark, d, "edges"), table(spark, d, "layers"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(p5_found(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "assembly_files")).drop("score")


def p6_stops(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table of tour stops over all files."""
    return drift.unified(table(spark, d, "assembly_files"), "stop")


def p6_warnings(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "assembly_files"), "warning")


QUERIES = {f.__name__: f for f in (p1_found, *FLAT, p1_table_counts, p5_found, p5_counts, p6_found, p6_stops, p6_warnings)}

_P5 = r"""
WITH n AS (
  SELECT project, regexp_replace(id, '^([A-Za-z_]+:)(.*)$', '\1\2') AS raw FROM nodes
), canon AS (
  SELECT project, CASE WHEN split_part(id, ':', 1) <> '' AND split_part(id, ':', 1) = split_part(id, ':', 2) AND regexp_matches(id, '^[A-Za-z_]+:[A-Za-z_]+:')
                       THEN substr(id, length(split_part(id, ':', 1)) + 2) ELSE id END AS cid, recorded_at, removed_at FROM nodes
), life AS (
  SELECT project, cid, min(recorded_at) AS first_seen, max(removed_at) AS removed FROM canon WHERE cid IS NOT NULL AND project IS NOT NULL GROUP BY 1, 2
), refs AS (
  SELECT 'edges' AS ref_table, project, CAST(edge_id AS VARCHAR) AS ref_id, 'source' AS field, source AS value, recorded_at AS seen FROM edges
  UNION ALL SELECT 'edges', project, CAST(edge_id AS VARCHAR), 'target', target, recorded_at FROM edges
  UNION ALL SELECT 'layers', project, id, 'node_ids', unnest(node_ids), recorded_at FROM layers
), keyed AS (
  SELECT *, CASE WHEN split_part(value, ':', 1) <> '' AND split_part(value, ':', 1) = split_part(value, ':', 2) AND regexp_matches(value, '^[A-Za-z_]+:[A-Za-z_]+:')
                 THEN substr(value, length(split_part(value, ':', 1)) + 2) ELSE value END AS cid FROM refs WHERE value IS NOT NULL AND value <> ''
), judged AS (
  SELECT k.ref_table, k.project, k.ref_id, k.field, k.value AS missing_id, strftime(k.seen, '%Y-%m') AS period,
         CASE WHEN l.cid IS NULL THEN 'missing' WHEN k.seen < l.first_seen THEN 'late' WHEN k.seen >= l.removed THEN 'deleted' END AS reason
  FROM keyed k LEFT JOIN life l ON l.project = k.project AND l.cid = k.cid
), found AS (SELECT DISTINCT ref_table, project, ref_id, field, missing_id, reason, period FROM judged WHERE reason IS NOT NULL)
"""

ORACLE = {
    "p5_found": _P5 + "SELECT * FROM found",
    "p5_counts": _P5 + "SELECT ref_table, period, reason, count(*) AS n_refs, count(DISTINCT (project, missing_id)) AS n_missing_ids FROM found GROUP BY 1, 2, 3",
}
