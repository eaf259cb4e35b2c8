"""References to records that do not exist: missing, late or deleted parents, per table and period.

Both streams are shuffled by (scope, parent key) into the same partitions and sorted there; the merge join is
one linear pass over the two sorted streams. Parents come in as validity intervals [first seen, removed), one
per key, combined map-side. Keys with very many references are salted (session.salted_join), so no task holds
the references of one hot key.

Defined results
 * Null and empty references are no references. A null scope or time never matches a parent or an interval:
   such a reference is 'missing' when no parent of its scope exists, else it counts as live.
 * Parent rows repeat freely: the interval runs from the earliest time seen to the latest removal.
 * Repeated reference rows count once. Empty tables give no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import salted_join

#: A type prefix written twice.
DOUBLED_PREFIX = r"^([A-Za-z_]+:)\1+"


def canonical_id(column: Column | str) -> Column:
    """A node id with its type prefix written once."""
    return F.regexp_replace(column, DOUBLED_PREFIX, "$1")


def validity(parents: DataFrame, scope: str, key: Column, seen: str, removed: str) -> DataFrame:
    """One interval per (scope, key)."""
    return parents.select(F.col(scope).alias("_scope"), key.alias("_key"), F.col(seen).alias("_s"), F.col(removed).alias("_r")).where(
        F.col("_key").isNotNull() & F.col("_scope").isNotNull()
    ).groupBy("_scope", "_key").agg(F.min("_s").alias("_first"), F.max("_r").alias("_removed"))


def orphans(references: DataFrame, intervals: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """references: (ref_table, scope, ref_id, field, value, key, at) with key the canonical form of value.
    Returns ref_table, scope, ref_id, field, missing_id, reason, period for each reference without a live parent."""
    refs = references.where(F.col("key").isNotNull() & (F.col("value") != "")).select("ref_table", F.col("scope").alias("_scope"), "ref_id", "field", "value", F.col("key").alias("_key"), "at")
    kwargs = {"hot_rows": hot_rows} if hot_rows else {}
    joined = salted_join(refs, intervals.withColumn("_there", F.lit(True)), ["_scope", "_key"], "left", "ref_id", **kwargs)
    reason = (
        F.when(F.col("_there").isNull(), "missing")
        .when(F.col("at") < F.col("_first"), "late")
        .when(F.col("at") >= F.col("_removed"), "deleted")
    )
    return (
        joined.withColumn("reason", reason).where(F.col("reason").isNotNull())
        .select("ref_table", F.col("_scope").alias("scope"), "ref_id", "field", F.col("value").alias("missing_id"), "reason", F.date_format("at", "yyyy-MM").alias("period"))
        .distinct()
    )


def graph_references(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """The node references of the edges and layers tables in the form orphans() takes, in one scan of each."""
    ends = edges.select(
        F.lit("edges").alias("ref_table"), F.col("project").alias("scope"), F.col("edge_id").cast("string").alias("ref_id"),
        F.explode(F.array(F.struct(F.lit("source").alias("field"), F.col("source").alias("value")), F.struct(F.lit("target").alias("field"), F.col("target").alias("value")))).alias("end"),
        F.col("recorded_at").alias("at"),
    ).select("ref_table", "scope", "ref_id", "end.field", "end.value", "at")
    members = layers.select(
        F.lit("layers").alias("ref_table"), F.col("project").alias("scope"), F.col("id").alias("ref_id"),
        F.lit("node_ids").alias("field"), F.explode("node_ids").alias("value"), F.col("recorded_at").alias("at"),
    )
    return ends.unionByName(members).withColumn("key", canonical_id("value"))


def orphan_references(nodes: DataFrame, edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Orphans of the graph tables; the scope is the project."""
    intervals = validity(nodes, "project", canonical_id("id"), "recorded_at", "removed_at")
    return orphans(graph_references(edges, layers), intervals).withColumnRenamed("scope", "project")


def orphan_counts(found: DataFrame) -> DataFrame:
    """Counts per table, month and reason."""
    return found.groupBy("ref_table", "period", "reason").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("project", "missing_id").alias("n_missing_ids"))
