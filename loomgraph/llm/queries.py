"""Queries of the problems on names, code and text, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import distinctive, language, mixing, names, neardup, packing, secrets, tokens


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(names.attach(names.spellings(table(spark, d, "commits"), table(spark, d, "file_git"))))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with its use count and canonical form."""
    return names.attach(names.spellings(table(spark, d, "commits"), table(spark, d, "file_git")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.findings(table(spark, d, "source_files")).select("file_id", "line")


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All files with credentials masked."""
    return secrets.redacted(table(spark, d, "source_files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = neardup.pairs(*neardup.near_duplicates(table(spark, d, "functions"), "fn_id", "body"))
    return found.select(F.col("id_a").alias("fn_id_a"), F.col("id_b").alias("fn_id_b"))


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every function with a body: its class of copies and the number of links of its representative."""
    links, members, _ = neardup.near_duplicates(table(spark, d, "functions"), "fn_id", "body")
    return neardup.classes(links, members).withColumnRenamed("id", "fn_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["project", "node_id"]
    return distinctive.characteristic(distinctive.node_records(table(spark, d, "nodes")), keys, "tf_idf", least_df=2).select(*keys, "term")


def p4_residual(spark: SparkSession, d: str) -> DataFrame:
    """The three terms of each node with the highest residual score."""
    keys = ["project", "node_id"]
    top = distinctive.characteristic(distinctive.node_records(table(spark, d, "nodes")), keys, "score", least_df=2)
    return top.select(*keys, "rank", "term", "tf", "df", "cf", F.round("score", 6).alias("score"))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of an oversized one, with its container of each kind."""
    sized = tokens.token_counts(table(spark, d, "documents"), "doc_id")
    return packing.pack(sized, table(spark, d, "pack_limits"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p8_packing(spark, d), table(spark, d, "pack_limits"))


def _mix(spark: SparkSession, d: str):
    sized = tokens.token_counts(table(spark, d, "documents"), "doc_id", keep=("source",))
    prepared = mixing.prepare(sized)
    planned = mixing.budgets(prepared, table(spark, d, "mix_targets"))
    return mixing.select(prepared, planned), planned


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    """Every document of each recipe's selection and how often it is used."""
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source of each recipe."""
    return mixing.report(*_mix(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.to_correct(language.identify(table(spark, d, "documents"))).select("doc_id", "seg_no", "lang")


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """All single-language stretches of all documents with their confidence."""
    return language.identify(table(spark, d, "documents")).withColumn("confidence", F.round("confidence", 4))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_canonical, p3_found, p3_redacted, p4_found, p4_residual, p7_found, p7_classes, p8_packing, p8_report, p9_selection, p9_shares, p10_found, p10_segments)
}

_TERMS = r"""
WITH canon AS (
  SELECT project, CASE WHEN regexp_matches(id, '^[A-Za-z_]+:[A-Za-z_]+:') AND split_part(id, ':', 1) = split_part(id, ':', 2)
                       THEN substr(id, length(split_part(id, ':', 1)) + 2) ELSE id END AS node_id, ord, coalesce(label, '') || ' ' || coalesce(summary, '') AS body FROM nodes
), latest AS (
  SELECT project, node_id, body FROM canon QUALIFY row_number() OVER (PARTITION BY project, node_id ORDER BY ord DESC NULLS LAST, body DESC) = 1
), tf AS (
  SELECT project, node_id, lower(t) AS term, count(*) AS tf FROM (SELECT project, node_id, unnest(regexp_extract_all(body, '[\p{L}\p{Nd}]+')) AS t FROM latest) GROUP BY 1, 2, 3
), stats AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1 HAVING count(*) >= 2),
size AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM latest),
scored AS (
  SELECT project, node_id, term, tf, df, CAST(cf AS BIGINT) AS cf, round(tf * ln(n / df), 9) AS tf_idf,
         round(tf * (ln(n / df) + ln(1 - exp(-cf / n))), 9) AS score FROM tf JOIN stats USING (term), size
)
""".replace("\\\\", "\\")

ORACLE: dict[str, str] = {
    "p4_found": _TERMS + "SELECT project, node_id, term FROM scored QUALIFY row_number() OVER (PARTITION BY project, node_id ORDER BY tf_idf DESC, term) <= 3",
    "p4_residual": _TERMS
    + "SELECT project, node_id, CAST(rank AS INTEGER) AS rank, term, tf, df, cf, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY project, node_id ORDER BY score DESC, term) AS rank FROM scored) WHERE rank <= 3",
}
