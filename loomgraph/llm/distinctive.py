"""How distinctive a term is of a record: inverse document frequency against its Poisson expectation.

For each (record, term) the record frequency tf is kept; for each term the number of records with it (df) and
its occurrences in all (cf). The observed value is idf = ln(N / df). If occurrences fell on records at random, a
record would hold the term with probability 1 - exp(-cf / N), so the expected value is -ln(1 - exp(-cf / N));
the residual observed - expected is large for terms concentrated in few records. score = tf * residual, and
tf_idf = tf * observed, rounded to 9 decimals.

Records are reduced to their last row first. Counting terms of a record reuses the partitioning of that step, and df
and cf are combined map-side. The FREQUENT most frequent terms come back to the records by a broadcast of bounded
size, so the bulk of the occurrences is never shuffled; only rarer terms are joined by shuffle, and none of those is hot.

Defined results
 * Terms are the maximal runs of Unicode letters and decimal digits of the text, lower-cased; null is empty.
 * A record without terms is a record (it counts in N) but has no rows. Repeats under one key count once: the row
   with the largest order value, then the largest text. Null keys form a key of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.orphans import canonical_id
from ..session import cut
#: So many terms are broadcast with their counts, none of more than LONGEST characters: some ten MB at most.
FREQUENT, LONGEST = 32_768, 256
TERM = r"[\p{L}\p{Nd}]+"


def records(df: DataFrame, keys: list[str], text: Column, order: str) -> DataFrame:
    """keys and text of the last row of each record."""
    last = df.select(*keys, F.struct(F.col(order).alias("o"), text.alias("text")).alias("row")).groupBy(*keys).agg(F.max("row").alias("row"))
    return last.select(*keys, F.col("row.text").alias("text"))


def node_records(nodes: DataFrame) -> DataFrame:
    """project, node_id (prefix written once) and text (label and summary) of the nodes table."""
    text = F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("summary", F.lit("")))
    return records(nodes.withColumn("node_id", canonical_id("id")), ["project", "node_id"], text, "ord")


def term_counts(recs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, tf."""
    terms = recs.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term"))
    return terms.select(*keys, F.lower("term").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def _measure(by: str, n: float) -> Column:
    """The rounded value that ranks: score or tf_idf."""
    idf = F.ln(F.lit(n) / F.col("df"))
    expected = -F.ln(-F.expm1(-F.col("cf") / F.lit(n)))
    return F.round(F.col("tf") * (idf - expected if by == "score" else idf), 9)


def _measured(df: DataFrame, keys: list[str], n: float) -> DataFrame:
    idf = F.ln(F.lit(n) / F.col("df"))
    expected = -F.ln(-F.expm1(-F.col("cf") / F.lit(n)))
    return df.select(
        *keys, "term", "tf", "df", "cf", F.round(idf, 9).alias("idf"), F.round(expected, 9).alias("expected"), F.round(idf - expected, 9).alias("residual"),
        _measure("score", n).alias("score"), _measure("tf_idf", n).alias("tf_idf"),
    )


def _split(recs: DataFrame, keys: list[str], least_df: int) -> tuple[DataFrame, DataFrame, float]:
    """(keys, term, tf with df and cf where the term is frequent, else null; stats of every term; number of records)."""
    n = float(recs.select(*keys).count())  # one number
    tf = term_counts(recs, keys)
    stats = cut(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))
    often = stats.where(F.length("term") <= LONGEST).orderBy(F.desc("df"), "term").limit(FREQUENT)
    return tf.join(F.broadcast(often), "term", "left").where(F.col("df").isNull() | (F.col("df") >= least_df)), stats.where(F.col("df") >= least_df), n


def _looked_up(met: DataFrame, stats: DataFrame) -> DataFrame:
    """met with the counts of the terms that have none yet; the other rows go through the join as they are, spread by
    hash, so that what comes before it is done once."""
    at = F.when(F.col("df").isNull(), F.xxhash64("term")).otherwise(F.xxhash64(*[c for c in met.columns if c not in ("term", "tf", "df", "cf")]))
    held = stats.select(F.xxhash64("term").alias("_h"), "term", F.col("df").alias("_df"), F.col("cf").alias("_cf"))
    found = met.withColumn("_h", at).join(held.hint("merge"), ["_h", "term"], "left")
    return found.withColumns({"df": F.coalesce("df", "_df"), "cf": F.coalesce("cf", "_cf")}).where(F.col("df").isNotNull())


def scores(recs: DataFrame, keys: list[str], least_df: int = 1) -> DataFrame:
    """keys, term, tf, df, cf, idf, expected, residual, score, tf_idf of every term of every record."""
    met, stats, n = _split(recs, keys, least_df)
    return _measured(_looked_up(met, stats), keys, n)


def top_terms(scored: DataFrame, keys: list[str], by: str, k: int = 3) -> DataFrame:
    """The k terms of each record with the highest value; ties go to the smaller term."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by), F.asc("term"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def characteristic(recs: DataFrame, keys: list[str], by: str, k: int = 3, least_df: int = 1) -> DataFrame:
    """top_terms() of scores() for score or tf_idf. Of the frequent terms a record's k best are chosen where the record
    lies; only those and the terms still to be looked up are shuffled."""
    met, stats, n = _split(recs, keys, least_df)
    here = met.withColumn("_open", F.col("df").isNull())
    local = Window.partitionBy(*keys).orderBy("_open", F.desc(_measure(by, n)), F.asc("term"))
    kept = here.withColumn("_at", F.row_number().over(local)).where(F.col("_open") | (F.col("_at") <= k)).drop("_at", "_open")
    return top_terms(_measured(_looked_up(kept, stats), keys, n), keys, by, k)
