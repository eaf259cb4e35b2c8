"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Every document gets a random key from the hash of its id. A range sort by (source, key) and distributed prefix
sums give each document the tokens before it in its source's random order. For a recipe, the largest total all
sources can serve under their repeat caps fixes each source's token budget; whole passes over a source are
epochs, and the last pass is cut where the budget ends. All recipes share one order, so a cut is a filter.

Defined results
 * Shares are taken in proportion to their sum over the sources that hold tokens; a source without documents is
   reported with a reached share of 0. A recipe none of whose sources holds tokens selects nothing.
 * Null or negative shares count as 0, null or negative repeat caps as 0; a (recipe, source) given twice has its
   shares added and the smaller cap. ``total_tokens`` asks for a smaller total than the largest.
 * A document is taken in the last pass when at least half of it lies within the budget, so a source is off by at
   most half a document. Documents without tokens (null or empty texts) are never taken. Null sources match none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import prefix_sums
from ..session import cut

SEED = 11


def prepare(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, n_tokens and _before, the tokens before the document in its source's random order."""
    keyed = sized.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long"), "source", F.col("n_tokens").cast("long"), F.xxhash64(F.lit(seed), "doc_id").alias("key")
    )
    # the range sort reads its input twice, to sample and to sort: the tokens are counted once, before it
    return cut(prefix_sums(cut(keyed), "source", ["key", "doc_id"], "n_tokens").select("doc_id", "source", "n_tokens", "_before"))


def budgets(prepared: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row for each (recipe, source) of the targets: target_share, max_repeats, source_tokens, budget."""
    sizes = prepared.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    wanted = targets.where(F.col("recipe").isNotNull() & F.col("source").isNotNull()).groupBy("recipe", "source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats")
    )
    known = wanted.join(sizes, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    counts = (F.col("source_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    share = F.when(counts, F.col("target_share"))
    most = known.groupBy("recipe").agg(
        F.sum(share).alias("shares"), F.min(F.when(counts, F.col("source_tokens") * F.col("max_repeats") / F.col("target_share"))).alias("most")
    )
    total = F.col("most") * F.col("shares")  # the total whose parts are most * share
    if total_tokens is not None:
        total = F.least(total, F.lit(float(total_tokens)))
    budget = F.when(counts, F.floor(total * F.col("target_share") / F.col("shares") + 1e-6)).otherwise(0)
    return known.join(most, "recipe").select("recipe", "source", "target_share", "max_repeats", "source_tokens", budget.cast("long").alias("budget"))


def select(prepared: DataFrame, planned: DataFrame) -> DataFrame:
    """recipe, source, doc_id, n_tokens, repeats: how often each document of the selection is used. planned is the
    small table of budgets(): one row for each target."""
    epochs = F.expr("budget div source_tokens")
    rest = F.col("budget") - epochs * F.col("source_tokens")
    repeats = epochs + (2 * F.col("_before") + F.col("n_tokens") <= 2 * rest).cast("long")
    return (
        prepared.join(planned.where("budget > 0"), "source")
        .select("recipe", "source", "doc_id", "n_tokens", F.least(repeats, F.col("max_repeats").cast("long")).alias("repeats")).where("repeats > 0")
    )


def report(selection: DataFrame, planned: DataFrame) -> DataFrame:
    """Each target with the tokens taken, the share of the recipe's total reached, and the most repeats used."""
    taken = selection.groupBy("recipe", "source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats")
    )
    joined = planned.join(taken, ["recipe", "source"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("tokens", "n_docs", "most_repeats")})
    totals = joined.groupBy("recipe").agg(F.sum("tokens").alias("all_tokens"))
    return joined.join(totals, "recipe").select(
        "recipe", "source", "target_share", "max_repeats", "tokens", "n_docs", "most_repeats",
        F.round(F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0), 6).alias("reached_share"),
    )
