"""Ranked search over nodes and documents: keywords, term vectors, stored vectors, edit distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cosine
from ..session import cut

#: No more queries than this are broadcast at once.
QUERY_BLOCK = 10_000
# Words left out of the vocabulary.
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with", "is", "are", "was", "be", "by", "at", "as", "it", "this", "that", "from")
WORD = r"[a-z0-9]+"


def _tokens(text: str) -> list[str]:
    return [t for t in text.lower().split() if t]


def _matches(column: Column, tokens: list[str]) -> Column:
    return sum((column.contains(t).cast("int") for t in tokens), F.lit(0))


def keyword_search(nodes: DataFrame, text: str, limit: int = 10, node_types: list[str] | None = None) -> DataFrame:
    """project, id, label and score of the best nodes: 5 exact label, 4 label holds the phrase, 3 id or summary
    does, 1 + share of words in the label, 0.5 + share in the id, 0.5 a word in the summary; then by risk, then order."""
    q, tokens = text.lower(), _tokens(text)
    i, label, summary = F.lower("id"), F.lower(F.coalesce("label", F.lit(""))), F.lower(F.coalesce("summary", F.lit("")))
    in_label, in_id, in_summary = (_matches(c, tokens) for c in (label, i, summary))
    n = float(max(len(tokens), 1))
    score = (
        F.when(label == q, 5.0).when(label.contains(q), 4.0).when(i.contains(q) | summary.contains(q), 3.0).when(in_label > 0, 1 + in_label / n)
        .when(in_id > 0, 0.5 + in_id / n).when(in_summary > 0, 0.5)
    )
    return _ranked(nodes, score, limit, node_types)


def question_search(nodes: DataFrame, text: str, limit: int = 20, node_types: list[str] | None = None) -> DataFrame:
    """The command-line ranking: 4 exact label, 3 label holds the phrase, 2.5 all words in the label, 2 some, 1 summary."""
    q, tokens = text.lower(), _tokens(text)
    label, summary = F.lower(F.coalesce("label", F.lit(""))), F.lower(F.coalesce("summary", F.lit("")))
    in_label, in_summary = _matches(label, tokens), _matches(summary, tokens)
    score = (
        F.when(label == q, 4.0).when(label.contains(q), 3.0).when((in_label == len(tokens)) & F.lit(bool(tokens)), 2.5).when(in_label > 0, 2.0)
        .when(summary.contains(q) | (in_summary > 0), 1.0)
    )
    return _ranked(nodes, score, limit, node_types)


def _ranked(nodes: DataFrame, score: Column, limit: int, node_types: list[str] | None) -> DataFrame:
    v = nodes if not node_types else nodes.where(F.col("node_type").isin(*node_types))
    hits = v.withColumn("score", score).where("score is not null")
    limit = max(1, min(limit, 1000))
    return hits.orderBy(F.desc("score"), F.desc(F.coalesce("risk_score", F.lit(0.0))), "ord").limit(limit).select("project", "id", "label", F.round("score", 6).alias("score"))


def substring_search(nodes: DataFrame, text: str, limit: int = 10) -> DataFrame:
    q = text.lower()
    return nodes.where(F.lower("label").contains(q) | F.lower("summary").contains(q)).orderBy("ord").limit(limit)


def words(df: DataFrame, key: list[str], text: Column) -> DataFrame:
    """key, word: the words of two letters or more that are no stop words."""
    return df.select(*key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word")).where((F.length("word") >= 2) & ~F.col("word").isin(*STOP_WORDS))


def vocabulary(terms: DataFrame, size: int = 500) -> DataFrame:
    """The most frequent words and their counts; ties go to the smaller word."""
    return terms.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(size)


def term_search(df: DataFrame, key: list[str], text: Column, query: str, limit: int = 10, threshold: float = 0.3, size: int = 500) -> DataFrame:
    """key, score: cosine of term frequencies over the vocabulary. Sparse: only the words of the query are joined; the
    length of each text's vector comes from one aggregation."""
    spark = df.sparkSession
    terms = words(df, key, text)
    known = vocabulary(terms, size)  # a fixed number of words
    counts = terms.join(F.broadcast(known.select("word")), "word").groupBy(*key, "word").agg(F.count(F.lit(1)).alias("tf"))
    import re

    asked: dict[str, int] = {}
    for w in re.findall(WORD, query.lower()):
        if len(w) >= 2 and w not in STOP_WORDS:
            asked[w] = asked.get(w, 0) + 1
    q = spark.createDataFrame(list(asked.items()), "word string, qf long").join(known.select("word"), "word")
    length = q.agg(F.sqrt(F.sum(F.col("qf") * F.col("qf")))).first()[0] or 0.0
    hit = counts.join(F.broadcast(q), "word", "left").groupBy(*key).agg(F.sum(F.col("tf") * F.coalesce("qf", F.lit(0))).alias("dot"), F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    score = F.col("dot") / (F.col("norm") * F.lit(length or 1.0))
    return hit.where("dot > 0").select(*key, F.round(score, 6).alias("score")).where(F.col("score") >= threshold).orderBy(F.desc("score"), *key).limit(limit)


def vector_search(vectors: DataFrame, key: str, vector: str, queries: DataFrame, limit: int = 10, threshold: float = 0.25) -> DataFrame:
    """query, key, score: the best vectors for each query (query, q_vector). The queries are a stated set and go to every
    block of vectors; each block keeps its best ``limit`` before the shuffle. More than QUERY_BLOCK queries are split by
    hash, and the results of a block are written before the next block is sent, so that only one is held at a time."""
    asked = queries.count()
    if asked > QUERY_BLOCK:
        n = -(-asked // (QUERY_BLOCK // 2))  # half full on average: a hash doesn't fill all blocks alike
        blocks = [queries.where(F.pmod(F.xxhash64("query"), F.lit(n)) == i) for i in range(n)]
        return reduce(DataFrame.unionByName, [cut(_best(vectors, key, vector, b, limit, threshold)) for b in blocks])
    return _best(vectors, key, vector, queries, limit, threshold)


def _best(vectors: DataFrame, key: str, vector: str, queries: DataFrame, limit: int, threshold: float) -> DataFrame:
    from pyspark.sql import Window

    pairs = vectors.select(key, vector).join(F.broadcast(queries), F.lit(True))
    scored = pairs.select("query", key, F.round(cosine(vector, "q_vector"), 6).alias("score")).where(F.col("score") >= threshold)
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return scored.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)


def fuzzy_search(nodes: DataFrame, text: str, limit: int = 10, threshold: float = 0.35) -> DataFrame:
    """project, id, score (0 is best): weighted edit distance to label 0.4, name 0.3, summary 0.2 and tags 0.1, each the
    best over the field's words; an approximation of bit-parallel fuzzy matching."""
    q = text.lower()

    def field(column: Column) -> Column:
        pieces = F.concat(F.array_compact(F.array(F.lower(column))), F.split(F.coalesce(F.lower(column), F.lit("")), r"[^a-z0-9]+"))
        best = F.array_min(F.transform(pieces, lambda w: F.when(w == "", 1.0).when(w.contains(q), 0.0).otherwise(F.levenshtein(w, F.lit(q)) / F.greatest(F.length(w), F.lit(len(q))))))
        return F.coalesce(best, F.lit(1.0))

    tags = field(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    weighted = [(field(F.col("label")), 0.4), (field(F.coalesce("node_name", F.lit("")) if "node_name" in nodes.columns else F.lit("")), 0.3), (field(F.coalesce("summary", F.lit(""))), 0.2), (tags, 0.1)]
    score = F.least(*[c + (0.4 - w) * 0.25 for c, w in weighted])
    return nodes.select("project", "id", F.round(score, 6).alias("score")).where(F.col("score") <= threshold).orderBy("score", "project", "id").limit(limit)
