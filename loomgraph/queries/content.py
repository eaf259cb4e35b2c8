"""Queries over source text, search, history, streams, merging and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import extract, graph, history, merge, search, traversal
from ..sources import files as tree
from ..session import cut, table
from ..streaming import changes
from .graph import _CANON, GRAPH_SQL, load, load_edges, load_nodes

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def sources(spark: SparkSession, d: str) -> DataFrame:
    """The source files once each."""
    return table(spark, d, "source_files").select("file_id", "project", "path", "lang_name", "content", "size_lines").where("content is not null").dropDuplicates(["file_id"])


_SOURCES = "WITH S AS (SELECT DISTINCT file_id, project, path, lang_name, content, size_lines FROM source_files WHERE content IS NOT NULL)"


@query(_SOURCES + """, x AS (
  SELECT project, path, 'python' AS language, unnest(list_concat(regexp_extract_all(content, '(?m)^from\\s+(\\.+[\\w.]*|[\\w][\\w.]*)\\s+import\\s+', 1),
    list_filter(list_transform(flatten(list_transform(regexp_extract_all(content, '(?m)^import\\s+([\\w][\\w., \\t]*)', 1), lambda y: string_split(y, ','))), lambda p: regexp_split_to_array(trim(p), '\\s+')[1]), lambda p: p <> ''))) AS raw FROM S WHERE lower(lang_name) = 'python'
  UNION ALL SELECT project, path, lower(lang_name), unnest(list_concat(list_concat(regexp_extract_all(content, '(?:import|require)\\s*(?:type\\s+)?(?:\\{[^}]*\\}|[\\w*$]+(?:\\s*,\\s*(?:\\{[^}]*\\}|[\\w*$]+))?)?\\s*from\\s*[''\"]([^''\"]+)[''\"]', 1),
    regexp_extract_all(content, 'import\\s*\\(\\s*[''\"]([^''\"]+)[''\"]\\s*\\)', 1)), regexp_extract_all(content, '\\brequire\\s*\\(\\s*[''\"]([^''\"]+)[''\"]\\s*\\)', 1))) FROM S WHERE lower(lang_name) IN ('typescript', 'javascript')
  UNION ALL SELECT project, path, 'java', unnest(regexp_extract_all(content, '(?m)^\\s*import\\s+(?:static\\s+)?([\\w.]+)(?:\\.\\*)?;?', 1)) FROM S WHERE lower(lang_name) IN ('java', 'kotlin')
) SELECT DISTINCT project, path, language, raw FROM x""")
def source_imports(spark, d):
    """Imports of the files whose language the table names, in the languages with imports in it."""
    found = extract.imports(sources(spark, d).where("lang_name is not null"))
    return found.where(F.col("language").isin("python", "typescript", "javascript", "java", "kotlin"))


@query()
def all_imports(spark, d):
    """Imports of all files, their language by name or else by extension. Without SQL: that of source_imports asks for the
    files whose language the table names."""
    return extract.imports(sources(spark, d))


@query()
def import_edges(spark, d):
    """Imports that lead to files of the project, as edges."""
    files = sources(spark, d)
    return extract.import_edges(extract.import_targets(extract.imports(files), files))


@query()
def skeleton_edges(spark, d):
    """The build from text alone: contains, imports and calls edges of all source files."""
    from ..plans.build import skeleton

    return skeleton(sources(spark, d))[1].select("project", "source", "target", "edge_type", "weight")


@query()
def source_symbols(spark, d):
    files = sources(spark, d)
    return extract.symbol_ends(extract.symbols(files), files)


@query(_SOURCES + """, l AS (SELECT project, path, lower(lang_name) AS lang, unnest(string_split(content, chr(10))) AS line FROM S)
SELECT project, path, regexp_extract(line, '^\\s*(?:async\\s+)?def\\s+(\\w+)\\s*\\(', 1) AS name, count(*) AS n FROM l WHERE lang = 'python' AND regexp_matches(line, '^\\s*(?:async\\s+)?def\\s+(\\w+)\\s*\\(') GROUP BY 1, 2, 3""")
def python_functions(spark, d):
    found = extract.symbols(sources(spark, d).where("lower(lang_name) = 'python'")).where("kind = 'function'")
    return found.groupBy("project", "path", "name").agg(F.count(F.lit(1)).alias("n"))


_STRIP = "body"
for _p, _to in (("//[^\\n]*", ""), ("/\\*[\\s\\S]*?\\*/", ""), ("`(?:\\\\.|[^`\\\\])*`", "``"), ("''(?:\\\\.|[^''\\\\])*''", "''''"), ('"(?:\\\\.|[^"\\\\])*"', '""')):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', '{_to}', 'g')"


@query(f"""WITH f AS (SELECT DISTINCT fn_id, body FROM functions WHERE body IS NOT NULL), x AS (SELECT fn_id, unnest(regexp_extract_all({_STRIP}, '(?:\\.\\s*)?\\b([A-Za-z_$][\\w$]*)\\s*\\(', 1)) AS callee FROM f)
SELECT fn_id, callee, count(*) AS n FROM x WHERE callee NOT IN ({", ".join(repr(x) for x in extract.NO_CALLS)}) GROUP BY 1, 2""")
def call_sites(spark, d):
    functions = table(spark, d, "functions").select("fn_id", "body").where("body is not null").dropDuplicates(["fn_id"])
    return extract.call_sites(functions)


@query()
def design_patterns(spark, d):
    return extract.design_patterns(sources(spark, d))


@query()
def language_lessons(spark, d):
    return extract.language_lessons(sources(spark, d))


def _rule_sql() -> str:
    """The security rules without lookahead, as (rule, condition on a line)."""
    out = []
    for i, (_, _, p, _) in enumerate(extract.SECURITY_RULES):
        if "innerHTML" in p or "outerHTML" in p:
            p = p.split(r"\s*(?!")[0] + r"([^'\"`]|$)"
        tail = ""
        if "yaml" in p:
            p = p.split("(?!")[0]
            tail = " AND NOT regexp_matches(line, '(?i)" + p.replace("'", "''") + r"\s*,\s*Loader')"
        out.append(f"SELECT file_id, {i} AS rule, min(line_no) AS line FROM l WHERE regexp_matches(line, '(?i){p.replace(chr(39), chr(39) * 2)}'){tail} GROUP BY 1")
    return " UNION ALL ".join(out)


_SCAN = _SOURCES + """, n AS (SELECT file_id, string_split(content, chr(10)) AS ls FROM S), k AS (SELECT file_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM n),
l AS (SELECT file_id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(line, '\\r$', '') AS line FROM k WHERE NOT regexp_matches(ltrim(line), '^(//|#|\\*)')), hits AS (""" + _rule_sql() + ")"


@query(_SCAN + " SELECT file_id, CAST(rule AS INTEGER) AS rule, line FROM hits")
def security_scan(spark, d):
    """The first line each of the twenty security rules matches in each file."""
    return extract.security_findings(sources(spark, d)).select("file_id", "rule", "line")


@query(_SCAN + ", c AS (SELECT CASE rule " + " ".join(f"WHEN {i} THEN '{r[1]}'" for i, r in enumerate(extract.SECURITY_RULES)) + " END AS severity, CASE rule " + " ".join(f"WHEN {i} THEN '{r[0]}'" for i, r in enumerate(extract.SECURITY_RULES)) + " END AS category FROM hits) SELECT severity, category, count(*) AS n FROM c GROUP BY GROUPING SETS ((), (severity), (category))")
def security_summary(spark, d):
    return extract.security_summary(extract.security_findings(sources(spark, d)))


@query(_SOURCES + """ SELECT project, list_sort(list_distinct(list(lang_name))) AS languages, count(*) AS n_files, CAST(sum(size_lines) AS BIGINT) AS n_lines, CASE WHEN count(*) < 50 THEN 'small' WHEN count(*) < 200 THEN 'medium' ELSE 'large' END AS size_class FROM S GROUP BY 1""")
def scan_summary(spark, d):
    return tree.scan_summary(sources(spark, d))


def _language_sql() -> str:
    from ..model import LANGUAGE_BY_EXTENSION

    return "CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in LANGUAGE_BY_EXTENSION.items()) + " ELSE 'unknown' END"


@query(_SOURCES + f", x AS (SELECT file_id, {_language_sql()} AS language, size_lines FROM S) SELECT file_id, language, CASE WHEN language IN ('typescript', 'javascript', 'python', 'go', 'rust', 'java', 'kotlin', 'ruby', 'php', 'c', 'cpp', 'csharp', 'swift', 'bash') THEN 'source' WHEN language IN ('json', 'yaml', 'toml') THEN 'config' WHEN language IN ('markdown', 'html') THEN 'document' ELSE 'other' END AS category, CASE WHEN size_lines < 50 THEN 'simple' WHEN size_lines < 200 THEN 'moderate' WHEN size_lines IS NOT NULL THEN 'complex' END AS complexity FROM x")
def file_classes(spark, d):
    """Language by extension, category and complexity of every source file."""
    return sources(spark, d).withColumn("language", P.language_of("path")).select("file_id", "language", P.file_category(F.col("language")).alias("category"), P.file_complexity("size_lines").alias("complexity"))


@query("WITH f AS (SELECT DISTINCT fn_id, body FROM functions WHERE body IS NOT NULL) SELECT fn_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '//[^\\n]*', '', 'g'), '/\\*[\\s\\S]*?\\*/', '', 'g'), '\"[^\"]*\"', '\"S\"', 'g'), '''[^'']*''', '''S''', 'g'), '`[^`]*`', '`S`', 'g'), '\\b\\d+(\\.\\d+)?\\b', 'N', 'g'), '\\s+', ' ', 'g'))) AS skeleton FROM f")
def code_skeletons(spark, d):
    """A hash of each function without comments, literals and layout."""
    f = table(spark, d, "functions").select("fn_id", "body").where("body is not null").dropDuplicates(["fn_id"])
    return f.select("fn_id", F.md5(T.code_skeleton("body")).alias("skeleton"))


@query()
def fingerprint_changes(spark, d):
    """Change classes between the files and themselves with comments taken out of every other text."""
    files = sources(spark, d)
    even = F.pmod(F.xxhash64("path"), F.lit(2)) == 0
    edited = files.withColumn("content", F.when(even, F.regexp_replace("content", r"(?m)^\s*(//|#).*$", "")).otherwise(F.col("content")))
    change = extract.classify_changes(extract.fingerprints(files), extract.fingerprints(edited))
    return change.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


_WORDS_SQL = f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{search.WORD}')) AS word FROM documents), w AS (SELECT * FROM t WHERE length(word) >= 2 AND word NOT IN ({", ".join(repr(x) for x in search.STOP_WORDS)})),
v AS (SELECT word, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, word LIMIT 500)"""


@query(_WORDS_SQL + " SELECT word, n FROM v")
def vocabulary_top500(spark, d):
    return search.vocabulary(search.words(table(spark, d, "documents"), ["doc_id"], F.col("text")))


_QUESTION = "scheduler drops pending tasks after merge"


@query(_WORDS_SQL + f""", q AS (SELECT word, count(*) AS qf FROM (SELECT unnest(regexp_extract_all(lower('{_QUESTION}'), '{search.WORD}')) AS word) WHERE length(word) >= 2 AND word NOT IN ({", ".join(repr(x) for x in search.STOP_WORDS)}) AND word IN (SELECT word FROM v) GROUP BY 1),
c AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word IN (SELECT word FROM v) GROUP BY 1, 2), h AS (SELECT doc_id, sum(tf * coalesce(qf, 0)) AS dot, sqrt(sum(tf * tf)) AS norm FROM c LEFT JOIN q USING (word) GROUP BY 1)
SELECT doc_id, round(dot / (norm * (SELECT sqrt(sum(qf * qf)) FROM q)), 6) AS score FROM h WHERE dot > 0 AND round(dot / (norm * (SELECT sqrt(sum(qf * qf)) FROM q)), 6) >= 0.3 ORDER BY score DESC, doc_id LIMIT 10""")
def term_search(spark, d):
    return search.term_search(table(spark, d, "documents"), ["doc_id"], F.col("text"), _QUESTION)


_PHRASE = "merge timer"


def _count_sql(column: str) -> str:
    return " + ".join(f"CAST(contains({column}, '{t}') AS INTEGER)" for t in _PHRASE.split())


@query(GRAPH_SQL + f""", s AS (SELECT project, id, label, risk_score, ord, lower(id) AS i, lower(coalesce(label, '')) AS l, lower(coalesce(summary, '')) AS m FROM V),
k AS (SELECT *, CASE WHEN l = '{_PHRASE}' THEN 5.0 WHEN contains(l, '{_PHRASE}') THEN 4.0 WHEN contains(i, '{_PHRASE}') OR contains(m, '{_PHRASE}') THEN 3.0 WHEN {_count_sql('l')} > 0 THEN 1 + ({_count_sql('l')}) / 2.0 WHEN {_count_sql('i')} > 0 THEN 0.5 + ({_count_sql('i')}) / 2.0 WHEN {_count_sql('m')} > 0 THEN 0.5 END AS score FROM s)
SELECT project, id, label, CAST(score AS DOUBLE) AS score FROM k WHERE score IS NOT NULL ORDER BY score DESC, coalesce(risk_score, 0) DESC, ord LIMIT 10""")
def keyword_search(spark, d):
    return search.keyword_search(load_nodes(spark, d), _PHRASE)


@query(GRAPH_SQL + f""", s AS (SELECT project, id, label, risk_score, ord, lower(coalesce(label, '')) AS l, lower(coalesce(summary, '')) AS m FROM V),
k AS (SELECT *, CASE WHEN l = '{_PHRASE}' THEN 4.0 WHEN contains(l, '{_PHRASE}') THEN 3.0 WHEN {_count_sql('l')} = 2 THEN 2.5 WHEN {_count_sql('l')} > 0 THEN 2.0 WHEN contains(m, '{_PHRASE}') OR {_count_sql('m')} > 0 THEN 1.0 END AS score FROM s)
SELECT project, id, label, CAST(score AS DOUBLE) AS score FROM k WHERE score IS NOT NULL ORDER BY score DESC, coalesce(risk_score, 0) DESC, ord LIMIT 20""")
def cli_search(spark, d):
    return search.question_search(load_nodes(spark, d), _PHRASE)


@query()
def fuzzy_search(spark, d):
    return search.fuzzy_search(load_nodes(spark, d), "janitr")


@query("""WITH q AS (SELECT vec_id AS query, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id, round(coalesce(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 0), 6) AS score FROM q, embeddings)
SELECT query, vec_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS pos FROM s WHERE score >= 0.25 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 10""")
def embedding_search(spark, d):
    """The ten nearest vectors of every vector whose id is divisible by 50."""
    v = table(spark, d, "embeddings")
    queries = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q_vector"))
    return search.vector_search(v, "vec_id", "embedding", queries)


@query()
def label_similarity(spark, d):
    """Common-subsequence similarity of the label and the name of every node that has both."""
    v = load_nodes(spark, d).join(table(spark, d, "nodes").select("project", graph.canonical_id("id").alias("id"), "node_name").dropDuplicates(["project", "id"]), ["project", "id"])
    return v.where("label is not null and node_name is not null").select("project", "id", F.round(T.lcs_similarity("label", "node_name"), 6).alias("similarity"))


_COMMITS = """WITH C AS (SELECT DISTINCT commit_id, project, file, sha, commit_date, message, author FROM commits),
K AS (SELECT *, CASE WHEN regexp_matches(commit_date, '[+-][0-9]{2}:?[0-9]{2}$') THEN CAST(regexp_replace(replace(commit_date, 'T', ' '), ' ?([+-][0-9]{2}):?([0-9]{2})$', '\\1:\\2') AS TIMESTAMPTZ) AT TIME ZONE 'UTC'
  ELSE TRY_CAST(replace(replace(commit_date, 'T', ' '), 'Z', '') AS TIMESTAMP) END AS moment FROM C)"""


@query(_COMMITS + " SELECT commit_id, strftime(moment, '%Y-%m-%d %H:%M:%S') AS \"at\" FROM K")
def commit_times(spark, d):
    return history.commit_times(table(spark, d, "commits")).select("commit_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(_COMMITS + " SELECT project, file, author, count(*) AS n, CAST(row_number() OVER (PARTITION BY project, file ORDER BY count(*) DESC, author) AS INTEGER) AS pos FROM C WHERE author <> '' GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY project, file ORDER BY count(*) DESC, author) <= 3")
def author_frequency(spark, d):
    return history.author_frequency(history.commit_times(table(spark, d, "commits")))


@query(_COMMITS + " SELECT project, file, count(*) AS n FROM K WHERE moment >= (SELECT max(moment) FROM K) - INTERVAL 90 DAY GROUP BY 1, 2")
def change_frequency_90d(spark, d):
    c = history.commit_times(table(spark, d, "commits"))
    return history.churn(c, 90, c.agg(F.max("at")).first()[0])


@query(_COMMITS + " SELECT project, file, sha, strftime(moment, '%Y-%m-%d %H:%M:%S') AS \"at\" FROM K WHERE moment IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project, file ORDER BY moment DESC, commit_id DESC) = 1")
def latest_change(spark, d):
    return history.latest_commit(history.commit_times(table(spark, d, "commits"))).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query(_COMMITS + " SELECT project, file, commit_id, CAST(length(coalesce(message, '')) AS INTEGER) AS size, CAST(row_number() OVER w AS INTEGER) AS pos FROM C QUALIFY row_number() OVER (PARTITION BY project, file ORDER BY length(coalesce(message, '')) DESC, commit_id) <= 5".replace("row_number() OVER w", "row_number() OVER (PARTITION BY project, file ORDER BY length(coalesce(message, '')) DESC, commit_id)"))
def largest_commits(spark, d):
    return history.largest_commits(history.commit_times(table(spark, d, "commits")))


@query(_COMMITS + ", x AS (SELECT project, file, commit_id, unnest(list_distinct(regexp_extract_all(message, '#\\d+'))) AS reference FROM C) SELECT project, file, reference, count(*) AS n FROM x GROUP BY 1, 2, 3")
def pr_references(spark, d):
    return history.pr_references(history.commit_times(table(spark, d, "commits")))


@query()
def decision_context(spark, d):
    """Authors, churn and references of every file with commits."""
    c = history.commit_times(table(spark, d, "commits"))
    found = history.decision_context(c, c.agg(F.max("at")).first()[0])
    none = F.array().cast("array<string>")
    return found.select("project", "file", F.size("commits").alias("n_commits"), F.array_join(F.coalesce("primary_authors", none), "|").alias("primary_authors"), "change_frequency", F.size(F.coalesce("pr_references", none)).alias("n_references"))


@query("""WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 30 MINUTE OR ts = before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n_events, list_sort(list_distinct(list(event_type))) AS items FROM g GROUP BY user_id, burst""")
def debounce_sessions(spark, d):
    """Bursts of each user's events, thirty quiet minutes apart."""
    return changes.debounce(table(spark, d, "events"), "30 minutes", None, "user_id", "event_type")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def tumbling_counts(spark, d):
    return changes.windowed_counts(table(spark, d, "events"), "event_type")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS start, event_type FROM events, range(4) r(k)) SELECT start, start + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n FROM w GROUP BY 1, 2, 3""")
def sliding_counts(spark, d):
    return changes.windowed_counts(table(spark, d, "events"), "event_type", width="1 hour", slide="15 minutes")


@query("""WITH a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, n, errors, n - lag(n) OVER (ORDER BY day) AS change FROM a""")
def history_trend(spark, d):
    """Daily snapshots of the events with the change from the day before."""
    from pyspark.sql import Window

    a = table(spark, d, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return a.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "n", "errors", (F.col("n") - F.lag("n").over(Window.orderBy("d"))).alias("change"))


_HALVES = """, A AS (SELECT project, id, label, summary, risk_score FROM V WHERE ord % 3 < 2), B AS (SELECT project, id, upper(label) AS label, NULL AS summary, CASE WHEN ord % 2 = 0 THEN 0.5 END AS risk_score FROM V WHERE ord % 3 > 0)"""


@query(GRAPH_SQL + _HALVES + " SELECT project, id, coalesce(B.label, A.label) AS label, CASE WHEN B.id IS NULL THEN A.risk_score ELSE B.risk_score END AS risk_score FROM A FULL JOIN B USING (project, id)")
def merge_passes(spark, d):
    """Two overlapping versions of the nodes, the later winning."""
    v = load_nodes(spark, d)
    a = v.where("ord % 3 < 2").select("project", "id", "label", "summary", "risk_score", "ord")
    b = v.where("ord % 3 > 0").select("project", "id", F.upper("label").alias("label"), F.lit(None).cast("string").alias("summary"), F.when(F.col("ord") % 2 == 0, 0.5).alias("risk_score"), "ord")
    return merge.merge_passes(a, b, ["project", "id"]).select("project", "id", "label", "risk_score")


@query(GRAPH_SQL + _HALVES + " SELECT project, id, A.label, coalesce(B.risk_score, A.risk_score) AS risk_score FROM A LEFT JOIN B USING (project, id)")
def enrich_merge(spark, d):
    """Nodes with the values of an overlay where it has any."""
    v = load_nodes(spark, d)
    a = v.where("ord % 3 < 2").select("project", "id", "label", "risk_score")
    b = v.where("ord % 3 > 0").select("project", "id", F.when(F.col("ord") % 2 == 0, 0.5).alias("risk_score"))
    return merge.apply_overlay(a, b, ["risk_score"])


@query(GRAPH_SQL + " SELECT 'all' AS project, project || ':' || id AS id, label FROM V")
def merge_subgraphs(spark, d):
    """The graphs of all projects as one, ids prefixed."""
    v, e = load(spark, d)
    merged, _ = merge.merge_projects(v, e, "all")
    return merged.select("project", "id", "label")


@query(GRAPH_SQL + """ SELECT 'all' AS project, project || ':' || source AS source, project || ':' || target AS target, edge_type, weight FROM E
QUALIFY row_number() OVER (PARTITION BY project, source, target, edge_type ORDER BY E.ord NULLS FIRST, E.edge_id NULLS FIRST, E.weight NULLS FIRST) = 1""")
def merge_subgraph_edges(spark, d):
    """The edges of the graphs of all projects as one, ids of both ends prefixed, the first of repeats."""
    v, e = load(spark, d)
    _, merged = merge.merge_projects(v, e, "all")
    return merged.select("project", "source", "target", "edge_type", "weight")


@query(f"""SELECT project, {_CANON.format('id')} AS id, coalesce(nullif(label, ''), nullif(node_name, ''), nullif(regexp_extract(id, '([^/:]+)$', 1), ''), id) AS label, CASE WHEN complexity IN ('simple', 'moderate', 'complex') THEN complexity END AS complexity,
  CASE WHEN risk_score IS NOT NULL THEN least(greatest(risk_score, 0.0), 1.0) END AS risk_score, len(list_filter(coalesce(risk_factors, []), lambda f: f IN ('high_coupling', 'no_test_coverage', 'frequent_changes', 'large_blast_radius', 'critical_path', 'single_author', 'recent_churn', 'has_structural_warnings'))) AS n_factors, ord FROM nodes WHERE coalesce(id, '') <> ''""")
def assemble_normalize(spark, d):
    """All node rows cleaned."""
    kept, _ = merge.clean_nodes(table(spark, d, "nodes"))
    return kept.select("project", graph.canonical_id("id").alias("id"), "label", "complexity", "risk_score", F.size("risk_factors").cast("long").alias("n_factors"), "ord")


@query()
def incremental_patch(spark, d):
    """The graph after a third of the files changed: the patch equals the rebuild, so the counts agree."""
    v, e = load(spark, d)
    changed = cut(v.where("file is not null").select("project", F.col("file").alias("path")).distinct().where(F.pmod(F.xxhash64("path"), F.lit(3)) == 0))
    fresh = v.join(changed.withColumnRenamed("path", "file"), ["project", "file"], "left_semi").select(*v.columns)
    ids = fresh.select("project", F.col("id").alias("source"))
    new_edges = e.join(ids, ["project", "source"], "left_semi").select(*e.columns)
    after, live = changes.patch_graph(v, e, changed, fresh, new_edges)
    return after.groupBy("project").agg(F.count(F.lit(1)).alias("n_nodes")).join(live.groupBy("project").agg(F.count(F.lit(1)).alias("n_edges")), "project", "left")


@query(GRAPH_SQL + """, s AS (SELECT V.project, V.id, V.node_type, V.file, row_number() OVER (PARTITION BY V.project ORDER BY risk_score DESC, ord) AS pos FROM V WHERE risk_score > 0.6)
SELECT project, row_number() OVER (PARTITION BY project ORDER BY pos) AS step_no, id FROM s WHERE pos > 1""")
def persona_steps(spark, d):
    """The risk tour of each project for a senior reader: without its first step."""
    from pyspark.sql import Window

    v = load_nodes(spark, d)
    steps = v.where("risk_score > 0.6").select("project", F.lit("risk").alias("tour_id"), F.row_number().over(Window.partitionBy("project").orderBy(F.desc("risk_score"), "ord")).alias("pos"), "id")
    return merge.persona_steps(steps, v, "senior").select("project", F.col("step_no").cast("long").alias("step_no"), "id")


@query(GRAPH_SQL + ", R AS (SELECT project, source, target FROM E WHERE edge_type = 'imports') SELECT DISTINCT R.project, R.source AS id FROM R JOIN V ON V.project = R.project AND V.id = R.target WHERE V.risk_score >= 0.7")
def importers(spark, d):
    """Direct importers of the risky nodes."""
    v, e = load(spark, d)
    return changes.importers(e, v.where("risk_score >= 0.7"))


@query()
def blast_radius_approx(spark, d):
    """Sketched blast radius over all edge types: linear a round where the exact closure is quadratic."""
    v, e = load(spark, d)
    return traversal.blast_radius_approx(v, e)
