"""Commit history: times, authors, churn, pull-request references, hunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["project", "file"]


def parse_date(column) -> "F.Column":
    """A commit date in any of its notations as UTC; null when it is none of them."""
    text = F.trim(F.col(column) if isinstance(column, str) else column)
    text = F.regexp_replace(F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})[ T]", "$1T"), r" ?([+-]\d{2}):?(\d{2})$", "$1:$2")
    return text.try_cast("timestamp")


def commit_times(commits: DataFrame) -> DataFrame:
    """Commits once each (rows repeated under one commit_id count once) with ``at``, the time of the commit."""
    columns = [c for c in commits.columns if c not in ("ord", "loaded_at")]
    return commits.select(*columns).dropDuplicates(["commit_id"]).withColumn("at", parse_date("commit_date"))


def author_frequency(commits: DataFrame, k: int = 3) -> DataFrame:
    """project, file, pos, author, n: the k most frequent authors of each file."""
    n = commits.where("author <> ''").groupBy(*KEY, "author").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*KEY).orderBy(F.desc("n"), "author")
    return n.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def churn(commits: DataFrame, days: int, now) -> DataFrame:
    """project, file, n commits in the days before now."""
    return commits.where(F.col("at") >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def latest_commit(commits: DataFrame) -> DataFrame:
    """project, file, sha, at of the newest commit of each file; ties go to the larger commit id."""
    last = F.max(F.struct("at", "commit_id", "sha")).alias("x")
    return commits.where("at is not null").groupBy(*KEY).agg(last).select(*KEY, "x.sha", "x.at")


def largest_commits(commits: DataFrame, k: int = 5) -> DataFrame:
    """The k commits of each file with the longest message (or diff)."""
    w = Window.partitionBy(*KEY).orderBy(F.desc(F.length(F.coalesce("message", F.lit("")))), "commit_id")
    return commits.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select(*KEY, "pos", "commit_id", F.length(F.coalesce("message", F.lit(""))).alias("size"))


def pr_references(commits: DataFrame) -> DataFrame:
    """project, file, reference, n: '#123' references in messages."""
    refs = commits.select(*KEY, "commit_id", F.explode(F.array_distinct(F.regexp_extract_all("message", F.lit(r"#\d+"), F.lit(0)))).alias("reference"))
    return refs.groupBy(*KEY, "reference").agg(F.count(F.lit(1)).alias("n"))


def hunks(diffs: DataFrame) -> DataFrame:
    """diffs (project, file, sha, diff) -> start and end lines of each hunk of the new side; the count defaults to 1 and
    the end is start + count."""
    header = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    starts, counts = (F.regexp_extract_all("diff", F.lit(header), F.lit(i)) for i in (1, 2))
    pair = F.explode(F.zip_with(starts, counts, lambda s, c: F.struct(s.cast("int").alias("s"), F.when(c == "", 1).otherwise(c.try_cast("int")).alias("c")))).alias("h")
    return diffs.select("project", "file", "sha", pair).select("project", "file", "sha", F.col("h.s").alias("start"), (F.col("h.s") + F.col("h.c")).alias("end"))


def symbol_commits(symbols: DataFrame, commits: DataFrame, hunk_rows: DataFrame) -> DataFrame:
    """Commits that touched each symbol (project, file, name, start_line, end_line): a hunk overlaps its lines, or the
    commit has no hunks known for the file. Symbols without lines have none."""
    s = symbols.where("start_line is not null and end_line is not null").select("project", "file", "name", "start_line", "end_line")
    c = commits.select("project", "file", "sha", "commit_id").distinct()
    joined = s.join(c, KEY).join(hunk_rows, ["project", "file", "sha"], "left")
    hit = F.col("start").isNull() | ((F.col("start_line") <= F.col("end")) & (F.col("end_line") >= F.col("start")))
    return joined.where(hit).select("project", "file", "name", "sha", "commit_id").distinct()


def decision_context(commits: DataFrame, now, k: int = 3, kept: int = 50) -> DataFrame:
    """One row a file: the newest commits, first authors, last change, changes in 90 days, references."""
    newest = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc_nulls_last("at"), F.desc("commit_id")))
    few = commits.withColumn("_n", newest).where(F.col("_n") <= kept)
    item = F.struct("_n", F.substring("sha", 1, 7).alias("sha"), "at", F.substring_index("message", "\n", 1).alias("message"), "author")
    base = few.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("commits"), F.max("at").alias("last_changed"))
    top = author_frequency(commits, k).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "author"))), lambda x: x["author"]).alias("primary_authors"))
    recent = churn(commits, 90, now).withColumnRenamed("n", "change_frequency")
    refs = pr_references(commits).groupBy(*KEY).agg(F.array_sort(F.collect_set("reference")).alias("pr_references"))
    return base.join(top, KEY, "left").join(recent, KEY, "left").join(refs, KEY, "left").withColumn("change_frequency", F.coalesce("change_frequency", F.lit(0)))


def changelog_entries(changelog: DataFrame, shas: DataFrame) -> DataFrame:
    """changelog (doc, line_no, line) and shas (sha): sha, version, entry for lines that hold a sha. The version is that
    of the last heading above. A sha meets a line through the line's own hexadecimal words."""
    heading = F.regexp_extract("line", r"^#+\s*\[?v?(\d+\.\d+[\w.-]*)", 1)
    w = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    at = changelog.withColumn("version", F.last(F.nullif(heading, F.lit("")), True).over(w))
    words = at.select("version", F.substring("line", 1, 200).alias("entry"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b[0-9a-f]{7,40}\b"), F.lit(0)))).alias("word"))
    known = shas.select("sha", F.substring("sha", 1, 7).alias("head")).distinct()
    return words.withColumn("head", F.substring("word", 1, 7)).join(known, "head").where(F.col("word").startswith(F.col("sha"))).select("sha", "version", "entry").distinct()
