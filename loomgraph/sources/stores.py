"""Stored graphs and side tables: load, save, checkpoints, fingerprints, history, annotations, responses, git logs."""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..functions.text import safe_file_name

GRAPH = (
    "version string, project_name string, nodes array<struct<id:string,type:string,label:string,name:string,filePath:string,summary:string,complexity:string,tags:array<string>,layer:string,"
    "risk_score:double,risk_factors:array<string>>>, edges array<struct<source:string,target:string,type:string,direction:string,weight:double>>, layers array<struct<id:string,name:string,description:string,node_ids:array<string>>>"
)


def load_graph(spark: SparkSession, path: str, strict: bool = True) -> dict[str, DataFrame] | None:
    """nodes, edges and layers of a graph document. strict fails on a document that doesn't fit the schema; else None."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    try:
        doc = spark.read.schema(GRAPH + ("" if strict else ", _corrupt_record string")).option("multiLine", True).option("mode", mode).json(path)
        first = doc.limit(1).select("project_name", F.size("nodes").alias("n"), *(["_corrupt_record"] if not strict else [])).first()
    except Exception:
        if strict:
            raise
        return None
    if first is None or (first["n"] or -1) < 0 or (not strict and first["_corrupt_record"] is not None):
        if strict:
            raise ValueError(f"{path} holds no graph")
        return None
    nodes = doc.select(F.col("project_name").alias("project"), F.posexplode("nodes").alias("ord", "n")).select("project", "n.id", F.col("n.type").alias("node_type"), "n.label", F.col("n.name").alias("node_name"), F.col("n.filePath").alias("file"), "n.summary", "n.complexity", "n.tags", "n.layer", "n.risk_score", "n.risk_factors", F.col("ord").cast("long").alias("ord"))
    edges = doc.select(F.col("project_name").alias("project"), F.posexplode("edges").alias("ord", "e")).select("project", F.col("ord").cast("long").alias("edge_id"), "e.source", "e.target", F.col("e.type").alias("edge_type"), "e.direction", "e.weight", F.col("ord").cast("long").alias("ord"))
    layers = doc.select(F.col("project_name").alias("project"), F.explode("layers").alias("l")).select("project", "l.id", F.col("l.name").alias("layer_name"), "l.description", "l.node_ids")
    return {"nodes": nodes, "edges": edges, "layers": layers}


class GraphLoader:
    """Loads a graph document again only when its file has changed; refuses files over max_bytes."""

    def __init__(self, spark: SparkSession, path: str, max_bytes: int = 50 * 1024 * 1024):
        self.spark, self.path, self.max_bytes = spark, path, max_bytes
        self._mtime: float | None = None
        self._graph: dict[str, DataFrame] | None = None
        self.problem: str | None = None

    def get(self) -> dict[str, DataFrame] | None:
        try:
            at = os.stat(self.path)
        except OSError:
            self.problem = "GRAPH_NOT_FOUND"
            return None
        if at.st_size > self.max_bytes:
            self.problem = "GRAPH_TOO_LARGE"
            return None
        if self._mtime != at.st_mtime:
            self._graph, self._mtime = load_graph(self.spark, self.path, strict=False), at.st_mtime
            self.problem = None if self._graph else "GRAPH_INVALID"
        return self._graph


def save(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a stored table as a whole. Each save is a folder of its own, and the file CURRENT, which names the one that
    counts, is replaced by a rename: readers (saved()) see the old or the new table, and a table may be saved from itself.
    The version before the last stays for readers that have begun; older ones are removed."""
    spark, version = df.sparkSession, f"version-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}/{version}")
    fs, at, jvm = *_file_system(spark, path), spark._jvm
    before = _current(spark, path)
    fresh, current = jvm.org.apache.hadoop.fs.Path(at, f".{version}"), jvm.org.apache.hadoop.fs.Path(at, "CURRENT")
    out = fs.create(fresh, True)
    out.writeBytes(version)
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, current, over)
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("version-") and name not in (version, before):
            fs.delete(status.getPath(), True)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _current(spark: SparkSession, path: str) -> str | None:
    fs, at = _file_system(spark, path)
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "CURRENT")):
        return None
    rows = spark.read.text(f"{path}/CURRENT").head(1)
    return rows[0][0] if rows else None


def saved(spark: SparkSession, path: str) -> DataFrame:
    """The table last saved under the path."""
    version = _current(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing was saved under {path}")
    return spark.read.parquet(f"{path}/{version}")


def save_stage(df: DataFrame, folder: str, stage: str) -> DataFrame:
    """Write the result of a stage and go on from the written table."""
    path = f"{folder.rstrip('/')}/{stage}"
    save(df, path)
    return saved(df.sparkSession, path)


def append_history(snapshot: DataFrame, path: str, kept: int = model.HISTORY_KEPT) -> DataFrame:
    """Append snapshots and return the last ``kept`` of each project, oldest first."""
    snapshot.write.mode("append").parquet(path)
    return last_history(snapshot.sparkSession.read.parquet(path), kept)


def last_history(history: DataFrame, kept: int = model.HISTORY_KEPT) -> DataFrame:
    w = Window.partitionBy("project").orderBy(F.desc("at"))
    return history.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= kept).drop("_n")


def annotate(spark: SparkSession, path: str, project: str, node_id: str, content: str, tags: list[str] | None = None, at: datetime | None = None) -> DataFrame:
    """Append one annotation."""
    if not content.strip():
        raise ValueError("INVALID_INPUT")
    row = [(project, node_id, content.strip(), tags or [], at or datetime.now(timezone.utc).replace(tzinfo=None))]
    df = spark.createDataFrame(row, "project string, node_id string, content string, tags array<string>, annotated_at timestamp").withColumn("file_name", F.concat(safe_file_name("node_id"), F.lit(".md")))
    df.write.mode("append").parquet(path)
    return df


def annotation_markdown(df: DataFrame) -> DataFrame:
    """Annotations as documents with a header."""
    head = F.concat(F.lit("---\nnode_id: "), F.col("node_id"), F.lit("\nannotated_at: "), F.date_format("annotated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\ntags: ["), F.array_join("tags", ", "), F.lit("]\n---\n\n"))
    return df.select("file_name", F.concat(head, F.col("content"), F.lit("\n")).alias("text"))


def stale_annotations(annotations: DataFrame, last_changed: DataFrame) -> DataFrame:
    """Annotations older than the last change (project, node_id, last_changed) of their node."""
    return annotations.join(last_changed, ["project", "node_id"]).where("last_changed > annotated_at")


def respond(spark: SparkSession, path: str, response: str, question: str | None = None, at: datetime | None = None) -> DataFrame:
    """Append one response, trimmed; an empty one is an error."""
    if not (response or "").strip():
        raise ValueError("MISSING_RESPONSE")
    df = spark.createDataFrame([(uuid.uuid4().hex, question, response.strip(), at or datetime.now(timezone.utc).replace(tzinfo=None))], "id string, question string, response string, at timestamp")
    df.write.mode("append").parquet(path)
    return df


def git_log(spark: SparkSession, path: str, project: str, file: str | None = None) -> DataFrame:
    """Lines 'sha|author|date|subject' (the subject may hold bars) as commits with a seven-letter sha; ``file`` is the file
    whose log it is."""
    parts = F.split("value", r"\|", 4)
    return spark.read.text(path).where(F.size(parts) >= 4).select(F.lit(project).alias("project"), F.lit(file).alias("file"), F.substring(parts[0], 1, 7).alias("sha"), parts[1].alias("author"), parts[2].alias("commit_date"), parts[3].alias("message"))


def git_log_with_diffs(spark: SparkSession, path: str, project: str, file: str | None = None) -> DataFrame:
    """Blocks that begin with COMMIT_START|sha|author|date|subject as commits with body and diff; file as in git_log()."""
    raw = spark.read.option("lineSep", "COMMIT_START|").text(path).where(F.trim("value") != "")
    head = F.split(F.substring_index("value", "\n", 1), r"\|", 4)
    rest = F.regexp_extract("value", r"(?s)^[^\n]*\n?(.*)$", 1)
    cut_at = F.locate("\ndiff --git", F.concat(F.lit("\n"), rest))
    body = F.when(cut_at > 0, F.substring(rest, F.lit(1), cut_at - 1)).otherwise(rest)
    diff = F.when(cut_at > 0, F.substring(rest, cut_at, F.length(rest))).otherwise("")
    return raw.select(F.lit(project).alias("project"), F.lit(file).alias("file"), F.substring(head[0], 1, 7).alias("sha"), head[1].alias("author"), head[2].alias("commit_date"), head[3].alias("message"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"), diff.alias("diff"))


def is_stale(head: str | None, analysed: str | None) -> bool:
    """Whether the analysed commit is another than the head, as far as both are known."""
    return bool(head and analysed and not head.startswith(analysed) and not analysed.startswith(head))


def status(run_log: DataFrame, now: datetime) -> DataFrame:
    """run_log (project, pass, state, at) -> the last state of each pass and its age in minutes."""
    last = run_log.groupBy("project", "pass").agg(F.max(F.struct("at", "state")).alias("x"))
    return last.select("project", "pass", F.col("x.state").alias("state"), F.floor((F.unix_timestamp(F.lit(now)) - F.unix_timestamp("x.at")) / 60).alias("age_minutes"))


def read_json(path: str, default=None):
    """A small JSON file on the driver, or the default."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return default
