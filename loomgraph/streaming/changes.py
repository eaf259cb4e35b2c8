"""Change streams over file events: debounce, content filter, incremental graph maintenance, windowed counts.

events: (project, path, op, content_hash, ts), op one of add, change, unlink; deletes arrive as events because file
sources don't report them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "project string, path string, op string, content_hash string, ts timestamp"


def debounce(events: DataFrame, quiet: str = "2 seconds", late: str | None = "1 minute", key: str = "project", item: str = "path", ts: str = "ts") -> DataFrame:
    """One row for each burst of a key: events no further apart than ``quiet``, its items once each. Works on streams
    (append mode, late data up to ``late``) and on tables."""
    source = events.withWatermark(ts, late) if late and events.isStreaming else events
    burst = F.session_window(ts, quiet)
    items = F.array_sort(F.collect_set(item)).alias("items")
    return source.groupBy(key, burst).agg(items, F.count(F.lit(1)).alias("n_events")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "items", "n_events")


def windowed_counts(events: DataFrame, key: str, ts: str = "ts", width: str = "1 hour", slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """Events and sums per key and window, tumbling or sliding."""
    source = events.withWatermark(ts, late) if late and events.isStreaming else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return source.groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def last_of_batch(batch: DataFrame) -> DataFrame:
    """The last event of each path."""
    return batch.groupBy("project", "path").agg(F.max(F.struct("ts", "op", "content_hash")).alias("x")).select("project", "path", "x.op", "x.content_hash", "x.ts")


def real_changes(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Last events whose content differs from the known hash (project, path, content_hash); removed and unreadable files
    (no hash) always count."""
    last = last_of_batch(batch)
    old = known.select("project", "path", F.col("content_hash").alias("_old"))
    joined = last.join(old, ["project", "path"], "left")
    return joined.where((F.col("op") == "unlink") | F.col("content_hash").isNull() | F.col("_old").isNull() | (F.col("content_hash") != F.col("_old"))).drop("_old")


def update_hashes(known: DataFrame, changed: DataFrame) -> DataFrame:
    """Known hashes after a batch: removed and unreadable files lose theirs."""
    rest = known.join(changed.select("project", "path"), ["project", "path"], "left_anti").select("project", "path", "content_hash")
    return rest.unionByName(changed.where("op <> 'unlink' and content_hash is not null").select("project", "path", "content_hash"))


def patch_graph(nodes: DataFrame, edges: DataFrame, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with all nodes of changed files (project, path) replaced by the new ones. Edges between kept nodes stay,
    edges of dropped nodes go unless both ends are there again; the result equals a rebuild when new_nodes and new_edges
    hold what a rebuild finds for the changed files and for the edges into them."""
    paths = changed.select("project", F.col("path").alias("file")).distinct()
    kept = nodes.join(paths, ["project", "file"], "left_anti").select(*nodes.columns)
    after = kept.unionByName(new_nodes.select(*nodes.columns))
    gone = nodes.join(paths, ["project", "file"], "left_semi").select("project", "id")
    own = edges.join(gone.withColumnRenamed("id", "source"), ["project", "source"], "left_anti")
    whole = own.select(*edges.columns).unionByName(new_edges.select(*edges.columns)).dropDuplicates(["project", "source", "target", "edge_type"])
    ids = after.select("project", "id").distinct()
    live = whole.join(ids.withColumnRenamed("id", "source"), ["project", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["project", "target"], "left_semi")
    return after, live.select(*edges.columns)


def importers(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Sources of imports of changed nodes (project, id), one step."""
    return edges.where("edge_type = 'imports'").join(changed.select("project", F.col("id").alias("target")).distinct(), ["project", "target"], "left_semi").select("project", F.col("source").alias("id")).distinct()


def watch(spark: SparkSession, source: str, state: str, out: str, checkpoint: str, quiet_trigger: str = "2 seconds", once: bool = True):
    """A streaming query over event files: each batch keeps the real changes against the hashes stored below ``state``
    and appends them to ``out``. Hash versions are numbered by batch, so a batch that runs again gives the same result."""

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        empty = session.createDataFrame([], "project string, path string, content_hash string")
        before = session.read.parquet(f"{state}/{number - 1}") if number > 0 else empty
        changed = real_changes(batch, before)
        changed.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        update_hashes(before, session.read.parquet(f"{out}/batch={number}")).write.mode("overwrite").parquet(f"{state}/{number}")

    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(source).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime=quiet_trigger)).start()
