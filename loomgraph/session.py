"""Session helpers shared by every operator: table access, lineage cuts, hot-key salting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least this many rows of the larger join side.
HOT_ROWS = 200_000
#: No more than this many hot keys are ever handled one by one (n rows hold at most n / HOT_ROWS of them;
#: beyond the bound the hottest are salted and AQE's skew handling has the rest).
MAX_HOT_KEYS = 256
_SHIPPED: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "loomgraph") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOOMGRAPH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python stages find it there whatever
    their working directory is."""
    sc = spark.sparkContext
    if _SHIPPED.get("application") == sc.applicationId:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="loomgraph-package-")
    archive = os.path.join(folder, "loomgraph_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for root, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(root, n)
                    z.write(full, os.path.join("loomgraph", os.path.relpath(full, here)))
    sc.addPyFile(archive)
    _SHIPPED["application"] = sc.applicationId


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the reliable checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """cut() as compressed columns, for tables read more than once: a checkpoint holds plain rows."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Spread rows over the session's shuffle partitions, so that a Python stage over few, large
    input files still uses every core. By the given columns, or round robin."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *columns)


def spread_scan(df: DataFrame) -> DataFrame:
    """A scan as it is when its splits keep every core busy; a few large files are spread like in spread()."""
    enough = df._jdf.queryExecution().toRdd().getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism
    return df if enough else spread(df)


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> list[tuple]:
    """The at most MAX_HOT_KEYS key tuples holding hot_rows rows or more. The counts are combined map-side,
    so a key with a third of all rows costs one row per map task; only the bounded list is brought back."""
    found = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows)
        .orderBy(F.desc("_n")).limit(MAX_HOT_KEYS).collect()
    )
    return [tuple(row[k] for k in keys) for row in found if all(row[k] is not None for k in keys)]


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, spread_by: str, salts: int = 32, hot_rows: int = HOT_ROWS, hot: list[tuple] | None = None) -> DataFrame:
    """Sort-merge join of a large left side that may hold hot keys with a right side of one row per key.

    Rows of a hot key are spread over ``salts`` partitions by the hash of ``spread_by``; only the right rows
    of hot keys are copied ``salts`` times (at most MAX_HOT_KEYS * salts rows). Without hot keys this is the
    plain join. how: inner, left, left_semi or left_anti (sides whose left rows each find their own copy). hot: the
    hot keys where they are known, which saves the count over the left side."""
    if hot is None:
        hot = hot_keys(left.select(*keys), keys, hot_rows)
    if not hot:
        return left.join(right.hint("merge"), list(keys), how)
    is_hot = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in zip(keys, row))) for row in hot))
    is_hot = F.coalesce(is_hot, F.lit(False))
    left = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread_by), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn("_salt", F.explode(copies))
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")
