"""Running counts and sums within groups over a distributed sort, without gathering a group in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def prefix_sums(df: DataFrame, group: str, order: list[str], size: str) -> DataFrame:
    """df with _row (0, 1, ...) and _before (sum of size before the row) within each group, in the given order.

    A range shuffle by (group, order) spreads a group over as many tasks as its rows need. Each task adds up its
    own rows; running sums of the per-task totals, at most one row for each task and group met there, give the offsets. group,
    order and size must not be null; order must be unique within a group for a definite result. The sorted rows
    are written to the checkpoint folder once, so that row numbers stay the same when a task runs again."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = cut(df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_task", F.spark_partition_id()))
    totals = ordered.groupBy(group, "_task").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(size).cast("long")).alias("_s"))
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        group, "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_sum_before")
    )
    schema = ordered.schema
    names = schema.names
    at_group, at_size = names.index(group), names.index(size)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", _local_row long, _local_sum long"

    def run(batches):
        now, row, total = None, 0, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            groups, sizes = b.column(at_group), b.column(at_size).cast(pa.int64()).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(pc.not_equal(groups[1:], groups[:-1]).to_numpy(zero_copy_only=False)) + 1])
            lengths = np.diff(np.append(starts, n))
            summed = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.arange(n) - np.repeat(starts, lengths)
            sums = summed[:-1] - np.repeat(summed[starts], lengths)
            if groups[0].as_py() == now:  # the group goes on from the batch before
                rows[: lengths[0]] += row
                sums[: lengths[0]] += total
            now, row, total = groups[n - 1].as_py(), int(rows[-1]) + 1, int(sums[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.int64()), pa.array(sums, pa.int64())], names=[*names, "_local_row", "_local_sum"])

    placed = ordered.mapInArrow(run, ddl).join(offsets, [group, "_task"])
    return placed.select(
        *[F.col(c) for c in df.columns], (F.col("_rows_before") + F.col("_local_row")).alias("_row"), (F.col("_sum_before") + F.col("_local_sum")).alias("_before")
    )
