"""Global positions without a single-partition window.

``row_number() OVER (ORDER BY ..)`` with no PARTITION BY moves every row into
one task.  ``global_positions`` computes the same 0-based position with a
distributed range sort: each sorted partition is numbered locally, a table of
per-partition counts (one row per partition and group, so bounded by the
partition count) is turned into offsets, and the offsets are broadcast back.
The sorted, locally numbered relation is checkpointed first so that the
counts and the rows come from the same physical partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.session import materialize


def global_positions(df: DataFrame, order_cols: list[str], group_col: str | None = None,
                     name: str = "position") -> DataFrame:
    """Adds ``name``: 0-based rank of each row in ``order_cols`` order (ties must
    not exist), restarting for every value of ``group_col``.

    ``group_col`` must have few values (e.g. an epoch): the broadcast offset
    table has one row per (partition, group).
    """
    keys = ([group_col] if group_col else []) + list(order_cols)
    grp = [group_col] if group_col else []
    numbered = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id()))
    counts = numbered.groupBy("_pid", *grp).agg(F.count(F.lit(1)).alias("_cnt"),
                                               F.min("_mid").alias("_first"))
    w = Window.partitionBy(*grp).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    return (numbered.join(F.broadcast(offsets.select("_pid", *grp, "_offset", "_first")),
                          ["_pid", *grp])
            .withColumn(name, F.col("_offset") + F.col("_mid") - F.col("_first"))
            .drop("_pid", "_mid", "_offset", "_first"))
