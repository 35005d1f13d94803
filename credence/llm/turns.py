"""Places of turns within their conversations, for conversations of any length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.llm import arrays as A
from credence.llm.blocks import materialize, shuffle_width

SHARD_ROWS = 200_000


def turn_digest(role: str = "role", text: str = "text") -> Column:
    """128 bits of the SHA-256 of a turn's role and text."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)).cast("binary"), 256), 1, 32))


def ranged(rows: DataFrame, keys: list[Column], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``rows`` dealt by ranges of ``keys``, about ``shard_rows`` to a task; their number grows with the input."""
    return rows.repartitionByRange(max(shuffle_width(rows.sparkSession), -(-rows.count() // shard_rows)), *keys)


def turn_positions(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with ``name``: the place, from 0, of each row in its conv_id (null is one id) by ``order``.

    The rows are sorted over all tasks by (conv_id, order), so a conversation
    that holds a third of all rows lies in many tasks.  Each task numbers its
    runs; only the first run of a task can go on from earlier ones, so one
    offset for each task, broadcast, makes the places whole.
    """
    keys = [F.col("conv_id").asc_nulls_first(), *order]
    schema = T.StructType([*rows.schema.fields, T.StructField("_shard", T.IntegerType()), T.StructField(name, T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id")
            ids, null = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
            start, end = A.runs_of(ids, null)
            place = np.arange(len(ids)) - np.repeat(start, end - start)
            if last == (ids[0], null[0]):
                place[: end[0]] += count
            last, count = (ids[-1], null[-1]), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), shard, np.int32)), pa.array(place.astype(np.int64))],
                                             names=[*batch.schema.names, "_shard", name])

    numbered = materialize(ranged(rows, keys).sortWithinPartitions(*keys).mapInArrow(number, schema))
    before = Window.partitionBy("conv_id").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (numbered.groupBy("conv_id", "_shard").agg((F.max(name) + 1).alias("n")).select("conv_id", "_shard", F.sum("n").over(before).alias("_offset"))
               .where("_offset is not null").select("_shard", F.col("conv_id").alias("_conv"), "_offset"))
    # At most one row for each task: only its first conversation can have begun earlier.
    return (numbered.join(F.broadcast(offsets), "_shard", "left")
            .withColumn(name, F.col(name) + F.when(F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_offset").isNotNull(), F.col("_offset")).otherwise(0))
            .drop("_shard", "_conv", "_offset"))
