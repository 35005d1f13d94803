"""Blocks of documents, and what several operators need of a Spark session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.session import materialize  # noqa: F401  (reliable checkpoint in spark.checkpoint.dir)
from credence.sources.tables import table  # noqa: F401

BLOCK_BYTES = 4 << 20


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one scan of one column, one number to the driver."""
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES, text: str = "text") -> int:
    """How many blocks of about ``block_bytes`` the texts fill; it grows with the input."""
    return max(shuffle_width(docs.sparkSession), -(-text_bytes(docs, text) // block_bytes))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def import_on_workers(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from where the driver did.

    On a cluster the package is installed or sent with ``--py-files``; a path
    that does not exist there is ignored.  Workers use one thread for linear
    algebra unless the session says otherwise: the tasks already fill the cores.
    """
    import os
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    env.setdefault("OMP_NUM_THREADS", "1")


BROADCAST_IDS = 250_000     # at most 2 MB of ids


def restrict(docs: DataFrame, ids: DataFrame, how: str = "left_semi", column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``column`` is (``left_semi``) or is not (``left_anti``) among ``ids``.

    The ids are counted first; few are broadcast, so the texts stay where they
    are, more are joined by a shuffle.  The result is the same.
    """
    ids = materialize(ids.select(column).distinct())
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, column, how)
