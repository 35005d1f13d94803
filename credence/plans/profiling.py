"""Corpus statistics over several labelled files in one job.

Every source is read (a missing optional one contributes nothing), tagged
with its dataset name, reduced to (dataset, label) and unioned; implied
labels of one-class files are applied by a broadcast join with the
name -> class map; one rollup then yields the per-dataset records and the
grand total.  No per-file jobs, no driver-side sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.operators import articles as A
from credence.operators import profile as P
from credence.sources import csv as CSV


@dataclass(frozen=True)
class LabelledSource:
    name: str
    paths: tuple[str, ...]
    sep: str = ","
    implied_label: str | None = None      # class of a one-class file
    label_col: str = "label"
    required: bool = False


def read_labels(spark: SparkSession, sources: list[LabelledSource]) -> DataFrame:
    """(dataset, label) for every row of every available source."""
    frames = []
    for s in sources:
        paths = list(s.paths)
        df = (CSV.read_first_available(spark, paths, sep=s.sep) if s.required
              else CSV.read_optional(spark, paths, sep=s.sep))
        if df is None:
            continue
        lab = F.col(s.label_col) if s.label_col in df.columns else F.lit(None).cast("string")
        frames.append(df.select(F.lit(s.name).alias("dataset"), lab.alias("label")))
    if not frames:
        raise ValueError("none of the sources could be read")
    rows = A.union_articles(*frames)
    implied = {s.name: s.implied_label for s in sources if s.implied_label}
    return P.implied_label(rows, implied) if implied else rows


def profile_sources(spark: SparkSession, sources: list[LabelledSource]) -> DataFrame:
    """(dataset, is_total, articles, fake, true) with the grand total row."""
    return P.dataset_rollup(read_labels(spark, sources))


def summary(rollup: DataFrame) -> DataFrame:
    """Grand total with fake/true percentages (one decimal), from a rollup."""
    total = F.col("articles")
    pct = lambda c: F.when(total > 0, F.round(F.lit(100.0) * F.col(c) / total, 1))
    return (rollup.filter(F.col("is_total") == 1)
            .select("articles", "fake", "true", pct("fake").alias("fake_pct"),
                    pct("true").alias("true_pct")))
