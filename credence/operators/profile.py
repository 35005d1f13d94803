"""Corpus profiling: counts, label counts, per-dataset records, totals.

All datasets are tagged and unioned first, then profiled by one aggregation:
no per-dataset jobs, no driver loops.  Every aggregate is a partial/final
hash aggregate, so a dataset holding most rows only adds map-side work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions.labels import FAKE_LABEL, REAL_LABEL


def _count_if(cond):
    return F.count_if(cond).cast("bigint")


def _label_aggs(label_col: str):
    lab = F.col(label_col)
    has_labels = F.count(lab) > 0
    # A dataset without any label is reported with NULL class counts rather
    # than being skipped.
    return [
        F.count(F.lit(1)).cast("bigint").alias("articles"),
        F.when(has_labels, _count_if(lab == FAKE_LABEL)).alias("fake"),
        F.when(has_labels, _count_if(lab == REAL_LABEL)).alias("true"),
    ]


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("articles"))


def label_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """One pass: total, fake and true counts."""
    return df.agg(*_label_aggs(label_col))


def dataset_stats(df: DataFrame, dataset_col: str = "dataset",
                  label_col: str = "label") -> DataFrame:
    """One record per dataset: (dataset, articles, fake, true)."""
    return df.groupBy(dataset_col).agg(*_label_aggs(label_col))


def dataset_rollup(df: DataFrame, dataset_col: str = "dataset",
                   label_col: str = "label") -> DataFrame:
    """Per-dataset records plus the grand total (``is_total = 1``).

    ``grouping()`` tells the total row apart from a dataset whose name is NULL.
    """
    return (df.rollup(dataset_col)
            .agg(F.grouping(dataset_col).cast("int").alias("is_total"),
                 *_label_aggs(label_col)))


def label_percentages(df: DataFrame, label_col: str = "label", digits: int = 1) -> DataFrame:
    """Totals and fake/true percentages of the total (NULL when the total is 0)."""
    totals = label_counts(df, label_col)
    total = F.col("articles")
    pct = lambda c: F.when(total > 0, F.round(F.lit(100.0) * F.col(c) / total, digits))
    return totals.select("articles", "fake", "true",
                         pct("fake").alias("fake_pct"), pct("true").alias("true_pct"))


def stats_record(df: DataFrame, dataset_col: str = "dataset", label_col: str = "label",
                 skip_unlabelled: bool = False, digits: int = 1) -> DataFrame:
    """One nested record: totals, percentages and ``datasets``, an array by name.

    (articles, fake, true, fake_pct, true_pct, datasets
    ARRAY<STRUCT<name, articles, fake, true>>); the array has one entry for
    each named dataset.  With ``skip_unlabelled`` a dataset without any label
    counts in neither the totals nor the array.  No rows: one record of zeros,
    NULL percentages and an empty array.
    """
    stats = dataset_stats(df, dataset_col, label_col)
    if skip_unlabelled:
        stats = stats.where("fake is not null")
    entry = F.struct(F.col(dataset_col).alias("name"), "articles", "fake", "true")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    record = stats.agg(total("articles").alias("articles"), total("fake").alias("fake"), total("true").alias("true"),
                       F.array_sort(F.collect_list(entry)).alias("datasets"))
    pct = lambda c: F.when(F.col("articles") > 0, F.round(F.lit(100.0) * F.col(c) / F.col("articles"), digits))
    return record.select("articles", "fake", "true", pct("fake").alias("fake_pct"), pct("true").alias("true_pct"), "datasets")


def implied_label(df: DataFrame, implied: dict, dataset_col: str = "dataset",
                  label_col: str = "label") -> DataFrame:
    """Rows of a one-class dataset take that class, whatever their columns.

    ``implied`` maps dataset name -> class label; other datasets keep their own
    label column (NULL when they have none).
    """
    spark = df.sparkSession
    mapping = spark.createDataFrame(
        [(k, v) for k, v in implied.items()],
        f"{dataset_col} string, implied_label string")
    src = df if label_col in df.columns else df.withColumn(label_col, F.lit(None).cast("string"))
    # The mapping has one row per named dataset: a bounded broadcast.
    return (src.join(F.broadcast(mapping), dataset_col, "left")
            .withColumn(label_col, F.coalesce("implied_label", label_col))
            .drop("implied_label"))


def describe_schema(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """The schema as a relation (column_name, data_type, position)."""
    spark = spark or df.sparkSession
    rows = [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "column_name string, data_type string, position int")


def column_profile(df: DataFrame) -> DataFrame:
    """(column_name, data_type, position, non_null): the schema plus the number
    of non-NULL values of every column, from one aggregation pass.

    The one-row count result is unpivoted and joined with the schema
    relation (one row per column, broadcast).
    """
    names = df.columns
    counts = df.agg(*[F.count(F.col(c)).cast("bigint").alias(c) for c in names])
    long = counts.unpivot([], names, "column_name", "non_null")
    return describe_schema(df).join(F.broadcast(long), "column_name")
