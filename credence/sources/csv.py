"""CSV article sources.

Quoted fields may contain doubled quotes and newlines, so files are read
with ``multiLine`` and ``escape='"'`` by default.  Columns are named from the
header (no inference pass over the data); a schema picks and casts them by
name, wherever they stand in the file.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.operators import articles as A

# The strings the usual CSV readers treat as missing by default.
DEFAULT_NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# End of fixed values.


def read_articles(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                  sep: str = ",", encoding: str = "UTF-8",
                  na_values: tuple[str, ...] | None = None, multi_line: bool = True,
                  strict: bool = True) -> DataFrame:
    """Read a header CSV.  ``na_values`` maps those exact strings to NULL.

    ``schema`` columns are found by their name in the header; one that the
    header lacks raises ValueError.  With ``strict`` a row with more or fewer fields than the
    header fails the job, and so does a value that its type cannot hold;
    without, surplus fields are cut and missing or unreadable values are NULL.

    ``multi_line=False`` lets Spark split a large file over many tasks; it is
    right when no quoted field contains a newline.
    """
    df = (spark.read.option("header", True).option("multiLine", multi_line)
          .option("escape", '"').option("quote", '"')
          .option("sep", sep).option("encoding", encoding)
          .option("mode", "FAILFAST" if strict else "PERMISSIVE")
          .option("columnPruning", not strict)          # pruned rows are not counted field by field
          .csv(path))
    if na_values:
        df = df.select(*[
            F.when(F.col(f.name).isin(*na_values), F.lit(None)).otherwise(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields])
    if schema is None:
        return df
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lacking = [f.name for f in wanted.fields if f.name not in df.columns]
    if lacking:
        raise ValueError(f"{path} has no column {', '.join(lacking)}")
    cast = (lambda f: F.col(f.name).cast(f.dataType)) if strict else (lambda f: F.col(f.name).try_cast(f.dataType))
    return df.select(*[cast(f).alias(f.name) for f in wanted.fields])


# Column that holds the raw text of a row whose fields do not fit the header.
_RAW = "_raw_record"


def read_checked(spark: SparkSession, path: str, schema: T.StructType | str, required: tuple[str, ...] = (),
                 checks: dict[str, Column] | None = None, sep: str = ",", encoding: str = "UTF-8",
                 na_values: tuple[str, ...] | None = None, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows) of a header CSV; together they are all rows.

    A row is rejected for the first of these reasons:

    * ``fields``: it has more or fewer fields than the header;
    * ``type:<column>``: a value that the column's type cannot hold;
    * ``missing:<column>``: a column of ``required`` is NULL;
    * ``check:<name>``: a condition of ``checks`` (on the typed columns) is false or NULL.

    Good rows have the columns of ``schema``.  Rejected ones have the same
    columns as the strings that were read, ``reason``, ``record`` (the raw text
    of a row with a wrong number of fields) and ``file``.  Nothing fails the
    job and nothing is dropped silently; both sides are lazy scans.
    """
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    options = {"header": True, "multiLine": multi_line, "escape": '"', "quote": '"', "sep": sep, "encoding": encoding}
    header = spark.read.options(**options).csv(path).columns
    lacking = [f.name for f in wanted.fields if f.name not in header]
    if lacking:
        raise ValueError(f"{path} has no column {', '.join(lacking)}")
    every = T.StructType([*[T.StructField(c, T.StringType()) for c in header], T.StructField(_RAW, T.StringType())])
    read = (spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=_RAW, columnPruning=False)
            .schema(every).csv(path).select("*", F.col("_metadata.file_path").alias("_file")))
    text = lambda c: F.when(F.col(c).isin(*na_values), F.lit(None)).otherwise(F.col(c)) if na_values else F.col(c)
    rows = read.select(F.struct(*[text(f.name).alias(f.name) for f in wanted.fields]).alias("_read"), _RAW, "_file")
    typed = F.struct(*[F.col("_read")[f.name].try_cast(f.dataType).alias(f.name) for f in wanted.fields])
    rows = rows.withColumn("_typed", typed)
    reason = F.when(F.col(_RAW).isNotNull(), "fields")
    for f in wanted.fields:
        reason = reason.when(F.col("_read")[f.name].isNotNull() & F.col("_typed")[f.name].isNull(), f"type:{f.name}")
    for name in required:
        reason = reason.when(F.col("_typed")[name].isNull(), f"missing:{name}")
    judged = rows.withColumn("_reason", reason)
    flat = judged.select(*[F.col("_typed")[f.name].alias(f.name) for f in wanted.fields], "_read", _RAW, "_file", "_reason")
    for name, condition in (checks or {}).items():
        flat = flat.withColumn("_reason", F.when(F.col("_reason").isNull() & ~F.coalesce(condition, F.lit(False)), f"check:{name}").otherwise(F.col("_reason")))
    good = flat.where("_reason is null").select(*[f.name for f in wanted.fields])
    rejected = flat.where("_reason is not null").select(*[F.col("_read")[f.name].alias(f.name) for f in wanted.fields], F.col("_reason").alias("reason"),
                                                        F.col(_RAW).alias("record"), F.col("_file").alias("file"))
    return good, rejected


@dataclass(frozen=True)
class SourceStatus:
    """What became of one location: ``read``, ``missing`` or ``unreadable`` (with the first line of the error)."""

    path: str
    status: str
    detail: str = ""


def read_optional_reported(spark: SparkSession, paths: list[str] | str, **kw) -> tuple[DataFrame | None, list[SourceStatus]]:
    """The first location that can be read to its end, or None, and what became of each location tried.

    A location is read through once before it is used, so a file that breaks
    half way (a truncated archive, a broken record of a strict read) counts as
    unreadable and contributes nothing.
    """
    tried = []
    for path in [paths] if isinstance(paths, str) else paths:
        try:
            df = read_articles(spark, path, **kw)
            df.write.format("noop").mode("overwrite").save()
        except AnalysisException as e:
            tried.append(SourceStatus(path, "missing" if _is_missing(e) else "unreadable", "" if _is_missing(e) else str(e).splitlines()[0]))
        except (PySparkException, Py4JJavaError, ValueError) as e:
            tried.append(SourceStatus(path, "unreadable", str(e).splitlines()[0]))
        else:
            return df, [*tried, SourceStatus(path, "read")]
    return None, tried


def _is_missing(e: AnalysisException) -> bool:
    cond = getattr(e, "getCondition", None) or getattr(e, "getErrorClass", None)
    return (cond() if cond else "") == "PATH_NOT_FOUND" or "PATH_NOT_FOUND" in str(e)


def read_first_available(spark: SparkSession, paths: list[str], **kw) -> DataFrame:
    """The first of ``paths`` that exists (any URI Spark can read)."""
    for p in paths:
        try:
            return read_articles(spark, p, **kw)
        except AnalysisException as e:
            if not _is_missing(e):
                raise
    raise FileNotFoundError(f"none of the inputs exists: {paths}")


def read_optional(spark: SparkSession, paths: list[str] | str, **kw) -> DataFrame | None:
    """Like ``read_first_available`` but a missing optional input is None."""
    try:
        return read_first_available(spark, [paths] if isinstance(paths, str) else paths, **kw)
    except FileNotFoundError:
        return None


def load_training_articles(spark: SparkSession, english_fake: str | list[str],
                           english_true: str | list[str], french: str | list[str] | None = None,
                           na_values: tuple[str, ...] | None = DEFAULT_NA_VALUES,
                           report: list[SourceStatus] | None = None) -> DataFrame:
    """English one-class files (required) + optional French file -> articles.

    Raises when an English file is missing or when nothing was loaded.  A
    French file that is missing, cannot be read or has no column ``fake`` is
    left out; a value of ``fake`` that is no number is NULL, and its row is
    kept without a class.  What became of the French locations is appended to
    ``report``; without one, an unreadable file is a warning.
    """
    as_list = lambda p: [p] if isinstance(p, str) else list(p)
    fake = read_first_available(spark, as_list(english_fake), na_values=na_values)
    true = read_first_available(spark, as_list(english_true), na_values=na_values)
    english = A.harmonise_english(fake, true)
    fr = None
    if french is not None:
        raw, tried = read_optional_reported(spark, as_list(french), sep=";", na_values=na_values)
        if report is not None:
            report += tried
        for t in tried:
            if report is None and t.status == "unreadable":
                warnings.warn(f"left out {t.path}: {t.detail}", stacklevel=2)
        if raw is not None and "fake" in raw.columns:
            fr = A.harmonise_french(raw.withColumn("fake", F.col("fake").try_cast("double")))
    out = A.harmonise_articles(A.with_doc_id(A.union_articles(english, fr, allow_missing=True)))
    if out.isEmpty():
        raise ValueError("no article could be loaded")
    return out
