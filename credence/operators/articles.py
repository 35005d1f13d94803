"""Harmonising labelled article sources into one relation.

Canonical relation: ``articles(doc_id, title, text, lang, source, is_fake)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions.labels import to_is_fake
from credence.functions.text import synth_title

ARTICLE_COLUMNS = ("doc_id", "title", "text", "lang", "source", "is_fake")

# Column names of the French source and their canonical names.
FRENCH_RENAMES = {"post": "text", "media": "source"}
FRENCH_LABEL_COLUMN = "fake"
# End of fixed values.


def tag(df: DataFrame, **constants) -> DataFrame:
    """Add constant columns (e.g. ``is_fake=True, lang='en'``)."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns; names absent from ``df`` are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def with_doc_id(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """Attach a row key when a source has none.

    ``monotonically_increasing_id`` is a per-partition counter: stable for
    the same files and split settings, so recomputing a lost partition gives
    the same ids.
    """
    if name in df.columns:
        return df
    return df.withColumn(name, F.monotonically_increasing_id())


def union_articles(*dfs: DataFrame, allow_missing: bool = False) -> DataFrame:
    """UNION ALL by column name (bag semantics, no de-duplication).

    ``allow_missing`` fills columns absent on one side with NULL.
    """
    dfs = [d for d in dfs if d is not None]
    if not dfs:
        raise ValueError("union_articles needs at least one input")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)


def harmonise_english(fake: DataFrame, true: DataFrame) -> DataFrame:
    """Two one-class files -> rows tagged with their class and ``lang='en'``."""
    return union_articles(tag(fake, is_fake=True, lang="en"),
                          tag(true, is_fake=False, lang="en"))


def harmonise_french(df: DataFrame, null_is_true: bool = False) -> DataFrame:
    """``post/media/fake`` -> ``text/source/is_fake``, ``lang='fr'``, synthetic title."""
    out = df
    if FRENCH_LABEL_COLUMN in out.columns:
        out = out.withColumn("is_fake", to_is_fake(FRENCH_LABEL_COLUMN, null_is_true))
    out = tag(out, lang="fr")
    out = rename_columns(out, FRENCH_RENAMES)
    return out.withColumn("title", synth_title("text"))


def harmonise_articles(english: DataFrame, french: DataFrame | None = None) -> DataFrame:
    """English + optional French rows, by name, missing columns -> NULL."""
    out = union_articles(english, french, allow_missing=True)
    types = {"doc_id": "bigint", "is_fake": "boolean"}
    return out.select(*[F.col(c) if c in out.columns
                        else F.lit(None).cast(types.get(c, "string")).alias(c)
                        for c in ARTICLE_COLUMNS])


def scorable(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text is non-empty (whitespace-only text passes)."""
    t = F.col(text_col)
    return df.filter(t.isNotNull() & (F.length(t) > 0))


def label_is(df: DataFrame, value: str, label_col: str = "label") -> DataFrame:
    return df.filter(F.col(label_col) == F.lit(value))


def has_columns(df: DataFrame, *names: str) -> bool:
    """Column-presence test on the schema (metadata only, no job)."""
    return all(n in df.columns for n in names)
