"""Exact-size seeded samples and train/validation splits.

Rows are ordered by a seeded pseudo-random key ``md5('<seed>:<key>')`` and, for
equal keys, by a hash of the whole row; a null key counts as a value of its
own.  The sample is the first ``n`` rows of that order, the split puts the
first ``ceil(test_size * n)`` in validation.  Only rows equal in every column
tie, and of those as many are taken as are needed, so sizes are exact.

The cut is found in the same way for every ``n``, from the keys alone: one
scan counts keys by the leading digits of their hash, a table of fixed size
that merges by adding; a second scan counts the hashes under the one prefix
that holds the n-th place.  Only if the rows of the key at the cut must be
divided are those rows read whole, and ordered by their row hash in the same
way.  The chosen rows are then a filter and are never gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.session import materialize

# Default seed and validation share.
DEFAULT_SEED = 42
DEFAULT_TEST_SIZE = 0.1
# End of fixed values.

_DIGITS = 5               # hex digits counted in the first scan: 16**5 prefixes, whatever the number of rows
_COARSE = 3               # of which the driver sees 16**3, then 16**2


def hash_key(seed: int | str = DEFAULT_SEED, key_col: str = "doc_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key_col).cast("string"), F.lit("\u0000null"))))


def _row_hash(df: DataFrame) -> Column:
    return F.lpad(F.lower(F.hex(F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]))), 16, "0")


def _nth(counts: list[tuple[str, int]], n: int) -> tuple[str, int, int]:
    """(value, places up to the n-th in it, its rows) where the n-th place falls in the order of the values."""
    for value, rows in sorted(counts):
        if n <= rows:
            return value, n, rows
        n -= rows
    raise AssertionError("the place lies beyond all rows")


class _Cuts:
    """Places in the order of ``value``, a column of hex digits over the rows of ``df``."""

    def __init__(self, df: DataFrame, value: Column):
        self.values = df.select(value.alias("v"))             # only what the value needs is read
        prefixes = self.values.groupBy(F.substring("v", 1, _DIGITS).alias("b")).agg(F.count(F.lit(1)).alias("c"))
        self.prefixes = materialize(prefixes)
        self.coarse = self._pairs(self.prefixes.groupBy(F.substring("b", 1, _COARSE).alias("b")).agg(F.sum("c").alias("c")))
        self.rows = sum(c for _, c in self.coarse)

    @staticmethod
    def _pairs(counts: DataFrame) -> list[tuple[str, int]]:
        return [(r["b"], r["c"]) for r in counts.collect()]

    def at(self, n: int) -> tuple[str, int, int]:
        """(value at the n-th place, how many of its rows belong before the cut, how many rows it has)."""
        lead, n, _ = _nth(self.coarse, n)
        prefix, n, _ = _nth(self._pairs(self.prefixes.where(F.col("b").startswith(lead))), n)
        inside = self.values.where(F.col("v").startswith(prefix)).groupBy(F.col("v").alias("b")).agg(F.count(F.lit(1)).alias("c"))
        return _nth(self._pairs(inside), n)


def _sides(df: DataFrame, cuts: _Cuts, value: Column, n: int, then: Column | None) -> tuple[DataFrame, DataFrame]:
    """(the first n rows by ``value``, the others); rows of equal value are ordered by ``then``."""
    cut, take, rows = cuts.at(n)
    before, after = df.where(value < cut), df.where(value > cut)
    tied = df.where(value == cut)
    if take == rows:
        return df.where(value <= cut), after
    if then is not None:
        mine, others = _sides(tied, _Cuts(tied, then), then, take, None)
    else:                                                      # rows equal in every column: any of them will do
        numbered = tied.withColumn("__nth", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.lit(0))))
        mine, others = numbered.where(F.col("__nth") <= take).drop("__nth"), numbered.where(F.col("__nth") > take).drop("__nth")
    return before.unionByName(mine), others.unionByName(after)


def sample_exact(df: DataFrame, n: int | None, seed: int = DEFAULT_SEED,
                 key_col: str = "doc_id") -> DataFrame:
    """Exactly ``min(n, rows)`` rows, chosen by the seeded order; ``None`` or 0 = no cap, all rows."""
    if not n:
        return df
    key = hash_key(seed, key_col)
    cuts = _Cuts(df, key)
    return df if cuts.rows <= n else _sides(df, cuts, key, n, _row_hash(df))[0]


def validation_size(n: int, test_size: float = DEFAULT_TEST_SIZE) -> int:
    """ceil(test_size * n) in floating point, like the usual split helpers."""
    return int(math.ceil(test_size * n))


def split_exact(df: DataFrame, test_size: float = DEFAULT_TEST_SIZE, seed: int = DEFAULT_SEED,
                key_col: str = "doc_id", n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, validation) with |validation| = ceil(test_size * n), disjoint, covering."""
    key = hash_key(seed, key_col)
    cuts = _Cuts(df, key)
    n = cuts.rows if n is None else n
    m = validation_size(n, test_size)
    if n - m <= 0:
        raise ValueError(f"split of {n} rows leaves no training rows")
    if m == 0:
        return df, df.limit(0)
    if cuts.rows < m:
        raise ValueError(f"fewer than {m} rows to choose from")
    mine, others = _sides(df, cuts, key, m, _row_hash(df))
    return others, mine
