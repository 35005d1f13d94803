"""Prefix trie of conversations by padded turn-id matrices (operator 11).

Turns become ids (128 bits of the SHA-256 of role and text).  Conversations
are rows of ids, cut into panels of ``PANEL`` turns; a panel knows the key of
the turns before it, a chain of hashes.  Panels are dealt by ranges of
(panel, key before, ids, conv_id) into shards of bounded size, so a group of
copies, however large, is split by conv_id.

A shard is one padded matrix.  ``numpy.lexsort`` orders it, the differences of
neighbouring rows, accumulated by OR along the columns, mark where the nodes
of every depth start, and ``reduceat`` over the starts adds up each depth.
Every quantity is a sum over rows: a subtree's leaves are the rows whose
successor does not continue them, and its saved tokens are the bytes of the
cells that do not start a node.  So the pieces of a node that several shards
(or panels) hold simply add up.  Only such nodes, those on the path of a
shard's first or last row or with turns in a further panel, are recombined by
key; all others are finished where they are.  Where two shards meet, the
first row of the second is corrected by the part that it shares with the last
row of the first.

Defined results: rows without conv_id belong to no conversation and are left
out; a null role or text is empty; a null turn sorts first, rows of equal
turns are ordered by their ids, and repeated rows are turns of their own; an
empty table has no root and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.llm import arrays as A
from credence.llm.blocks import materialize, shuffle_width
from credence.llm.turns import turn_digest, turn_positions

PANEL = 64
SHARD_PANELS = 20_000
ROOT = bytes(16)
HEAD, GROUP, CHECKS = 8, 5, 9       # rebuilt: the first crc32 % 9 (at most 8) turns come from the first conversation of five
_SALT_ROWS = 4096
_LONG = ("depth", "conv_id", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_tokens", "panel", "shard")
RECORD = ("kind string, key binary, parent binary, ends binary, ends_sha256 string, path array<binary>, bytes array<long>, leaf boolean, last boolean, "
          + ", ".join(f"{c} long" for c in _LONG))
EMPTY = hashlib.sha256(b"").hexdigest()


def further(key: bytes, turn: bytes) -> bytes:
    """The key of a sequence with one more turn."""
    return hashlib.sha256(key + turn).digest()[:16]


def ranks(values: pa.ChunkedArray) -> tuple[np.ndarray, list[bytes]]:
    """Each value's rank among the distinct values, and these in order."""
    coded = pa.concat_arrays(values.chunks).dictionary_encode() if values.num_chunks else pa.array([], pa.binary()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    order = sorted(range(len(distinct)), key=distinct.__getitem__)
    rank = np.empty(len(distinct), np.int64)
    rank[order] = np.arange(len(distinct))
    return rank[coded.indices.to_numpy()], [distinct[i] for i in order]


class Shard:
    """The sorted matrix of a range of panels, with the marks of its nodes."""

    def __init__(self, table: pa.Table):
        conv, panel = table["conv_id"].to_numpy(), table["panel"].to_numpy()
        more = table["more"].to_numpy()
        prefix, self.prefixes = ranks(table["prefix"])
        length = pc.list_value_length(table["ids"]).to_numpy().astype(np.int64)
        code, self.turns = ranks(pc.list_flatten(table["ids"]))
        width = int(length.max(initial=0))
        row, column = np.repeat(np.arange(len(length)), length), A.ranges(np.zeros(len(length), np.int64), length)
        matrix, size = np.full((len(length), width), -1, np.int64), np.zeros((len(length), width), np.int64)
        matrix[row, column] = code
        size[row, column] = pc.list_flatten(table["bytes"]).to_numpy()
        order = np.lexsort((conv, more, *matrix.T[::-1], prefix, panel))
        self.conv, self.panel, self.more, self.prefix, self.length = conv[order], panel[order], more[order], prefix[order], length[order]
        self.matrix, self.size, self.width = matrix[order], size[order], width
        changed = np.ones((len(order), width + 1), bool)
        changed[1:, 0] = (self.panel[1:] != self.panel[:-1]) | (self.prefix[1:] != self.prefix[:-1])
        changed[1:, 1:] = self.matrix[1:] != self.matrix[:-1]
        np.logical_or.accumulate(changed, axis=1, out=changed)
        self.valid = self.length[:, None] >= np.arange(width + 1)
        self.start = changed & self.valid
        self.leaf = ~self.more
        self.leaf[:-1] &= changed[np.arange(1, len(order)), self.length[:-1]]
        shared = np.where(self.start[:, 1:], 0, self.size)
        self.saved = np.zeros((len(order), width + 1), np.int64)      # bytes of the cells from a depth on that start no node
        self.saved[:, :width] = np.cumsum(shared[:, ::-1], axis=1)[:, ::-1]
        self.saved[:, 1:] = self.saved[:, :-1].copy()
        self.paths: dict[int, list[bytes]] = {}

    def path(self, row: int, depth: int | None = None) -> list[bytes]:
        """Keys of the row's first 0, 1, .. ``depth`` turns of this panel."""
        keys = self.paths.setdefault(row, [self.prefixes[self.prefix[row]]])
        depth = int(self.length[row]) if depth is None else depth
        while len(keys) <= depth:
            keys.append(further(keys[-1], self.turns[self.matrix[row, len(keys) - 1]]))
        return keys[: depth + 1]

    def nodes(self) -> Iterator[dict[str, np.ndarray]]:
        """The nodes of each depth as columns: first row, whether open, and their sums."""
        last = len(self.conv) - 1
        for d in range(self.width + 1):
            first = np.flatnonzero(self.start[:, d])
            if not len(first):
                return
            own = self.valid[:, d]

            def added(values: np.ndarray, first=first, own=own) -> np.ndarray:
                return np.add.reduceat(np.where(own, values, 0).astype(np.int64), first)
            inside = (self.panel > 0) if d == 0 else np.zeros(len(own), bool)     # the panel before has these nodes' own sums
            opened = (first == 0) | (added(self.more) > 0) | inside[first]
            if own[last]:
                opened[-1] = True
            yield {"depth": self.panel[first] * PANEL + d, "first": first, "open": opened, "inner": inside[first],
                   "conv_id": np.minimum.reduceat(np.where(own, self.conv, np.iinfo(np.int64).max), first),
                   "n_convs": added(~inside), "n_children": added(self.start[:, d + 1]) if d < self.width else np.zeros(len(first), np.int64),
                   "n_leaves": added(self.leaf & ~inside), "saved_tokens": added(np.where(inside, 0, self.saved[:, max(d, 1) if self.width else 0])),
                   "n_ends": added((self.length == d) & ~self.more)}


def _records(shard: Shard, number: int) -> Iterator[pa.RecordBatch]:
    above = None
    for d, level in enumerate(shard.nodes()):
        first, opened, n = level["first"], level["open"], len(level["first"])
        up = np.searchsorted(above["first"], first, side="right") - 1 if d else None
        below_open = above["open"][up] if d else np.zeros(n, bool)
        ids = [",".join(map(str, shard.conv[a: a + k].tolist())).encode() if k else None for a, k in zip(first.tolist(), level["n_ends"].tolist(), strict=True)]
        named = opened | below_open
        paths = [shard.path(int(r), d) if x else None for r, x in zip(first, named, strict=True)]
        known = ~below_open & (d > 0)
        yield _rows({
            "kind": ["part" if x else "node" for x in opened], "key": [p[d] if x else None for p, x in zip(paths, opened, strict=True)],
            "parent": [p[d - 1] if x else None for p, x in zip(paths, below_open, strict=True)],
            "ends": [e if x else None for e, x in zip(ids, opened, strict=True)],
            "ends_sha256": [None if x else EMPTY if e is None else hashlib.sha256(e).hexdigest() for e, x in zip(ids, opened, strict=True)],
            "depth": level["depth"], "conv_id": pa.array(level["conv_id"], mask=level["inner"]),
            "parent_conv": pa.array(above["conv_id"][up] if d else np.zeros(n, np.int64), mask=~known),
            **{c: level[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}}, n, number)
        above = level
    edge = [0, len(shard.conv) - 1]
    yield _rows({"kind": ["edge"] * 2, "path": [shard.path(r) for r in edge], "bytes": [shard.size[r, : shard.length[r]].tolist() for r in edge],
                 "leaf": shard.leaf[edge], "last": [False, True], "conv_id": shard.conv[edge], "panel": shard.panel[edge]}, 2, number)
    later = np.flatnonzero(shard.panel > 0)
    yield _rows({"kind": ["later"] * len(later), "conv_id": shard.conv[later], "panel": shard.panel[later], "n_leaves": shard.leaf[later].astype(np.int64),
                 "saved_tokens": shard.saved[later, 1 if shard.width else 0]}, len(later), number)
    more = np.flatnonzero(shard.more)
    yield _rows({"kind": ["more"] * len(more), "conv_id": shard.conv[more], "panel": shard.panel[more], "path": [shard.path(int(r)) for r in more]}, len(more), number)


_TYPES = {"binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}


def _rows(columns: dict, n: int, shard: int) -> pa.RecordBatch:
    columns["shard"] = np.full(n, shard, np.int64)
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [_TYPES[c.split()[1]] for c in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.nulls(n, k) if (v := columns.get(c)) is None else v if isinstance(v, pa.Array) else pa.array(v, k)
                                       for c, k in zip(names, kinds, strict=True)], names=names)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    held = [b for b in batches if b.num_rows]
    if held:
        yield from _records(Shard(pa.Table.from_batches(held)), TaskContext.get().partitionId())


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Panels of long conversations, sorted, with the key of the turns before them."""
    conv, key = None, ROOT
    for batch in batches:
        before = []
        for c, ids in zip(batch.column("conv_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if c != conv:
                conv, key = c, ROOT
            before.append(key)
            for turn in ids:
                key = further(key, turn)
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([pa.array(before, pa.binary()) if c == "prefix" else batch.column(c) for c in names], names=names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces of ids, comma-joined; sorted by (key, shard), one piece held at a time."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k, ends in zip(batch.column("key").to_pylist(), batch.column("ends"), strict=True):
            if k != key:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ends.as_py())
            else:
                digest.update(b"," + ends.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["key", "hash"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "hash"])


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, lengths) of the rebuilt conversations.

    cells: conv_id, place, id, bytes, total of every turn; lengths: conv_id,
    total of every conversation, turnless ones included.  A conversation's own
    turns meet its one row of lengths in slices of ``_SALT_ROWS`` turns.
    """
    light = (conversations.where("conv_id is not null")
             .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
             .select("conv_id", "turn", turn_digest().alias("id"), F.octet_length("text").cast("long").alias("bytes")))
    placed = turn_positions(light, [F.col("turn").asc_nulls_first(), F.col("id").asc()]).select("conv_id", "position", "id", "bytes")
    sizes = (placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % CHECKS).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP))
    bases = sizes.where(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("n_base"))
    sizes = materialize(sizes.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
                        .withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    slices = sizes.select("conv_id", "h", "taken", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _SALT_ROWS))).alias("slice"))
    own = (placed.withColumn("slice", F.floor(F.col("position") / _SALT_ROWS)).join(slices, ["conv_id", "slice"]).where("position >= h")
           .select("conv_id", (F.col("taken") + F.col("position") - F.col("h")).alias("place"), "id", "bytes", "total"))
    heads = placed.where((F.col("position") < HEAD) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    head = heads.join(sizes.select("conv_id", "base", "taken", "total"), "base").where("position < taken").select("conv_id", F.col("position").alias("place"), "id", "bytes", "total")
    return own.unionByName(head), sizes.select("conv_id", "total")


def panels(cells: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, panel, prefix, ids, bytes and more (whether a further panel follows) of every ``PANEL`` turns."""
    listed = F.array_sort(F.collect_list(F.struct("place", "id", "bytes")))
    cut = (cells.groupBy("conv_id", F.floor(F.col("place") / PANEL).alias("panel")).agg(listed.alias("t"), F.max("total").alias("total"))
           .select("conv_id", "panel", F.lit(ROOT).alias("prefix"), F.col("t.id").alias("ids"), F.col("t.bytes").alias("bytes"),
                   (F.col("total") > (F.col("panel") + 1) * PANEL).alias("more"), "total"))
    none = lengths.where("total = 0").select("conv_id", F.lit(0).cast("long").alias("panel"), F.lit(ROOT).alias("prefix"), F.array().cast("array<binary>").alias("ids"),
                                             F.array().cast("array<long>").alias("bytes"), F.lit(False).alias("more"))
    long = cut.where(F.col("total") > PANEL).drop("total").repartition("conv_id").sortWithinPartitions("conv_id", "panel")
    return (cut.where(F.col("total") <= PANEL).drop("total").unionByName(none)
            .unionByName(long.mapInArrow(_chained, "conv_id long, panel long, prefix binary, ids array<binary>, bytes array<long>, more boolean")))


def _corrections(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by node, by panel): what the first row of a shard shares with the last row of the shard before."""
    edges = records.where("kind = 'edge'")
    first = edges.where("not last").select("shard", "path", "bytes", "conv_id", "panel")
    before = F.lag("shard").over(Window.orderBy("shard"))       # one number for each shard
    last = edges.where("last").select(F.col("shard").alias("before"), F.col("path").alias("path_before"), F.col("leaf").alias("leaf_before"), F.col("conv_id").alias("conv_before"))
    met = (first.join(first.select("shard", before.alias("before")), "shard").join(last, "before")
           .withColumn("shared", F.size(F.array_intersect("path", "path_before"))).where("shared > 0")
           .withColumn("lost", F.when(F.col("leaf_before") & (F.col("shared") == F.size("path_before")), -1).otherwise(0)))

    def cells(start):
        start = F.greatest(start, F.lit(1))
        return F.aggregate(F.slice("bytes", start, F.greatest(F.col("shared") - start, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    inner = (F.col("panel") > 0) & (F.col("d") == 0)
    nodes = met.select("*", F.posexplode(F.slice(F.col("path"), F.lit(1), F.col("shared"))).alias("d", "key")).select(
        "key", F.when(F.col("d") < F.col("shared") - 1, -1).otherwise(0).alias("n_children"), F.when(inner, 0).otherwise(F.col("lost")).alias("n_leaves"),
        F.when(inner, 0).otherwise(cells(F.col("d"))).alias("saved_tokens"))
    later = met.where("panel > 0")
    rows = (later.select("conv_id", "panel", F.lit(0).alias("n_leaves"), cells(F.lit(1)).alias("saved_tokens"))
            .unionByName(later.select(F.col("conv_before").alias("conv_id"), "panel", F.col("lost").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))))
    return nodes, rows


def prefix_trie(panel_rows: DataFrame) -> DataFrame:
    """All nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    panel_rows = materialize(panel_rows)
    shards = max(shuffle_width(panel_rows.sparkSession), -(-panel_rows.count() // SHARD_PANELS))
    records = materialize(panel_rows.repartitionByRange(shards, "panel", "prefix", "ids", "more", "conv_id").mapInArrow(_shards, RECORD))
    by_node, by_panel = _corrections(records)
    sums = ["n_children", "n_leaves", "saved_tokens"]

    deeper = Window.partitionBy("conv_id").orderBy(F.col("panel").desc()).rowsBetween(Window.unboundedPreceding, 0)
    below = (records.where("kind = 'later'").select("conv_id", "panel", "n_leaves", "saved_tokens").unionByName(by_panel)
             .groupBy("conv_id", "panel").agg(*[F.sum(c).alias(c) for c in sums[1:]])
             .select("conv_id", (F.col("panel") - 1).alias("panel"), *[F.sum(c).over(deeper).alias(c) for c in sums[1:]]))
    more = records.where("kind = 'more'").select("conv_id", "panel", "path")
    carried = (more.join(below, ["conv_id", "panel"])
               .select(F.explode(F.when(F.col("panel") == 0, F.col("path")).otherwise(F.slice("path", 2, PANEL))).alias("key"), F.lit(0).alias("n_children"), *sums[1:]))

    part = records.where("kind = 'part'")
    pieces = part.select("key", "parent", "depth", "conv_id", "n_convs", *sums, "shard")
    for extra in (by_node, carried):
        pieces = pieces.unionByName(extra, allowMissingColumns=True)
    ends = (part.where("ends is not null").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
            .mapInArrow(_hashed, "key binary, hash string"))
    whole = (pieces.groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
                                       F.sum("n_convs").alias("n_convs"), *[F.sum(c).alias(c) for c in sums],
                                       F.min(F.when(F.col("parent").isNotNull(), F.col("shard"))).alias("shard"))
             .join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("hash", F.lit(EMPTY))).drop("hash"))
    whole = materialize(whole)
    # A parent that was recombined is looked up by (shard, key): no key has more rows than a shard has nodes.
    parents = (part.select("shard", "key").distinct().join(whole.select("key", F.col("conv_id").alias("parent_conv_id")), "key")
               .withColumnRenamed("key", "parent"))
    shape = ["conv_id", "depth", "parent_conv_id", "n_convs", *sums, "ends_sha256"]
    node = records.where("kind = 'node'")
    asked = node.where("parent is not null").drop("key").unionByName(whole.where("parent is not null").drop("key"), allowMissingColumns=True)
    return (node.where("parent is null").withColumnRenamed("parent_conv", "parent_conv_id").select(*shape)
            .unionByName(asked.join(parents, ["shard", "parent"]).select(*shape))
            .unionByName(whole.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*shape)))
