"""Fixed-length token-id encoding with attention mask.

Two encoders, both with begin/end markers, padding and a mask:

* ``encode_fixed``: word tokens by a vocabulary of the corpus, as large as it
  is; truncated to ``max_length``.  Only the first ``max_length - 2`` tokens of
  a document are exploded, so a long document costs at most ``max_length``
  rows and its group stays bounded.
* ``encode_subwords``: byte-level subwords of a given public vocabulary, row by
  row; truncated, or the whole text in windows, which ``decode_subwords`` turns
  back into the text.  Every byte has a token, so no token is unknown.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.operators.ranking import global_positions

# Special ids and the default sequence length.
PAD_ID, UNK_ID, BOS_ID, EOS_ID = 0, 1, 2, 3
FIRST_TERM_ID = 4
DEFAULT_MAX_LENGTH = 512
# End of fixed values.


def encode_fixed(tokens: DataFrame, vocab: DataFrame, max_length: int = DEFAULT_MAX_LENGTH,
                 terms_col: str = "terms") -> DataFrame:
    """(doc_id, n_tokens, input_ids ARRAY<INT>, attention_mask ARRAY<INT>).

    ``vocab`` is (term_id, term); token id = FIRST_TERM_ID + term_id, unknown
    tokens map to UNK_ID.  The planner broadcasts it while it is small and
    joins by a shuffle beyond (a term in a third of all places is skew that
    adaptive execution splits).
    """
    body = max_length - 2
    if body < 0:
        raise ValueError("max_length must leave room for the two markers")
    ids = vocab.select("term", (F.col("term_id") + FIRST_TERM_ID).alias("tid"))
    exploded = tokens.select("doc_id", F.posexplode_outer(F.slice(terms_col, 1, body))
                             .alias("pos", "term"))
    looked = (exploded.join(ids, "term", "left")
              .select("doc_id", "pos",
                      F.when(F.col("term").isNull(), F.lit(None))
                      .otherwise(F.coalesce("tid", F.lit(UNK_ID))).alias("tid")))
    grouped = looked.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "tid"))).alias("_s"))
    seq = F.filter("_s", lambda s: s["tid"].isNotNull())
    core = F.concat(F.array(F.lit(BOS_ID)), F.transform(seq, lambda s: s["tid"]),
                    F.array(F.lit(EOS_ID)))
    n = F.size("_ids")
    pad = F.lit(max_length) - n
    return (grouped.withColumn("_ids", core.cast("array<int>"))
            .select("doc_id", n.cast("int").alias("n_tokens"),
                    F.concat("_ids", F.array_repeat(F.lit(PAD_ID), pad)).alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), pad))
                    .alias("attention_mask")))


def full_vocabulary(tf: DataFrame) -> DataFrame:
    """(term_id, term) of every term of ``tf``, numbered alphabetically by a distributed sort."""
    return global_positions(tf.select("term").distinct(), ["term"], name="position").select(F.col("position").cast("int").alias("term_id"), "term")


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_subwords(docs: DataFrame, path: str, pattern: str, max_length: int = DEFAULT_MAX_LENGTH, whole: bool = False, text_col: str = "text") -> DataFrame:
    """(doc_id, window, n_tokens, input_ids, attention_mask) of every document, row by row.

    ``path``: ranks of a public byte-level vocabulary, present on every
    executor, of V entries; begin, end and padding are the ids V, V + 1 and
    V + 2.  A text is cut to ``max_length - 2`` tokens, or with ``whole`` runs
    on in further windows.  A null text is empty; it has one window.
    """
    body = max_length - 2
    if body < 1:
        raise ValueError("max_length must leave room for the two markers and a token")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        begin, end, pad = (encoding.n_vocab + i for i in range(3))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoding.encode_ordinary(text or "")
                for w, a in enumerate(range(0, max(len(ids), 1) if whole else 1, body)):
                    own = [begin, *ids[a: a + body], end]
                    rows.append((doc, w, len(own), own + [pad] * (max_length - len(own)), [1] * len(own) + [0] * (max_length - len(own))))
                if len(rows) > 1000:
                    yield _windows(rows, batch.schema.field(0).type)
                    rows = []
            yield _windows(rows, batch.schema.field(0).type)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_col).mapInArrow(encode, f"doc_id {kind}, window int, n_tokens int, input_ids array<int>, attention_mask array<int>")


def _windows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    types = (kind, pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "window", "n_tokens", "input_ids", "attention_mask"])


def decode_subwords(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text): the text of each document's windows, in order, without markers and padding."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        for batch in batches:
            parts = [encoding.decode_bytes([i for i in ids if i < encoding.n_vocab]) for ids in batch.column("input_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("window"), pa.array(parts, pa.binary())], names=["doc_id", "window", "part"])
    kind = dict(encoded.dtypes)["doc_id"]
    parts = encoded.select("doc_id", "window", "input_ids").mapInArrow(decode, f"doc_id {kind}, window int, part binary")
    listed = F.array_sort(F.collect_list(F.struct("window", "part")))
    # Bytes are joined before they are read as text: a window may end inside a character.
    return parts.groupBy("doc_id").agg(listed.alias("p")).select("doc_id", F.decode(F.aggregate("p", F.lit(b""), lambda text, p: F.concat(text, p["part"])), "UTF-8").alias("text"))
