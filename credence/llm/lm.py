"""Masked pseudo-likelihood of documents by a bidirectional window network (operator 7).

Every word is predicted from the ``SIDE`` words on its left and right, never
from itself.  Words are hashed to 16**3 codes; a code is predicted digit by
digit (16 outputs each, given the digits before), so the probabilities add up
to one without a large output layer.  The network starts from the counts: a
digit's logits are the logarithm of its share among the corpus's words with
the same digits before it, plus what the context adds, which is nothing before
training.

Training is in synchronised rounds.  The texts are dealt to the rounds by a
hash; in a round every partition trains a copy of the network in numpy on its
texts of that round, and the copies are averaged by their word counts before
the next one.  Copies are added up in groups first, so the number of weights
that are summed one by one does not grow with the number of partitions.

A word's probability is that of its code times its share of the code, from the
counts of all words of the corpus.  A code keeps a share for words that were
not counted: as much as its words counted once, and one more (Good-Turing),
spread over at least as many unseen words (Chao), so that none of them is
likelier than a word counted once and the shares add up to one.  The counts are
a table that grows with the corpus; a block of documents asks it once for each
of its distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm import arrays as A
from credence.llm.blocks import block_count, materialize
from credence.llm.repeats import BLOCK, binary_column

SIDE, WIDTH, HIDDEN, DIGITS, RADIX = 2, 8, 16, 3, 16
CODES = RADIX ** DIGITS
BATCH, RATE, SEED = 2048, 0.3, 7
SCORED = 4096                           # words scored at once
ROUNDS = 3
GROUP = 64                              # copies that are added up together
COUNTED, ASKED = 8 << 20, 16 << 20      # bytes of text whose words are counted, and asked for, together
SHAPES = {"embed": (CODES + 1, WIDTH), "mix": (2 * SIDE * WIDTH, HIDDEN), "shift": (HIDDEN,),
          "head": (DIGITS, HIDDEN, RADIX), "bias": (DIGITS, RADIX), "digit": (DIGITS - 1, RADIX, HIDDEN)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def codes_of(symbol: np.ndarray) -> np.ndarray:
    return ((symbol >> np.uint64(20)) % np.uint64(CODES)).astype(np.int64)


def windows(w: A.Words) -> tuple[np.ndarray, np.ndarray]:
    """(context codes, code) of each word; places beyond a text hold the code ``CODES``."""
    code = codes_of(w.symbol)
    # The codes of all texts in one line, with SIDE places that hold no word before each text and after the last.
    at = np.arange(len(code)) + SIDE * (1 + np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.first)))
    line = np.full(len(code) + SIDE * len(w.offsets), CODES, dtype=np.int64)
    line[at] = code
    return np.stack([line[at + step] for step in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1), code


def digit_shares(seen: np.ndarray) -> list[np.ndarray]:
    """log share of each digit among the words with the digits before it, from the words counted of each code.

    One table a digit, a row for each run of digits before it; every code has
    one word more than were counted, so no share is 0.
    """
    held = (np.asarray(seen, float) + 1.0).reshape((RADIX,) * DIGITS)
    out = []
    for d in range(DIGITS):
        level = held.sum(axis=tuple(range(d + 1, DIGITS))) if d < DIGITS - 1 else held
        out.append(np.log(level / level.sum(axis=-1, keepdims=True)).reshape(-1, RADIX).astype(np.float32))
    return out


def _summed(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """The sum of the rows of ``values`` that belong to each row number."""
    width = values.shape[1]
    return np.bincount((row[:, None] * width + np.arange(width)).ravel(), weights=values.ravel(), minlength=rows * width).reshape(rows, width)


class Network:
    """``vector``: all weights in one array (by default small random ones, no effect of the context); ``shares``: as from ``digit_shares``."""

    def __init__(self, vector: np.ndarray | None = None, shares: list[np.ndarray] | None = None):
        if vector is None:
            vector = np.random.default_rng(SEED).normal(0, 0.1, SIZE)
            at = sum(int(np.prod(SHAPES[n])) for n in ("embed", "mix", "shift"))
            vector[at: at + int(np.prod(SHAPES["head"])) + int(np.prod(SHAPES["bias"]))] = 0
        self.shares = digit_shares(np.zeros(CODES)) if shares is None else shares
        self.vector = vector.astype(np.float32)
        self.parts, at = {}, 0
        for name, shape in SHAPES.items():
            n = int(np.prod(shape))
            self.parts[name] = self.vector[at: at + n].reshape(shape)
            at += n
        self.squares = np.full(SIZE, 1e-2, dtype=np.float32)

    def forward(self, around: np.ndarray, code: np.ndarray, train: bool = False):
        """log P(code) of every word, and for training what the gradient needs."""
        p, row = self.parts, np.arange(len(code))
        inputs = p["embed"][around].reshape(len(code), -1)
        hidden = np.tanh(inputs @ p["mix"] + p["shift"])
        state, log_p, steps = hidden, np.zeros(len(code)), []
        for d in range(DIGITS):
            digit = code // RADIX ** (DIGITS - 1 - d) % RADIX
            z = state @ p["head"][d] + p["bias"][d] + self.shares[d][code // RADIX ** (DIGITS - d)]
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z)
            total = e.sum(axis=1, keepdims=True)
            log_p += z[row, digit] - np.log(total[:, 0])
            if train:
                steps.append((state, e / total, digit))
            if d < DIGITS - 1:
                state = state + p["digit"][d][digit]
        return log_p, inputs, hidden, steps

    def gradient(self, around: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Of the mean negative log-likelihood of a batch, by all weights."""
        p, n = self.parts, len(code)
        _, inputs, hidden, steps = self.forward(around, code, train=True)
        grad = np.zeros(SIZE, dtype=np.float32)
        g, at = {}, 0
        for name, shape in SHAPES.items():
            size = int(np.prod(shape))
            g[name] = grad[at: at + size].reshape(shape)
            at += size
        back = np.zeros_like(hidden)
        for d in range(DIGITS - 1, -1, -1):
            state, q, digit = steps[d]
            if d < DIGITS - 1:
                g["digit"][d] = _summed(digit, back, RADIX)
            q[np.arange(n), digit] -= 1
            q /= n
            g["head"][d] = state.T @ q
            g["bias"][d] = q.sum(axis=0)
            back += q @ p["head"][d].T
        back *= 1 - hidden ** 2
        g["mix"][...] = inputs.T @ back
        g["shift"][...] = back.sum(axis=0)
        to_inputs = (back @ p["mix"].T).reshape(-1, WIDTH)
        g["embed"][...] = _summed(around.ravel(), to_inputs, CODES + 1)
        return grad

    def train(self, around: np.ndarray, code: np.ndarray) -> None:
        """One Adagrad step on a batch."""
        grad = self.gradient(around, code)
        self.squares += grad * grad
        self.vector -= RATE * grad / np.sqrt(self.squares)


def _train(vector: np.ndarray | None, shares: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        net, seen = Network(vector, shares), 0
        for batch in batches:
            data, offsets = A.text_arrays(batch.column("text"))
            for a, b in A.pieces(offsets):
                around, code = windows(A.Words(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]))
                for i in range(0, len(code), BATCH):
                    net.train(around[i: i + BATCH], code[i: i + BATCH])
                seen += len(code)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // GROUP], pa.int32()), pa.array([seen]), pa.array([(net.vector.astype(np.float64) * seen).tobytes()], pa.binary())],
                                             names=["part", "words", "vector"])
    return run


def _added(table: pa.Table) -> pa.Table:
    """The sum of a group's vectors, each already times its words."""
    total = sum(np.frombuffer(v.as_buffer(), np.float64) for v in table.column("vector").combine_chunks())
    return pa.table({"words": pa.array([sum(table.column("words").to_pylist())], pa.int64()), "vector": pa.array([total.tolist()], pa.list_(pa.float64()))})


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(symbol, word, times) of the distinct words of some texts."""
    w = A.Words(data, offsets)
    symbol, one, times = np.unique(w.symbol, return_index=True, return_counts=True)
    size = w.end[one] - w.start[one]
    return symbol, binary_column(data[A.ranges(w.start[one], size)], np.cumsum(size)), times


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = A.text_arrays(batch.column("text"))
        for a, b in A.pieces(offsets, COUNTED):
            symbol, word, times = _distinct(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([word, pa.array(codes_of(symbol).astype(np.int32)), pa.array(times)], names=["word", "code", "times"])


@dataclass
class Model:
    """``vector``: weights of the network; ``counts``: word, code and times of every word of the corpus;
    ``codes``: for each code the words counted, the share kept for unseen words and the number of those, in words."""

    vector: np.ndarray
    counts: DataFrame
    codes: np.ndarray

    def log_share(self, times: np.ndarray, code: np.ndarray) -> np.ndarray:
        return log_share(self.codes, times, code)


def log_share(codes: np.ndarray, times: np.ndarray, code: np.ndarray) -> np.ndarray:
    """log P(word | code) of words counted ``times`` times; 0 is an unseen word."""
    seen, kept, unseen = codes
    return np.where(times > 0, np.log(np.maximum(times, 1)), np.log(kept / unseen)[code]) - np.log(seen + kept)[code]


def _code_shares(counts: DataFrame) -> np.ndarray:
    seen, once, twice = np.zeros((3, CODES))
    for r in counts.groupBy("code").agg(F.sum("times").alias("seen"), F.count_if(F.col("times") == 1).alias("once"), F.count_if(F.col("times") == 2).alias("twice")).collect():
        seen[r["code"]], once[r["code"]], twice[r["code"]] = r["seen"], r["once"], r["twice"]
    kept = once + 1
    return np.stack([seen, kept, np.maximum(kept, once * (once - 1) / (2 * (twice + 1)))])


def fit(docs: DataFrame, rounds: int = ROUNDS, passes: int = 1, text_col: str = "text") -> Model:
    """The counts of all words, and the network after ``passes`` passes over all texts, each in ``rounds`` synchronised rounds.

    Every text is in one round of a pass, by a hash of the text.  Without any
    word: the start weights.  ``SIZE`` weights and three numbers for each code
    come to the driver, the counts stay a table.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = materialize(texts.mapInArrow(_counted, "word binary, code int, times long").groupBy("word").agg(F.min("code").alias("code"), F.sum("times").alias("times")))
    codes, vector = _code_shares(counts), None
    shares = digit_shares(codes[0])
    for step in range(rounds * passes):
        dealt = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == step % rounds) if rounds > 1 else texts
        copies = dealt.mapInArrow(_train(vector, shares), "part int, words long, vector binary").groupBy("part").applyInArrow(_added, "words long, vector array<double>")
        mean = copies.select("words", F.posexplode("vector").alias("at", "value")).groupBy("at").agg((F.sum("value") / F.sum("words")).alias("value"))
        got = {r["at"]: r["value"] for r in mean.collect()}
        if got:
            vector = np.array([got[i] for i in range(SIZE)])
    return Model(Network(vector).vector, counts, codes)


def _asked(table: pa.Table) -> pa.Table:
    """Each distinct word of a block once."""
    data, offsets = A.text_arrays(table.column("text"))
    symbols, words = [], []
    for a, b in A.pieces(offsets):
        symbol, word, _ = _distinct(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
        symbols.append(symbol)
        words.append(word)
    symbol, one = np.unique(np.concatenate(symbols), return_index=True)
    return pa.table({BLOCK: pa.array(np.full(len(one), table.column(BLOCK)[0].as_py(), np.int32)), "word": pa.chunked_array(words).take(pa.array(one)), "symbol": pa.array(symbol.view(np.int64))})


def _score(vector: np.ndarray, codes: np.ndarray, result: pa.Schema):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        net = Network(vector, digit_shares(codes[0]))
        symbol, times = answers.column("symbol").to_numpy().view(np.uint64), answers.column("times").to_numpy()
        order = np.argsort(symbol)
        symbol, times = symbol[order], times[order]
        data, offsets = A.text_arrays(docs.column("text"))
        sizes, sums = [], []
        for a, b in A.pieces(offsets):
            w = A.Words(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
            around, code = windows(w)
            log_p = np.concatenate([net.forward(around[i: i + SCORED], code[i: i + SCORED])[0] for i in range(0, len(code), SCORED)] or [np.zeros(0)])
            if len(code):
                distinct, which = np.unique(w.symbol, return_inverse=True)          # looked up in order, each once
                log_p = log_p + log_share(codes, times[np.searchsorted(symbol, distinct)][which], code)
            total = np.concatenate([[0.0], np.cumsum(log_p)])
            sizes.append(np.diff(w.first))
            sums.append(total[w.first[1:]] - total[w.first[:-1]])
        n, s = (np.concatenate(x or [np.zeros(0)]) for x in (sizes, sums))
        return pa.table([docs.column("doc_id").cast(result.field("doc_id").type), pa.array(n.astype(np.int64)), pa.array(s), pa.array(np.where(n > 0, s / np.maximum(n, 1), np.nan), mask=n == 0)], schema=result)
    return run


def score_documents(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, pseudo_log_likelihood (sum over all words) and per_word, one row for each input row.

    ``model``: that of ``fit``; by default it is fitted on all of ``docs``.  A
    null or blank text has no word, a sum of 0 and a null per_word.  The
    weights depend on how the texts are partitioned.  Other columns are not
    read; an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    if model is None:
        model = fit(docs, text_col=text_col)
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = base.withColumn(BLOCK, F.pmod(F.xxhash64("doc_id", "text"), F.lit(block_count(base, ASKED))).cast("int")).groupBy(BLOCK)
    asked = blocks.applyInArrow(_asked, f"{BLOCK} int, word binary, symbol long")
    answers = asked.join(model.counts.select("word", "times").hint("shuffle_hash"), "word", "left").select(BLOCK, "symbol", F.coalesce("times", F.lit(0).cast("long")).alias("times"))
    schema = f"doc_id {kind}, n_words long, pseudo_log_likelihood double, per_word double"
    result = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return blocks.cogroup(answers.groupBy(BLOCK)).applyInArrow(_score(model.vector, model.codes, result), schema)
