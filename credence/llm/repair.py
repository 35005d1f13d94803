"""Conversation structure repair by a grammar-compressed dynamic program (operator 13).

A conversation is a sequence of symbols, one a row: the class of its role
(system, user, assistant, other) and its fault.  Repair edits rows so that the
roles read ``(s?(ua)+)?``.  One symbol is a 4 x 4 min-plus matrix over the
states (nothing yet, after s, after u, after a); an entry holds the least cost
and the ASCII-least audit among the cheapest.  Sequences repeat over
conversations, so a task compresses its distinct sequences by Re-Pair: the
most frequent pair of neighbours becomes a rule, again and again.  Each rule's
matrix is the product of its two halves' matrices, found once, bottom-up, and
shared by every conversation that uses the rule.  Audits are ropes, so a
product makes no copies of strings.

No two equally cheap audits of the same rows are such that one begins with the
other (the rest would be inserts, which cost), so the smaller of two parts
makes the smaller whole and the order of multiplication does not matter.

Conversations are cut into chunks of ``CHUNK`` rows; the matrices of a
conversation's chunks are multiplied along in a sorted stream, and the same
stream then applies the audit to the rows.  No task holds a whole
conversation, only its audit.

Defined results: a null role or text is one space; a null turn sorts first; rows
of a null conv_id are one conversation, returned with a null conv_id; rows of
one conversation and turn are ordered by the digest of their role and text,
and a repeated row stands next to its original; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.turns import turn_digest, turn_positions

SPACES = "\\x20\\x09-\\x0D"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1      # costs
START, SYSTEM, USER, ASSISTANT = range(4)                    # what the roles so far end with
ACCEPT = (START, ASSISTANT)
ROLES = {"s": 0, "u": 1, "a": 2, "o": 3}                     # role classes; other initials are o
GOES = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),), "o": ()}
LEGAL = {"su", "ua", "au"}
MUST_DELETE = 8                                              # symbol of a blank or duplicate row
CHUNK = 1024

_PRIME = (1 << 128) - 159
_LEAF = 64


class Rope:
    """An immutable string: a leaf, or two ropes one after the other; ``code`` identifies its content."""

    __slots__ = ("code", "left", "right", "size", "text")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is not None:
            self.size, self.code = len(text), int.from_bytes(text.encode(), "big") % _PRIME
        else:
            self.size = left.size + right.size
            self.code = (left.code * pow(256, right.size, _PRIME) + right.code) % _PRIME

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return self if self.size else other
        if self.size + other.size <= _LEAF and self.text is not None and other.text is not None:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def __str__(self) -> str:
        parts, todo = [], [self]
        while todo:
            rope = todo.pop()
            if rope.text is not None:
                parts.append(rope.text)
            else:
                todo += [rope.right, rope.left]
        return "".join(parts)

    def __lt__(self, other: Rope) -> bool:
        mine, its = [self], [other]
        while mine and its:
            a, b = mine.pop(), its.pop()
            if a is b or (a.size == b.size and a.code == b.code):
                continue
            if a.text is None and (b.text is not None or a.size >= b.size):
                mine += [a.right, a.left]
                its.append(b)
            elif b.text is None:
                its += [b.right, b.left]
                mine.append(a)
            else:
                n = min(a.size, b.size)
                if a.text[:n] != b.text[:n]:
                    return a.text[:n] < b.text[:n]
                if a.size > n:
                    mine.append(Rope(a.text[n:]))
                if b.size > n:
                    its.append(Rope(b.text[n:]))
        return bool(its)


Matrix = dict[tuple[int, int], tuple[int, Rope]]


def better(a: tuple[int, Rope] | None, b: tuple[int, Rope]) -> tuple[int, Rope]:
    """The cheaper of two entries; of equally cheap ones the ASCII-least."""
    return b if a is None or b[0] < a[0] or (b[0] == a[0] and b[1] < a[1]) else a


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: first ``a``, then ``b``."""
    out: Matrix = {}
    for (p, r), (cost, audit) in a.items():
        for q in range(4):
            after = b.get((r, q))
            if after is not None:
                known = out.get((p, q))
                if known is None or cost + after[0] <= known[0]:
                    out[p, q] = better(known, (cost + after[0], audit + after[1]))
    return out


def _inserts() -> Matrix:
    """No insert, or inserts along the states without coming back to one."""
    out: Matrix = {}
    for p in range(4):
        state, k = p, 0
        while (p, state) not in out:
            out[p, state] = (k * INSERT, Rope("I" * k))
            state, k = (ASSISTANT if state == USER else USER), k + 1
    return out


INSERTS = _inserts()


def symbol_matrix(symbol: int) -> Matrix:
    """Inserts, then one row kept, reroled or deleted."""
    rows: Matrix = {(p, p): (DELETE, Rope("D")) for p in range(4)}
    if symbol != MUST_DELETE:
        extra = TRUNCATED if symbol >= 4 else 0
        for role in "ua":
            for step in GOES[role]:
                rows[step] = (REROLE + extra, Rope("R"))
        for step in GOES["suao"[symbol % 4]]:
            rows[step] = (KEEP + extra, Rope("K"))
    return times(INSERTS, rows)


SYMBOLS = [symbol_matrix(s) for s in range(9)]


def re_pair(sequences: list[list[int]], first_rule: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(rules, sequences in the rules' symbols): rule i has the symbol ``first_rule + i`` and stands for two symbols."""
    symbols: list[int] = []
    for s in sequences:
        symbols += [*s, -1]
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    for i in range(n - 1):
        if symbols[i] >= 0 and symbols[i + 1] >= 0:
            places.setdefault((symbols[i], symbols[i + 1]), []).append(i)
    heap = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []

    def stands(i: int, pair: tuple[int, int]) -> bool:
        return symbols[i] == pair[0] and after[i] < n and symbols[after[i]] == pair[1]

    while heap:
        count, pair = heapq.heappop(heap)
        at = [i for i in dict.fromkeys(places[pair]) if stands(i, pair)]
        places[pair] = at
        if len(at) < 2:
            continue
        if len(at) < -count:                    # fewer than when it was queued: wait for its turn
            heapq.heappush(heap, (-len(at), pair))
            continue
        rule, touched = first_rule + len(rules), set()
        rules.append(pair)
        for i in at:
            if not stands(i, pair):             # overlaps the one before, as in aaa
                continue
            gone = after[i]
            symbols[i], symbols[gone] = rule, -2
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0 and symbols[j] >= 0 and after[j] < n and symbols[after[j]] >= 0:
                    new = (symbols[j], symbols[after[j]])
                    places.setdefault(new, []).append(j)
                    touched.add(new)
        for new in touched:
            if len(places[new]) > 1:
                heapq.heappush(heap, (-len(places[new]), new))
    short, at = [], 0
    for s in sequences:
        end, now = at + len(s), []
        while at < end:
            now.append(symbols[at])
            at = after[at]
        short.append(now)
        at = end + 1
    return rules, short


def transfers(sequences: list[list[int]]) -> list[Matrix]:
    """The matrix of each sequence of symbols, by the grammar that all of them share."""
    rules, short = re_pair(sequences, len(SYMBOLS))
    matrices = list(SYMBOLS)
    for left, right in rules:
        matrices.append(times(matrices[left], matrices[right]))
    out = []
    for s in short:
        whole: Matrix = {(p, p): (0, Rope("")) for p in range(4)}
        for symbol in s:
            whole = times(whole, matrices[symbol])
        out.append(whole)
    return out


def final(vector: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation, given its matrix."""
    ends = times({k: v for k, v in vector.items() if k[0] == START}, INSERTS)
    best = None
    for q in ACCEPT:
        if (START, q) in ends:
            best = better(best, ends[START, q])
    return best[0], str(best[1])


def edited(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired conversation: ``audit`` applied to its rows (role, text) in order."""
    state, at = START, 0

    def named() -> str:
        return "assistant" if state == USER else "user"

    def inserted() -> Iterator[tuple[str, str, str]]:
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            yield "I", named(), ""
            state, at = (ASSISTANT if state == USER else USER), at + 1

    for role, text in rows:
        yield from inserted()
        edit, at = audit[at], at + 1
        if edit == "D":
            continue
        if edit == "K" and state == START and role[:1] == "s":
            yield edit, role, text
            state = SYSTEM
        else:
            yield edit, (role if edit == "K" else named()), text
            state = ASSISTANT if state == USER else USER
    yield from inserted()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with the faults that crc32 of ``conv_id:turn`` deals them (conv_id, turn, role, text, tie, again)."""
    spaced = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                  *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    dealt = spaced.withColumn("deal", F.crc32(name.cast("binary")) % 20).where("deal <> 0").withColumn("tie", turn_digest())
    copies = F.when(F.col("deal") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return dealt.select("conv_id", "turn", "tie", F.explode(copies).alias("again"),
                        F.when(F.col("deal") == 4, "user").otherwise(F.col("role")).alias("role"),
                        F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"))


ORDER = [lambda: F.col("turn").asc_nulls_first(), lambda: F.col("tie").asc(), lambda: F.col("again").asc()]


def row_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, position, initial (s, u, a, o) and fault (b, d, t or .) of every row; no texts."""
    initial = F.substring("role", 1, 1)
    light = rows.select("conv_id", "turn", "tie", "again", turn_digest().alias("content"),
                        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
                        (~F.col("text").rlike(f"[^{SPACES}]")).alias("blank"), (~F.col("text").rlike(f"[.!?][{SPACES}]*\\z")).alias("cut"))
    placed = turn_positions(light, [f() for f in ORDER])
    firsts = (placed.groupBy(F.col("conv_id").alias("c"), "content").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").drop("n"))
    seen = placed.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (placed["content"] == firsts["content"]), "left")
    fault = F.when(F.col("blank"), "b").when(F.col("position") > F.col("first"), "d").when(F.col("cut"), "t").otherwise(".")
    return seen.select("conv_id", "turn", "position", "initial", fault.alias("fault"))


CHUNKS = ("conv_id long, chunk long, costs array<long>, audits array<string>, blank long, duplicate long, truncated long, illegal long, "
          "ends string, least long, most long, turns long")


def _chunk_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        coded = [tuple(MUST_DELETE if f in "bd" else ROLES[i] + 4 * (f == "t") for i, f in zip(initials, faults, strict=True))
                 for initials, faults in zip(rows["initials"], rows["faults"], strict=True)]
        distinct = list(dict.fromkeys(coded))
        known = dict(zip(distinct, transfers([list(s) for s in distinct]), strict=True))
        listed = {s: ([m[k][0] if (k := (p, q)) in m else None for p in range(4) for q in range(4)],
                      [str(m[k][1]) if (k := (p, q)) in m else None for p in range(4) for q in range(4)]) for s, m in known.items()}
        out = {"conv_id": batch.column("conv_id"), "chunk": batch.column("chunk"), "costs": [listed[s][0] for s in coded], "audits": [listed[s][1] for s in coded]}
        for column, letter in (("blank", "b"), ("duplicate", "d"), ("truncated", "t")):
            out[column] = [f.count(letter) for f in rows["faults"]]
        out["illegal"] = [sum(s[i: i + 2] not in LEGAL for i in range(len(s) - 1)) for s in rows["initials"]]
        out["ends"] = [s[0] + s[-1] for s in rows["initials"]]
        types = {"costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string()), "ends": pa.string()}
        arrays = [v if isinstance(v, pa.Array) else pa.array(v, types.get(k, pa.int64())) for k, v in out.items()]
        arrays += [batch.column(c) for c in ("least", "most", "turns")]
        yield pa.RecordBatch.from_arrays(arrays, names=[*out, "least", "most", "turns"])


def chunk_matrices(faults: DataFrame) -> DataFrame:
    """One row for each chunk of a conversation: its matrix, counts, outer initials and turns."""
    listed = F.array_sort(F.collect_list(F.struct("position", "initial", "fault")))
    chunks = (faults.groupBy("conv_id", F.floor(F.col("position") / CHUNK).alias("chunk"))
              .agg(listed.alias("rows"), F.min("turn").alias("least"), F.max("turn").alias("most"), F.size(F.collect_set("turn")).cast("long").alias("turns")))
    return (chunks.select("conv_id", "chunk", F.array_join("rows.initial", "").alias("initials"), F.array_join("rows.fault", "").alias("faults"),
                          "least", "most", "turns").mapInArrow(_chunk_matrices, CHUNKS))


class _Conversation:
    """What the stream knows of the conversation that it is in."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.matrix = conv_id, {(START, START): (0, Rope(""))}
        self.counts, self.turns, self.least, self.most, self.last = [0, 0, 0, 0], 0, None, None, ""

    def chunk(self, row: dict) -> None:
        step = {(i // 4, i % 4): (c, Rope(a)) for i, (c, a) in enumerate(zip(row["costs"], row["audits"], strict=True)) if c is not None}
        self.matrix = times(self.matrix, step)
        for i, c in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[i] += row[c]
        self.counts[3] += bool(self.last) and self.last + row["ends"][0] not in LEGAL
        self.last = row["ends"][1]
        if row["turns"]:
            self.turns += row["turns"] - (self.most is not None and self.most == row["least"])
            self.least, self.most = row["least"] if self.least is None else self.least, row["most"]

    def summary(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts, *final(self.matrix))


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, Iterator[tuple[str, str]]]]:
    """Each conversation with an iterator of its rows (role, text), which must be used up before the next one."""
    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def texts(conv_id: int | None) -> Iterator[tuple[str, str]]:
        nonlocal row
        while row is not None and row["conv_id"] == conv_id:
            yield row["role"], row["text"]
            row = next(source, None)

    source = rows()
    row = next(source, None)
    while row is not None:
        now = _Conversation(row["conv_id"])
        while row is not None and row["conv_id"] == now.conv_id and row["kind"] < 2:
            if row["kind"] == 1:
                now.chunk(row)
            row = next(source, None)
        yield now, texts(now.conv_id)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for now, texts in _stream(batches):
        summary, digest, join = now.summary(), hashlib.sha256(), ""
        for _, role, text in edited(summary[-1], texts):
            digest.update(f"{join}{role}:{text}".encode())
            join = "\n"
        out.append((*summary, digest.hexdigest()))
        if len(out) == 2000:
            yield _batch(out, [*_TYPES, ("repaired_sha256", pa.string())])
            out = []
    yield _batch(out, [*_TYPES, ("repaired_sha256", pa.string())])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    out: list[tuple] = []
    for now, texts in _stream(batches):
        for place, (edit, role, text) in enumerate(edited(now.summary()[-1], texts)):
            out.append((now.conv_id, place, edit, role, text))
            if len(out) == 2000:
                yield _batch(out, types)
                out = []
    yield _batch(out, types)


_TYPES = [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SUMMARY.split(", ")]


def _batch(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])


def _streams(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Every conversation's id, then its chunk matrices, then its rows, each conversation in one sorted run."""
    chunks = chunk_matrices(row_faults(rows))
    parts = [ids.select("conv_id").distinct().withColumn("kind", F.lit(0)), chunks.withColumn("kind", F.lit(1)), rows.withColumn("kind", F.lit(2))]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    # A conversation's digest reads its rows one after the other; the task holds a batch of them and the audit, never all.
    return (every.repartition("conv_id")
            .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", "chunk", *[f() for f in ORDER]).drop("turn", "tie", "again", "chunk"))


def repair_conversations(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of the repaired form of each conversation of ``ids`` (conv_id).

    ``rows``: conv_id, turn, role, text, tie and again, as from ``damaged``.
    """
    return _streams(rows, ids).mapInArrow(_summaries, f"{SUMMARY}, repaired_sha256 string")


def repaired_turns(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place, edit (K, R or I), role and text of each row."""
    return _streams(rows, ids).mapInArrow(_repaired, "conv_id long, place long, edit string, role string, text string")
