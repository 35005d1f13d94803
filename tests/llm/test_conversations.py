"""Operators 11 and 13 against plain versions."""

from __future__ import annotations

import random

import pytest
from plain_conversations import cheapest, exhaustive, repaired, trie

from credence.llm.blocks import import_on_workers
from credence.llm.registry import QUERIES
from credence.llm.repair import ROLES, MUST_DELETE, Rope, damaged, final, re_pair, repair_conversations, repaired_turns, transfers
from credence.llm.trie import panels, prefix_trie, rebuilt

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, position int, kind string, fault string, n int, tie string"


def rows_of(spark, sf_dir=SF):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def table_of(spark, rows):
    """Conversations with extra columns whose names the operators use themselves."""
    import_on_workers(spark)
    return spark.createDataFrame([(*r, 7, "x", "y", 1, "z") for r in rows], SCHEMA)


def key(row):
    return tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in row)


def same(found, expected):
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def odd_rows():
    """Nulls in every column, empty and blank and very long texts, equal turns, repeated rows, one conversation longer than a chunk and a panel."""
    rng = random.Random(5)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a."), (1, 3, None, "b"), (1, 3, "assistant", None), (2, 0, "", ""), (2, 1, " ", " \t"),
            (3, 0, "user", "Long " * 200_000 + "end."), (3, 1, "assistant", "ok!"), (4, 0, "system", "S."), (4, 0, "system", "S."), (4, 0, "user", "S."), (-7, 2, "user", "q?"), (-3, -2, "tool", "é\n.")]
    rows += [(5, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", f"t{t}!"])) for t in range(3000)]
    rows += [(c, t, ["user", "assistant"][t % 2], f"same {t}.") for c in range(10, 40) for t in range(4)]
    rows += [(c, t, ["user", "assistant"][t % 2], f"deep {t}.") for c in (50, 51, 52, 53, 54, 60) for t in range(150 + c)]
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_cheapest_edits_equal_exhaustive_search(seed):
    rng = random.Random(seed)
    for _ in range(25):
        symbols = [(rng.choice("suao"), rng.choice("bdt..")) for _ in range(rng.randrange(4))]
        best = exhaustive(symbols)
        assert cheapest(symbols) == best
        coded = [MUST_DELETE if f in "bd" else ROLES[i] + 4 * (f == "t") for i, f in symbols]
        assert final(transfers([coded])[0]) == best


def test_grammar_gives_the_sequences_back_and_equals_the_plain_program():
    rng = random.Random(3)
    symbols = [[(rng.choice("suuaao"), rng.choice("bdt.....")) for _ in range(rng.choice([0, 1, 2, 7, 8, 300]))] for _ in range(200)]
    coded = [[MUST_DELETE if f in "bd" else ROLES[i] + 4 * (f == "t") for i, f in s] for s in symbols] + [[1, 2] * 60, [1] * 41]
    rules, short = re_pair(coded, 9)

    def expanded(symbol):
        return [symbol] if symbol < 9 else [x for part in rules[symbol - 9] for x in expanded(part)]
    assert [[x for s in line for x in expanded(s)] for line in short] == coded
    assert rules and sum(map(len, short)) < sum(map(len, coded)) / 2
    assert [final(m) for m in transfers(coded)[: len(symbols)]] == [cheapest(s) for s in symbols]


def test_ropes_compare_as_strings():
    rng = random.Random(1)
    made = [Rope(rng.choice("DIKR") * rng.randrange(1, 5)) for _ in range(20)]
    for _ in range(400):
        made.append(rng.choice(made) + rng.choice(made))
    for _ in range(2000):
        a, b = rng.choice(made), rng.choice(made)
        if not str(a).startswith(str(b)) and not str(b).startswith(str(a)):
            assert (a < b) == (str(a) < str(b))


def test_op13_on_the_whole_table(spark):
    same(QUERIES["op13_grammar_repair"](spark, SF).collect(), repaired(rows_of(spark)))


def test_op13_on_odd_rows(spark):
    rows = odd_rows()
    table = table_of(spark, rows)
    found = repair_conversations(damaged(table), table).collect()
    same(found, repaired(rows))
    assert max(len(r.audit) for r in found) > 2048


def test_op13_repaired_rows_are_legal(spark):
    rows = odd_rows()
    table = table_of(spark, rows)
    found = {}
    for r in repaired_turns(damaged(table), table).collect():
        found.setdefault(r.conv_id, []).append((r.place, r.role[:1]))
    import re
    assert found
    for v in found.values():
        assert [p for p, _ in sorted(v)] == list(range(len(v)))
        assert re.fullmatch("s?(ua)+", "".join(i for _, i in sorted(v)))


def test_op13_on_an_empty_table(spark):
    table = table_of(spark, [])
    assert repair_conversations(damaged(table), table).collect() == []


def test_op11_on_the_whole_table(spark):
    same(QUERIES["op11_turn_matrix_trie"](spark, SF).collect(), trie(rows_of(spark)))


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_op11_on_odd_rows(spark, shards, monkeypatch):
    """Nodes split over many shards and panels add up to the same trie."""
    from credence.llm import trie as module
    monkeypatch.setattr(module, "shuffle_width", lambda _: shards)
    rows = odd_rows()
    found = prefix_trie(panels(*rebuilt(table_of(spark, rows)))).collect()
    same(found, trie(rows))


def test_op11_on_an_empty_table(spark):
    assert prefix_trie(panels(*rebuilt(table_of(spark, [])))).collect() == []
