"""Plain versions of the conversation operators, by their contracts, for small tables."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]")


def tie(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def grouped(rows):
    """{conv_id: its rows (turn, role, text) by turn, nulls first, then by digest}, None replaced by ``blank``."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, role, text))
    for v in out.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1], r[2])))
    return out


# --- repair

def cheapest(symbols):
    """(cost, audit) by a table over (row, state) that keeps whole strings; no grammar, no matrices."""
    def better(a, b):
        return b if a is None or b < a else a

    def insert(states):
        for _ in range(3):
            for p, q in ((0, 2), (1, 2), (3, 2), (2, 3)):
                if p in states:
                    states[q] = better(states.get(q), (states[p][0] + 2, states[p][1] + "I"))
        return states

    states = insert({0: (0, "")})
    for initial, fault in symbols:
        now = {}
        for p, (c, a) in states.items():
            now[p] = better(now.get(p), (c + 3, a + "D"))
            if fault in "bd":
                continue
            extra = fault == "t"
            for q in range(1, 4):
                role = {1: "s", 2: "u", 3: "a"}[q]
                if (p, q) in {(0, 1), (0, 2), (1, 2), (3, 2), (2, 3)}:
                    if initial == role:
                        now[q] = better(now.get(q), (c + extra, a + "K"))
                    if role != "s":
                        now[q] = better(now.get(q), (c + 2 + extra, a + "R"))
        states = insert(now)
    return min(states[q] for q in (0, 3) if q in states)


def exhaustive(symbols, most_inserts=4):
    """(cost, audit) by trying every sequence of edits; for very short conversations."""
    best = None
    for k in range(most_inserts + 1):
        for ops in itertools.product("KRD", repeat=len(symbols)):
            for at in itertools.combinations(range(len(symbols) + k), k):
                edits, rest = [], iter(range(len(symbols)))
                for i in range(len(symbols) + k):
                    edits.append(("I", None) if i in at else (ops[(j := next(rest))], j))
                for choice in itertools.product("ua", repeat=sum(e in "RI" for e, _ in edits)):
                    cost, roles, chosen = 0, "", iter(choice)
                    for e, j in edits:
                        if e == "I":
                            cost, roles = cost + 2, roles + next(chosen)
                        elif e == "D":
                            cost += 3
                        else:
                            cost += symbols[j][1] == "t"
                            if symbols[j][1] in "bd":
                                cost += 1000
                            if e == "R":
                                cost, roles = cost + 2, roles + next(chosen)
                            else:
                                roles += symbols[j][0]
                    if re.fullmatch("(s?(ua)+)?", roles):
                        entry = (cost, "".join(e for e, _ in edits))
                        best = entry if best is None else min(best, entry)
    return best


def repaired(rows):
    """One result row for each conversation of ``rows`` (conv_id, turn, role, text), by the contract."""
    rows = list(rows)
    out = []
    spaced = grouped((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows)
    for conv, turns in spaced.items():
        kept = []
        for turn, role, text in turns:
            deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if deal == 0:
                continue
            text = "" if deal == 1 else re.sub("[.!?]", "", text) if deal == 2 else text
            role = "user" if deal == 4 else role
            kept += [(turn, role, text)] * (2 if deal == 3 else 1)
        seen, symbols = set(), []
        for turn, role, text in kept:
            solid = NOT_SPACE.findall(text)
            fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "."
            seen.add((role, text))
            symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "o", fault))
        numbers = {t for t, _, _ in kept if t is not None}
        cost, audit = cheapest(symbols)
        lines, state, rest = [], "", iter(kept)
        for e in audit:
            role, text = ("", "") if e == "I" else next(rest)[1:]
            if e == "D":
                continue
            if e == "K" and not state and role[:1] == "s":
                state = "s"
            else:
                state = "a" if state == "u" else "u"
                if e != "K":
                    role = {"u": "user", "a": "assistant"}[state]
            lines.append(f"{role}:{text}")
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *[sum(f == x for _, f in symbols) for x in "bdt"],
                    sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(symbols)), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


# --- prefix trie

def trie(rows):
    """One result row for each node of the trie of rebuilt conversations, by the contract."""
    turns = grouped((c, t, r or "", x or "") for c, t, r, x in rows if c is not None)
    turns = {c: [(r, x) for _, r, x in v] for c, v in turns.items()}
    members, ends = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(rebuilt) + 1):
            members.setdefault(rebuilt[:d], []).append(c)
        ends.setdefault(rebuilt, []).append(c)
    leaves, saved, children = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = leaves.get(node, 0) or 1
        saved[node] = saved.get(node, 0) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        if node:
            up = node[:-1]
            leaves[up], saved[up], children[up] = leaves.get(up, 0) + leaves[node], saved.get(up, 0) + saved[node], children.get(up, 0) + 1
    return [(min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children.get(node, 0), leaves[node], saved[node],
             hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()) for node, m in members.items()]
