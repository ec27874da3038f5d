"""Interval parsing against enumeration of all edits, a whole chart and a row-by-row search."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from mailglass.llm import conversation_repair as cr
from mailglass.llm.queries import repaired

SHAPE = "conv_id long, turn long, role string, text string"
FORM = re.compile("(s?(ua)+)?")


def all_edits(codes):
    """Cheapest (cost, audit) of every way to edit the rows, up to two insertions at a place."""
    inserts = [""] + ["".join(x) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    options = []
    for code in codes:
        own = [(3, "D", "")]
        if code != "x":
            extra = code.isupper()
            own += [(extra, "K", code.lower()), (2 + extra, "R", "u"), (2 + extra, "R", "a")]
        options.append(own)
    best = None
    for chosen in itertools.product(*options):
        for gaps in itertools.product(inserts, repeat=len(codes) + 1):
            cost = sum(c[0] for c in chosen) + 2 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            form = gaps[0] + "".join(c[2] + g for c, g in zip(chosen, gaps[1:]))
            if FORM.fullmatch(form):
                audit = "I" * len(gaps[0]) + "".join(c[1] + "I" * len(g) for c, g in zip(chosen, gaps[1:]))
                best = min(best or (cost, audit), (cost, audit))
    return best


def best_of(cell):
    return min(cell[0, q] for q in cr.ENDS if (0, q) in cell)


def test_cells_against_all_edits():
    draw = random.Random(5)
    cases = {"".join(draw.choice("suaoSUAOx") for _ in range(draw.randint(1, 3))) for _ in range(60)}
    for codes in sorted(cases):
        assert best_of(cr.parse(codes)) == all_edits(codes), codes


def test_spans_by_length_equal_a_whole_chart():
    """All spans and all splits give no other cell than the spans of doubled length."""
    draw = random.Random(6)
    for n in (2, 5, 9, 16, 21):
        codes = "".join(draw.choice("ssuuaaoUAx") for _ in range(n))
        chart = {(i, i + 1): cr.leaf(c) for i, c in enumerate(codes)}
        for length in range(2, n + 1):
            for i in range(n - length + 1):
                cell = {}
                for split in range(i + 1, i + length):
                    for way, found in cr.combine(chart[i, split], chart[split, i + length]).items():
                        cell[way] = min(cell.get(way, found), found)
                chart[i, i + length] = cell
        assert chart[0, n] == cr.parse(codes)


def stepwise(codes):
    """Row by row over the states, insertions as moves of their own."""
    def close(cells):
        for _ in range(3):
            for (cost, audit), p in [(v, k) for k, v in cells.items()]:
                for role in "ua":
                    if p in cr.STEPS[role]:
                        q = cr.STEPS[role][p]
                        cells[q] = min(cells.get(q, (9e9, "")), (cost + 2, audit + "I"))
        return cells

    cells = close({0: (0, "")})
    for code in codes:
        after = {}
        for p, (cost, audit) in cells.items():
            moves = [(3, "D", p)]
            if code != "x":
                moves += [(code.isupper(), "K", q) for q in [cr.STEPS[code.lower()].get(p)] if q is not None]
                moves += [(2 + code.isupper(), "R", cr.STEPS[r][p]) for r in "ua" if p in cr.STEPS[r]]
            for extra, edit, q in moves:
                after[q] = min(after.get(q, (9e9, "")), (cost + extra, audit + edit))
        cells = close(after)
    return min(cells[q] for q in cr.ENDS if q in cells)


def expected(rows):
    """Faults, digests and edits of one conversation's rows, in order, in plain Python."""
    seen, codes, faults = set(), "", []
    for turn, role, text in rows:
        last = text.rstrip(cr.BLANKS)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
        i = role[:1] if role[:1] and role[:1] in "sua" else "o"
        codes += "x" if fault in ("blank", "duplicate") else i.upper() if fault == "truncated" else i
    initials = [r[:1] if r[:1] in ("s", "u", "a") else "o" for _, r, _ in rows]
    cost, audit = stepwise(codes)
    left = len(audit) - audit.count("D")
    lines, at = [], 0
    for edit in audit:
        if edit != "D":
            left -= 1
            role = rows[at][1] if edit == "K" else "assistant" if left % 2 == 0 else "user"
            lines.append(f"{role}:{'' if edit == 'I' else rows[at][2]}")
        at += edit != "I"
    turns = [t for t, _, _ in rows if t is not None]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in cr.LEGAL for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
            "sha": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def compare(frame, rows):
    """``repair`` on rows whose order within a turn is that of role and MD5."""
    wide = frame.withColumns({c: F.lit("clash") for c in ("at", "block", "part", "begin", "cost", "audit", "code")})
    found, edits = cr.repair(wide)
    shas = {r.conv_id: r.sha256 for r in cr.digests(edits).collect()}
    got = {r.conv_id: r.asDict() for r in found.collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert set(got) == set(by)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        want = expected(own)
        sha = want.pop("sha")
        assert {k: got[conv][k] for k in want} == want, conv
        assert shas.get(conv, hashlib.sha256(b"").hexdigest()) == sha, conv


def test_repair_of_odd_rows(make):
    long = "word " * 60_000 + "."
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "Cut off"), (1, 7, None, None), (1, None, "user", "No turn."),
            (2, None, "assistant", "A."), (2, None, "assistant", "A."), (None, 3, "user", "Who?"), (None, 4, "Assistant", "What?"), (3, 0, "user", " \t\n\x0b"), (3, 0, "", "Empty role."),
            (4, 0, "user", long), (4, 1, "assistant", long), (5, 5, "tool", "x"), (6, 0, "system", "Only."), (7, 1, "user", "Ü字!"), (7, 0, "assistant", "Ça va?\r\n")]
    compare(make(rows, SHAPE), rows)


def test_one_conversation_over_many_blocks(spark, make):
    """Over 4 096 rows of one conversation: three levels of spans, and short ones across the blocks' borders."""
    draw = random.Random(7)
    ways = [("user", 40), ("assistant", 40), ("system", 3), ("bot", 3)]
    names, weights = zip(*ways)
    rows = [(8, i // 2, *draw.choices(names, weights), f"t{draw.randrange(3000)}" + draw.choice(["", ".", "!", ".", "."])) for i in range(4500)]
    rows += [(100 + c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(60) for t in range(draw.randint(1, 9))]
    draw.shuffle(rows)
    compare(make(rows, SHAPE).repartition(7), rows)


def test_damage_and_digest(spark, make):
    draw = random.Random(8)
    rows = [(c, t, ("user", "assistant")[t % 2] if t or c % 3 else "system", f"{c} says {t}." + "!" * draw.randint(0, 2)) for c in range(240) for t in range(draw.randint(1, 6) if c % 2 else 1)] + [(None, None, None, None)]
    damaged = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out = damaged.setdefault(conv, [])
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    got = {r.conv_id: r.asDict() for r in repaired(make(rows, SHAPE)).collect()}
    assert set(got) == set(damaged) and any(not v for v in damaged.values())
    for conv, own in damaged.items():
        want = expected(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0)))
        want["repaired_sha256"] = want.pop("sha")
        assert {k: got[conv][k] for k in want} == want, conv


def test_empty_table(make):
    assert repaired(make([], SHAPE)).collect() == []


@pytest.mark.parametrize("codes", ["x", "xx", "s", "S", "o", "a", "ua", "su"])
def test_by_hand(codes):
    want = {"x": (3, "D"), "xx": (6, "DD"), "s": (3, "D"), "S": (3, "D"), "o": (3, "D"), "a": (2, "IK"), "ua": (0, "KK"), "su": (2, "KKI")}
    assert best_of(cr.parse(codes)) == want[codes]
