"""Against all edit sequences of short conversations; damage, odd rows, and the repaired turns themselves."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from pagewright.llm import conversations as C

ROWS = "conv_id bigint, turn bigint, role string, text string, copies bigint"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def _order(t):
    return (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode())


def _told(rows):
    """Faults and flags of rows (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        found = BLANK.findall(text)
        fault = "blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def _brute(rows):
    """(cost, audit, digest) over all sequences of edits, with up to two inserted turns before each row and at the end."""
    faults = _told(rows)
    gaps = [""] + ["u", "a", "ua", "au"]
    best = None
    for edits in itertools.product(*[["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            initials, lines, audit, cost = "", [], "", 0
            for i in range(len(rows) + 1):
                for x in ins[i]:
                    initials, audit, cost = initials + x, audit + "I", cost + 2
                    lines.append(C.ROLES[x] + ":")
                if i < len(rows):
                    e, (_, role, text) = edits[i], rows[i]
                    cost += {"D": 3, "K": 0}.get(e, 2) + (e != "D" and faults[i] == "truncated")
                    audit += e[0]
                    if e != "D":
                        name = role if e == "K" else C.ROLES[e[1]]
                        initials += name[:1] or "?"
                        lines.append(f"{name}:{text}")
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return best


def _want(conv, rows):
    turns = [t for t, _, _ in rows if t is not None]
    faults = _told(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), *_brute(rows)[:3])


def test_all_edit_sequences(spark):
    draw = np.random.default_rng(11)
    table, want, lines = [], [], []
    for conv in range(120):
        rows = []
        for _ in range(int(draw.integers(0, 5))):
            turn = None if draw.random() < 0.1 else int(draw.integers(0, 5))
            role = str(draw.choice(["user", "assistant", "system", "tool", "", "sage", " "], p=[0.35, 0.3, 0.15, 0.05, 0.05, 0.05, 0.05]))
            text = str(draw.choice(["hi.", "why?", "cut off", " \t", "", "…", "né!"]))
            rows += [(turn, role, text)] * (2 if draw.random() < 0.1 and len(rows) < 3 else 1)
        rows = sorted(rows[:4], key=_order)
        key = None if conv == 0 else conv
        table += [(key, *r, 1) for r in rows] or [(key, None, None, None, 0)]
        want.append(_want(key, rows))
        lines += [(key, i, x) for i, x in enumerate(_brute(rows)[3])]
    df = spark.createDataFrame(table, ROWS).repartition(5)
    got = C.repair(df)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    turns = [(r.conv_id, r.place, f"{r.role}:{r.text}") for r in C.turns(df, got).collect()]
    assert sorted(turns, key=lambda t: (t[0] or 0, t[1])) == sorted(lines, key=lambda t: (t[0] or 0, t[1]))


def test_damage(spark):
    rows = [(c, t, r, "One. Two! Three?") for c in (1, None, -7) for t in [*range(40), None] for r in ("assistant", None)]
    got = sorted((tuple(r) for r in C.damaged(spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, copies string")).collect()), key=str)
    want = []
    for c, t, r, text in rows:
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if draw == 1 else "One Two Three" if draw == 2 else text
        r = "user" if draw == 4 else r or " "
        want.append((c, None, None, None, 0) if draw == 0 else (c, t, r, text, 2 if draw == 3 else 1))
    assert got == sorted(want, key=str)


def test_long_conversation_and_copies(spark):
    """One conversation of many rows, half of them one repeated row."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.", 1) for t in range(4000)] + [(1, 5, "user", "again.", 1)] * 4000
    [got] = C.repair(spark.createDataFrame(rows, ROWS).repartition(6)).collect()
    assert (got.gaps, got.blank, got.duplicate, got.truncated) == (0, 0, 3999, 0)
    # turn 5 holds the assistant's row, then the user's row 4000 times, and an assistant's turn is missing behind the kept one or it goes
    assert got.cost == 3 * 3999 + 2 and len(got.audit) == 8001 and got.audit.count("D") == 3999 and got.audit.count("I") == 1


def test_long_text(spark):
    text = "long words " * 200_000 + "end."
    rows = [(1, 0, "user", text, 1), (1, 1, "assistant", text, 1)]
    [got] = C.repair(spark.createDataFrame(rows, ROWS)).collect()
    assert (got.cost, got.audit) == (0, "KK") and got.repaired_sha256 == hashlib.sha256(f"user:{text}\nassistant:{text}".encode()).hexdigest()


@pytest.mark.parametrize("rows, n", [([], 0), ([(3, 0, "user", "x.", "y")], 1)])
def test_small_tables(spark, rows, n):
    assert C.digest(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, audit string")).count() == n
