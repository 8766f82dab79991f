"""Conversation repair against exhaustive edits and a plain row by row program."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from docweave.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, m long, part int, symbol string, audit string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def row_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain(rows):
    """(cost, audit, final rows): the least over states after each row, inserts anywhere."""
    found = row_faults(rows)
    nexts = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def inserted(states):
        out = dict(states)
        for state, (cost, audit, made) in states.items():
            at, c, a, m = state, cost, audit, made
            for _ in range(3):
                at = nexts[at]
                c, a, m = c + 3, a + "I", (*m, (full[at], ""))
                if at not in out or (c, a) < out[at][:2]:
                    out[at] = (c, a, m)
        return out

    states = {"": (0, "", ())}
    for (_, _, role, text), fault in zip(rows, found):
        new = {}

        def offer(at, way, new=new):
            if at not in new or way[:2] < new[at][:2]:
                new[at] = way

        for state, (cost, audit, made) in inserted(states).items():
            offer(state, (cost + 4, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            to = nexts[state]
            offer(to, (cost + 3 + more, audit + "R", (*made, (full[to], text))))
            if role[:1] == to or (role[:1] == "s" and state == ""):
                offer(role[:1], (cost + more, audit + "K", (*made, (role, text))))
        states = new
    return min(v for k, v in inserted(states).items() if k in ("", "a"))


def summary(conv, rows):
    rows = order(rows)
    found = row_faults(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, made = plain(rows)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return (conv, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest)


def brute(rows, convs):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return sorted((summary(c, by[c]) for c in convs), key=repr)


def exhaustive(symbols):
    """(cost, audit) over all edits with up to two inserts in a place."""
    best = None
    for edits in itertools.product("KRD", repeat=len(symbols)):
        if any(e != "D" and s == "D" for e, s in zip(edits, symbols)):
            continue
        for ins in itertools.product(range(3), repeat=len(symbols) + 1):
            audit = "".join("I" * n + e for n, e in zip(ins, edits)) + "I" * ins[-1]
            cost = 3 * sum(ins) + sum({"K": 0, "R": 3, "D": 4}[e] + (3 if e != "D" and s.isupper() else 0) for e, s in zip(edits, symbols))
            if best is not None and (cost, audit) >= best:
                continue
            free = [s.lower() if e == "K" else "?" for e, s in zip(edits, symbols)]
            roles = []
            for n, e, r in zip(ins, edits, free):
                roles += ["?"] * n + ([r] if e != "D" else [])
            roles += ["?"] * ins[-1]
            for shape in ("ua" * (len(roles) // 2), "s" + "ua" * (len(roles) // 2)):
                if len(shape) == len(roles) and GRAMMAR.fullmatch(shape) and all(x == y or (x == "?" and y != "s") for x, y in zip(roles, shape)):
                    best = (cost, audit)
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_matrices_equal_all_edits(n):
    matrices = cr.rule_matrices([])
    for symbols in itertools.product(cr.SYMBOLS, repeat=n):
        cost, audit = cr.finish(cr.evaluate("".join(symbols), [], matrices, (0,)))
        assert (cost, str(audit)) == exhaustive(symbols), symbols


def test_matrices_equal_all_edits_of_four():
    rng = random.Random(2)
    matrices = cr.rule_matrices([])
    for _ in range(60):
        symbols = "".join(rng.choice(cr.SYMBOLS) for _ in range(4))
        cost, audit = cr.finish(cr.evaluate(symbols, [], matrices, (0,)))
        assert (cost, str(audit)) == exhaustive(symbols), symbols


def test_rules_change_no_result():
    rng = random.Random(3)
    rules = ["ua", cr.name(0) * 2, cr.name(1) * 2, "Us", "DD", cr.name(4) + "u"]
    plain_m, ruled = cr.rule_matrices([]), cr.rule_matrices(rules)
    for _ in range(200):
        s = "".join(rng.choice(["ua", "ua", *cr.SYMBOLS]) for _ in range(rng.randrange(40)))
        a, b = (cr.evaluate(s, r, m) for r, m in (([], plain_m), (rules, ruled)))
        assert {k: (c, str(t)) for k, (c, t) in a.items()} == {k: (c, str(t)) for k, (c, t) in b.items()}


def test_ropes_compare_as_texts():
    rng = random.Random(4)
    made = [cr.Rope.of("")]
    texts = [""]
    for _ in range(400):
        if rng.random() < 0.3:
            t = "".join(rng.choice("DIKR") for _ in range(rng.randrange(4)))
            made.append(cr.Rope.of(t))
            texts.append(t)
        else:
            i, j = rng.randrange(len(made)), rng.randrange(len(made))
            if len(texts[i]) + len(texts[j]) < 200:
                made.append(made[i] + made[j])
                texts.append(texts[i] + texts[j])
    assert [str(m) for m in made] == texts
    for _ in range(4000):
        i, j = rng.randrange(len(made)), rng.randrange(len(made))
        assert (made[i] < made[j]) == (texts[i] < texts[j])


def odd_conversations():
    rng = random.Random(6)
    roles = ["user", "assistant", "system", "tool", "", None, "unit", "user", "assistant"]
    texts = ["Good.", "good", "Yes!", "", " \t", None, "No?\n", "été\x85", "done.  ", ".", "x" * 5000]
    rows = []
    for conv in [*range(80), None]:
        for turn in range(rng.choice((1, 2, 5, 12))):
            if rng.random() < 0.9:
                rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice((1, 1, 1, 3)), rng.choice(roles) if rng.random() < 0.5 else ("user", "assistant")[turn % 2], rng.choice(texts) if rng.random() < 0.4 else f"Text {turn}."))
    rows += rows[:30]  # repeated rows
    rows += [(900, t, ("user", "assistant")[t % 2], f"Line {t % 50}{'.' * (t % 7 > 0)}") for t in range(3000)]
    rows += [(901, 5, "user", "Again.")] * 700
    return rows + [(902, None, "system", "Only.")] + [(c, 0, "user", "x") for c in range(1000, 1040)]


def as_frame(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, 2, "s", "a") for c, t, r, x in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("segment", [4096, 7])
def test_damage_and_repair_equal_the_plain_program(spark, monkeypatch, segment):
    monkeypatch.setattr(cr, "SEGMENT", segment)
    rows = odd_conversations()
    conversations = as_frame(spark, rows)
    got = sorted(map(tuple, cr.repair(cr.damage(conversations), conversations).collect()), key=repr)
    assert got == brute(damaged(rows), {r[0] for r in rows})
    assert any(g[7] == "" and g[6] == 0 for g in got)  # a conversation all of whose rows are dropped


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cr.repair(cr.damage(none), none).count() == 0
