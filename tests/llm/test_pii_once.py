"""Pseudonyms are written once: many values of each shape against a plain program."""

import datetime
import hashlib
import random
import re


from docweave.llm import pii

KEY = "k"


def prf(label, i, size, value):
    return int(hashlib.sha256(f"{KEY}|{label}|{i}|{size}|{value}".encode()).hexdigest()[:15], 16)


def feistel(left, right, mod_left, mod_right, label):
    for i in range(8):
        if i % 2 == 0:
            left = (left + prf(label, i, mod_left + mod_right, right) % mod_left) % mod_left
        else:
            right = (right + prf(label, i, mod_left + mod_right, left) % mod_right) % mod_right
    return left, right


def permuted(digits, label):
    h = len(digits) // 2
    a, b = feistel(int(digits[:h]), int(digits[h:]), 10**h, 10 ** (len(digits) - h), label)
    return f"{a:0{h}d}{b:0{len(digits) - h}d}"


def luhn(front):
    total = 0
    for k, c in enumerate(reversed(front)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def spread(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def card(v):
    d = re.sub("[^0-9]", "", v)
    new = permuted(d[:-1], "card")
    return spread(v, new + luhn(new))


def phone(v):
    d = re.sub("[^0-9]", "", v)
    return spread(v, d[:-7] + permuted(d[-7:], "phone"))


def ssn(v):
    return spread(v, permuted(v.replace("-", ""), "ssn"))


def ip(v):
    a, b, c, d = map(int, v.split("."))
    x, y = feistel(a * 256 + b, c * 256 + d, 65536, 65536, "ip")
    return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


def date(v):
    first = datetime.date(1000, 1, 1)
    n = (datetime.date.fromisoformat(v) - first).days
    while True:
        a, b = feistel(n // 1000, n % 1000, 1000, 1000, "date")
        n = a * 1000 + b
        if n < 730485:
            return (first + datetime.timedelta(n)).isoformat()


def number(rng, n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def grouped(digits, sizes, sep):
    out = []
    for s in sizes:
        out.append(digits[:s])
        digits = digits[s:]
    return sep.join(out)


def valid(rng, n):
    front = number(rng, n - 1)
    return front + luhn(front)


MADE = {
    "4-6-5": ("card", card, lambda r: grouped(valid(r, 15), (4, 6, 5), r.choice(" -"))),
    "4-6-4": ("card", card, lambda r: grouped(valid(r, 14), (4, 6, 4), r.choice(" -"))),
    "4-4-4-4": ("card", card, lambda r: grouped(valid(r, 16), (4, 4, 4, 4), r.choice(" -"))),
    "plain card": ("card", card, lambda r: valid(r, r.randrange(13, 20))),
    "ssn": ("ssn", ssn, lambda r: grouped(number(r, 9), (3, 2, 4), "-")),
    "phone": ("phone", phone, lambda r: r.choice([f"+1 ({number(r, 3)}) {number(r, 3)}-{number(r, 4)}", f"{number(r, 3)}-{number(r, 3)}-{number(r, 4)}", f"0{number(r, 3)} {number(r, 6)}", f"+49 30 {number(r, 8)}", f"020 {number(r, 4)} {number(r, 4)}"])),
    "ip": ("ip", ip, lambda r: ".".join(str(r.randrange(256)) for _ in range(4))),
    "date": ("date", date, lambda r: (datetime.date(1000, 1, 1) + datetime.timedelta(r.randrange(730485))).isoformat()),
}


def test_each_value_is_rewritten_once(spark):
    """10,000 values: found once, equal to the plain program's, and undone exactly."""
    values = [(shape, MADE[shape][2](rng)) for shape in MADE for rng in [random.Random(shape)] for _ in range(1250)]
    df = spark.createDataFrame([(i, f"pay {v}, then") for i, (_, v) in enumerate(values)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in pii.pseudonymise(df, key=KEY).collect()}
    for i, (shape, v) in enumerate(values):
        kind, plain, _ = MADE[shape]
        assert got[i].n_found == 1 == got[i][f"n_{kind}"] and got[i].text == f"pay {plain(v)}, then", v
    there = spark.createDataFrame([(i, r.text) for i, r in got.items()], "doc_id long, text string")
    back = {r.doc_id: r.text for r in pii.pseudonymise(there, key=KEY, undo=True).collect()}
    assert [back[i] for i in range(len(values))] == [f"pay {v}, then" for _, v in values]


def test_mixed_texts(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        parts = [MADE[s][2](rng) for s in rng.choices(list(MADE), k=rng.randrange(1, 9))]
        rows.append((i, " and ".join(parts), len(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(8)
    got = pii.pseudonymise(df, key=KEY)
    assert {r.doc_id: r.n_found for r in got.collect()} == {i: n for i, _, n in rows}
    back = pii.pseudonymise(got.select("doc_id", "text"), key=KEY, undo=True)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t for i, t, _ in rows}


def test_marks_of_the_text_itself(spark):
    odd = "﷐ 4111 1111 1111 1111 ﷖﷑ a.b@x.com ﷕ 0772 366470 96970"
    r = pii.pseudonymise(spark.createDataFrame([(1, odd)], "doc_id long, text string"), key=KEY).first()
    left = [c for c in r.text if "﷐" <= c <= "﷖"]
    assert left == [c for c in odd if "﷐" <= c <= "﷖"] and r.n_found == 2
    assert r.text.endswith("0772 366470 96970")  # a card's grouping without its check digit
