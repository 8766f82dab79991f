"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Card numbers (by their check digit), phone numbers, social security numbers,
IP addresses and dates are found and validated; their digits go through a
balanced Feistel network keyed by a secret, and come back in the same
punctuation. So equal values have equal pseudonyms in every document, distinct
ones stay distinct, and who has the key can undo it (``undo=True``). E-mail
addresses, whose length has no fixed domain, get a keyed digest as local part
under a reserved host.

- digits of length n are split in halves of n // 2 and n - n // 2; eight rounds
  add a keyed SHA-256 of the one half (with the round, kind and length) to the
  other, modulo its power of ten.
- a card's check digit is made anew from the permuted others. Sixteen digits in
  fours (with three more as a fifth group, or none) always count; other numbers of 13 to 19 digits if they pass the check.
- a date of year 1000 to 2999 is its day number, permuted by cycle walking in
  six digits until it is one of the 730,485 days again, and one that its own
  form can say: digits, separators, order of the fields and the list of month
  names stay. With slashes the month comes first, with dots or hyphens the day,
  if that is a date; else the other way.
- an address's four octets are one number below 2**32, permuted in halves of
  16 bits.

Null texts stay null and empty ones empty. Values are found in the text as it came:
none is found twice, and no pseudonym is taken for a value. One row comes out for every row: null and repeated ids and
repeated rows stay as they are (equal texts get equal pseudonyms); other columns
are not read. Very long texts are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let

ROUNDS = 8
_FIRST_DAY, _DAYS = "1000-01-01", 730485

# month names, by list; a name of several lists belongs to the first
MONTHS = tuple(
    names.split()
    for names in (
        "january february march april may june july august september october november december",
        "jan feb mar apr may jun jul aug sep oct nov dec",
        "januar februar märz april mai juni juli august september oktober november dezember",
        "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
        "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    )
)
_MONTH_CODE = {"sept": 109} | {name: 100 * k + i for k, names in reversed(list(enumerate(MONTHS))) for i, name in enumerate(names, 1)}
_MONTH = "(?iu:" + "|".join(sorted(_MONTH_CODE, key=len, reverse=True)) + ")(?!\\p{L})"

_FOURS = "[0-9]{4}([ -]?)[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}"
_ISO = "[12][0-9]{3}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
_S, _CODE = "[ .-]", "\\+[0-9]{1,3}[ .-](?:\\(0\\)[ ]?)?"
_PHONES = (
    "\\+[0-9]{1,3}[ .-]?\\(?[0-9]{2,4}\\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}",
    "\\+[0-9]{8,15}",
    f"{_CODE}[0-9]{{4,5}}{_S}[0-9]{{5,8}}",
    f"{_CODE}\\(?[0-9]{{2,3}}\\)?{_S}[0-9]{{7,8}}",
    f"{_CODE}\\(?[0-9]{{1,4}}\\)?{_S}[0-9]{{3,5}}{_S}[0-9]{{3,4}}",
    f"{_CODE}[0-9](?:{_S}[0-9]{{2}}){{4}}",
    f"{_CODE}[0-9]{{2,3}}(?:{_S}[0-9]{{2}}){{3,4}}",
    f"{_CODE}[0-9]{{4}}{_S}[0-9]{{4}}",
)
#: stands for a found value of each kind while others are looked for; those that a
#: text has itself are set aside first, under the last one
_MARKS = [chr(0xFDD0 + i) for i in range(7)]
_M = f"{_MARKS[0]}-{_MARKS[-1]}"
_NATIONAL = (
    "(?:1[ .-])?(?:\\([0-9]{3}\\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
    # with the zero of a long-distance call; not the groups of a longer number
    f"(?<![0-9{_M}][ -])\\(?0(?:[0-9](?:{_S}[0-9]{{2}}){{4}}|[0-9]{{2,4}}\\)?[ /-][0-9]{{6,8}}|[0-9]{{1,4}}\\)?{_S}[0-9]{{3,4}}{_S}[0-9]{{3,4}})(?![ -][0-9]{{4}}(?![0-9]))",
)

#: patterns in Java's syntax; a value stands free of letters, digits and dots beside it
PATTERNS = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}",
    "card": f"(?<![0-9A-Za-z{_M}])(?:{_FOURS}(?![0-9A-Za-z{_M}]|\\1[0-9]{{3}}(?![0-9A-Za-z{_M}]))|[0-9]{{4}}([ -])[0-9]{{4}}\\2[0-9]{{4}}\\2[0-9]{{4}}\\2[0-9]{{3}}|[0-9]{{4}}([ -])[0-9]{{6}}\\3[0-9]{{4,5}}|(?<!\\+)[0-9]{{13,19}})(?![0-9A-Za-z{_M}])",
    "ssn": f"(?<![0-9A-Za-z{_M}-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z{_M}-])",
    "phone": f"(?:(?:{'|'.join(_PHONES)})(?![0-9])|(?<![0-9A-Za-z{_M}+]|[0-9{_M}][.-])(?:{'|'.join(_NATIONAL)})(?![0-9A-Za-z{_M}]|[.-][0-9]))",
    "ip": f"(?<![0-9A-Za-z{_M}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){{3}}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9A-Za-z{_M}]|\\.[0-9])",
    "date": (
        f"(?:(?<![0-9A-Za-z{_M}-]){_ISO}(?![0-9A-Za-z{_M}-])"
        f"|(?<![0-9A-Za-z{_M}]|[0-9{_M}][./-])(?:[0-9]{{1,2}}([/.-])[0-9]{{1,2}}\\1[12][0-9]{{3}}|[12][0-9]{{3}}([/.])[0-9]{{1,2}}\\2[0-9]{{1,2}})(?![0-9A-Za-z{_M}]|[./-][0-9])"
        f"|(?<!\\p{{L}}){_MONTH}\\.?[ ][0-9]{{1,2}}(?i:st|nd|rd|th)?,?[ ][12][0-9]{{3}}(?![0-9A-Za-z{_M}])"
        f"|(?<![0-9A-Za-z{_M}])[0-9]{{1,2}}(?:(?i:st|nd|rd|th|er)|\\.)?[ ](?:(?i:of|de)[ ])?{_MONTH}\\.?,?(?:[ ](?i:de|del))?[ ][12][0-9]{{3}}(?![0-9A-Za-z{_M}]))"
    ),
}
KINDS = tuple(PATTERNS)


def _prf(key: Column, label: str, i: Column, value: Column, size: Column) -> Column:
    """60 bits of a keyed SHA-256, as a number."""
    said = F.concat_ws("|", key, F.lit(label), i.cast("string"), size.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def _feistel(left: Column, right: Column, mod_left: Column, mod_right: Column, key: Column, label: str, undo: bool) -> Column:
    """A struct of two numbers below their moduli, permuted together: even
    rounds change the left one, odd rounds the right one."""
    size, sign = mod_left + mod_right, -1 if undo else 1

    def turn(p: Column, i: Column) -> Column:
        even = i % 2 == 0
        mod = F.when(even, mod_left).otherwise(mod_right)
        by = F.pmod(_prf(key, label, i, F.when(even, p["r"]).otherwise(p["l"]), size), mod)
        new = F.pmod(F.when(even, p["l"]).otherwise(p["r"]) + sign * by, mod)
        return F.struct(F.when(even, new).otherwise(p["l"]).alias("l"), F.when(even, p["r"]).otherwise(new).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    rounds = F.array(*(F.lit(i) for i in (reversed(range(ROUNDS)) if undo else range(ROUNDS))))
    return F.reduce(rounds, start, turn)


def permute_digits(digits: Column, key: Column, label: str, undo: bool = False) -> Column:
    """A string of 2 to 36 digits as another one of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    a, b = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest)
    both = _feistel(a, b, F.pow(F.lit(10.0), half).cast("long"), F.pow(F.lit(10.0), rest).cast("long"), key, label, undo)
    return let(both, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), rest, "0")))


def luhn_digit(digits: Column) -> Column:
    """The check digit that makes ``digits`` and itself valid."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return ((10 - F.reduce(F.sequence(F.lit(1), n), F.lit(0), add) % 10) % 10).cast("string")


def _spread(shape: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``shape``."""
    chars = F.split(shape, "")
    placed = F.transform(chars, lambda c, i: F.when(c.between("0", "9"), F.substring(digits, F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c))
    return F.array_join(placed, "")


def _passes(digits: Column) -> Column:
    front = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return luhn_digit(front) == F.substring(digits, F.length(digits), F.lit(1))


def _is_card(v: Column) -> Column:
    return v.rlike(f"^{_FOURS}(?:[ -][0-9]{{3}})?$") | let(F.regexp_replace(v, "[^0-9]", ""), _passes)


def _card(v: Column, key: Column, undo: bool) -> Column:
    def body(d: Column) -> Column:
        front = F.substring(d, F.lit(1), F.length(d) - 1)
        valid = luhn_digit(front) == F.substring(d, F.length(d), F.lit(1))
        new = let(permute_digits(front, key, "card", undo), lambda p: F.concat(p, luhn_digit(p)))
        # a number that fails the check is permuted whole, in a domain of its own:
        # what it becomes must fail the check too, so its last digit keeps its distance
        off = F.pmod(F.substring(d, F.length(d), F.lit(1)).cast("int") - luhn_digit(front).cast("int"), F.lit(10))
        odd = let(permute_digits(front, key, "card", undo), lambda p: F.concat(p, F.pmod(luhn_digit(p).cast("int") + off, F.lit(10)).cast("string")))
        return F.when(valid, new).otherwise(odd)

    return F.when(_is_card(v), let(F.regexp_replace(v, "[^0-9]", ""), lambda d: _spread(v, body(d)))).otherwise(v)


def _digits(label: str) -> Callable[[Column, Column, bool], Column]:
    return lambda v, key, undo: let(F.regexp_replace(v, "[^0-9]", ""), lambda d: _spread(v, permute_digits(d, key, label, undo)))


def _phone(v: Column, key: Column, undo: bool) -> Column:
    """The last seven digits are permuted; what stands before them stays."""

    def body(d: Column) -> Column:
        n = F.length(d)
        return F.concat(F.substring(d, F.lit(1), n - 7), permute_digits(F.substring(d, n - 6, F.lit(7)), key, "phone", undo))

    return let(F.regexp_replace(v, "[^0-9]", ""), lambda d: _spread(v, body(d)))


def _ip(v: Column, key: Column, undo: bool) -> Column:
    mod = F.lit(65536).cast("long")

    def body(o: Column) -> Column:
        n = lambda i: F.get(o, i).cast("long")
        both = _feistel(n(0) * 256 + n(1), n(2) * 256 + n(3), mod, mod, key, "ip", undo)
        return let(both, lambda p: F.concat_ws(".", *((F.floor(p[x] / 256) if high else p[x] % 256).cast("string") for x in "lr" for high in (True, False))))

    return let(F.split(v, "\\."), body)


def _read_date(v: Column) -> Column:
    """date (null if it is none), wm, wd (digits of month and day), swapped (the
    fields stand in the other order), code (of the month's name, or null)."""
    codes = F.create_map(*(F.lit(x) for pair in _MONTH_CODE.items() for x in pair))

    def read(a: Column) -> Column:
        code = F.when(F.size(a) == 2, F.try_element_at(codes, F.lower(F.regexp_extract(v, _MONTH, 0))))
        n = lambda i: F.get(a, F.lit(i))
        named, first = code.isNotNull(), F.length(n(0)) == 4
        slash = F.instr(v, "/") > 0
        year = F.when(named, n(1)).when(first, n(0)).otherwise(n(2))
        month = F.when(named, F.lpad((code % 100).cast("string"), 2, "0")).when(first | ~slash, n(1)).otherwise(n(0))
        day = F.when(~named & first, n(2)).when(~named & slash, n(1)).otherwise(n(0))
        date = lambda m, d: F.try_to_date(F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        one, other = date(month, day), F.when(~named & ~first, date(day, month))
        swapped = one.isNull() & other.isNotNull()
        wide = lambda x, y: F.length(F.when(swapped, y).otherwise(x))
        return F.struct(F.coalesce(one, other).alias("date"), wide(month, day).alias("wm"), wide(day, month).alias("wd"), swapped.alias("swapped"), code.alias("code"))

    return let(F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0)), read)


def _is_date(v: Column) -> Column:
    return v.rlike(f"^{_ISO}$") | _read_date(v)["date"].isNotNull()


def _date(v: Column, key: Column, undo: bool) -> Column:
    first = F.lit(_FIRST_DAY).cast("date")
    names = F.array(*(F.lit(x) for xs in MONTHS for x in xs))
    codes = F.create_map(*(F.lit(x) for pair in _MONTH_CODE.items() for x in pair))

    def walk(p: Column) -> Column:
        # a cycle that leaves the days the form can say comes back after 1 / 0.16 steps
        # on average in the narrowest form (1 / 0.73 in full digits); it is walked until
        # it does, 250 steps for all but one day in 10**19
        mod = F.lit(1000).cast("long")

        def one(n: Column) -> Column:
            return let(_feistel(F.floor(n / 1000), n % 1000, mod, mod, key, "date", undo), lambda q: q["l"] * 1000 + q["r"])

        def fits(n: Column) -> Column:
            date = F.date_add(first, n.cast("int"))
            month, day = F.month(date), F.dayofmonth(date)
            table = F.floor(p["code"] / 100).cast("int")
            said = F.try_element_at(codes, F.get(names, table * 12 + month - 1)) == table * 100 + month
            return (n < _DAYS) & ((p["wm"] == 2) | (month < 10)) & ((p["wd"] == 2) | (day < 10)) & (~p["swapped"] | (day > 12)) & (p["code"].isNull() | said)

        begun = one(F.datediff(p["date"], first).cast("long"))
        return let(F.reduce(F.sequence(F.lit(1), F.lit(250)), begun, lambda n, _: F.when(fits(n), n).otherwise(one(n))), lambda n: F.when(fits(n), n))

    def write(p: Column, n: Column) -> Column:
        date = F.date_add(first, n.cast("int"))
        year, month, day = F.date_format(date, "yyyy"), F.month(date), F.dayofmonth(date)
        m, d = F.lpad(month.cast("string"), p["wm"], "0"), F.lpad(day.cast("string"), p["wd"], "0")
        sep, slash = F.regexp_extract(v, "[-/.]", 0), F.instr(v, "/") > 0
        figures = F.when(v.rlike("^[0-9]{4}"), F.concat(year, sep, m, sep, d)).when(slash != p["swapped"], F.concat(m, sep, d, sep, year)).otherwise(F.concat(d, sep, m, sep, year))
        token = F.regexp_extract(v, _MONTH, 0)
        name = F.get(names, F.floor(p["code"] / 100).cast("int") * 12 + month - 1)
        name = F.when(token == F.lower(token), name).when(token == F.upper(token), F.upper(name)).otherwise(F.initcap(name))
        th = F.when(day.isin(11, 12, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
        counted = F.when(v.rlike("[0-9](?:st|nd|rd|th)"), th).when(v.rlike("[0-9](?:ST|ND|RD|TH)"), F.upper(th)).otherwise("")
        words = F.regexp_replace(v, F.lit("[0-9]{4}$"), year)
        words = F.regexp_replace(words, F.lit("(?<![0-9])[0-9]{1,2}(?:(?i:st|nd|rd|th))?(?![0-9])"), F.concat(d, counted))
        return F.when(p["code"].isNull(), figures).otherwise(F.regexp_replace(words, F.lit("(?<!\\p{L})" + _MONTH), name))

    def body(p: Column) -> Column:
        said = let(walk(p), lambda n: F.coalesce(write(p, n), F.regexp_replace(v, "[0-9]", "0")))
        return F.when(p["date"].isNull(), v).otherwise(said)

    return let(_read_date(v), body)


def _email(v: Column, key: Column, undo: bool) -> Column:
    return F.concat(F.lit("user-"), F.substring(F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(v)), 256), 1, 16), F.lit("@redacted.invalid"))


_MASKS = {"email": _email, "card": _card, "ssn": _digits("ssn"), "phone": _phone, "ip": _ip, "date": _date}


#: kinds of which the pattern finds more than the values, and what they must pass
_CHECKS = {"card": _is_card, "date": _is_date}


def _hint(kind: str, text: Column) -> Column:
    """A cheap test that every text with a value of the kind passes."""
    if kind == "email":
        return F.instr(text, "@") > 0
    if kind == "phone":
        return (F.instr(text, "+") > 0) | text.rlike("[0-9][) ./-]{1,2}[0-9]{2}")
    return text.rlike({"card": "[0-9]{4}", "ssn": "[0-9]-[0-9]", "ip": "[0-9]\\.[0-9]", "date": "[12][0-9]{3}"}[kind])


def _count(kind: str, found: Column) -> Column:
    return F.size(F.filter(found, _CHECKS[kind]) if kind in _CHECKS else found).cast("long")


def _put_back(text: Column, mark: str, values: Column) -> Column:
    """``text`` with the values, in order, in place of a mark."""
    gaps = F.split(text, mark, -1)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(values, i), F.lit("")))), "")


def _secret(docs: DataFrame, key: str) -> Column:
    """The key as the value of a one-row table, which is read when the query
    runs: no plan, and so no event log, tells it."""
    return docs.sparkSession.createDataFrame(pa.table({"key": [key]})).scalar()


def pseudonymise(docs: DataFrame, *, key: str, kinds: tuple[str, ...] = KINDS, id_col: str = "doc_id", text_col: str = "text", undo: bool = False) -> DataFrame:
    """doc_id, n_found (values by all kinds), n_<kind> ..., text (with pseudonyms).

    All values are found in the text as it came, kinds in the order of ``KINDS``;
    what one kind has taken no later one sees, and all pseudonyms are written at
    the end. A number in a card's grouping that fails the check stays as it is.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _secret(docs, key).alias("key"))
    asked = [k for k in KINDS if k in kinds]
    none = F.array().cast("array<string>")
    steps = [("own", f"[{_M}]", _MARKS[-1]), *((k, PATTERNS[k], m) for k, m in zip(KINDS, _MARKS) if k in asked)]
    for kind, pattern, mark in steps:
        text = F.col("text")
        hint = text.rlike(pattern) if kind == "own" else _hint(kind, text)
        out = out.withColumn(f"f_{kind}", F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
        out = out.withColumn("text", F.when(F.size(f"f_{kind}") > 0, F.regexp_replace(text, pattern, mark)).otherwise(text))
    masks = {k: partial(m, key=F.col("key"), undo=undo) for k, m in _MASKS.items()}
    for kind, _, mark in steps[1:] + steps[:1]:
        found = F.col(f"f_{kind}")
        mask = masks.get(kind)
        values = F.transform(found, lambda v: mask(v)) if mask else found  # noqa: B023
        # texts without a value pass as they are; the masks are only made for the others
        out = out.withColumn("text", F.when(F.size(found) > 0, _put_back(F.col("text"), mark, values)).otherwise(F.col("text")))
    counts = {k: _count(k, F.col(f"f_{k}")) if k in asked else F.lit(0).cast("long") for k in kinds}
    total = sum(counts.values(), F.lit(0).cast("long"))
    return out.select("doc_id", total.alias("n_found"), *(counts[k].alias(f"n_{k}") for k in kinds), "text")
