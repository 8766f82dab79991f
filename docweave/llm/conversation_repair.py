"""Cheapest repair of conversations by a grammar-compressed dynamic program.

A row of a conversation becomes one of nine symbols: its role's initial (system,
user, assistant, other) and whether it is sound or truncated, or that it has to go
(blank, or role and text were there before). A repair keeps, reroles, deletes and
inserts rows so that the roles read ``(s?(ua)+)?``; what it does to one symbol is a
4 x 4 matrix over the states start, after system, after user, after assistant, whose
entries hold the least cost and its audit. Matrices multiply by min-plus; of equal
costs the audit least in ASCII stays. From one state an audit tells all costs and
roles, so no audit is a prefix of another of the same cost, and that order holds
under concatenation.

Rows are sorted over all tasks, so a long conversation lies in several; each piece
of up to ``SEGMENT`` symbols is a string, and equal strings are evaluated once. A
Re-Pair grammar over the distinct strings replaces frequent pairs of symbols, a batch
each round, counted by Spark; each rule gets one matrix from those of its two
symbols, bottom-up, with audits as shared ropes. At most ``RULES`` rules go to the
tasks, whatever the input; they change the work and no result. Pieces of one
conversation are multiplied in order, first those of one task, then those results.

Digests need a conversation's texts in order: its rows pass through one task as a
sorted stream and only the audit is held in memory, one letter for a row.

Null conv_id is one conversation; null turns come first; null roles and texts are
one space. Rows of one turn come in order of role and text, by bytes; repeated rows
are counted and not multiplied. Empty, and very long conversations and texts are
taken whole. Other columns are not looked at. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._scratch import cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: symbols of a piece of a conversation
SEGMENT = 4096
#: rounds of the grammar, rules of a round, and rules in all
ROUNDS, BATCH, RULES = 10, 16, 160
START, SYSTEM, USER, ASSISTANT = range(4)
_BLANKS = "\\x20\\x09-\\x0D"
_LEGAL = {"su", "ua", "au"}


# ---- the algebra: a matrix is a dict {(from, to): (cost, rope)}


class Rope:
    """Text as a tree; equal trees are one object, so shared parts compare at once."""

    __slots__ = ("left", "right", "text")
    _made: dict = {}

    def __init__(self, text: str | None, left=None, right=None):
        self.text, self.left, self.right = text, left, right

    @classmethod
    def of(cls, text: str) -> Rope:
        return cls._made.setdefault(text, cls(text))

    def __add__(self, other: Rope) -> Rope:
        if self.text == "":
            return other
        if other.text == "":
            return self
        key = (id(self), id(other))
        found = self._made.get(key)
        if found is None:
            found = self._made[key] = Rope(None, self, other)
        return found

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            r = todo.pop()
            if r.text is None:
                todo += (r.right, r.left)
            else:
                out.append(r.text)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y:
                continue
            if x.text is None:
                a += (x.right, x.left)
                b.append(y)
            elif y.text is None:
                b += (y.right, y.left)
                a.append(x)
            else:
                n = min(len(x.text), len(y.text))
                if x.text[:n] != y.text[:n]:
                    return x.text < y.text
                if x.text[n:]:
                    a.append(Rope.of(x.text[n:]))
                if y.text[n:]:
                    b.append(Rope.of(y.text[n:]))
        return not a and any(str(r) for r in b)


def _better(new, old) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and new[1] < old[1])


def times(a: dict, b: dict) -> dict:
    out: dict = {}
    for (i, k), (cost, audit) in a.items():
        for j in range(4):
            step = b.get((k, j))
            if step is not None:
                at = out.get((i, j))
                if at is None or cost + step[0] <= at[0]:
                    new = (cost + step[0], audit + step[1])
                    if _better(new, at):
                        out[i, j] = new
    return out


def _inserts(of) -> dict:
    """What inserting any number of rows can do, at least cost."""
    out = {(s, s): (0, of("")) for s in range(4)}
    for start in (START, SYSTEM, USER, ASSISTANT):
        state = start
        for n in (1, 2, 3):
            state = ASSISTANT if state == USER else USER
            out.setdefault((start, state), (INSERT * n, of("I" * n)))
    return out


def symbol_matrix(symbol: str, of=Rope.of) -> dict:
    """Inserts, then one edit of a row with that symbol."""
    edit = {(s, s): (DELETE, of("D")) for s in range(4)}
    if symbol != "D":
        more = TRUNCATED if symbol.isupper() else 0
        for state in range(4):
            to = ASSISTANT if state == USER else USER
            ways = [(to, REROLE + more, "R")]
            role = symbol.lower()
            if (role == "s" and state == START) or (role == "u" and to == USER) or (role == "a" and to == ASSISTANT):
                ways.append((SYSTEM if role == "s" else to, KEEP + more, "K"))
            for end, cost, letter in ways:
                if _better((cost, of(letter)), edit.get((state, end))):
                    edit[state, end] = (cost, of(letter))
    return times(_inserts(of), edit)


SYMBOLS = "DsuaoSUAO"


def rule_matrices(rules: list[str]) -> dict[str, dict]:
    """Matrices of all symbols; a rule is the pair that it stands for."""
    out = {s: symbol_matrix(s) for s in SYMBOLS}
    for n, (a, b) in enumerate(rules):
        out[name(n)] = times(out[a], out[b])
    return out


def name(rule: int) -> str:
    return chr(0x4E00 + rule)


def compress(symbols: str, rules: list[str]) -> str:
    for n, pair in enumerate(rules):
        symbols = symbols.replace(pair, name(n))
    return symbols


def evaluate(symbols: str, rules: list[str], matrices: dict[str, dict], starts=range(4)) -> dict:
    """The product of a string's matrices, from some states. Long strings are
    multiplied as a balanced tree, which keeps ropes shallow."""
    level = [matrices[c] for c in compress(symbols, rules)]
    while len(level) > 16:
        level = [times(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    out = {(s, s): (0, Rope.of("")) for s in starts}
    for m in level:
        out = times(out, m)
    return out


def finish(row: dict, of=Rope.of):
    """(cost, audit) of the best way from the start to a legal end."""
    closed = times(row, _inserts(of))
    best = None
    for end in (START, ASSISTANT):
        found = closed.get((START, end))
        if found is not None and _better(found, best):
            best = found
    return best


# ---- rows and symbols


def damage(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, m: rows as a checksum of their place damages
    them, with the number of times each stands there."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told(conv_col), F.lit(":"), told(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("m"))


def faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows with how often each stands there (m), and the same with the
    role's initial and the symbol of the first copy (``B`` for blank ones)."""
    told = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    turns = cut(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), told("role"), told("text"), "m").groupBy("conv_id", "turn", "role", "text").agg(F.sum("m").alias("m")), "turns")
    seen = turns.groupBy("conv_id", "role", "text").agg(F.count("*").alias("places"), F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first")).where("places > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), F.col("first.turn").alias("first"), F.lit(True).alias("again"))
    both = turns.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")), "left")
    later = F.coalesce("again", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("o")
    blank = ~F.col("text").rlike(f"[^{_BLANKS}]")
    whole = F.col("text").rlike(f"[.!?][{_BLANKS}]*\\z")
    symbol = F.when(blank, "B").when(later, "D").when(whole, initial).otherwise(F.upper(initial))
    return turns, both.select("conv_id", "turn", "role", "text", "m", initial.alias("initial"), symbol.alias("symbol"))


_ORDER = ["conv_id", "turn", "role", "text"]  # ascending, Spark puts nulls first
_COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, low long, high long, first_initial string, last_initial string"
_PIECE = f"conv_id long, part int, piece long, symbols string, {_COUNTS}"


class _Piece:
    """Symbols and counts of neighbouring rows of one conversation."""

    def __init__(self):
        self.symbols: list[str] = []
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.low = self.high = self.first_initial = self.last_initial = None

    def add(self, turn, initial: str, symbol: str, n: int) -> None:
        if self.size == 0:
            self.first_turn, self.first_initial = turn, initial
        elif self.last_initial + initial not in _LEGAL:
            self.illegal += 1
        self.illegal += n - 1  # a role behind itself is never legal
        if turn is not None and (self.size == 0 or turn != self.last_turn):
            self.turns += 1
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
        self.last_turn, self.last_initial = turn, initial
        self.blank += n * (symbol == "B")
        self.duplicate += n * (symbol == "D")
        self.truncated += n * (symbol in "SUAO")
        self.symbols.append(("D" if symbol == "B" else symbol) * n)
        self.size += n

    def row(self) -> tuple:
        return "".join(self.symbols), self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.first_turn, self.last_turn, self.low, self.high, self.first_initial, self.last_initial


def _pieces(batches) -> Iterator[pa.RecordBatch]:
    part, names = TaskContext.get().partitionId(), [c.split()[0] for c in _PIECE.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in _PIECE.split(", ")]
    out: list[tuple] = []
    conv, number, piece = None, 0, _Piece()

    def close():
        nonlocal piece, number
        if piece.size:
            out.append((conv, part, number, *piece.row()))
            number += 1
        piece = _Piece()

    def batch():
        rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        out.clear()
        return rows

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "symbol", "m")]
        for c, turn, initial, symbol, m in zip(*cols):
            if c != conv:
                close()
                conv = c
            # the first copy may be sound, the others repeat it
            runs = [(symbol, 1), ("D", m - 1)] if symbol not in "BD" else [(symbol, m)]
            for s, n in runs:
                while n:
                    take = min(n, SEGMENT - piece.size)
                    piece.add(turn, initial, s, take)
                    n -= take
                    if piece.size == SEGMENT:
                        close()
            if len(out) >= 2000:
                yield batch()
    close()
    if out:
        yield batch()


# ---- grammar and evaluation over tables


def grammar(strings: DataFrame) -> list[str]:
    """Pairs that rules stand for, in order: those most frequent in ``symbols``
    of the distinct strings, a batch each round."""
    rules: list[str] = []
    for _ in range(ROUNDS):
        so_far = list(rules)

        def pairs(batches):
            found: Counter = Counter()
            for b in batches:
                for s in b.column(0).to_pylist():
                    s = compress(s, so_far)
                    found.update(s[i : i + 2] for i in range(len(s) - 1))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["pair", "n"])

        counted = strings.select("symbols").mapInArrow(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        new = [r["pair"] for r in counted.orderBy(F.desc("n"), "pair").limit(min(BATCH, RULES - len(rules))).collect()]
        if not new:
            break
        rules += new
    return rules


_ENTRIES = "array<struct<start:int,end:int,cost:long,audit:string>>"
_ENTRY = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _told(m: dict) -> list[dict]:
    return [{"start": i, "end": j, "cost": c, "audit": str(a)} for (i, j), (c, a) in m.items()]


def _read(entries: list[dict]) -> dict:
    return {(e["start"], e["end"]): (e["cost"], e["audit"]) for e in entries}


def _multiply(group: pa.Table) -> dict:
    out = None
    for entries in group.column("ways").to_pylist():
        out = _read(entries) if out is None else times(out, _read(entries))
    return out


def _repairs(pieces: DataFrame) -> DataFrame:
    """conv_id, cost, audit for every conversation that has pieces."""
    many = F.count("*").over(Window.partitionBy("conv_id"))
    pieces = pieces.select("conv_id", "part", "piece", "symbols", (many == 1).alias("alone"))
    strings = cut(pieces.select("symbols", "alone").distinct(), "strings")
    rules = grammar(strings)

    def solve(batches):
        matrices = rule_matrices(rules)
        for b in batches:
            ways, cost, audit = [], [], []
            for s, alone in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m = evaluate(s, rules, matrices, (START,) if alone else range(4))
                best = finish(m) if alone else (None, "")
                ways.append(None if alone else _told(m))
                cost.append(best[0])
                audit.append(str(best[1]) if alone else None)
            Rope._made.clear()
            matrices = rule_matrices(rules)  # ropes of the batch go
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ways, _ENTRY), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["symbols", "alone", "ways", "cost", "audit"])

    solved = strings.mapInArrow(solve, f"symbols string, alone boolean, ways {_ENTRIES}, cost long, audit string")
    held = cut(pieces.join(solved, ["symbols", "alone"]).drop("symbols"), "solved")

    def in_task(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece")
        return pa.table({"conv_id": group.column("conv_id")[:1], "part": group.column("part")[:1], "ways": pa.array([_told(_multiply(group))], _ENTRY)})

    def over_tasks(group: pa.Table) -> pa.Table:
        cost, audit = finish({k: v for k, v in _multiply(group.sort_by("part")).items() if k[0] == START}, str)
        return pa.table({"conv_id": group.column("conv_id")[:1], "cost": pa.array([cost], pa.int64()), "audit": pa.array([audit])})

    long = held.where("not alone").select("conv_id", "part", "piece", "ways")
    parts = long.groupBy("conv_id", "part").applyInArrow(in_task, f"conv_id long, part int, ways {_ENTRIES}")
    joined = parts.groupBy("conv_id").applyInArrow(over_tasks, "conv_id long, cost long, audit string")
    return held.where("alone").select("conv_id", "cost", "audit").unionByName(joined)


class _Text:
    """A conversation's repaired text as a digest."""

    def __init__(self, audit: str):
        self.audit, self.at, self.role, self.digest, self.empty = audit, 0, "", hashlib.sha256(), True

    def _say(self, role: str, text: str) -> None:
        if not self.empty:
            self.digest.update(b"\n")
        self.digest.update(f"{role}:{text}".encode())
        self.role, self.empty = role[:1], False

    def _next(self) -> str:
        return "assistant" if self.role == "u" else "user"

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._say(self._next(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            self._say(role if letter == "K" else self._next(), text)

    def end(self) -> str:
        self.inserts()
        return self.digest.hexdigest()


def _digests(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256."""
    heads = repairs.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("m"))
    both = heads.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "m"))

    def read(batches):
        conv, now = None, None
        for b in batches:
            convs, digests = [], []
            for c, kind, _, role, text, m in zip(*(x.to_pylist() for x in b.columns)):
                if kind == 0:
                    if now:
                        convs.append(conv)
                        digests.append(now.end())
                    conv, now = c, _Text(text)
                else:
                    for _ in range(m):
                        now.row(role, text)
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([now.end()])], ["conv_id", "repaired_sha256"])

    ordered = both.repartition("conv_id").sortWithinPartitions(_ORDER[0], "kind", *_ORDER[1:])
    return ordered.mapInArrow(read, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 for every conv_id of ``conversations``.

    ``rows`` has conv_id, turn, role, text and m, the number of times that a row
    stands there. gaps: turns that lack between the least and the largest.
    """
    turns, found = faults(rows.withColumn("conv_id", F.col("conv_id").cast("long")))
    ordered = found.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    pieces = cut(ordered.select("conv_id", "turn", "initial", "symbol", "m", "role", "text").mapInArrow(_pieces, _PIECE), "pieces")
    before = Window.partitionBy("conv_id").orderBy("part", "piece")
    last, turn = F.lag("last_initial").over(before), F.lag("last_turn").over(before)
    edges = pieces.select("*", (last.isNotNull() & ~F.concat(last, "first_initial").isin(*_LEGAL)).cast("long").alias("bad"), F.coalesce(turn == F.col("first_turn"), F.lit(False)).cast("long").alias("same"))
    total = lambda c: F.sum(c).alias(c)
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - F.col("same")), F.lit(0))
    counts = edges.groupBy("conv_id").agg(gaps.alias("gaps"), total("blank"), total("duplicate"), total("truncated"), F.sum(F.col("illegal") + F.col("bad")).alias("illegal"))
    repairs = cut(_repairs(pieces), "repairs")
    digests = _digests(turns, repairs)
    key = lambda df: df.withColumnRenamed("conv_id", "c")
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for more in (counts, repairs, digests):
        out = out.join(key(more), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
