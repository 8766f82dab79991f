"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of every benchmark item. A document's
words walk through it, and the walk knows after each word how long the longest
run is that ends there and stands in some item. A window is 13 consecutive
item words, or a whole item of fewer words; words of a document inside an
occurrence of a window are hit.

Most text never comes near an item: a window can only lie in a run of words
whose every neighbouring pair also stands in an item, so only such runs are
walked; one table of bits for the pairs of all items finds them for whole byte
buffers at once.

Items are taken in blocks of a bounded number of words, each with its own
automaton in a file of the shared folder. A worker reads a text once, holds its
runs against every block, and keeps at most ``HELD`` automata: neither passes
over the documents nor memory grow with the benchmark, and rows are never
matched up by their ids, so repeated and null ids change nothing.

Words are compared by 64-bit hashes. Null texts have no words; items without
words have no windows; an item with a null id is left out, and rows of one item
id count as one item. Long texts and items are read whole. Columns of ``docs``
other than id and text are not looked at; ``keep_clean`` and ``remove_spans``
pass them on. An empty benchmark hits nothing; no rows give no rows.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._resident import resident
from ._scratch import cut, new_path, release
from ._words import ALNUM, Words, blocks

WINDOW = 13
#: words of items for which one automaton is built (about 0.2 kB a word)
BLOCK_WORDS = 400_000
#: automata that a worker keeps
HELD = 4
#: bytes of text between two readings of an automaton, where there are more
CHUNK = 1 << 26
MOST_BITS = 27


class Automaton:
    """A generalised suffix automaton over sequences of small integers."""

    def __init__(self, sequences: list[tuple[str, list[int]]], window: int = WINDOW):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, seq in sequences:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.window = window
        self.cut = self._cuts()
        #: items that have a window of full size at a state
        self.full: dict[int, list[str]] = {}
        #: (longest, items) of shorter items that end at a state
        self.short: dict[int, tuple[int, list[str]]] = {}
        for item, seq in sequences:
            state = 0
            for i, c in enumerate(seq):
                state = self.next[state][c]
                if i + 1 >= window:
                    found = self.full.setdefault(self.cut[state], [])
                    if not found or found[-1] != item:
                        found.append(item)
            if 0 < len(seq) < window:
                self.short.setdefault(state, (len(seq), []))[1].append(item)
        self.above = self._shorts()

    def _by_length(self) -> list[int]:
        return sorted(range(1, len(self.length)), key=self.length.__getitem__)

    def _cuts(self) -> list[int]:
        """For each state that of the last ``window`` words of a run that ends in it."""
        cut = list(range(len(self.link)))
        for state in self._by_length():
            if self.length[self.link[state]] >= self.window:
                cut[state] = cut[self.link[state]]
        return cut

    def _shorts(self) -> list[int]:
        """For each state the nearest above it at which a shorter item ends, or 0."""
        above = [0] * len(self.link)
        for state in self._by_length() if self.short else ():
            up = self.link[state]
            above[state] = up if up in self.short else above[up]
        return above

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def walk(self, seq: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (maximal, in order) and items with windows here.
        A word takes a constant time on average, however often words repeat."""
        nxt, link, length = self.next, self.link, self.length
        state, run = 0, 0
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        told: set[int] = set()

        def hit(s: int, e: int) -> None:
            while spans and spans[-1][1] >= s:
                s = min(s, spans.pop()[0])
            spans.append((s, e))

        for i, c in enumerate(seq, 1):
            while state and c not in nxt[state]:
                state = link[state]
                run = length[state]
            if c in nxt[state]:
                state, run = nxt[state][c], run + 1
            if run >= self.window:
                at = self.cut[state]
                if at in self.full:
                    hit(i - self.window, i)
                    if at not in told:
                        told.add(at)
                        items.update(self.full[at])
            if self.short:
                # items that end at a state have one length: they are the same words
                own = self.short.get(state)
                at = state if own and own[0] <= run else self.above[state]
                if at:
                    hit(i - self.short[at][0], i)
                while at and -at not in told:  # those further up are told already
                    told.add(-at)
                    items.update(self.short[at][1])
                    at = self.above[at]
        return spans, items


class Matcher:
    """The items of one block: their automaton, and codes for their words."""

    def __init__(self, ids: list[str], held: list[np.ndarray], window: int):
        flat = np.concatenate(held)
        self.vocabulary, coded = np.unique(flat, return_inverse=True)
        code, ends = coded.tolist(), np.cumsum([0, *map(len, held)]).tolist()
        self.automaton = Automaton([(i, code[s:e]) for i, s, e in zip(ids, ends, ends[1:]) if e > s], window)

    def walk(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words in a run of hashed words, and items."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return self.automaton.walk(np.where(self.vocabulary[at] == words, at, -1).tolist())


def _pair_bits(words: np.ndarray, power: int) -> np.ndarray:
    """A place of ``2**power`` for every two neighbouring words."""
    return (words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - power)


def _word_bits(words: np.ndarray, power: int) -> np.ndarray:
    return (words * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - power)


class Items:
    """Benchmark items in files of the shared folder: a matcher for each block
    of about ``block_words`` words, and one table of bits for the neighbouring
    words of all items, of at most ``2**MOST_BITS`` bits.

    Made by tasks: the driver sees one short row for a block. Long items are
    taken apart into pieces that overlap by a window less one word, so every
    window lies in a piece.
    """

    def __init__(self, items: DataFrame, *, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS):
        spark = items.sparkSession
        self.window, self.folder = window, new_path(spark, "items")
        size = max(window, block_words // 8)

        def pieces(batches):
            for b in batches:
                for first, end, words in blocks(b.column(1), ALNUM):
                    item, place, part = [], [], []
                    for i in range(end - first):
                        seq = words.hashes[words.ptr[i] : words.ptr[i + 1]].view(np.int64)
                        for s in range(0, max(1, len(seq) - window + 1), size) if len(seq) else ():
                            item.append(first + i)
                            place.append(s)
                            part.append(seq[s : s + size + window - 1])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(item, pa.int64())), pa.array(place, pa.int64()), pa.array(part, pa.list_(pa.int64()))], ["item", "place", "words"])

        named = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null")
        cut_up = cut(named.mapInArrow(pieces, "item string, place long, words array<long>"), "pieces")
        seen = cut_up.agg(F.sum(F.size("words")).alias("n"), F.min(F.size("words")).alias("least")).first()
        self.least = int(seen["least"] or 0)
        self.power = int(min(MOST_BITS, max(16, math.ceil(math.log2(16 * (seen["n"] or 1))))))
        n_blocks = max(1, -(-(seen["n"] or 0) // block_words))
        folder, power = self.folder, self.power

        def build(group: pa.Table) -> pa.Table:
            group = group.sort_by([("item", "ascending"), ("place", "ascending")])
            held = [np.array(w, np.int64).view(np.uint64) for w in group.column("words").to_pylist()]
            fs, base = pafs.FileSystem.from_uri(folder)
            fs.create_dir(base, recursive=True)
            name = f"block-{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(pickle.dumps(Matcher(group.column("item").to_pylist(), held, window), 5))
            with fs.open_output_stream(f"{base}/{name}.bits") as out:
                out.write(pickle.dumps([np.unique(np.concatenate([f(h, power) for h in held])) for f in (_pair_bits, _word_bits)], 5))
            return pa.table({"name": [name]})

        def gather(batches):
            names = [n for b in batches for n in b.column(0).to_pylist()]
            fs, base = pafs.FileSystem.from_uri(folder)
            tables = np.zeros((2, 1 << power - 3), np.uint8)
            for name in names:
                with fs.open_input_file(f"{base}/{name}.bits") as f:
                    for table, at in zip(tables, pickle.loads(f.read())):
                        np.bitwise_or.at(table, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            if names:
                bits = f"bits-{uuid.uuid4().hex}"
                with fs.open_output_stream(f"{base}/{bits}") as out:
                    out.write(tables.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([bits]), pa.array([sorted(names)])], ["bits", "names"])

        block = F.pmod(F.xxhash64("item", "place"), F.lit(n_blocks)).alias("block")
        told = cut(cut_up.select("*", block).groupBy("block").applyInArrow(build, "name string"), "blocks")  # one attempt's files count
        row = told.coalesce(1).mapInArrow(gather, "bits string, names array<string>").first()
        self.bits, self.names = (row["bits"], row["names"]) if row else ("", [])
        release(cut_up, told)

    def _read(self, name: str) -> bytes:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_file(f"{base}/{name}") as f:
            return f.read()


class Finder:
    """A worker's side of :class:`Items`: at most ``HELD`` matchers at once."""

    def __init__(self, items: Items):
        self.items = items
        self.bits = np.frombuffer(items._read(items.bits), np.uint8).reshape(2, -1) if items.names else None
        self._held: dict[str, Matcher] = {}

    @property
    def chunk(self) -> int:
        """Bytes of text to gather before :meth:`solve`: where matchers come
        and go each is read once for a chunk."""
        return CHUNK if len(self.items.names) > HELD else 0

    def _matcher(self, name: str) -> Matcher:
        found = self._held.pop(name, None)
        if found is None:
            while len(self._held) >= HELD:
                del self._held[next(iter(self._held))]
            found = pickle.loads(self.items._read(name))
        self._held[name] = found
        return found

    def _set(self, table: int, at: np.ndarray) -> np.ndarray:
        return (self.bits[table][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def runs(self, words: Words) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, place in it, words) of the runs in which a window can lie:
        all neighbours of a window are neighbours in an item."""
        w, ptr, power = words.hashes, words.ptr, self.items.power
        if not len(w) or self.bits is None:
            return
        joined = np.zeros(len(w) + 1, bool)  # word i and i - 1 may stand together in an item
        if len(w) > 1:
            joined[1:-1] = self._set(0, _pair_bits(w, power))
            joined[ptr] = False
        known = self._set(1, _word_bits(w, power)) if self.items.least == 1 else joined[:-1] | joined[1:]
        begin = np.flatnonzero(known & ~joined[:-1])
        end = np.flatnonzero(known & ~joined[1:]) + 1
        long = end - begin >= self.items.least
        for s, e in zip(begin[long].tolist(), end[long].tolist()):
            text = int(np.searchsorted(ptr, s, "right")) - 1
            yield text, s - int(ptr[text]), w[s:e]

    def solve(self, runs: list[tuple[object, int, np.ndarray]]) -> dict:
        """By text: its spans of hit words (maximal, in order) and its items."""
        found: dict = {}
        for name in self.items.names if runs else ():
            matcher = self._matcher(name)
            for text, at, words in runs:
                spans, items = matcher.walk(words)
                if spans:
                    all_spans, all_items = found.setdefault(text, ([], set()))
                    all_spans += [(at + s, at + e) for s, e in spans]
                    all_items |= items
        return {k: (merged(s), i) for k, (s, i) in found.items()}


_kept: dict[str, Finder] = resident()


def _found(batches, place: int, items: Items) -> Iterator[tuple[pa.RecordBatch, np.ndarray, dict]]:
    """(batch, words of each text, by row its spans and items), for parts of the batches."""
    if items.folder not in _kept:
        _kept.clear()
        _kept[items.folder] = Finder(items)
    finder = _kept[items.folder]
    waiting: list[tuple[pa.RecordBatch, np.ndarray]] = []
    runs: list = []
    size = 0

    def flush():
        found: list[dict] = [{} for _ in waiting]
        for (n, i), value in finder.solve(runs).items():
            found[n][i] = value
        for (part, n_words), here in zip(waiting, found):
            yield part, n_words, here
        waiting.clear()
        runs.clear()

    for b in batches:
        for first, end, words in blocks(b.column(place), ALNUM):
            runs += [((len(waiting), i), at, w.copy()) for i, at, w in finder.runs(words)]
            waiting.append((b.slice(first, end - first), np.diff(words.ptr)))
            size += waiting[-1][0].column(place).nbytes
            if size >= finder.chunk:
                yield from flush()
                size = 0
    yield from flush()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def find_windows(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, spans (of hit words; maximal, in order), items (sorted):
    one row for every row of ``docs``, found in one pass over it. ``options``
    are those of :class:`Items`; none but ``window`` changes a row."""
    held = Items(items, **options)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b, n_words, found in _found(batches, 1, held):
            spans: list[list] = [[] for _ in range(b.num_rows)]
            names: list[list] = [[] for _ in range(b.num_rows)]
            for i, (s, n) in found.items():
                spans[i] = [{"start": x, "end": y} for x, y in s]
                names[i] = sorted(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(names, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "items"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans: a
    document is contaminated if at least a twentieth of its words is hit."""
    found = find_windows(docs, items, **options)
    n_hit = F.reduce("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans")
    flag = (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), flag.alias("contaminated"), "spans")


def keep_clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, as they are."""
    held = Items(items, **options)
    place = docs.columns.index(text_col)

    def run(batches):
        for b, n_words, found in _found(batches, place, held):
            clean = np.ones(b.num_rows, bool)
            for i, (spans, _) in found.items():
                clean[i] = sum(e - s for s, e in spans) * 20 < n_words[i]
            yield b if clean.all() else b.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def remove_spans(docs: DataFrame, items: DataFrame, *, max_words: int | None = None, max_share: float = 0.05, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with benchmark passages cut out of their texts.

    Where at least ``max_share`` of the words is hit all spans go; elsewhere
    those of more than ``max_words`` words do (none, where it is null). A span
    is cut from its first word's start to its last word's end. Other texts stay
    as they are.
    """
    held = Items(items, **options)
    place = docs.columns.index(text_col)

    def cleaned(text: str, spans: list[tuple[int, int]]) -> str:
        raw = text.encode()
        at = [(m.start(), m.end()) for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw.translate(_LOWER))]
        all_go = sum(e - s for s, e in spans) >= max_share * len(at)
        out, last = [], 0
        for s, e in spans:
            if all_go or (max_words is not None and e - s > max_words):
                out.append(raw[last : at[s][0]])
                last = at[e - 1][1]
        return b"".join([*out, raw[last:]]).decode()

    def run(batches):
        for b, _, found in _found(batches, place, held):
            if found:
                texts = b.column(place).to_pylist()
                for i, (spans, _) in found.items():
                    texts[i] = cleaned(texts[i], spans)
                b = b.set_column(place, b.schema.field(place), pa.array(texts, b.schema.field(place).type))
            yield b

    return docs.mapInArrow(run, docs.schema)
