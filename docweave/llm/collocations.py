"""Phrase collocations by prefix-free parsing.

A text is parsed at triggers: places where a hash of two neighbouring words is
divisible by ``SPACING``. A chunk runs from one trigger to the end of the next,
so neighbouring chunks overlap by two words, and equal passages give equal chunks
wherever they stand. Chunks become a dictionary with parse frequencies; n-grams
are counted inside distinct chunks, weighted by frequency. A run of up to three
words belongs to the chunk in which it starts before the closing trigger (a
text's last chunk has none), so runs in an overlap count once.

Counting goes from short to long. First every word is counted by a 64-bit hash;
then runs of two whose words both reach the least count, then runs of three of such
pairs; then, as texts, the runs that can still reach it. Counts by hash may be too large where hashes meet, never
too small, so they only leave out what can't reach the least count; every result
comes from exact counts by text. What passes is a table of bits in the shared
folder, at most ``2**MOST_BITS``; a full table lets more pass and loses nothing.

A-Z are lower-cased. Pieces end at ``[.,;:!?]`` and line breaks, words at blanks
and tabs; everything is per language, null is ``und`` and meets what is called so.
Null and empty texts have no words; texts are read whole; ids aren't looked at, so
repeated rows count as often as they stand there. Within a block of a task words
are told apart by their 64-bit hashes. Counts up to 10**15 are exact. Other columns
are not looked at. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._scratch import cut, release
from ._words import _buffers, _hash, mix

#: mean number of words from one trigger to the next
SPACING = 48
MOST_BITS = 30
#: bytes of texts or chunks that a task takes at once
BLOCK = 1 << 23
#: salted groups of a language that are ranked before the language is
SALTS = 64

_U = np.uint64
_P = [_U(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ENDS = np.zeros(256, bool)  # of pieces
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False


class _Table:
    """Words of some texts: their byte ranges, texts, pieces and hashes."""

    def __init__(self, column: pa.Array):
        data, offsets = _buffers(column)
        at, n = int(offsets[0]), int(offsets[-1] - offsets[0])
        self.raw = data[at : at + n].tobytes().translate(_LOWER)
        text, rel = np.frombuffer(self.raw, np.uint8), offsets - at
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = _WORD[text]
        edge = np.zeros(n + 1, bool)
        edge[rel] = True
        self.start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        ends = np.zeros(n + 1, np.int32)
        np.cumsum(_ENDS[text], out=ends[1:])
        self.text = np.searchsorted(rel, self.start, "right") - 1
        self.ptr = np.searchsorted(self.start, rel)
        piece = ends[self.start]
        # word i + 1 goes on in the piece of word i
        self.joined = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])
        self.hash = _hash(text, self.start, self.end)

    def runs(self, n: int) -> np.ndarray:
        """Places where a run of n words of one piece starts."""
        if n == 1:
            return np.arange(len(self.hash))
        ok = self.joined if n == 2 else self.joined[:-1] & self.joined[1:]
        return np.flatnonzero(ok)

    def codes(self, at: np.ndarray, n: int, lang: np.ndarray) -> np.ndarray:
        """Hashes of the runs of n words at some places; ``lang`` by text."""
        h = lang[self.text[at]] + _U(n)
        for k in range(n):
            h = h + self.hash[at + k] * _P[k]
        return mix(h)


def _lang_codes(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    names = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    return np.array(names, _U)[coded.indices.to_numpy()] if names else np.zeros(0, _U)


def _blocks(batches, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of about ``BLOCK`` bytes (a longer text stands alone)."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy())
        first = 0
        while first < b.num_rows:
            before = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, before + BLOCK, "right")))
            yield b.slice(first, last - first)
            first = last


def _parse(batches) -> Iterator[pa.RecordBatch]:
    """(lang, chunk, tail, f): distinct chunks of each block with their number."""
    for b in _blocks(batches, "text"):
        t = _Table(b.column("text"))
        trigger = np.zeros(len(t.hash), bool)
        if len(t.hash) > 1:
            same = t.text[1:] == t.text[:-1]
            trigger[:-1] = same & (mix(t.hash[:-1] * _P[0] + t.hash[1:] * _P[1]) % _U(SPACING) == 0)
        trigger[t.ptr[:-1][np.diff(t.ptr) > 0]] = True  # a text's first word opens its first chunk
        first = np.flatnonzero(trigger)
        nxt = np.append(first[1:], len(t.hash))
        tail = np.append(t.text[first[1:]] != t.text[first[:-1]], True) if len(first) else np.zeros(0, bool)
        last = np.where(tail, nxt, nxt + 2) - 1
        langs = b.column("lang").to_pylist()
        texts = t.text[first].tolist()
        found = Counter((langs[x], t.raw[s:e], z) for x, s, e, z in zip(texts, t.start[first].tolist(), t.end[last].tolist(), tail.tolist()))
        if found:
            lang, chunk, tails = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(chunk, pa.binary()), pa.array(tails, pa.bool_()), pa.array(list(found.values()), pa.int64())], ["lang", "chunk", "tail", "f"])


def dictionary(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, chunk, tail, f: the distinct chunks of all texts and how often each
    stands in the parse; ``tail`` marks those that end a text."""
    named = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return named.mapInArrow(_parse, "lang string, chunk binary, tail boolean, f long").groupBy("lang", "chunk", "tail").agg(F.sum("f").alias("f"))


class _Chunks(_Table):
    """Words of chunks; runs count where they start in words that a chunk owns."""

    def __init__(self, b: pa.RecordBatch):
        super().__init__(b.column("chunk").cast(pa.large_binary()))
        self.lang = _lang_codes(b.column("lang"))
        self.names = b.column("lang")
        self.f = b.column("f").to_numpy()
        lost = np.where(b.column("tail").to_numpy(zero_copy_only=False), 0, 2)
        self.owned = np.arange(len(self.hash)) < (self.ptr[1:] - lost)[self.text]

    def starts(self, n: int) -> np.ndarray:
        at = self.runs(n)
        return at[self.owned[at]]

    def weights(self, at: np.ndarray) -> np.ndarray:
        return self.f[self.text[at]]


def _summed(code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes, a place of each, sums of weights)."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[first], order[first], np.add.reduceat(weight[order], first) if len(first) else weight[:0]


class Bits:
    """Hashes that may reach the least count, as bits in the shared folder."""

    def __init__(self, counts: DataFrame, least: int):
        frequent = counts.where(F.col("f") >= least)
        self.power = int(min(MOST_BITS, max(16, math.ceil(math.log2(16 * (frequent.count() or 1))))))
        place = F.shiftrightunsigned("code", 64 - self.power)
        word = frequent.select(F.shiftrightunsigned(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("bit"))
        self.table = cut(word.groupBy("word").agg(F.bit_or("bit").alias("bits")), "bits")
        self.folder = self.table._docweave_path

    def read(self) -> np.ndarray:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        out = np.zeros(1 << (self.power - 6), _U)
        for b in pads.dataset(base, filesystem=fs, format="parquet").to_batches(columns=["word", "bits"]):
            out[b.column(0).to_numpy()] = b.column(1).to_numpy().view(_U)
        return out

    @staticmethod
    def has(bits: np.ndarray, code: np.ndarray) -> np.ndarray:
        place = code >> _U(64 - (len(bits).bit_length() + 5))
        return (bits[place >> _U(6)] >> (place & _U(63)) & _U(1)).astype(bool)


_held: dict[str, np.ndarray] = {}


def _bits(table: Bits) -> np.ndarray:
    """A worker reads a table once."""
    if table.folder not in _held:
        while len(_held) >= 3:
            del _held[next(iter(_held))]
        _held[table.folder] = table.read()
    return _held[table.folder]


class _Told:
    """What tasks need of :class:`Bits`; a data frame can't go with them."""

    def __init__(self, bits: Bits):
        self.power, self.folder = bits.power, bits.folder

    read = Bits.read


def _coded(code, lang, f) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), lang, pa.array(f, pa.int64())], ["code", "lang", "f"])


def _passing(t: _Chunks, n: int, below: np.ndarray) -> np.ndarray:
    """Starts of runs of n words both of whose parts of n - 1 pass."""
    at = t.starts(n)
    return at[Bits.has(below, t.codes(at, n - 1, t.lang)) & Bits.has(below, t.codes(at + 1, n - 1, t.lang))]


def phrase_counts(docs: DataFrame, *, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) for all phrases of up to three words that stand at
    least ``least`` times, and (lang, n): the number of all words."""
    chunks = cut(dictionary(docs, text_col=text_col, lang_col=lang_col), "chunks")

    def words(batches):
        for b in _blocks(batches, "chunk"):
            t = _Chunks(b)
            at = t.starts(1)
            code, place, f = _summed(t.codes(at, 1, t.lang), t.weights(at))
            yield _coded(code, t.names.take(pa.array(t.text[at[place]])), f)

    one = cut(chunks.mapInArrow(words, "code long, lang string, f long").groupBy("code", "lang").agg(F.sum("f").alias("f")), "words")
    totals = one.groupBy("lang").agg(F.sum("f").alias("n"))
    bits1 = _Told(Bits(one, least))

    def runs(n: int, below: _Told) -> DataFrame:
        """Hashes of runs of n words that reach the least count."""

        def count(batches):
            for b in _blocks(batches, "chunk"):
                t = _Chunks(b)
                at = _passing(t, n, _bits(below))
                code, _, f = _summed(t.codes(at, n, t.lang), t.weights(at))
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(f, pa.int64())], ["code", "f"])

        return cut(chunks.mapInArrow(count, "code long, f long").groupBy("code").agg(F.sum("f").alias("f")).where(F.col("f") >= least), f"runs{n}")

    two = runs(2, bits1)
    bits2 = _Told(Bits(two, least))
    three = runs(3, bits2)
    bits3 = _Told(Bits(three, least))

    def phrases(batches):
        for b in _blocks(batches, "chunk"):
            t = _Chunks(b)
            for n, bits in ((1, bits1), (2, bits2), (3, bits3)):
                at = t.starts(n)
                code = t.codes(at, n, t.lang)
                passes = Bits.has(_bits(bits), code)
                at, code = at[passes], code[passes]
                _, place, f = _summed(code, t.weights(at))
                at = at[place]
                parts = [[t.raw[s:e] for s, e in zip(t.start[at + k].tolist(), t.end[at + k].tolist())] for k in range(n)]
                text = pa.array(list(map(b" ".join, zip(*parts))) if len(at) else [], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([t.names.take(pa.array(t.text[at])), pa.array(np.full(len(at), n, np.int32)), text, pa.array(f, pa.int64())], ["lang", "k", "phrase", "f"])

    counted = chunks.mapInArrow(phrases, "lang string, k int, phrase string, f long").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    out = cut(counted.where(F.col("f") >= least), "phrases")
    release(chunks, two, three)
    return out, totals


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    return F.expr(f"(1000000BD * cast({a} as decimal(16)) * cast({a} as decimal(16))) div (cast({left} as decimal(16)) * cast({right} as decimal(16)))")


def collocations(docs: DataFrame, *, least: int = 10, share: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` best phrases of two or
    three words of each language.

    A phrase is dropped if it stands in a longer one that has ``share`` percent
    of its count or more. Ties: the larger count, then the smaller phrase by bytes.
    """
    counts, totals = phrase_counts(docs, least=least, text_col=text_col, lang_col=lang_col)
    word = F.split("phrase", " ")
    joined = lambda s, n: F.array_join(F.slice(word, s, n), " ")
    cuts = F.array(*(F.when(F.col("k") > c, F.struct(F.lit(c).alias("cut"), joined(1, c).alias("left"), F.array_join(F.slice(word, F.lit(c + 1), F.col("k") - c), " ").alias("right"))) for c in (1, 2)))
    candidates = counts.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.explode(F.filter(cuts, lambda x: x.isNotNull())).alias("at"))
    part = counts.select("lang", "phrase", "f")
    sides = (
        candidates.select("lang", "k", "phrase", "a", "at.*")
        .join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    )
    scored = sides.select("lang", "k", "phrase", "a", F.struct(_score("a", "l", "r").alias("score"), "cut", "l", "r").alias("best"))
    lowest = scored.groupBy("lang", "k", "phrase", "a").agg(F.min("best").alias("best"))
    inner = counts.where("k = 3").select("lang", F.col("f").alias("longer"), F.explode(F.array_distinct(F.array(joined(1, 2), joined(2, 2)))).alias("phrase"))
    within = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(within, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {share} * a")
    rows = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", "salt"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(keys).orderBy(order))).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
