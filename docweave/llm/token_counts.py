"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton gives every vocabulary piece that ends at each
character; for each end the best total score is kept with the number of pieces
on its path, and nothing else. The counts are those of the unigram tokenizer of
the sentencepiece library, with its rules for ties and rounding:

- scores add up in 32 bits, and of totals that come out equal the path whose
  last piece starts first wins;
- where the score of a place passes ``RESET`` it and all scores beyond it are
  counted anew from that place, in 32 bits again. Beside a marker whose own score
  is -1e9 this rounds the first pieces of a word to multiples of 64, so a longer
  first piece may win over a better pair; what the rounding does depends on
  the score modulo 64 with which the word before ended;
- a character that no piece covers costs the least score minus 10 and counts
  as its UTF-8 bytes where the vocabulary has bytes; else a run of such is one.

A text gets the marker U+2581 for each space (and one in front). Where scores
are whole numbers and no piece crosses a word's start, each word is solved once
for each such remainder and remembered (characters that no piece has stand alone,
and the score begins anew behind them); other vocabularies go through whole texts.

The public vocabulary file at hand was made for BPE; its pieces and scores are
used as a unigram vocabulary here (the library does the same if the file's model
type is switched), so the counts are those of that unigram tokenizer.

One row comes out for every row. A null or empty text has no characters and no
tokens; null and repeated ids and repeated rows stay as they are, other columns
are not read, and very long texts are counted whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: fixed value of the library: a score beyond it is counted anew
RESET = 100_000


def _single(x: float) -> float:
    """``x`` in 32 bits."""
    return float(np.float32(x))


def fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, kind, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, kind, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield number, kind, data[at : at + size]
        at += size


def pieces(path: str) -> tuple[list[tuple[str, float, int]], dict[int, int]]:
    """(piece, score, type) of a sentencepiece file, and its normaliser flags."""
    out, flags = [], {}
    with open(path, "rb") as f:
        data = f.read()
    for number, _, value in fields(data):
        if number == 1:
            p = {n: v for n, _, v in fields(value)}
            out.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, 1)))
        elif number == 3:
            flags = {n: v for n, k, v in fields(value) if k == 0}
    return out, flags


class Counter:
    """Counts pieces of texts, one distinct word at a time where it can."""

    def __init__(self, path: str, cache_words: int = 1 << 18):
        import ahocorasick

        found, flags = pieces(path)
        if flags.get(4, 1):
            raise ValueError("a vocabulary that drops spaces isn't supported")
        self.prefix = MARK if flags.get(3, 1) else ""
        normal = [(p, s) for p, s, kind in found if kind == 1]
        if any(kind == 4 for _, _, kind in found) or MARK not in dict(normal):
            raise ValueError("a vocabulary with pieces of users, or without the marker, isn't supported")
        self.by_bytes = any(kind == 6 for _, _, kind in found)
        self.unknown = _single(min(s for _, s in normal) - 10)
        self._longest = max(len(p) for p, _ in normal)
        inside = [p.lstrip(MARK) for p, _ in normal]
        known = set("".join(inside)) - {MARK}
        letters = {c for c in known if c.isalpha()}
        if any(x.isalpha() != y.isalpha() for p in inside for x, y in zip(p, p[1:])):
            letters = known  # pieces go from letters to other characters
        some = lambda chars: "".join(map(re.escape, sorted(chars)))
        self._words = re.compile("|".join([f"{MARK}*[{some(c)}]+" for c in (letters, known - letters) if c] + [f"{MARK}+", f"[^{MARK}{some(known)}]+"])).findall
        self._alone = {p for p, _ in normal if len(p) == 1}
        self._pairs = {p for p, _ in normal if len(p) == 2 and p[0] == MARK != p[1]}
        #: results by the difference at the start (from the least) of words met often;
        #: a result is a number of pieces and the score after them, in its lowest bits
        self._rows: dict[str, tuple[int, ...]] = {}
        #: of other words, one result and the differences that have it
        self._once: dict[str, int] = {}
        #: pieces, score and lowest score on the way of words without a marker
        self._free: dict[str, tuple[int, int, int]] = {}
        self._size = cache_words
        self._coarse = self._half = None
        marks = {s for p, s in normal if not p.strip(MARK)}
        across = any(MARK in p or (q.startswith(MARK * 2) and p) for p, (q, _) in zip(inside, normal))
        if len(marks) == 1 and not across and all(s == int(s) <= 0 for _, s in normal) and min(marks) <= -(1 << 24):
            self._coarse = int(min(marks))
            self._half = int(abs(np.spacing(np.float32(self._coarse)))) // 2
            self._coarse = self._coarse if self._half < 1 << 15 else None
            # what rounding beside the marker's score takes off a score: half goes to the even side
            step, odd = 2 * self._half, int(min(marks)) // (2 * self._half) & 1
            quotient, left = np.divmod(np.arange(-RESET, RESET + 1), step)
            over = (left > self._half) | ((left == self._half) & (quotient % 2 != odd))
            self._places = (left - step * over + self._half).tolist()
        self._automaton = ahocorasick.Automaton()
        for p, s in normal:
            self._automaton.add_word(p, (len(p), int(s), self._offsets(p, int(s))) if self._coarse else (len(p), s, None))
        self._automaton.make_automaton()

    def _offsets(self, piece: str, score: int) -> tuple[list[int], list[int]] | None:
        """For each difference at a word's start, from the least, the score of a
        first piece as rounded beside the marker's own; and where it changes."""
        if not piece.strip(MARK) or not piece.startswith(MARK):
            return None
        sums = np.arange(-self._half, self._half + 1) + float(score - self._coarse)
        out = (sums.astype(np.float32).astype(np.float64) + self._coarse).astype(int)
        return out.tolist(), (np.flatnonzero(np.diff(out)) + 1).tolist()

    def _exact(self, text: str, start: float) -> tuple[int, float]:
        """Pieces of a text and the score at its end, in 32-bit steps from the
        score ``start``."""
        n, longest = len(text), self._longest
        by_start: list[list[tuple[int, float]]] = [[] for _ in text]
        for end, (size, score, _) in self._automaton.iter(text):
            by_start[end + 1 - size].append((size, score))
        best: list[float | None] = [start, *[None] * n]
        count, last_unknown = [0] * (n + 1), [False] * (n + 1)
        for i, found in enumerate(by_start):
            here = best[i]
            if abs(here) > RESET:
                for j in range(i + 1, min(n, i + longest) + 1):
                    if best[j] is not None:
                        best[j] = _single(best[j] - here)
                here = 0.0
            for size, score in found:
                total = _single(here + score)
                if best[i + size] is None or total > best[i + size]:
                    best[i + size], count[i + size], last_unknown[i + size] = total, count[i] + 1, False
            if not any(size == 1 for size, _ in found):
                total = _single(here + self.unknown)
                if best[i + 1] is None or total > best[i + 1]:
                    more = len(text[i].encode()) if self.by_bytes else not last_unknown[i]
                    best[i + 1], count[i + 1], last_unknown[i + 1] = total, count[i] + more, True
        return count[n], best[n]

    def _marked(self, word: str, place: int) -> int:
        """The result of a word with a marker for a score before it (from
        -RESET). Differences that round its first pieces alike have one result;
        a word that is met with another one is solved for all."""
        at = self._places[place]
        once = self._once.get(word)
        if once is not None and once >> 16 & 0xFFFF <= at < once & 0xFFFF:
            return once >> 32
        found = list(self._automaton.iter(word))  # by end, the longest first
        # the marker with one character, and the longer first pieces
        first = [piece[2] for _, piece in found if piece[2]]
        zero = first.pop(0) if first and word[:2] in self._pairs else None
        if word[:2] == MARK * 2 or not self._alone.issuperset(word) or (first and not zero):
            return self._after(*self._exact(word, float(place - RESET)))
        n = len(word)
        if not zero:
            here = self._after(*self._plain(found, n, 1, ())[:2])
            self._once[word] = here << 32 | 0xFFFF
            return here
        if once is None:
            here = self._after(*self._plain(found, n, 2, [f[0][at] - zero[0][at] for f in first])[:2])
            low, high = 0, 2 * self._half + 1
            for f in (zero, *first):
                for step in f[1]:
                    if low < step <= at:
                        low = step
                    elif at < step < high:
                        high = step
            self._once[word] = here << 32 | low << 16 | high
            return here
        ways: dict[tuple[int, ...], int] = {}

        def result(i: int) -> int:
            way = tuple([f[0][i] - zero[0][i] for f in first])
            if way not in ways:
                ways[way] = self._after(*self._plain(found, n, 2, way)[:2])
            return ways[way]

        row: list[int] = []
        steps = sorted({0, *zero[1], *(i for f in first for i in f[1])})
        for here, after in zip(steps, [*steps[1:], 2 * self._half + 1]):
            row += [result(here)] * (after - here)
        self._rows[word] = tuple(row)
        del self._once[word]
        return row[at]

    def _unmarked(self, word: str, place: int) -> int:
        """The same for a word without a marker: nothing is rounded there."""
        if word[0] not in self._alone and not any(True for _ in self._automaton.iter(word)):
            return self._after(len(word.encode()) if self.by_bytes else 1, RESET + 1)  # no piece has these
        if not self._alone.issuperset(word):
            return self._after(*self._exact(word, float(place - RESET)))
        found = list(self._automaton.iter(word))
        if word not in self._free:
            self._free[word] = self._plain(found, len(word), 0, ())
        return self._after(*self._plain(found, len(word), 0, (), place - RESET)[:2])

    @staticmethod
    def _after(pieces_: int, score: float) -> int:
        return pieces_ << 18 | (int(score) + RESET if -RESET <= score <= RESET else RESET)

    @staticmethod
    def _plain(found: list[tuple[int, tuple]], n: int, begin: int, way: Sequence[int], before: int = 0) -> tuple[int, int, int]:
        """Pieces, score and lowest score in whole numbers, for a word whose every character
        is a piece. It begins behind the marker and its first character (2), for
        only the scores of its first pieces are rounded, and ``way`` is how,
        beside that of the shortest; or at once (0), or behind the marker (1)."""
        best, count = [-(1 << 60)] * (n + 1), [0] * (n + 1)
        best[begin], count[begin] = 0, int(begin > 0)
        turn = 0
        for end, (size, score, rounded) in found:
            end += 1
            if rounded is None:
                total = best[end - size] + score
                if total > best[end]:
                    best[end], count[end] = total, count[end - size] + 1
            elif size > 2:  # the first of its end
                best[end], count[end] = way[turn], 1
                turn += 1
        zero = -before  # the score from which scores are counted
        low = min(best[begin:])
        if low + before < -RESET or (way and max(way) > RESET):
            for score in best[begin:n]:
                if not -RESET <= score - zero <= RESET:
                    zero = score
        return count[n], best[n] - zero, low

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = self.prefix + text.replace(" ", MARK)
        if self._coarse is None:
            return self._exact(text, 0.0)[0]
        rows, free, places = self._rows, self._free, self._places
        total, place = 0, RESET
        for word in self._words(text):
            if word[0] == MARK:
                row = rows.get(word)
                found = row[places[place]] if row else self._marked(word, place)
            else:
                own = free.get(word)
                if own and place + own[2] >= 0:
                    total += own[0]
                    place += own[1]
                    continue
                found = self._unmarked(word, place)
            total += found >> 18
            place = found & 0x3FFFF
        for cache, size in ((rows, self._size), (self._once, 2 * self._size), (free, self._size)):
            if len(cache) > size:
                # words met first are the frequent ones; those met late go
                for w in list(cache)[size // 2 :]:
                    del cache[w]
        return total


_kept: dict[str, Counter] = {}


def token_counts(docs: DataFrame, *, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_tokens for every row; a null text has none of either."""

    def run(batches):
        if vocabulary not in _kept:
            _kept[vocabulary] = Counter(vocabulary)
        counter = _kept[vocabulary]
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = b.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([counter.count(t) for t in texts], pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_chars long, n_tokens long")
