"""BPE encoding and decoding by speculation and verification.

Words that a worker hasn't met are encoded together. For each, greedy longest
match over the vocabulary proposes tokens. A proposal is the right encoding
if and only if every two neighbouring tokens are compatible, that is, merging
the two tokens' text alone gives these two tokens. That is tested for all
neighbours of all words at once, with numpy: both tokens are taken apart along
the side that faces the other, latest merge first, and the pair is refused if a
merge across the border would have come before the one taken back. Only words
with a refused pair, or in which greedy matching stops, are merged step by step.

Texts are normalised and split as the tokenizer's file says. Texts of common
characters take a direct way that gives the same words; others go through the
library's own normaliser and splitter. Special tokens in a text are found
first, in the text as it is.

One row comes out for every row: a null text is an empty one, without ids; null
and repeated ids and repeated rows stay as they are; other columns are not read.
Very long texts, and very long words, are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._resident import resident, tidy
from .token_files import _byte_of

_NONE = np.int64(2**31)
_LONG = 100  # tokens from which a heap beats looking through all pairs


class Merger:
    """Encodes words (strings of byte-level characters) of one BPE table."""

    def __init__(self, spec: dict):
        model = spec["model"]
        for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"):
            if model.get(k):
                raise ValueError(f"a BPE file with {k} isn't supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.tokens = [""] * (max(self.vocab.values()) + 1)
        for t, i in self.vocab.items():
            self.tokens[i] = t
        n = len(self.tokens)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        #: rank and result of the merge of a pair, in one number that orders by rank
        self.rank = {(a, b): i << 32 | m for i, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist()))}
        key = left * n + right
        self._order = np.argsort(key)
        self._keys, self._n = key[self._order], n
        #: how a token comes about: rank of its merge, or -1, and its parts
        self.born, self.left, self.right = np.full(n, -1, np.int64), np.arange(n), np.arange(n)
        self.born[made[::-1]] = np.arange(len(pairs))[::-1]
        self.left[made[::-1]], self.right[made[::-1]] = left[::-1], right[::-1]
        # what greedy matching may propose: tokens that their own text gives
        self._inner: dict[str, int] = {}
        self._final: dict[str, int] = {}
        self._longest = 1
        for t, i in self.vocab.items():
            last = bool(self.suffix) and t.endswith(self.suffix)
            text = t.removesuffix(self.suffix) if last else t
            if self._merge(text, last) == [i]:
                (self._final if last or not self.suffix else self._inner)[text] = i
                if not self.suffix:
                    self._inner[text] = i
                self._longest = max(self._longest, len(text))
        #: the longest token that starts with three characters
        self._reach: dict[str, int] = {}
        for t in self._inner:
            if len(t) > 2:
                self._reach[t[:3]] = max(self._reach.get(t[:3], 0), len(t))

    def _merge(self, word: str, final: bool = True) -> list[int]:
        """The tokens of a word by exact merging: lowest rank first, leftmost
        of equal ones first."""
        parts = list(word)
        if final and parts:
            parts[-1] += self.suffix
        ids = list(map(self.vocab.__getitem__, parts))
        rank = self.rank.get
        if len(ids) > _LONG:
            return self._merge_long(ids)
        none = 1 << 62
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [best & 0xFFFFFFFF]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and linked neighbours: n log n steps."""
        rank = self.rank.get
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i, pair in enumerate(zip(ids, ids[1:])) if (r := rank(pair)) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            # a pair that has changed since is another merge, or none
            if ids[i] < 0 or j >= n or rank((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = r & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((ids[i], ids[k]))) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank((ids[h], ids[i]))) is not None:
                heappush(heap, (r, h))
        return [i for i in ids if i >= 0]

    def _propose(self, word: str) -> list[int] | None:
        """Greedy longest match; None if it stops before the end."""
        out, at, n = [], 0, len(word)
        inner, final, longest, reach = self._inner.get, self._final.get, self._longest, self._reach.get
        while at < n:
            left = n - at
            if left <= longest and (t := final(word[at:])) is not None:
                out.append(t)
                return out
            for size in range(min(reach(word[at : at + 3], 2), left - 1), 0, -1):
                if (t := inner(word[at : at + size])) is not None:
                    out.append(t)
                    at += size
                    break
            else:
                return None
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether their texts merged alone give them."""
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), _NONE)
        while len(live):
            key = x * self._n + y
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            rank = np.where(self._keys[at] == key, self._order[at], _NONE)
            # limit: the merge across must come before this, else it can't come
            refused = rank < limit
            out[live[refused]] = False
            bx, by = self.born[x], self.born[y]
            go = ~refused & ((bx >= 0) | (by >= 0))
            live, x, y, bx, by = live[go], x[go], y[go], bx[go], by[go]
            first = bx > by  # x came last; of equal merges the right one does
            limit = np.where(first, bx, by + 1)  # an equal merge further left wins
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        proposed = [self._propose(w) for w in words]
        sizes = np.array([len(p) if p else 0 for p in proposed])
        flat = np.array([t for p in proposed if p for t in p], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = owner[:-1] == owner[1:]
        pairs, back = np.unique(flat[:-1][inside] * self._n + flat[1:][inside], return_inverse=True)
        good = self.compatible(pairs // self._n, pairs % self._n)[back]
        failed = np.zeros(len(words), bool)
        failed[owner[:-1][inside][~good]] = True
        return [self._merge(w) if bad or p is None else p for w, p, bad in zip(words, proposed, failed.tolist())]


#: bytes that a worker keeps of chunks and of words between texts
CACHE_BYTES = (72 << 20, 24 << 20)


class Tokenizer:
    """Ids and decoded text as the tokenizers library gives them, for BPE files
    that normalise by NFC, white space and lower case and split by a pattern."""

    def __init__(self, path: str, cache_bytes: tuple[int, int] = CACHE_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._path = path
        self.merger = Merger(spec)
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if normal != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in splits] != ["Split", "ByteLevel"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError("this kind of tokenizer file isn't supported")
        special = {t["content"]: t["id"] for t in spec["added_tokens"] if not t["normalized"]}
        if len(special) < len(spec["added_tokens"]):
            raise ValueError("normalised added tokens aren't supported")
        self._special = special
        self._cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self._rare = re.compile("[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u012f\\u0132-\\u017f]")
        letters = "a-zªµºß-öø-ÿĀ-ſ"
        self._words = re.compile(f"[{letters}]+|[0-9²³¹¼½¾]|'(?:s|t|re|ve|m|ll|d)|[^\\s{letters}0-9²³¹¼½¾]+").findall
        self._bytes = {b: c for c, b in _byte_of().items()}
        #: ids of words, and of chunks between white space
        self._word_ids: dict[str, bytes] = {}
        self._ids: dict[str, bytes] = {}
        #: what each id is decoded to
        named = {v: k for k, v in special.items()}
        tokens = self.merger.tokens
        ids = [*range(len(tokens))] if isinstance(tokens, list) else list(tokens)
        self._said = np.full(max([*ids, *named]) + 1, "", object)
        for i in ids:
            self._said[i] = tokens[i]
        for i, token in named.items():
            self._said[i] = token
        self._most, self._held = dict(zip(("chunks", "words"), cache_bytes)), {"chunks": 0, "words": 0}

    @cached_property
    def _library(self):  # noqa: ANN202
        """Loaded where a text of other characters comes: most workers never need it."""
        from tokenizers import Tokenizer as Library

        return Library.from_file(self._path)

    def _rare_words(self, text: str) -> list[str]:
        """Words of a text of any characters, by the library's own parts."""
        normal = self._library.normalizer.normalize_str(text)
        back = _byte_of()
        return [bytes(back[c] for c in w).decode() for w, _ in self._library.pre_tokenizer.pre_tokenize_str(normal)]

    def _know(self, words: set[str]) -> None:
        new = list(words.difference(self._word_ids))
        if not new:
            return
        turn = self._bytes.__getitem__
        for w, ids in zip(new, self.merger.encode([w if w.isascii() and w.isalnum() else "".join(map(turn, w.encode())) for w in new])):
            self._word_ids[w] = struct.pack(f"<{len(ids)}I", *ids)
            self._held["words"] += self._cost(w, self._word_ids[w])

    def _learn(self, chunks: set[str]) -> None:
        split = {c: self._words(c) for c in chunks}
        self._know(set().union(*split.values()))
        ids = self._word_ids.__getitem__
        for c, words in split.items():
            self._ids[c] = b"".join(map(ids, words))
            self._held["chunks"] += self._cost(c, self._ids[c])

    @staticmethod
    def _cost(key: str, ids: bytes) -> int:
        """About the bytes of an entry: two objects in a table."""
        return 190 + 2 * len(key) + len(ids)

    def _trim(self, kind: str, ids: dict[str, bytes]) -> None:
        """Over the bound, entries that came late go until half of it is left:
        frequent words are met early."""
        if self._held[kind] <= self._most[kind]:
            return
        kept = 0
        for key in list(ids):
            cost = self._cost(key, ids[key])
            if kept + cost > self._most[kind] // 2:
                del ids[key]
            else:
                kept += cost
        self._held[kind] = kept

    def _decoded(self, ids: bytes) -> str:
        return " ".join(self._said[np.frombuffer(ids, "<u4")].tolist())

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """For each text (none: empty) its ids as unsigned 32-bit integers, and
        the decoded text; unknown words of all the texts are learnt at once."""
        self._trim("chunks", self._ids)
        self._trim("words", self._word_ids)
        # plain texts as chunks; others as a list of words and special ids
        plain: list[list[str] | None] = []
        other: dict[int, list[str | int]] = {}
        unknown: set[str] = set()
        words: set[str] = set()
        for n, text in enumerate(texts):
            if not text or not (self._rare.search(text) or (self._cut and self._cut.search(text))):
                chunks = text.lower().split() if text else []
                unknown.update(chunks)
                plain.append(chunks)
                continue
            split: list[str | int] = []
            for piece in self._cut.split(text) if self._cut else [text]:
                split += [self._special[piece]] if piece in self._special else self._rare_words(piece)
            words.update(w for w in split if isinstance(w, str))
            plain.append(None)
            other[n] = split
        self._know(words)
        self._learn(unknown.difference(self._ids))
        ids_of = self._ids.__getitem__
        for n, chunks in enumerate(plain):
            if chunks is not None:
                ids = b"".join(map(ids_of, chunks))
            else:
                ids = b"".join(self._word_ids[w] if isinstance(w, str) else struct.pack("<I", w) for w in other[n])
            yield ids, self._decoded(ids)


_kept: dict[str, Tokenizer] = resident()


def _tokenizer(path: str) -> Tokenizer:
    """One for a Python worker, which serves many tasks."""
    if path not in _kept:
        _kept[path] = Tokenizer(path)
    return _kept[path]


def encode(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", contents: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``contents``, ids
    and decoded. A null text counts as an empty one."""

    def run(batches):
        tok = _tokenizer(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                n, h, d, ids_out, text_out = [], [], [], [], []
                for ids, decoded in tok.encode(b.column(1).to_pylist()):
                    n.append(len(ids) // 4)
                    h.append(hashlib.sha256(ids).hexdigest())
                    d.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if contents:
                        ids_out.append(np.frombuffer(ids, "<u4").astype(np.int32))
                        text_out.append(decoded)
                columns = [b.column(0), pa.array(n, pa.int64()), pa.array(h), pa.array(d)]
                if contents:
                    columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(text_out)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * contents
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


def decode(ids: Iterable[int], path: str) -> str:
    """The library's decode(ids, skip_special_tokens=False) for such a file."""
    tok = _tokenizer(path)
    special = {v: k for k, v in tok._special.items()}
    return " ".join(special.get(i) or tok.merger.tokens[i] for i in ids)
