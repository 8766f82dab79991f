"""Token ids in files of directly addressable codes.

A file holds segments of about a million ids. A segment splits each id into
chunks of 8 bits: level 0 has the lowest chunk of every id and a bitmap that
says which ids go on; level 1 has the next chunk of those only, and so on. A
rank directory (ones before every 512 bits) turns "the i-th id goes on" into a
position in the next level, so any id is read from a few bytes, without
decoding its neighbours. All integers are little-endian.

    file     = MAGIC segment* footer footer_at:u64 MAGIC
    segment  = n_docs:u64 n_ids:u64 n_levels:u64 ids_of_docs:i64[] starts:u64[n_docs + 1] null:u8[] level*
    level    = n:u64 chunks:u8[n] bits:u8[ceil(n / 8)] ranks:u32[ceil(n / 512)]
    footer   = n_segments:u64 (offset:u64 first_id:u64 n_ids:u64)*

One document is written for every row: a null or empty text has only the end id;
null ids (told apart from 0), repeated ids and repeated rows are kept; other
columns are not read. A very long text makes one longer segment. An empty table
gives no file.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import cut, new_path

MAGIC = b"DWDAC001"
SEGMENT_IDS = 1 << 20
_BITS = 8
_RANK = 512
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Encoder:
    """Ids of texts, equal to those of the tokenizers library for its file.

    The library takes about 1,000 CPU seconds for a GB of text. So where the
    file is a plain byte-level BPE whose merges are in the order of their ids
    (checked here), texts of common characters are merged by tiktoken over the
    same table, a few times faster with the same ids; texts with other
    characters, or in which a special token stands, go to the library itself,
    and with another kind of file all do.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._special = [t["content"] for t in spec["added_tokens"]]
        self._rare = re.compile("[^\n\x20-\x7e\u00a1-\u024f]")
        self._fast = _rank_table(spec)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """For each text its ids as unsigned 32-bit integers; none for a null."""
        for text in texts:
            if not text:
                yield b""
            elif self._fast and not self._rare.search(text) and not any(s in text for s in self._special):
                yield self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            else:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable ones for themselves, the rest counted on from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _rank_table(spec: dict):
    """A tiktoken encoding with the merges of a byte-level BPE file, or None
    if the file has anything that it could not follow."""
    import tiktoken
    from public_tokenizers import PATTERN

    model, pre = spec["model"], spec["pre_tokenizer"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    bytelevel = pre and pre["type"] == "ByteLevel" and pre.get("use_regex") and not pre["add_prefix_space"]
    if not (plain and bytelevel and spec["normalizer"] is None and spec["post_processor"] is None):
        return None
    vocab, byte = model["vocab"], _byte_of()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab[a + b] for a, b in pairs]
    special = {t["content"] for t in spec["added_tokens"]}
    made = {a + b for a, b in pairs}
    if ids != sorted(ids) or len(made) != len(ids) or any(len(t) > 1 and t not in made for t in vocab if t not in special):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack(ids: np.ndarray) -> bytes:
    """The levels of the ids."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> _BITS
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        ones = _POPCOUNT[bits]
        per = np.add.reduceat(ones.astype(np.uint32), np.arange(0, len(ones), _RANK // 8)) if len(ones) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per)])[: len(per)].astype("<u4")
        out += [struct.pack("<Q", len(rest)), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        rest = more[goes_on]
        if not len(rest):
            return struct.pack("<Q", len(out) // 4) + b"".join(out)


class Levels:
    """Reads what :func:`pack` made, from ``data`` at ``at``."""

    def __init__(self, data, at: int = 0):
        self.parts = []
        (n_levels,) = struct.unpack_from("<Q", data, at)
        at += 8
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            sizes = (n, -(-n // 8), 4 * -(-n // _RANK))
            chunks, bits, ranks = (np.frombuffer(data, np.uint8, s, at + sum(sizes[:i])) for i, s in enumerate(sizes))
            self.parts.append((chunks, bits, ranks))
            at += sum(sizes)
        self.end = at

    def __len__(self) -> int:
        return len(self.parts[0][0])

    def __getitem__(self, i: int) -> int:
        """Id i, from a byte or two of each level and at most 64 bytes of each bitmap."""
        out = 0
        for level, (chunks, bits, ranks) in enumerate(self.parts):
            out |= int(chunks[i]) << (_BITS * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // _RANK
            before = int.from_bytes(ranks[4 * block : 4 * block + 4].tobytes(), "little")
            before += int(_POPCOUNT[bits[block * _RANK // 8 : i >> 3]].sum())
            i = before + bin(int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).count("1")
        return out

    def all(self) -> np.ndarray:
        below = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.parts):
            here = chunks.astype(np.uint32)
            here[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= below << np.uint32(_BITS)
            below = here
        return below


class Writer:
    """Appends documents in the order given; holds one segment at a time."""

    def __init__(self, out):
        self.out, self.segments, self.total = out, [], 0
        self._at = out.write(MAGIC)
        self._docs, self._ids, self._n = [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs.append(doc_id)
        self._ids.append(ids)
        self._n += len(ids) // 4
        if self._n >= SEGMENT_IDS:
            self._flush()

    def _flush(self) -> None:
        if not self._docs:
            return
        starts = np.cumsum([0, *(len(x) // 4 for x in self._ids)]).astype("<u8")
        levels = pack(np.frombuffer(b"".join(self._ids), "<u4"))
        data = b"".join(
            [
                struct.pack("<QQ", len(self._docs), self._n),
                np.array([d or 0 for d in self._docs], "<i8").tobytes(),
                starts.tobytes(),
                np.array([d is None for d in self._docs], np.uint8).tobytes(),
                levels,
            ]
        )
        self.segments.append((self._at, self.total, self._n))
        self._at += self.out.write(data)
        self.total += self._n
        self._docs, self._ids, self._n = [], [], 0

    def close(self) -> None:
        self._flush()
        footer = struct.pack("<Q", len(self.segments)) + b"".join(struct.pack("<QQQ", *s) for s in self.segments)
        self.out.write(footer + struct.pack("<Q", self._at) + MAGIC)


class Reader:
    """Random access to a file: reads the footer, then only what is asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a complete token file")
        (at,) = struct.unpack("<Q", tail[:8])
        footer = source.read_at(size - 16 - at, at)
        (n,) = struct.unpack_from("<Q", footer)
        self.segments = [struct.unpack_from("<QQQ", footer, 8 + 24 * i) for i in range(n)]
        self.ends = [s[0] for s in self.segments[1:]] + [at]
        self._firsts = [s[1] for s in self.segments]
        self._held: tuple[int, tuple] | None = None

    def _segment(self, k: int):
        if self._held is None or self._held[0] != k:
            at = self.segments[k][0]
            data = self.source.read_at(self.ends[k] - at, at)
            n_docs, _ = struct.unpack_from("<QQ", data)
            p = 16
            docs = np.frombuffer(data, "<i8", n_docs, p)
            starts = np.frombuffer(data, "<u8", n_docs + 1, p + 8 * n_docs)
            nulls = np.frombuffer(data, np.uint8, n_docs, p + 16 * n_docs + 8)
            self._held = (k, (docs, starts, nulls, Levels(data, p + 17 * n_docs + 8)))
        return self._held[1]

    def __len__(self) -> int:
        return sum(s[2] for s in self.segments)

    def token(self, i: int) -> int:
        """Id i of the file, from some headers and, for each level, its chunk, its
        byte of the bitmap, a rank and at most 64 bytes of bitmap beside."""
        k = bisect_right(self._firsts, i) - 1
        read, at = self.source.read_at, self.segments[k][0]
        (n_docs,) = struct.unpack("<Q", read(8, at))
        at += 17 * n_docs + 8 + 16
        (n_levels,) = struct.unpack("<Q", read(8, at))
        at, i, out = at + 8, i - self._firsts[k], 0
        for level in range(n_levels):
            (n,) = struct.unpack("<Q", read(8, at))
            chunks, bits = at + 8, at + 8 + n
            ranks = bits + -(-n // 8)
            out |= read(1, chunks + i)[0] << (_BITS * level)
            block = i // _RANK
            begin = block * _RANK // 8
            near = np.frombuffer(read((i >> 3) - begin + 1, bits + begin), np.uint8)
            if not near[-1] >> (i & 7) & 1:
                break
            (before,) = struct.unpack("<I", read(4, ranks + 4 * block))
            i = before + int(_POPCOUNT[near[:-1]].sum()) + bin(int(near[-1]) & ((1 << (i & 7)) - 1)).count("1")
            at = ranks + 4 * -(-n // _RANK)
        return out

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids)"""
        for k, (_, first, _n) in enumerate(self.segments):
            docs, starts, nulls, levels = self._segment(k)
            ids = levels.all()
            for d, s, e, null in zip(docs.tolist(), starts.tolist(), starts[1:].tolist(), nulls.tolist()):
                yield None if null else d, first + s, ids[s:e]


@contextlib.contextmanager
def open_file(path: str):
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        yield Reader(f)


def write(docs: DataFrame, folder: str, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Encode every text, append ``end_id`` to each, and write files in
    ascending id order (nulls first; equal ids by a hash of the text, then as they
    come, so they need not lie in one file). Returns, per file in
    order, (path, ids of all files before it, ids): one short row for a file.

    A task writes under a name of its own attempt and renames it when whole;
    only files of attempts that Spark accepted are listed, others are removed.
    """

    def run(batches):
        encoder = Encoder(tokenizer)
        ctx = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"tokens-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.dac"
        end = np.array([end_id], "<u4").tobytes()
        n_docs = 0
        with fs.open_output_stream(f"{base}/_{name}") as out:
            writer = Writer(out)
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                        writer.add(doc_id, ids + end)
                        n_docs += 1
            writer.close()
        if n_docs:
            fs.move(f"{base}/_{name}", f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([ctx.partitionId()], pa.int32()), pa.array([name]), pa.array([writer.total], pa.int64())], ["part", "name", "n_ids"])
        else:
            fs.delete_file(f"{base}/_{name}")

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", "hash", "place"]
    keyed = texts.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = cut(ordered.mapInArrow(run, "part int, name string, n_ids long"), "manifest").orderBy("part").collect()
    fs, base = pafs.FileSystem.from_uri(folder)
    named = {r["name"] for r in made}
    with contextlib.suppress(FileNotFoundError):
        for f in fs.get_file_info(pafs.FileSelector(base)):
            if f.base_name not in named:
                fs.delete_file(f.path)
    before = np.cumsum([0, *(r["n_ids"] for r in made)]).tolist()
    return [(f"{folder}/{r['name']}", b, r["n_ids"]) for r, b in zip(made, before)]


def read_digests(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches):
        for b in batches:
            for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open_file(path) as reader:
                    rows = []
                    for d, s, ids in reader.documents():
                        rows.append((d, before + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(files, "path string, before long, n_ids long")
    return listed.repartition(max(1, len(files))).mapInArrow(run, schema)


def token_output(docs: DataFrame, *, tokenizer: str, end_id: int, **columns) -> DataFrame:
    """Write the ids of ``docs`` to new files and return what they hold."""
    spark = docs.sparkSession
    return read_digests(spark, write(docs, new_path(spark, "tokens"), tokenizer=tokenizer, end_id=end_id, **columns))
