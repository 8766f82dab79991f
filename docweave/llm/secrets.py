"""Secret scans: fixed patterns, and a small character convolutional network.

The patterns (assign, access, hex) always count. Beside them every other run of
16 or more key characters with a letter and a digit is a candidate, and so is
what a pattern's span leaves of a run; the network reads it whole, in windows of
48 characters with those around them, and adds the span (kind ``cnn``) if the
highest calibrated probability reaches the threshold.

The network is trained here, on labelled findings: ``findings(n, seed)`` makes
keys of many issuers' shapes and look-alikes (host names, paths, identifiers,
versions, dates, long words) in varied surroundings, ``buried(n, seed)`` puts
them behind long paths. Three disjoint draws of both train it, calibrate it (a
logistic map of its score) and give the threshold: the highest that still finds
``min_recall`` of the true ones of either kind. Training is
deterministic; its size is a parameter and doesn't depend on the table.

Null texts count as empty. Offsets are in code points. One row comes out for
every row: null and repeated ids and repeated rows stay as they are, other columns
are not read by ``find_secrets`` and pass through ``redact``. Very long texts and
runs are read whole; spans that start alike are told in the order of their kinds.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "cnn")
_ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_HINTS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_DIGIT = re.compile("[0-9]")
_LETTER = re.compile("[A-Za-z]")
_CUES = re.compile("|".join(_HINTS), re.ASCII | re.IGNORECASE)

LEFT, BODY, RIGHT = 24, 48, 8
#: from one window of a long candidate to the next
STEP = 8
_WIDTH = LEFT + BODY + RIGHT


class Span(NamedTuple):
    start: int
    kind: int
    end: int


# ---------------------------------------------------------------- labelled findings

_HEXDIGITS, _UPPER, _LOWER, _DIGITS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_B64 = _UPPER + _LOWER + _DIGITS + "+/"
_ALNUM = _UPPER + _LOWER + _DIGITS
_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ción que ment aux der ung ich".split()


def _makers(rng: np.random.Generator):
    """Makers of words, numbers and prose, of keys and of look-alikes."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    word = lambda: "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 5))))
    number = lambda k: some(_DIGITS, k)
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(2, 8))))
    secrets = (
        lambda: some(_B64, 40),
        lambda: pick(("ghp_", "gho_", "pat-", "sk-", "rk_live_", "glpat-", "npm_")) + some(_ALNUM, int(rng.integers(20, 41))),
        lambda: f"xox{pick('bpa')}-{number(11)}-{some(_ALNUM, 24)}",
        lambda: some(_ALNUM, int(rng.integers(20, 65))),
        lambda: some(_B64, int(rng.integers(4, 16)) * 4 - 1) + "=",
        lambda: f"eyJ{some(_ALNUM, 20)}.{some(_ALNUM, 30)}.{some(_ALNUM + '-_', 40)}",
        lambda: "AIza" + some(_ALNUM + "-_", 35),
        lambda: some(_HEXDIGITS.upper(), int(rng.choice((32, 40, 64)))),
        lambda: some(_LOWER + _DIGITS, int(rng.integers(24, 41))),
    )
    harmless = (
        lambda: ".".join(word() for _ in range(3)) + f"{number(1)}.example.com",
        lambda: "mail" + number(1) + ".example.com",
        lambda: "/".join(word() for _ in range(4)) + "/" + word() + number(2) + ".txt",
        lambda: "-".join(word() for _ in range(3)) + "-20" + number(2),
        lambda: "_".join(word() for _ in range(4)) + number(1),
        lambda: f"{some(_HEXDIGITS, 8)}-{some(_HEXDIGITS, 4)}-{some(_HEXDIGITS, 4)}-{some(_HEXDIGITS, 4)}-{some(_HEXDIGITS, 12)}",
        lambda: f"{word()}-{number(1)}.{number(2)}.{number(1)}-{word()}-{word()}",
        lambda: f"20{number(2)}-0{number(1)}-1{number(1)}T0{number(1)}.{number(2)}.{number(2)}Z",
        lambda: "".join(word() for _ in range(5)) + number(int(rng.integers(1, 4))),
        lambda: (word() + word()).upper() + "-" + number(6) + "-" + word().upper() + word().upper(),
        lambda: "ISBN-" + f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}",
        lambda: "".join(word().title() for _ in range(4)) + number(2),
    )
    return pick, some, word, number, prose, secrets, harmless


def findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, 1 if the span is a secret, else 0)"""
    rng = np.random.default_rng(seed)
    pick, _, _, _, prose, secrets, harmless = _makers(rng)
    cues = ("key: ", "key=", "auth ", "Authorization: Bearer ", "credential '", "pwd ", "export KEY=", "AWS ", "access ", "", "", "")
    plain = ("see ", "at ", "file ", "host ", "version ", "id ", "", "", "", "on ", "the ")
    out = []
    while len(out) < n:
        true = int(rng.integers(2))
        body = pick(secrets if true else harmless)()
        if not (_RUN.fullmatch(body) and _DIGIT.search(body) and _LETTER.search(body)):
            continue
        before = prose() + pick((" ", "\n", ": ", ' "', " | ")) + pick(cues if true or rng.random() < 0.2 else plain)
        out.append((before + body + pick((" ", '"', "\n", ", ", "; ")) + prose(), len(before), len(before) + len(body), true))
    return out


def buried(n: int, seed: int) -> list[tuple[str, int, int, int, int, int]]:
    """(text, start, end, 1 if a secret is in the run, else 0, start and end of
    the secret or look-alike): runs that begin with a path or host."""
    rng = np.random.default_rng([seed, 1])
    pick, some, word, number, prose, secrets, harmless = _makers(rng)
    parts = (
        word,
        word,
        lambda: word() + number(int(rng.integers(1, 4))),
        lambda: pick("TBCUG") + some(_UPPER + _DIGITS, int(rng.integers(8, 11))),
        lambda: pick("TBCUG") + "0" * 8,
        lambda: "-".join(word() for _ in range(int(rng.integers(2, 6)))),
        lambda: "_".join(word() for _ in range(int(rng.integers(2, 5)))),
        lambda: f"20{number(2)}/0{number(1)}/1{number(1)}",
        lambda: number(int(rng.integers(2, 10))),
        lambda: f"v{number(1)}.{number(1)}",
        lambda: word().title() + word().title(),
    )
    hosts = (lambda: f"//{word()}.{word()}.com", lambda: f"//{word()}{number(1)}.example.org", lambda: "/" + word(), lambda: word() + "/" + word(), lambda: f"www.{word()}.net")
    out = []
    while len(out) < n:
        true, least = int(rng.integers(2)), int(rng.integers(16, 100))
        ahead = pick(hosts)()
        while len(ahead) < least:
            ahead += "/" + pick(parts)()
        leaf = pick(secrets if true else harmless + parts)()
        tail = pick(("", "", "", "/" + word(), "." + word(), "/" + word() + "/" + word() + number(2)))
        ahead += pick(("/", "/", "/", "=", "/" + word() + "="))
        run, before = ahead + leaf + tail, prose() + pick((" ", "\n", ": ", ' "', " https:"))
        if not (_RUN.fullmatch(run) and _DIGIT.search(run) and _LETTER.search(run)):
            continue
        s = len(before)
        out.append((before + run + pick((" ", '"', "\n", ", ", "; ")) + prose(), s, s + len(run), true, s + len(ahead), s + len(ahead) + len(leaf)))
    return out


# ---------------------------------------------------------------- the network


def _windows(s: int, e: int) -> list[tuple[int, int]]:
    """The windows over a candidate; the last ends with it."""
    if e - s <= BODY:
        return [(s, e)]
    return [(at, at + BODY) for at in [*range(s, e - BODY, STEP), e - BODY]]


def _codes(cases: list[tuple[str, int, int]]) -> np.ndarray:
    """Character codes of each candidate's window: 1-95 for printable ASCII, 96
    for others, 0 for nothing; 97 more inside the candidate."""
    out = np.zeros((len(cases), _WIDTH), np.int64)
    for row, (text, s, e) in zip(out, cases):
        left, body, right = text[max(0, s - LEFT) : s], text[s : min(e, s + BODY)], text[e : e + RIGHT]
        line = np.array([ord(c) for c in left + body + right], np.int64)
        line = np.where((line >= 32) & (line < 127), line - 31, 96)
        at = LEFT - len(left)
        row[at : at + len(line)] = line
        row[LEFT : LEFT + len(body)] += 97
    return out


class Network:
    """Embedding, one convolution with max pooling, one hidden layer."""

    def __init__(self, seed: int, *, embed: int = 8, filters: int = 24, width: int = 5, hidden: int = 16):
        rng = np.random.default_rng(seed)
        scaled = lambda *s: (rng.standard_normal(s) * np.sqrt(2 / s[0])).astype(np.float32)
        self.width = width
        self.p = {
            "E": (rng.standard_normal((194, embed)) * 0.5).astype(np.float32),
            "W": scaled(width * embed, filters),
            "b": np.zeros(filters, np.float32),
            "U": scaled(filters, hidden),
            "c": np.zeros(hidden, np.float32),
            "v": scaled(hidden, 1),
            "d": np.zeros(1, np.float32),
        }
        self.slope, self.offset, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, codes: np.ndarray):
        p = self.p
        x = p["E"][codes]
        n, length, k = x.shape
        cols = np.lib.stride_tricks.sliding_window_view(x, self.width, axis=1).transpose(0, 1, 3, 2).reshape(n * (length - self.width + 1), -1)
        z = (cols @ p["W"] + p["b"]).reshape(n, length - self.width + 1, -1)
        at = z.argmax(axis=1)
        pooled = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0]
        a = np.maximum(pooled, 0)
        h = np.maximum(a @ p["U"] + p["c"], 0)
        return cols, at, pooled, a, h, (h @ p["v"] + p["d"])[:, 0]

    def score(self, codes: np.ndarray) -> np.ndarray:
        parts = [self._forward(codes[i : i + 1024])[-1] for i in range(0, len(codes), 1024)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def best(self, cases: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Of each candidate: the highest score of its windows, and that window's codes."""
        top, codes = np.full(len(cases), -np.inf), np.zeros((len(cases), _WIDTH), np.int64)

        def weigh(held: list[tuple[int, str, int, int]]) -> None:
            rows = _codes([h[1:] for h in held])
            for (i, *_), row, score in zip(held, rows, self.score(rows).tolist()):
                if score > top[i]:
                    top[i], codes[i] = score, row

        held: list[tuple[int, str, int, int]] = []
        for i, (text, s, e) in enumerate(cases):
            for window in _windows(s, e):
                held.append((i, text, *window))
                if len(held) == 4096:
                    weigh(held)
                    held = []
        weigh(held)
        return top, codes

    def sure(self, cases: list[tuple[str, int, int]]) -> np.ndarray:
        """Whether the highest probability of a candidate reaches the threshold."""
        return self.probability(self.best(cases)[1]) >= self.threshold

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.score(codes) + self.offset)))

    def fit(self, codes: np.ndarray, labels: np.ndarray, *, epochs: int = 6, batch: int = 64, rate: float = 3e-3, seed: int = 0) -> None:
        rng, p = np.random.default_rng(seed), self.p
        m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for i in range(0, len(order), batch):
                c, y = codes[order[i : i + batch]], labels[order[i : i + batch]]
                cols, at, pooled, a, h, out = self._forward(c)
                n, f, places = len(c), pooled.shape[1], c.shape[1] - self.width + 1
                g = ((1 / (1 + np.exp(-out)) - y) / n).astype(np.float32)[:, None]
                dh = (g @ p["v"].T) * (h > 0)
                da = (dh @ p["U"].T) * (pooled > 0)
                row = (np.arange(n)[:, None] * places + at).ravel()
                taken = cols[row].reshape(n, f, -1)
                back = (da[:, :, None] * p["W"].T[None]).reshape(n, f, self.width, -1)
                de = np.zeros_like(p["E"])
                where = c[np.arange(n)[:, None, None], at[:, :, None] + np.arange(self.width)]
                np.add.at(de, where.ravel(), back.reshape(-1, de.shape[1]))
                grads = {"E": de, "W": np.einsum("nf,nfk->kf", da, taken), "b": da.sum(0), "U": a.T @ dh, "c": dh.sum(0), "v": h.T @ g, "d": g.sum(0)}
                step += 1
                for k, d in grads.items():
                    m[k] += 0.1 * (d - m[k])
                    s[k] += 0.001 * (d * d - s[k])
                    p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, codes: np.ndarray, labels: np.ndarray) -> None:
        """A logistic map of the score, by Newton's method."""
        x = np.column_stack([self.score(codes), np.ones(len(codes))]).astype(np.float64)
        w = np.array([1.0, 0.0])
        for _ in range(25):
            q = 1 / (1 + np.exp(-(x @ w)))
            hess = (x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
            w -= np.linalg.solve(hess, x.T @ (q - labels) + 1e-3 * (w - [1.0, 0.0]))
        self.slope, self.offset = w.tolist()

    def constrain(self, codes: np.ndarray, labels: np.ndarray, min_recall: float) -> None:
        """The highest threshold at which ``min_recall`` of the secrets is found."""
        found = np.sort(self.probability(codes)[labels == 1])
        self.threshold = float(found[int((1 - min_recall) * len(found))])


def _labelled_windows(cases: list[tuple[str, int, int, int, int, int]], seed: int) -> list[tuple[str, int, int, int]]:
    """Windows with the whole secret (or all of it that fits) and windows without
    any of it, one of each for a case; of the others two."""
    rng, out = np.random.default_rng(seed), []
    for text, s, e, true, a, b in cases:
        windows = _windows(s, e)
        within = [w for w in windows if min(w[1], b) - max(w[0], a) >= min(b - a, BODY - STEP)]
        outside = [w for w in windows if w[1] <= a or b <= w[0]]
        for label, some in ((1, within), (0, outside)) if true else ((0, windows), (0, windows)):
            if some:
                out.append((text, *some[int(rng.integers(len(some)))], label))
    return out


_trained: dict[tuple, Network] = {}


def trained(n: int = 3000, seed: int = 11, min_recall: float = 0.97) -> Network:
    """The network, trained once for a process."""
    key = (n, seed, min_recall)
    if key not in _trained:
        net = Network(seed)
        draws = [(findings(k, seed + d), buried(k, seed + d)) for d, k in enumerate((n, n // 3, n // 3))]
        plain, deep = draws[0]
        cases = [f[:4] for f in plain] + _labelled_windows(deep, seed)
        net.fit(_codes([c[:3] for c in cases]), np.array([c[3] for c in cases]))
        both = draws[1][0] + draws[1][1]
        net.calibrate(net.best([f[:3] for f in both])[1], np.array([f[3] for f in both]))
        limits = []
        for part in draws[2]:
            net.constrain(net.best([f[:3] for f in part])[1], np.array([f[3] for f in part]), min_recall)
            limits.append(net.threshold)
        net.threshold = min(limits)
        _trained[key] = net
    return _trained[key]


# ---------------------------------------------------------------- scanning


def _candidate(i: int, text: str, s: int, e: int) -> list[tuple[int, str, int, int]]:
    part = text[s:e]
    return [(i, text, s, e)] if len(part) >= 16 and _DIGIT.search(part) and _LETTER.search(part) else []


def scan(texts: list[str | None], net: Network) -> list[list[Span]]:
    """The spans of each text, by start, then kind, then end."""
    out: list[list[Span]] = []
    open_: list[tuple[int, str, int, int]] = []
    for i, text in enumerate(texts):
        spans: list[Span] = []
        out.append(spans)
        if not text:
            continue
        if _CUES.search(text):
            spans += [Span(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
        for run in _RUN.finditer(text):
            at, body = run.start(), run[0]
            if not _DIGIT.search(body) and "AKIA" not in body and len(body) < 32:
                continue
            own = [Span(at + m.start(), 1, at + m.end()) for m in _ACCESS.finditer(body) if m.end() - m.start() >= 16]
            if len(body) >= 32:
                own += [Span(at + m.start(), 2, at + m.end()) for m in _HEX.finditer(body) if m.end() - m.start() >= 32]
            spans += own
            # what the patterns leave of the run
            for s in sorted(x for x in spans if x.start < run.end() and run.start() < x.end):
                open_ += _candidate(i, text, at, s.start)
                at = max(at, s.end)
            open_ += _candidate(i, text, at, run.end())
    if open_:
        sure = net.sure([c[1:] for c in open_])
        for (i, _, s, e), yes in zip(open_, sure.tolist()):
            if yes:
                out[i].append(Span(s, 3, e))
    return [sorted(s) for s in out]


def _said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", net: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_cnn, base_sha256, spans."""
    held = docs.sparkSession.sparkContext.broadcast(net or trained())

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                found = scan(b.column(1).to_pylist(), held.value)
                counts = [pa.array([sum(s.kind == k for s in spans) for spans in found], pa.int64()) for k in range(4)]
                base = [hashlib.sha256(_said([s for s in spans if s.kind < 3]).encode()).hexdigest() for spans in found]
                yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(base), pa.array([_said(s) for s in found])], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_cnn", "base_sha256", "spans"]
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_cnn long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, *, text_col: str = "text", mask: str = "[SECRET]", net: Network | None = None) -> DataFrame:
    """The rows of ``docs`` with every found span replaced by ``mask``; spans
    that overlap are replaced together. Other texts stay as they are."""
    held = docs.sparkSession.sparkContext.broadcast(net or trained())
    place = docs.columns.index(text_col)

    def masked(text: str, spans: list[Span]) -> str:
        out, last = [], 0
        for s in spans:
            if s.start >= last:
                out += [text[last : s.start], mask]
            last = max(last, s.end)
        return "".join([*out, text[last:]])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = b.column(place).to_pylist()
                found = scan(texts, held.value)
                if any(found):
                    kind = b.schema.field(place)
                    b = b.set_column(place, kind, pa.array([masked(t, s) if s else t for t, s in zip(texts, found)], kind.type))
                yield b

    return docs.mapInArrow(run, docs.schema)
