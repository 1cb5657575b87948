"""SentencePiece encoding and decoding in batched numpy.

A text's segments (white space and what follows it) are independent, as no piece reaches
over their ends; the model file is checked for that.  Distinct segments are grouped by
length, and the segments of one length advance together in one Viterbi pass: prefix hashes
over characters give the hash of any substring, which probes the sorted hashes of the
pieces; at each position the vectorised maximum over the pieces that end there is stored
with its backpointer.

* Unigram models: a path's score is the sum of its pieces' scores.
* BPE models: scores are merge ranks, and their sums do not define the encoding.  But the
  encoding of a text is the one sequence of pieces of which each two neighbours are the
  encoding of their own concatenation.  So a piece scores nothing if it can follow the best
  path's last piece and minus infinity if not, and the maximum is the library's encoding.
  Whether two pieces can stand side by side follows from how each came about: going back
  through the merges at the border, no pair there may be a piece that would have merged
  earlier than what did.  Answers are kept for each pair of pieces.

Characters without a piece become byte pieces where the model has them, else the unknown
id.  A bounded memo holds segments already encoded; segments of more than LONG characters
(nothing but letters, or but marks) are encoded one by one.

Defined results: null text is empty; empty text has no ids; white space other than the
space is an ordinary character; a text that holds U+2581 does not come back from
decoding, as the model writes spaces with it; very long texts are encoded whole; rows may
repeat and each is returned; null doc_ids are returned; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tuned

UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
SPACE = "▁"
#: Segments and pairs of pieces whose answers a worker keeps.
MEMO, PAIRS = 1_000_000, 1 << 20
MARKS = r"!-/:-@\[-`{-~"
MARK, LETTER = re.compile(f"[{MARKS}]"), re.compile(f"[^{MARKS}{SPACE}]")
LONG = 48
#: Texts whose new segments advance together.
TOGETHER = 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        elif tag & 7 == 5:
            yield tag >> 3, struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        else:
            yield tag >> 3, data[at : at + 8]
            at += 8


def _powers(n: int, step: np.uint64) -> np.ndarray:
    p = np.full(n, step, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Model:
    def __init__(self, data: bytes):
        pieces, trainer, normal = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                x = dict(fields(value))
                pieces.append((x[1].decode(), x.get(2, 0.0), x.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        if normal.get(2):
            raise NotImplementedError("a model with a character map; only identity normalisation is supported")
        self.setup(pieces, trainer.get(3, UNIGRAM), bool(normal.get(3, 1)), bool(normal.get(4, 1)))

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], kind: int, prefix: bool = True, squeeze: bool = False) -> "Model":
        model = cls.__new__(cls)
        model.setup(pieces, kind, prefix, squeeze)
        return model

    def setup(self, pieces, kind: int, prefix: bool, squeeze: bool) -> None:
        self.pieces, self.kind, self.prefix, self.squeeze = pieces, kind, prefix, squeeze
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == BYTE}
        self.ids = {p[0]: i for i, p in enumerate(pieces) if p[2] in (NORMAL, USER)}
        self.score = np.array([p[1] for p in pieces], float)
        self.longest = max(map(len, self.ids), default=1)
        n = max(LONG, self.longest) + 2
        self.up, self.down = _powers(n, _BASE), _powers(n, _INVERSE)
        keys = np.array([self._key(p) for p in self.ids], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(self.ids.values()), np.int64)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.least = min((p[1] for p in pieces if p[2] == NORMAL), default=0.0)
        self.independent = not any(SPACE in p.lstrip(SPACE) or "\n" in p[1:] or p[0] == "\n" and len(p) > 1 for p in self.ids)
        # where no piece has both letters and marks, a word ends where its letters do; a character
        # that shares a piece with marks counts as a mark
        mixed = [p for p in self.ids if LETTER.search(p) and MARK.search(p)]
        marks = MARKS + re.escape("".join({c for p in mixed for c in LETTER.findall(p)}))
        letter, mark = re.compile(f"[^{marks}{SPACE}]"), re.compile(f"[{marks}]")
        apart = self.independent and not any(letter.search(p) and mark.search(p) for p in self.ids)
        inside = f"{SPACE}*[{marks}]+|{SPACE}*[^{SPACE}\n{marks}]+" if apart else f"{SPACE}*[^{SPACE}\n]+"
        self.find = re.compile(f"\n|{inside}|{SPACE}+").findall
        self.memo: dict[str, bytes] = {}
        self.known, self.answers = np.full(PAIRS, -1), np.zeros(PAIRS, bool)
        if kind == BPE:
            self._history()
        self.text = [bytes([int(p[0][3:5], 16)]) if p[2] == BYTE else b"" if p[2] == CONTROL else " ⁇ ".encode() if p[2] == UNKNOWN else p[0].replace(SPACE, " ").encode() for p in pieces]

    def _key(self, piece: str) -> int:
        h = 0
        for i, c in enumerate(piece):
            h = (h + (ord(c) + 1) * 0xD6E8FEB86659FD93 * int(self.up[i])) & 0xFFFFFFFFFFFFFFFF
        return h

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each substring hash, -1 where there is none."""
        if not len(self.keys):
            return np.full(h.shape, -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.key_ids[at], -1)

    def _prefixes(self, words: list[str]) -> np.ndarray:
        n = len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)
        h = np.zeros((len(words), n + 1), np.uint64)
        np.cumsum((chars + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * self.up[:n], 1, out=h[:, 1:])
        return h

    def merge(self, words: list[str], cut: dict[int, int]) -> list[bytes]:
        """Ids of words of one length by merging, which tells how pieces come about; ``cut`` gets where the
        last two symbols of a word meet, if it came down to two."""
        n = len(words[0])
        h = self._prefixes(words)
        done: list = [None] * len(words)
        row = np.arange(len(words))
        bounds = np.tile(np.arange(n + 1), (len(words), 1))

        def rank(rows, lo, hi):
            found = self.probe((h[rows, hi] - h[rows, lo]) * self.down[lo])
            return np.where(found >= 0, self.score[found], -np.inf)

        pair = rank(np.repeat(row, n - 1), np.tile(np.arange(n - 1), len(words)), np.tile(np.arange(2, n + 1), len(words))).reshape(len(words), n - 1) if n > 1 else np.zeros((len(words), 0))
        while len(row):
            best = pair.argmax(1) if pair.shape[1] else np.zeros(len(row), np.int64)
            live = pair[np.arange(len(row)), best] > -np.inf if pair.shape[1] else np.zeros(len(row), bool)
            if not live.all():
                ended, at = row[~live], bounds[~live]
                lo, hi = at[:, :-1], at[:, 1:]
                found = self.probe((h[ended[:, None], hi] - h[ended[:, None], lo]) * self.down[lo])
                raw, size = found.astype("<u4").tobytes(), 4 * found.shape[1]
                whole = found.min(1) >= 0
                for i, (r, sound) in enumerate(zip(ended.tolist(), whole.tolist(), strict=True)):
                    if sound:
                        done[r] = raw[i * size : (i + 1) * size]
                    else:
                        done[r] = self.ids_of(words[r], list(zip(lo[i].tolist(), hi[i].tolist(), found[i].tolist(), strict=True)))
            row, bounds, pair, best = row[live], bounds[live], pair[live], best[live]
            if not len(row):
                break
            k = bounds.shape[1]
            if k == 3:
                cut.update(zip(row.tolist(), bounds[:, 1].tolist(), strict=True))
            keep = np.arange(k)[None, :] != best[:, None] + 1
            bounds = bounds[keep].reshape(len(row), k - 1)
            keep = np.arange(k - 2)[None, :] != best[:, None]
            pair = pair[keep].reshape(len(row), k - 3)
            # the pairs on either side of the merged symbol, which is now symbol ``best``
            for at, there in ((best - 1, best > 0), (best, best < k - 3)):
                i = np.flatnonzero(there)
                if len(i):
                    a = at[i]
                    pair[i, a] = rank(row[i], bounds[i, a], bounds[i, a + 2])
        return done

    def _history(self) -> None:
        """Of each piece: its hash and length, its place in the order of merges (-1: one character), the two
        pieces it is merged from last, and whether it is the encoding of its own text."""
        n = len(self.pieces)
        self.rank, self.left, self.right = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        self.whole, self.size, self.hash = np.zeros(n, bool), np.ones(n, np.int64), np.zeros(n, np.uint64)
        by: dict[int, list[str]] = {}
        for piece in self.ids:
            by.setdefault(len(piece), []).append(piece)
        merged = [i for p, i in self.ids.items() if len(p) > 1]
        self.rank[sorted(merged, key=lambda i: -self.score[i])] = np.arange(len(merged))
        for size, pieces in by.items():
            at = np.array([self.ids[p] for p in pieces])
            h = self._prefixes(pieces)
            self.size[at], self.hash[at] = size, h[:, -1]
            if size == 1:
                self.whole[at] = True
                continue
            cut: dict[int, int] = {}
            alone = self.merge(pieces, cut) if size <= LONG else [b""] * len(pieces)
            self.whole[at] = [x == array("I", [i]).tobytes() for x, i in zip(alone, at.tolist(), strict=True)]
            rows = np.array([i for i in cut if self.whole[at[i]]], np.int64)
            if len(rows):
                mid = np.array([cut[i] for i in rows.tolist()])
                self.left[at[rows]] = self.probe(h[rows, mid])
                self.right[at[rows]] = self.probe((h[rows, -1] - h[rows, mid]) * self.down[mid])

    def can_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b can stand after piece a; a character without a piece (-1) can stand anywhere."""
        out = np.ones(len(a), bool)
        ask = np.flatnonzero((a >= 0) & (b >= 0))
        if not len(ask):
            return out
        a, b = a[ask], b[ask]
        key = a * len(self.pieces) + b
        slot = (key * 0x9E3779B1) & (PAIRS - 1)
        answers = self.answers[slot]
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            keys, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            asked = new[first]
            found = self._apart(a[asked], b[asked])
            answers[new] = found[back]
            # of new pairs that share a slot one stays
            at, one = np.unique(slot[asked], return_index=True)
            self.known[at], self.answers[at] = keys[one], found[one]
        out[ask] = answers
        return out

    def _apart(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether pieces u and v, side by side, are never merged over their border."""
        never = len(self.pieces)
        out = np.ones(len(u), bool)
        row, u, v = np.arange(len(u)), u.copy(), v.copy()
        u_goes, v_goes = np.full(len(u), never), np.full(len(u), never)  # when each is merged into the next
        while len(row):
            both = self.size[u] + self.size[v] <= self.longest
            found = np.full(len(u), -1)
            found[both] = self.probe(self.hash[u[both]] + self.hash[v[both]] * self.up[self.size[u[both]]])
            when = np.where(found >= 0, self.rank[found], never)
            # of equal merges the left one comes first
            clash = (when < u_goes) & (when <= v_goes) & (found >= 0)
            out[row[clash]] = False
            later = self.rank[v] >= self.rank[u]  # the one merged last is taken apart
            more = ~clash & (np.where(later, self.rank[v], self.rank[u]) >= 0)
            row, u, v, u_goes, v_goes, later = (x[more] for x in (row, u, v, u_goes, v_goes, later))
            u_goes, v_goes = np.where(later, u_goes, self.rank[u]), np.where(later, self.rank[v], v_goes)
            u, v = np.where(later, u, self.right[u]), np.where(later, self.left[v], v)
        return out

    def neighbours(self, words: list[str]) -> list[bytes]:
        """BPE ids for words of one length: the path of pieces of which each can follow the one before."""
        n, rows = len(words[0]), len(words)
        h = self._prefixes(words)
        row = np.arange(rows)
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((rows, n + 1), np.int64), np.full((rows, n + 1), -1)
        for end in range(1, n + 1):
            lo = np.arange(max(0, end - self.longest), end)
            found = self.probe((h[:, end : end + 1] - h[:, lo]) * self.down[lo])
            fits = (found >= 0) & self.whole[found]
            fits[:, -1] |= found[:, -1] < 0  # a character without a piece stands alone
            x, y = np.nonzero(fits)
            fits[x, y] = (lo[y] == 0) | self.can_follow(piece[x, lo[y]], found[x, y])
            score = np.where(fits, best[:, lo], -np.inf)
            at = score.argmax(1)
            best[:, end] = score[row, at]
            back[:, end], piece[:, end] = lo[at], found[row, at]
        out: list = [None] * rows
        # the paths, from their ends, all at once: rows that are done drop out
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        end = np.full(rows, n)
        while len(row):
            steps.append((row, back[row, end], end, piece[row, end]))
            end = back[row, end]
            row, end = row[end > 0], end[end > 0]
        where, lo, hi, ids = (np.concatenate(x[::-1]) for x in zip(*steps, strict=True))
        order = np.lexsort((lo, where))
        where, lo, hi, ids = where[order], lo[order], hi[order], ids[order]
        cut = np.searchsorted(where, np.arange(rows + 1))
        raw, sound = ids.astype("<u4").tobytes(), np.logical_and.reduceat(ids >= 0, cut[:-1])
        for i, (a, b, ok) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), sound.tolist(), strict=True)):
            out[i] = raw[4 * a : 4 * b] if ok else self.ids_of(words[i], list(zip(lo[a:b].tolist(), hi[a:b].tolist(), ids[a:b].tolist(), strict=True)))
        return out

    def ids_of(self, word: str, path: list[tuple[int, int, int]]) -> bytes:
        """Ids of a word from the (start, end, piece id or -1) of its symbols."""
        ids: list[int] = []
        for lo, hi, found in path:
            if found >= 0:
                ids.append(found)
            elif self.bytes:
                ids += [self.bytes[b] for b in word[lo:hi].encode("utf-8", "surrogatepass")]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return array("I", ids).tobytes()

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Unigram ids for words of one length: the path with the greatest sum of scores."""
        n, rows = len(words[0]), len(words)
        h = self._prefixes(words)
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((rows, n + 1), np.int64)
        piece = np.full((rows, n + 1), -1)
        for end in range(1, n + 1):
            lo = np.arange(max(0, end - self.longest), end)
            found = self.probe((h[:, end : end + 1] - h[:, lo]) * self.down[lo])
            score = np.where(found >= 0, self.score[found], -np.inf)
            score[:, -1] = np.where(found[:, -1] >= 0, score[:, -1], self.least - 10.0)
            total = best[:, lo] + score
            at = total.argmax(1)
            best[:, end] = total[np.arange(rows), at]
            back[:, end], piece[:, end] = lo[at], found[np.arange(rows), at]
        out = []
        for i in range(rows):
            path, end = [], n
            while end:
                path.append((int(back[i, end]), end, int(piece[i, end])))
                end = int(back[i, end])
            out.append(self.ids_of(words[i], path[::-1]))
        return out

    def long_merge(self, word: str) -> bytes:
        """BPE of one long segment with a heap of pairs."""
        n = len(word)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        end = list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def push(i: int) -> None:
            j = right[i]
            if i >= 0 and j < n:
                found = self.ids.get(word[i : end[j]], -1) if end[j] - i <= self.longest else -1
                if found >= 0:
                    heapq.heappush(heap, (-self.score[found], i, end[i], end[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or right[i] >= n or end[right[i]] != stop:
                continue
            j = right[i]
            alive[j] = False
            end[i], right[i] = end[j], right[j]
            if right[i] < n:
                left[right[i]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return self.ids_of(word, [(i, end[i], self.ids.get(word[i : end[i]], -1)) for i in range(n) if alive[i]])

    def long_viterbi(self, word: str) -> bytes:
        best, back = [0.0], [(0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[end - 1] + self.least - 10.0, end - 1, -1)] if word[end - 1] not in self.ids else []
            for lo in range(max(0, end - self.longest), end):
                found = self.ids.get(word[lo:end], -1)
                if found >= 0:
                    options.append((best[lo] + self.score[found], lo, found))
            top = max(options, key=lambda x: (x[0], -x[1]))
            best.append(top[0])
            back.append((top[1], top[2]))
        path, end = [], len(word)
        while end:
            path.append((back[end][0], end, back[end][1]))
            end = back[end][0]
        return self.ids_of(word, path[::-1])

    def learn(self, segments: list[str]) -> None:
        if len(self.memo) + len(segments) > MEMO:
            self.memo.clear()
        by: dict[int, list[str]] = {}
        for s in segments:
            by.setdefault(len(s), []).append(s)
        together, alone = (self.neighbours, self.long_merge) if self.kind == BPE else (self.viterbi, self.long_viterbi)
        for n, group in by.items():
            self.memo.update(zip(group, together(group) if n <= LONG else map(alone, group), strict=True))

    def normalize(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return ((" " if self.prefix and text else "") + text).replace(" ", SPACE)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for i in range(0, len(texts), TOGETHER):
            split = [self.find(t) if self.independent else [t] * bool(t) for t in map(self.normalize, texts[i : i + TOGETHER])]
            every = set().union(*split)
            new = every.difference(self.memo)
            if len(self.memo) + len(new) > MEMO:
                new = every
            self.learn(list(new))
            out += [b"".join(map(self.memo.__getitem__, x)) for x in split]
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.text.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")
        return raw[1:] if self.prefix and raw.startswith(" ") else raw


_open: dict[int, Model] = {}


def load(data: bytes) -> Model:
    """The model of a file's bytes; a worker reads it once."""
    key = hash(data)
    if key not in _open:
        _open[key] = Model(data)
    return _open[key]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ``ids`` (little-endian unsigned 32-bit integers) of each document."""
    return _run(docs, model, lambda m, texts, ids: [pa.array(ids, pa.binary())], "ids binary", ["ids"])


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and the text of each row's ``ids``; null ids give null."""
    with open(model, "rb") as f:
        data = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(data.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else m.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, and whether decoding the ids gives the text back."""

    def make(m: Model, texts: list[str], ids: list[bytes]) -> list[pa.Array]:
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            pa.array([m.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
        ]

    return _run(docs, model, make, "n_tokens long, ids_crc32 long, round_trip boolean", ["n_tokens", "ids_crc32", "round_trip"])


def _run(docs: DataFrame, model: str, make, schema: str, names: list[str]) -> DataFrame:
    tuned(docs.sparkSession)
    with open(model, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(data.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), *make(m, texts, m.encode(texts))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id long, {schema}")
