"""Token ids of whole batches through a vectorised memo of runs.

For tokenizers that lower-case, drop white space and split letters, digits and marks: in
the bytes of a batch, runs of one class are cut with numpy, hashed, and looked up in a
memo of arrays (sorted hashes, with a direct-mapped table before them).  New runs are
encoded by the tokenizers library, once for each worker; a word with any character whose
class is not plain goes to the library whole, and so does a text that holds an added
token's content, which the library maps to the token's id.  The memo starts anew when it
is full.

A run is known by a 64-bit hash and its length; two runs of one length would have to
collide for a wrong id.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .hashing import _LOWER, SPACE, buffers, mix, powers, prefix_hash, slices
from .packing import alphabet

GAP, LETTER, DIGIT, MARK, OTHER, WHOLE = range(6)
MOST = 2_000_000
TABLE = 1 << 21
CLASS = np.full(256, OTHER, np.uint8)
CLASS[SPACE] = GAP
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[48:58] = DIGIT
CLASS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = MARK
ALPHABET = alphabet()
_open: dict[int, "RunMemo"] = {}


class RunMemo:
    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        # content of the added tokens, and whether it is looked for in the normalised text
        self.added = [(t.content, t.normalized) for t in self.library.get_added_tokens_decoder().values()]
        self.model, self.normal = self.library.model, self.library.normalizer
        self.clear()

    def clear(self) -> None:
        # entries are appended; ``keys`` in order, with the entry of each
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.slot_key, self.slot = np.zeros(TABLE, np.uint64), np.zeros(TABLE, np.int64)

    def runs(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and class of each run."""
        n = len(buf)
        kind = CLASS[buf]
        lead = np.flatnonzero((buf >= 0xC3) & (buf <= 0xC9))
        lead = lead[lead + 1 < n]
        tail = buf[lead + 1]
        head = buf[lead]
        # letters from U+00C0 to U+024F, without the multiplication and division signs and the dotted capital I
        plain = ~((head == 0xC3) & ((tail == 0x97) | (tail == 0xB7)) | (head == 0xC4) & (tail == 0xB0) | (head == 0xC9) & (tail > 0x8F))
        kind[lead[plain]] = kind[lead[plain] + 1] = LETTER
        first = np.zeros(n, bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        gap = kind == GAP
        word = ~gap
        word[1:] &= gap[:-1] | first[1:]
        if (kind == OTHER).any():
            number = np.cumsum(word)
            bad = np.zeros(number[-1] + 1, bool)
            bad[number[kind == OTHER]] = True
            kind[bad[number] & ~gap] = WHOLE
        new = word | ~gap & (kind == DIGIT)
        new[1:] |= ~gap[1:] & (kind[1:] != kind[:-1])
        start = np.flatnonzero(new)
        # a run ends where the next begins, or at white space before that, or with its document
        stop = gap.copy()
        end = np.append(start[1:], n)
        edge = np.flatnonzero(stop)
        if len(edge):
            k = np.searchsorted(edge, start)
            nxt = np.append(edge, n)[k]
            end = np.minimum(end, nxt)
        return start, end, kind[start]

    def encode(self, text: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch with the end id after each text, and where each text's begin (length + 1)."""
        whole = self.marked(text)
        if len(whole):
            texts = text.take(pa.array(whole)).to_pylist()
            mask = np.zeros(len(text), bool)
            mask[whole] = True
            ids, at = self.encode(pc.if_else(pa.array(mask), "", text), end_id)
            # the texts' own ids go before their end ids
            own = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            size = np.zeros(len(text), np.int64)
            size[whole] = [len(x) for x in own]
            return np.insert(ids, np.repeat(at[:-1], size), np.concatenate(own)), at + np.concatenate(([0], np.cumsum(size)))
        buf, offsets = buffers(text)
        parts, counts = [], []
        for i, j in slices(offsets, 2 << 20):
            ids, n = self.piece(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end_id)
            parts.append(ids)
            counts.append(n)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.concatenate(([0], np.cumsum(n)))

    def marked(self, text: pa.Array) -> np.ndarray:
        """Numbers of the texts that may hold an added token."""
        found = np.zeros(len(text), bool)
        for content, normalized in self.added:
            hit = pc.match_substring(text, content, ignore_case=normalized)
            found |= hit.fill_null(False).to_numpy(zero_copy_only=False)
        return np.flatnonzero(found)

    def piece(self, buf: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        n_docs = len(offsets) - 1
        if not len(buf):
            return np.full(n_docs, end_id, np.uint32), np.ones(n_docs, np.int64)
        start, end, kind = self.runs(buf, offsets)
        h = prefix_hash(_LOWER[buf])
        key = mix((h[end] - h[start]) * powers("down", len(buf))[start] ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        entry = self.find(key)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            _, at = np.unique(key[missing], return_index=True)
            if len(self.keys) + len(at) > MOST:
                self.clear()
                missing = np.arange(len(key))
                _, at = np.unique(key, return_index=True)
            at = missing[at]
            self.learn(key[at], buf, start[at], end[at], kind[at])
            entry = self.find(key)
        size = self.size[entry].astype(np.int64)
        doc = np.searchsorted(offsets, start, "right") - 1
        total = np.bincount(doc, weights=size, minlength=n_docs).astype(np.int64) + 1
        out = np.full(int(total.sum()), end_id, np.uint32)
        # a run's ids go after those of the runs before it and the end ids of the documents before
        to = np.cumsum(size) - size + doc
        spread = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to, size) + spread] = self.pool[np.repeat(self.at[entry], size) + spread]
        return out, total

    def find(self, key: np.ndarray) -> np.ndarray:
        """Index of each key's entry, -1 where there is none."""
        slot = (key & np.uint64(TABLE - 1)).astype(np.int64)
        entry = np.where(self.slot_key[slot] == key, self.slot[slot], -1)
        rest = np.flatnonzero(entry < 0)
        if len(rest) and len(self.keys):
            k = key[rest]
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            hit = self.keys[at] == k
            found = self.entry[at[hit]]
            entry[rest[hit]] = found
            self.slot_key[slot[rest[hit]]] = k[hit]
            self.slot[slot[rest[hit]]] = found
        return entry

    def learn(self, key: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> None:
        """Encode new runs (keys ascend) and merge them into the memo."""
        raw = buf.tobytes()
        model, out = self.model, []
        whole = [raw[a:b].decode("utf-8", "replace") for a, b, k in zip(start.tolist(), end.tolist(), kind.tolist(), strict=True) if k == WHOLE]
        known = iter(self.library.encode_batch_fast(whole, add_special_tokens=False)) if whole else iter(())
        for a, b, k in zip(start.tolist(), end.tolist(), kind.tolist(), strict=True):
            if k == WHOLE:
                out.append(array("I", next(known).ids))
                continue
            text = raw[a:b]
            text = text.lower() if text.isascii() else self.normal.normalize_str(text.decode()).encode()
            out.append(array("I", [t.id for t in model.tokenize(text.decode("latin-1").translate(ALPHABET))]))
        size = np.array([len(x) for x in out], np.int32)
        ids = np.frombuffer(b"".join(x.tobytes() for x in out), np.uint32)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), np.uint32)))
        at = self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        where = np.searchsorted(self.keys, key)
        new = np.arange(len(self.at), len(self.at) + len(key))
        self.keys, self.entry = np.insert(self.keys, where, key), np.insert(self.entry, where, new)
        self.at, self.size = np.append(self.at, at), np.append(self.size, size)


def run_memo(spec: str) -> RunMemo:
    """One memo for each worker process and tokenizer, kept from task to task."""
    if hash(spec) not in _open:
        _open[hash(spec)] = RunMemo(spec)
    return _open[hash(spec)]
