"""Removal of repeated byte passages by distributed prefix doubling.

A byte goes if some string of ``length`` bytes (100) that covers it also starts earlier: in a
document of smaller doc_id, or earlier in the same one.

1. Whole copies.  Of documents with equal bytes all but the first go at once (shorter
   ones than ``length`` have nothing to match and stay).
2. Anchors.  Every string of ``length`` bytes holds an anchor, a string of half as many whose
   hash is least among its neighbours; equal strings hold equal anchors at the same
   place.  Only starts near an anchor that occurs twice can repeat; all others are unique
   already and never sorted.
3. Doubling.  Positions start with the rank of their first bytes (25 of 100; a fingerprint of
   64 bits).  In each round the pairs of ranks of a position and of the one at the round's
   offset (25, then 50: as wide as the ranks are by then) are dealt to ranges of values, sorted
   and ranked anew; a position whose pair is unique drops out.  Rounds go on until all are
   unique or the ranks cover ``length`` bytes.  In the last round the earliest position of
   equal pairs stays, and the others start a removed string.  Ranks that occur in one slice
   alone are settled there; only pairs of ranks that slices share travel on.

Spark deals and groups the ranges; a row holds a slice's part of a range, and the pairs of a
range are sorted in numpy.  Each slice of documents (``SLICE`` bytes; a longer document stands
alone) sends one entry for each distinct pair, with its earliest position, so that a passage
that a third of all documents share costs each slice one entry and no task gathers it.

A removal could only be wrong if fingerprints of unlike strings met in all rounds at one place.

Defined results: null text counts as empty; null doc_ids come before all others; rows
repeated as they are count as one document and get equal results; unlike texts under one
doc_id, which tie, are ordered by a hash; very long texts are whole; an empty table gives no
rows; other columns, whatever their names, are kept or ignored as the caller says.
Memory of a task: about 120 bytes for each byte of a slice or of the longest document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, forget, looked_up, partitions, scratch, text_bytes, tuned, written
from .hashing import BASE, buffers, mix, prefix_hash, powers, slices, sliding_min
from .set_join import _grouped

LENGTH = 100
#: Bytes that the first ranks cover at least, where ``length`` is twice that or more.
FIRST = 25
SLICE = 2 << 20
#: Bytes of affected text in a partition of slices, about.
PART = 16 << 20
#: Bytes of affected text for each bucket of ranks; there are 65,536 buckets at most, as half a rank's key.
BUCKET = 3_000_000
LAST = np.uint32(0xFFFFFFFF)
#: Marks ranks that one slice alone holds.
OWN = np.uint64(1 << 63)
EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Plan:
    """Strings of ``length`` bytes, their anchors of ``half``, and the doubling: the first ranks' width and
    the offset of each round."""

    length: int
    half: int
    first: int
    offsets: tuple[int, ...]


def plan(length: int) -> Plan:
    if length < 4:
        raise ValueError("a repeated string has 4 bytes at least")
    rounds = max(1, (length // FIRST).bit_length() - 1)
    first = -(-length // (1 << rounds))
    offsets, width = [], first
    while width < length:
        offsets.append(min(width, length - width))
        width += offsets[-1]
    return Plan(length, length // 2, first, tuple(offsets))


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63)).cast("long")).alias("ord"), text.alias("text"), F.xxhash64(doc_id, text).alias("rid"))


def anchors(buf: np.ndarray, offsets: np.ndarray, p: Plan) -> np.ndarray:
    """Positions of the anchors of all documents in a buffer (and a few more at their borders)."""
    n, half, span = len(buf), p.half, p.length - p.half + 1
    if n < p.length:
        return np.zeros(0, np.int64)
    h = prefix_hash(buf)
    x = (((h[half:] - h[:-half]) * powers("down", n + 1)[: n - half + 1]) >> np.uint64(32)).astype(np.uint32)
    size = np.diff(offsets)
    border = np.zeros(n + 1, np.int32)  # strings that reach over a document's end, and short documents
    lo = np.where(size < p.length, offsets[:-1], offsets[1:] - half + 1)
    np.add.at(border, np.clip(lo, 0, n), 1)
    np.add.at(border, offsets[1:], -1)
    x[np.cumsum(border[:-1])[: len(x)] > 0] = LAST
    least = sliding_min(x, span)
    padded = np.full(len(least) + 2 * (span - 1), LAST)
    padded[span - 1 : span - 1 + len(least)] = LAST - least
    # the greatest minimum over the windows that hold a position: its own hash where it is an anchor
    best = LAST - sliding_min(padded, span)
    return np.flatnonzero((x == best[: len(x)]) & (x != LAST))


def repeated_anchors(rows: DataFrame, n_buckets: int, p: Plan) -> DataFrame:
    """rid, blobs of the positions of anchors that unlike documents share or one holds twice, and
    the least of those anchors' hashes, which near copies tend to have in common."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in batches:
            rid, cid = b.column(0).to_numpy(), b.column(1).to_numpy()
            buf, offsets = buffers(b.column(2))
            for i, j in slices(offsets, 2 * SLICE):
                part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                at = anchors(part, off, p)
                doc = np.searchsorted(off, at, "right") - 1
                h = prefix_hash(part)
                name = mix((h[at + p.half] - h[at]) * powers("down", len(part) + 1)[at])
                place = at - off[doc]
                who = cid[i:j][doc].view(np.uint64) ^ mix(place.astype(np.uint64))
                order = np.lexsort((who, name))
                name, who, doc, place = name[order], who[order], doc[order], place[order]
                start = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1]))) if len(name) else np.zeros(0, np.int64)
                count = np.diff(np.append(start, len(name)))
                several = np.minimum.reduceat(who, start) != np.maximum.reduceat(who, start) if len(start) else np.zeros(0, bool)
                many = np.repeat(several, count)
                back = np.lexsort((place[many], doc[many]))
                out = []
                if many.any():
                    d, at, k = doc[many][back], place[many][back], name[many][back]
                    names, c = np.unique(d, return_counts=True)
                    out.append((turn % n_buckets, b"", b"", b"", b"", b"", rid[i:j][names].tobytes(), c.astype(np.uint32).tobytes(), at.astype(np.uint32).tobytes(), k.astype(np.uint32).tobytes()))
                    turn += 1
                once = name[start[several]]
                name, doc, place = name[~many], doc[~many], place[~many]
                back = np.argsort(doc, kind="stable")
                name, doc, place = name[back], doc[back], place[back]
                bucket = (name >> np.uint64(32)) % np.uint64(n_buckets)
                for k, ix, v in _grouped(np.arange(len(name)), name, bucket):
                    names, c = np.unique(doc[ix], return_counts=True)
                    out.append((k, v.astype(np.uint32).tobytes(), rid[i:j][names].tobytes(), cid[i:j][names].tobytes(), c.astype(np.uint32).tobytes(), place[ix].astype(np.uint32).tobytes(), b"", b"", b"", b""))
                for k, _, v in _grouped(np.zeros(len(once), np.int64), once, (once >> np.uint64(32)) % np.uint64(n_buckets)):
                    out.append((k, v.astype(np.uint32).tobytes(), b"", b"", b"", b"", b"", b"", b"", b""))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "h", "rid", "cid", "count", "place", "known", "kcount", "kplace", "kname"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        def joined(c, kind):
            return np.frombuffer(b"".join(pdf[c]), kind)

        h = joined("h", np.uint32)
        rid, cid, count, place = joined("rid", np.int64), joined("cid", np.uint64), joined("count", np.uint32), joined("place", np.uint32)
        owner = np.repeat(np.arange(len(rid)), count)
        mine = np.concatenate([np.full(len(a) // 4, len(b) > 0) for a, b in zip(pdf["h"], pdf["rid"], strict=True)]) if len(h) else np.zeros(0, bool)
        who = np.zeros(len(h), np.uint64)
        who[mine] = cid[owner] ^ mix(place.astype(np.uint64))
        entry = np.full(len(h), -1)
        entry[mine] = np.arange(len(place))
        found = np.zeros(0, np.int64)
        if len(h):
            order = np.argsort(h, kind="stable")
            s = h[order]
            start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            w, e = who[order], entry[order]
            several = (np.minimum.reduceat(w, start) != np.maximum.reduceat(w, start)) | (np.minimum.reduceat(e, start) < 0)
            e = e[np.repeat(several, np.diff(np.append(start, len(s))))]
            found = np.sort(e[e >= 0])
        docs, places = rid[owner[found]], place[found]
        hashed = np.zeros(len(place), np.uint32)
        hashed[entry[mine]] = h[mine]
        ids = (mix(hashed[found].astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
        known, kcount = joined("known", np.int64), joined("kcount", np.uint32)
        ids = np.concatenate((ids, (mix(joined("kname", np.uint32).astype(np.uint64)) >> np.uint64(1)).astype(np.int64)))
        docs, places = np.concatenate((docs, np.repeat(known, kcount))), np.concatenate((places, joined("kplace", np.uint32)))
        order = np.argsort(docs, kind="stable")
        docs, places, ids = docs[order], places[order], ids[order]
        names, at = np.unique(docs, return_index=True)
        cut = np.append(at, len(docs))
        return pd.DataFrame({"rid": names.astype(np.int64), "places": [places[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], "least": np.minimum.reduceat(ids, at) if len(at) else np.zeros(0, np.int64)})

    schema = "bucket int, h binary, rid binary, cid binary, count binary, place binary, known binary, kcount binary, kplace binary, kname binary"
    return rows.select("rid", "cid", "text").mapInArrow(spread, schema).groupBy("bucket").applyInPandas(meet, "rid long, places binary, least long")


def sliced(affected: DataFrame) -> DataFrame:
    """One row for each slice: its documents in order, their bytes, and the places of their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            held.sort(key=lambda x: (x[1], x[0]))
            values = (
                min(x[0] for x in held),
                np.array([x[0] for x in held], np.int64).tobytes(),
                np.array([x[1] for x in held], np.int64).tobytes(),
                np.array([len(x[2]) for x in held], np.int64).tobytes(),
                b"".join(x[2] for x in held),
                np.array([len(x[3]) // 4 for x in held], np.int64).tobytes(),
                b"".join(x[3] for x in held),
            )
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([values[0]], pa.int64()), *(pa.array([v], pa.binary()) for v in values[1:])], ["slice", "rid", "ord", "size", "text", "n", "places"])

        for b in batches:
            for r, o, t, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                held.append((r, o, t, b"".join(p)))
                size += len(t)
                if size >= SLICE:
                    yield row()
                    size = 0
        if held:
            yield row()

    return affected.select("rid", "ord", "text", "places").mapInArrow(run, "slice long, rid binary, ord binary, size binary, text binary, n binary, places binary")


@dataclass
class Pairs:
    """The distinct pairs of one round in a slice, by bucket (-1: settled in the slice itself)."""

    positions: np.ndarray
    place: np.ndarray  # of each position: its pair
    bucket: np.ndarray
    name: np.ndarray | None  # first round: the pair's fingerprints as one
    one: np.ndarray | None  # later rounds: the pair's ranks
    two: np.ndarray | None
    earliest: np.ndarray
    twice: np.ndarray  # held by several positions of the slice


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts of the runs of equal keys in it, run of each key)."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(key) else np.zeros(0, bool)
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), place


class Slice:
    """The documents of one slice, its candidate starts and their pairs of ranks."""

    def __init__(self, p: Plan, n_buckets: int, rid: bytes, ord_: bytes, size: bytes, text: bytes, n: bytes, places: bytes):
        self.plan, self.n_buckets = p, n_buckets
        self.rid, self.ord = np.frombuffer(rid, np.int64), np.frombuffer(ord_, np.int64)
        size, n = np.frombuffer(size, np.int64), np.frombuffer(n, np.int64)
        self.buf = np.frombuffer(text, np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum(size)))
        total = len(self.buf)
        at = np.frombuffer(places, np.uint32).astype(np.int64) + np.repeat(self.offsets[:-1], n)
        owner = np.repeat(np.arange(len(size)), n)
        # a start lies at most length - half before an anchor, in the anchor's document, with length bytes to its end
        lo = np.maximum(at - (p.length - p.half), self.offsets[owner])
        hi = np.minimum(at, self.offsets[owner + 1] - p.length)
        cover = np.zeros(total + 1, np.int32)
        ok = hi >= lo
        np.add.at(cover, lo[ok], 1)
        np.add.at(cover, hi[ok] + 1, -1)
        self.start = np.cumsum(cover[:total]) > 0

    def wanted(self, turn: int) -> np.ndarray:
        """Positions whose pair of the round later rounds look at: the starts, and what lies at later offsets."""
        mark = np.zeros(len(self.buf) + 1, bool)
        mark[: len(self.start)] = self.start
        for k in self.plan.offsets[turn + 1 :]:
            mark[k:] |= mark[:-k].copy()
        return np.flatnonzero(mark)

    def pairs(self, turn: int, replies: list[list[tuple[int, bytes]]]) -> Pairs:
        """The pairs of a round, from the ranks that earlier rounds replied."""
        at, k = self.wanted(turn), self.plan.offsets[turn]
        if turn == 0:
            h, down, w = prefix_hash(self.buf), powers("down", len(self.buf) + 1), self.plan.first
            # the second string begins at the offset and ends where the round's width does
            first = mix((h[at + w] - h[at]) * down[at])
            second = mix((h[at + k + w] - h[at + k]) * down[at + k])
            key = mix(first * BASE + second)
            order, starts, place = _distinct(key)
            name = key[order[starts]]
            count = np.diff(np.append(starts, len(key)))
            earliest = np.minimum.reduceat(at[order], starts) if len(starts) else at
            # buckets are ranges of names, so that their order is the names' own
            bucket = (((name >> np.uint64(32)) * np.uint64(self.n_buckets)) >> np.uint64(32)).astype(np.int64)
            return Pairs(at, place, bucket, name, None, None, earliest, count > 1)
        before = self.pairs(turn - 1, replies)
        rank = self.ranks(before, replies[turn - 1])
        full = np.zeros(len(self.buf) + 1, np.int64)  # of each position: its pair of the last round, from 1; 0: unique
        full[before.positions] = np.where(rank > 0, np.arange(1, len(rank) + 1), 0)[before.place]
        live = (full[at] > 0) & (full[at + k] > 0)
        at = at[live]
        key = (full[at] << 32) | full[at + k]
        order, starts, place = _distinct(key)
        pair = key[order[starts]]
        one, two = rank[(pair >> 32) - 1], rank[(pair & 0xFFFFFFFF) - 1]
        count = np.diff(np.append(starts, len(key)))
        earliest = np.minimum.reduceat(at[order], starts) if len(starts) else at
        # pairs with a rank of this slice's own stay here
        bucket = np.where((one | two) & OWN > 0, -1, (mix(one * BASE + two) % np.uint64(self.n_buckets)).astype(np.int64))
        by = np.lexsort((earliest, bucket))
        to = np.empty(len(by), np.int64)
        to[by] = np.arange(len(by))
        return Pairs(at, to[place], bucket[by], None, one[by], two[by], earliest[by], count[by] > 1)

    def ranks(self, x: Pairs, reply: list[tuple[int, bytes]]) -> np.ndarray:
        """New ranks of a round's pairs: 0 where a pair is unique, marked OWN where other slices lack it."""
        rank = np.where(x.twice, OWN | np.arange(1, len(x.bucket) + 1, dtype=np.uint64), np.uint64(0))
        for k, raw in reply:
            lo, hi = np.searchsorted(x.bucket, k, "left"), np.searchsorted(x.bucket, k, "right")
            bits = -(-int(hi - lo) // 8)
            at = lo + np.flatnonzero(np.unpackbits(np.frombuffer(raw[:bits], np.uint8), count=int(hi - lo)))
            rank[at] = (np.uint64(k) << np.uint64(32)) | np.frombuffer(raw[bits:], np.uint32).astype(np.uint64)
        return rank

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1


COLUMNS = ["slice", "rid", "ord", "size", "text", "n", "places"]


def replies(turns: int) -> list[str]:
    """Columns of the slices that hold the ranks of the first rounds."""
    return [f"ranks{i}" for i in range(turns)]


def _open(b: pa.RecordBatch, p: Plan, n_buckets: int, turns: int) -> Iterator[tuple[int, Slice, list]]:
    for i in range(b.num_rows):
        told = [[(r["bucket"], r["ranks"]) for r in b.column(7 + t)[i].as_py() or []] for t in range(turns)]
        yield b.column(0)[i].as_py(), Slice(p, n_buckets, *(b.column(c)[i].as_py() for c in range(1, 7))), told


def _split(one: np.ndarray, two: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Ranks (16 bits of bucket, 32 of number) as their low halves and both high ones."""
    high = (one >> np.uint64(32) << np.uint64(16)) | (two >> np.uint64(32))
    return one.astype(np.uint32).tobytes(), two.astype(np.uint32).tobytes(), high.astype(np.uint32).tobytes()


def _joined(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    one, two, high = (np.frombuffer(b"".join(pdf[c]), np.uint32) for c in ("one", "two", "high"))
    return (one.astype(np.uint64) << np.uint64(16)) | (high >> np.uint32(16)), (two.astype(np.uint64) << np.uint64(16)) | (high & np.uint32(0xFFFF))


def _runs(bucket: np.ndarray) -> list[np.ndarray]:
    """Indices of each bucket of sorted ones, those of the slice's own left out."""
    first = int(np.searchsorted(bucket, 0, "left"))
    cut = first + np.flatnonzero(np.diff(bucket[first:])) + 1
    return [ix for ix in np.split(np.arange(first, len(bucket)), cut - first) if len(ix)]


def rank_pairs(slices_: DataFrame, n_buckets: int, p: Plan, turn: int) -> DataFrame:
    """slice and [(bucket, ranks)]: for the slice's distinct pairs of the round, in order, a bit for those
    that other slices hold too, and the new ranks of these; ``live``: how many are not unique."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, s, told in _open(b, p, n_buckets, turn):
                x = s.pairs(turn, told)
                out = []
                for ix in _runs(x.bucket):
                    values = (x.name[ix].tobytes(), b"", b"") if turn == 0 else _split(x.one[ix], x.two[ix])
                    out.append((int(x.bucket[ix[0]]), name, *values, int(x.twice[ix].sum())))
                if (own := int(x.twice[x.bucket < 0].sum())):  # they do not travel, but are not unique
                    out.append((0, name, b"", b"", b"", own))
                if out:
                    cols = list(zip(*out, strict=True))
                    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "slice", "one", "two", "high", "twice"])

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        if turn == 0:
            names = np.frombuffer(b"".join(pdf["one"]), np.uint64)
            order = np.argsort(names, kind="stable")  # runs that are sorted already
            s = names[order]
            new = np.concatenate(([True], s[1:] != s[:-1]))
        else:
            one, two = _joined(pdf)
            order = np.lexsort((two, one))
            one, two = one[order], two[order]
            new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(new)))
        shared = count > 1  # a slice sends a pair once
        out = np.empty(len(new), np.uint32)
        out[order] = np.repeat(np.where(shared, np.cumsum(shared), 0).astype(np.uint32), count)
        cut = np.cumsum([len(x) // (8 if turn == 0 else 4) for x in pdf["one"]])[:-1]
        parts = np.split(out, cut)
        return pd.DataFrame({
            "slice": pdf["slice"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "live": [int((x > 0).sum()) + int(t) for x, t in zip(parts, pdf["twice"], strict=True)],
            "ranks": [np.packbits(x > 0).tobytes() + x[x > 0].tobytes() for x in parts],
        })

    sent = slices_.select(*COLUMNS, *replies(turn)).mapInArrow(send, "bucket int, slice long, one binary, two binary, high binary, twice long")
    ranked = sent.groupBy("bucket").applyInPandas(rank, "slice long, bucket int, live long, ranks binary")
    return ranked.groupBy("slice").agg(F.collect_list(F.when(F.octet_length("ranks") > 0, F.struct("bucket", "ranks"))).alias(f"ranks{turn}"), F.sum("live").alias("live"))


def later_starts(slices_: DataFrame, n_buckets: int, p: Plan) -> DataFrame:
    """slice and [(bucket, bits)]: for the slice's distinct pairs of the last round, in order, whether an
    earlier start has the pair too."""
    turn = len(p.offsets) - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, s, told in _open(b, p, n_buckets, turn):
                x = s.pairs(turn, told)
                doc = s.doc_of(x.earliest)
                out = []
                for ix in _runs(x.bucket):
                    if turn == 0:  # names ascend, starts do not
                        ix = ix[np.argsort(x.earliest[ix], kind="stable")]
                    d = doc[ix]  # ascending, as the entries of a bucket are sorted by start
                    which, n = np.unique(d, return_counts=True)
                    values = (x.name[ix].tobytes(), b"", b"") if turn == 0 else _split(x.one[ix], x.two[ix])
                    out.append((int(x.bucket[ix[0]]), name, *values, s.ord[which].tobytes(), s.rid[which].tobytes(), n.astype(np.uint32).tobytes(), (x.earliest[ix] - s.offsets[d]).astype(np.uint32).tobytes()))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["bucket", "slice", "one", "two", "high", "ord", "rid", "n", "at"])

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        n, at = (np.frombuffer(b"".join(pdf[c]), np.uint32) for c in ("n", "at"))
        one, two = (np.frombuffer(b"".join(pdf["one"]), np.uint64), np.zeros(len(at), np.uint64)) if turn == 0 else _joined(pdf)
        ord_, rid = (np.repeat(np.frombuffer(b"".join(pdf[c]), np.int64), n) for c in ("ord", "rid"))
        order = np.lexsort((at, rid, ord_, two, one))
        a, b = one[order], two[order]
        later = np.empty(len(a), bool)
        later[order] = np.concatenate(([False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])))
        cut = np.cumsum([len(x) // (8 if turn == 0 else 4) for x in pdf["one"]])[:-1]
        return pd.DataFrame({"slice": pdf["slice"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "later": [np.packbits(x).tobytes() for x in np.split(later, cut)]})

    sent = slices_.select(*COLUMNS, *replies(turn)).mapInArrow(send, "bucket int, slice long, one binary, two binary, high binary, ord binary, rid binary, n binary, at binary")
    return sent.groupBy("bucket").applyInPandas(first, "slice long, bucket int, later binary").groupBy("slice").agg(F.collect_list(F.struct("bucket", "later")).alias("later"))


def cut_out(slices_: DataFrame, n_buckets: int, p: Plan, with_text: bool) -> DataFrame:
    """rid, n_removed, n_spans, kept_sha256, and the kept text at whole characters (if asked for)."""
    turn = len(p.offsets) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (_, s, told) in enumerate(_open(b, p, n_buckets, turn)):
                x = s.pairs(turn, told)
                later = np.zeros(len(x.bucket), bool)
                for r in b.column(7 + turn)[i].as_py() or []:
                    lo, hi = np.searchsorted(x.bucket, r["bucket"], "left"), np.searchsorted(x.bucket, r["bucket"], "right")
                    bits = np.unpackbits(np.frombuffer(r["later"], np.uint8), count=int(hi - lo)).astype(bool)
                    later[lo + np.argsort(x.earliest[lo:hi], kind="stable") if turn == 0 else slice(lo, hi)] = bits
                gone = x.positions[later[x.place] | (x.positions != x.earliest[x.place])] if len(x.positions) else x.positions
                cover = np.zeros(len(s.buf) + 1, np.int32)
                cover[gone] += 1  # each start is there once
                cover[gone + p.length] -= 1
                removed = np.cumsum(cover[:-1]) > 0
                rows = []
                for d in range(len(s.rid)):
                    lo, hi = s.offsets[d], s.offsets[d + 1]
                    out, text = removed[lo:hi], s.buf[lo:hi]
                    n = int(out.sum())
                    spans = int(out[0]) + int((out[1:] & ~out[:-1]).sum()) if len(out) else 0
                    kept = text[~out].tobytes()
                    row = (int(s.rid[d]), n, spans, hashlib.sha256(kept).hexdigest())
                    if with_text:
                        whole = np.flatnonzero((text & 0xC0) != 0x80)
                        if len(whole):
                            char = np.logical_and.reduceat(out, whole)
                            out = np.repeat(char, np.diff(np.append(whole, len(text))))
                        row += (text[~out].tobytes().decode("utf-8", "replace"),)
                    rows.append(row)
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], ["rid", "n_removed", "n_spans", "kept_sha256", "kept"][: len(cols)])

    schema = "rid long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    return slices_.select(*COLUMNS, *replies(len(p.offsets) - 1), "later").mapInArrow(run, schema)


def find_repeats(docs: DataFrame, with_text: bool = False, length: int = LENGTH) -> DataFrame:
    """rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, null where the text stays
    as it is) for each distinct document; ``rid`` is ``xxhash64(doc_id, text)``."""
    spark = docs.sparkSession
    tuned(spark)
    p = plan(length)
    size = text_bytes(docs)
    rows = _identified(docs)
    meta = written(rows.select("rid", "doc_id", "ord", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")).distinct(), "contents")
    first = written(meta.groupBy("sha").agg(F.min(F.struct("ord", "rid")).alias("first"), F.count("*").alias("copies")), "firsts")
    meta = written(looked_up(meta, first, ["sha"], "copies").select("rid", "doc_id", "n_bytes", "sha", (F.col("first.rid") != F.col("rid")).alias("copy")), "contents")
    found = written(repeated_anchors(rows.select("rid", F.xxhash64("text").alias("cid"), "text"), fold(size // 26, BUCKET, least=4), p), "anchors")
    found = found.join(meta.where("copy"), "rid", "left_anti").groupBy("rid").agg(F.collect_list("places").alias("places"), F.min("least").alias("least"))
    affected = found.join(rows, "rid").groupBy("rid").agg(F.first("ord").alias("ord"), F.first("text").alias("text"), F.first("places").alias("places"), F.first("least").alias("least"))
    kept = scratch(spark, "affected")
    affected = written(affected.withColumn("n_bytes", F.octet_length("text").cast("long")), "affected", kept)
    held = affected.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    # near copies side by side: a slice then sends most of their strings once
    parts = written(sliced(affected.repartitionByRange(max(partitions(spark), fold(held, PART)), "least", "rid").sortWithinPartitions("least", "rid")), "slices")
    forget(spark, kept)
    n_buckets = fold(held, BUCKET, least=4, most=1 << 16)
    live = 1
    for turn in range(len(p.offsets) - 1):
        ranks = written(rank_pairs(parts, n_buckets, p, turn), "ranks")
        live = ranks.agg(F.coalesce(F.sum("live"), F.lit(0))).first()[0]
        if not live:
            break  # every position is unique
        parts = parts.join(ranks.drop("live"), "slice", "left")
    whole = F.col("copy") & (F.col("n_bytes") >= length)
    if not live:
        cut = spark.createDataFrame([], "rid long, n_removed long, n_spans long, kept_sha256 string, kept string")
    else:
        later = written(later_starts(parts, n_buckets, p), "later")
        cut = written(cut_out(parts.join(later, "slice", "left"), n_buckets, p, with_text), "cut")
    out = meta.join(cut, "rid", "left")
    cols = [
        "rid",
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        cols.append(F.when(whole, F.lit("")).when(F.coalesce("n_removed", F.lit(0)) > 0, F.col("kept")).alias("kept"))
    return out.select(*cols)


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``."""
    report = find_repeats(docs, length=length)
    n = _identified(docs).groupBy("rid").agg(F.count("*").alias("_n")).where("_n > 1")
    again = report.join(n, "rid", "left").withColumn("_n", F.explode(F.sequence(F.lit(1), F.coalesce("_n", F.lit(1)))))
    return again.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, at whole characters; all columns stay."""
    report = find_repeats(docs, with_text=True, length=length).where("kept is not null").select(F.col("rid").alias("__loom_rid"), F.col("kept").alias("__loom_kept"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("__loom_row", F.xxhash64(F.col("doc_id").cast("long"), text)).join(report, F.col("__loom_row") == F.col("__loom_rid"), "left")
    return rows.withColumn("text", F.coalesce("__loom_kept", "text")).select(*docs.columns)
