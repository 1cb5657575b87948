"""Exact Jaccard self-join of word-shingle sets, for its connected components.

A set holds the distinct hashes of a document's five-word shingles (fewer words: the
whole sequence).  Copies of one set are held by one representative.  What follows is
exact; every filter is a necessary condition of a link.

1. Unique shingles.  A shingle that only one document holds cannot be shared, and a
   linked document shares 75 of 100 of its own.  Shingle hashes are dealt to buckets
   (each slice of documents sends one entry for a shingle, however many of its documents
   hold it) and only documents with enough shared shingles go on.
2. Index.  Their shingles, rarest first, make prefix lists: two linked sets share a
   shingle within the first ``n - ceil(0.75 n) + 1`` of each.  An entry has the set's
   size and the shingle's position.
3. Set relations.  A list is sorted by size, and the entries of one size by position: a
   block.  Each round draws a pivot for each class of sizes that can link, and a set is
   compared with the pivots of another component that it meets in most and in fewest
   lists, only.  Sets linked that way are one component and need no further comparison
   among themselves, so a group of near copies costs a few comparisons for each member.
4. Block skipping.  For an entry and a block, the sizes give the overlap that is needed; a
   block is skipped whole if the entry's own position leaves too little room, and of the
   others the entries are read only up to the last position that leaves enough.
5. Derived answers.  A set that is linked to its pivot holds the pivot's shingles but a few
   (``removed``) and a few others (``added``).  Candidates of the set are compared with the
   pivot, once for all of its followers; the set's own overlap is then
   ``|p & z| - |removed & z| + |added & z|``, and ``|p & z| + |added|`` already settles most.
   Overlaps with a common pivot bound the others before:
   ``|x & y| <= min(|x & p|, |y & p|) + min(|x - p|, |y - p|)``.

A list that more than CUT sets share is dealt into parts, and pairs of parts are cells, so
that a task's memory does not grow with the list; groups of copies and components are
looked up by ``looked_up``, which gathers no key.

Hashes have 64 bits; the verdict on a pair could only be wrong if two different shingles
of these two documents collided, sets are equal if their sizes and two independent hashes
are, and rows are told apart by 64 bits of doc_id and text.

Defined results: null or empty text, and text without words, has an empty set and links
with nothing, as does a row without doc_id (its set is not built: 0 and null); rows may
repeat, each is returned; rows of one doc_id are one document; ties do not matter, as the
result does not depend on which pivots are drawn; very long texts are whole sets, and a
task's memory is that of its longest; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, looked_up, text_bytes, tuned, written
from .components import components
from .hashing import buffers, distinct, mix, shingles, slices

NUMERATOR, DENOMINATOR = 75, 100
WORDS = 5
SLICE = 2 << 20
#: Shingles in a bucket, on average.
BUCKET = 1_500_000
#: Rounds of comparing sets with pivots; fewer where a round finds no link.  What they leave apart of a
#: group of near copies costs the exact step its square.
STAR_ROUNDS = 6
#: Entries of a shingle's list in one task; longer lists are dealt into parts of about so many.
CUT = 200_000
#: Sets of a long list that all its parts know as pivots, about.
PIVOTS = 256
#: Pairs of entries that are looked at together.
CHUNK = 1 << 20
_SALTS = np.uint64(0x51ED2700A5B3C6D9), np.uint64(0x2545F4914F6CDD1D)


def need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of linked sets of these sizes."""
    return -((-NUMERATOR * (a + b)) // (NUMERATOR + DENOMINATOR))


def prefix(n: np.ndarray) -> np.ndarray:
    return n + (-NUMERATOR * n) // DENOMINATOR + 1


def with_row_id(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("rid"))


def _grouped(owner: np.ndarray, values: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, owners, values) with owners in order."""
    if not len(values):
        return
    order = np.argsort(bucket, kind="stable")
    owner, values, bucket = owner[order], values[order], bucket[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for o, v, b in zip(np.split(owner, cut), np.split(values, cut), bucket[np.concatenate(([0], cut))], strict=True):
        yield int(b), o, v


def sharing(rows: DataFrame, n_buckets: int) -> DataFrame:
    """rid, n, key and other (two hashes of the set) and ``dup``: how many of the set's shingles other rows hold too."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in batches:
            rid = b.column(0).to_numpy()
            buf, offsets = buffers(b.column(1))
            for i, j in slices(offsets, SLICE):
                h, owner, _ = shingles(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WORDS)
                h, owner = distinct(h, owner)
                n = np.bincount(owner, minlength=j - i)
                key = np.zeros((2, j - i), np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    for k, salt in enumerate(_SALTS):
                        key[k, full] = np.add.reduceat(mix(h ^ salt), np.searchsorted(owner, full))
                order = np.argsort(h, kind="stable")
                h, owner = h[order], owner[order]
                start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                count = np.diff(np.append(start, len(h)))
                many = np.repeat(count > 1, count)
                local = np.bincount(owner[many], minlength=j - i)
                once = h[start[count > 1]]
                h, owner = h[~many], owner[~many]
                back = np.argsort(owner, kind="stable")
                h, owner = h[back], owner[back]
                out = [(turn % n_buckets, b"", b"", b"", rid[i:j].tobytes(), n.tobytes(), key[0].tobytes(), key[1].tobytes(), local.tobytes())]
                turn += 1
                for bucket, o, v in _grouped(owner, h, (h >> np.uint64(32)) % np.uint64(n_buckets)):
                    who, c = np.unique(o, return_counts=True)
                    out.append((bucket, v.astype(np.uint32).tobytes(), rid[i:j][who].tobytes(), c.astype(np.uint32).tobytes(), b"", b"", b"", b"", b""))
                for bucket, _, v in _grouped(np.zeros(len(once), np.int64), once, (once >> np.uint64(32)) % np.uint64(n_buckets)):
                    out.append((bucket, v.astype(np.uint32).tobytes(), b"", b"", b"", b"", b"", b"", b""))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "h", "who", "count", "rid", "n", "key", "other", "local"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        rid = np.frombuffer(b"".join(pdf["rid"]), np.int64)
        n = np.frombuffer(b"".join(pdf["n"]), np.int64)
        key, other = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("key", "other"))
        local = np.frombuffer(b"".join(pdf["local"]), np.int64)
        h = np.frombuffer(b"".join(pdf["h"]), np.uint32)
        who, index, base = [], [], 0
        for a, b, c in zip(pdf["h"], pdf["who"], pdf["count"], strict=True):
            if len(b):
                owners = np.frombuffer(b, np.int64)
                index.append(np.repeat(np.arange(base, base + len(owners)), np.frombuffer(c, np.uint32)))
                who.append(owners)
                base += len(owners)
            else:
                index.append(np.full(len(a) // 4, -1))
        found = np.zeros(0, np.int64)
        if len(h):
            index = np.concatenate(index)
            order = np.argsort(h, kind="stable")
            s = h[order]
            same = np.zeros(len(s), bool)
            equal = s[1:] == s[:-1]
            same[1:] |= equal
            same[:-1] |= equal
            found = index[order[same]]
            found = found[found >= 0]
        count = np.bincount(found, minlength=base) if base else np.zeros(0, np.int64)
        names = np.concatenate(who) if who else np.zeros(0, np.int64)
        hit = np.flatnonzero(count)
        zero = np.zeros(len(hit), np.int64)
        rid, dup = np.concatenate((rid, names[hit])), np.concatenate((local, count[hit]))
        n, key, other = (np.concatenate((x, zero)) for x in (n, key, other))
        return pd.DataFrame(_parted(rid, n_buckets, rid, n, key, other, dup), columns=["part", "rid", "n", "key", "other", "dup"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        # of rows of one rid, each gives its own n and key, which are equal; other buckets give zeros
        rid, n, key, other, dup = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("rid", "n", "key", "other", "dup"))
        order = np.lexsort((n, rid))
        rid, n, key, other, dup = (x[order] for x in (rid, n, key, other, dup))
        start = np.flatnonzero(np.concatenate(([True], rid[1:] != rid[:-1])))
        last = np.append(start[1:], len(rid)) - 1
        return pd.DataFrame({"rid": rid[start], "n": n[last], "key": key[last], "other": other[last], "dup": np.add.reduceat(dup, start)})

    spread_rows = rows.select("rid", "text").mapInArrow(spread, "bucket int, h binary, who binary, count binary, rid binary, n binary, key binary, other binary, local binary")
    met = spread_rows.groupBy("bucket").applyInPandas(meet, "part int, rid binary, n binary, key binary, other binary, dup binary")
    return met.groupBy("part").applyInPandas(total, "rid long, n long, key long, other long, dup long")


def sets_of(rows: DataFrame) -> DataFrame:
    """rid, n and the sorted distinct shingle hashes of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = buffers(b.column(1))
            for i, j in slices(offsets, SLICE):
                h, owner = distinct(*shingles(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WORDS)[:2])
                cut = np.searchsorted(owner, np.arange(j - i + 1))
                parts = [h[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(cut)), pa.array(parts, pa.binary())], ["rid", "n", "h"])

    return rows.select("rid", "text").mapInArrow(run, "rid long, n long, h binary")


def _draw(rid: np.ndarray, turn: int) -> np.ndarray:
    """A set's draw in a turn: of the sets that can be a pivot, the one with the least is."""
    return mix(rid.view(np.uint64) ^ np.uint64(turn * 0x9E37 + 1))


def _deal(batches, n_buckets: int, columns: list[str], most: int = CUT, turn: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (rid, h, df, more per-row numbers...) to one row for each bucket and batch.

    A list that ``df`` says is longer than ``most`` is dealt into parts by set, and an entry's
    list is named by shingle and part.  In a ``turn`` of drawing pivots, the entries of a long
    list with about the PIVOTS least draws go to all its parts, which then draw the same
    pivots.  Without one, an entry of part p goes to the cells (p, q) of all parts q, so that
    any two entries meet in one cell: ``side`` says which of its two parts the entry is of, or
    0 where both are the same.
    """
    for b in batches:
        raw = b.column(1).to_pylist()
        size = np.array([len(x) // 8 for x in raw])
        h = np.frombuffer(b"".join(raw), np.uint64)
        owner = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        rid = b.column(0).to_numpy()
        more = [b.column(i).to_numpy() for i in range(3, len(columns))]
        df = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
        parts = -(-df // most)
        part = (mix(rid.view(np.uint64))[owner] % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64)
        at, low, high = np.arange(len(h)), part, part
        if len(parts) and parts.max() > 1:
            copies = parts if turn is None else np.where(_draw(rid, turn)[owner] < float(1 << 64) * PIVOTS / df, parts, 1)
            at = np.repeat(at, copies)
            other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            if turn is None:
                low, high = np.minimum(part[at], other), np.maximum(part[at], other)
            else:
                low = high = np.where(copies[at] > 1, other, part[at])
        name = h[at]
        split = parts[at] > 1
        name[split] = mix(name[split] ^ (low[split].astype(np.uint64) << np.uint64(32)) ^ (high[split].astype(np.uint64) + np.uint64(1)))
        side = np.where((low == high) | (turn is not None), 0, np.where(part[at] == low, 1, 2))
        out = []
        for bucket, ix, v in _grouped(np.arange(len(at)), name, (name >> np.uint64(20)) % np.uint64(n_buckets)):
            o = owner[at[ix]]
            out.append((bucket, v.tobytes(), rid[o].tobytes(), place[at[ix]].tobytes(), side[ix].tobytes(), *(m[o].astype(np.int64).tobytes() for m in more)))
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "h", "rid", "place", "side", *columns[3:]])


def _unpack(pdf: pd.DataFrame, names: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(pdf[c]), np.uint64 if c == "h" else np.int64) for c in names]


def rare_first(sets: DataFrame, n_buckets: int) -> DataFrame:
    """rid, n, first (position of the first listed shingle), h and df: the shingles of the prefix
    that some other set holds, rarest first, and how many sets hold each."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            h = np.frombuffer(b"".join(raw), np.uint64)
            rid = np.repeat(b.column(0).to_numpy(), [len(x) // 8 for x in raw])
            rows = [(k, v.tobytes(), o.tobytes()) for k, o, v in _grouped(rid, h, (h >> np.uint64(20)) % np.uint64(n_buckets))]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "h", "rid"])

    dealt = sets.select("rid", "h").mapInArrow(deal, "bucket int, h binary, rid binary")

    def frequency(pdf: pd.DataFrame) -> pd.DataFrame:
        h, rid = _unpack(pdf, ["h", "rid"])
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        df = count[back]
        keep = df > 1
        h, rid, df = h[keep], rid[keep], df[keep]
        rows = _parted(rid, n_buckets, rid, h, df.astype(np.int64))
        return pd.DataFrame(rows, columns=["part", "rid", "h", "df"])

    shared = dealt.groupBy("bucket").applyInPandas(frequency, "part int, rid binary, h binary, df binary")
    sizes = sets.select("rid", "n").mapInArrow(lambda x: _sizes(x, n_buckets), "part int, rid binary, n binary")

    def order(shared: pd.DataFrame, sizes: pd.DataFrame) -> pd.DataFrame:
        """A part's sets: their shared shingles, no more than the sets themselves, rarest first."""
        rid, df = (np.frombuffer(b"".join(shared[c]), np.int64) for c in ("rid", "df"))
        h = np.frombuffer(b"".join(shared["h"]), np.uint64)
        known, n = (np.frombuffer(b"".join(sizes[c]), np.int64) for c in ("rid", "n"))
        by = np.argsort(known)
        known, n = known[by], n[by]
        by = np.lexsort((h, df, rid))
        rid, h, df = rid[by], h[by], df[by]
        names, at = np.unique(rid, return_index=True)
        cut = np.append(at, len(rid))
        out = []
        for name, a, b, size in zip(names.tolist(), cut[:-1], cut[1:], n[np.searchsorted(known, names)].tolist() if len(names) else [], strict=True):
            unique = size - int(b - a)
            room = int(prefix(np.array(size))) - unique
            if room > 0:
                end = min(b, a + room)
                out.append((name, h[a:end].tobytes(), df[a:end].tobytes(), size, unique))
        return pd.DataFrame(out, columns=["rid", "h", "df", "n", "first"]).astype({"rid": "int64", "n": "int64", "first": "int64"})

    return shared.groupBy("part").cogroup(sizes.groupBy("part")).applyInPandas(order, "rid long, h binary, df binary, n long, first long")


def _parted(key: np.ndarray, n_parts: int, *columns: np.ndarray) -> list[tuple]:
    """(part, blobs of the columns), dealt by key."""
    part = (mix(key.view(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(n_parts + 1))
    return [(p, *(c[order[a:b]].tobytes() for c in columns)) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]


def _sizes(batches: Iterator[pa.RecordBatch], n_parts: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = _parted(b.column(0).to_numpy(), n_parts, b.column(0).to_numpy(), b.column(1).to_numpy())
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", "rid", "n"])


def _merged_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distinct pairs of one part."""
    a, b = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("a", "b"))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    return pd.DataFrame({"a": a[keep], "b": b[keep]})


def _remaining_of(n_parts: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = remaining(pdf)
        a, b = found["a"].to_numpy(np.int64), found["b"].to_numpy(np.int64)
        return pd.DataFrame(_parted(a, n_parts, a, b), columns=["part", "a", "b"])

    return run


def _lists(pdf: pd.DataFrame, names: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Entries sorted by shingle, size, id; and the list number of each."""
    cols = _unpack(pdf, ["h", "rid", "n", *names])
    order = np.lexsort((cols[1], cols[2], cols[0]))
    cols = [c[order] for c in cols]
    new = np.concatenate(([True], cols[0][1:] != cols[0][:-1])) if len(cols[0]) else np.zeros(0, bool)
    return cols, np.cumsum(new) - 1


def _pairs(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    frame = pd.DataFrame({"a": a, "b": b})
    return frame.groupby(["a", "b"], as_index=False).size().rename(columns={"size": "votes"})


def stars(pdf: pd.DataFrame, turn: int) -> pd.DataFrame:
    """(a, b, votes): each entry with its block's pivot, where they may link and are not yet of one component."""
    (h, rid, n, place, first, comp), lists = _lists(pdf, ["place", "first", "comp"])
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "votes": np.zeros(0, np.int64)})
    if not len(h):
        return none
    # sizes of one class can link to each other; the classes' borders move from turn to turn
    width = np.log(DENOMINATOR / NUMERATOR)
    block = lists * 1000 + np.floor(np.log(n) / width + turn / STAR_ROUNDS).astype(np.int64)
    # the pivot of a block: another one in each turn, the same in all lists that hold the same sets
    order = np.lexsort((_draw(rid, turn), block))
    head = np.flatnonzero(np.concatenate(([True], np.diff(block[order]) > 0)))
    pivot = np.empty(len(h), np.int64)
    pivot[order] = np.repeat(order[head], np.diff(np.append(head, len(h))))
    room = np.minimum(n[pivot] - first[pivot] - place[pivot], n - first - place)
    keep = (rid != rid[pivot]) & (comp != comp[pivot]) & (room >= need(n, n[pivot]))
    return _pairs(rid[keep], rid[pivot[keep]]) if keep.any() else none


def _stars_of(turn: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return stars(pdf, turn)

    return run


def _runs(key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, with the length at the end."""
    return np.concatenate((np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), [len(key)]))


def remaining(pdf: pd.DataFrame) -> pd.DataFrame:
    """(a, b, votes): all pairs of different components that no filter and no derived bound excludes.

    Units are the entries of one list, size, component and side, by position.  An entry meets
    units of its list whose size it can link to and of another component; whole units are
    skipped by size and by the entry's position, the rest of a unit by its own positions.
    """
    h, rid, n, place, side, first, comp, p, o = _unpack(pdf, ["h", "rid", "n", "place", "side", "first", "comp", "pivot", "overlap"])
    if not len(h):
        return _no_pairs()
    q = first + place
    order = np.lexsort((rid, q, side, comp, n, h))
    h, rid, n, side, comp, p, o, q = (x[order] for x in (h, rid, n, side, comp, p, o, q))
    lists = np.cumsum(np.concatenate(([True], h[1:] != h[:-1]))) - 1
    unit_start = np.flatnonzero(np.concatenate(([True], (lists[1:] != lists[:-1]) | (n[1:] != n[:-1]) | (comp[1:] != comp[:-1]) | (side[1:] != side[:-1]))))
    unit_end = np.append(unit_start[1:], len(h))
    unit_list, unit_n = lists[unit_start], n[unit_start]
    unit = np.repeat(np.arange(len(unit_start)), unit_end - unit_start)
    # units in order of list and size: an entry meets the later ones up to the size that it can link to and
    # that its own position has room for
    most = np.minimum(n * DENOMINATOR // NUMERATOR, (n - q) * (NUMERATOR + DENOMINATOR) // NUMERATOR - n)
    wide = int(unit_n.max()) + 2
    last = np.searchsorted(unit_list * wide + unit_n, lists * wide + np.clip(most, -1, wide - 1), "right")
    meets = np.maximum(0, last - unit - 1)
    # a unit's entries by position, so that those with enough room are its first ones
    far = int(q.max()) + 2
    position = unit * far + q
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for lo, hi in _chunks(meets):
        i = np.repeat(np.arange(lo, hi), meets[lo:hi])
        u = unit[i] + 1 + np.arange(len(i)) - np.repeat(np.cumsum(meets[lo:hi]) - meets[lo:hi], meets[lo:hi])
        apart = (comp[i] != comp[unit_start[u]]) & ((side[i] == 0) | (side[i] != side[unit_start[u]]))
        i, u = i[apart], u[apart]
        room = unit_n[u] - need(n[i], unit_n[u])
        reads = np.maximum(0, np.searchsorted(position, u * far + np.clip(room, -1, far - 1), "right") - unit_start[u])
        for x, y in _chunks(reads):
            j = np.repeat(unit_start[u[x:y]], reads[x:y]) + np.arange(reads[x:y].sum()) - np.repeat(np.cumsum(reads[x:y]) - reads[x:y], reads[x:y])
            k = np.repeat(i[x:y], reads[x:y])
            derived = np.where((p[j] == p[k]) & (p[k] != 0), np.minimum(o[j], o[k]) + np.minimum(n[j] - o[j], n[k] - o[k]), n[k] + n[j])
            keep = (derived >= need(n[k], n[j])) & (p[j] != rid[k]) & (p[k] != rid[j]) & (rid[j] != rid[k])
            k, j = rid[k[keep]], rid[j[keep]]
            if len(k):
                found.append(_distinct_pairs(np.minimum(k, j), np.maximum(k, j)))
    if not found:
        return _no_pairs()
    a, b = _distinct_pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return pd.DataFrame({"a": a, "b": b})


def _no_pairs() -> pd.DataFrame:
    return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})


def _chunks(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges whose counts come to about CHUNK; ranges that count nothing are left out."""
    total = np.concatenate(([0], np.cumsum(count)))
    at = 0
    while at < len(count) and total[at] < total[-1]:
        to = max(at + 1, int(np.searchsorted(total, total[at] + CHUNK, "right")) - 1)
        if total[to] > total[at]:
            yield at, to
        at = to


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    return a[keep], b[keep]


def overlaps(pairs: DataFrame, sets: DataFrame, differences: bool = False) -> DataFrame:
    """a, b, na, nb, overlap, linked for pairs (a, b), set by set; and, if asked for, what a linked
    ``a`` has more than ``b`` (added) and less (removed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = []
            for a, b in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.concatenate((a, b))
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                linked = DENOMINATOR * same >= NUMERATOR * (len(a) + len(b) - same)
                rows.append((len(a), len(b), same, linked))
                if differences:
                    rows[-1] += (np.setdiff1d(a, b, True).tobytes(), np.setdiff1d(b, a, True).tobytes()) if linked else (None, None)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
            cols = list(zip(*rows, strict=True)) or [()] * (6 if differences else 4)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], ["a", "b", "na", "nb", "overlap", "linked", "added", "removed"][: 2 + len(cols)])

    x = pairs.select("a", "b").join(sets.select(F.col("rid").alias("a"), F.col("h").alias("ha")), "a")
    x = x.join(sets.select(F.col("rid").alias("b"), F.col("h").alias("hb")), "b").select("a", "b", "ha", "hb")
    return x.mapInArrow(run, "a long, b long, na long, nb long, overlap long, linked boolean" + ", added binary, removed binary" * differences)


def derived(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, linked for pairs (a, b) with the overlap of a's pivot and b, and a's differences from its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            linked = []
            for n, o, added, removed, b in zip(*(x.column(i).to_pylist() for i in range(2, 7)), strict=True):
                added, removed, b = (np.frombuffer(v, np.uint64) for v in (added, removed, b))
                o += int(np.isin(added, b, True).sum()) - int(np.isin(removed, b, True).sum())
                linked.append(DENOMINATOR * o >= NUMERATOR * (n + len(b) - o))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    x = pairs.join(sets.select(F.col("rid").alias("b"), "h"), "b").select("a", "b", "n", "overlap", "added", "removed", "h")
    return x.mapInArrow(run, "a long, b long, linked boolean")


def _buckets(index: DataFrame, n_buckets: int, columns: list[str], most: int, turn: int | None = None) -> DataFrame:
    schema = ", ".join(["bucket int", "h binary", "rid binary", "place binary", "side binary", *(f"{c} binary" for c in columns[3:])])
    return index.select(*columns).mapInArrow(lambda x: _deal(x, n_buckets, columns, most, turn), schema).groupBy("bucket")


def _linked_sets(index: DataFrame, sets: DataFrame, n_buckets: int, most: int) -> DataFrame:
    """(a, b): links that join up what all links join up."""
    spark = sets.sparkSession
    known, joined = None, spark.createDataFrame([], "node long, component long")
    columns = ["rid", "h", "df", "n", "first", "comp"]
    for turn in range(STAR_ROUNDS):
        placed = index.join(joined.withColumnRenamed("node", "rid"), "rid", "left").select(*columns[:5], F.coalesce("component", "rid").alias("comp"))
        votes = _buckets(placed, n_buckets, columns, most, turn).applyInPandas(_stars_of(turn), "a long, b long, votes long")
        votes = votes.groupBy("a", "b").agg(F.sum("votes").alias("votes"))
        if known is not None:
            votes = votes.join(known.select("a", "b"), ["a", "b"], "left_anti")
        best = votes.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("x"), F.min(F.struct("votes", "b")).alias("y"))
        best = best.select("a", F.explode(F.array_distinct(F.array("x.b", "y.b"))).alias("b"))
        found = written(overlaps(best, sets, differences=True), "overlaps")
        known = found if known is None else known.union(found)
        joined = components(known.where("linked").select("a", "b"))
        if not found.where("linked").limit(1).count():
            break
    # of each set the pivot that it overlaps most, of linked ones first; without one it is its own
    top = known.groupBy("a").agg(F.max(F.struct("linked", "overlap", "b")).alias("top"))
    pivots = written(known.join(top.select("a", F.col("top.b").alias("b")), ["a", "b"]).select(F.col("a").alias("rid"), F.col("b").alias("pivot"), "overlap", "linked", "added", "removed"), "pivots")
    placed = index.join(joined.withColumnRenamed("node", "rid"), "rid", "left").join(pivots.select("rid", "pivot", "overlap"), "rid", "left")
    placed = placed.select(*columns[:5], F.coalesce("component", "rid").alias("comp"), F.coalesce("pivot", "rid").alias("pivot"), F.coalesce("overlap", "n").alias("overlap"))
    rest = _buckets(placed, n_buckets, [*columns, "pivot", "overlap"], most).applyInPandas(_remaining_of(n_buckets), "part int, a binary, b binary")
    rest = rest.groupBy("part").applyInPandas(_merged_pairs, "a long, b long")
    lead = pivots.where("linked").select(F.col("rid").alias("a"), "pivot", "added", "removed")
    rest = written(rest.join(lead, "a", "left"), "rest")
    of_pivots = written(overlaps(rest.select(F.coalesce("pivot", "a").alias("a"), "b").distinct(), sets), "overlaps")
    own = rest.where("pivot is not null").join(of_pivots.select(F.col("a").alias("pivot"), "b", "na", "nb", "overlap"), ["pivot", "b"])
    n = F.col("na") + (F.octet_length("added") - F.octet_length("removed")) / F.lit(8).cast("long")
    own = own.withColumn("n", n.cast("long")).where((F.col("overlap") + F.octet_length("added") / 8) * (NUMERATOR + DENOMINATOR) >= (F.col("n") + F.col("nb")) * NUMERATOR)
    own = written(derived(own, sets), "derived")
    return known.select("a", "b", "linked").union(of_pivots.select("a", "b", "linked")).union(own).where("linked").select("a", "b")


def near_sets(docs: DataFrame, most: int = CUT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    spark = docs.sparkSession
    tuned(spark)
    size = text_bytes(docs)
    rows = with_row_id(docs)
    n_buckets = fold(size // 6, BUCKET, least=4)
    held = written(sharing(rows.where("doc_id is not null"), n_buckets), "sharing")
    same = ["n", "key", "other"]
    groups = held.where("n > 0").groupBy(*same).agg(F.min("rid").alias("rep"), F.max("dup").alias("dup"), F.count("*").alias("copies"))
    groups = written(groups, "set-groups")
    suspects = groups.where(F.col("dup") * DENOMINATOR >= F.col("n") * NUMERATOR).select(F.col("rep").alias("rid"))
    texts = rows.join(suspects, "rid", "left_semi").groupBy("rid").agg(F.first("text").alias("text"))
    sets = written(sets_of(texts), "sets")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_buckets = fold(total, BUCKET // 4, least=4)
    index = written(rare_first(sets, n_buckets), "index")
    joined = components(_linked_sets(index, sets, n_buckets, most)).withColumnRenamed("node", "rep")
    # from representatives to rows: the least doc_id of all rows of a component's sets; rows of one doc_id meet
    groups = written(groups.join(joined, "rep", "left").select(*same, "copies", F.coalesce("component", "rep").alias("comp")), "joined")
    member = looked_up(held.where("n > 0").select("rid", *same), groups, same, "copies").select("rid", "comp")
    named = written(rows.select("doc_id", "rid").join(held.select("rid", "n"), "rid", "left").join(member, "rid", "left"), "members")
    least = written(named.where("comp is not null and doc_id is not null").groupBy("comp").agg(F.min("doc_id").alias("low"), F.count("*").alias("members")), "least")
    direct = looked_up(named, least, ["comp"], "members").select("doc_id", "rid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("low", "doc_id").alias("low"))
    twice = named.where("comp is not null").groupBy("doc_id").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").limit(1).count()
    if twice:  # rows of one doc_id with unlike texts: their components meet
        ends = direct.where("low <> doc_id").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
        meet = components(ends)
        direct = direct.join(meet.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "rid", "n", F.coalesce("component", "low").alias("low"))
    return direct.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("low").alias("component_id"))
