"""Near-duplicate vectors through an inverted file with product quantisation.

Equal vectors of one label (two 64-bit hashes stand for both) are first grouped, so that
copies cost nothing further.  A coarse quantiser, principal directions and, on the
residuals' leading coordinates, subspace codebooks are fitted on a bounded sample
(``MAX_TRAIN`` distinct vectors, by hash order).  Every distinct vector belongs to the
inverted list of its nearest centroid and is stored with its code, the length of its
quantisation error and its own components.  Vectors are dealt by label and list to chunks
of bounded bytes, a row each; of two chunks with a label in common the vectors of one visit
the lists of the other whose border they could have crossed: a partner lies at most ``r``
away (``r`` from the cosine threshold), so it can be in a list only if the border with that
list is at most ``r`` away, in whatever direction.  No link is lost.  In visited lists,
codes looked up in the codebooks give the asymmetric products with all stored vectors; with
the stored error and the lengths of what the leading coordinates leave out they bound the
cosine from above, so that the lookup stage loses nothing either.  What is left is compared
exactly in double precision.

Pairs of chunks are shuffled in rounds, each of about the bytes of the chunks' table, and a
round's shuffle files go before the next begins: the disk that is needed is a fixed multiple
of the input, however many lists are visited.  Links are counted in the task and leave it only
as a count for each vector and a spanning forest, never as pairs; the rounds' counts and
forests are joined up whenever they hold more rows than there are vectors.

Defined results: null, empty or zero vectors, and those with null or non-finite
components, link with nothing, as do rows with a null label or vec_id; a row repeated as
it is counts once as a partner, and each of its repetitions is returned; a cosine of exactly
the threshold is a link; vectors of unlike dimensions never link; vectors are scaled by
their largest component first, so that no square overflows or vanishes; long vectors are
compared whole; an empty table gives no rows.  Other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, looked_up, scratch, tuned, written
from .components import components, forest

COSINE = 0.93
MAX_TRAIN = 16_384
LIST = 1024
MOST_LISTS = 1024
#: Leading principal coordinates that codes stand for: LEAD, or so many fours more that of the
#: sample's pairs only a share of SPARE without a link gets past them, if errors take SLACK.
LEAD, SPARE, SLACK = 16, 5e-4, 0.08
#: Coordinates of a subspace and codes of its book.
WIDE, CODES = 2, 64
#: Vectors of a chunk: so many bytes of them in double precision, but at least LEAST.
CHUNK, LEAST = 16 << 20, 2048
#: Rows and columns of vectors that are compared at once.
ROWS, COLUMNS = 256, 1024
#: What single precision may err by where borders of lists are judged.
ROUGH = 1e-5
#: A round shuffles as many bytes as the chunks have, or so many if those are fewer.
ROUND = 64 << 20
#: Bytes of a shuffle partition of chunks.
PART = 24 << 20


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centre.T - (centre**2).sum(1) / 2, 1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centre))
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
    return centre


def directions(v: np.ndarray) -> np.ndarray:
    """Vectors of length one; components are scaled before they are squared."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Index:
    """Coarse centroids, principal directions and residual codebooks for unit vectors of one dimension."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float = COSINE):
        unit = directions(sample)
        axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1]
        self.axes = axes[:, : self._leading(unit[:1024], axes, cosine)]
        centre = kmeans(unit, max(1, lists))
        # lists of neighbours come next to each other, so that whole chunks can be skipped
        self.centre = centre[np.argsort(centre @ self.axes[:, 0], kind="stable")].astype(np.float32)
        self.half = (self.centre**2).sum(1) / 2
        self.middle = self.centre.astype(float) @ self.axes
        self.edges = range(0, self.axes.shape[1], WIDE)
        rest = unit @ self.axes - self.middle[self.nearest(unit)]
        self.books = [kmeans(rest[:, a : a + WIDE], CODES) for a in self.edges]

    @staticmethod
    def _leading(unit: np.ndarray, axes: np.ndarray, cosine: float) -> int:
        apart = unit @ unit.T < cosine
        for lead in range(LEAD, len(axes), 4):
            part = unit @ axes[:, :lead]
            rest = np.sqrt(np.maximum(1 - (part**2).sum(1), 0))
            if ((part @ part.T + np.outer(rest, rest) >= cosine - SLACK) & apart).mean() <= SPARE:
                return lead
        return len(axes)

    def nearest(self, unit: np.ndarray) -> np.ndarray:
        return np.argmax(unit.astype(np.float32) @ self.centre.T - self.half, 1)

    def encode(self, unit: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the lengths of the errors, rounded up."""
        rest = unit @ self.axes - self.middle[near]
        codes = np.empty((len(unit), len(self.books)), np.uint8)
        error = np.zeros(len(unit))
        for j, (book, a) in enumerate(zip(self.books, self.edges, strict=True)):
            part = rest[:, a : a + WIDE]
            codes[:, j] = np.argmax(part @ book.T - (book**2).sum(1) / 2, 1)
            error += ((part - book[codes[:, j]]) ** 2).sum(1)
        return codes, np.nextafter(np.sqrt(error).astype(np.float32), np.float32(2))

    def visits(self, unit: np.ndarray, near: np.ndarray, lists: np.ndarray, r: float) -> np.ndarray:
        """Which of ``lists`` any of the vectors visits: those whose border with its own list is within r."""
        unit, centre = unit.astype(np.float32), self.centre[lists]
        own = np.einsum("ij,ij->i", unit, self.centre[near]) - self.half[near]
        margin = own[:, None] - (unit @ centre.T - self.half[lists])
        names, at = np.unique(near, return_inverse=True)
        square = 2 * (self.half[names][:, None] + self.half[lists] - self.centre[names] @ centre.T)
        # the root of a square that errs by 1e-6 errs by 1e-3 at most, near zero
        apart = np.sqrt(np.maximum(square, 0) + np.float32(1e-6))
        return (margin <= np.float32(r) * apart[at] + np.float32(ROUGH)).any(0)

    def asking(self, unit: np.ndarray) -> np.ndarray:
        """Rows whose products with those of ``stored`` bound the cosines from above."""
        lead = unit @ self.axes
        square = (lead**2).sum(1)
        return np.column_stack((lead, np.sqrt(square), np.sqrt(np.maximum(1 - square, 0)))).astype(np.float32)

    def stored(self, unit: np.ndarray, near: np.ndarray, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        lead = self.middle[near]
        for j, (book, a) in enumerate(zip(self.books, self.edges, strict=True)):
            lead[:, a : a + WIDE] += book[codes[:, j]]
        rest = np.sqrt(np.maximum(1 - ((unit @ self.axes) ** 2).sum(1), 0))
        return np.column_stack((lead, error, rest)).astype(np.float32)


class Chunk:
    """The vectors of a row of the chunks' table, in order of label and list."""

    def __init__(self, row: dict, dim: int, kind: str):
        def array(name: str, dtype: str) -> np.ndarray:
            return np.frombuffer(row[name].as_buffer(), dtype)

        self.labels, self.ends = row["labels"].as_py(), array("ends", "int64")
        self.g, self.h, self.rep, self.copies = (array(c, "int64") for c in ("g", "h", "rep", "copies"))
        self.list = array("list", "int32")
        self.unit = directions(array("v", kind).reshape(-1, dim).astype(float))
        if "code" in row:
            self.code, self.error = array("code", "uint8").reshape(len(self.g), -1), array("error", "float32")
        self.links = np.zeros(len(self.g), np.int64)

    def found(self) -> list[np.ndarray]:
        met = np.flatnonzero(self.links)
        return [self.g[met], self.h[met], self.rep[met], self.rep[met], self.links[met]]


class Trees:
    """Rows joined up by links, as each row's root."""

    def __init__(self, n: int):
        self.root, self.late, self.waiting = np.arange(n), [], 0

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.root[a] != self.root[b]
        a, b = a[apart], b[apart]
        if len(a) > COLUMNS:
            self._now(a, b)
        elif len(a):
            self.late.append((a, b))
            self.waiting += len(a)
            if self.waiting > 1 << 16:
                self._rest()

    def _rest(self) -> None:
        late, self.late, self.waiting = self.late, [], 0
        if late:
            self._now(*(np.concatenate(x) for x in zip(*late, strict=True)))

    def _now(self, a: np.ndarray, b: np.ndarray) -> None:
        some = np.empty(len(self.root), np.int64)
        while len(a):
            # a link for each end, until none is left whose ends have two roots
            at, taken = np.arange(len(a)), np.zeros(len(a), bool)
            for end in (a, b):
                some[end] = at
                taken |= some[end] == at
            names, roots = forest(self.root[a[taken]], self.root[b[taken]])
            new = np.arange(len(self.root))
            new[names] = roots
            self.root = new[self.root]
            apart = self.root[a] != self.root[b]
            a, b = a[apart], b[apart]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        self._rest()
        node = np.flatnonzero(self.root != np.arange(len(self.root)))
        return node, self.root[node]


FOUND = "g long, h long, rep long, root long, n long"


def compare(index: Index, x: Chunk, y: Chunk, cosine: float, r: float) -> Iterator[pa.RecordBatch]:
    """Counts of links, and a spanning forest of them, between two chunks or within one."""
    asked, held = index.asking(x.unit), index.stored(y.unit, y.list, y.code, y.error)
    cut = np.float32(cosine - 2.4e-7 * (held.shape[1] + 8))  # single precision's rounding
    shift = 0 if x is y else len(x.g)
    rep = x.rep if x is y else np.concatenate((x.rep, y.rep))
    tree = Trees(len(rep))
    room, over = np.empty(ROWS * COLUMNS, np.float32), np.empty(ROWS * COLUMNS, bool)
    few = max(1, (4 << 20) // (8 * x.unit.shape[1]))
    if x is y:
        label = np.repeat(np.arange(len(x.ends)), np.diff(x.ends, prepend=0))
        blocks = [(a, min(a + ROWS, len(x.g)), a, x.ends[label[min(a + ROWS, len(x.g)) - 1]]) for a in range(0, len(x.g), ROWS)]
    else:
        blocks, there = [], {name: j for j, name in enumerate(y.labels)}
        for i, j in ((i, there[name]) for i, name in enumerate(x.labels) if name in there):
            begin, c, d = (x.ends[i - 1] if i else 0), (y.ends[j - 1] if j else 0), y.ends[j]
            blocks += [(a, min(a + ROWS, x.ends[i]), c, d) for a in range(begin, x.ends[i], ROWS)]
    for a, b, c, d in blocks:
        columns = None
        lists, at = np.unique(y.list[c:d], return_inverse=True)
        if len(lists) > 1 and 8 * len(lists) <= d - c:
            visited = index.visits(x.unit[a:b], x.list[a:b], lists, r)
            if not visited.all():
                columns = c + np.flatnonzero(visited[at])
        near = held[c:d] if columns is None else held[columns]
        for k in range(0, len(near), COLUMNS):
            part = near[k : k + COLUMNS]
            cells = (b - a) * len(part)
            tile, mask = room[:cells], over[: -(-cells // 8) * 8]
            np.matmul(asked[a:b], part.T, out=tile.reshape(b - a, -1))
            np.greater_equal(tile, cut, out=mask[:cells])
            mask[cells:] = False
            eights = np.flatnonzero(mask.view(np.uint64))
            if not len(eights):
                continue
            at8, inside = np.nonzero(mask.reshape(-1, 8)[eights])
            p, q = np.divmod(eights[at8] * 8 + inside, len(part))
            p, q = p + a, (q + k + c if columns is None else columns[q + k])
            if x is y:
                once = (p < q) & (label[p] == label[q])
                p, q = p[once], q[once]
            if not len(p):
                continue
            if 16 * len(p) > cells:  # most are near: the whole tile at once
                low, high = q.min(), q.max() + 1
                hit = (x.unit[a:b] @ y.unit[low:high].T)[p - a, q - low] >= cosine if high - low <= 2 * COLUMNS else None
            else:
                hit = None
            if hit is None:
                hit = np.concatenate([np.einsum("ij,ij->i", x.unit[p[m : m + few]], y.unit[q[m : m + few]]) >= cosine for m in range(0, len(p), few)])
            p, q = p[hit], q[hit]
            if not len(p):
                continue
            np.add.at(x.links, p, y.copies[q])
            np.add.at(y.links, q, x.copies[p])
            tree.join(p, q + shift)
    node, root = tree.found()
    node, root = rep[node], rep[root]
    none = np.zeros(len(node), np.int64)
    for columns in ([x.found()] if x is y else [x.found(), y.found()]) + [[none, none, node, root, none]]:
        yield pa.RecordBatch.from_arrays([pa.array(col, pa.int64()) for col in columns], ["g", "h", "rep", "root", "n"])


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding, label)."""
    spark = rows.sparkSession
    tuned(spark)
    r = float(np.sqrt(2 - 2 * cosine))
    single = rows.select("embedding").schema[0].dataType.simpleString() == "array<float>"
    kind = "float32" if single else "float64"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
    sound &= F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    rows = rows.withColumn("g", F.when(sound, F.xxhash64("label", "v"))).withColumn("h", F.when(sound, F.xxhash64(F.lit(1), "v", "label")))
    once = rows.where("g is not null")
    groups = once.select("vec_id", "g", "h", F.size("v").alias("dim")).distinct().groupBy("g", "h", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    groups = written(groups, "vectors")
    dims = sorted(tuple(x) for x in groups.groupBy("dim").count().collect())
    if not dims:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = None
    for dim, n in dims:
        part = _links(once.where(F.size("v") == dim), groups.where(F.col("dim") == dim), n, dim, kind, cosine, r)
        found = part if found is None else found.union(part)
    counts = found.where("n > 0").groupBy("g", "h").agg(F.sum("n").alias("n"))
    # a link between groups joins their first vectors; copies join their group's first
    joined = components(found.where("root <> rep"), "rep", "root").withColumnRenamed("node", "rep")
    known = groups.join(counts, ["g", "h"], "left").join(joined, "rep", "left")
    known = written(known.select("g", "h", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"), "copies"), "vector-groups")
    out = looked_up(rows.select("vec_id", "g", "h"), known, ["g", "h"], "copies")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"), F.coalesce(F.coalesce("c", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


def _chunks(once: DataFrame, groups: DataFrame, n: int, dim: int, kind: str, cosine: float, r: float):  # noqa: ANN202
    """The chunks' table, and the broadcast index."""
    spark = once.sparkSession
    # by hash order, but of the hashes that can be among the first only
    share = int(min(1.0, (1.2 * MAX_TRAIN + 1000) / n) * (1 << 32))
    sample = once.where(F.pmod(F.xxhash64("g"), F.lit(1 << 32)) < share).groupBy("g", "h").agg(F.first("v").alias("v"))
    sample = sample.orderBy(F.pmod(F.xxhash64("g"), F.lit(1 << 32)), "g", "h").limit(MAX_TRAIN).select("v").toPandas()["v"]
    index = Index(np.array(sample.tolist(), float).reshape(-1, dim), min(MOST_LISTS, -(-n // LIST)), cosine)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            v = b.column(5).flatten().to_numpy().reshape(-1, dim)
            unit = directions(v.astype(float))
            near = index.nearest(unit)
            code, error = index.encode(unit, near)
            raw = [pa.array([x.tobytes() for x in part], pa.binary()) for part in (v, code)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(near.astype(np.int32)), *raw, pa.array(error)], ["g", "h", "rep", "copies", "label", "list", "v", "code", "error"])

    vectors = once.groupBy("g", "h").agg(F.first("label").alias("label"), F.first("v").alias("v")).join(groups.select("g", "h", "rep", "copies").hint("merge"), ["g", "h"])
    path = scratch(spark, "vectors-listed")
    listed = "g long, h long, rep long, copies long, label string, list int, v binary, code binary, error float"
    vectors = written(vectors.select("g", "h", "rep", "copies", "label", "v").mapInArrow(place, listed), "vectors-listed", path)
    size = int(max(1, min(CHUNK // (8 * dim), max(LEAST, n // 64))))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        index = shared.value
        table = pa.Table.from_batches(held).combine_chunks()
        del held
        names, label = np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)
        g, h, rep, copies, lists, error = (table[c].to_numpy() for c in ("g", "h", "rep", "copies", "list", "error"))
        order = np.lexsort((g, lists, label))
        everything = np.arange(len(index.centre))
        for k, take in enumerate(np.array_split(order, max(1, round(len(order) / size)))):
            v, code = (b"".join(table[c].take(pa.array(take)).to_pylist()) for c in ("v", "code"))
            unit = directions(np.frombuffer(v, kind).reshape(-1, dim).astype(float))
            reach = np.zeros(len(index.centre), bool)
            for i in range(0, len(take), ROWS):
                reach |= index.visits(unit[i : i + ROWS], lists[take[i : i + ROWS]], everything, r)
            has = np.bincount(lists[take], minlength=len(reach)) > 0
            inside, starts = np.unique(label[take], return_index=True)
            ends = np.append(starts[1:], len(take)).astype(np.int64)
            row = {"chunk": (TaskContext.get().partitionId() << 24) + k, "size": len(take), "list0": int(lists[take[0]]), "g0": int(g[take[0]]), "first": names[inside[0]], "last": names[inside[-1]], "reach": np.packbits(reach).tobytes(), "has": np.packbits(has).tobytes()}
            row |= {"labels": [names[i] for i in inside], "ends": ends.tobytes(), "g": g[take].tobytes(), "h": h[take].tobytes(), "rep": rep[take].tobytes(), "copies": copies[take].tobytes(), "list": lists[take].astype(np.int32).tobytes(), "v": v, "code": code, "error": error[take].tobytes()}
            yield pa.RecordBatch.from_pylist([row], FIELDS)

    dealt = vectors.repartitionByRange(max(1, -(-n // size)), "label", "list", "g")
    chunks = written(dealt.mapInArrow(gathered, SCHEMA), "vector-chunks")
    forget(spark, path)
    return chunks, shared


SCHEMA = "chunk long, size long, list0 int, g0 long, first string, last string, reach binary, has binary, labels array<string>, ends binary, g binary, h binary, rep binary, copies binary, list binary, v binary, code binary, error binary"
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
FIELDS = pa.schema([(name, KINDS[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])
ASKS = ["labels", "ends", "g", "h", "rep", "copies", "list", "v"]
HOLDS = [*ASKS, "code", "error"]


def _rounds(chunks: DataFrame, width: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Pairs (number, chunk, chunk, bytes) of unlike chunks that may hold links, in rounds of bounded bytes."""
    known = chunks.select("first", "list0", "g0", "last", "chunk", "size", "reach", "has").collect()
    known.sort(key=lambda x: (x["first"], x["list0"], x["g0"], x["last"]))
    names = {x: i for i, x in enumerate(dict.fromkeys(y for x in known for y in (x["first"], x["last"])))}
    first, last = (np.array([names[x[c]] for x in known]) for c in ("first", "last"))
    chunk, size = (np.array([x[c] for x in known], np.int64) for c in ("chunk", "size"))
    reach, has = (np.array([np.frombuffer(x[c], np.uint8) for x in known]) for c in ("reach", "has"))
    most = max(ROUND, int(size.sum()) * width)
    pairs, filled = [], 0
    for step in range(1, len(known)):
        # chunks follow in the order of labels: one that two have in common is the last of one and the first of the other
        a = np.flatnonzero(last[:-step] == first[step:])
        if not len(a):
            break
        b = a + step
        near = (reach[a] & has[b]).any(1) & (reach[b] & has[a]).any(1)
        for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
            cost = int(size[i] + size[j]) * width
            if filled + cost > most and pairs:
                yield pairs
                pairs, filled = [], 0
            pairs.append((len(pairs), int(chunk[i]), int(chunk[j]), cost))
            filled += cost
    if pairs:
        yield pairs


def _links(once: DataFrame, groups: DataFrame, n: int, dim: int, kind: str, cosine: float, r: float) -> DataFrame:
    spark = once.sparkSession
    chunks, shared = _chunks(once, groups, n, dim, kind, cosine, r)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                x = Chunk({c: b.column(c)[i] for c in HOLDS}, dim, kind)
                yield from compare(shared.value, x, x, cosine, r)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                x, y = Chunk({c: b.column(f"x_{c}")[i] for c in ASKS}, dim, kind), Chunk({c: b.column(f"y_{c}")[i] for c in HOLDS}, dim, kind)
                yield from compare(shared.value, x, y, cosine, r)

    paths, held = [], 0

    def add(part: DataFrame) -> None:
        nonlocal held
        paths.append(scratch(spark, "vector-links"))
        held += written(part, "vector-links", paths[-1]).count()

    add(chunks.select(*HOLDS).mapInArrow(within, FOUND))
    width = dim * np.dtype(kind).itemsize + 64
    for pairs in _rounds(chunks, width):
        table = F.broadcast(spark.createDataFrame([x[:3] for x in pairs], "pair long, a long, b long"))
        parts = max(1, -(-sum(x[3] for x in pairs) // PART))
        sides = []
        for side, end, columns in (("x", "a", ASKS), ("y", "b", HOLDS)):
            at = [x[1 if end == "a" else 2] for x in pairs]
            rows = chunks.where(F.col("chunk").between(min(at), max(at))).join(table, F.col("chunk") == F.col(end))
            sides.append(rows.select("pair", *[F.col(c).alias(f"{side}_{c}") for c in columns]).repartition(parts, "pair"))
        add(sides[0].hint("merge").join(sides[1], "pair").drop("pair").mapInArrow(between, FOUND))
        if held > max(n, 1 << 20):
            old = list(paths)
            found = spark.read.schema(FOUND).parquet(*old)
            counts = found.where("n > 0").groupBy("g", "h").agg(F.sum("n").alias("n")).select("g", "h", F.lit(0).cast("long").alias("rep"), F.lit(0).cast("long").alias("root"), "n")
            zero = F.lit(0).cast("long")
            trees = components(found.where("root <> rep"), "rep", "root").select(zero.alias("g"), zero.alias("h"), F.col("node").alias("rep"), F.col("component").alias("root"), zero.alias("n"))
            paths.clear()
            add(counts.union(trees))
            held = 0
            for path in old:
                forget(spark, path)
    return spark.read.schema(FOUND).parquet(*paths)
