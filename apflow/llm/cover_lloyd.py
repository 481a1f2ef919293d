"""Product-quantisation codes, with codebooks fitted by Lloyd rounds over partition-local cover trees.

Vectors are cut into consecutive parts; each part position has a codebook of its own. The rows of a task
are packed into blocks of at most ``BLOCK_ROWS``; each block gets, per part position, a cover tree: a node has a
point, the radius that covers all points below it, and its points as one range of the tree's order, so that the
sum of a subtree is the difference of two cumulative sums. The blocks and their trees are written once.

In a Lloyd round a node whose every point is nearest to the same entry (by the triangle inequality: entry
distance of the node's point, plus and minus its radius) gives count and sum of its whole subtree to that entry.
Other nodes pass the entries that are still possible on to their children; the points of ambiguous leaves
are compared one by one. A task sums over all its blocks before anything is shuffled; the driver
receives one row per (part, entry, component), ``entries`` x vector length numbers, and sends the next codebooks.

Components are the integers floor(scale * x), distances are squared Euclidean in exact integers: in doubles
while sums stay below 2^52, else in Python integers.

Defined results: vectors that are null, or hold null, non-finite or larger components than 2^52 in size, drop out;
each vector length has its own codebooks; part i of n goes from component length * i div n, so lengths that n does
not divide are cut unevenly; a codebook begins with the parts of the rows of least id (null ids last, then by vector)
and has fewer entries where there are fewer rows; entries equal in distance: the lower index wins; repeated
rows count each by itself; an error beyond a long is set to the largest long; an empty table gives an empty
result; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apflow.llm.vector_blocks import usable
from apflow.operators.joins import materialize

BLOCK_ROWS = 4096
LEAF_POINTS = 8
BASE = 1.3  # the cover radius shrinks by this factor from a node to its children
EXACT = float(1 << 52)
LONG_MAX = (1 << 63) - 1


# ------------------------------------------------------------------ one block
@dataclass
class CoverTree:
    """Nodes in breadth-first order; node i covers the points ``order[lo[i]:hi[i]]``, its children are consecutive."""

    order: np.ndarray
    point: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray
    children: np.ndarray

    FIELDS = ("order", "point", "radius", "lo", "hi", "child", "children")


def cover_tree(x: np.ndarray) -> CoverTree:
    """The tree of the rows of ``x``."""
    order = np.arange(len(x), dtype=np.int32)
    point, lo, hi, radius, child, children = [0], [0], [len(x)], [], [], []
    at = 0
    while at < len(point):
        ids = order[lo[at] : hi[at]]
        far = ((x[ids] - x[point[at]]) ** 2).sum(axis=1)
        widest = float(far.max(initial=0.0))
        radius.append(np.sqrt(widest))
        groups = []
        if len(ids) > LEAF_POINTS and widest > 0:
            cover = widest / BASE**2
            near = far <= cover
            groups.append((point[at], ids[near]))
            rest = ids[~near]
            while len(rest):  # the next centre is farther than the cover radius from all before it
                near = ((x[rest] - x[rest[0]]) ** 2).sum(axis=1) <= cover
                groups.append((int(rest[0]), rest[near]))
                rest = rest[~near]
        child.append(len(point))
        children.append(len(groups))
        start = lo[at]
        for centre, members in groups:
            order[start : start + len(members)] = members
            point.append(centre)
            lo.append(start)
            start += len(members)
            hi.append(start)
        at += 1
    ints = [np.array(a, dtype=np.int32) for a in (point, lo, hi, child, children)]
    return CoverTree(order, ints[0], np.array(radius), *ints[1:])


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] + (entries**2).sum(axis=1)[None, :] - 2.0 * (x @ entries.T)


def fits_doubles(x: np.ndarray, entries: np.ndarray) -> bool:
    widest = float(np.abs(x).max(initial=0)) + float(np.abs(entries).max(initial=0))
    return max(1, x.shape[1]) * 4 * widest**2 < EXACT


def nearest(tree: CoverTree, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, ...]:
    """The nearest entry of all points: (lo, hi, entry) of whole subtrees and (places in the order, entry) of single points."""
    nodes, open_ = np.zeros(1 if len(x) else 0, dtype=np.int64), np.ones((1, len(entries)), dtype=bool)
    whole, single = [], []
    while len(nodes):
        exact = squared_distances(x[tree.point[nodes]], entries)
        r = tree.radius[nodes][:, None]
        d = np.sqrt(exact)
        best = np.where(open_, d, np.inf).min(axis=1, keepdims=True)
        possible = open_ & (d - r <= best + r + 1e-9 * (best + r + 1))
        sure = (possible.sum(axis=1) == 1) | (r[:, 0] == 0)
        winner = np.where(open_, exact, np.inf).argmin(axis=1)
        whole.append(np.stack([tree.lo[nodes[sure]], tree.hi[nodes[sure]], winner[sure]], axis=1))
        leaf = ~sure & (tree.children[nodes] == 0)
        places, of = _ranges(tree.lo[nodes[leaf]], tree.hi[nodes[leaf]])
        if len(places):
            exact = squared_distances(x[tree.order[places]], entries)
            single.append(np.stack([places, np.where(possible[leaf][of], exact, np.inf).argmin(axis=1)], axis=1))
        inner = ~sure & ~leaf
        first, n = tree.child[nodes[inner]], tree.children[nodes[inner]]
        nodes, of = _ranges(first, first + n)
        open_ = possible[inner][of]
    empty = np.zeros((0, 2), dtype=np.int64)
    whole = np.concatenate(whole) if whole else np.zeros((0, 3), dtype=np.int64)
    single = np.concatenate(single) if single else empty
    return whole[:, 0], whole[:, 1], whole[:, 2], single[:, 0], single[:, 1]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, and which range each is from."""
    n = (hi - lo).astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo.astype(np.int64)[of], of


def nearest_wide(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(entry, squared distance) of each row in Python integers, for components too wide for exact doubles."""
    whole = [[int(v) for v in e] for e in entries]
    found, errors = [], []
    for row in x:
        p = [int(v) for v in row]
        d = [sum((a - b) ** 2 for a, b in zip(p, e, strict=True)) for e in whole]
        errors.append(min(d))
        found.append(d.index(errors[-1]))
    return np.array(found, dtype=np.int64), errors


def part_bounds(length: int, parts: int) -> list[slice]:
    return [slice(length * i // parts, length * (i + 1) // parts) for i in range(parts)]


def part_sums(tree: CoverTree, x: np.ndarray, entries: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Number and sum of the points nearest to each entry."""
    counts = np.zeros(len(entries), dtype=np.int64)
    if not fits_doubles(x, entries):
        found, _ = nearest_wide(x, entries)
        sums = [[0] * x.shape[1] for _ in entries]
        for e, row in zip(found, x, strict=True):
            sums[e] = [a + int(b) for a, b in zip(sums[e], row, strict=True)]
        np.add.at(counts, found, 1)
        return counts.tolist(), sums
    lo, hi, entry, places, single = nearest(tree, x, entries)
    dealt = x[tree.order].astype(np.int64)
    upto = np.concatenate([np.zeros((1, x.shape[1]), dtype=np.int64), np.cumsum(dealt, axis=0)])
    sums = np.zeros(entries.shape, dtype=np.int64)
    np.add.at(counts, entry, hi - lo)
    np.add.at(sums, entry, upto[hi] - upto[lo])
    np.add.at(counts, single, 1)
    np.add.at(sums, single, dealt[places])
    return counts.tolist(), sums.tolist()


def part_codes(tree: CoverTree, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(entry, squared distance) of each row."""
    if not fits_doubles(x, entries):
        return nearest_wide(x, entries)
    lo, hi, entry, places, single = nearest(tree, x, entries)
    code = np.zeros(len(x), dtype=np.int64)
    at, of = _ranges(lo, hi)
    code[tree.order[at]] = entry[of]
    code[tree.order[places]] = single
    return code, ((x - entries[code]) ** 2).sum(axis=1).astype(np.int64).tolist()


# ---------------------------------------------------------------- Spark plan
def _packed(x: np.ndarray, parts: int) -> bytes:
    small = float(np.abs(x).max(initial=0)) < 2**31
    arrays = {"x": x.astype(np.int32) if small else x}
    for i, p in enumerate(part_bounds(x.shape[1], parts)):
        tree = cover_tree(x[:, p])
        arrays |= {f"{f}{i}": getattr(tree, f) for f in CoverTree.FIELDS}
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(body: bytes, parts: int) -> tuple[np.ndarray, list[CoverTree]]:
    with np.load(io.BytesIO(body)) as z:
        trees = [CoverTree(*[z[f"{f}{i}"] for f in CoverTree.FIELDS]) for i in range(parts)]
        return z["x"].astype(np.float64), trees


def blocks_of(rows: DataFrame, parts: int) -> DataFrame:
    """(length, body, ids, labels): blocks of rows of one vector length with their trees, written.

    ``rows`` has vec_id, label and v (array of double, whole numbers).
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat, bounds = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            size = np.diff(bounds)
            for length in np.unique(size):
                places = np.flatnonzero(size == length)
                for at in range(0, len(places), BLOCK_ROWS):
                    own = places[at : at + BLOCK_ROWS]
                    x = flat[bounds[own][:, None] + np.arange(length)].astype(np.float64)
                    ids, labels = batch.column("vec_id").take(pa.array(own)), batch.column("label").take(pa.array(own))
                    ends = pa.array([0, len(own)], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(length)], pa.int32()), pa.array([_packed(x, parts)], pa.binary()),
                         pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, labels)],
                        names=["length", "body", "ids", "labels"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"length int, body binary, ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>"
    return materialize(rows.mapInArrow(run, schema))


def lloyd_round(blocks: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over the blocks of their vector length."""
    parts = len(codebooks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [[0] * len(c) for c in codebooks]
        sums = [[[0] * c.shape[1] for _ in c] for c in codebooks]
        for batch in batches:
            for body in batch.column("body"):
                x, trees = _unpacked(body.as_py(), parts)
                for i, p in enumerate(part_bounds(x.shape[1], parts)):
                    n, s = part_sums(trees[i], np.ascontiguousarray(x[:, p]), codebooks[i])
                    counts[i] = [a + b for a, b in zip(counts[i], n, strict=True)]
                    sums[i] = [[a + b for a, b in zip(u, w, strict=True)] for u, w in zip(sums[i], s, strict=True)]
        used = [(i, e) for i in range(parts) for e in range(len(codebooks[i])) if counts[i][e]]
        if used:
            yield pa.RecordBatch.from_arrays(
                [pa.array([u[0] for u in used], pa.int32()), pa.array([u[1] for u in used], pa.int32()),
                 pa.array([counts[i][e] for i, e in used], pa.int64()),
                 pa.array([[Decimal(v) for v in sums[i][e]] for i, e in used], pa.list_(pa.decimal128(38, 0)))],
                names=["part", "entry", "n", "total"])

    told = blocks.select("body").mapInArrow(run, "part int, entry int, n bigint, total array<decimal(38,0)>")
    rows = told.select("part", "entry", "n", F.posexplode("total").alias("at", "total")).groupBy("part", "entry", "at").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # entries x vector length rows
    out = [c.copy() for c in codebooks]
    for r in rows:
        out[r["part"]][r["entry"], r["at"]] = float(int(r["total"]) // r["n"])
    return out


@dataclass
class Quantizer:
    """Codebooks by vector length: for each part position an array of entries x components, whole numbers."""

    codebooks: dict[int, list[np.ndarray]]

    def digest(self, length: int) -> str:
        flat = (str(int(v)) for c in self.codebooks[length] for v in c.ravel())
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def scaled_rows(df: DataFrame, scale: float, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v = F.col(vector_col)
    small = ~F.exists(v, lambda x: F.abs(x.cast("double")) >= float(1 << 52))
    return df.where(usable(v) & small).select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def fit(rows: DataFrame, blocks: DataFrame, parts: int, entries: int, rounds: int) -> Quantizer:
    """Codebooks of every vector length of ``rows``, of which ``blocks`` are the packed form."""
    books = {}
    for length in sorted(r[0] for r in blocks.select("length").distinct().collect()):  # one index per length
        own = blocks.where(F.col("length") == length)
        first = rows.where(F.size("v") == length).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
        seeds = np.array([r["v"] for r in first], dtype=np.float64).reshape(len(first), length)
        now = [np.ascontiguousarray(seeds[:, p]) for p in part_bounds(length, parts)]
        for _ in range(rounds):
            now = lloyd_round(own, now)
        books[length] = now
    return Quantizer(books)


def encode(blocks: DataFrame, quantizer: Quantizer, parts: int) -> DataFrame:
    """(vec_id, label, length, code, error) of every row of the blocks; code: indexes, one byte a part up to 256 entries."""
    books = quantizer.codebooks

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, trees = _unpacked(batch.column("body")[i].as_py(), parts)
                own = books[x.shape[1]]
                codes = np.zeros((len(x), parts), dtype=np.int64)
                errors = [0] * len(x)
                for j, p in enumerate(part_bounds(x.shape[1], parts)):
                    codes[:, j], e = part_codes(trees[j], np.ascontiguousarray(x[:, p]), own[j])
                    errors = [a + b for a, b in zip(errors, e, strict=True)]
                width = max(2, max((len(f"{len(c) - 1:x}") for c in own if len(c)), default=2))
                text = ["".join(f"{c:0{width}x}" for c in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array([x.shape[1]] * len(x), pa.int32()),
                     pa.array(text, pa.string()), pa.array([min(e, LONG_MAX) for e in errors], pa.int64())],
                    names=["vec_id", "label", "length", "code", "error"])

    kinds = {f.name: f.dataType.elementType.simpleString() for f in blocks.schema.fields if f.name in ("ids", "labels")}
    return blocks.select("body", "ids", "labels").mapInArrow(
        run, f"vec_id {kinds['ids']}, label {kinds['labels']}, length int, code string, error bigint")


def compress(
    df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, Quantizer]:
    """The codes of all rows, with label_error (the errors summed over equal labels, nulls together), and the codebooks."""
    rows = scaled_rows(df, scale, id_col, vector_col, label_col)
    blocks = blocks_of(rows, parts)
    quantizer = fit(rows, blocks, parts, entries, rounds)
    coded = materialize(encode(blocks, quantizer, parts))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    # written, so that the join has a plain exchange on either side and a hot label can be split
    per_label = materialize(coded.groupBy(F.col("label").alias("__llm_label")).agg(total.alias("label_error")))
    joined = coded.join(per_label, F.col("label").eqNullSafe(F.col("__llm_label")))
    return joined.select("vec_id", "label", "length", "code", "error", "label_error"), quantizer
