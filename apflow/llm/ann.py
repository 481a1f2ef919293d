"""Approximate nearest neighbours over learned partitions (after Neural LSH, Dong et al., 2020).

On a bounded sample the exact k-nearest-neighbour graph is built and cut into balanced parts:
nodes are first laid out along a traversal of the graph and dealt into equal parts, then moved,
one at a time, to the part of most of their neighbours while it has room. A small neural
network learns to tell, from a vector, the parts of its neighbours. It then places every
vector of the table into its most probable part, and routes each query to its most probable
parts, until they hold ``probability`` of the mass and at least k candidates; the candidates
there are ranked exactly.

The fit reads ``sample`` vectors (those of least hashed id, a fixed bound that fits the
driver); all vectors are indexed. Large parts are split into blocks.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows
without id take no part; vectors of different length are not compared, each length has its own
index; a repeated row counts once, and no row of a query's own id is returned for it; ties go to the smaller
id; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apflow.llm.samples import least_hashed
from apflow.llm.vector_blocks import best_per_query, usable
from apflow.operators.joins import materialize

SAMPLE = 6000
PARTS = 32
NEIGHBOURS = 10
PROBABILITY = 0.95
HIDDEN, EPOCHS, SEED = 128, 30, 7


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other rows of each row."""
    out = np.zeros((len(unit), k), dtype=np.int64)
    for at in range(0, len(unit), 512):
        dots = unit[at : at + 512] @ unit.T
        dots[np.arange(len(dots)), at + np.arange(len(dots))] = -np.inf
        out[at : at + 512] = np.argpartition(-dots, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """A part for each node, none larger than ``slack`` times the mean."""
    n = len(graph)
    near = [set(row) for row in graph.tolist()]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            near[j].add(i)
    near = [np.fromiter(s, dtype=np.int64) for s in near]
    order, seen = [], np.zeros(n, dtype=bool)
    for start in range(n):
        queue = [] if seen[start] else [start]
        seen[start] = True
        for node in queue:
            order.append(node)
            fresh = near[node][~seen[near[node]]]
            seen[fresh] = True
            queue.extend(fresh.tolist())
    part = np.zeros(n, dtype=np.int64)
    part[order] = np.arange(n) * parts // n
    room = int(np.ceil(slack * n / parts))
    size = np.bincount(part, minlength=parts)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[near[i]], minlength=parts)
            votes[(size >= room) & (np.arange(parts) != part[i])] = -1
            to = int(votes.argmax())
            if votes[to] > votes[part[i]]:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if moved < n // 200:
            break
    return part


class Router:
    """One hidden layer; vector -> probability of each part."""

    def __init__(self, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray) -> None:
        self.w1, self.b1, self.w2, self.b2 = w1, b1, w2, b2

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        z = np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit_router(unit: np.ndarray, parts: int = PARTS, seed: int = SEED) -> list[np.ndarray]:
    """The router's weights: learn the parts of the sample's neighbour graph; a sample too small to cut has one part."""
    n, dims = unit.shape
    parts = max(1, min(parts, n // 64))
    rng = np.random.default_rng(seed)
    p = [rng.normal(size=(dims, HIDDEN)) * np.sqrt(2 / max(dims, 1)), np.zeros(HIDDEN),
         rng.normal(size=(HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    if parts == 1:
        return p
    graph = neighbour_graph(unit, min(NEIGHBOURS, n - 1))
    part = balanced_parts(graph, parts, seed=seed)
    want = np.zeros((n, parts))
    np.add.at(want, (np.repeat(np.arange(n), graph.shape[1]), part[graph.ravel()]), 1.0)
    want[np.arange(n), part] += 1.0
    want /= want.sum(axis=1, keepdims=True)
    m, v, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(n), max(1, n // 256)):
            x, t = unit[at], want[at]
            h = np.maximum(x @ p[0] + p[1], 0)
            d = (Router(*p)(x) - t) / len(at)
            dh = (d @ p[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((x.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return p


def probes(prob: np.ndarray, sizes: np.ndarray, k: int, probability: float) -> np.ndarray:
    """Which parts each query visits (rows x parts, boolean)."""
    order = np.argsort(-prob, axis=1, kind="stable")
    ranked = np.take_along_axis(prob, order, axis=1)
    before = np.cumsum(ranked, axis=1) - ranked
    found = np.cumsum(sizes[order], axis=1) - sizes[order]
    go = (before < probability) | (found < k + 1)
    out = np.zeros_like(go)
    np.put_along_axis(out, order, go, axis=1)
    return out & (sizes > 0)


def nearest_in_block(query_ids, queries, ids, rows, k) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The best ``k`` of ``rows`` by cosine for each query, in double precision."""
    q_norm, c_norm = np.sqrt((queries**2).sum(axis=1)), np.sqrt((rows**2).sum(axis=1))
    for at in range(0, len(queries), 256):
        cosines = (queries[at : at + 256] @ rows.T) / q_norm[at : at + 256, None] / c_norm
        cosines[query_ids[at : at + 256, None] == ids] = -np.inf
        for i, row in enumerate(cosines, start=at):
            edge = np.partition(row, max(len(row) - k, 0))[max(len(row) - k, 0)]
            near = np.flatnonzero((row >= edge - 1e-9) & (ids != query_ids[i]))
            # one formula for the scores that are returned, whatever the block
            score = (rows[near] * queries[i]).sum(axis=1) / (q_norm[i] * c_norm[near])
            best = np.lexsort((ids[near], -score))[:k]
            if len(best):
                yield query_ids[i], ids[near[best]], score[best]


def search(
    df: DataFrame, is_query, k: int = 5, parts: int = PARTS, probability: float = PROBABILITY, sample: int = SAMPLE,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for those where ``is_query`` holds."""
    v = F.col(vector_col)
    rows = df.where(F.col(id_col).isNotNull() & usable(v) & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), is_query.alias("asks"),
        F.transform(v, lambda x: x.cast("double")).alias("v"),
    ).withColumn("dims", F.size("v")).dropDuplicates(["vec_id", "v"])
    chosen = least_hashed(rows, sample, "vec_id").select("v").toPandas()["v"].tolist()
    routers = {}
    for dims in {len(x) for x in chosen}:
        x = np.array([r for r in chosen if len(r) == dims], dtype=np.float64)
        routers[dims] = fit_router(_unit(x), parts)
    shared = df.sparkSession.sparkContext.broadcast(routers)
    width = parts

    def place(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            part = np.zeros(len(frame), dtype=np.int64)
            for dims, at in frame.groupby("dims").indices.items():
                if dims in shared.value:
                    x = np.array(frame["v"].iloc[at].tolist(), dtype=np.float64)
                    part[at] = Router(*shared.value[dims])(_unit(x)).argmax(axis=1)
            yield frame.assign(grp=frame["dims"] * width + part)

    schema = "vec_id bigint, asks boolean, v array<double>, dims int"
    placed = materialize(rows.select("vec_id", "asks", "v", "dims").mapInPandas(place, f"{schema}, grp bigint"))
    counts = {r["grp"]: r["n"] for r in placed.groupBy("grp").agg(F.count("*").alias("n")).collect()}  # lengths x parts rows

    def route(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dims, at in frame.groupby("dims").indices.items():
                sizes = np.array([counts.get(dims * width + p, 0) for p in range(width)])
                some = frame.iloc[at]
                if dims in shared.value:
                    prob = Router(*shared.value[dims])(_unit(np.array(some["v"].tolist(), dtype=np.float64)))
                    go = probes(np.pad(prob, ((0, 0), (0, width - prob.shape[1]))), sizes, k, probability)
                else:
                    go = np.tile(sizes > 0, (len(some), 1))
                q, p = np.nonzero(go)
                yield pd.DataFrame({"grp": dims * width + p, "vec_id": some["vec_id"].to_numpy()[q], "v": some["v"].to_numpy()[q]})

    def compare(query_ids, queries, ids, vectors):
        return nearest_in_block(query_ids, queries, ids, vectors, k)

    asked = placed.where("asks").select("vec_id", "v", "dims").mapInPandas(route, "grp bigint, vec_id bigint, v array<double>")
    return best_per_query(asked, placed.select("grp", "vec_id", "v"), k, compare, "double")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
