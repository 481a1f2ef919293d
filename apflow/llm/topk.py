"""Exact top-k inner products by columnar branch-and-bound.

A block of candidates lies dimension by dimension (vertical layout). For each query the
dimension blocks are added in order of the query's mass; after each, a candidate can gain
at most the sum, over the blocks left, of query norm times candidate norm (Cauchy-Schwarz).
Candidates whose bound is below the k-th best score known are dropped and the survivors
compacted. Bounds carry a slack for rounding, so no candidate that belongs to the result is lost.

Components are integers (``floor(scale * x)``); sums below 2^53 are exact in doubles, and
larger ones are formed in Python integers and, beyond a long, set to its limit.

Defined results: vectors that are null, or hold null or non-finite components, and rows
without id take no part; vectors of different length are not compared; a repeated row (same id,
same vector) counts once, rows of one id with different vectors are all candidates but no
row of a query's own id is returned for it; ties go to the smaller id; an empty table or a
query without candidates gives no rows; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apflow.llm.vector_blocks import best_per_query, usable

DIM_BLOCK = 16
EXACT = float(1 << 52)


def branch_and_bound(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The best ``k`` of ``rows`` for each query: (query id, ids, integer scores)."""
    order = np.argsort(ids, kind="stable")
    ids, columns = ids[order], np.ascontiguousarray(rows[order].T)  # vertical: one row of the array a dimension
    dims = len(columns)
    parts = [slice(d, min(dims, d + DIM_BLOCK)) for d in range(0, dims, DIM_BLOCK)]
    norms = np.array([np.sqrt((columns[p] ** 2).sum(axis=0)) for p in parts]).reshape(len(parts), len(ids))
    exact = dims * max(np.abs(columns).max(initial=0), 1) * max(np.abs(queries).max(initial=0), 1) < EXACT
    for qid, q in zip(query_ids, queries, strict=True):
        mass = np.array([np.sqrt((q[p] ** 2).sum()) for p in parts])
        plan = np.argsort(-mass, kind="stable")
        live = np.flatnonzero(ids != qid)
        if not len(live):
            continue
        head = live[:: max(1, len(live) // 256)]  # scores of a few give the first threshold
        first = q @ columns[:, head]
        known = np.sort(first)[-k] if len(first) >= k else -np.inf
        sums = np.zeros(len(live))
        rest = mass @ norms[:, live]
        for b in plan:
            sums += q[parts[b]] @ columns[parts[b]][:, live]
            rest -= mass[b] * norms[b, live]
            slack = 1e-9 * (np.abs(sums) + np.abs(rest) + 1)
            if len(live) > k:
                low = sums - rest - slack  # certain to be reached
                known = max(known, np.partition(low, len(low) - k)[len(low) - k])
            keep = sums + rest + slack >= known
            live, sums, rest = live[keep], sums[keep], rest[keep]  # compaction
        if exact:
            scores = np.rint(sums).astype(np.int64)
        else:
            whole = [int(x) for x in q]
            sums = [sum(a * int(c) for a, c in zip(whole, columns[:, i], strict=True)) for i in live]
            top = np.iinfo(np.int64)
            scores = np.array([min(max(s, top.min), top.max) for s in sums], dtype=np.int64)
        best = np.lexsort((ids[live], -scores.astype(np.float64) if exact else [-int(s) for s in scores]))[:k]
        yield qid, ids[live[best]], scores[best]


def top_k(df: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``df`` where ``is_query`` holds, against all rows."""
    v = F.col(vector_col)
    rows = df.where(F.col(id_col).isNotNull() & usable(v)).select(
        F.col(id_col).cast("long").alias("vec_id"), is_query.alias("asks"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"),
    ).withColumn("grp", F.size("v")).dropDuplicates(["vec_id", "v"])

    def compare(query_ids, queries, ids, vectors):
        return branch_and_bound(query_ids, queries, ids, vectors, k)

    return best_per_query(rows.where("asks").drop("asks"), rows.drop("asks"), k, compare, "bigint")
