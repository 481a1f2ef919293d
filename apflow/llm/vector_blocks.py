"""Queries against candidates in blocks: no pair of vectors is ever a row.

Both sides are cut into hash blocks of bounded size (in bytes, so fewer rows of longer vectors)
within each group; every query block meets every candidate block of its group in one task, which
returns the best ``k`` of each query. A candidate is sent once per query block, so those are the larger
ones, as large as a task can hold with ease. A group with most of the rows is only more blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apflow.llm.words import whole_groups

QUERY_BYTES, CANDIDATE_BYTES = 1 << 24, 1 << 21  # of doubles: 32,768 and 4,096 vectors of 64 components


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def best_per_query(
    queries: DataFrame, candidates: DataFrame, k: int, compare: Callable, score_type: str,
    query_bytes: int = QUERY_BYTES, candidate_bytes: int = CANDIDATE_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the best k of each query, ties to the smaller vec_id.

    ``queries`` and ``candidates`` have grp, vec_id and v (array of double). ``compare(query ids, query rows,
    candidate ids, candidate rows)`` yields (query id, candidate ids, scores) with the block's best k of each query.
    """
    def numbered(df: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
        blocks = df.groupBy("grp").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("v") * F.lit(8)) / size)).cast("int").alias(f"n_{name}"))
        return df, blocks

    q, q_blocks = numbered(queries, query_bytes, "q")
    c, c_blocks = numbered(candidates, candidate_bytes, "c")
    both = q_blocks.join(c_blocks, "grp")

    def dealt(df: DataFrame, own: str, other: str, is_query: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id"), F.col(f"n_{own}")).cast("int")
        return df.join(both, "grp").select(
            "grp", block.alias(f"{own}b"), F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(f"{other}b"),
            F.lit(is_query).alias("is_query"), "vec_id", "v",
        ).select("grp", "qb", "cb", "is_query", "vec_id", "v")

    met = dealt(q, "q", "c", True).unionByName(dealt(c, "c", "q", False))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["grp", "qb", "cb"]):
            for _, rows in frame.groupby(["grp", "qb", "cb"], sort=False):
                asks = rows["is_query"].to_numpy()
                if asks.all() or not asks.any():
                    continue
                ids = rows["vec_id"].to_numpy()
                vectors = np.array(rows["v"].tolist(), dtype=np.float64).reshape(len(rows), -1)
                found = list(compare(ids[asks], vectors[asks], ids[~asks], vectors[~asks]))
                if found:
                    yield pd.DataFrame({
                        "query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]),
                        "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found]),
                    })

    part = (
        met.repartition("grp", "qb", "cb").sortWithinPartitions("grp", "qb", "cb")
        .mapInPandas(run, f"query_id bigint, vec_id bigint, score {score_type}")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
