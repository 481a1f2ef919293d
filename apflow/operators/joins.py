"""Join helpers: size-checked broadcast and NULL-aware membership."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apflow.session import ensure_checkpoint_dir

# A broadcast side is shipped to every executor and held in memory there, so
# on a thousand executors it must stay small: 500k narrow rows (a key or two and
# a value, ~12 MB) is far above a real rate table (currencies x months, tens of
# thousands of rows) and far below executor memory.
DEFAULT_BROADCAST_ROWS = 500_000


def _intermediates(spark: SparkSession) -> str:
    """The folder of this application's written tables."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/apflow-tables/{spark.sparkContext.applicationId}"


def clear_intermediates(spark: SparkSession) -> None:
    """Delete every table this application has written with :func:`materialize`.

    For a caller that has written its results and is done with them: frames
    built before can no longer be read, and frames that keep a written table
    in their plan (``APTables`` and what follows from it) are to be built anew.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(_intermediates(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_folder(spark: SparkSession) -> str:
    """A path of its own under the shared checkpoint folder, not made yet; gone with :func:`clear_intermediates`."""
    return f"{_intermediates(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, small: bool = False) -> DataFrame:
    """Write ``df`` as a parquet table under the shared checkpoint folder and read it back.

    Cuts lineage: a lost executor re-reads the written files instead of
    recomputing the upstream scan and shuffles. Parquet keeps it columnar and
    compressed, unlike an RDD checkpoint of serialized rows. Each call writes
    a fresh folder, so concurrent jobs never share one; it stays until
    :func:`clear_intermediates`. ``small`` is for results bounded by
    construction (a top-k): they are written as a single file.
    """
    return _write(df, fresh_folder(df.sparkSession), small)


def _write(df: DataFrame, path: str, small: bool) -> DataFrame:
    # a result bounded by construction is one file; repartition, not coalesce,
    # so the stage computing it keeps its parallelism
    (df.repartition(1) if small else df).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class WrittenTables:
    """Small tables written once and shared by the jobs of one set of sources.

    A lookup that several jobs derive alike (one rate per currency and month, the excluded suppliers) is written by
    the first of them, with its row count; later jobs read it. Tables are found by Spark's canonical form of
    their plan (``semanticHash`` and ``sameSemantics``), so it does not matter which job built the plan. The sources
    are taken as they were when the table was written: :meth:`forget` after they have changed. A table that
    :func:`clear_intermediates` has deleted is written again.
    """

    def __init__(self) -> None:
        self._held: dict[int, list[tuple[DataFrame, DataFrame, str, int]]] = {}

    def get(self, df: DataFrame, small: bool = False) -> tuple[DataFrame, int]:
        """The written form of ``df`` and its number of rows."""
        key = df.semanticHash()
        spark = df.sparkSession
        for plan, written, path, rows in self._held.get(key, []):
            if plan.sparkSession is spark and plan.sameSemantics(df) and _exists(spark, path):
                return written, rows
        path = fresh_folder(spark)
        written = _write(df, path, small)
        rows = written.count()
        kept = [x for x in self._held.get(key, []) if not x[0].sameSemantics(df)]
        self._held[key] = [*kept, (df, written, path, rows)]
        return written, rows

    def forget(self) -> None:
        """Write every table anew from here on."""
        self._held.clear()


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def sized_dimension(
    df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, written: WrittenTables | None = None
) -> tuple[DataFrame, bool]:
    """Materialize an aggregated lookup and report whether it may be broadcast.

    Used for lookups whose size is bounded by the domain rather than by the
    data (one rate per currency and month). The count reads the checkpoint,
    not the source, so the check costs one pass over a small result; with ``written``, one
    pass for all jobs that share it.
    """
    # not forced into one file: the size is what is being checked
    m, rows = (written or WrittenTables()).get(df)
    return m, rows <= max_rows


def join_dimension(
    fact: DataFrame,
    dim: DataFrame,
    keys: Sequence[tuple[str, str]],
    how: str = "left",
    max_rows: int = DEFAULT_BROADCAST_ROWS,
    written: WrittenTables | None = None,
) -> DataFrame:
    """Join ``fact`` to a lookup on ``(fact column, lookup column)`` pairs.

    The lookup is materialized and counted first (once for all jobs that share ``written``); it is
    broadcast only when the measured row count is at most ``max_rows``. Past that the join stays a
    shuffle (sort-merge) join, where AQE may still pick a broadcast from
    measured sizes. Column names must differ between the two sides.
    """
    dim_m, small = sized_dimension(dim, max_rows, written)
    cond = reduce(lambda a, b: a & b, [F.col(f) == F.col(d) for f, d in keys])
    return fact.join(F.broadcast(dim_m) if small else dim_m, cond, how)


def where_not_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The rows of ``df`` that pass SQL's ``column NOT IN (subquery)``, for a one-column ``values`` of any size.

    NULL semantics as in SQL: an empty subquery keeps every row, a NULL in it keeps none, and
    otherwise a NULL ``column`` is dropped. Spark plans the SQL form as a broadcast of the subquery; here the two
    facts that NULLs depend on are scalar subqueries (one-row aggregates), and the rest is a plain anti join, which
    is broadcast where the values are small and otherwise a shuffle join that can split a hot ``column`` (the
    distinct values get an exchange of their own).
    """
    v = values.select(F.col(values.columns[0]).alias("_excluded"))
    facts = v.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count("_excluded").alias("given"))).scalar()
    empty, no_null = facts["n"] == 0, facts["n"] == facts["given"]
    kept = df.where(empty | (no_null & F.col(column).isNotNull()))
    keys = v.where(F.col("_excluded").isNotNull()).distinct().hint("rebalance")
    return kept.join(keys, F.col(column) == F.col("_excluded"), "left_anti")


# A bitmap of 2^26 bits is broadcast as one (word, bits) row per 64 of them: 2^20 rows of two longs at most,
# about 40 MB as a hash relation. With half as many keys as bits two rows in five still go.
BITMAP_WORDS = 1 << 20
BITMAP_KEYS = BITMAP_WORDS * 32


def reduce_by_keys(
    fact: DataFrame, column: str, keys: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, max_bitmap_keys: int = BITMAP_KEYS
) -> DataFrame:
    """``fact`` without rows whose ``column`` is certainly not among ``keys`` (written, one column), before any shuffle.

    For a fact that is aggregated or shuffled and then joined to the rows of ``keys``: rows that the join
    would drop go in the map tasks. At most ``max_rows`` keys are broadcast as they are (exact). More
    keys, up to ``max_bitmap_keys``, are hashed into a bitmap of fixed size, which lets some others through. Beyond
    that nothing is dropped. The caller's join decides in every case.
    """
    k = keys.select(F.col(keys.columns[0]).alias("_kept"))
    n = k.count()
    if n <= max_rows:
        return fact.join(F.broadcast(k.distinct()), F.col(column) == F.col("_kept"), "left_semi")
    if n > max_bitmap_keys:
        return fact

    def bit(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(BITMAP_WORDS * 64))

    def word(c: Column) -> Column:
        return F.shiftright(bit(c), 6)

    def mask(c: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit(c), F.lit(64)).cast("int"))

    key_type = fact.schema[column].dataType
    own = k.select(F.col("_kept").cast(key_type).alias("_kept")).where(F.col("_kept").isNotNull())
    bitmap = own.groupBy(word(F.col("_kept")).alias("_word")).agg(F.bit_or(mask(F.col("_kept"))).alias("_bits"))
    joined = fact.join(F.broadcast(bitmap), word(F.col(column)) == F.col("_word"))
    return joined.where(F.col("_bits").bitwiseAND(mask(F.col(column))) != 0).select(*[F.col(f"`{c}`") for c in fact.columns])


ROWS_PER_SALT = 1_000_000


def left_join_many(
    one: DataFrame, many: DataFrame, one_key: str, many_key: str, rows_per_salt: int = ROWS_PER_SALT,
    max_rows: int = DEFAULT_BROADCAST_ROWS,
) -> DataFrame:
    """``one`` left-joined to ``many``, where a few keys of ``many`` may hold most of its rows.

    AQE splits only the left side of a left join, so a hot key of the right side would stay in one task. Here the
    rows of ``many`` are counted per key; a key with more than ``rows_per_salt`` of them is hot and gets that
    many salts. Its ``many`` rows are dealt over the salts by a hash of the whole row, and its ``one`` rows are repeated
    once per salt; all other rows have salt 0. A repeated row that meets nothing in its salt goes: the key
    is in ``many``, so another copy of the row has its matches. The hot keys are at most ``many`` / ``rows_per_salt``
    and are broadcast after a size check.

    ``many`` is read twice (write it first if it is costly); rows of it that are alike in every column share a salt.
    Column names must differ between the two sides.
    """
    counts = many.where(F.col(many_key).isNotNull()).groupBy(F.col(many_key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    hot, small = sized_dimension(
        counts.where(F.col("_n") > rows_per_salt).select("_hot", F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_salts")), max_rows)
    hot = F.broadcast(hot) if small else hot
    row = F.xxhash64(*[F.col(f"`{c}`") for c in many.columns])
    dealt = many.join(hot, F.col(many_key) == F.col("_hot"), "left").withColumn(
        "_many_salt", F.coalesce(F.pmod(row, F.col("_salts")), F.lit(0)).cast("int")).drop("_hot", "_salts")
    each = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    repeated = one.join(hot, F.col(one_key) == F.col("_hot"), "left").withColumn("_one_salt", F.explode(each))
    joined = repeated.join(dealt, (F.col(one_key) == F.col(many_key)) & (F.col("_one_salt") == F.col("_many_salt")), "left")
    met = F.col("_salts").isNull() | F.col("_many_salt").isNotNull()
    return joined.where(met).drop("_hot", "_salts", "_one_salt", "_many_salt")
