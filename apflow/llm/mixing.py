"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are shuffled (ordered by a seeded hash). A document's virtual
finish time is the number of its source's words up to its end divided by the source's
target, so at time 1 every source has given its target; documents are offered again in a
second pass, which continues the first one's clock. All entries are then sorted by finish
time over range buckets of the clock, and the mix ends where its words reach the budget:
the entry that crosses it is taken in part.

Targets: source ``i`` (ordered by code point, null last) weighs ``weights[i % len(weights)]``.
The sources share ``budget_share`` of all words by weight; a target stops at ``max_passes``
times its source's words and the excess is shared again by weight until none is above.

Running sums never gather a source in one task: hashes are cut into ``SLICES`` slices and
the clock into as many range buckets, sums per slice come first (partial aggregation) and
only their table, sources x slices rows at most, is summed up in order. Rows with equal
hashes are ordered by id and size, so reruns agree; repeated rows have hashes of their own.

Defined results: a null text has no words; documents without words take part with 0; a
source without words has target 0; rows are taken one by one (repeated rows alike, so a
repeated row counts twice); an empty table gives an empty result; a null source is a source
of its own; a null id is allowed. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apflow.operators.joins import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SLICES = 4096
SEED = 20240607
COPIES_AT_ONCE = 10_000  # of one row, in one task


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _copies(rows: DataFrame, n: Column, index: str) -> DataFrame:
    """Every row ``n`` times, numbered from 0 in the column ``index``; the copies of one row are dealt over tasks."""
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / COPIES_AT_ONCE)))
    chunked = rows.withColumn("__llm_copies", n.cast("long")).withColumn("__llm_chunk", chunk).hint("rebalance")
    first = F.col("__llm_chunk") * COPIES_AT_ONCE
    each = F.sequence(first, F.least(first + COPIES_AT_ONCE, F.col("__llm_copies")) - 1)
    return chunked.withColumn(index, F.explode(each)).drop("__llm_copies", "__llm_chunk")


def sizes(docs: DataFrame, seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, place, slice): one narrow row per document, written once.

    ``place`` is the document's place in its source's shuffled order, ``slice`` the slice of places it is in. Rows
    that are alike are counted first and then numbered, and the number goes into the hash, so that the copies of
    a row lie all over the order and not in one slice.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *[c for c in carry if c != "source"])
    alike = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__llm_n"))
    rows = _copies(alike, F.col("__llm_n"), "__llm_copy").drop("__llm_n")
    own = [F.lit(seed), F.col("doc_id"), F.col("size")]
    place = F.when(F.col("__llm_copy") == 0, F.xxhash64(*own)).otherwise(F.xxhash64(*own, F.col("__llm_copy")))
    rows = rows.withColumn("place", F.shiftrightunsigned(place, 1)).drop("__llm_copy")
    rows = rows.withColumn("slice", F.floor(F.col("place") / F.lit(2**63 // SLICES)).cast("int"))
    return materialize(rows)


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, budget_share: float = 1.5, max_passes: int = 2) -> DataFrame:
    """(source, source_size, target) of every source.

    With caps c and weights w the targets are min(c, level * w), where the level makes them sum to the
    budget. In order of c / w the capped sources come first, so the level follows from running sums over
    the table of sources.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = per_source.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    t = t.withColumn("cap", F.lit(float(max_passes)) * F.col("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_fill = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("budget", F.lit(float(budget_share)) * F.sum("source_size").over(everything))
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open_weight"))
    # the first source whose cap is not reached sets the level of all after it
    t = t.withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(
        (F.col("cap") / F.col("weight")).alias("fill"), F.col("level").alias("level")))).over(everything))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("final.level") * F.col("weight"))
    )
    return t.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget_share: float = 1.5, max_passes: int = 2,
    seed: int = SEED, carry: Sequence[str] = (),
) -> DataFrame:
    """The documents with what the mix takes of them.

    Returns doc_id, size, source_size, target, taken (words, repeats counted), first_at (the place in the mix,
    in words, where its first pass begins; null if it is not taken) and the ``carry`` columns.
    """
    sized = sizes(docs, seed, carry)
    table = materialize(targets(sized, weights, budget_share, max_passes), small=True)
    slice_sums = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slice_sums = slice_sums.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0))).select(
        F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), "slice_start")
    in_slice = Window.partitionBy("source", "slice").orderBy("place", "doc_id", "size")
    rows = (
        sized.withColumn("upto", F.sum("size").over(in_slice.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(in_slice))
        .join(slice_sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice")), "left")
        .withColumn("upto", F.col("upto") + F.col("slice_start")).drop("s_source", "s_slice", "slice_start")
    )
    everything = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.round(F.sum("target").over(everything)).cast("long")
    t = table.select(F.col("source").alias("t_source"), "source_size", "target", budget.alias("budget"))
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
    passes = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.lit(max_passes - 1))).otherwise(F.array(F.lit(0)))
    entries = rows.withColumn("pass", F.explode(passes))
    finish = F.try_divide((F.col("upto") + F.col("pass") * F.col("source_size")).cast("double"), F.col("target"))
    entries = entries.withColumn("finish", F.coalesce(finish, F.lit(float("inf"))))
    # up to 2 the clock's range buckets hold about the same number of words each; later ones grow with the clock
    late = SLICES + F.floor(F.least(F.log2(F.col("finish") / 2), F.lit(1024.0)) * 256)
    bucket = F.when(F.col("finish") < 2, F.floor(F.col("finish") * (SLICES // 2))).otherwise(late).cast("int")
    entries = entries.withColumn("bucket", bucket)
    ticks = entries.groupBy("bucket").agg(F.sum("size").alias("words"))
    ticks = ticks.withColumn(
        "bucket_start", F.coalesce(F.sum("words").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select(F.col("bucket").alias("t_bucket"), "bucket_start")
    in_bucket = Window.partitionBy("bucket").orderBy("finish", "source", "slice", "nth", "pass")
    taken = (
        entries.withColumn("begins", F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(ticks, F.col("bucket") == F.col("t_bucket"))
        .withColumn("begins", F.col("begins") + F.col("bucket_start"))
        .withColumn("takes", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("begins"))))
        .withColumn("at", F.when(F.col("takes") > 0, F.col("begins")))
    )
    keys = ["source", "slice", "nth"]
    return taken.groupBy(*keys).agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.sum("takes").alias("taken"), F.min("at").alias("first_at"),
        *[F.first(c).alias(c) for c in carry if c != "source"],
    ).drop(*[k for k in keys if k not in carry])


def sample_documents(docs: DataFrame, **settings) -> DataFrame:
    """``docs``, same columns, one row for each pass that the mix makes over a document.

    A document that the budget cuts stays whole; documents of which nothing is taken go. Rows with the same id,
    source and text are alike, so the passes over them are dealt out among them: each gets the whole part of
    their share, and what is left goes to copies of one of them.
    """
    hashed = F.xxhash64("text")
    taken = mix(docs.withColumn("__llm_text", hashed), carry=("__llm_text", "source"), **settings)
    passes = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    # written, so that the join has a plain exchange on either side and rows that are very often alike can be split
    dealt = materialize(taken.groupBy("doc_id", "source", "__llm_text").agg(
        F.sum(passes).cast("long").alias("__llm_passes"), F.count(F.lit(1)).alias("__llm_n")).where("__llm_passes > 0").select(
        F.col("doc_id").alias("__llm_doc"), F.col("source").alias("__llm_source"), "__llm_text",
        F.floor(F.col("__llm_passes") / F.col("__llm_n")).alias("__llm_each"),
        (F.col("__llm_passes") % F.col("__llm_n")).alias("__llm_left")))
    rows = docs.withColumn("__llm_hash", hashed)
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def of(some: DataFrame) -> DataFrame:
        return rows.join(some, F.col("doc_id").eqNullSafe(F.col("__llm_doc")) & F.col("source").eqNullSafe(F.col("__llm_source"))
                         & F.col("__llm_hash").eqNullSafe(F.col("__llm_text")))

    each = F.sequence(F.lit(1).cast("long"), F.col("__llm_each"))
    out = of(dealt.where("__llm_each > 0")).withColumn("__llm_pass", F.explode(each)).select(*columns)
    left = dealt.where("__llm_left > 0")  # of repeated rows only
    if left.limit(1).count():
        one = of(left).groupBy("__llm_doc", "__llm_source", "__llm_hash").agg(
            F.first(F.struct(*columns)).alias("__llm_one"), F.first("__llm_left").alias("__llm_left"))
        copies = _copies(one.select("__llm_one", "__llm_left"), F.col("__llm_left"), "__llm_copy")
        out = out.unionByName(copies.select("__llm_one.*"))
    return out
