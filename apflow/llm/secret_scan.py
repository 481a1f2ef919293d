"""Secret scanning with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found by pattern, each kind leftmost and without overlap: ``assign`` (a
password-like name and a value), ``access`` (access key ids), ``hex`` (long hexadecimal runs)
and ``token`` (long runs that mix upper and lower case and digits). Every candidate's hash is
then counted over the corpus by distinct repositories and distinct owners. What ``EXAMPLE_OWNERS`` or
more owners have in different texts is a widely copied example, what belongs to fewer is live-looking:
all copies of one text count for the least owner that has it, so a copied document is no example. Spans of the first three
kinds always stay and carry that verdict; ``token`` spans, which a pattern alone cannot tell
from other identifiers, are added only where the value is owner-specific and the span
overlaps none of the others.

Positions are code points, the end exclusive. Only SHA-256 hashes of candidates are written or
shuffled, never the values.

Defined results: a null text has no spans; a null repository or owner counts as one of its own;
repeated rows are scanned each by itself and count as one owner; ties of position are ordered by
kind as listed; an empty table gives an empty result; extra columns are kept (columns whose names begin with
``__llm_`` excepted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apflow.operators.joins import materialize

KINDS = ("assign", "access", "hex", "token")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 8, 16, 32, 20
# runs are taken whole, so a minimum in the pattern drops the same runs as a test afterwards
ACCESS = rf"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}"
HEX = rf"[0-9a-f]{{{MIN_HEX},}}"
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"
EXAMPLE_OWNERS = 3
MASK = "[SECRET]"
CUT_BLOCK = 512


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches as array<struct(gap, len, hash, keep)>: how far each begins after the one before, and how long it is."""
    pieces = F.split(text, pattern, -1)
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.length(p)).alias("gap"),
    )

    def told(x: Column) -> Column:
        secret, keep = x["m"], F.lit(True)
        if kind == 0:
            secret = F.regexp_extract(x["m"], ASSIGN, 2)
            keep = F.length(secret) >= MIN_ASSIGN
        elif kind == 3:
            keep = x["m"].rlike("[a-z]") & x["m"].rlike("[A-Z]") & x["m"].rlike("[0-9]")
        return F.struct(x["gap"].alias("gap"), F.length(x["m"]).alias("len"), F.when(keep, F.sha2(secret, 256)).alias("hash"),
                        keep.alias("keep"))

    empty = F.array().cast("array<struct<gap:int,len:int,hash:string,keep:boolean>>")
    # one cheap pass decides whether there is anything to cut
    return F.when(text.rlike(pattern), F.transform(found, told)).otherwise(empty)


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__llm_found``, the matches of each kind, and the text's hash where there are any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    patterns = (ASSIGN, ACCESS, HEX, TOKEN)
    found = docs.withColumn("__llm_found", F.array(*[_matches(text, p, kind) for kind, p in enumerate(patterns)]))
    return found.withColumn("__llm_text_md5", F.when(_any_found(), F.md5(F.encode(text, "utf-8"))))


def _any_found() -> Column:
    return F.exists("__llm_found", lambda m: F.size(m) > 0)


def _spans(found: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row per candidate, written: __llm_row, __llm_text_md5, repo, owner, kind, start, end, hash.

    Places are running sums of gaps and lengths, and a ``token`` clashes if the farthest end of the others
    that begin before its own end is behind its start: two windows over the matches of a text, whose work grows with
    their number (times its logarithm).
    """
    each = found.where(_any_found()).select(
        "__llm_row", "__llm_text_md5", repository.alias("repo"), owner.alias("owner"), F.posexplode("__llm_found").alias("kind", "matches"))
    each = each.select("__llm_row", "__llm_text_md5", "repo", "owner", "kind", F.posexplode("matches").alias("nth", "m"))
    each = each.select("__llm_row", "__llm_text_md5", "repo", "owner", "kind", "nth", "m.*").repartition("__llm_row")
    so_far = Window.partitionBy("__llm_row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far).cast("int")).where("keep")
    each = each.withColumn("start", F.col("end") - F.col("len"))
    base = F.col("kind") < 3
    place = F.when(base, F.col("start")).otherwise(F.col("end"))
    before = Window.partitionBy("__llm_row").orderBy(place, base).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(-1))
    each = each.withColumn("reach", reach).where(base | (F.col("reach") <= F.col("start")))
    return materialize(each.select("__llm_row", "__llm_text_md5", "repo", "owner", "kind", "start", "end", "hash"))


def judged(found: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row per span that stays, of the rows of ``found`` (written, with __llm_row, __llm_found and __llm_text_md5).

    __llm_row, start, kind, end, repositories, owners, live.
    """
    each = _spans(found, repository, owner)
    owner_name = F.coalesce("owner", F.lit(""))
    holders = each.select("hash", F.coalesce("repo", F.lit("")).alias("repo"), owner_name.alias("owner")).distinct()
    # copies of a text are no owners of their own: the least one stands for all
    firsts = each.groupBy("hash", "__llm_text_md5").agg(F.min(owner_name).alias("owner"))
    counts = materialize(
        holders.groupBy("hash").agg(F.count_distinct("repo").alias("repositories"), F.count_distinct("owner").alias("owners"))
        .join(firsts.groupBy("hash").agg(F.count_distinct("owner").alias("independent")), "hash"))
    live = F.col("independent") < EXAMPLE_OWNERS
    told = each.drop("repo", "owner").join(counts, "hash").where((F.col("kind") < 3) | live)
    return told.select("__llm_row", "start", "kind", "end", "repositories", "owners", live.alias("live"))


def _by_text(spans: DataFrame) -> DataFrame:
    """(__llm_row, spans): the spans of each text by start and kind."""
    span = F.struct("start", "kind", "end", "repositories", "owners", "live")
    return spans.groupBy("__llm_row").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def owner_of(source: Column) -> Column:
    """What stands before the first slash of a repository's name."""
    return F.substring_index(source, "/", 1)


def scan(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``spans`` (array, empty if there are none)."""
    found = materialize(
        with_candidates(docs, text_col).drop(text_col).withColumn("__llm_row", F.monotonically_increasing_id()))
    source = F.col(source_col).cast("string")
    spans = _by_text(judged(found, source, owner_of(source))).withColumnRenamed("spans", "__llm_told")
    empty = F.array().cast(spans.schema["__llm_told"].dataType)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "spans")]
    return found.join(spans, "__llm_row", "left").select(*kept, F.coalesce("__llm_told", empty).alias("spans"))


def _cut(text: Column, intervals: Column) -> Column:
    """``text`` with each of the ``intervals`` (in order, apart from each other) replaced by the mask.

    The text is cut into blocks of ``CUT_BLOCK`` characters first, as a place in a string is found by counting from its
    beginning; what lies between two intervals is put together from parts of blocks.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT_BLOCK}}}"), F.lit(0))

    def piece(of: Column, begin: Column, end: Column) -> Column:
        first, last = F.floor(begin / CUT_BLOCK).cast("int"), F.floor((end - 1) / CUT_BLOCK).cast("int")

        def part(k: Column) -> Column:
            lo = F.greatest(begin - k * CUT_BLOCK, F.lit(0))
            hi = F.least(end - k * CUT_BLOCK, F.lit(CUT_BLOCK))
            return F.substring(F.element_at(of, k + 1), lo + 1, hi - lo)

        return F.when(end > begin, F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), part), "")).otherwise(F.lit(""))

    def put_together(x: Column) -> Column:
        def between(i: Column) -> Column:
            begin = F.when(i > 0, F.get(x["intervals"], i - 1)["end"]).otherwise(F.lit(0))
            end = F.when(i < F.size(x["intervals"]), F.get(x["intervals"], i)["start"]).otherwise(x["n"])
            return piece(x["blocks"], begin, end)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(x["intervals"])), between), MASK)

    # an element of an array, so that the blocks are cut once and not anew in each step of the inner function
    once = F.array(F.struct(blocks.alias("blocks"), intervals.alias("intervals"), F.length(text).alias("n")))
    return F.element_at(F.transform(once, put_together), 1)


def _live_intervals(spans: DataFrame) -> DataFrame:
    """(__llm_row, __llm_live): the live spans of each text, those that overlap as one, in order."""
    before = Window.partitionBy("__llm_row").orderBy("start", "kind")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where("live").withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1))
    numbered = marked.withColumn("i", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("__llm_row", "i").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("__llm_row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__llm_live"))


def redact(docs: DataFrame, source_col: str = "source", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs``, same columns and rows, with every live-looking secret of the text replaced by a mask.

    Widely copied examples stay. ``length_col``, where there is one, follows the new text.
    """
    found = with_candidates(docs, text_col)
    dirty = materialize(found.where(_any_found()).withColumn("__llm_row", F.monotonically_increasing_id()))
    source = F.col(source_col).cast("string")
    joined = dirty.drop("__llm_found").join(_live_intervals(judged(dirty, source, owner_of(source))), "__llm_row", "left")
    text = F.when(F.col("__llm_live").isNull(), F.col(text_col)).otherwise(_cut(F.col(text_col), F.col("__llm_live")))
    joined = joined.withColumn("__llm_text", text)
    fields = {f.name: f.dataType for f in docs.schema.fields}

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("__llm_text").alias(c)
        if c == length_col:
            return F.when(F.col("__llm_text") != F.col(text_col), F.length("__llm_text")).otherwise(F.col(f"`{c}`")).cast(fields[c]).alias(c)
        return F.col(f"`{c}`")

    clean = found.where(~_any_found()).select(*[F.col(f"`{c}`") for c in docs.columns])
    return joined.select(*[column(c) for c in docs.columns]).unionByName(clean)
