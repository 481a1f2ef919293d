"""A third of all rows alike, and hubs: results stay exact and no task gathers the copies."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from apflow.llm import components, jaccard, mixing, substrings
from tests.test_skew import _final_joins, split_conf  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COPIES = 3000


def _words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(400)}" for _ in range(n)]


@pytest.fixture(scope="module")
def repeated(spark):
    """3,000 copies of one row, a near copy of it, a text that shares a passage with it, 50 others."""
    base = _words(80, 1)
    near, shares = [*base[:-1], "end"], [*_words(30, 2), *base[20:70], *_words(30, 3)]
    rows = [(7, " ".join(base), "en", "s0", 1)] * COPIES + [(8, " ".join(near), "en", "s1", 1), (9, " ".join(shares), "en", "s1", 1)]
    rows += [(100 + i, " ".join(_words(60, 10 + i)), "fr", f"s{i % 3}", 1) for i in range(50)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def _counted(spark, monkeypatch, module, name, *before):
    """How many rows the mapped function ``module.name(...)`` is given in all tasks."""
    total, real = spark.sparkContext.accumulator(0), getattr(module, name)

    def patched(*a):
        inner = real(*a)

        def run(frames):
            def seen():
                for f in frames:
                    total.add(len(f))
                    yield f

            yield from inner(seen())

        return run

    monkeypatch.setattr(module, name, patched)
    return total


def test_jaccard_compares_vertices_and_not_copies(spark, monkeypatch, repeated):
    total = _counted(spark, monkeypatch, jaccard, "_compare_blocks")
    out = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(repeated).collect())
    assert out[7, 7, COPIES] == COPIES and out[8, 7, COPIES] == 1 and out[9, 9, 0] == 1 and len(out) == 53
    assert 2 <= total.value < 30
    kept = [r.doc_id for r in jaccard.deduplicate(repeated).collect()]
    assert sorted(kept) == [7, 9, *range(100, 150)]


def test_substrings_cut_out_of_one_copy(spark, monkeypatch, repeated):
    total = _counted(spark, monkeypatch, substrings, "_search")
    out = {}
    for r in substrings.remove_repeated(repeated).collect():
        assert out.setdefault(r.doc_id, (r.n_words, r.n_removed)) == (r.n_words, r.n_removed)
    # all words of the copies and of the near copy but its last; of the third text the 50 shared ones
    assert out[7] == (80, 80) and out[8] == (80, 79) and out[9] == (110, 50)
    assert all(out[i][1] == 0 for i in range(100, 150))
    assert 1 <= total.value < 500


def test_mixing_spreads_the_copies_of_a_row(spark, repeated):
    slices = mixing.sizes(repeated).groupBy("source", "slice").count().agg(F.max("count"), F.sum("count")).first()
    assert slices[0] < 12 and slices[1] == COPIES + 52
    mixed = mixing.mix(repeated)
    rows = mixed.collect()
    assert len(rows) == COPIES + 52 and all(0 <= r.taken <= 2 * r.size for r in rows)
    by_source = collections.defaultdict(int)
    for r in rows:
        by_source[r.source_size, r.target] += r.taken
    for (size, target), taken in by_source.items():
        assert abs(taken - target) <= 200, (size, target, taken)
    again = collections.Counter(map(str, mixing.mix(repeated.repartition(3)).collect()))
    assert again == collections.Counter(map(str, rows))


def test_sampled_passes_over_copies_add_up(spark, repeated, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES_AT_ONCE", 100)
    passes = collections.Counter()
    for r in mixing.mix(repeated).collect():
        passes[r.doc_id] += -(-r.taken // r.size) if r.size else 0
    out = mixing.sample_documents(repeated.withColumn("__extra", F.lit(5)))
    assert out.columns == [*repeated.columns, "__extra"]
    got = collections.Counter(r.doc_id for r in out.collect())
    assert got == +passes
    assert out.where("doc_id = 7").select("text", "lang", "source", "n_chars").distinct().count() == 1


def test_copies_are_dealt_over_tasks(spark):
    d = spark.range(3).select(F.col("id").alias("k"), F.when(F.col("id") == 1, 100_000).otherwise(1).alias("n"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = mixing._copies(d, F.col("n"), "i")
        assert out.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("m"), F.count_distinct("i").alias("d")).orderBy("k").collect() == [
            (0, 1, 0, 1), (1, 100_000, 99_999, 100_000), (2, 1, 0, 1)]
        per_task = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert per_task <= 30_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_both_stars_let_a_hub_be_split(spark, split_conf):  # noqa: F811
    hub = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    edges = spark.range(1, 60_000).repartition(8)
    for large, frame in ((True, edges.select((F.col("id") + 100_000).alias("a"), hub.alias("b"))),
                         (False, edges.select((hub + 100_000).alias("a"), F.col("id").alias("b")))):
        step = components._star(frame.where("a > b"), large)
        step.collect()
        assert any("skew=true" in j for j in _final_joins(step)), large


def test_components_of_a_hub_and_a_path(spark):
    edges = [(i, 0) for i in range(1, 400)] + [(1000 + i + 1, 1000 + i) for i in range(200)] + [(5, 1000)]
    out = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()
    assert {r.root for r in out} == {0} and len(out) == 399 + 201
