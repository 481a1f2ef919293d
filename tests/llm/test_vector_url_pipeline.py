"""Edge cases and brute-force checks of the vector, URL and pipeline operators."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from apflow.llm import ann, queries, topk, url_filter

def every_10th():
    return F.col("vec_id") % 10 == 0

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=20)], 0) for i in range(300)]
    rows += [(400 + i, rows[7][1], 1) for i in range(30)]  # ties
    rows += [rows[0], rows[10], (None, rows[1][1], 0), (500, None, 0), (510, [float("nan")] * 20, 0),
             (520, [1.0, None] * 10, 0), (530, [float("inf")] * 20, 0), (540, [0.0] * 20, 0), (550, [1.0, 2.0], 0), (551, [2.0, 1.0], 0)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))


def usable(df):
    out = {}
    for r in df.collect():
        v = r.embedding
        if r.vec_id is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            out[r.vec_id] = np.array(v, dtype=np.float64)
    return out


def test_exact_topk_against_all_pairs(spark, vectors):
    rows = {i: np.floor(v * 256) for i, v in usable(vectors).items()}
    expected = []
    for q in rows:
        if q % 10 == 0:
            scores = sorted((-int(rows[q] @ rows[c]), c) for c in rows if c != q and len(rows[c]) == len(rows[q]))
            expected += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores[:5])]
    got = sorted(tuple(r) for r in topk.top_k(vectors, every_10th()).collect())
    assert got == sorted(expected)
    assert topk.top_k(vectors.limit(0), every_10th()).count() == 0


def test_blocks_by_bytes_and_how_often_a_candidate_is_sent(spark):
    from apflow.llm.topk import branch_and_bound
    from apflow.llm.vector_blocks import best_per_query

    r = np.random.default_rng(9)
    short, long = r.integers(-99, 99, size=(600, 8)).astype(float), r.integers(-99, 99, size=(40, 80)).astype(float)
    rows = [(8, i, [float(x) for x in v]) for i, v in enumerate(short)] + [(80, 1000 + i, [float(x) for x in v]) for i, v in enumerate(long)]
    d = spark.createDataFrame(rows, "grp long, vec_id long, v array<double>")
    calls, given = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def compare(query_ids, queries, ids, vectors):
        calls.add(1)
        given.add(len(ids))
        return branch_and_bound(query_ids, queries, ids, vectors, 3)

    def run(**sizes):
        before = calls.value, given.value
        out = sorted(map(tuple, best_per_query(d.where("vec_id % 2 = 0"), d, 3, compare, "bigint", **sizes).collect()))
        return out, calls.value - before[0], given.value - before[1]

    whole, n, sent = run()
    assert (n, sent) == (2, 640)  # a block for each length
    expected = []
    for base, m in ((0, short), (1000, long)):
        dots = (m @ m.T).astype(int)
        for q in range(0, len(m), 2):
            best = sorted((-int(dots[q, c]), c) for c in range(len(m)) if c != q)[:3]
            expected += [(base + q, k + 1, base + c, -s) for k, (s, c) in enumerate(best)]
    assert whole == sorted(expected)
    # 300 queries of 64 bytes in 6 blocks of 3,200 bytes, 20 of 640 bytes in 4: that is how often a candidate is sent
    cut, n, sent = run(query_bytes=3200, candidate_bytes=6400)
    assert cut == whole and sent == 6 * 600 + 4 * 40 and n == 6 * 6 + 4 * 4


def test_exact_topk_beyond_exact_doubles(spark):
    rows = [(i, [1e12 + i, float(i)], 0) for i in range(12)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ints = {i: [int(np.floor(x * 256)) for x in v] for i, v, _ in rows}
    got = topk.top_k(d, every_10th(), k=3).collect()
    top = np.iinfo(np.int64)
    for q in (0, 10):
        s = sorted((-min(max(sum(a * b for a, b in zip(ints[q], ints[c])), top.min), top.max), c) for c in ints if c != q)[:3]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(c, -x) for x, c in s]


def cosine_best(rows, q, k=5):
    s = sorted((-float(rows[q] @ rows[c] / np.linalg.norm(rows[q]) / np.linalg.norm(rows[c])), c)
               for c in rows if c != q and len(rows[c]) == len(rows[q]))
    return [(c, -x) for x, c in s[:k]]


def test_ann_recall_scores_and_edges(spark, vectors):
    rows = {i: v for i, v in usable(vectors).items() if v.any()}
    got = {}
    for r in ann.search(vectors, every_10th(), parts=4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hit = total = 0
    for q in (i for i in rows if i % 10 == 0):
        best = cosine_best(rows, q)
        assert len(got.get(q, {})) == len(best)
        hit += len({c for c, _ in best} & {c for c, _ in got.get(q, {}).values()})
        total += len(best)
        for c, s in got.get(q, {}).values():
            assert s == pytest.approx(float(rows[q] @ rows[c] / np.linalg.norm(rows[q]) / np.linalg.norm(rows[c])), abs=1e-12)
    assert hit / total >= 0.9
    assert ann.search(vectors.limit(0), every_10th()).count() == 0


def test_ann_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = usable(spark.read.parquet(f"{sf}/embeddings.parquet"))
    got = {}
    for r in queries.op9_ann(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = [i for i in rows if i % 50 == 0]
    assert sum(len({c for c, _ in cosine_best(rows, q)} & got[q]) for q in asked) / (5 * len(asked)) >= 0.9


def test_ann_recall_outside_the_sample(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = usable(d)
    inside = {r.vec_id for r in d.orderBy(F.xxhash64("vec_id"), "vec_id").limit(500).collect()}
    got = {}
    for r in ann.search(d, F.col("vec_id") % 5 == 0, sample=500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q in (i for i in rows if i % 5 == 0 and i not in inside):
        best = [c for c, _ in cosine_best(rows, q)]
        hit, total = hit + len(got[q] & set(best)), total + len(best)
    print(f"recall {hit / total:.4f} of {total // 5} queries outside of {len(inside)} sampled vectors")
    assert total > 1000 and hit / total >= 0.9


def test_parts_are_balanced():
    r = np.random.default_rng(2)
    x = r.normal(size=(640, 8))
    graph = ann.neighbour_graph(x / np.linalg.norm(x, axis=1, keepdims=True), 6)
    sizes = np.bincount(ann.balanced_parts(graph, 8), minlength=8)
    assert sizes.sum() == 640 and sizes.max() <= np.ceil(1.1 * 80)


# ----------------------------------------------------------------------- URLs
URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/x", "http://www.example.com/en/1", "http://a.www.example.com/en/",
    "http://badexample.com/en/", "http://x.net/es/1?a=b", "http://net/fr/", "http://x.net/frx", "http://shop.com", "http://shop.com/",
    "ftp://x.org/a/b/c.html?q=1&r=2#t", "http://x.com/?u=http://y.net/es/", "x://É.COM/en/", "http://u@x.com:80/a",
]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v, h + p) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_and_verdicts(spark):
    d = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, URLS[4]] * 3)], "page_id long, url string, verdict string")
    out = url_filter.judge(d, queries.URL_RULES).collect()
    assert len(out) == d.count()
    verdicts = {}
    for r in out:
        host, path, verdict, rule = brute_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        assert verdicts.setdefault(r.url, r.verdict) == r.verdict
    assert url_filter.judge(d.limit(0), queries.URL_RULES).count() == 0
    one = d.where("url = 'http://shop.com/' or url = 'http://x.net/frx'")
    assert {r.verdict for r in url_filter.judge(one, queries.URL_RULES).collect()} == {"allow"}


def test_trees_learn_what_the_rules_mean(spark):
    r = random.Random(3)
    rows = [(i, f"http://{r.choice(['a', 'b', 'www.c'])}.{r.choice(['net/es', 'net/de', 'com/es', 'org/es'])}/{r.randrange(999)}") for i in range(600)]
    rules = [("block", "net", "/es/"), ("allow", "com", "/")]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert {x.verdict for x in out if ".net/de" in x.url} == {"block"}  # of what is known, the domain is always blocked


def test_suffix_statistics_count_all_labelled_rows(spark):
    # of 40 domains every other one is blocked throughout, and only the domain tells
    rows = [(40 * k + i, f"http://h{i:02}.org/a/{'z' if k == 30 else 'yx'[i % 2]}{k % 7}") for i in range(40) for k in range(31)]
    rules = [("block", "org", "/a/x"), ("allow", "org", "/a/y")]
    d = spark.createDataFrame(rows, "page_id long, url string")
    out = url_filter.judge(d, rules, sample=60).where("rule is null").collect()
    assert len(out) == 40 and all(r.verdict == ("block" if int(r.host[1:3]) % 2 else "allow") for r in out)


def test_hot_url_or_rare_verdict_does_not_empty_a_class(spark):
    by_hash = spark.range(400).selectExpr("concat('http://a.net/es/', id) url").orderBy(F.xxhash64("url")).collect()
    urls = [by_hash[0].url] * 300 + [r.url for r in by_hash[1:]] + ["http://a.com/1", "http://b.com/2", "http://a.org/1", "http://b.net/de/1"]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rules = [("block", "net", "/es/"), ("allow", "com", "/")]
    # the blocked hot URL would fill a sample of 200 rows alone
    out = {r.url: r for r in url_filter.judge(d, rules, sample=200).collect()}
    assert out["http://b.net/de/1"].block_score is not None and out["http://a.com/1"].verdict == "allow"
    drawn = url_filter.fit_sample(d.selectExpr("url", "cast(url like '%/es/%' as double) label").where("url like '%/es/%' or url like '%.com/%'"), 200, "url").collect()
    assert len({r.url for r in drawn}) == len(drawn) == 102 and sum(r.label for r in drawn) == 100
    assert all(r.weight == 1 for r in drawn if not r.label) and sum(r.weight for r in drawn if r.label) == pytest.approx(400, rel=0.2)


# ------------------------------------------------------------------- pipeline
def test_pipeline_stages_on_odd_documents(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (10**6, "", "en", None, 0), (10**6 + 1, "12 34", "en", "src1", 5), (None, "null id text", "en", None, 12)], d.schema)
    for docs in (d.unionByName(odd).unionByName(d.limit(3)).withColumn("key", F.lit(1)), d.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            path = str(tmp_path / f"{i}-{docs.columns[-1]}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)


def test_pipeline_run_follows_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    d = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert out and all(len(r.ids) == r.n_tokens and r.source == d[r.doc_id].source for r in out)
    # of two copies of a text at most one is left, taken at most twice
    seen = {}
    for r in out:
        seen.setdefault(d[r.doc_id].text, []).append(r.doc_id)
    assert all(len(set(v)) == 1 and len(v) <= 2 for v in seen.values())
