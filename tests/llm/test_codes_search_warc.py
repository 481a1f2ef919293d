"""Brute-force checks and edge cases of the vector codes, the lexical search and the WARC archives."""

import gzip
import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from apflow.llm import cover_lloyd, lexical, warc
from apflow.operators.joins import fresh_folder, materialize

VECTORS = "vec_id long, embedding array<double>, label int"


# ------------------------------------------------------------------ op11
def lloyd(rows, parts=4, entries=256, rounds=4):
    """Plain Lloyd in Python integers over rows (id, vector of ints)."""
    dims = len(rows[0][1])
    cut = [(dims * i // parts, dims * (i + 1) // parts) for i in range(parts)]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][a:b] for r in order] for a, b in cut]

    def best(x, book):
        d = [sum((u - v) ** 2 for u, v in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            groups = {}
            for r in rows:
                groups.setdefault(best(r[1][a:b], books[p])[0], []).append(r[1][a:b])
            books[p] = [[sum(c) // len(g) for c in zip(*g)] if (g := groups.get(e)) else old for e, old in enumerate(books[p])]
    out = []
    for i, x in rows:
        found = [best(x[a:b], books[p]) for p, (a, b) in enumerate(cut)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
    text = ",".join(str(v) for book in books for e in book for v in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


def integers(v, scale=1024):
    return [math.floor(scale * x) for x in v]


def test_codes_against_plain_lloyd(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 10))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.02 * r.normal(size=10)], i % 3 if i % 7 else None) for i in range(400)]
    rows += [(500 + i, rows[5][1], 9) for i in range(150)]  # copies
    rows += [rows[0], rows[0], (None, rows[1][1], 1)]
    bad = [(901, None, 1), (902, [math.nan] * 10, 1), (903, [1.0, None] * 5, 1), (904, [math.inf] * 10, 1)]
    d = spark.createDataFrame(rows + bad, VECTORS).withColumn("error", F.lit("clash")).repartition(5)
    coded, quantizer = cover_lloyd.compress(d, entries=32)
    expected, digest = lloyd([(i, integers(v)) for i, v, _ in rows], entries=32)
    got = coded.collect()
    key = lambda t: tuple((x is None, x or 0 if not isinstance(x, str) else x) for x in t)
    assert sorted(((g.vec_id, g.code, g.error) for g in got), key=key) == sorted(expected, key=key)
    assert quantizer.digest(10) == digest
    for label in (0, 1, 2, 9, None):
        own = [g for g in got if g.label == label]
        assert {g.label_error for g in own} == {sum(g.error for g in own)}


def test_codes_of_wide_uneven_and_few_vectors(spark):
    rows = [(i, [1e9 * i, -1e9, 0.5, i / 3, 7e8], 1) for i in range(9)]  # too wide for exact doubles
    rows += [(20 + i, [float(i)], 2) for i in range(5)] + [(30, [], 3), (31, [], 3)]
    coded, quantizer = cover_lloyd.compress(spark.createDataFrame(rows, VECTORS), entries=4)
    got = {r.vec_id: (r.code, r.error) for r in coded.collect()}
    for length in (5, 1):
        expected, digest = lloyd([(i, integers(v)) for i, v, _ in rows if len(v) == length], entries=4)
        assert {i: got[i] for i, _, _ in expected} == {i: (c, min(e, (1 << 63) - 1)) for i, c, e in expected}
        assert quantizer.digest(length) == digest
    assert got[30] == ("00000000", 0)
    empty, quantizer = cover_lloyd.compress(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and quantizer.codebooks == {}
    assert cover_lloyd.compress(spark.createDataFrame([(1, None, 1)], VECTORS))[0].count() == 0


def test_cover_tree_holds_its_invariants_and_assigns_whole_subtrees():
    r = np.random.default_rng(5)
    x = np.floor(1024 * (np.repeat(r.normal(size=(20, 6)), 100, axis=0) + 0.01 * r.normal(size=(2000, 6))))
    tree = cover_lloyd.cover_tree(x)
    assert sorted(tree.order.tolist()) == list(range(2000))
    for i in range(len(tree.point)):
        own = tree.order[tree.lo[i] : tree.hi[i]]
        assert tree.point[i] in own
        assert np.sqrt(((x[own] - x[tree.point[i]]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-6
        below = range(tree.child[i], tree.child[i] + tree.children[i])
        if tree.children[i]:
            assert [tree.lo[c] for c in below] == [tree.lo[i], *[tree.hi[c] for c in below][:-1]]
            apart = x[tree.point[list(below)]]
            d = np.sqrt(((apart[:, None] - apart[None]) ** 2).sum(axis=2))[np.triu_indices(len(apart), 1)]
            assert (d > tree.radius[i] / cover_lloyd.BASE * 0.999999).all()
    entries = x[::100].copy()
    lo, hi, entry, places, single = cover_lloyd.nearest(tree, x, entries)
    assert (hi - lo).sum() + len(places) == 2000 and (hi - lo).sum() > 1500 and len(lo) < 400  # most go as subtrees
    code, errors = cover_lloyd.part_codes(tree, x, entries)
    exact = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (code == exact.argmin(axis=1)).all() and errors == exact.min(axis=1).astype(int).tolist()


# ------------------------------------------------------------------ op12
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k):
    held = [(i, terms(t)) for i, t in docs]
    full = [(i, t) for i, t in held if t]
    n_docs, n_terms = len(full), sum(len(t) for _, t in full)
    df = {}
    for _, t in full:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in set(items):
        scores = []
        for i, t in full:
            m = 75 + (25 * len(t) * n_docs) // n_terms
            s = 0
            for w in terms(text):
                if tf := t.count(w):
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf) // (1000 * tf + 12 * m))
            if s:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return out


def by_item(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 3000}"  # noqa: E731  a few words are everywhere
    docs = [(i, " ".join(word() for _ in range(r.randrange(1, 120)))) for i in range(900)]
    docs += [(2000 + i, docs[3][1]) for i in range(40)]  # ties
    docs += [(0, docs[0][1]), (0, docs[0][1]), (None, docs[0][1]), (5000, None), (5001, ""), (5002, "  ., \n!"),
             (5003, "Été ÉTÉ漢字 Straße,W1_w1-W1"), (5004, " ".join(word() for _ in range(30_000)))]
    items = [(i, docs[7 * i][1]) for i in range(30)]
    items += [(100, None), (101, ""), (102, "nowhere found"), (103, "été ÉTÉ漢字 straße w1 w1 W1"), (104, "w1"), items[0], items[0],
              (0, "w1 w2"), (None, "w2 w3"), (105, " ".join(f"w{i}" for i in range(3000)))]
    return docs, items


@pytest.mark.parametrize("shard_chars,block_terms", [(1 << 23, 1 << 18), (3000, 200)])
def test_search_against_all_scores(spark, corpus, shard_chars, block_terms):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    index = lexical.build_index(d, shard_chars=shard_chars)
    got = lexical.search(index, q, k=7, query_terms_a_block=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert by_item(tuple(r) for r in got.collect()) == by_item(ranked(docs, items, 7))


def test_search_of_empty_tables(spark, corpus):
    docs, items = corpus
    none = spark.createDataFrame([], "doc_id long, text string")
    blank = spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    for d in (none, blank):
        assert lexical.search(lexical.build_index(d), q).count() == 0
    full = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    assert lexical.search(full, q.limit(0)).count() == 0
    assert lexical.search(full, q.where("item_id in (100, 101, 102)")).count() == 0


def test_shard_packs_wide_numbers_and_skips_blocks():
    texts = ["common " * (1 + i % 3) + ("rare " * 5 if i == 41_000 else "") for i in range(70_000)] + ["common " * 70_000]
    words = lexical.DocumentWords(lexical.TermHasher(), texts)
    total = len(words.hash)
    shard = lexical.Shard.unpacked(lexical.Shard.build(words, len(texts), total).packed())
    m = lexical.length_part(shard.lengths, len(texts), total)
    common, rare = (lexical.TermHasher()(w.encode())[0][0] for w in ("common", "rare"))
    at = {int(t): i for i, t in enumerate(shard.terms)}
    docs, tf = shard.postings(np.arange(shard.block_at[at[int(common)]], shard.block_at[at[int(common)] + 1]))
    assert docs.tolist() == list(range(70_001)) and tf[-1] == 70_000 and tf[:3].tolist() == [1, 2, 3]
    rest = [20_000 * 10**6, 10 * 10**6, 0]
    query = lexical.Query(np.array([rare, common], dtype=np.uint64), np.array([20_000, 10]), np.array([rest[0] + rest[1], rest[1], 0]))
    seen = [0, 0]
    found, scores = lexical.search_shard(shard, m, query, 1, 0, seen)
    assert found.tolist() == [41_000]
    assert seen[0] == 2 and seen[1] > 500  # the block of the rare term, and one of 547 of the common one


# ------------------------------------------------------------------ op13
PAGES = "page_id long, url string, html string"


def pages_brute(rows, least=100):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(b) if len(b) >= least else None
        again = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return by_item(out)


@pytest.fixture(scope="module")
def page_rows():
    r = random.Random(8)
    rows = [(i, f"http://h{i}.example/", "<html>" + "".join(chr(r.choice((65, 233, 0x6F22, 0x1F600, 10, 13, 0))) for _ in range(r.randrange(600)))) for i in range(120)]
    rows += [(1000 + i, None, rows[5][2] + "x" * 200) for i in range(300)]  # a hot payload
    rows += [(900, "http://first.example/\r\nInjected: yes", rows[5][2] + "x" * 200), (2000, "u", None), (2001, "u", ""), (2002, "", "short"),
             (2003, "u", "short"), rows[0], rows[0], (None, "u", rows[5][2] + "x" * 200), (None, "u", "y" * 100),
             (3000, "u", "é" * 50), (3001, "u", "é" * 50), (3002, "u", "é" * 49), (3003, "u", "é" * 49), (-7, "u", "WARC/1.0\r\nWARC-Type: response\r\n\r\n" * 9),
             (4000, "u", "z" * (17 << 20))]  # its length field does not end in a zero byte
    return rows


@pytest.fixture(scope="module")
def archives(spark, page_rows):
    path = fresh_folder(spark)
    d = spark.createDataFrame(page_rows, PAGES).withColumn("digest", F.lit("clash")).withColumn("body", F.lit(1)).repartition(3)
    warc.write_archives(d, path)
    return path


def files_of(path):
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-"))


def test_archives_round_trip(spark, page_rows, archives):
    found = materialize(warc.read_archives(spark, archives))
    assert found.where("kind = 'gap'").count() == 0
    assert by_item(tuple(r) for r in warc.resolved(found).collect()) == pages_brute(page_rows)
    texts = {r.page_id: r.payload.decode() for r in found.where("record_type = 'response' and page_id is not null").collect()}
    for i, _, h in page_rows:
        if i in texts:
            assert texts[i] == (h or "")
    assert found.where("uri like '%\r%' or uri like '%\n%'").count() == 0


def test_archives_are_plain_concatenated_gzip_members(archives):
    whole = b"".join(gzip.open(f).read() for f in files_of(archives))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") >= 400
    for f in files_of(archives):  # a member a record
        data = open(f, "rb").read()
        records = [x for x in warc.salvage(data)]
        assert len({r.start for r in records}) == len(records) and records[0].start == 0


def test_no_pages(spark):
    path = fresh_folder(spark)
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.resolved(warc.read_archives(spark, path)).count() == 0


def plain(n, size=200):
    out = []
    for i in range(n):
        body = f"<p>{i}</p>".encode() * size
        out.append(warc.page_record(i, f"http://e/{i}", body, hashlib.sha256(body).hexdigest(), None, False))
    return out


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_gets_past_damage(packed):
    records = [warc.member(r) if packed else r for r in plain(40)]
    at = np.append(0, np.cumsum([len(r) for r in records])).tolist()
    whole = b"".join(records)
    r = random.Random(1)
    for trial in range(60):
        hurt = sorted(r.sample(range(40), 5))
        data = bytearray(whole)
        for i in hurt:  # of a plain record only the block has a digest
            start = at[i] + 12 if packed else whole.index(b"\r\n\r\n", at[i]) + 4
            data[r.randrange(start, at[i + 1] - 4)] ^= 1 << r.randrange(8)
        found = list(warc.salvage(bytes(data)))
        ids = [int(x.fields["x-page-id"]) for x in found if isinstance(x, warc.Record)]
        gaps = [x for x in found if isinstance(x, warc.Gap)]
        lost = sorted(set(range(40)) - set(ids))
        assert set(lost) <= set(hurt) and ids == sorted(ids)
        for g in gaps:
            assert g.start in at and g.end in at and g.reason
        assert sorted(i for g in gaps for i in range(at.index(g.start), at.index(g.end))) == lost == hurt


def test_salvage_of_truncated_inserted_and_foreign_bytes():
    records = plain(6)
    members = [warc.member(r) for r in records]
    noise = bytes(random.Random(2).randrange(256) for _ in range(5000)).replace(b"\x1f\x8b\x08", b"")
    data = members[0] + noise + members[1] + records[2] + b"\r\n\r\n" + members[3][:40] + members[4] + members[5][:-30]
    found = list(warc.salvage(data))
    assert [int(x.fields["x-page-id"]) for x in found if isinstance(x, warc.Record)] == [0, 1, 2, 4]
    gaps = [(g.start, g.end) for g in found if isinstance(g, warc.Gap)]
    a, b = len(members[0]), len(members[0]) + len(noise)
    c = b + len(members[1]) + len(records[2]) + 4
    d = c + 40 + len(members[4])
    assert gaps == [(a, b), (c, c + 40), (d, len(data))]
    assert [x.reason for x in warc.salvage(noise)] == ["no version line"] and list(warc.salvage(b"")) == []
    bad = records[0].replace(b"Content-Length: ", b"Content-Length: 9", 1)  # points beyond the end of the next record
    assert [int(x.fields["x-page-id"]) for x in warc.salvage(bad + records[1]) if isinstance(x, warc.Record)] == [1]
    wrong = hashlib.sha256(b"other").hexdigest()
    (gap,) = warc.salvage(warc.member(warc.page_record(1, "u", b"payload", wrong, None, False)))
    assert gap.reason == "payload digest"


def test_foreign_fields():
    assert [warc._long(x) for x in ("12", "-3", str(2**63 - 1), str(2**63), "9" * 19, "x1", "", None)] == [12, -3, 2**63 - 1, None, None, None, None, None]
    text = b"Block of its own\r\n\r\nnot HTTP"
    (plain_block,) = warc.salvage(warc.record([("WARC-Type", "resource"), ("Content-Type", "text/plain")], text))
    (message,) = warc.salvage(warc.record([("warc-TYPE", "response"), ("content-type", "Application/HTTP")], text))
    assert plain_block.payload == text and message.payload == b"not HTTP"
    folded = b"WARC/1.0\r\nWARC-Type: metadata\r\nX-Note: one\r\n two\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (r,) = warc.salvage(folded)
    assert r.fields["x-note"] == "one two" and r.block == b""


def test_damaged_archive_through_spark(spark, archives, page_rows):
    folder = fresh_folder(spark)
    os.makedirs(folder.removeprefix("file:"))
    hurt = 0
    for n, f in enumerate(files_of(archives)):
        data = bytearray(open(f, "rb").read())
        if n == 0:
            second = [x.start for x in warc.salvage(bytes(data))][1]
            data[second + 15] ^= 255
            hurt = 1
        open(f"{folder.removeprefix('file:')}/{n}.warc.gz", "wb").write(data)
    found = warc.read_archives(spark, folder).collect()
    gaps = [r for r in found if r.kind == "gap"]
    assert len(gaps) == hurt and gaps[0].reason and gaps[0].archive.endswith("0.warc.gz") and gaps[0].end > gaps[0].start
    assert sum(r.kind == "record" for r in found) == len(page_rows) - 1
