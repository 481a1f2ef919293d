"""The whole pipeline against a brute-force version of its chain, as a full set of rows."""

import collections
import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from apflow.llm import mixing, secret_scan
from tests.llm.test_text_operators import PATH, PATTERNS, WORDS, brute_classes, fill

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")


def planted(spark, folder):
    """sf0.001 with rejected texts, near copies, a live secret and an example."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, r = [tuple(x) for x in d.orderBy("doc_id").collect()], random.Random(4)
    greek = " ".join("".join(chr(r.randrange(0x3B1, 0x3C9)) for _ in range(r.randrange(2, 9))) for _ in range(80))
    texts = ["12 34", greek]
    for i in (3, 17, 40):
        w = rows[i][1].split(" ")
        texts.append(" ".join([*w[:-1], "changed"]))
    for i in (5, 6, 7, 8):
        own = rows[i][1].split()
        r.shuffle(own)  # no near copy of its original
        texts.append(f"{' '.join(own)} password=example123 {'Zx9' * 8 if i == 5 else ''} apikey: own{i}secret")
    rows += [(10**6 + k, t, None if t == greek else "en", f"src{k % 4}", len(t)) for k, t in enumerate(texts)]
    rows.append((10**6 + 50, texts[-1], "en", "src9", len(texts[-1])))
    spark.createDataFrame(rows, d.schema).write.parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def trigrams(text):
    s = "".join(c if c.isalpha() else " " for c in f" {text} ".lower())
    s = re.sub(" +", " ", s)
    return collections.Counter(s[i:i + 3] for i in range(len(s) - 2))


def cosine(a, b):
    return sum(n * b[g] for g, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def identified(rows):
    sums = collections.defaultdict(collections.Counter)
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            sums[r.lang].update(trigrams(r.text))
    same = {lang: sum(n * n for n in c.values()) / sum(c.values()) ** 2 for lang, c in sums.items()}
    kept = []
    for r in rows:
        letters, own = sum(c.isalpha() for c in r.text), trigrams(r.text)
        if not letters:
            continue
        best, lang = max((cosine(own, c), lang) for lang, c in sums.items())
        x = sum(own.values()) * same[lang]
        bound = 0.18 * math.sqrt(x / (1 + x)) - 0.5 / math.sqrt(512)
        assert abs(best - bound) > 0.05 or letters < 20, (r.doc_id, best, bound)  # far enough from it for exact cosines
        if best >= bound:
            kept.append(r)
    return kept


def spans(text):
    """(start, end, hash) of the candidates that count."""
    out = [(m.start(), m.end(), m[2] if k == 0 else m[0]) for k, (p, ok) in enumerate(PATTERNS) for m in p.finditer(text) if ok(m)]
    for m in TOKEN.finditer(text):
        mixed = all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))
        if mixed and not any(a < m.end() and m.start() < b for a, b, _ in out):
            out.append((m.start(), m.end(), m[0]))
    return sorted(out)


def masked(rows):
    least = {}  # the least owner of each (value, text)
    for r in rows:
        for _, _, value in spans(r.text):
            owner = (r.source or "").split("/")[0]
            least[value, r.text] = min(least.get((value, r.text), owner), owner)
    owners = collections.defaultdict(set)
    for (value, _), owner in least.items():
        owners[value].add(owner)
    out = {}
    for r in rows:
        at, text = 0, ""
        for a, b, value in spans(r.text):
            if len(owners[value]) < 3:
                if a >= at:
                    text += r.text[at:a] + secret_scan.MASK
                at = max(at, b)
        out[r.doc_id] = text + r.text[at:]
    return out


def passes(spark, texts, source):
    size = {i: len(WORDS.findall(t)) for i, t in texts.items()}
    hashes = spark.createDataFrame(list(size.items()), "doc_id long, size long").select(
        "doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), "doc_id", "size"), 1).alias("h"))
    place = {r.doc_id: r.h for r in hashes.collect()}
    total = collections.Counter()
    for i, n in size.items():
        total[source[i]] += n
    names = sorted(total)
    target = fill(total, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(total.values()))
    entries, upto = [], collections.Counter()
    for i in sorted(size, key=lambda i: place[i]):
        upto[source[i]] += size[i]
        entries += [((upto[source[i]] + p * total[source[i]]) / target[source[i]], source[i], place[i], p, i) for p in (0, 1)]
    left, taken = round(sum(target.values())), collections.Counter()
    for *_, i in sorted(entries):
        n = min(size[i], left)
        left -= n
        taken[i] += n
    return {i: -(-n // size[i]) for i, n in taken.items() if n}


def test_pipeline_run_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = planted(spark, str(tmp_path)).orderBy("doc_id").collect()
    kept = identified(docs)
    assert {r.doc_id for r in docs} - {r.doc_id for r in kept} == {10**6, 10**6 + 1}
    single = {c for _, c, _ in brute_classes(kept)}
    kept = [r for r in kept if r.doc_id in single]
    assert not single & {10**6 + 2, 10**6 + 3, 10**6 + 4, 10**6 + 50}  # copies and near copies
    texts = masked(kept)
    assert any(secret_scan.MASK in t for t in texts.values()) and "example123" in texts[10**6 + 5]
    library = Tokenizer.from_file(PATH)
    source, expected = {r.doc_id: r.source for r in kept}, []
    for i, times in passes(spark, texts, source).items():
        ids = library.encode(texts[i], add_special_tokens=False).ids
        expected += [(i, source[i], len(ids), hashlib.md5(str(ids).encode()).hexdigest())] * times
    got = [(r.doc_id, r.source, r.n_tokens, hashlib.md5(str(list(r.ids)).encode()).hexdigest()) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expected)
