"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its word 5-grams (a document of one to four words is the one
n-gram it consists of). Two documents are linked if the Jaccard similarity of their sets
is at least the threshold.

1. Each distinct text (by its MD5) becomes one vertex with 96 MinHash values.
2. Vertices that agree in one of 24 bands of 4 values are candidates. A pair of similarity
   0.8 is missed with probability (1 - 0.8^4)^24 = 3e-6, one of 0.9 with 8e-12.
3. No pair is ever a row of a table. A band's bucket is known by its least vertex, its
   leader; a leader's group are all vertices it leads in some band, and groups are split
   into blocks of bounded size. A task compares two blocks of one group with numpy.
4. Values are compared 32 at a time. With a uniform prior, m agreements of n give a
   Beta(m + 1, n - m + 1) posterior; a pair is dropped once the posterior probability of
   reaching the threshold is below ``TOLERANCE``.
5. The rest is verified exactly on the 5-gram sets (64-bit hashes). A pair that several
   groups hold counts only in the group of the first band in which it agrees.
6. Links are counted per vertex, weighted with the number of copies; classes are the
   connected components of the links.

Defined results: texts that are null or have no word link to nothing and form a class of
their own; rows with the same text are copies of each other (similarity 1), repeated rows
included; ties don't arise; an empty table gives an empty result; a null id is allowed (the
class id is the least id that is not null); extra columns are not carried by ``classes`` and
kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apflow.llm.components import connected_components
from apflow.llm.words import DocumentWords, WordHasher, by_bytes, mix, shingle_hashes, whole_groups
from apflow.operators.joins import materialize

WORDS = 5
THRESHOLD = 0.8
BANDS, PER_BAND = 24, 4
HASHES = BANDS * PER_BAND
ROUND = 32
TOLERANCE = 1e-7
BLOCK_DOCS, BLOCK_WORDS = 1024, 1_000_000  # of one block of a group


def text_key(text: Column) -> Column:
    """16 bytes that identify a text; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


class Shingler:
    """Texts -> shingle hashes and MinHash signatures."""

    def __init__(self) -> None:
        self.hasher = WordHasher()
        seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
        self.mul = (seeds[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.add = (seeds[HASHES:] >> np.uint64(32)).astype(np.uint32)

    def shingles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of all n-grams in order, where those of each text begin and end, words per text)."""
        d = DocumentWords(self.hasher, texts)
        counts = d.counts()
        sizes = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
        bounds = np.append(0, np.cumsum(sizes))
        out = np.zeros(bounds[-1], dtype=np.uint64)
        all_grams = shingle_hashes(d.hash, WORDS)
        of = np.repeat(np.arange(len(texts)), np.where(counts >= WORDS, sizes, 0))
        at = np.arange(len(of)) - np.repeat(np.cumsum(np.where(counts >= WORDS, sizes, 0)) - np.where(counts >= WORDS, sizes, 0), np.where(counts >= WORDS, sizes, 0))
        if len(of):
            out[bounds[of] + at] = all_grams[d.at[of] + at]
        for i in np.flatnonzero((counts > 0) & (counts < WORDS)):
            own = d.hash[d.at[i] : d.at[i + 1]]
            out[bounds[i]] = shingle_hashes(own, len(own))[0] ^ np.uint64(len(own))
        return out, bounds, counts

    def signatures(self, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """MinHash values, texts x HASHES; all ones for a text without n-grams."""
        n = len(bounds) - 1
        out = np.full((n, HASHES), np.iinfo(np.uint32).max, dtype=np.uint32)
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            low = (grams >> np.uint64(32)).astype(np.uint32)
            for k in range(HASHES):
                out[full, k] = np.minimum.reduceat(low * self.mul[k] + self.add[k], bounds[full])
        return out


def least_agreements(n: int, threshold: float, tolerance: float) -> int:
    """The least m of n agreements whose posterior probability of similarity >= threshold is ``tolerance`` or more."""
    s = (np.arange(200_000) + 0.5) / 200_000
    for m in range(n + 1):
        log_beta = lgamma(m + 1) + lgamma(n - m + 1) - lgamma(n + 2)
        density = np.exp(m * np.log(s) + (n - m) * np.log1p(-s) - log_beta)
        if density[s >= threshold].mean() * (s >= threshold).mean() >= tolerance:
            return m
    return n


def candidate_pairs(a: np.ndarray, b: np.ndarray, same: bool, needs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of signatures ``a`` and ``b`` that are left after all rounds; needs[n]: agreements asked for among n."""
    left, right = [], []
    need = needs[ROUND]
    for at in range(0, len(a), 64):  # a strip of all pairs at a time
        part = a[at : at + 64]
        agree = np.zeros((len(part), len(b)), dtype=np.int16)
        for k in range(ROUND):
            agree += part[:, k, None] == b[None, :, k]
        i, j = np.nonzero(agree >= need)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        left.append(i)
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    for n in range(2 * ROUND, HASHES + 1, ROUND):
        keep = []
        for at in range(0, len(i), 1 << 17):
            p, q = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            keep.append((a[p, :n] == b[q, :n]).sum(axis=1) >= needs[n])
        kept = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
        i, j = i[kept], j[kept]
    return i, j


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact size of the intersection of ``sets[i]`` and ``sets[j]`` (sorted, distinct) for each pair."""
    if len(i) <= 64:
        return np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(i, j, strict=True)], dtype=np.int64)
    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    p, q = place[: len(i)], place[len(i) :]
    flat = np.concatenate([sets[u] for u in used])
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    df = np.diff(np.append(starts, len(flat)))
    out = np.zeros(len(i), dtype=np.int64)
    common = np.flatnonzero(df >= 24)  # n-grams of many rows: a dense product, some columns at a time
    column = np.repeat(np.arange(len(starts)), df)
    for at in range(0, len(common), 1024):
        cols = common[at : at + 1024]
        table = np.zeros((len(used), len(cols)), dtype=np.float32)
        entry = np.concatenate([np.arange(starts[c], starts[c] + df[c]) for c in cols])
        table[row[entry], np.searchsorted(cols, column[entry])] = 1
        dots = table @ table.T
        out += dots[p, q].astype(np.int64)
    rare = np.flatnonzero((df >= 2) & (df < 24))
    pair_key = p.astype(np.int64) * len(used) + q
    sorter = np.argsort(pair_key)
    keys = pair_key[sorter]
    for width in np.unique(df[rare]):  # n-grams of few rows: their pairs, by the number of rows
        rows_of = row[starts[rare[df[rare] == width]][:, None] + np.arange(width)]
        x, y = np.triu_indices(width, 1)
        for at in range(0, len(rows_of), max(1, (1 << 20) // len(x))):
            part = rows_of[at : at + max(1, (1 << 20) // len(x))]
            u, v = part[:, x].ravel().astype(np.int64), part[:, y].ravel().astype(np.int64)
            for key in (u * len(used) + v, v * len(used) + u):
                found = np.searchsorted(keys, key)
                ok = found < len(keys)
                ok[ok] = keys[found[ok]] == key[ok]
                np.add.at(out, sorter[found[ok]], 1)
    return out


def _least_of_group(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For rows 0 to n - 1: the least row connected to each by the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        m = np.minimum(root[i], root[j])
        np.minimum.at(root, i, m)
        np.minimum.at(root, j, m)
        root = root[root]
        if (root == before).all():
            return root


def signature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, sig) of every document; key and sig are null if the text has no word."""
    import pyarrow as pa

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in by_bytes(texts):
                grams, bounds, counts = shingler.shingles(texts[part])
                sig = shingler.signatures(grams, bounds)
                piece = batch.slice(part.start, part.stop - part.start)
                keys = [k if n else None for k, n in zip(piece.column("key").to_pylist(), counts, strict=True)]
                sigs = [s.tobytes() if n else None for s, n in zip(sig, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary())],
                    names=["doc_id", "key", "n_words", "sig"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key(F.col("text")).alias("key"), "text").mapInArrow(
        run, f"doc_id {id_type}, key binary, n_words bigint, sig binary")


def _compare_blocks(threshold: float, tolerance: float):
    share = Fraction(threshold).limit_denominator(10_000)
    needs = {n: least_agreements(n, threshold, tolerance) for n in range(ROUND, HASHES + 1, ROUND)}

    def compare(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for frame in whole_groups(frames, ["leader", "lo", "hi"]):
            keys = frame[["leader", "lo", "hi"]].to_numpy()
            heads = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            for lo, hi in zip(heads, np.append(heads[1:], len(frame)), strict=True):
                if hi - lo > 1:
                    out = block(shingler, frame.iloc[lo:hi].drop_duplicates("vid"))
                    if out is not None:
                        yield out

    def block(shingler: Shingler, rows: pd.DataFrame) -> pd.DataFrame | None:
        rows = rows.sort_values("vid")
        grams, sizes, sigs = [], [], []
        texts = rows["text"].tolist()
        for part in by_bytes(texts):
            g, bounds, _ = shingler.shingles(texts[part])
            sigs.append(shingler.signatures(g, bounds))
            grams += [np.unique(g[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        sig = np.concatenate(sigs)
        blk, first, second = rows["blk"].to_numpy(), rows["lo"].iloc[0], rows["hi"].iloc[0]
        left, right = np.flatnonzero(blk == first), np.flatnonzero(blk == second)
        i, j = candidate_pairs(sig[left], sig[right], first == second, needs)
        i, j = left[i], right[j]
        leaders = np.array(rows["leaders"].tolist(), dtype=np.int64)
        own = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), 1 << 17):  # the pair belongs to the group of the first band it agrees in
            p, q = leaders[i[at : at + (1 << 17)]], leaders[j[at : at + (1 << 17)]]
            agree = (p == q) & (p >= 0)
            band = agree.argmax(axis=1)
            own[at : at + (1 << 17)] = agree.any(axis=1) & (p[np.arange(len(p)), band] == rows["leader"].iloc[0])
        i, j = i[own], j[own]
        if not len(i):
            return None
        sizes = np.array([len(g) for g in grams], dtype=np.int64)
        both = overlaps(grams, i, j)
        # overlap / (size + size - overlap) >= share, in integers
        ok = both * (share.numerator + share.denominator) >= share.numerator * (sizes[i] + sizes[j])
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        copies, vid = rows["copies"].to_numpy(), rows["vid"].to_numpy()
        links = np.zeros(len(rows), dtype=np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root = _least_of_group(len(rows), i, j)
        at = np.flatnonzero(links)
        return pd.DataFrame({"vid": vid[at], "links": links[at], "parent": vid[root[at]]})

    return compare


def _classes(docs: DataFrame, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(one row per document with its key, one row per vertex with its class)."""
    signed = materialize(signature_table(docs))
    vertices = materialize(
        signed.where(F.col("key").isNotNull()).groupBy("key").agg(
            F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.first("n_words").alias("n_words"),
            F.first("sig").alias("sig"),
        ).withColumn("vid", F.monotonically_increasing_id())
    )
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.xxhash64(b, F.substring("sig", b * (4 * PER_BAND) + 1, F.lit(4 * PER_BAND))),
    )
    banded = vertices.select("vid", F.posexplode(bands).alias("band", "value"))
    # written, so that the join has a plain exchange on either side and a hot bucket can be split
    buckets = materialize(
        banded.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("vid").alias("leader")).where("n > 1").drop("n"))
    led = banded.join(buckets, ["band", "value"]).groupBy("vid").agg(
        F.map_from_entries(F.collect_list(F.struct("band", "leader"))).alias("by_band")  # BANDS entries at most
    )
    led = materialize(led.select("vid", F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.coalesce(F.try_element_at("by_band", b), F.lit(-1))).alias("leaders")))
    grouped = led.join(vertices.select("vid", "n_words"), "vid").select(
        "vid", "n_words", F.explode(F.array_distinct(F.filter("leaders", lambda x: x >= 0))).alias("leader"))
    blocks = materialize(grouped.groupBy("leader").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_words") / BLOCK_WORDS)).cast("int").alias("blocks")))
    members = grouped.drop("n_words").join(blocks, "leader").withColumn(
        "blk", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    # each block meets every block of its group, itself included, in one task
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "vid", "leader", "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))
    texts = docs.select("doc_id", "text").withColumn("key", text_key(F.col("text")))
    shown = led.join(vertices.drop("sig", "n_words"), "vid").withColumnRenamed("first_id", "doc")
    shown = shown.join(texts, (shown["key"] == texts["key"]) & shown["doc"].eqNullSafe(texts["doc_id"])).select(
        "vid", "leaders", "copies", "text")
    shown = shown.dropDuplicates(["vid"])  # of a repeated row, which is met once a copy, one goes on to the comparison
    compared = (
        met.join(shown, "vid")
        .repartition("leader", "lo", "hi").sortWithinPartitions("leader", "lo", "hi")
        .mapInPandas(_compare_blocks(threshold, tolerance), "vid bigint, links bigint, parent bigint")
    )
    linked = materialize(compared)
    links = linked.groupBy("vid").agg(F.sum("links").alias("links"))
    roots = connected_components(linked.select(F.col("vid").alias("a"), F.col("parent").alias("b")))
    placed = (
        vertices.drop("sig", "n_words").join(roots, vertices["vid"] == roots["vertex"], "left").drop("vertex")
        .withColumn("root", F.coalesce("root", "vid")).join(links, "vid", "left")
    )
    placed = materialize(placed)
    class_ids = placed.groupBy("root").agg(F.min("first_id").alias("class_id"), F.min(F.struct("first_id", "vid")).alias("best"))
    placed = placed.join(materialize(class_ids), "root").select(
        "key", "first_id", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        (F.col("best.vid") == F.col("vid")).alias("representative"))
    return signed.select("doc_id", "key"), placed


def classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_links) of every row: the least id of its class, and how many other rows are linked to it."""
    signed, placed = _classes(docs, threshold, tolerance)
    return signed.join(placed.drop("first_id", "representative"), "key", "left").select(
        "doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row of each class, the one with the least id; rows without a word all stay. Same columns as ``docs``."""
    _, placed = _classes(docs, threshold, tolerance)
    keep = placed.where("representative").select(F.col("key").alias("__llm_k"), F.col("first_id").alias("__llm_first"))
    keyed = docs.withColumn("__llm_key", text_key(F.col("text")))
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = keyed.where(~wordless).join(
        keep, (F.col("__llm_key") == F.col("__llm_k")) & F.col("doc_id").eqNullSafe(F.col("__llm_first"))
    ).dropDuplicates(["__llm_k", "__llm_first"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return one.select(*columns).unionByName(docs.where(wordless).select(*columns))
