"""Exact substring deduplication with compressed FM-indexes, one per shard.

A window is ``window`` consecutive words of one document; a word is removed if a window that
covers it occurs at more than one place of the corpus.

Shards are cut by content, so that all occurrences of a window meet in one shard without any
document being sent to all of them. Among a window's word n-grams the one of least hash is its
anchor (winnowing): equal windows have equal anchors at the same place. The words of all windows
with one anchor are its neighbourhood; each window is in exactly one, so what a shard counts
for a run of a window's length or more are places of the corpus.

1. Every document's anchors are listed with a hash of their neighbourhood. Anchors that occur
   once in the corpus cannot belong to a repeated window and go.
2. Equal neighbourhoods become one, with its number of occurrences.
3. Neighbourhoods go to shards by their anchor. A shard is a text of words over which an
   FM-index is built (suffix order, Burrows-Wheeler transform, wavelet tree with bit-packed
   levels and rank counts). All neighbourhoods of the shard are streamed through it by backward
   search: the matching statistic of an end is the longest run of words up to it that occurs
   more than once, occurrences counted with their numbers. Runs of at least ``window`` words are reported.
4. The intervals go back to the documents that have the neighbourhood, and their words are removed.

An anchor with very many different neighbourhoods (a frequent passage in ever new
surroundings) would make one shard large. Neighbourhoods of an anchor that has more than
``CROWDED`` are replaced by their single windows, equal ones again collapsed, and sharded by
the window: nothing is dropped and a shard stays bounded.

Defined results: a null text has no words; texts shorter than a window lose nothing; repeated
rows (same id and text) count as occurrences of their own, so a window in a repeated row is
repeated; windows overlapping themselves count; ties of anchor hashes take the leftmost; an
empty table gives an empty result; extra columns are not carried. Equality of words and
neighbourhoods is equality of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apflow.llm.words import DocumentWords, WordHasher, by_bytes, mix, shingle_hashes, whole_groups
from apflow.operators.joins import materialize

WINDOW = 35
GRAM = 6
SHARD_WORDS = 400_000
CROWDED = 2000
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)  # the bits before each place of a word


class Anchors:
    """Texts -> the anchors of all their windows."""

    def __init__(self, window: int, gram: int) -> None:
        self.window, self.gram, self.hasher = window, gram, WordHasher()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """(anchors per text; of each neighbourhood its first word, its words, its anchor's hash and its own), in order."""
        d = DocumentWords(self.hasher, texts)
        counts, span = d.counts(), self.window - self.gram + 1
        owner = np.repeat(np.arange(len(texts)), counts)
        h = shingle_hashes(d.hash, self.gram)
        if len(h) < span:
            return np.zeros(len(texts), np.int64), *(np.zeros(0, np.int64),) * 2, *(np.zeros(0, np.uint64),) * 2
        # the least of every `span` hashes, the leftmost on ties, from minima over growing widths
        best, width = np.arange(len(h)), 1
        while width < span:
            step = min(width, span - width)
            left, right = best[:-step], best[step:]
            best = np.where(h[right] < h[left], right, left)
            width += step
        begins = np.flatnonzero(owner[: len(best)] == owner[self.window - 1 : self.window - 1 + len(best)])  # inside one text
        if not len(begins):
            return np.zeros(len(texts), np.int64), *(np.zeros(0, np.int64),) * 2, *(np.zeros(0, np.uint64),) * 2
        # windows with the same anchor stand side by side
        change = np.flatnonzero(np.append(True, best[begins[1:]] != best[begins[:-1]]))
        lo, hi = begins[change], begins[np.append(change[1:], len(begins)) - 1] + self.window
        self.hasher._powers(len(d.hash) + 1)
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(d.hash + np.uint64(7)) * self.hasher.up[: len(d.hash)]))
        around = mix((sums[hi] - sums[lo]) * self.hasher.down[lo] + (hi - lo).astype(np.uint64))
        of = owner[lo]
        return np.bincount(of, minlength=len(texts)), lo - d.at[of], hi - lo, h[best[lo]], around


class WaveletTree:
    """Ranks of symbols 0 to n - 1 in a sequence, one bit-packed level for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, n: int) -> None:
        self.bits = max(1, int(n - 1).bit_length())
        self.levels, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (symbols >> b & 1).astype(np.uint8)
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, np.uint8)), bitorder="little").view(np.uint64)
            before = np.append(0, np.cumsum(np.bitwise_count(packed).astype(np.int64)))[:-1].astype(np.int32)
            self.levels.append((packed, before))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(n)
        self.base = np.zeros(n, dtype=np.int64)  # where each symbol's run begins in the last level
        self.base = self._descend(every, np.zeros((1, n), dtype=np.int64))[0]

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of ``symbol`` before ``lo`` and before ``hi``."""
        lo, hi = self._descend(symbol, np.stack([lo, hi]))
        return lo - self.base[symbol], hi - self.base[symbol]

    def _descend(self, symbol: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The places of the symbols' bits in the last level, for rows of ``places`` together."""
        for (packed, before), zeros, b in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            word = places >> 6
            ones = before[word] + np.bitwise_count(packed[word] & _BELOW[places & 63])
            places = np.where((symbol >> b & 1).astype(bool), zeros + ones, places - ones)
        return places


class FMIndex:
    """An FM-index over several word sequences with weights.

    The sequences are joined by separators of their own, so no run crosses two of them. Suffixes are ordered by their first
    ``depth`` words, enough for every run of at most that length.
    """

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, weights: np.ndarray, depth: int) -> None:
        words, inverse = np.unique(flat, return_inverse=True)
        n = len(sizes)
        self.known = len(words)
        ends = np.cumsum(sizes) + np.arange(n)
        text = np.zeros(len(flat) + n, dtype=np.int64)
        is_word = np.ones(len(text), dtype=bool)
        is_word[ends] = False
        text[is_word] = inverse + 1  # 0 is the separator
        self.text, self.starts = text, np.append(0, ends[:-1] + 1)
        to_separator = np.repeat(ends, sizes + 1) - np.arange(len(text))
        rank, width = text.copy(), 1
        order = np.argsort(rank) if depth <= 1 else None
        while width < depth:  # suffix order by doubling; what lies behind a separator does not count
            after = np.zeros(len(text), dtype=np.int64)
            after[:-width] = rank[width:]
            key = rank * (len(text) + 1) + np.where(to_separator < width, 0, after)
            order = np.argsort(key)  # suffixes alike to the depth may stand in any order
            sorted_key = key[order]
            rank = np.empty(len(text), dtype=np.int64)
            rank[order] = np.cumsum(np.append(False, sorted_key[1:] != sorted_key[:-1]))
            width *= 2
        owner = np.repeat(np.arange(n), sizes + 1)
        self.weight_before = np.append(0, np.cumsum(weights[owner[order]]))
        bwt = text[order - 1]  # of the first suffix: the last separator
        self.counts = np.append(0, np.cumsum(np.bincount(text, minlength=self.known + 1)))
        self.tree = WaveletTree(bwt, self.known + 1)
        self.size = len(text)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One step of backward search: the interval of ``symbol`` before each interval, and its weighted occurrences."""
        a, b = self.tree.rank(symbol, lo, hi)
        lo, hi = self.counts[symbol] + a, self.counts[symbol] + b
        return lo, hi, self.weight_before[hi] - self.weight_before[lo]


def repeated_runs(flat: np.ndarray, sizes: np.ndarray, weights: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(sequence, begin, end) of runs of ``window`` or more words that occur more than once; every such window is in one.

    All sequences are searched at once, each from its right end to the left. A search that cannot be prolonged
    has found the longest repeated run up to its end. All windows not seen yet begin at the word it stopped at or
    before it, so probes of that word with the 2, 4, 8, ... words from it on tell how far right such a window can
    reach at most, and the next search begins there.
    """
    index = FMIndex(flat, sizes, weights, int(sizes.max(initial=1)))
    seq, out = np.flatnonzero(sizes >= window), []
    end = sizes[seq].astype(np.int64)
    at = end.copy()
    lo, hi = np.zeros(len(seq), np.int64), np.full(len(seq), index.size, np.int64)
    probing = np.zeros(len(seq), dtype=bool)
    target, cap, length = np.zeros(len(seq), np.int64), np.zeros(len(seq), np.int64), np.zeros(len(seq), np.int64)
    while len(seq):
        new_lo, new_hi, times = index.extend(index.text[index.starts[seq] + np.maximum(at - 1, 0)], lo, hi)
        ok = (at > 0) & (times > 1)
        lo, hi, at = np.where(ok, new_lo, lo), np.where(ok, new_hi, hi), np.where(ok, at - 1, at)
        over = ~ok & ~probing
        found = over & (end - at >= window)
        out += zip(seq[found].tolist(), at[found].tolist(), end[found].tolist(), strict=True)
        dead = over & (at == 0)
        # a search that has ended: probe from the word before, unless little is left to save
        target, cap = np.where(over, at - 1, target), np.where(over, end - 1, cap)
        length = np.where(over, 2, length)
        direct = over & (cap - target <= 2)
        begin_probe = over & ~direct
        # a probe that has ended: no window with the target reaches its end, or it asks for twice as much
        refuted = ~ok & probing
        passed = ok & probing & (at == target)
        reached = passed & (end >= cap)
        longer = passed & ~reached
        length = np.where(longer, 2 * length, length)
        probe = begin_probe | longer
        search = direct | refuted | reached
        end = np.where(probe, np.minimum(target + length, cap), np.where(direct | reached, cap, np.where(refuted, end - 1, end)))
        fresh = probe | search
        at, lo, hi = np.where(fresh, end, at), np.where(fresh, 0, lo), np.where(fresh, index.size, hi)
        probing = np.where(probe, True, np.where(search, False, probing))
        live = ~dead & (np.where(probing, cap, end) >= window)
        seq, end, at, lo, hi, probing, target, cap, length = (
            x[live] for x in (seq, end, at, lo, hi, probing, target, cap, length))
    return out


def _listed(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, th, pos, len, mh, sh): per document, arrays of its neighbourhoods."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(window, gram)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in by_bytes(texts):
                counts, places, sizes, own, around = find(texts[part])
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                piece = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("th"), *(
                        pa.ListArray.from_arrays(offsets, pa.array(x))
                        for x in (places.astype(np.int32), sizes.astype(np.int32), own.view(np.int64), around.view(np.int64)))],
                    names=["doc_id", "th", "pos", "len", "mh", "sh"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(
        run, f"doc_id {kind}, th bigint, pos array<int>, len array<int>, mh array<bigint>, sh array<bigint>")


def _cut_out(window: int):
    """(doc texts with wanted neighbourhoods) -> one row per neighbourhood, or per window of it if its anchor is crowded.

    The copies of a repeated row come to one task (to a few, where the join has split it), which cuts the first.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, seen = WordHasher(), set()
        for frame in frames:
            rows = []
            for doc, hashed, text, wanted in zip(frame["doc"], frame["hash"], frame["text"], frame["wanted"], strict=True):
                if (doc, hashed) in seen:
                    continue
                seen.add((doc, hashed))
                words = DocumentWords(hasher, [text]).hash
                for w in wanted:
                    around = words[w["pos"] : w["pos"] + w["len"]]
                    if not w["crowded"]:
                        rows.append((w["mh"], w["sh"], -1, 0, w["n"], around.tobytes()))
                        continue
                    whole = shingle_hashes(around, window).view(np.int64)
                    rows += [(w["mh"], w["sh"], j, int(x), w["n"], around[j : j + window].tobytes()) for j, x in enumerate(whole)]
            yield pd.DataFrame(rows, columns=["mh", "sh", "j", "wh", "n", "words"])

    return run


def _search(window: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["shard"]):
            for _, rows in frame.groupby("shard", sort=False):
                sizes = rows["words"].str.len().to_numpy() // 8
                flat = np.frombuffer(b"".join(rows["words"]), dtype=np.uint64)
                runs = repeated_runs(flat, sizes, rows["n"].to_numpy(), window)
                if runs:
                    i, begin, end = (np.array(x) for x in zip(*runs, strict=True))
                    yield pd.DataFrame({"shard": rows["shard"].iloc[0], "a": rows["a"].to_numpy()[i], "b": rows["b"].to_numpy()[i], "begin": begin, "stop": end})

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, spans): word intervals [begin, stop) of repeated windows, for the documents that have any."""
    spark = docs.sparkSession
    listed = materialize(_listed(docs, window, gram))
    each = listed.select("doc_id", "th", F.explode(F.arrays_zip("pos", "len", "mh", "sh")).alias("x")).select(
        "doc_id", "th", "x.pos", "x.len", "x.mh", "x.sh")
    # written, so that the join has a plain exchange on either side and a hot anchor can be split
    again = materialize(each.groupBy("mh").agg(F.count("*").alias("n")).where("n > 1").select("mh"))
    kept = materialize(each.join(again, "mh"))
    distinct = kept.groupBy("mh", "sh").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos", "len")).alias("at"))
    distinct = materialize(distinct)
    # written for the same reason: a crowded anchor's neighbourhoods can be split
    many = materialize(distinct.groupBy("mh").agg(F.count("*").alias("d")).where(F.col("d") > CROWDED))
    marked = distinct.join(many, "mh", "left").withColumn("crowded", F.col("d").isNotNull())
    wanted = marked.groupBy(F.col("at.doc_id").alias("doc"), F.col("at.th").alias("hash")).agg(
        F.collect_list(F.struct("at.pos", "at.len", "mh", "sh", "n", "crowded")).alias("wanted"))  # anchors of one document
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    cut = (
        texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc"]) & (texts["th"] == wanted["hash"])).select(
            F.col("doc").cast("string").alias("doc"), "hash", "text", "wanted")
        .mapInPandas(_cut_out(window), "mh bigint, sh bigint, j int, wh bigint, n bigint, words binary")
    )
    cut = materialize(cut)
    size = cut.agg(F.sum(F.length("words")).alias("b")).first()["b"] or 0
    shards = int(size / 8 / SHARD_WORDS) + 1
    whole = cut.where("j < 0").select(F.col("mh").alias("a"), F.col("sh").alias("b"), "n", "words")
    single = cut.where("j >= 0").groupBy("wh").agg(F.sum("n").alias("n"), F.first("words").alias("words")).select(
        F.col("wh").alias("a"), F.lit(0).cast("bigint").alias("b"), "n", "words")
    streams = whole.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards))).unionByName(
        single.withColumn("shard", -1 - F.pmod(F.xxhash64("a"), F.lit(shards))))  # shards of their own
    parts = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = materialize(
        streams.repartition(parts, "shard").sortWithinPartitions("shard")
        .mapInPandas(_search(window), "shard bigint, a bigint, b bigint, begin int, stop int"))
    of_whole = runs.where("shard >= 0").select(F.col("a").alias("mh"), F.col("b").alias("sh"), "begin", "stop")
    of_single = cut.where("j >= 0").select("mh", "sh", "j", "wh").join(
        runs.where("shard < 0").select(F.col("a").alias("wh")), "wh").select(
        "mh", "sh", F.col("j").alias("begin"), (F.col("j") + window).alias("stop"))
    hits = kept.join(of_whole.unionByName(of_single).distinct(), ["mh", "sh"])
    return hits.select("doc_id", "th", (F.col("pos") + F.col("begin")).alias("begin"), (F.col("pos") + F.col("stop")).alias("stop")).groupBy("doc_id", "th").agg(
        F.collect_set(F.struct("begin", "stop")).alias("spans"))


def remove_repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` holds the words that stay, joined by one space."""
    # an exchange of its own, so that the join can split a document of very many repeated rows
    spans = repeated_spans(docs, window, gram).select(F.col("doc_id").alias("s_doc"), F.col("th").alias("s_th"), "spans").hint("rebalance")
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    joined = texts.join(spans, texts["doc_id"].eqNullSafe(spans["s_doc"]) & (texts["th"] == spans["s_th"]), "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                total, removed, kept = [], [], []
                for text, spans_of in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    data = (text or "").encode()
                    _, first, last = hasher(data)
                    gone = np.zeros(len(first) + 1, dtype=np.int64)
                    for s in spans_of or ():
                        gone[s["begin"]] += 1
                        gone[s["stop"]] -= 1
                    stay = np.cumsum(gone)[:-1] == 0
                    total.append(len(first))
                    removed.append(len(first) - int(stay.sum()))
                    kept.append(b" ".join([data[a:b] for a, b in zip(first[stay].tolist(), last[stay].tolist(), strict=True)]).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")
