"""Ranked lexical search: an inverted index in compressed blocks, searched with Block-Max MaxScore.

Index. A task cuts its documents into shards of about ``SHARD_CHARS`` characters; a shard is one row: its documents' ids
and lengths, its terms (64-bit hashes) in order, and each term's postings in blocks of ``BLOCK`` documents. A block holds
document numbers (offsets from its first) and occurrences in one, two or four bytes each, and beside it, not
compressed, its first and last document and the largest impact of its postings. Nothing is shuffled.

Search. Queries travel to the shards in blocks of about ``QUERY_TERMS`` terms, one pass over the index each. A first pass
sums document frequencies and takes the largest impact of each query term over all shards; weight times that is the term's
global bound. In the second pass, per query and shard: lists in falling order of their bounds are essential as long
as the bounds from there on reach the threshold (the k-th best score this task has seen, or the k-th best sum so
far in the shard); documents of the essential lists are the candidates. On the other lists a candidate goes on only if
its sum, the largest impact of the block it would be in, and the bounds of the lists after that reach the
threshold; only blocks that still have such a candidate are decompressed. A task keeps one heap a query over all its
shards, Spark merges the heaps.

Score of a document: the sum over the query's terms, repeats included, of weight * impact, all in integers:
weight = floor(1000 ln((2N + 2) / (2 df + 1))), impact = (10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L,
with N documents that hold a term, L their terms, n a document's terms, df and tf as usual.

Terms are the maximal runs of ASCII letters and digits and all characters beyond ASCII, A-Z lower-cased.

Defined results: a null or empty text has no term and is never found; documents of score 0 are not returned; equal
scores go to the smaller id, null ids last; every row is a document of its own, so repeated rows are found
each; a query row (id and text) that is repeated is answered once, rows of one id with different texts each by
itself; a query without terms, and an empty table, give no rows; ids are whole numbers; extra columns are not carried.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apflow.llm.words import DocumentWords, WordHasher, by_bytes
from apflow.operators.joins import materialize

BLOCK = 128
SHARD_CHARS = 1 << 23
QUERY_TERMS = 1 << 18
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class TermHasher(WordHasher):
    """Terms instead of words: all ASCII but letters and digits separates."""

    def __init__(self) -> None:
        super().__init__()
        self.sep = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return super().__call__(data.translate(_LOWER))


# ----------------------------------------------------------------- a shard
def length_part(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents with ``n`` terms."""
    return 75 + (25 * n.astype(np.int64) * documents) // terms


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _widths(values: np.ndarray) -> np.ndarray:
    return np.where(values < 1 << 8, 1, np.where(values < 1 << 16, 2, 4)).astype(np.uint8)


def _put(data: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    for b in range(4):
        own = width > b
        data[at[own] + b] = (values[own] >> (8 * b)) & 255


def _get(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    out = data[at].astype(np.int64)
    for b in range(1, int(width.max(initial=1))):
        own = width > b
        out[own] |= data[at[own] + b].astype(np.int64) << (8 * b)
    return out


@dataclass
class Shard:
    """The packed arrays of a shard; ``first``, ``last``, ``top`` and the widths have one entry a block."""

    lengths: np.ndarray
    terms: np.ndarray
    df: np.ndarray
    first: np.ndarray
    last: np.ndarray
    top: np.ndarray
    doc_width: np.ndarray
    tf_width: np.ndarray
    data: np.ndarray

    FIELDS = ("lengths", "terms", "df", "first", "last", "top", "doc_width", "tf_width", "data")

    def __post_init__(self) -> None:
        blocks = -(-self.df.astype(np.int64) // BLOCK)
        self.block_at = np.append(0, np.cumsum(blocks))  # of term i: blocks block_at[i] to block_at[i + 1]
        self.count = np.full(self.block_at[-1], BLOCK, dtype=np.int64)
        self.count[self.block_at[1:] - 1] = self.df - (blocks - 1) * BLOCK
        size = self.count * (self.doc_width.astype(np.int64) + self.tf_width)
        self.offset = np.cumsum(size) - size

    @classmethod
    def build(cls, words: DocumentWords, documents: int, terms: int) -> Shard:
        n = words.counts()
        of = np.repeat(np.arange(len(n)), n)
        order = np.argsort(words.hash, kind="stable")
        h, d = words.hash[order], of[order]
        start = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, np.int64)
        tf = np.diff(np.append(start, len(h)))
        h, d = h[start], d[start]
        head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else start
        df = np.diff(np.append(head, len(h)))
        place = np.arange(len(h)) - np.repeat(head, df)
        block = np.flatnonzero(place % BLOCK == 0)
        count = np.diff(np.append(block, len(h)))
        first, last = d[block], d[block + count - 1]
        reduced = (lambda a: np.maximum.reduceat(a, block)) if len(block) else (lambda a: a)
        top = reduced(impacts(tf, length_part(n, documents, max(1, terms))[d]))
        doc_width, tf_width = _widths(last - first), _widths(reduced(tf))
        size = count * (doc_width.astype(np.int64) + tf_width)
        offset, in_block = np.cumsum(size) - size, place % BLOCK
        b = np.repeat(np.arange(len(block)), count)
        data = np.zeros(int(size.sum()), dtype=np.uint8)
        _put(data, offset[b] + in_block * doc_width[b], d - first[b], doc_width[b])
        _put(data, offset[b] + count[b] * doc_width[b] + in_block * tf_width[b], tf, tf_width[b])
        return cls(n.astype(np.int32), h[head], df.astype(np.int32), first.astype(np.int32), last.astype(np.int32),
                   top.astype(np.int32), doc_width, tf_width, data)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def unpacked(cls, body: bytes) -> Shard:
        with np.load(io.BytesIO(body)) as z:
            return cls(*[z[f] for f in cls.FIELDS])

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``terms`` the shard has, and their places in its list of terms."""
        at = np.searchsorted(self.terms, terms)
        has = at < len(self.terms)
        has[has] = self.terms[at[has]] == terms[has]
        return has, at

    def tops(self) -> np.ndarray:
        """The largest impact of each term."""
        return np.maximum.reduceat(self.top, self.block_at[:-1]) if len(self.terms) else self.top

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, occurrences) of the given blocks, decompressed."""
        n = self.count[blocks]
        b = np.repeat(blocks, n)
        j = np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n)
        wide = self.doc_width[b].astype(np.int64)
        docs = self.first[b] + _get(self.data, self.offset[b] + j * wide, self.doc_width[b])
        return docs, _get(self.data, self.offset[b] + self.count[b] * wide + j * self.tf_width[b], self.tf_width[b])


@dataclass
class Query:
    """Terms of one query in falling order of their global bound, weights with repeats; ``rest[i]``: bounds from i on."""

    terms: np.ndarray
    weights: np.ndarray
    rest: np.ndarray


def kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def search_shard(shard: Shard, m: np.ndarray, query: Query, k: int, least: int, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the shard that may be among the best ``k``; ``least``: the score to reach.

    ``seen`` gets the numbers of blocks decompressed and in the query's lists added.
    """
    has, at = shard.places(query.terms)
    sums = np.zeros(len(shard.lengths), dtype=np.int64)
    known, opened, i = max(least, 1), 0, 0
    while i < len(query.terms) and query.rest[i] >= known:  # essential lists
        if has[i]:
            own = np.arange(shard.block_at[at[i]], shard.block_at[at[i] + 1])
            docs, tf = shard.postings(own)
            sums[docs] += query.weights[i] * impacts(tf, m[docs])
            opened += len(own)
            known = max(known, kth(sums, k))
        i += 1
    found, wanted = np.flatnonzero(sums), np.zeros(len(sums), dtype=bool)
    for i in range(i, len(query.terms)):
        after = query.rest[i + 1]
        found = found[sums[found] + query.rest[i] >= known]
        if not len(found):
            break
        if not has[i]:
            continue
        lo, hi = shard.block_at[at[i]], shard.block_at[at[i] + 1]
        block = lo + np.searchsorted(shard.last[lo:hi], found)
        inside = block < hi
        inside[inside] = shard.first[block[inside]] <= found[inside]
        bound = sums[found] + after
        bound[inside] += query.weights[i] * shard.top[block[inside]].astype(np.int64)
        stays = bound >= known
        needed = np.unique(block[inside & stays])
        found = found[stays]
        if len(needed):
            docs, tf = shard.postings(needed)
            wanted[found] = True
            hit = wanted[docs]
            wanted[found] = False
            docs = docs[hit]
            sums[docs] += query.weights[i] * impacts(tf[hit], m[docs])
            opened += len(needed)
            known = max(known, kth(sums[found], k))
    found = found[sums[found] >= known]
    if seen is not None:
        seen[0] += opened
        seen[1] += int((shard.block_at[at[has] + 1] - shard.block_at[at[has]]).sum())
    return found, sums[found]


# --------------------------------------------------------------- Spark plan
@dataclass
class Index:
    """Written shards (ids array<bigint>, body binary) with the corpus totals."""

    shards: DataFrame
    documents: int
    terms: int


def corpus_totals(texts: DataFrame) -> tuple[int, int]:
    """How many of ``texts`` (one column) have a term, and all their terms with repeats."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = ~TermHasher().sep
        documents = terms = 0
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    term = inside[np.frombuffer(text.as_buffer(), dtype=np.uint8)]
                    n = int(np.count_nonzero(term[1:] > term[:-1])) + int(term[:1].sum())
                    documents, terms = documents + (n > 0), terms + n
        yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], names=["documents", "terms"])

    row = texts.mapInArrow(run, "documents bigint, terms bigint").agg(F.sum("documents"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = SHARD_CHARS) -> Index:
    text = F.col(text_col)
    documents, terms = corpus_totals(docs.select(text.alias("text")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TermHasher()
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            for part in by_bytes(texts, shard_chars):
                words = DocumentWords(hasher, texts[part])
                if len(words.hash):
                    body = Shard.build(words, documents, terms).packed()
                    own = pa.ListArray.from_arrays(pa.array([0, part.stop - part.start], pa.int32()), ids[part.start : part.stop])
                    yield pa.RecordBatch.from_arrays([own, pa.array([body], pa.binary())], names=["ids", "body"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    return Index(materialize(rows.mapInArrow(run, "ids array<bigint>, body binary")), documents, terms)


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, terms, repeats) of the distinct query rows with a term, written."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TermHasher()
        for batch in batches:
            words = DocumentWords(hasher, batch.column("text").to_pylist())
            found = [np.unique(words.hash[a:b], return_counts=True) for a, b in zip(words.at, words.at[1:], strict=False)]
            own = [i for i, f in enumerate(found) if len(f[0])]
            if own:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").take(pa.array(own)), pa.array([found[i][0].view(np.int64) for i in own], pa.list_(pa.int64())),
                     pa.array([found[i][1] for i in own], pa.list_(pa.int64()))], names=["item_id", "terms", "repeats"])

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    return materialize(rows.mapInArrow(run, f"item_id {kind}, terms array<bigint>, repeats array<bigint>"))


def _global_bounds(index: Index, vocabulary: np.ndarray) -> dict[int, tuple[int, int]]:
    """{term: (weight, largest impact)} of the terms of a block of queries that the index has."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, top = np.zeros(len(vocabulary), dtype=np.int64), np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for body in batch.column("body"):
                shard = Shard.unpacked(body.as_py())
                has, at = shard.places(vocabulary)
                df[has] += shard.df[at[has]]
                top[has] = np.maximum(top[has], shard.tops()[at[has]])
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(a[used]) for a in (vocabulary.view(np.int64), df, top)], names=["term", "df", "top"])

    found = index.shards.select("body").mapInArrow(run, "term bigint, df bigint, top bigint").groupBy("term").agg(
        F.sum("df").alias("df"), F.max("top").alias("top")).collect()  # at most the block's terms
    n = index.documents
    return {r["term"]: (math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1))), r["top"]) for r in found}


def _search_block(index: Index, block: list, k: int, id_type: str) -> DataFrame:
    """(q, item_id, doc_id, score): each task's heaps for a block of queries."""
    vocabulary = np.unique(np.concatenate([np.array(r["terms"], dtype=np.int64) for r in block]).view(np.uint64))
    known = _global_bounds(index, vocabulary)
    queries, ids = [], [r["item_id"] for r in block]
    for r in block:
        own = [(known[t][0] * n * known[t][1], t, known[t][0] * n) for t, n in zip(r["terms"], r["repeats"], strict=True) if t in known]
        own.sort(reverse=True)
        bounds = np.array([o[0] for o in own], dtype=np.int64)
        queries.append(Query(
            np.array([o[1] for o in own], dtype=np.int64).view(np.uint64), np.array([o[2] for o in own], dtype=np.int64),
            np.append(np.cumsum(bounds[::-1])[::-1], 0)))
    documents, terms = index.documents, index.terms

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        heaps = [(none, none, none) for _ in queries]  # scores, ids, whether the id is null; best first
        for batch in batches:
            for own, body in zip(batch.column("ids"), batch.column("body"), strict=True):
                shard = Shard.unpacked(body.as_py())
                m = length_part(shard.lengths, documents, terms)
                own_ids = own.values
                null = np.asarray(own_ids.is_null()).astype(np.int64)
                own_ids = own_ids.fill_null(0).to_numpy()
                for i, query in enumerate(queries):
                    best = heaps[i]
                    found, scores = search_shard(shard, m, query, k, int(best[0][-1]) if len(best[0]) >= k else 0)
                    if len(found):
                        s, d, z = (np.concatenate(x) for x in zip(best, (scores, own_ids[found], null[found]), strict=True))
                        first = np.lexsort((d, z, -s))[:k]
                        heaps[i] = (s[first], d[first], z[first])
        n = [len(h[0]) for h in heaps]
        if sum(n):
            s, d, z = (np.concatenate(x) for x in zip(*heaps, strict=True))
            of = np.repeat(np.arange(len(heaps)), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.int32()), pa.array([ids[i] for i in of]), pa.array(d, pa.int64(), mask=z.astype(bool)), pa.array(s, pa.int64())],
                names=["q", "item_id", "doc_id", "score"])

    return index.shards.mapInArrow(run, f"q int, item_id {id_type}, doc_id bigint, score bigint")


def search(
    index: Index, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text", query_terms_a_block: int = QUERY_TERMS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``k`` documents of every query row of ``items``."""
    asked = query_terms(items, id_col, text_col)
    id_type = asked.schema["item_id"].dataType.simpleString()
    size = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(size / query_terms_a_block))
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == b).collect()
        if not block or not index.terms:
            continue
        order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = _search_block(index, block, k, id_type).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = best.select("item_id", "rank", "doc_id", "score")
        best = best if blocks == 1 else materialize(best)
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return out
