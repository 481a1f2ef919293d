"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A token that the merges can build is an entry of the vocabulary, and so is every
intermediate piece. A pair of bytes that stands side by side in no entry can
therefore never end up inside one token: between them a cut is certain. The
encoder cuts there (and where the pre-tokenizer cuts), encodes each fragment by
itself and concatenates the ids. Fragments repeat, so a bounded memo holds the
ids of those seen before.

Defined results: a null text encodes as the empty text (no ids, decoded ``""``);
rows, also repeated ones, are encoded each by itself; extra columns are kept, but
a column that has the name of an output is replaced; an empty table gives an
empty result. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apflow.llm.words import per_worker

MEMO_ENTRIES = 200_000  # of one generation, about 40 MB
MEMO_CHARS = 48  # longer units are not kept
LONG = 64  # bytes of a fragment that is merged by itself
NO_MERGE = 1 << 40
# The byte-level pre-tokenizer for texts below U+0250, where all versions of Unicode agree on letters and
# numbers (fixed value: the public pattern); other texts go to the library's pre-tokenizer.
_LATIN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_LATIN_END = "\u0250"
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space for Python only
_UNIT = re.compile(r"\s*\S+|\s+")


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(extra)
            extra += 1
    return [names[b] for b in range(256)]


class Vocabulary:
    """Tables of a byte-level BPE tokenizer file, built from its JSON text."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError("a byte-level BPE tokenizer without normalizer or prefix space is needed")
        added = spec.get("added_tokens") or []
        if any(a.get("single_word") or a.get("lstrip") or a.get("rstrip") for a in added):
            raise ValueError("added tokens that take their surroundings are not supported")
        from tokenizers import Tokenizer

        self.pre_tokenize = Tokenizer.from_str(text).pre_tokenizer.pre_tokenize_str
        letters = _byte_alphabet()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        if any(c not in vocab for c in letters):
            raise ValueError("the vocabulary lacks single bytes")
        self.byte_of, self.byte_id = byte_of, [vocab[c] for c in letters]
        special = {a["content"]: a["id"] for a in added}
        self.special = special
        self.split_special = (
            re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split
            if special else (lambda t: [t])
        )
        self.token_bytes: dict[int, bytes] = {}
        inside = np.zeros((256, 256), dtype=bool)
        for token, i in vocab.items():
            if token in special:
                continue
            self.token_bytes[i] = coded = bytes(byte_of[c] for c in token)
            inside[list(coded[:-1]), list(coded[1:])] = True
        for content, i in special.items():
            self.token_bytes[i] = content.encode()
        self.inside = inside
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.width = max(vocab.values()) + 1
        keys = np.array([a * self.width + b for a, b in self.merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array([r for r, _ in self.merges.values()], dtype=np.int64)[order], NO_MERGE)
        self.results = np.append(np.array([i for _, i in self.merges.values()], dtype=np.int64)[order], -1)
        self.byte_ids = np.array(self.byte_id, dtype=np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_MERGE), self.results[at]

    def encode_fragments(self, raw: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, place of the first byte of each) of all fragments of ``raw``; ``cut[i]``: one begins at byte i.

        All fragments advance together: in each round every fragment merges its leftmost pair of lowest
        rank, and those without a pair to merge are done.
        """
        cut = cut.copy()
        cut[1:] |= ~self.inside[raw[:-1], raw[1:]]  # the forced boundaries
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(raw)))
        out, alive = self.byte_ids[raw], np.ones(len(raw), dtype=bool)
        for s, n in zip(starts[sizes > LONG], sizes[sizes > LONG], strict=True):
            ids = self.merge(raw[s : s + n].tobytes())
            ends = np.cumsum([len(self.token_bytes[i]) for i in ids])
            alive[s : s + n] = False
            at = s + np.append(0, ends[:-1])
            alive[at], out[at] = True, ids
        group = np.cumsum(cut) - 1
        pos = np.flatnonzero(((sizes > 1) & (sizes <= LONG))[group])
        ids, group = out[pos], group[pos]
        if not len(pos):
            return out[alive], np.flatnonzero(alive)
        last = np.append(group[1:] != group[:-1], True)
        rank, result = np.full(len(ids), NO_MERGE), np.full(len(ids), -1)
        i = np.flatnonzero(~last)
        rank[i], result[i] = self.pair_ranks(ids[i], ids[i + 1])
        while len(pos):
            heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            lowest = np.minimum.reduceat(rank, heads)
            best = np.repeat(lowest, np.diff(np.append(heads, len(group))))
            hit = np.flatnonzero((rank == best) & (best < NO_MERGE))
            hit = hit[np.append(True, group[hit[1:]] != group[hit[:-1]])] if len(hit) else hit  # the leftmost
            ids[hit], rank[hit + 1] = result[hit], NO_MERGE
            last[hit] = last[hit + 1]
            keep = best < NO_MERGE
            out[pos[~keep]] = ids[~keep]  # these fragments are done
            keep[hit + 1] = False
            alive[pos[hit + 1]] = False
            moved = np.zeros(len(pos), dtype=bool)
            moved[hit] = True
            moved[hit[hit > 0] - 1] = True  # the changed symbol may be its right one
            ids, rank, result, pos, group, last, moved = (x[keep] for x in (ids, rank, result, pos, group, last, moved))
            rank[last & moved] = NO_MERGE
            i = np.flatnonzero(moved & ~last)
            rank[i], result[i] = self.pair_ranks(ids[i], ids[i + 1])
        return out[alive], np.flatnonzero(alive)

    def pieces(self) -> list[bytes]:
        return [self.token_bytes.get(i, b"") for i in range(max(self.token_bytes) + 1)]

    def merge(self, data: bytes) -> list[int]:
        """Ids of one fragment: always merge the pair of lowest rank, the leftmost first."""
        ids = [self.byte_id[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two was merged elsewhere
            ids[i], ids[j] = new, -1
            nxt[i] = k = nxt[j]
            if k >= 0:
                prv[k] = i
                if m := self.merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            if (h := prv[i]) >= 0 and (m := self.merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return [x for x in ids if x >= 0]


class Encoder:
    """Texts -> ids, with a bounded memo of units (white space and what follows it) seen before.

    The memo has two generations: when the young one is full it becomes the old one, and what is
    used again moves back.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.memo, self.old = vocabulary, {}, {}

    def _units(self, text: str | None) -> list[str]:
        out = []
        for i, part in enumerate(self.v.split_special(text or "")):
            if i % 2:
                self.memo[part] = np.int32(self.v.special[part]).tobytes()
                out.append(part)
            elif part:
                # the pre-tokenizer always cuts between a visible character and white space
                out += [part] if _ODD_SPACE.search(part) else _UNIT.findall(part)
        return out

    def _learn(self, units: list[str]) -> None:
        """Put the ids of ``units``, none of them in the memo, into it."""
        raws, cuts, sizes = [], [], []
        joined = [u for u in units if u[0] == " " and len(u) <= MEMO_CHARS and not u.isspace() and not _ODD_SPACE.search(u)]
        rest = list(set(units).difference(joined))
        # units that begin with a space can be pre-tokenized in one string, as they stand in a text
        for text, ends in [("".join(joined), np.cumsum([len(u) for u in joined])), *((u, [len(u)]) for u in rest)]:
            if not text:
                continue
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # first byte of each character
            cut = np.zeros(len(raw), dtype=bool)
            if len(text) == len(raw) or max(text) < _LATIN_END:
                begins = [m.start() for m in _LATIN.finditer(text)]
            else:
                begins = [a for _, (a, _) in self.v.pre_tokenize(text)]
            cut[chars[begins]] = True
            raws.append(raw)
            cuts.append(cut)
            sizes.append(np.diff(np.append(0, chars[ends])))
        ids, at = self.v.encode_fragments(np.concatenate(raws), np.concatenate(cuts))
        ends = np.searchsorted(at, np.cumsum(np.concatenate(sizes))) * 4
        coded, begin = ids.astype(np.int32).tobytes(), 0
        for u, end in zip([*joined, *rest], ends.tolist(), strict=True):
            self.memo[u] = coded[begin:end]
            begin = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as int32 bytes."""
        if len(self.memo) > MEMO_ENTRIES:
            self.old, self.memo = self.memo, {}
        units = [self._units(t) for t in texts]
        new = []
        for u in set().union(*units).difference(self.memo):
            if (known := self.old.get(u)) is None:
                new.append(u)
            else:
                self.memo[u] = known
        if new:
            self._learn(new)
        get = self.memo.__getitem__
        coded = [b"".join(map(get, u)) for u in units]
        for u in new:
            if len(u) > MEMO_CHARS:
                del self.memo[u]
        return coded


def _shared(df: DataFrame, tokenizer_path: str):
    """The file's text as a broadcast, and its digest."""
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    return df.sparkSession.sparkContext.broadcast(text), hashlib.sha256(text.encode()).hexdigest()


def _replaced(df: DataFrame, field: T.StructField) -> tuple[list[str], T.StructType]:
    kept = [f for f in df.schema.fields if f.name != field.name]
    return [f.name for f in kept], T.StructType([*kept, field])


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col`` (array of int), the token ids of ``text_col``.

    The vocabulary file is read once by the driver and broadcast; its size is fixed.
    """
    shared, digest = _shared(df, tokenizer_path)
    kept, schema = _replaced(df, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("bpe", digest), lambda: Encoder(Vocabulary(shared.value)))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                coded = encoder.encode(part.column(text_col).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                flat = np.frombuffer(b"".join(coded), dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), ids], names=[*kept, ids_col])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``, the text of the token ids, special tokens included (null ids: the empty text)."""
    shared, digest = _shared(df, tokenizer_path)
    kept, schema = _replaced(df, T.StructField(text_col, T.StringType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = per_worker(("bpe pieces", digest), lambda: Vocabulary(shared.value).pieces())
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = []
                for ids in part.column(ids_col):
                    flat = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else []
                    texts.append(b"".join([pieces[i] for i in (flat.tolist() if len(flat) else ())]).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(texts, type=pa.string())], names=[*kept, text_col]
                )

    return df.mapInArrow(run, schema)


def ids_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), 256)
