"""Vectorised word hashing shared by the operators that run numpy inside Spark tasks.

A word is a maximal run of bytes other than space and ``\\t``-``\\r``. Separators
are ASCII, so words can be cut from UTF-8 bytes without decoding them.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np

SEGMENT_BYTES = 1 << 21  # text hashed at a time; bounds the temporary arrays, not the text
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def separators() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, 9, 10, 11, 12, 13]] = True
    return table


class WordHasher:
    """64-bit hashes of all words of a buffer, by prefix sums of a polynomial over random byte values."""

    def __init__(self) -> None:
        self.sep = separators()
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first byte, byte after the last) of each word of ``data``."""
        raw = np.frombuffer(data, dtype=np.uint8)
        parts, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + SEGMENT_BYTES)
            while end < len(raw) and not self.sep[raw[end - 1]]:  # a word is never cut
                tail = np.flatnonzero(self.sep[raw[end : end + SEGMENT_BYTES]])
                end = end + int(tail[0]) + 1 if len(tail) else min(len(raw), end + SEGMENT_BYTES)
            parts.append(self._segment(raw[at:end], at))
            at = end
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _segment(self, raw: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word = np.zeros(len(raw) + 2, dtype=np.int8)
        word[1:-1] = ~self.sep[raw]
        edge = np.diff(word)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self._powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.value[raw] * self.up[: len(raw)], out=sums[1:])
        h = (sums[last] - sums[first]) * self.down[first]
        return mix(h + (last - first).astype(np.uint64)), first + at, last + at


class DocumentWords:
    """Words of several texts at once: flat hashes and, per text, where its words begin and end."""

    def __init__(self, hasher: WordHasher, texts: list[str | None]) -> None:
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([len(c) + 1 for c in coded], dtype=np.int64)
        self.data = b"\n".join(coded) + b"\n" if coded else b""
        self.hash, self.first, self.last = hasher(self.data)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.at = np.searchsorted(self.first, bounds)  # of text i: words at[i] to at[i + 1]
        self.text_at = bounds

    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive entries of ``words``; entry i covers words i to i + n - 1."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    size = len(words) - n + 1
    out = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        out = out * _STEP + words[j : j + size]
    return mix(out)


def per_worker(key: tuple, make: Callable):
    """``make()``, kept for the life of this Python worker, which serves many tasks one after another."""
    kept = vars(sys).setdefault("_apflow_llm_worker", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def by_bytes(texts: list[str | None], limit: int = SEGMENT_BYTES) -> Iterator[slice]:
    """Slices of ``texts`` of about ``limit`` characters each; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def whole_groups(frames: Iterable, keys: list[str]) -> Iterator:
    """Re-cut a stream of pandas frames, sorted by ``keys``, so that no frame ends inside a group."""
    import pandas as pd

    held = []
    for frame in frames:
        if not len(frame):
            continue
        k = frame[keys].to_numpy()
        change = np.flatnonzero((k[1:] != k[:-1]).any(axis=1))
        if held and (held[-1][keys].iloc[-1].to_numpy() != k[0]).any():
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        if not len(change):
            held.append(frame)
            continue
        cut = change[-1] + 1
        head = frame.iloc[:cut] if not held else pd.concat([*held, frame.iloc[:cut]], ignore_index=True)
        yield head.reset_index(drop=True)
        held = [frame.iloc[cut:].reset_index(drop=True)]
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
