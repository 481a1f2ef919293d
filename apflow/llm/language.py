"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that follows from its code point
alone. A letter trigram is the product of its letters' vectors, each rotated by
its place (binding); a text is the sum of its trigrams (bundling); a language is
the sum of its training texts. A text gets the language whose prototype has the
largest cosine with it.

Letters are lower-cased; every run of other characters counts as one boundary
letter. Defined results: a null text, or one without a letter, is ``und`` with
score 0, and so is every text if nothing could be learned; ties go to the
language that sorts first; the score is the cosine, at least 0. Rows are judged
one by one (repeated rows alike), whole texts of any length; extra columns are
kept, except that columns with the names of the outputs are replaced.

Learning sums up ``languages x dims`` numbers, which does not grow with the corpus:
each task bundles its own rows and Spark adds the tasks' sums up. Up to
``MAX_LANGUAGES`` languages are held and broadcast at once; the sums of more stay a written
table, and texts are compared with one slice of it after another.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apflow.llm.words import by_bytes, mix
from apflow.operators.joins import materialize

UNKNOWN = "und"
DIMS = 512
MAX_LANGUAGES = 2000  # prototypes that are broadcast at once: 2000 x 512 doubles are 8 MB
LEAST_SHARE = 0.18  # of the cosine that a text of its language would have
CHUNK_CHARS = 200_000
TRIGRAMS_AT_ONCE = 4096


@dataclass(frozen=True)
class Prototypes:
    """``collisions``: the chance that two trigrams of a language are the same one; ``slices`` of the written ``sums``, if there
    are more languages than are held at once (the arrays are empty then)."""

    languages: list[str]
    vectors: np.ndarray  # languages x dims, unit length
    collisions: np.ndarray
    sums: DataFrame | None = None
    slices: int = 1

    @property
    def known(self) -> bool:
        return bool(self.languages) or self.sums is not None

    @classmethod
    def of(cls, sums: pd.DataFrame, dims: int) -> Prototypes:
        """From rows of lang, dim, total; at ``dims`` stands the number of trigrams."""
        table = sums.pivot(index="lang", columns="dim", values="total").sort_index()
        total = table.to_numpy(dtype=np.float64).reshape(len(table), dims + 1 if len(table) else 1)
        vectors, grams = total[:, :-1], total[:, -1]
        size = np.linalg.norm(vectors, axis=1, keepdims=True) if len(table) else np.ones((0, 1))
        collisions = (size[:, 0] ** 2) / (max(dims, 1) * np.maximum(grams, 1) ** 2)
        return cls([str(x) for x in table.index], vectors / np.where(size > 0, size, 1), collisions)

    def parts(self) -> Iterator[Prototypes]:
        """The prototypes, as many as are held at once."""
        if self.sums is None:
            yield self
            return
        dims = self.vectors.shape[1]
        for i in range(self.slices):
            yield Prototypes.of(self.sums.where(F.pmod(F.xxhash64("lang"), F.lit(self.slices)) == i).toPandas(), dims)


class Bundler:
    """Texts -> unit vectors."""

    def __init__(self, dims: int) -> None:
        self.dims = dims
        codes = range(0x110000)
        self.letter = np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in codes), dtype=bool, count=0x110000)
        self.index = np.zeros(0x110000, dtype=np.int64)

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        seeds = mix(codes.astype(np.uint64) + np.uint64(1))[:, None] + np.arange(self.dims // 64, dtype=np.uint64)
        bits = np.unpackbits(mix(seeds).view(np.uint8), axis=1)
        return bits.astype(np.int8) * np.int8(2) - np.int8(1)

    def _grams(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text of each trigram, its number, the alphabet of the numbers, letters per text)."""
        lowered = [(t or "").lower() for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lowered])
        # a boundary before and after each text
        codes = np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = self.letter[codes]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # one boundary after a run of letters
        keep[1:-1] |= is_letter[2:] & ~is_letter[1:-1] & ~is_letter[:-2]  # and one before it
        keep[:1] = is_letter[1:2]
        letters = np.bincount(owner[is_letter], minlength=len(texts))
        seq, owner = np.where(is_letter, codes, 0)[keep], owner[keep]
        again = (seq[1:] == 0) & (seq[:-1] == 0) & (owner[1:] == owner[:-1])  # a longer run is one boundary, too
        once = np.append(np.ones(min(1, len(seq)), dtype=bool), ~again)
        seq, owner = seq[once], owner[once]
        flags = np.zeros(0x110000, dtype=bool)
        flags[seq] = True
        alphabet = np.flatnonzero(flags)
        self.index[alphabet] = np.arange(len(alphabet))
        s, a = self.index[seq], len(alphabet)
        inside = owner[2:] == owner[:-2]
        return owner[:-2][inside], ((s[:-2] * a + s[1:-1]) * a + s[2:])[inside], alphabet, letters

    def bundle(self, rows: np.ndarray, grams: np.ndarray, alphabet: np.ndarray, n: int) -> np.ndarray:
        """Sum of the trigram vectors of each of ``n`` rows."""
        out, a = np.zeros((n, self.dims)), len(alphabet)
        if not len(grams):
            return out
        keys = np.sort(grams * n + rows)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.diff(np.r_[starts, len(keys)])
        grams, rows = keys[starts] // n, keys[starts] % n
        new = np.r_[True, grams[1:] != grams[:-1]]
        place, distinct = np.cumsum(new) - 1, grams[new]
        vectors = self._letters(alphabet)
        once, twice = np.roll(vectors, 1, axis=1), np.roll(vectors, 2, axis=1)
        for at in range(0, len(distinct), TRIGRAMS_AT_ONCE):
            g = distinct[at : at + TRIGRAMS_AT_ONCE]
            lo, hi = np.searchsorted(place, [at, at + len(g)])
            table = np.zeros((n, len(g)), dtype=np.float32)
            table[rows[lo:hi], place[lo:hi] - at] = counts[lo:hi]
            out += table @ (twice[g // (a * a)] * once[g // a % a] * vectors[g % a]).astype(np.float32)
        return out

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit vectors, letters, trigrams) of the texts."""
        out, letters, trigrams = np.zeros((len(texts), self.dims)), *np.zeros((2, len(texts)), dtype=np.int64)
        for part in by_bytes(texts, CHUNK_CHARS):
            rows, grams, alphabet, letters[part] = self._grams(texts[part])
            out[part] = self.bundle(rows, grams, alphabet, part.stop - part.start)
            trigrams[part] = np.bincount(rows, minlength=part.stop - part.start)
        size = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return out / np.where(size > 0, size, 1), letters, trigrams

    def by_label(self, texts: list[str | None], labels: np.ndarray, n: int) -> np.ndarray:
        """Sum of the trigram vectors of all texts of each label 0 to n - 1, and their number as the last component."""
        out = np.zeros((n, self.dims + 1))
        for part in by_bytes(texts, CHUNK_CHARS):
            rows, grams, alphabet, _ = self._grams(texts[part])
            out[:, :-1] += self.bundle(labels[part][rows], grams, alphabet, n)
            out[:, -1] += np.bincount(labels[part][rows], minlength=n)
        return out


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = DIMS) -> Prototypes:
    """Prototypes from the rows of ``df`` that have a language and a text with letters."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )

    def bundle(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundler, sums = None, {}
        for frame in frames:
            bundler = bundler or Bundler(dims)
            labels, names = pd.factorize(frame["lang"])
            for lang, total in zip(names, bundler.by_label(frame["text"].tolist(), labels, len(names)), strict=True):
                sums[lang] = sums.get(lang, 0) + total.astype(np.int64)
        for lang, total in sums.items():
            yield pd.DataFrame({"lang": [lang], "total": [total]})

    sums = materialize(
        rows.mapInPandas(bundle, "lang string, total array<long>")
        .select("lang", F.posexplode("total").alias("dim", "part"))
        .groupBy("lang", "dim").agg(F.sum("part").alias("total")))
    found = sums.count() // (dims + 1)
    if found <= MAX_LANGUAGES:
        return Prototypes.of(sums.toPandas(), dims)
    return Prototypes([], np.zeros((0, dims)), np.zeros(0), sums, -(-2 * found // MAX_LANGUAGES))


def _judged(df: DataFrame, model: Prototypes, text_col: str, names: dict[str, str]) -> DataFrame:
    """``df`` with the best language, its cosine, the cosine a text of it would have, and the number of letters (``names``)."""
    types = {"lang": T.StringType(), "cosine": T.DoubleType(), "expected": T.DoubleType(), "letters": T.LongType()}
    kept = [f for f in df.schema.fields if f.name not in names.values()]
    schema = T.StructType([*kept, *(T.StructField(names[k], t) for k, t in types.items())])
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.vectors, model.collisions))
    columns = [f.name for f in kept]

    def judge(batches):
        import pyarrow as pa

        languages, vectors, collisions = shared.value
        bundler = None
        for batch in batches:
            bundler = bundler or Bundler(vectors.shape[1] if languages else DIMS)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                unit, letters, trigrams = bundler(part.column(text_col).to_pylist())
                cosines = unit @ vectors.T if languages else np.zeros((part.num_rows, 1))
                best = cosines.argmax(axis=1)
                cosine = np.where(letters > 0, cosines[np.arange(len(best)), best], 0.0)
                pred = [languages[b] if languages and k else UNKNOWN for b, k in zip(best, letters, strict=True)]
                # n trigrams drawn from those of the language: n S sqrt(S) over sqrt(n + n^2 S) sqrt(S), with S the collisions
                x = trigrams * (collisions[best] if languages else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in columns), pa.array(pred, pa.string()), pa.array(cosine, pa.float64()),
                     pa.array(np.sqrt(x / (1 + x)), pa.float64()), pa.array(letters, pa.int64())],
                    names=[*columns, *(names[k] for k in types)],
                )

    return df.mapInArrow(judge, schema)


def identify(
    df: DataFrame, model: Prototypes, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score",
    letters_out: str = "n_letters", expected_out: str | None = None,
) -> DataFrame:
    """``df`` with the predicted language, its cosine and the number of letters it was judged by.

    ``expected_out``: a column for the cosine that a text of the predicted language with as many trigrams would have.
    """
    own = {"lang": lang_out, "cosine": score_out, "expected": expected_out or "__llm_expected", "letters": letters_out}
    more = {k: f"__llm_next_{k}" for k in own}
    out = None
    for part in model.parts():
        if out is None:
            out = _judged(df, part, text_col, own)
        else:  # the slice before is written, so one slice is held at a time
            both = _judged(materialize(out), part, text_col, more)
            a, b = F.col(f"`{own['cosine']}`"), F.col(more["cosine"])
            better = (b > a) | ((b == a) & (F.col(more["lang"]) < F.col(f"`{own['lang']}`")))
            out = both.withColumns({own[k]: F.when(better, F.col(more[k])).otherwise(F.col(f"`{own[k]}`")) for k in own}).drop(*more.values())
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"`{score_out}`")))
    out = out.withColumn(score_out, score)
    return out if expected_out else out.drop("__llm_expected")


def least_cosine(expected: Column, dims: int, share: float = LEAST_SHARE) -> Column:
    return F.greatest(F.lit(0.0), share * expected - 0.5 / dims**0.5)


def keep_identified(df: DataFrame, model: Prototypes, share: float = LEAST_SHARE, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, same columns, whose text has a language.

    Rejected are texts without a letter, and texts whose best cosine is below ``share`` of the cosine that
    a text of that language with as many trigrams would have, less half the standard deviation, 1 / sqrt(dims), of
    the cosine of unrelated trigrams, which is the same at any length. With few trigrams a text of the language shows
    little, and little is asked. With no learned language, only texts without letters go.
    """
    lang, score, letters, expected = "__llm_lang", "__llm_score", "__llm_letters", "__llm_asked"
    judged = identify(df, model, text_col, lang, score, letters, expected)
    ok = F.col(letters) > 0
    if model.known:
        ok = ok & (F.col(score) >= least_cosine(F.col(expected), model.vectors.shape[1], share))
    return judged.where(ok).select(*[F.col(f"`{c}`") for c in df.columns])
