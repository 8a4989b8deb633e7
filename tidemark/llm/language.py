"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, seeded by its code point. A letter trigram is
bound as the product of its letters' vectors, the first rotated by two places and the second
by one; a run of non-letters counts as one blank. A text bundles its trigrams (their sum,
weighted by a damped count), a language bundles its training texts, each at length one. A
text gets the language whose centred profile has the greatest cosine with its own vector,
centred likewise; the score is that cosine mapped to 0 to 1.

Training is one pass with a vector per language and task, summed per language; the profiles
are a few vectors, checked to be at most `MAX_LANGUAGES` before they are broadcast.

Defined cases: a null, empty or letterless text is `und` with score 0; equal cosines prefer
the lesser name; with no training rows everything is `und`; an empty table gives an empty
result; only doc_id, text and lang are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold, shipped, table

DIMENSIONS = 1024
MAX_LANGUAGES = 10_000
#: Characters worked on at once, distinct trigrams whose vectors are held at once, letters whose vectors are kept.
CHUNK, WIDE, MAX_LETTERS = 1 << 20, 8192, 65_536
BLANK = 32
#: Bits of a code point in a trigram's key.
CODE = 21


def _letters() -> np.ndarray:
    """Of each code point, its lower case if it is a letter, else a blank."""
    out = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_table: np.ndarray | None = None
_vectors: dict[int, np.ndarray] = {}


def letter_vector(code: int) -> np.ndarray:
    """The same for a letter wherever it is made; a bounded number is kept."""
    if code not in _vectors:
        if len(_vectors) >= MAX_LETTERS:
            _vectors.clear()
        _vectors[code] = (np.random.default_rng([11, code]).integers(0, 2, DIMENSIONS) * 2 - 1).astype(np.int8)
    return _vectors[code]


def bound(keys: np.ndarray) -> np.ndarray:
    """The vectors of trigram keys, a row each."""
    mask = (1 << CODE) - 1
    letters, at = np.unique(np.stack([keys >> (2 * CODE), (keys >> CODE) & mask, keys & mask]), return_inverse=True)
    vectors = np.stack([letter_vector(c) for c in letters.tolist()]) if len(letters) else np.zeros((0, DIMENSIONS), np.int8)
    a, b, c = at.reshape(3, -1)
    out = np.roll(vectors, 2, axis=1)[a]
    out *= np.roll(vectors, 1, axis=1)[b]
    out *= vectors[c]
    return out.astype(np.float32)


class Codebook:
    """Vectors of the trigrams seen so far, at most `most` of them kept."""

    def __init__(self, most: int = 20_000):
        self.most = most
        self.keys, self.rows = np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.float32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if known.all():
            return self.rows[at]
        out = np.empty((len(keys), DIMENSIONS), np.float32)
        out[known], out[~known] = self.rows[at[known]], bound(keys[~known])
        if len(self.keys) + len(keys) <= self.most:
            merged, first = np.unique(np.concatenate([self.keys, keys[~known]]), return_index=True)
            self.rows = np.concatenate([self.rows, out[~known]])[first]
            self.keys = merged
        return out


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram keys of the texts end to end, and the text that each belongs to."""
    global _table
    if _table is None:
        _table = _letters()
    # a text stands between blanks, and no trigram with a blank amid or of blanks alone remains
    joined = "".join(f"  {t}  " for t in texts)
    codes = _table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    of = np.repeat(np.arange(len(texts)), np.array([len(t) + 4 for t in texts], np.int64))
    keep = np.ones(len(codes), bool)
    # each text keeps a blank before and after it, whatever its neighbours
    keep[1:] = (codes[1:] != BLANK) | (codes[:-1] != BLANK) | (of[1:] != of[:-1])
    codes, of = codes[keep], of[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = (codes[:-2] << (2 * CODE)) | (codes[1:-1] << CODE) | codes[2:]
    good = (codes[1:-1] != BLANK) & (of[:-2] == of[2:])
    return keys[good], of[:-2][good]


def text_vectors(texts: list[str], book: Codebook) -> np.ndarray:
    """A bundle per text, zero where it has no letters."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    keys, of = _trigrams(texts)
    if not len(keys):
        return out
    # counts by (text, trigram), in blocks of trigrams, and within a block of texts
    distinct, ids = np.unique(keys, return_inverse=True)
    key = np.sort((ids // WIDE * len(texts) + of) * WIDE + ids % WIDE)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    weights = np.sqrt(np.diff(np.append(first, len(key)))).astype(np.float32)
    of, within = np.divmod(key[first], WIDE)
    block, of = np.divmod(of, len(texts))
    ids = block * WIDE + within
    cuts = np.searchsorted(ids // WIDE, np.arange(-(-len(distinct) // WIDE) + 1))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        vectors = book(distinct[k * WIDE : (k + 1) * WIDE])
        step = max(1, (4 << 20) // len(vectors))
        texts_at, where = np.unique(of[a:b], return_inverse=True)
        steps = np.searchsorted(where, np.arange(0, len(texts_at) + step, step))
        for n, (c, d) in enumerate(zip(steps[:-1], steps[1:], strict=True)):
            mine = texts_at[n * step : (n + 1) * step]
            counts = np.zeros((len(mine), len(vectors)), np.float32)
            counts[where[c:d] - n * step, ids[a + c : a + d] - k * WIDE] = weights[a + c : a + d]
            out[mine] += counts @ vectors
    return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    held: list[str] = []
    size = start = 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > CHUNK:
            yield start, held
            held, size, start = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield start, held


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def profiles(training: DataFrame) -> tuple[list[str], np.ndarray]:
    """From rows (text, lang) without null langs: the languages by name and a vector for each."""
    shipped(training.sparkSession)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, sums = Codebook(), {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for start, texts in _chunks(batch.column(0).to_pylist()):
                vectors = unit(text_vectors(texts, book))
                for lang in set(langs[start : start + len(texts)]):
                    rows = [i for i in range(len(texts)) if langs[start + i] == lang]
                    sums[lang] = sums.get(lang, 0) + vectors[rows].sum(0, dtype=np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.tolist()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = training.select("text", "lang").mapInArrow(bundle, "lang string, v array<double>")
    summed = (
        parts.select("lang", F.posexplode("v").alias("at", "x"))
        .groupBy("lang", "at")
        .agg(F.sum("x").alias("x"))
        .groupBy("lang")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"))
    )
    rows = summed.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    rows.sort(key=lambda r: r.lang)
    return [r.lang for r in rows], np.array([r.v for r in rows]).reshape(len(rows), DIMENSIONS)


def identify(docs: DataFrame, names: list[str], vectors: np.ndarray) -> DataFrame:
    """A row per document: doc_id, lang_pred, score."""
    shipped(docs.sparkSession)
    shapes = unit(vectors) if len(names) else vectors
    centre = shapes.mean(0, keepdims=True) if len(names) else np.zeros((1, DIMENSIONS))
    held = docs.sparkSession.sparkContext.broadcast((names, unit(shapes - centre).astype(np.float32) if len(names) > 1 else shapes.astype(np.float32), centre.astype(np.float32)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, prototypes, middle = held.value
        book = Codebook()
        for batch in batches:
            preds: list[str] = []
            scores: list[float] = []
            for _, texts in _chunks(batch.column(1).to_pylist()):
                mine = text_vectors(texts, book)
                some = mine.any(1)
                near = unit(mine)
                if len(known) > 1:
                    near = unit(near - middle)
                if not known:
                    some[:] = False
                    cos = np.zeros((len(texts), 1))
                else:
                    cos = near @ prototypes.T
                best = cos.argmax(1)
                preds += [known[b] if s else "und" for b, s in zip(best, some, strict=True)]
                scores += [float(min(1.0, max(0.0, (1 + c[b]) / 2))) if s else 0.0 for c, b, s in zip(cos, best, some, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names, vectors = profiles(docs.where(F.col("lang").isNotNull() & (fold(4) != 2)))
    found = identify(docs, names, vectors)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")
