"""Language identification with hyperdimensional profiles.

Each letter, by its code point in lower case, has a random vector of +-1 (bits of a hash). A trigram binds its letters'
vectors, permuted by place (the product of the first rolled by 2, the second by 1 and the third). A document bundles
(adds) its trigrams' vectors; a language's prototype bundles all trigrams of all documents labelled with it. A document
goes to the prototype with the greatest cosine. Bundling is linear and its sums are whole numbers, so tasks bundle what
they have and Spark adds up exactly; one vector a language reaches the driver.

A document is rejected if it has no letters, or if its best cosine is under the limit for its length: it then resembles
no language known. Cosines rise with length, of text as of gibberish, so the limit is fitted to all labelled rows: half of
the 1st percentile of their cosines, by powers of two of trigrams. A length of under FEW labelled rows has the limit of
the nearest length with as many (the shorter of two). From ENOUGH trigrams on, never is a limit under ``noise`` standard
deviations of what a random vector gets, 1/sqrt(dim). With fewer trigrams a low cosine says less: there the limit is at
most those deviations times the root of trigrams / ENOUGH.

Null or empty text, or text without letters: no language, cosine null, rejected. Very long text: counted whole.
Null label: not used in a prototype. Ties: the language first by name. Repeated rows: the same result each. Empty table
or no labels: no language is known, all is rejected. Other columns are left out of identify() and kept by accepted().
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, index_of, pick, positional
from .textvec import chunks, code_points, mix

DIM, NOISE, ENOUGH = 512, 4.0, 32
SLOTS, BITS = 128, 7  # the dense form of letters: common ones have slots 1 to 127, 0 is anything else
WIDE = 21  # bits of a code point: the sparse form
LENGTHS, BINS, FEW, LOW, PART = 40, 1000, 20, 0.01, 0.5  # of the limits
SIZE = 300_000  # characters at once


@functools.cache
def alphabet() -> np.ndarray:
    """True at each code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@functools.cache
def dense() -> tuple[np.ndarray, np.ndarray]:
    """Slot of each code point, 0 for all but the small letters of Latin and its extension, and the code points of slots."""
    common = [i for i in [*range(0x61, 0x7B), *range(0xDF, 0x180)] if chr(i).isalpha() and chr(i).lower() == chr(i)][: SLOTS - 1]
    s, back = np.zeros(0x110000, np.uint8), np.zeros(SLOTS, np.int64)
    s[common] = np.arange(1, len(common) + 1)
    back[1 : len(common) + 1] = common
    return s, back


def letters(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """A vector of +-1 for each code point; 0 is the blank's."""
    words = -(-dim // 64)
    h = mix(mix(codes.astype(np.uint64))[:, None] + np.arange(words, dtype=np.uint64))
    bits = np.unpackbits(h.view(np.uint8).reshape(len(codes), words * 8), axis=1, bitorder="little")[:, :dim]
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def gram_vectors(ids: np.ndarray, dim: int = DIM) -> np.ndarray:
    """One float row for each trigram, an integer of three code points."""
    code, at = np.unique(np.stack((ids >> (2 * WIDE), (ids >> WIDE) & ((1 << WIDE) - 1), ids & ((1 << WIDE) - 1))), return_inverse=True)
    at = at.reshape(3, len(ids))
    r = letters(code, dim)
    out = np.roll(r, 2, 1)[at[0]]
    out *= np.roll(r, 1, 1)[at[1]]
    out *= r[at[2]]
    return out.astype(np.float32)


@functools.lru_cache(8)
def _dense_table(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = letters(dense()[1], dim)
    return np.roll(r, 2, 1), np.roll(r, 1, 1), r


def dense_vectors(ids: np.ndarray, dim: int = DIM) -> np.ndarray:
    """gram_vectors() of trigrams of slots."""
    first, second, r = _dense_table(dim)
    out = first[ids >> (2 * BITS)]
    out *= second[(ids >> BITS) & (SLOTS - 1)]
    out *= r[ids & (SLOTS - 1)]
    return out.astype(np.float32)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Trigrams, the number of the text of each, and whether they are of slots (if all letters have one) or of code points.
    Runs of anything but letters count as one blank, also at both ends."""
    low = [t.lower() for t in texts]
    cp = code_points(" " + " ".join(low) + " ")
    there = alphabet()[cp]
    s = dense()[0][cp]
    small = not (there & (s == 0)).any()
    bits = BITS if small else WIDE
    s = s.astype(np.int32) if small else np.where(there, cp, 0).astype(np.int64)
    doc = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    doc = np.concatenate((doc, doc[-1:]))
    keep = there.copy()
    keep[1:] |= there[:-1]
    keep[0] = True
    s, doc = s[keep], doc[keep]
    if len(s) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), small
    # a blank between two texts belongs to the next one; a trigram belongs to the text of its letters
    owner = np.where(s[1:-1] > 0, doc[1:-1], -1)
    left = np.where((s[:-2] > 0) & (s[1:-1] == 0), doc[:-2], -1)
    right = np.where((s[2:] > 0) & (s[1:-1] == 0), doc[2:], -1)
    owner = np.where(owner >= 0, owner, np.where(left == right, left, -1))
    ids = (s[:-2] << (2 * bits)) | (s[1:-1] << bits) | s[2:]
    ok = owner >= 0
    return ids[ok], owner[ok], small


def profile(texts: list[str], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vector of each text, and how many trigrams it has."""
    ids, doc, small = trigrams(texts)
    if not len(ids):
        return np.zeros((len(texts), dim), np.float32), np.zeros(len(texts), np.int64)
    if small:
        seen = np.zeros(SLOTS**3, bool)
        seen[ids] = True
        own = np.flatnonzero(seen)
        at = np.zeros(SLOTS**3, np.int32)
        at[own] = np.arange(len(own))
        at = at[ids]
    else:
        own, at = np.unique(ids, return_inverse=True)
    counts = np.bincount(doc * len(own) + at, minlength=len(texts) * len(own)).reshape(len(texts), len(own))
    return counts.astype(np.float32) @ (dense_vectors if small else gram_vectors)(own, dim), counts.sum(1)


def _blocks(texts: list) -> Iterator[tuple[int, list[str]]]:
    """Chunks whose count table stays small: texts x trigrams."""
    for start, held in chunks(texts, SIZE):
        for i in range(0, len(held), 128):
            yield start + i, held[i : i + 128]


def prototypes(docs: DataFrame, text: str = "text", label: str = "lang", dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages by name, and their unit vectors, from all labelled rows."""
    arrow_batches(docs.sparkSession)
    rows = positional(docs).select(F.col(f"_{index_of(docs, text)}").alias("t"), F.col(f"_{index_of(docs, label)}").cast("string").alias("l")).where("l is not null and t is not null")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, np.ndarray] = {}  # trigrams of slots are counted and bundled at the end
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for start, held in chunks(texts, SIZE):
                ids, doc, small = trigrams(held)
                names = langs[start : start + len(held)]
                known = sorted(set(names))
                code = np.array([known.index(x) for x in names])[doc]
                for c, name in enumerate(known):
                    own = ids[code == c]
                    if small:
                        counted[name] = counted.get(name, 0) + np.bincount(own, minlength=SLOTS**3)
                    else:
                        own, n = np.unique(own, return_counts=True)
                        add(total, name, own, n, gram_vectors)
        for name, n in counted.items():
            add(total, name, np.flatnonzero(n), n[n > 0], dense_vectors)
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dim, pa.string()), pa.array(np.arange(dim), pa.int32()), pa.array(v, pa.int64())], ["l", "j", "v"])

    def add(total: dict, name: str, ids: np.ndarray, n: np.ndarray, vectors) -> None:
        for u in range(0, len(ids), 10_000):
            total[name] = total.get(name, 0) + np.rint(n[u : u + 10_000].astype(np.float64) @ vectors(ids[u : u + 10_000], dim)).astype(np.int64)

    found = rows.mapInArrow(bundle, "l string, j int, v bigint").groupBy("l", "j").agg(F.sum("v").alias("v")).toPandas()  # a vector a language
    names = sorted(set(found["l"]))
    protos = np.zeros((len(names), dim), np.float64)
    for i, name in enumerate(names):
        protos[i] = found[found["l"] == name].sort_values("j")["v"]
    norm = np.linalg.norm(protos, axis=1, keepdims=True)
    return names, (protos / np.where(norm > 0, norm, 1)).astype(np.float32)


def _nearest(texts: list[str], protos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cosines with each prototype, the best one and its cosine, and how many trigrams each text has (0: no vector)."""
    v, grams = profile(texts, protos.shape[1])
    norm = np.linalg.norm(v, axis=1)
    cos = (v @ protos.T) / np.where(norm > 0, norm, 1)[:, None]
    best = cos.argmax(1)
    return cos, best, cos[np.arange(len(texts)), best], np.where(norm > 0, grams, 0)


def _length(grams: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(grams, 1)).astype(np.int64)


def limits(docs: DataFrame, protos: np.ndarray, noise: float = NOISE, enough: int = ENOUGH, text: str = "text", label: str = "lang") -> np.ndarray:
    """Least cosine by length, from all labelled rows."""
    part = np.minimum(1, (2.0 ** np.arange(LENGTHS) / enough) ** 0.5)
    least = part * noise / (protos.shape[1] if len(protos) else DIM) ** 0.5
    if not len(protos):
        return least
    rows = positional(docs).select(F.col(f"_{index_of(docs, text)}").alias("t"), F.col(f"_{index_of(docs, label)}").alias("l")).where("l is not null and t is not null").select("t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LENGTHS * BINS, np.int64)
        for b in batches:
            for _, held in _blocks(b.column(0).to_pylist()):
                _, _, top, grams = _nearest(held, protos)
                at = _length(grams) * BINS + (np.clip(top, 0, 1) * (BINS - 1)).astype(np.int64)
                total += np.bincount(at[grams > 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    found = np.zeros(LENGTHS * BINS, np.int64)
    for at, n in rows.mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n")).collect():  # LENGTHS x BINS at most
        found[at] = n
    found = found.reshape(LENGTHS, BINS)
    known = np.flatnonzero(found.sum(1) >= FEW)
    if len(known):
        low = (found.cumsum(1) > LOW * found.sum(1)[:, None]).argmax(1) / (BINS - 1) * PART
        low = low[known[np.abs(np.arange(LENGTHS)[:, None] - known).argmin(1)]]
        least = np.where(part < 1, np.minimum(least, low), np.maximum(least, low))
    return least


def classifier(names: list[str], protos: np.ndarray, least: np.ndarray):
    """Pandas UDF: text -> (lang, cosine, margin, accepted)."""

    @F.pandas_udf("lang string, cosine double, margin double, accepted boolean")
    def classify(texts: pd.Series) -> pd.DataFrame:
        n = len(texts)
        lang, cosine, margin, good = np.full(n, None, object), np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, bool)
        if len(names):
            for start, held in _blocks(texts.tolist()):
                cos, best, top, grams = _nearest(held, protos)
                second = np.partition(cos, -2, axis=1)[:, -2] if len(names) > 1 else np.zeros(len(held))
                ok = grams > 0
                at = start + np.flatnonzero(ok)
                lang[at] = np.array(names, object)[best[ok]]
                cosine[at], margin[at] = top[ok], (top - second)[ok]
                good[at] = (top >= least[_length(grams)])[ok]
        return pd.DataFrame({"lang": lang, "cosine": [None if np.isnan(x) else round(float(x), 4) for x in cosine], "margin": [None if np.isnan(x) else round(float(x), 4) for x in margin], "accepted": good})

    return classify


def _fitted(docs: DataFrame, noise: float, dim: int):
    names, protos = prototypes(docs, dim=dim)
    return classifier(names, protos, limits(docs, protos, noise))


def identify(docs: DataFrame, noise: float = NOISE, dim: int = DIM) -> DataFrame:
    """doc_id, lang (found), cosine, margin over the second language, accepted."""
    arrow_batches(docs.sparkSession)
    classify = _fitted(docs, noise, dim)
    return pick(docs, "doc_id", "text").select("doc_id", classify("text").alias("r")).select("doc_id", "r.lang", "r.cosine", "r.margin", "r.accepted")


def accepted(docs: DataFrame, noise: float = NOISE, dim: int = DIM) -> DataFrame:
    """The rows of ``docs`` that identify() accepts, with all their columns; no join or shuffle."""
    arrow_batches(docs.sparkSession)
    classify = _fitted(docs, noise, dim)
    p = positional(docs).withColumn("_r", classify(F.col(f"_{index_of(docs, 'text')}")))
    return p.where("_r.accepted").drop("_r").toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
