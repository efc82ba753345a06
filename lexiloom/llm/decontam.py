"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment search.

Jaccard similarity says nothing of a short item in a long document, so documents are partitioned by size: one of up to
2^c shingles (K consecutive words) has 2^(c+1) hash bins and signs with the least shingle hash of each bin. For each size
class an item signs with the same bins, and a document is a candidate for every item with which it shares a bin's
minimum. As bins grow with the size class, a shared shingle is a document's minimum with probability of 0.79 or more at
any length, so an item of 11 shingles held in full is missed with probability under 1e-7, and one of 4 under 0.2 %.
Items of fewer than FEW shingles are looked up by all shingles of a document, so none is missed; an item of under K words
is one shingle of all its words, looked up among a document's runs of as many words. Candidates are verified by exact
containment: the share of the item's distinct shingles that the document has.

Documents are read once and never shuffled while the items' keys fit KEYS_BROADCAST; beyond that, the keys of both sides
are joined with a shuffle and candidates verified after a join with their texts.

Null or empty document: clean. Null item, or one without words: finds nothing. Null
doc_id or item_id: reported as null. Repeated rows: reported each. Very long text: signed whole. Empty table: no rows.
Ties can't arise. Other columns are left out by leaks() and kept by clean().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_batches, index_of, pick, positional, table, where_rows
from .textvec import chunks, grams, mix, shingles, words

K, CONTAINMENT = 5, 0.7
CLASSES = range(5, 40)  # size classes: 32 shingles to more than any text has
KEYS_BROADCAST = 4_000_000  # items' keys that may be sent to every executor: 64 MB
FEW = 4  # an item of fewer distinct shingles is looked up exactly
BITS = 22  # of a first screen of keys


def signatures(s: np.ndarray, doc: np.ndarray, n: int, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, size class) of the bin minima of n documents, and in class 0 of all shingles that
    the screen ``near`` has. A key is a hash of shingle and class."""
    if not len(s):
        return s, doc, doc
    h = s >> np.uint64(20)  # 44 bits; a chunk has fewer than 2^20 documents
    own = np.unique((doc.astype(np.uint64) << np.uint64(44)) | h)
    doc, h = (own >> np.uint64(44)).astype(np.int64), own & np.uint64((1 << 44) - 1)
    size = np.bincount(doc, minlength=n)
    cls = np.maximum(CLASSES[0], np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))[doc]
    place = h >> (np.uint64(44 - 1) - cls.astype(np.uint64))  # the first c+1 bits are the bin
    least = np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))
    key, at, cls = class_keys(h[least], cls[least]), doc[least], cls[least]
    if near is None:
        return key, at, cls
    some = near[h >> np.uint64(44 - BITS)]
    zero = np.zeros(some.sum(), np.int64)
    return np.concatenate((key, class_keys(h[some], zero))), np.concatenate((at, doc[some])), np.concatenate((cls, zero))


def class_keys(h44: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return mix(h44 ^ (cls.astype(np.uint64) << np.uint64(50)))


def item_keys(own: np.ndarray) -> np.ndarray:
    """Keys of an item's distinct shingles in every size class; of a few shingles, all in class 0."""
    h = np.unique(own >> np.uint64(20))
    if len(h) < FEW:
        return class_keys(h, np.zeros(len(h), np.int64))
    out = []
    for c in CLASSES:
        place = h >> np.uint64(43 - c)
        least = np.concatenate(([True], place[1:] != place[:-1]))
        out.append(class_keys(h[least], np.full(least.sum(), c)))
    return np.concatenate(out)


def screen(prefixes: np.ndarray) -> np.ndarray | None:
    """Which prefixes of BITS bits the shingles of items of few shingles have; None if there are none."""
    if not len(prefixes):
        return None
    near = np.zeros(1 << BITS, bool)
    near[prefixes] = True
    return near


class Index:
    """Items' shingles and keys for the search within a Python worker."""

    def __init__(self, ids: list, parts: list[np.ndarray], lengths: list[int], k: int):
        self.ids, self.parts = ids, parts
        keys = [item_keys(p) if n == k else p[:0] for p, n in zip(parts, lengths)]
        self.key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        self.item = np.repeat(np.arange(len(parts)), [len(k) for k in keys])
        order = np.argsort(self.key, kind="stable")
        self.key, self.item = self.key[order], self.item[order]
        few = [p for p, n in zip(parts, lengths) if n == k and len(np.unique(p >> np.uint64(20))) < FEW]
        self.near = screen(np.concatenate(few) >> np.uint64(64 - BITS)) if few else None
        self.bits = BITS
        self.screen = np.zeros(1 << self.bits, bool)
        self.screen[self.key >> np.uint64(64 - self.bits)] = True
        self.short = {}  # number of words: sorted hashes of the items of as many, and the items
        for n in sorted(set(lengths) - {k}):
            item = np.array([i for i, x in enumerate(lengths) if x == n])
            known = np.array([parts[i][0] for i in item])
            order = np.argsort(known, kind="stable")
            self.short[n] = (known[order], item[order])

    def search(self, texts: list, k: int, least: float) -> Iterator[tuple[int, int, float]]:
        """(number of the text, number of the item, containment)."""
        for start, held in chunks(texts):
            h, of = words(held)
            s, doc = shingles(h, of, k)
            key, at, _ = signatures(s, doc, len(held), self.near)
            some = self.screen[key >> np.uint64(64 - self.bits)]
            for pair in _meet(key[some], at[some], self.key, self.item, len(self.ids)):
                d, i = divmod(pair, len(self.ids))
                u, v = np.searchsorted(doc, [d, d + 1])
                share = np.isin(self.parts[i], s[u:v]).mean()
                if share >= least:
                    yield start + d, i, float(share)
            for n, (known, item) in self.short.items():
                for pair in _meet(*grams(h, of, n, k), known, item, len(self.ids)):
                    yield start + pair // len(self.ids), pair % len(self.ids), 1.0


def _meet(key: np.ndarray, at: np.ndarray, known: np.ndarray, item: np.ndarray, items: int) -> list[int]:
    """Pairs of a document and an item (document * items + item) that share a key; known is sorted."""
    lo = np.searchsorted(known, key, "left")
    some = known[np.minimum(lo, len(known) - 1)] == key if len(known) else np.zeros(len(key), bool)
    key, at, lo = key[some], at[some], lo[some]
    n = np.searchsorted(known, key, "right") - lo
    which = np.repeat(np.arange(len(key)), n)
    own = item[lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
    return np.unique(at[which] * items + own).tolist()


def item_shingles(items: DataFrame, k: int = K) -> DataFrame:
    """item_id, its distinct shingles, and their words: k, or all words of a shorter item."""
    own = pick(items, "item_id", "text")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, parts, size = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                h, d = words([t or ""])
                if len(h):
                    at.append(i)
                    parts.append(np.unique(shingles(h, d, k)[0]).view(np.int64))
                    size.append(min(len(h), k))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(parts, pa.list_(pa.int64())), pa.array(size, pa.int32())], ["item_id", "q", "n"])

    return own.mapInArrow(cut_up, T.StructType([T.StructField("item_id", own.schema["item_id"].dataType), T.StructField("q", T.ArrayType(T.LongType())), T.StructField("n", T.IntegerType())]))


def _index(items: DataFrame, k: int, limit: int):
    """(broadcast Index or None, items' shingles): the index only if its size, which is checked first, allows."""
    q = table(item_shingles(items, k))
    total = q.agg(F.sum(F.size("q"))).first()[0] or 0
    if total * len(CLASSES) > limit:
        return None, q
    rows = q.collect()
    return q.sparkSession.sparkContext.broadcast(Index([r[0] for r in rows], [np.array(r[1], np.int64).view(np.uint64) for r in rows], [r[2] for r in rows], k)), q


def leaks(docs: DataFrame, items: DataFrame, k: int = K, containment: float = CONTAINMENT, limit: int = KEYS_BROADCAST) -> DataFrame:
    """doc_id, item_id, containment of every document that holds an item."""
    arrow_batches(docs.sparkSession)
    own = pick(docs, "doc_id", "text")
    index, q = _index(items, k, limit)
    doc_type, item_type = own.schema["doc_id"].dataType, q.schema["item_id"].dataType
    if index is None:
        return _joined(own, q, k, containment)
    out = T.StructType([T.StructField("doc_id", doc_type), T.StructField("item_id", item_type), T.StructField("containment", T.DoubleType())])

    id_type = to_arrow_type(item_type)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        ids = pa.array(known.ids, id_type)
        for b in batches:
            hits = list(known.search(b.column(1).to_pylist(), k, containment))
            d, i, c = zip(*hits) if hits else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d, pa.int64())), ids.take(pa.array(i, pa.int64())), pa.array([round(x, 6) for x in c], pa.float64())], ["doc_id", "item_id", "containment"])

    return own.mapInArrow(find, out)


def _joined(own: DataFrame, q: DataFrame, k: int, containment: float) -> DataFrame:
    """leaks() for more items than can be broadcast: keys meet in a shuffle, candidates meet their texts in another."""
    doc_type, item_type = own.schema["doc_id"].dataType, q.schema["item_id"].dataType
    own = table(own.withColumn("row", F.monotonically_increasing_id()))  # rows are told apart, whatever their doc_id
    q = table(q.withColumn("item", F.monotonically_increasing_id()))

    lengths = sorted(r[0] for r in q.where(F.col("n") < k).select("n").distinct().collect())  # k at most
    few = q.where(F.size("q") < FEW).select(F.explode("q").alias("x")).select(F.shiftrightunsigned("x", 64 - BITS).alias("p")).distinct()
    near = screen(np.array([r[0] for r in few.toLocalIterator()], np.int64))  # 2^BITS rows at most

    def doc_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1).to_numpy()
            for start, held in chunks(b.column(0).to_pylist()):
                h, of = words(held)
                key, at, _ = signatures(*shingles(h, of, k), len(held), near)
                for n in lengths:
                    s, doc = grams(h, of, n, k)
                    own_key = s >> np.uint64(20)
                    some = near[own_key >> np.uint64(44 - BITS)]
                    key, at = np.concatenate((key, class_keys(own_key[some], np.zeros(some.sum(), np.int64)))), np.concatenate((at, doc[some]))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rows[start + at])], ["key", "row"])

    def keys_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own_q, item in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key = item_keys(np.array(own_q, np.int64).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), item))], ["k", "item"])

    left = own.select("text", "row").mapInArrow(doc_keys, "key bigint, row bigint")
    right = q.select("q", "item").mapInArrow(keys_of_items, "k bigint, item bigint")
    pairs = table(left.join(right, F.col("key") == F.col("k")).select("row", "item").distinct())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            share = []
            for t, x, n in zip(b.column("text").to_pylist(), b.column("q").to_pylist(), b.column("n").to_pylist()):
                share.append(np.isin(np.array(x, np.int64).view(np.uint64), grams(*words([t]), n, k)[0]).mean())
            held = pa.array(np.flatnonzero(np.array(share) >= containment))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(held), b.column("item_id").take(held), pa.array([round(float(share[i]), 6) for i in held.to_pylist()], pa.float64())], ["doc_id", "item_id", "containment"])

    both = own.join(pairs, "row").join(q, "item").select("doc_id", "item_id", "text", "q", "n")
    out = T.StructType([T.StructField("doc_id", doc_type), T.StructField("item_id", item_type), T.StructField("containment", T.DoubleType())])
    return both.mapInArrow(verify, out)


def clean(docs: DataFrame, items: DataFrame, k: int = K, containment: float = CONTAINMENT, limit: int = KEYS_BROADCAST) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; no join while the items can be broadcast."""
    arrow_batches(docs.sparkSession)
    index, q = _index(items, k, limit)
    if index is None:
        numbered = table(positional(docs).withColumn("_row", F.monotonically_increasing_id()))
        bad = table(_joined(numbered.select(F.col("_row").alias("doc_id"), F.col(f"_{index_of(docs, 'text')}").alias("text")), q, k, containment).select(F.col("doc_id").alias("_bad")).distinct())
        return numbered.join(bad, F.col("_row") == F.col("_bad"), "left_anti").drop("_row").toDF(*docs.columns)

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), bool)
        for d, _, _ in index.value.search(texts.tolist(), k, containment):
            out[d] = True
        return pd.Series(out)

    return where_rows(docs, ["text"], lambda text: ~holds(text))


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sql(docs: str = "documents", items: str = "benchmark", k: int = K, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL for leaks(): exact containment of every item in every document."""
    word = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')"
    return f"""WITH iw AS (SELECT item_id, row_number() OVER () AS item, {word} AS w, least(len(w), {k}) AS j FROM {items} WHERE text IS NOT NULL),
ish AS (SELECT DISTINCT item, item_id, j, array_to_string(w[i:i + j - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - j + 2)) AS i FROM iw WHERE j > 0)),
n AS (SELECT item, count(*) AS n FROM ish GROUP BY item),
dw AS (SELECT doc_id, row_number() OVER () AS d, {word} AS w FROM {docs} WHERE text IS NOT NULL),
dsh AS (SELECT DISTINCT d, doc_id, j, array_to_string(w[i:i + j - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - j + 2)) AS i FROM dw, (SELECT DISTINCT j FROM ish) WHERE len(w) >= j))
SELECT doc_id, item_id, round(count(*) / any_value(n.n), 6) AS containment
FROM ish JOIN dsh USING (j, s) JOIN n USING (item) GROUP BY d, doc_id, item, item_id HAVING count(*) / any_value(n.n) >= {containment}"""
