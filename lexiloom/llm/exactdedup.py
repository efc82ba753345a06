"""Exact dedup against immutable snapshots, screened by static binary-fuse filters.

A snapshot is an earlier batch that doesn't change any more. Its digests are split into buckets by hash, and each bucket
gets a static 3-wise binary-fuse filter of 8-bit fingerprints, built once and kept with it: write_snapshot() stores rows,
digests and filters, read_snapshot() loads them, and a batch can meet any number of snapshots. Incoming digests, each
once, meet only the filter of their bucket. What a filter passes joins the snapshot's exact bucket by digest, and the
texts themselves are compared; what it doesn't pass is new. New texts that repeat within their own batch are grouped
apart, also down to the text.

Copies are counted with partial sums before anything moves, so a text that a third of all rows have is one row a task; its
rows meet the verdict by a broadcast of the digests that more than a thousandth of all rows have (a thousand at most).

Null text: never a copy of anything. Empty text: a text as any other. Null doc_id: a row of its own; it may be a copy,
but the copies' keeper is the least doc_id that isn't null. Repeated rows: each is listed. Ties can't arise, as
doc_id orders the keepers. Empty table, empty snapshot or batch: no rows, or none screened. Other columns are left out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, pick, shared_dir, table
from .textvec import mix

DIGESTS_A_BUCKET = 20_000  # a filter of some 25 kB
FILTER_DIGESTS = 8_000_000  # repeated digests that may be sent as one filter: 9 MB
SCREENED = 1_000_000  # incoming digests that are tested with one filter at once
HOT = 1000  # a digest of more than so large a part of all rows is hot


def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Three places in consecutive segments, and the fingerprint."""
    with np.errstate(over="ignore"):
        h = mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        g = mix(h)
    start = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    mask = np.uint64(segment - 1)
    a = start * segment + (h & mask).astype(np.int64)
    b = (start + 1) * segment + ((g >> np.uint64(20)) & mask).astype(np.int64)
    c = (start + 2) * segment + ((g >> np.uint64(40)) & mask).astype(np.int64)
    return a, b, c, (g & np.uint64(255)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, number of segments, fingerprints) of a filter that holds all these 64-bit keys."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    segments = max(1, int(np.ceil(n * factor / segment)) - 2)
    for seed in range(1, 1000):
        a, b, c, f = _places(keys, seed, segment, segments)
        size = (segments + 2) * segment
        cells = np.stack((a, b, c), 1)
        count = np.bincount(cells.ravel(), minlength=size)
        acc = np.zeros(size, np.int64)  # xor of the keys at a cell
        np.bitwise_xor.at(acc, cells.ravel(), np.repeat(np.arange(n), 3))
        alive, rounds = np.ones(n, bool), []
        while True:  # peel all cells with one key at a time
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            key, first = np.unique(acc[single], return_index=True)
            rounds.append((key, single[first]))
            alive[key] = False
            gone = cells[key].ravel()
            np.subtract.at(count, gone, 1)
            np.bitwise_xor.at(acc, gone, np.repeat(key, 3))
        if not alive.any():
            out = np.zeros(size, np.uint8)
            for key, cell in reversed(rounds):
                x = f[key] ^ out[a[key]] ^ out[b[key]] ^ out[c[key]]
                out[cell] = x ^ out[cell]
            return seed, segment, segments, out.tobytes()
        if seed % 10 == 0:
            segments += max(1, segments // 20)
    raise RuntimeError("no seed worked")


def contains(filter_: tuple[int, int, int, bytes], keys: np.ndarray) -> np.ndarray:
    seed, segment, segments, data = filter_
    a, b, c, f = _places(keys.astype(np.uint64), seed, segment, segments)
    cells = np.frombuffer(data, np.uint8)
    return (cells[a] ^ cells[b] ^ cells[c]) == f


def snapshot_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """(bucket, seed, segment, segments, data) from column ``k``: one filter a bucket."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, data = build(pdf["k"].to_numpy().view(np.uint64))
        return pd.DataFrame([(pdf["bucket"].iloc[0], seed, segment, segments, data)], columns=["bucket", "seed", "segment", "segments", "data"])

    return digests.select(F.pmod("k", F.lit(buckets)).alias("bucket"), "k").groupBy("bucket").applyInPandas(make, "bucket bigint, seed int, segment int, segments int, data binary")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int, salts: int = 1) -> DataFrame:
    """Distinct (digest, k) that the filter of the key's bucket holds. A bucket's keys are split by ``salts``."""

    def test(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = rows[["digest", "k"]]
        if not len(own) or not len(rows):
            return rows[:0]
        x = own.iloc[0]
        return rows[contains((int(x["seed"]), int(x["segment"]), int(x["segments"]), x["data"]), rows["k"].to_numpy().view(np.uint64))]

    keyed = incoming.select("digest", "k", F.pmod("k", F.lit(buckets)).alias("bucket"), F.pmod(F.xxhash64("k"), F.lit(salts)).alias("salt"))
    each = filters.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)]).cast("array<bigint>")))
    return keyed.groupBy("bucket", "salt").cogroup(each.groupBy("bucket", "salt")).applyInPandas(test, "digest binary, k bigint")


def _digests(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text").alias("k"))


@dataclass(frozen=True)
class Snapshot:
    """rows (doc_id, text), store (digest, k, n: each digest and its rows), filters by bucket."""

    rows: DataFrame
    store: DataFrame
    filters: DataFrame
    buckets: int


def write_snapshot(docs: DataFrame, path: str, digests_a_bucket: int = DIGESTS_A_BUCKET) -> Snapshot:
    """Stores a batch (columns doc_id, text) as a snapshot at ``path``; its filters are built once, here."""
    arrow_batches(docs.sparkSession)
    own = pick(docs, "doc_id", "text")
    own.write.parquet(f"{path}/rows")
    return _finished(docs.sparkSession.read.schema(own.schema).parquet(f"{path}/rows"), path, digests_a_bucket)


def _finished(rows: DataFrame, path: str, digests_a_bucket: int) -> Snapshot:
    spark = rows.sparkSession
    _digests(rows).groupBy("digest").agg(F.min("k").alias("k"), F.count("*").alias("n")).write.parquet(f"{path}/store")
    store = spark.read.schema(STORE).parquet(f"{path}/store")
    buckets = max(1, -(-store.count() // digests_a_bucket))
    snapshot_filters(store, buckets).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/filters")
    return Snapshot(rows, store, spark.read.schema(FILTERS).parquet(f"{path}/filters"), buckets)


STORE = "digest binary, k bigint, n bigint"
FILTERS = "bucket bigint, seed int, segment int, segments int, data binary, buckets int"


def read_snapshot(spark, path: str) -> Snapshot:
    """What write_snapshot() stored; no filter is built again."""
    filters = spark.read.schema(FILTERS).parquet(f"{path}/filters")
    first = filters.select("buckets").first()
    return Snapshot(spark.read.parquet(f"{path}/rows"), spark.read.schema(STORE).parquet(f"{path}/store"), filters, first[0] if first else 1)


def dedup(snapshot: DataFrame, batch: DataFrame, digests_a_bucket: int = DIGESTS_A_BUCKET, filter_digests: int = FILTER_DIGESTS) -> DataFrame:
    """doc_id, keep_id, kind for the rows of both tables (columns doc_id, text).

    kind: 'kept', 'copy_of_snapshot' (a batch text that the snapshot has) or 'copy_in_batch' (a text that an earlier row
    of the same table has, with no copy in the snapshot). keep_id: the doc_id that stays for this text.
    """
    arrow_batches(batch.sparkSession)
    path = f"{shared_dir(batch.sparkSession).rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    return _judged([_finished(pick(snapshot, "doc_id", "text"), path, digests_a_bucket)], batch, filter_digests, True)


def against(snapshots: list[Snapshot], batch: DataFrame, filter_digests: int = FILTER_DIGESTS) -> DataFrame:
    """As dedup(), for the rows of a batch alone; a text's keeper is in the first snapshot that has it."""
    arrow_batches(batch.sparkSession)
    return _judged(snapshots, batch, filter_digests, False)


def _judged(snapshots: list[Snapshot], batch: DataFrame, filter_digests: int, all_rows: bool) -> DataFrame:
    new, last = pick(batch, "doc_id", "text"), len(snapshots)
    fresh = table(_digests(new).groupBy("digest").agg(F.min("k").alias("k"), F.count("*").alias("n")))
    n_fresh = fresh.count()
    repeated = fresh.where("n > 1").select("digest", "k")
    for x in snapshots:
        maybe = screen(fresh, x.filters, x.buckets, -(-n_fresh // (x.buckets * SCREENED)) or 1)
        repeated = repeated.unionByName(maybe.join(x.store.select("digest"), "digest", "left_semi"))
        if all_rows:
            repeated = repeated.unionByName(x.store.where("n > 1").select("digest", "k"))
    repeated = table(repeated.distinct())
    # byte check: only texts whose digest repeats move, each once a task; copies are equal texts, whatever the digests say
    rows = new.withColumn("age", F.lit(last))
    for i, x in enumerate(snapshots):
        rows = rows.unionByName(x.rows.withColumn("age", F.lit(i)))
    suspects, alone = _split(rows.withColumn("k", F.xxhash64("text")), repeated, filter_digests)
    suspects = suspects.withColumn("digest", F.unhex(F.sha2("text", 256)))
    groups = suspects.groupBy("digest", "text").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("age", "doc_id")))["doc_id"].alias("keep"), F.min("age").alias("oldest"), F.count("*").alias("n")
    )
    groups = table(groups.withColumn("h", F.xxhash64("text")))
    clash = table(groups.groupBy("digest").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).where("texts > 1").select("digest"))  # one digest, several texts
    listed = suspects if all_rows else suspects.where(F.col("age") == last)
    verdicts = groups.join(clash, "digest", "left_anti").select("digest", "keep", "oldest", "n")
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(verdicts.where(F.col("n") > total / HOT).drop("n"))  # HOT rows at most
    narrow = listed.select("doc_id", "age", "digest")
    cold = narrow.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    apart = listed.join(clash, "digest", "left_semi").join(groups.select("digest", "text", "keep", "oldest"), ["digest", "text"])
    columns = ("doc_id", "age", "keep", "oldest")
    out = narrow.join(hot, "digest").select(*columns).unionByName(cold.join(verdicts.where(F.col("n") <= total / HOT), "digest").select(*columns)).unionByName(apart.select(*columns))
    alone = alone if all_rows else alone.where(F.col("age") == last)
    out = out.unionByName(alone.select("doc_id", "age", F.col("doc_id").alias("keep"), F.col("age").alias("oldest")))
    stays = F.col("keep").isNull() | ((F.col("keep").eqNullSafe(F.col("doc_id"))) & (F.col("oldest") == F.col("age")))
    return out.select(
        "doc_id",
        F.coalesce("keep", "doc_id").alias("keep_id"),
        F.when(stays, "kept").when((F.col("age") == last) & (F.col("oldest") < last), "copy_of_snapshot").otherwise("copy_in_batch").alias("kind"),
    )


def _split(rows: DataFrame, repeated: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows with text whose digest may be among ``repeated``, and the others. Up to ``most`` digests, a fuse filter of
    them (9 bits each) goes to the executors and no text moves for this; beyond, a join by key tells them apart."""
    if repeated.count() <= most:
        keys = np.array([r[0] for r in repeated.select("k").toLocalIterator()], np.int64).view(np.uint64)
        sent = rows.sparkSession.sparkContext.broadcast(build(keys) if len(keys) else None)

        @F.pandas_udf("boolean")
        def repeats(k: pd.Series) -> pd.Series:
            return pd.Series(contains(sent.value, k.to_numpy().view(np.uint64)) if sent.value else np.zeros(len(k), bool))

        marked = rows.withColumn("again", repeats("k") & F.col("text").isNotNull())
        return marked.where("again").drop("again", "k"), marked.where("not again").drop("again", "text", "k")
    held = repeated.select(F.col("k").alias("rk")).distinct()
    again = (F.col("k") == F.col("rk")) & F.col("text").isNotNull()
    return rows.join(held, again, "left_semi").drop("k"), rows.join(held, again, "left_anti").drop("text", "k")


def query(spark, sf_dir: str) -> DataFrame:
    """The lower half of the doc_ids is the snapshot, all else the incoming batch."""
    arrow_batches(spark)
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    ends = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    mid = 0 if ends[0] is None else (ends[0] + ends[1] + 1) // 2
    return dedup(docs.where(F.col("doc_id") < mid), docs.where(F.coalesce(F.col("doc_id") >= mid, F.lit(True))))


SQL = """WITH m AS (SELECT (min(doc_id) + max(doc_id) + 1) // 2 AS mid FROM documents),
k AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS keep FROM documents)
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE coalesce(keep, doc_id) END AS keep_id,
  CASE WHEN text IS NULL OR keep IS NULL OR doc_id IS NOT DISTINCT FROM keep THEN 'kept'
       WHEN coalesce(doc_id >= mid, TRUE) AND keep < mid THEN 'copy_of_snapshot' ELSE 'copy_in_batch' END AS kind
FROM k, m"""
