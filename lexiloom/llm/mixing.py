"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, in the order of md5(doc_id), form blocks. With a source's weight w, its k-th block may not come
before slot floor((k-1)/w) and must be out by slot ceil(k/w). Earliest deadline first over the released blocks meets
every deadline (weights sum to 1, one block a slot), so at any slot each source is less than one block from its weight.

A source that runs out leaves the mix and the others go on in the ratio of their weights, so every document of a source
with a weight gets a slot: a mix is a run of phases, each with the sources that are left. A phase ends before a source
could run short; of the blocks whose windows reach beyond its end, those of the earliest release are still in it (as many
as there are slots left; that choice can always be scheduled). Tasks are frames of FRAME slots. A phase of up to FRAME
slots (16 million documents) is one, with the weights' own windows. A longer one is cut into frames whose blocks by
source are the weights' shares, rounded so that running sums stay within a block of the weights, and these numbers are
the frame's weights: a source is less than one block from them and less than two from its own weight.

``weights`` are parts of the mix by source. A source that isn't named weighs its own share of all blocks beside them, one
with weight 0 gets no slot. Without weights every source weighs its share, and all run out together.

The rank of a document in its source comes from counts by (source, hash bucket) and a rank inside the bucket, so a hot
source is spread over all tasks. Null source: a source of its own. Null doc_id: ordered as "". Repeated rows: each is
counted and placed. Ties in the hash: by doc_id. Null text: as any other. Empty table: no rows. A weight of a source
without documents: no part of the mix. Sources are a row each on the driver: more than SOURCES are an error.
Other columns are left out of schedule() and kept by mixed().
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, index_of, pick, positional, table

BLOCK, FRAME, SOURCES = 16, 1_000_000, 10_000
ROWS = 50_000  # slots in a batch
BUCKET_DIGITS = 3  # 4096 hash buckets a source
#: target weights of query() and of the pipeline: equal parts for the known sources, others beside them by their size
WEIGHTS = {f"src{i}": 0.05 for i in range(20)}


def _order(s) -> tuple:
    return (s is not None, str(s))


def target_weights(blocks: dict, weights: dict | None = None) -> dict:
    """Exact weights, by source that has blocks and a weight: the given ones, and own shares of all blocks."""
    total, given = sum(blocks.values()), weights or {}
    out = {s: Fraction(str(given[s])) if s in given else Fraction(n, total) for s, n in blocks.items() if n}
    return {s: w for s, w in out.items() if w > 0}


def whole(weights: dict) -> tuple[dict, int]:
    """Whole numbers in the very ratio of the weights, and their sum."""
    d = math.lcm(*(w.denominator for w in weights.values()))
    quota = {s: int(w * d) for s, w in weights.items()}
    common = math.gcd(*quota.values())
    return {s: q // common for s, q in quota.items()}, sum(quota.values()) // common


def phases(blocks: dict, weights: dict) -> Iterator[tuple[dict, dict, int, dict]]:
    """(exact weights, blocks before, slots, blocks in it) of each phase: as long as no source that is left runs short."""
    done, left = dict.fromkeys(weights, 0), dict(weights)
    while left:
        total = sum(left.values())
        now = {s: w / total for s, w in left.items()}
        rest = {s: blocks[s] - done[s] for s in now}
        size = min(rest[s] // w for s, w in now.items())
        here = {s: math.floor(w * size) for s, w in now.items()}
        cut = [s for s, w in now.items() if w * size != here[s]]  # a window reaches beyond the end
        cut.sort(key=lambda s: (here[s] // now[s], here[s] + 1 != rest[s], _order(s)))
        for s in cut[: size - sum(here.values())]:
            here[s] += 1
        yield now, {s: done[s] for s in now}, size, here
        for s, n in here.items():
            done[s] += n
            if n == rest[s]:
                del left[s]


def rounded(weights: dict, slots: int, least: dict, most: dict) -> dict:
    """Whole numbers that sum to ``slots``, each less than one from its weight's share where ``least`` and ``most`` let
    it, by largest remainders."""
    share = {s: w * slots for s, w in weights.items()}
    out = {s: min(most[s], max(math.floor(x), least[s])) for s, x in share.items()}
    gap = slots - sum(out.values())
    for s in sorted(share, key=lambda s: (out[s] - share[s], _order(s)), reverse=gap < 0):
        step = min(1, most[s] - out[s]) if gap > 0 else -min(1, out[s] - least[s]) if gap < 0 else 0
        out[s], gap = out[s] + step, gap - step
    assert not gap  # a frame has many times as many slots as there are sources
    return out


def frames(blocks: dict, weights: dict, size: int) -> Iterator[tuple[int, int, int, dict]]:
    """(first slot, slots, sum of quotas, {source: (first block, blocks, quota)}) of each frame."""
    at = 0
    for now, before, n, here in phases(blocks, weights):
        if n <= size:
            quota, total = whole(now)
            yield at, n, total, {s: (before[s], here[s], quota[s]) for s in now if here[s]}
        else:
            seen = dict.fromkeys(now, 0)
            for end in [*range(size, n - size, size), n]:  # the last one is of up to two sizes, so that it has room
                to = here if end == n else rounded(now, end, seen, here)
                long = end - sum(seen.values())
                yield at + end - long, long, long, {s: (before[s] + seen[s], to[s] - seen[s], to[s] - seen[s]) for s in now if to[s] > seen[s]}
                seen = to
        at += n


def frame_slots(long: int, total: int, part: dict) -> Iterator[tuple]:
    """(source, block) of each of a frame's slots, for part {source: (first block, blocks, quota)}: earliest deadline
    first among released blocks, ties by the source's order. A block that is in the frame has its deadline there."""
    names = sorted(part, key=_order)
    first, most, quota = ([part[s][i] for s in names] for i in range(3))
    waiting = [(0, i, 1) for i in range(len(names))]
    heapq.heapify(waiting)
    ready = []
    for t in range(long):
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (min(-(-k * total // quota[i]), long), i, k))
        deadline, i, k = heapq.heappop(ready)
        assert deadline > t
        yield names[i], first[i] + k - 1
        if k < most[i]:
            heapq.heappush(waiting, (k * total // quota[i], i, k + 1))


def _plan(spark, sizes: dict, weights: dict | None, block: int, frame: int) -> DataFrame:
    """(s, b, slot) of every block in the mix. A table. A frame's numbers are a row, so tasks get only their own."""
    if len(sizes) > SOURCES:
        raise ValueError(f"{len(sizes)} sources are more than {SOURCES}: mix by a column of fewer")
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    frame = max(frame, 64 * len(blocks))
    todo = [(at, long, str(total), [(s, first, n, str(q)) for s, (first, n, q) in part.items()]) for at, long, total, part in frames(blocks, target_weights(blocks, weights), frame)]
    tasks = spark.createDataFrame(todo, "at bigint, long bigint, total string, part array<struct<s: string, first: bigint, n: bigint, q: string>>").repartition(max(1, len(todo)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                mix = enumerate(frame_slots(x["long"], int(x["total"]), {y["s"]: (y["first"], y["n"], int(y["q"])) for y in x["part"]}), x["at"])
                while rows := list(itertools.islice(mix, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array([y[0] for _, y in rows], pa.string()), pa.array([y[1] for _, y in rows], pa.int64()), pa.array([t for t, _ in rows], pa.int64())], ["s", "b", "slot"])

    return table(tasks.mapInArrow(walk, "s string, b bigint, slot bigint"))


def _narrow(docs: DataFrame, *more: str) -> DataFrame:
    d = pick(docs, "doc_id", "source", *more)
    return d.select("doc_id", F.col("source").cast("string").alias("source"), *more).withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _ranked(d: DataFrame) -> DataFrame:
    """``rank`` from 0 in the source, in the order of h and doc_id, without a window over a whole source."""
    d = d.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    counts = d.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = d.withColumn("i", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id")))
    b = before.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before")
    both = inside.join(b, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return both.withColumn("rank", F.col("before") + F.col("i") - 1).drop("s", "b", "before", "i", "bucket", "h")


def _placed(d: DataFrame, weights: dict | None, block: int, frame: int) -> DataFrame:
    """d (doc_id, source, h and others) with block, slot and position in place of h."""
    sizes = {r[0]: r[1] for r in d.groupBy("source").count().limit(SOURCES + 1).collect()}  # a row a source; _plan() refuses more
    plan = _plan(d.sparkSession, sizes, weights, block, frame)
    r = _ranked(d).withColumn("block", F.floor(F.col("rank") / block).cast("bigint"))
    r = r.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    return r.withColumn("position", (F.col("slot") * block + F.col("rank") % block).cast("bigint")).drop("s", "b", "rank")


def schedule(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """doc_id, source, block (from 0 in the source), slot and position: its order in the mix. The last block of a source
    can be short, so positions can skip some numbers; they are null for a source of weight 0."""
    arrow_batches(docs.sparkSession)
    return _placed(_narrow(docs), weights, block, frame).select("doc_id", "source", "block", "slot", "position")


def mixed(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, with all their columns: partitions are ranges of positions, sorted,
    so a file or a run of files that is written from them holds the sources at their weights. Rows of sources of weight
    0 go, all others stay. Positions are worked out on ids alone; texts move to their rows' positions and to their ranges."""
    spark = docs.sparkSession
    arrow_batches(spark)
    own = table(positional(docs).withColumn("_row", F.monotonically_increasing_id()))  # rows are told apart, whatever their doc_id
    ids = own.select(F.col(f"_{index_of(docs, 'doc_id')}").alias("doc_id"), F.col(f"_{index_of(docs, 'source')}").alias("source"), F.col("_row").alias("row"))
    at = _placed(_narrow(ids, "row"), weights, block, frame).where("slot is not null").select("row", "position")
    return own.join(at, F.col("_row") == F.col("row")).drop("_row", "row").repartitionByRange("position").sortWithinPartitions("position").drop("position").toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"), WEIGHTS)
