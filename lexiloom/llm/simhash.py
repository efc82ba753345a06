"""Near-duplicate documents by SimHash and a binary-trie self-join.

A document's fingerprint has 128 bits: each distinct word votes with the bits of its hash. Two documents are near copies
if at most ``budget`` bits differ, and groups are the connected components of that.

The join descends a binary trie with itself: a pair of nodes holds the differing bits so far, and is dropped as soon as
they exceed what the depth allows. If two fingerprints differ in at most K of 128 bits, cut into K + 1 blocks of 5 or 6
bits, then they can be rotated to start at some block so that for every l the first l blocks differ in under l bits (the
cycle lemma, i.e. the pigeonhole principle on a ring). So K + 1 rotated tries, with a budget that grows along the path,
find every pair within K, and node pairs are pruned near the roots already; nothing is approximate.

The tries' top levels are the unit of distribution. In its first block a pair agrees, so a fingerprint goes to one node a
rotation: 23 rows. Where a node has more than NODE fingerprints, by a count of all, it is split by the next block, or the
next two, and a fingerprint goes to every pair of sub-nodes that the budget allows there (7 and 64 rows a rotation). Rows
are 23 a fingerprint up to some 20 million fingerprints of even prefixes, 161 up to a billion and 1,472 beyond.

Within a task only a spanning forest of the pairs found is kept, and node pairs whose fingerprints are all of one group
already aren't compared, so groups of thousands give no quadratic output.

Null, empty or wordless text: a document of its own, never a copy. Null doc_id: not compared, a document of its own.
Repeated rows of one doc_id stay or go together. Ties: the least doc_id of a group is kept. Very long text: all its
words count. Empty table: no rows. Other columns are left out by groups() and kept by dedup().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, components, pick, table, without_ids
from .textvec import chunks, mix, words

BUDGET = 22  # of 128 bits
NODE = 500_000  # fingerprints that a node of a trie may have before it is split
TOP = (6, 12, 18)  # bits of a split at most
LEAF, FRONT = 64, 400_000  # pairs of leaves compared at once; node pairs expanded at once
LANES = np.uint64(0x0101010101010101)


def fingerprints(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, high 64 bits, low 64 bits) of the texts that have words."""
    at, high, low = [], [], []
    for start, held in chunks(texts):
        h, doc = words(held)
        if not len(h):
            continue
        key = np.unique((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))  # a chunk has fewer than 2^20 texts
        doc, h = (key >> np.uint64(44)).astype(np.int64), mix(key & np.uint64((1 << 44) - 1))
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        size = np.diff(np.append(first, len(doc)))
        # lanes of 8 bits hold the votes of up to 255 words; longer documents are cut into parts and added up
        parts = -(-size // 255)
        begin = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        owner = np.cumsum(parts) - parts
        out = []
        for x in (h, mix(h)):
            bits = np.zeros((len(first), 64), bool)
            for s in range(8):
                votes = np.add.reduceat((x >> np.uint64(s)) & LANES, begin).view(np.uint8).reshape(-1, 8)
                total = np.add.reduceat(votes.astype(np.int32), owner, axis=0)
                bits[:, s::8] = 2 * total > size[:, None]
            out.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel())
        at.append(start + doc[first])
        high.append(out[0])
        low.append(out[1])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(at), np.concatenate(high), np.concatenate(low)


def rotate(high: np.ndarray, low: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit words turned left."""
    if by >= 64:
        high, low, by = low, high, by - 64
    if not by:
        return high, low
    a, b = np.uint64(by), np.uint64(64 - by)
    return (high << a) | (low >> b), (low << a) | (high >> b)


def blocks(budget: int = BUDGET) -> list[int]:
    """Widths of the blocks that the 128 bits are cut into."""
    n = min(budget + 1, 128)
    return [(i + 1) * 128 // n - i * 128 // n for i in range(n)]


def turns(budget: int = BUDGET) -> list[int]:
    """Bits by which each rotation is turned."""
    return np.cumsum([0, *blocks(budget)[:-1]]).tolist()


def limits(turn: int = 0, budget: int = BUDGET) -> np.ndarray:
    """Differing bits allowed at each depth 0 to 128 of a rotation."""
    w = blocks(budget)
    begun = np.concatenate(([0], np.repeat(np.arange(1, len(w) + 1), w[turn:] + w[:turn])))
    return begun * budget // len(w)


def tops(turn: int, budget: int = BUDGET) -> list[int]:
    """Depths at which a rotation's trie can be split."""
    w = blocks(budget)
    return [min(d, most) for d, most in zip(np.cumsum([*w[turn:], *w[:turn]][:3]).tolist(), TOP)]


def patterns(depth: int, turn: int = 0, budget: int = BUDGET) -> list[int]:
    """Differences of two prefixes of ``depth`` bits that the budget allows on the whole way down."""
    most, found = limits(turn, budget), [0]
    for d in range(1, depth + 1):
        found = [y for x in found for y in (2 * x, 2 * x + 1) if y.bit_count() <= most[d]]
    return found


class Forest:
    """Components of n nodes; pairs are taken in as they are found, and kept no longer than until there are many."""

    def __init__(self, n: int):
        self.label, self.held, self.many = np.arange(n), [], 0
        self.change = self.label

    def take(self, i: np.ndarray, j: np.ndarray) -> None:
        self.held.append((i, j))
        self.many += len(i)
        if self.many > max(20_000, len(self.label) // 4):
            self.settle()

    def settle(self) -> np.ndarray:
        """The least member of each node's component."""
        if self.many:
            i, j = (np.concatenate(x) for x in zip(*self.held))
            self.label = roots(len(self.label), self.label[i], self.label[j])[self.label]
            self.change = np.cumsum(np.concatenate(([0], self.label[1:] != self.label[:-1])))
        self.held, self.many = [], 0
        return self.label

    def apart(self, a0, a1, b0, b1) -> np.ndarray:
        """Whether ranges of nodes aren't all of one component, as far as it is known."""
        c, x = self.change, self.label
        return (c[a0] != c[a1 - 1]) | (c[b0] != c[b1 - 1]) | (x[a0] != x[b0])


def trie_pairs(ah, al, bh, bl, same: bool, depth: int, spent: int, turn: int = 0, budget: int = BUDGET, forest: Forest | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of pairs within the budget, from two sorted arrays whose members share ``depth`` bits each, ``spent`` of
    which differ; with ``same`` the arrays are one, and each pair comes once. Pairs that ``forest`` (over the nodes of the
    first array and, unless they are one, of the second after them) has in one component can be left out."""
    most, shift = limits(turn, budget), 0 if same else len(ah)
    if not len(ah) or not len(bh):
        return
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def counted(level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in ones:
            s = np.uint64(63 - level % 64)
            a = np.concatenate(([0], np.cumsum(((ah if level < 64 else al) >> s) & np.uint64(1)))).astype(np.int64)
            ones[level] = (a, a if same else np.concatenate(([0], np.cumsum(((bh if level < 64 else bl) >> s) & np.uint64(1)))).astype(np.int64))
        return ones[level]

    def compare(a0, a1, b0, b1):
        rows = a1 - a0
        i = np.repeat(a0 - (np.cumsum(rows) - rows), rows) + np.arange(rows.sum())
        wide, start = np.repeat(b1 - b0, rows), np.repeat(b0, rows)
        left = ah[i]
        found_i, found_j = [], []
        for k in range(int(wide.max(initial=0))):  # the k-th partner of each row
            if k:
                more = np.flatnonzero(wide > k)
                i, wide, start, left = i[more], wide[more], start[more], left[more]
            j = start + k
            close = np.flatnonzero(np.bitwise_count(left ^ bh[j]) <= budget)
            if len(close):
                x, y = i[close], j[close]
                near = np.bitwise_count(ah[x] ^ bh[y]).astype(np.int16) + np.bitwise_count(al[x] ^ bl[y]) <= budget
                if same:
                    near &= x < y
                found_i.append(x[near])
                found_j.append(y[near])
        if not found_i:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_i), np.concatenate(found_j)

    def batches(x):
        """Node pairs whose leaf pairs together are few enough for memory."""
        n = np.cumsum((x[1] - x[0]) * (x[3] - x[2]))
        cuts = [0, *(np.searchsorted(n, np.arange(1, int(n[-1]) // (8 * FRONT) + 1) * 8 * FRONT) + 1), len(n)] if len(n) else [0, 0]
        for u, v in zip(cuts[:-1], cuts[1:]):
            if v > u:
                yield [y[u:v] for y in x[:4]]

    one = lambda v: np.array([v], np.int64)
    stack = [(depth, [one(0), one(len(ah)), one(0), one(len(bh)), one(spent)])]
    while stack:
        level, front = stack.pop()
        if forest is not None and forest.change[-1] < len(forest.label) - 1:
            new = forest.apart(front[0], front[1], front[2] + shift, front[3] + shift)
            front = [x[new] for x in front]
        a0, a1, b0, b1, d = front
        done = ((a1 - a0) * (b1 - b0) <= LEAF) | (level == 128)
        for part in batches([x[done] for x in front]):
            yield compare(*part)
        if done.all():
            continue
        a0, a1, b0, b1, d = (x[~done] for x in front)
        ca, cb = counted(level)
        am, bm = a1 - (ca[a1] - ca[a0]), b1 - (cb[b1] - cb[b0])
        twin = np.zeros(len(a0), bool) if not same else (a0 == b0) & (a1 == b1)
        children = [(a0, am, b0, bm, d, None), (am, a1, bm, b1, d, None), (a0, am, bm, b1, d + 1, None), (am, a1, b0, bm, d + 1, twin)]
        kept = []
        for x0, x1, y0, y1, e, never in children:
            ok = (x1 > x0) & (y1 > y0) & (e <= most[level + 1])
            if never is not None:
                ok &= ~never  # the mirror image of the pair before
            kept.append([v[ok] for v in (x0, x1, y0, y1, e)])
        merged = [np.concatenate(v) for v in zip(*kept)]
        for u in reversed(range(0, len(merged[0]), FRONT)):  # a node with itself before others: they can be one group then
            stack.append((level + 1, [v[u : u + FRONT] for v in merged]))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each of n nodes' components."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, label[i], m)
        np.minimum.at(new, label[j], m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(group: pa.Table, budget: int) -> pa.Table:
    """Edges that join the near copies below one pair of nodes."""
    node = int(group.column("node")[0].as_py())
    turn, level, p, q = node >> 38, (node >> 36) & 3, (node >> 18) & 0x3FFFF, node & 0x3FFFF
    depth = tops(turn, budget)[level]
    high, low = (group.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    shift = 0 if p == q else int(np.searchsorted(high >> np.uint64(64 - depth), np.uint64(q)))
    forest = Forest(len(high))
    ah, al = (high, low) if p == q else (high[:shift], low[:shift])
    for i, j in trie_pairs(ah, al, high[shift:], low[shift:], p == q, depth, (p ^ q).bit_count(), turn, budget, forest):
        if len(i):
            forest.take(i, j + shift)
    root = forest.settle()
    member = np.flatnonzero(root != np.arange(len(high)))
    return pa.table({"a": group.column("rep").take(pa.array(order[member])), "b": group.column("rep").take(pa.array(order[root[member]]))})


def _prefixes(batch: pa.RecordBatch, budget: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the rotation, high, low) of a batch (high, low, ...)."""
    h, lo = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))
    for turn, by in enumerate(turns(budget)):
        yield turn, *rotate(h, lo, by)


def levels(unique: DataFrame, most: int = NODE, budget: int = BUDGET) -> np.ndarray:
    """How deep each first node of each rotation is split (0 to 2), from the true counts of nodes."""
    out = np.zeros((len(turns(budget)), 1 << TOP[0]), np.int8)
    for level in range(len(TOP)):
        now = out.copy()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for b in batches:
                for turn, x, _ in _prefixes(b, budget):
                    first, depth = tops(turn, budget)[0], tops(turn, budget)[level]
                    at = (x >> np.uint64(64 - depth)).astype(np.int64)
                    if level:
                        at = at[now[turn, at >> (depth - first)] == level]
                    found[turn] = found.get(turn, 0) + np.bincount(at, minlength=1 << depth)
            for turn, n in found.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), turn)), pa.array(at >> (tops(turn, budget)[level] - tops(turn, budget)[0])), pa.array(at), pa.array(n[at])], ["turn", "first", "node", "n"])

        full = unique.select("high", "low").mapInArrow(count, "turn bigint, first bigint, node bigint, n bigint").groupBy("turn", "first", "node").agg(F.sum("n").alias("n")).where(F.col("n") > most)
        for turn, first in full.select("turn", "first").distinct().collect():  # first nodes: 64 a rotation at most
            out[turn, first] = min(level + 1, len(TOP) - 1)
        if (out == now).all() or level + 2 == len(TOP):
            break
    return out


def edges(unique: DataFrame, n: int, budget: int = BUDGET, most: int = NODE) -> DataFrame:
    """Edges (a, b) of a spanning forest of the near copies among n distinct fingerprints (high, low, rep)."""
    deep = levels(unique, most, budget) if n > most else np.zeros((len(turns(budget)), 1 << TOP[0]), np.int8)
    kind = unique.schema["rep"].dataType
    allowed = [[patterns(d, turn, budget) for d in tops(turn, budget)] for turn in range(len(turns(budget)))]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for turn, x, y in _prefixes(b, budget):
                first = tops(turn, budget)[0]
                level_of = deep[turn, (x >> np.uint64(64 - first)).astype(np.int64)]
                for level in np.unique(level_of).tolist():
                    at = np.flatnonzero(level_of == level)
                    own = (x[at] >> np.uint64(64 - tops(turn, budget)[level])).astype(np.int64)
                    columns = [pa.array(x[at].view(np.int64)), pa.array(y[at].view(np.int64)), b.column(2).take(pa.array(at))]
                    for e in allowed[turn][level]:
                        other = own ^ e
                        node = (turn << 38) | (level << 36) | (np.minimum(own, other) << 18) | np.maximum(own, other)
                        yield pa.RecordBatch.from_arrays([pa.array(node), *columns], ["node", "high", "low", "rep"])

    wide = T.StructType([T.StructField("node", T.LongType()), T.StructField("high", T.LongType()), T.StructField("low", T.LongType()), T.StructField("rep", kind)])
    rows = n * sum(max(len(allowed[turn][level]) for level in np.unique(deep[turn]).tolist()) for turn in range(len(allowed)))
    tasks = max(2 * unique.sparkSession.sparkContext.defaultParallelism, rows // 1_000_000)
    spreaded = unique.select("high", "low", "rep").mapInArrow(spread, wide).repartition(tasks, "node")

    def forest(group: pa.Table) -> pa.Table:
        return _forest(group, budget)

    return spreaded.groupBy("node").applyInArrow(forest, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def groups(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, keep_id (the least doc_id of its group), kept."""
    arrow_batches(docs.sparkSession)
    own = pick(docs, "doc_id", "text")
    kind = own.schema["doc_id"].dataType

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, high, low = fingerprints(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64))], ["doc_id", "high", "low"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("high", T.LongType()), T.StructField("low", T.LongType())])
    printed = table(own.where("doc_id is not null and text is not null").mapInArrow(prints, schema))
    unique = table(printed.groupBy("high", "low").agg(F.min("doc_id").alias("rep")))
    found = components(edges(unique, unique.count(), budget))
    keep = unique.join(found, F.col("rep") == F.col("node"), "left").select("high", "low", F.coalesce("root", "rep").alias("keep_id"))
    sure = printed.join(keep, ["high", "low"]).groupBy("doc_id").agg(F.min("keep_id").alias("keep_id"))
    rows = own.select("doc_id").join(sure.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d"), "left")
    return rows.select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id")).withColumn("kept", F.col("keep_id").eqNullSafe(F.col("doc_id")))


def dedup(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` but for near copies of a document that stays, with all their columns."""
    return without_ids(docs, table(groups(docs, budget).where("not kept").select("doc_id").distinct()))


def query(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
