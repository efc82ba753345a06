"""Token counts at every prefix of a text, by prefix dynamic programming.

For byte-pair encoding, the encoding of a prefix ends in exactly one token that is compatible with the last token of the
prefix before it: two neighbours are compatible if encoding their bytes gives them again. So one pass over a piece gives
the exact count at each of its prefixes. Text is cut where a non-blank meets a blank; the pre-tokeniser never looks across
such a place, so these units are encoded on their own and kept. Within a unit, a prefix can be cut otherwise than the
whole: a run of blanks is one piece as long as nothing follows, and a contraction isn't one until it is complete; such
prefixes are counted as they are.

counts() stores, for each character, by how much the count changes (16-bit integers): n_tokens, the longest prefix
within any budget, and the tokens of any stretch of prefixes follow without encoding again.

Null text: null counts. Empty text: 0 tokens. Null doc_id, repeated rows: as any row. Very long texts: whole. Empty
table: no rows. Ties can't arise (the longest prefix within a budget is unique). Other columns are left out.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, pick

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # of this vocabulary
BUDGETS = (512, 2048)
BLANK = "\t\n\x0b\x0c\r \x85\xa0                　"
UNITS_KEPT, PIECES_KEPT, PAIRS_KEPT = 1_000_000, 600_000, 600_000  # memory of a worker's tables, about 350 MB


class Counter:
    """Exact counts of a byte-level BPE vocabulary at all prefixes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.pieces = regex.compile(pattern)
        self.units = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
        self.blanks = re.compile(f"[{BLANK}]{{2,}}")
        self.kept: dict[str, bytes] = {}
        self.counted: dict[str, array] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """Byte-pair encoding as it is defined: merge the pair of least rank, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def split(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens whose merge makes this one."""
        known = self.halves.get(token)
        if known is None:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                _, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = self.halves[token] = (parts[0], parts[1])
        return known

    def fits(self, before: bytes, token: bytes) -> bool:
        """Whether the encoding of both together is these two tokens. Undoing their merges from the latest on, no pair
        across the border may have been open to an earlier merge."""
        known = self.pairs.get((before, token))
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[before, token] = self._fits(before, token) if before else self.merge(token) == [token]
        return known

    def _fits(self, a: bytes, b: bytes) -> bool:
        limit = 1 << 40
        while True:
            if self.ranks.get(a + b, limit) < limit:
                return False
            ra, rb = self.ranks[a], self.ranks[b]
            if len(a) == len(b) == 1:
                return True
            if len(b) == 1 or (len(a) > 1 and ra > rb):
                limit, a = ra, self.split(a)[1]
            else:
                limit, b = rb + 1, self.split(b)[0]

    def piece(self, text: str) -> array:
        """Count at each character's end, of a single piece."""
        known = self.counted.get(text)
        if known is None:
            known = array("i", self._piece(text))
            if len(text) <= 64:
                if len(self.counted) >= PIECES_KEPT:
                    self.counted.clear()
                self.counted[text] = known
        return known

    def _piece(self, text: str) -> list[int]:
        data = text.encode("utf-8", "surrogatepass")
        ranks, fits, known, far = self.ranks, self.fits, self.pairs.get, self.longest
        last, count = [b""], [0]
        for i in range(1, len(data) + 1):
            for j in range(i - far if i > far else 0, i):
                token = data[j:i]
                if token in ranks and (fits(last[j], token) if (ok := known((last[j], token))) is None else ok):
                    last.append(token)
                    count.append(count[j] + 1)
                    break
        if len(data) == len(text):
            return count[1:]
        ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text]).tolist()
        return [count[e] for e in ends]

    def unit(self, text: str) -> list[int] | array:
        """Count at each character's end, of a run of blanks and the non-blanks after it."""
        if text.isalpha() or (text[0] == " " and text[1:].isalpha()):
            return self.piece(text)
        out: list[int] = []
        for m in self.pieces.finditer(text):
            base, p = (out[-1] if out else 0), m.group()
            if p[0] == "'" and 1 < len(p) <= 3 and p[1:].isalpha():  # a contraction: its prefixes are no contractions
                part = [sum(self.piece(q)[-1] for q in self.pieces.findall(p[:i])) for i in range(1, len(p))]
                out += [base + x for x in part] + [base + self.piece(p)[-1]]
            else:
                out += [base + x for x in self.piece(p)]
        for m in self.blanks.finditer(text):
            base = out[m.start() - 1] if m.start() else 0
            out[m.start() : m.end()] = [base + x for x in self.piece(m.group())]
        return out

    def deltas(self, text: str) -> bytes:
        """Change of the count at each character, as 16-bit integers."""
        kept, parts = self.kept, []
        for u in self.units.findall(text):
            d = kept.get(u)
            if d is None:
                n = self.unit(u)
                d = array("h", map(int.__sub__, n, [0, *n[:-1]])).tobytes()
                if len(u) <= 64:
                    if len(kept) >= UNITS_KEPT:
                        kept.clear()
                    kept[u] = d
            parts.append(d)
        return b"".join(parts)


@functools.cache
def counter(path: str = VOCABULARY) -> Counter:
    with open(path, "rb") as lines:
        return Counter({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def longest_within(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    n = np.frombuffer(deltas, "<i2")
    fits = np.flatnonzero(np.cumsum(n, dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def counts(docs: DataFrame, budgets: tuple[int, ...] = BUDGETS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_chars, n_tokens, cut_<budget> (characters of the longest prefix within it) and deltas."""
    arrow_batches(docs.sparkSession)
    own = pick(docs, "doc_id", "text")
    fields = [T.StructField("doc_id", own.schema["doc_id"].dataType), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType())]
    fields += [*(T.StructField(f"cut_{b}", T.LongType()) for b in budgets), T.StructField("deltas", T.BinaryType())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            d = [None if t is None else c.deltas(t) for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([None if x is None else len(x) // 2 for x in d], pa.int64()), pa.array([None if x is None else int(np.frombuffer(x, "<i2").sum(dtype=np.int64)) for x in d], pa.int64())]
            columns += [pa.array([None if x is None else longest_within(x, n) for x in d], pa.int64()) for n in budgets]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(d, pa.binary())], [f.name for f in fields])

    return own.mapInArrow(count, T.StructType(fields))


def prefix_tokens(deltas: Column, chars: Column) -> Column:
    """Tokens of the prefix of so many characters, from stored deltas."""

    @F.pandas_udf("bigint")
    def tokens(d: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or y != y else int(np.frombuffer(x, "<i2")[: max(0, int(y))].sum(dtype=np.int64)) for x, y in zip(d, n)], dtype="Int64")

    return tokens(deltas, chars)


def cut_at(deltas: Column, budget: Column) -> Column:
    """Characters of the longest prefix within a budget, from stored deltas."""

    @F.pandas_udf("bigint")
    def cut(d: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or y != y else longest_within(x, int(y)) for x, y in zip(d, n)], dtype="Int64")

    return cut(deltas, budget)


def query(spark, sf_dir: str) -> DataFrame:
    return counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
