"""Lexical diversity and growth, for the whole table or by groups. Null is a type."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ieee import NAN, div
from ..functions.validate import as_column, check_count
from ..session import prepare


def _by(by: str | list[str] | None) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def _types(df: DataFrame, expr, keys: list[str]) -> DataFrame:
    """Counts of types by key: what all measures without order are made of."""
    return df.select(*keys, as_column(expr).alias("_x")).groupBy(*keys, "_x").agg(F.count("*").alias("_c"))


def ttr(df: DataFrame, expr: str | Column, by: str | list[str] | None = None) -> DataFrame:
    """Types over tokens; NaN for no tokens."""
    keys = _by(by)
    out = _types(df, expr, keys).groupBy(*keys).agg(F.count("*").alias("_v"), F.coalesce(F.sum("_c"), F.lit(0)).alias("_n"))
    return out.select(*keys, div(F.col("_v"), F.col("_n")).alias("ttr"))


def yules_k(df: DataFrame, expr: str | Column, by: str | list[str] | None = None) -> DataFrame:
    """10000 (sum of squared counts / N^2 - 1/N); NaN for no tokens."""
    keys = _by(by)
    out = _types(df, expr, keys).groupBy(*keys).agg(F.coalesce(F.sum(F.col("_c").cast("double") * F.col("_c")), F.lit(0.0)).alias("_q"), F.coalesce(F.sum("_c"), F.lit(0)).cast("double").alias("_n"))
    n = F.col("_n")
    return out.select(*keys, F.when(n == 0, F.lit(NAN)).otherwise(F.lit(1e4) * (div(F.col("_q"), n * n) - div(F.lit(1.0), n))).alias("yules_k"))


def msttr(df: DataFrame, expr: str | Column, n: int = 1000, index: str = "idx", by: str | list[str] | None = "file_id", dense: bool = False) -> DataFrame:
    """Mean type-token ratio of segments of n tokens; the rest at the end doesn't count; null for less than a segment.
    ``dense``: the index counts from 0 without gaps in each group, so that nothing has to be sorted."""
    check_count(n, "n", 1)
    keys = _by(by)
    w = Window.partitionBy(*keys).orderBy(index) if keys else Window.orderBy(index)
    place = F.col(index) if dense else F.row_number().over(w) - 1
    rows = df.select(*keys, index, as_column(expr).alias("_x")).withColumn("_s", F.floor(place / n))
    types = rows.groupBy(*keys, "_s", "_x").agg(F.count("*").alias("_c")).groupBy(*keys, "_s").agg(F.count("*").alias("_v"), F.sum("_c").alias("_n"))
    full = F.col("_n") == n
    segments = F.count(F.when(full, 1))
    return types.groupBy(*keys).agg((F.sum(F.when(full, F.col("_v"))) / F.when(segments > 0, segments) / F.lit(float(n))).alias("msttr"))


def _factors(tokens: list, threshold: float) -> float:
    factors, seen, n = 0.0, set(), 0
    for t in tokens:
        seen.add(t)
        n += 1
        if len(seen) / n <= threshold:
            factors, seen, n = factors + 1, set(), 0
    return factors + (1 - len(seen) / n) / (1 - threshold) if n else factors


def mtld_of(tokens: list, threshold: float = 0.72) -> float | None:
    """Mean length of stretches that keep the type-token ratio above the threshold, read forwards and backwards;
    None under 10 tokens, infinite if no stretch ends."""
    if len(tokens) < 10:
        return None
    lengths = [len(tokens) / f if f else float("inf") for f in (_factors(tokens, threshold), _factors(tokens[::-1], threshold))]
    return sum(lengths) / 2


def mtld(df: DataFrame, expr: str | Column, threshold: float = 0.72, index: str = "idx", by: str = "file_id") -> DataFrame:
    """mtld_of() each group, from its tokens in order. Truly sequential: one stream over sorted partitions."""
    if not 0 < threshold < 1:
        raise ValueError(f"threshold must be between 0 and 1, not {threshold}")
    prepare(df.sparkSession)
    rows = df.select(F.col(by), F.col(index).alias("_i"), as_column(expr).cast("string").alias("_x"))
    out = T.StructType([T.StructField(by, rows.schema[by].dataType), T.StructField("mtld", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, begun, kind = None, [], False, None
        keys, values = [], []
        for b in batches:
            kind = b.column(0).type
            for k, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if begun and k != key:
                    keys.append(key)
                    values.append(mtld_of(held, threshold))
                    held = []
                key, begun = k, True
                held.append(x)
        if begun:
            keys.append(key)
            values.append(mtld_of(held, threshold))
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(values, pa.float64())], [by, "mtld"])

    return rows.repartition(by).sortWithinPartitions(by, "_i").mapInArrow(run, out)


def vocabulary_growth(df: DataFrame, expr: str | Column, index: str = "idx", by: str | list[str] | None = "file_id") -> DataFrame:
    """The table with ``growth``: how many types there were up to a token."""
    keys = _by(by)
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    rows = df.withColumn("_x", as_column(expr))
    rows = rows.withColumn("_new", (F.row_number().over(Window.partitionBy(*keys, "_x").orderBy(index)) == 1).cast("bigint"))
    return rows.withColumn("growth", F.sum("_new").over(part.orderBy(index).rowsBetween(Window.unboundedPreceding, 0))).drop("_x", "_new")
