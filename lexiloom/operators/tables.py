"""Frequency tables and contingency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.assoc import freqs
from ..functions.ieee import div
from ..functions.validate import as_column, output_name
from ..sources import tokens as tk


def frequencies(df: DataFrame, expr: str | Column, name: str = "freq") -> DataFrame:
    """Counts of an expression's values; null is a value."""
    column = output_name(df, expr)
    return df.select(as_column(expr).alias(column)).groupBy(column).agg(F.count("*").alias(name))


def file_counts(df: DataFrame, expr: str | Column, file_id_column: str = "file_id") -> DataFrame:
    """_t, _f, _c, _s: each value's count in each file where it is, and the file's size; rows with a null in either don't
    count. A table in order is spread by file before it is cut into words, so that only its texts move."""
    own = tk.source(df, file_id_column)
    if own:
        spread = own.files.where("file_id is not null").repartition(tk.parts(own.files), "file_id")
        df = own.tokens(spread)
    rows = df.select(as_column(expr).alias("_t"), F.col(file_id_column).alias("_f")).where("_t is not null and _f is not null")
    if not own:
        rows = rows.repartition("_f")
    counts = rows.groupBy("_f", "_t").agg(F.count("*").alias("_c"))
    return counts.select("_t", "_f", "_c", F.sum("_c").over(Window.partitionBy("_f")).alias("_s"))


def relative(df: DataFrame, expr: str | Column, per: float = 10_000, name: str = "rate") -> DataFrame:
    """Counts and rates per so many tokens."""
    counts = frequencies(df, expr)
    total = df.agg(F.count("*").alias("_n"))  # one row
    return counts.crossJoin(F.broadcast(total)).withColumn(name, div(F.col("freq") * F.lit(float(per)), F.col("_n"))).drop("_n")


def ranked(df: DataFrame, expr: str | Column) -> DataFrame:
    """Zipf's table: freq, rank (by frequency, then value) and freq x rank. The window runs over types, not tokens,
    and ranks inside frequency classes first, so no task orders the whole vocabulary."""
    column = output_name(df, expr)
    counts = frequencies(df, expr)
    classes = counts.groupBy("freq").agg(F.count("*").alias("_types"))  # as many rows as different frequencies
    above = classes.withColumn("_above", F.coalesce(F.sum("_types").over(Window.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = counts.withColumn("_i", F.row_number().over(Window.partitionBy("freq").orderBy(column)))
    out = inside.join(above.select(F.col("freq").alias("_f"), "_above"), F.col("freq") == F.col("_f"))
    return out.select(column, "freq", (F.col("_above") + F.col("_i")).alias("rank")).withColumn("freq_x_rank", F.col("freq") * F.col("rank"))


def frequency_spectrum(df: DataFrame, expr: str | Column) -> DataFrame:
    """m and how many types occur m times."""
    return frequencies(df, expr, "m").groupBy("m").agg(F.count("*").alias("types"))


def count_hapaxes(df: DataFrame, expr: str | Column) -> DataFrame:
    """One row: types that occur once."""
    return frequencies(df, expr).agg(F.count(F.when(F.col("freq") == 1, 1)).alias("hapaxes"))


def crosstab(df: DataFrame, x: str | Column, y: str | Column, freqs_name: str = "freqs") -> DataFrame:
    """x, y and their 2x2 table; rows with a null in either don't count. Margins are sums over the counted pairs."""
    a, b = output_name(df, x, "x"), output_name(df, y, "y")
    pairs = df.select(as_column(x).alias("_x"), as_column(y).alias("_y")).where("_x is not null and _y is not null").groupBy("_x", "_y").agg(F.count("*").alias("_f12"))
    xs = pairs.groupBy(F.col("_x").alias("_kx")).agg(F.sum("_f12").alias("_f1"))
    ys = pairs.groupBy(F.col("_y").alias("_ky")).agg(F.sum("_f12").alias("_f2"))
    n = pairs.agg(F.sum("_f12").alias("_n"))  # one row
    out = pairs.join(xs, F.col("_x") == F.col("_kx")).join(ys, F.col("_y") == F.col("_ky")).crossJoin(F.broadcast(n))
    return out.select(F.col("_x").alias(a), F.col("_y").alias(b), freqs("_f12", "_f1", "_f2", "_n").alias(freqs_name))
