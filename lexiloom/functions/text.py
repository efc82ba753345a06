"""Token helpers: letters, n-grams, proportions, chunk numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ieee import col, div
from .validate import check_columns, check_count


def is_letters(expr: str | Column, allow_spaces: bool = False) -> Column:
    """At least one letter (with marks), else hyphens, apostrophes and, if allowed, spaces; null stays null."""
    other = r"\-'’" + (" " if allow_spaces else "")
    return col(expr).rlike(rf"^(?:[{other}])*\p{{L}}\p{{M}}*(?:\p{{L}}\p{{M}}*|[{other}])*\z")


def ngrams(n: int, expr: str | Column, index: str = "idx", by: str | None = "file_id", as_str: bool = True) -> Column:
    """A token and the n-1 after it; null where one is null or missing. Files (``by``) aren't crossed."""
    check_count(n, "n", 1)
    w = Window.partitionBy(by).orderBy(index) if by else Window.orderBy(index)
    parts = [col(expr)] + [F.lead(col(expr), i).over(w) for i in range(1, n)]
    missing = parts[0].isNull()
    for p in parts[1:]:
        missing = missing | p.isNull()
    whole = F.concat_ws(" ", *[p.cast("string") for p in parts]) if as_str else F.array(*parts)
    return F.when(~missing, whole)


def proportion(df: DataFrame, column: str, group: str | list[str] | None = None) -> DataFrame:
    """The column as a share of its sum, in all or by group. Sums are joined: no window gathers the table in one task."""
    groups = [group] if isinstance(group, str) else list(group or [])
    check_columns(df, column=column)
    if groups:
        total = F.sum(column).over(Window.partitionBy(*groups))
        return df.withColumn(column, div(F.col(column), total))
    total = df.agg(F.sum(column).alias("_total"))  # one row
    return df.crossJoin(F.broadcast(total)).withColumn(column, div(F.col(column), F.col("_total"))).drop("_total")


def chunk_id(tag: str | Column, index: str = "idx", by: str | None = "file_id") -> Column:
    """How many B tags there were up to a token; null at O. One count over each file, or with by=None over all rows."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    t = col(tag)
    return F.when(t == "O", F.lit(None).cast("bigint")).otherwise(F.sum((t == "B").cast("bigint")).over(w))


def with_chunk_index(df: DataFrame, chunk_column: str, name: str = "chunk_idx", index: str = "idx", by: str | None = "file_id") -> DataFrame:
    check_columns(df, chunk_column=chunk_column, index=index)
    return df.withColumn(name, chunk_id(chunk_column, index, by))


def with_runs(df: DataFrame, column: str, index: str, name: str = "run") -> DataFrame:
    """Numbers maximal runs of equal values (null is a value) in the order of ``index``; for tables without unique
    (file, position) keys. One ordering of the whole table: a repair step, not a query."""
    w = Window.orderBy(index)
    new = F.when(F.col(column).eqNullSafe(F.lag(column).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
