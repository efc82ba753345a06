"""The data behind the usual corpus plots; drawing is left to a plotting library."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.validate import check_columns, check_count


def global_index(df: DataFrame, file_id_column: str = "file_id", index_column: str = "idx", name: str = "position") -> DataFrame:
    """Row numbers over all files in the order of their ids: offsets come from the files' sizes, so only as many rows as
    there are files are ordered together."""
    sizes = df.groupBy(F.col(file_id_column).alias("_f")).agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_f", "_before")
    return df.join(offsets, F.col(file_id_column).eqNullSafe(F.col("_f"))).withColumn(name, F.col("_before") + F.col(index_column)).drop("_f", "_before")


def barcode_data(corpus: DataFrame, terms: list[str], column: str = "token", file_id_column: str = "file_id", index_column: str = "idx", warn: bool = True) -> DataFrame:
    """position, term and y (the term's place in the list) of each occurrence."""
    check_columns(corpus, column=column)
    rank = F.create_map(*[x for i, t in enumerate(terms) for x in (F.lit(t), F.lit(i))])
    rows = global_index(corpus.select(file_id_column, index_column, column), file_id_column, index_column).where(F.col(column).isin(*terms))
    out = rows.select("position", F.col(column).alias("term"), rank[F.col(column)].alias("y"))
    if warn:
        there = {r[0] for r in corpus.where(F.col(column).isin(*terms)).select(column).distinct().collect()}  # some of the terms asked for
        if missing := [t for t in terms if t not in there]:
            warnings.warn(f"not in the corpus: {', '.join(missing)}", stacklevel=2)
    return out


def dispersion_data(corpus: DataFrame, term: str, column: str = "token", relative: bool = False, file_id_column: str = "file_id", index_column: str = "idx", check: bool = True) -> DataFrame:
    """file_id and position (from 1, or as a share of the file) of each occurrence."""
    check_columns(corpus, column=column, file_id_column=file_id_column)
    hits = corpus.where(F.col(column) == term).select(F.col(file_id_column).alias("file_id"), (F.col(index_column) + 1).cast("double").alias("position"))
    if check and hits.isEmpty():
        raise ValueError(f"{term!r} isn't in column {column!r}")
    if relative:
        sizes = corpus.groupBy(F.col(file_id_column).alias("_f")).agg(F.count("*").alias("_n"))
        hits = hits.join(sizes, F.col("file_id").eqNullSafe(F.col("_f"))).select("file_id", (F.col("position") / F.col("_n")).alias("position"))
    return hits


def keyword_data(keywords: DataFrame, term: str, score: str, top_k: int = 20) -> DataFrame:
    """The first terms of a keyword table with their scores."""
    check_columns(keywords, term=term, score=score)
    return keywords.limit(check_count(top_k, "top_k", 1)).select(F.col(term).alias("term"), F.col(score).alias("score"))


def text_data(points: DataFrame, x: str, y: str, label: str) -> DataFrame:
    """Labels with their places."""
    check_columns(points, x=x, y=y, label=label)
    return points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(label).cast("string").alias("label"))
