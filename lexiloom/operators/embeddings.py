"""Vectors of texts, of matches and of terms. A model has get_embedding_dimension() and encode(texts, normalize_embeddings)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validate import check_count
from ..session import prepare
from ..sources import tokens as tk
from .search import search


def encode_column(model, text: Column) -> Column:
    """The model's vectors, batch by batch; null text has none."""
    dim = int(model.get_embedding_dimension())

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = s[s.notna()]
            found = dict(zip(known.index, model.encode(known.tolist(), normalize_embeddings=True))) if len(known) else {}
            out = [[float(y) for y in found[i]] if i in found else None for i in s.index]
            if any(v is not None and len(v) != dim for v in out):
                raise ValueError(f"the model's vectors don't have {dim} numbers")
            yield pd.Series(out, dtype=object)

    return vectors(text)


def encode(df: DataFrame, model, expr: str, name: str = "vector") -> DataFrame:
    prepare(df.sparkSession)
    return df.withColumn(name, encode_column(model, F.col(expr)))


def centroid(df: DataFrame, vector: str, by: str | list[str] | None = None, normalize: bool = True, name: str = "centroid") -> DataFrame:
    """Element-wise mean, of length 1 if ``normalize`` and it isn't zero. Sums by place are partial before the shuffle."""
    keys = [by] if isinstance(by, str) else list(by or [])
    means = df.select(*keys, F.posexplode(vector).alias("_p", "_v")).groupBy(*keys, "_p").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    out = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda x: x["_m"]).alias("_c"))
    norm = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.when(norm > 0, F.transform("_c", lambda x: x / F.when(norm > 0, norm))).otherwise(F.col("_c")) if normalize else F.col("_c")
    return out.select(*keys, unit.cast("array<float>").alias(name))


def encode_terms(terms: list[str], corpus: DataFrame, model, expr: str = "token", window: int = 5, chunk_column: str | None = None, max_matches: int = 10_000, seed: int = 0, term_column: str = "term", **search_kwargs) -> DataFrame:
    """A vector for each term: the mean of the model's vectors of (at most max_matches, drawn by hash) matches in
    context; null if there is none. All terms' contexts are encoded and averaged in one plan."""
    check_count(max_matches, "max_matches", 1)
    spark = prepare(corpus.sparkSession)
    parts = []
    for t in terms:
        found = search(corpus, t, **search_kwargs)
        drawn = F.xxhash64("file_id", "start", F.lit(seed)), "file_id", "start"
        if tk.source(corpus):  # contexts come with the matches, in one pass
            rows = found.concordance(expr, window, chunk_column, bindings=False).orderBy(*drawn).limit(max_matches)
        else:
            rows = found._with(found.matches.orderBy(*drawn).limit(max_matches)).concordance(expr, window, chunk_column, bindings=False)
        sides = [c for c in (f"{expr}_left_context", expr, f"{expr}_right_context") if c in rows.columns]
        parts.append(rows.select(F.lit(t).alias(term_column), F.array_join(F.concat(*sides), " ").alias("_text")))
    asked = spark.createDataFrame([(t,) for t in terms], f"{term_column} string")
    if not parts:
        return asked.withColumn("vector", F.lit(None).cast("array<float>"))
    spread = reduce(DataFrame.unionByName, parts).repartition(spark.sparkContext.defaultParallelism)  # each term's are in one task
    vectors = spread.withColumn("_v", encode_column(model, F.col("_text")))
    means = centroid(vectors, "_v", term_column, name="vector").withColumnRenamed(term_column, "_t")
    return asked.join(means, F.col(term_column) == F.col("_t"), "left").select(term_column, "vector")
