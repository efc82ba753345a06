"""How evenly words are spread over files: eight measures from one table of counts by word and file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ieee import NAN, div
from ..functions.validate import check_choices, check_columns, output_name
from .tables import file_counts

COLUMNS = {"range": "range", "range%": "range%", "sd": "sd", "cv": "cv", "cv%": "cv%", "d": "D", "da": "DA", "dp": "DP"}

def dispersion(corpus: DataFrame, expr: str | Column, method: str | list[str] = "dp", min_freq: int = 0, file_id_column: str = "file_id") -> DataFrame:
    """term, freq and the measures asked for. Rows with a null term or file don't count; files without any row left
    aren't files. Words' absence from files is in the formulas: no table of words by files is made."""
    asked = check_choices(method, COLUMNS, "method")
    check_columns(corpus, file_id_column=file_id_column)
    name = output_name(corpus, expr)
    every = file_counts(corpus, expr, file_id_column).select("_t", "_c", (F.col("_c") / F.col("_s")).alias("_r"))
    ordered = "da" in asked or "dp" in asked
    if ordered:  # all of a word's files in one task, where they are sorted by rate and not held
        every = every.repartition("_t")
    # shares of words in a file add up to 1, so the files are counted with the tokens and in the same pass and shuffle
    totals = F.round(F.sum("_r")).alias("_N"), F.sum("_c").cast("double").alias("_all")
    one, r = F.lit(1.0), F.col("_r")
    sums = [F.sum("_c").alias("freq"), F.count("*").alias("_m"), F.sum("_r").alias("_S"), F.sum(r * r).alias("_Q")]
    if ordered:
        total = every.agg(*totals)  # one row
        word = Window.partitionBy("_t")
        columns = [F.sum("_c").over(word).alias("_tf")] if "dp" in asked else []
        rank = F.row_number().over(word.orderBy("_r")) - 1
        rows = every.select("*", *([rank.alias("_i")] if "da" in asked else [])).select("*", *columns).crossJoin(F.broadcast(total))
        share = F.col("_c") / r / F.col("_all")
        sums += [F.sum(r * 2 * F.col("_i")).alias("_R")] if "da" in asked else []
        sums += [F.sum(F.abs(F.col("_c") / F.col("_tf") - share) - share).alias("_D")] if "dp" in asked else []
        terms = rows.groupBy("_t").agg(*sums, F.first("_N").alias("_N"))
    else:
        terms = every.groupBy("_t").agg(*sums)
        # both uses read all columns, so that they share one pass and shuffle
        total = terms.agg(F.round(F.sum("_S")).alias("_N"), F.max("_m").alias("_m1"), F.max("_Q").alias("_Q1"), F.max("freq").alias("_f1"))
        terms = terms.crossJoin(F.broadcast(total)).where("_m <= _m1 and _Q <= _Q1 and freq <= _f1").drop("_m1", "_Q1", "_f1")
    if "da" in asked:
        terms = terms.withColumn("_P", F.col("_R") + (F.col("_N") + 1 - 2 * F.col("_m")) * F.col("_S"))
    terms = terms.where(F.col("freq") >= min_freq)
    n, s = F.col("_N"), F.col("_S")
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("_Q") - s * s / n) / n))
    cv = sd / (s / n)
    nan = F.lit(NAN)
    measures = {
        "range": F.col("_m"),
        "range%": F.lit(100.0) * F.col("_m") / n,
        "sd": sd,
        "cv": cv,
        "cv%": F.lit(100.0) * cv,
        "d": F.when(n > 1, one - F.least(one, div(cv, F.sqrt(n - 1)))).otherwise(nan),
        "da": F.when(n > 1, one - F.col("_P") / F.when(n > 1, (n - 1) * s)).otherwise(nan) if "da" in asked else None,
        "dp": F.greatest(F.lit(0.0), (one + F.col("_D")) / 2) if "dp" in asked else None,
    }
    return terms.select(F.col("_t").alias(name), "freq", *[measures[m].alias(COLUMNS[m]) for m in asked])
