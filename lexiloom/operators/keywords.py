"""Words that mark a target corpus against a reference corpus."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import assoc
from ..functions.validate import as_column, check_choice, check_columns, output_name

NAMES = {"ll": "LogLik", "pmi": "PMI", "chisq": "ChiSq", "minsens": "MinSens", "smp": "SMP"}


def keywords(target: DataFrame, reference: DataFrame, expr: str | Column, method: str = "ll", min_target_tf: int = 0, min_target_df: int = 0, k: float | None = None, file_id_column: str = "file_id", p: bool = True) -> DataFrame:
    """Terms of the target by an association measure, best first: term, freqs, target_df and the measure. With "ttest":
    term, t, p, df, g by Welch's test on relative frequencies in files, terms with t > 0, least p first.

    Rows with a null term or file don't count. One aggregation by term gives the whole table of a term."""
    method = check_choice(method, [*NAMES, "ttest"], "method")
    if method == "smp" and (k is None or not k > 0):
        raise ValueError("method 'smp' needs k > 0")
    if method != "smp" and k is not None:
        warnings.warn(f"k has no effect on method {method!r}", stacklevel=2)
    if method == "ttest" and (min_target_tf or min_target_df):
        warnings.warn("min_target_tf and min_target_df have no effect on method 'ttest'", stacklevel=2)
    check_columns(target, file_id_column=file_id_column)
    check_columns(reference, file_id_column=file_id_column)
    name = output_name(target, expr)
    if output_name(reference, expr) != name:
        raise ValueError("expr must give the same column in target and reference")

    def part(df: DataFrame, is_target: bool) -> DataFrame:
        return df.select(as_column(expr).alias("_term"), F.col(file_id_column).alias("_file")).where("_term is not null and _file is not null").withColumn("_target", F.lit(is_target))

    both = part(target, True).unionByName(part(reference, False))
    return _ttest(both, name, p) if method == "ttest" else _measure(both, name, method, min_target_tf, min_target_df, k)


def _measure(both: DataFrame, name: str, method: str, tf: int, df: int, k: float | None) -> DataFrame:
    files = both.groupBy("_term", "_target", "_file").agg(F.count("*").alias("_c"))
    terms = files.groupBy("_term").agg(F.sum(F.when(F.col("_target"), F.col("_c")).otherwise(0)).alias("_f12"), F.sum("_c").alias("_f1"), F.count(F.when(F.col("_target"), 1)).alias("target_df"))
    sizes = both.agg(F.count(F.when(F.col("_target"), 1)).alias("_f2"), F.count("*").alias("_n"))  # one row
    out = terms.where((F.col("_f12") > 0) & (F.col("_f12") >= tf) & (F.col("target_df") >= df)).crossJoin(F.broadcast(sizes))
    out = out.select(F.col("_term").alias(name), assoc.freqs("_f12", "_f1", "_f2", "_n").alias("freqs"), "target_df")
    measure = {"ll": assoc.loglik, "pmi": assoc.pmi, "chisq": assoc.chisq, "minsens": assoc.minsens, "smp": lambda s: assoc.smp(s, k=k)}[method]
    return out.withColumn(NAMES[method], measure("freqs")).orderBy(F.desc_nulls_first(NAMES[method]))


def _ttest(both: DataFrame, name: str, p: bool) -> DataFrame:
    sizes = both.groupBy("_file", "_target").agg(F.count("*").alias("_size"))
    counts = both.groupBy("_term", "_file", "_target").agg(F.count("*").alias("_c"))
    s = sizes.select(F.col("_file").alias("_f"), F.col("_target").alias("_t"), "_size")
    rates = counts.join(s, (F.col("_file") == F.col("_f")) & (F.col("_target") == F.col("_t"))).withColumn("_r", F.col("_c") / F.col("_size"))
    zero = F.lit(0.0)
    sums = [F.sum(F.when(c, v).otherwise(zero)).alias(n) for n, c, v in (("s1", F.col("_target"), F.col("_r")), ("q1", F.col("_target"), F.col("_r") * F.col("_r")), ("s2", ~F.col("_target"), F.col("_r")), ("q2", ~F.col("_target"), F.col("_r") * F.col("_r")))]
    n = sizes.agg(F.count(F.when(F.col("_target"), 1)).alias("n1"), F.count(F.when(~F.col("_target"), 1)).alias("n2"))  # one row
    out = rates.groupBy("_term").agg(*sums).crossJoin(F.broadcast(n))
    out = out.select(F.col("_term").alias(name), "s1", "q1", "n1", "s2", "q2", "n2", assoc.welchs_t_from_stats("s1", "q1", "n1", "s2", "q2", "n2", p=False).alias("w")).where("w.t > 0")
    w = assoc.welchs_t_from_stats("s1", "q1", "n1", "s2", "q2", "n2", p=p)
    return out.select(name, w.alias("w")).select(name, "w.t", "w.p", "w.df", "w.g").orderBy("p" if p else F.desc("t"))
