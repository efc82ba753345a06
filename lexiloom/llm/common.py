"""Helpers shared by the ten operators: column picking, lineage cuts, row filters, components."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 512  # rows in an Arrow batch: long texts must not pile up in a Python worker


def index_of(df: DataFrame, name: str) -> int:
    """Position of a column: the exact name first, then a case-insensitive match."""
    names = df.columns
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for i, c in enumerate(names):
            if same(c):
                return i
    raise ValueError(f"no column {name!r}; there are {names}")


def positional(df: DataFrame) -> DataFrame:
    """The same rows with columns _0, _1, ...: names that clash can't be ambiguous then."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, whatever else the table has and however its other columns are called."""
    at = [index_of(df, n) for n in names]
    return positional(df).select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names)])


def where_rows(df: DataFrame, names: list[str], keep) -> DataFrame:
    """Rows for which ``keep(*columns)`` holds, with all columns of ``df`` as they are."""
    at = [index_of(df, n) for n in names]
    return positional(df).where(keep(*[F.col(f"_{i}") for i in at])).toDF(*df.columns)


def without_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key isn't in ``ids``; rows without a key stay. No hint: Spark broadcasts by size."""
    k = index_of(df, key)
    drop = ids.select(F.col(ids.columns[0]).alias("_drop"))
    return positional(df).join(drop, F.col(f"_{k}") == F.col("_drop"), "left_anti").toDF(*df.columns)


def arrow_batches(spark: SparkSession) -> None:
    """Small Arrow batches for the Python operators, as documents can be very long; workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. A local session without one gets a
    temporary folder, any other an error: no other folder is known to be shared."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if sc.master.startswith("local[") or sc.master == "local":
            named = tempfile.mkdtemp(prefix="lexiloom-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are in the shared folder, so a lost executor costs nothing."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """As cut(), as a Parquet table in the shared folder: smaller, and its columns can be pruned."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def md5_int(text: Column, start: int, digits: int) -> Column:
    """Integer of some hexadecimal digits of md5; the same value can be had in SQL."""
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("bigint")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root the least node of its component; roots
    themselves have no row.

    Alternating large-star and small-star steps: every round halves path lengths, costs two shuffles of the
    edges and is cut by a checkpoint. Nothing is collected but a checksum. Self-loops and null ends are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u != v").distinct()
    e = cut(e)
    mark = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        e = cut(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        mark = now
