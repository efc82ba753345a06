"""Division and logarithm as floating-point hardware has them: infinities and NaN where Spark has errors or nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    edge = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, edge).otherwise(a / F.when(b != 0, b))


def ln(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.log(x))
