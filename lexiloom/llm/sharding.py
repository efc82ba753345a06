"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws -ln(u) / weight with u from a hash of
(key, child), and the least draw wins. So a child gets documents in proportion to its weight, and as a draw depends on
nothing but the key, the child and its weight, a changed weight moves documents only into or out of subtrees whose
weights changed. The plan is one projection: no shuffle, no Python.

Null keys: placed together by the key "". Repeated rows and equal keys: the same shard. Empty table: no rows.
Other columns: kept as they are; the three placement columns come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import index_of, pick, positional

#: region -> rack -> shard -> weight; an inner node weighs what its children weigh together.
TREE: dict[str, dict[str, dict[str, float]]] = {
    f"r{r}": {f"r{r}k{k}": {f"r{r}k{k}s{s}": float(1 + (r + k + s) % 3) for s in range(8)} for k in range(4)} for r in range(3)
}
DIGITS = 13  # hexadecimal digits of md5 in a draw: 52 bits, exact in a double


def weight(node) -> float:
    return float(sum(map(weight, node.values()))) if isinstance(node, dict) else float(node)


def nodes(tree: dict) -> list[tuple[int, str, str, float]]:
    """(level, parent, child, weight) of each node that has weight; siblings in the order of their names."""
    out = []

    def walk(level: int, parent: str, node: dict) -> None:
        for name in sorted(node):
            if weight(node[name]) > 0:
                out.append((level, parent, name, weight(node[name])))
                if isinstance(node[name], dict):
                    walk(level + 1, name, node[name])

    walk(0, "", tree)
    return out


def _draw(key: Column, child: Column, w: Column) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), child)), 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(16**DIGITS))
    return -F.log(u) / w


def shard(df: DataFrame, key: str = "doc_id", tree: dict = TREE, names: tuple[str, str, str] = ("region", "rack", "shard")) -> DataFrame:
    """All columns of ``df``, then the placement; an own column of such a name gives way to the placement."""
    k = index_of(df, key)
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in names]
    p = positional(df)
    children: dict[tuple[int, str], list[Column]] = {}
    for level, parent, name, w in nodes(tree):
        children.setdefault((level, parent), []).append(F.struct(F.lit(name).alias("n"), F.lit(w).alias("w")))
    if not children:
        raise ValueError("the tree has no weight")
    drawn = F.coalesce(F.col(f"_{k}").cast("string"), F.lit(""))
    p = p.withColumn("_top", F.lit(""))
    for level, (above, here) in enumerate((("_top", "_region"), ("_region", "_rack"), ("_rack", "_shard"))):  # a column a level: each draw is made once
        below = F.create_map(*[x for (at, q), c in children.items() if at == level for x in (F.lit(q), F.array(*c))])
        p = p.withColumn(here, F.array_min(F.transform(below[F.col(above)], lambda c: F.struct(_draw(drawn, c["n"], c["w"]).alias("d"), c["n"].alias("n"))))["n"])
    return p.select(*[f"_{i}" for i in keep], "_region", "_rack", "_shard").toDF(*[df.columns[i] for i in keep], *names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(pick(docs, "doc_id", "source", "n_chars"))


def sql(tree: dict = TREE, source: str = "documents") -> str:
    """DuckDB SQL for query()."""
    rows = ", ".join(f"({lv}, '{p}', '{n}', {w!r}::DOUBLE)" for lv, p, n, w in nodes(tree))
    draw = f"-ln((('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || t.n), 1, {DIGITS}))::BIGINT::DOUBLE + 0.5) / {float(16**DIGITS)!r}) / t.w"

    return f"""WITH tree(lv, p, n, w) AS (VALUES {rows}),
d0 AS (SELECT doc_id, source, n_chars, row_number() OVER () AS rid FROM {source}),
c0 AS (SELECT d.*, t.n AS l0, row_number() OVER (PARTITION BY d.rid ORDER BY {draw}, t.n) AS k FROM d0 d JOIN tree t ON t.lv = 0),
d1 AS (SELECT * EXCLUDE (k) FROM c0 WHERE k = 1),
c1 AS (SELECT d.*, t.n AS l1, row_number() OVER (PARTITION BY d.rid ORDER BY {draw}, t.n) AS k FROM d1 d JOIN tree t ON t.lv = 1 AND t.p = d.l0),
d2 AS (SELECT * EXCLUDE (k) FROM c1 WHERE k = 1),
c2 AS (SELECT d.*, t.n AS l2, row_number() OVER (PARTITION BY d.rid ORDER BY {draw}, t.n) AS k FROM d2 d JOIN tree t ON t.lv = 2 AND t.p = d.l1)
SELECT doc_id, source, n_chars, l0 AS region, l1 AS rack, l2 AS shard FROM c2 WHERE k = 1"""
