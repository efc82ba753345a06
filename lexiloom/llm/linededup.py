"""Line dedup by a log-template tree.

A line's tokens are its runs of non-blanks; a token with a digit counts as <*>. The tree has a fixed depth: the number
of tokens, then the first LEAD tokens. At a leaf the distinct lines, in their order, join the template that agrees in
the largest share of tokens, at least SIMILAR; tokens that differ become <*>, which agrees with nothing. A template whose
lines are in MIN_DOCS documents or more recurs, and its lines are dropped wherever they are, the first one too. Copies of
one text are one document here, so a text isn't emptied for having copies; a line in fewer documents than MIN_DOCS stays,
and a passage is only seen if it is lines of its own.

A template can't recur unless its leaf does, so a leaf's documents are counted first, from hashes, and only lines of
recurring leaves ever move with their text, once for each distinct line. Within a leaf a line meets only templates that
have one of its runs of tokens: of D + 1 runs, one is whole if at most D tokens differ, so the result is that of comparing
all. A leaf of more than LEAF distinct lines is split by hash, and its parts' templates join one another as lines do, so
no task holds all lines of a hot leaf. The dropped lines' hashes go to the executors while there are at most SEND of
them; beyond that, a join by document brings them.

Null text: stays null. Empty text and blank lines: stay. Null doc_id: as any other. Repeated rows: one
document in the counts, each is cleaned. Ties of templates: the one made first. Very long texts: all lines. Empty table:
no rows. Other columns are left out by cleaned() and kept by clean().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, index_of, pick, positional, table

LEAD, SIMILAR, MIN_DOCS = 3, 0.8, 3
SEND = 8_000_000  # dropped lines' hashes that may be sent to every executor: 64 MB
LEAF = 200_000  # distinct lines of a leaf in one task
ANY, OPEN = "<*>", "\0"  # a token with a digit, a place where a template's lines differ


def _trimmed(text: Column) -> Column:
    """Masked lines: tokens with a digit are <*>, runs of blanks single spaces. Lines without digits skip the mask."""

    def masked(line: Column) -> Column:
        digits = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*", ANY)).otherwise(line)
        return F.trim(F.regexp_replace(digits, r"[\x0B\f\r\t][\x0B\f\r\t ]*| [\x0B\f\r\t ]+", " "))

    return F.transform(F.split(text, "\n", -1), masked)


def _count(line: Column) -> Column:
    return F.length(line) - F.length(F.translate(line, " ", "")) + 1


def _leaf(line: Column, lead: int) -> Column:
    return F.xxhash64(_count(line), F.substring_index(line, " ", lead))


def templates(lines: list[str], similar: float = SIMILAR, lead: int = LEAD) -> tuple[list[int], list[str]]:
    """Template number of each of a leaf's lines (all with as many tokens and the same first ones, distinct, in order),
    and the templates. Lines can be templates themselves."""
    ids: dict[str, int] = {}
    rows = np.array([[ids.setdefault(t, len(ids)) for t in x.split(" ")] for x in lines], np.int64)
    if OPEN in ids:
        rows[rows == ids[OPEN]] = -1
    if ANY in ids:
        rows[rows == ids[ANY]] = -2  # a line's own mask agrees with that of a template
    size = rows.shape[1]
    least = similar * size
    differ = sum(size - d >= least for d in range(1, size + 1))  # tokens that may
    lead = min(lead, size)
    ends = np.linspace(lead, size, differ + 2).astype(int).tolist()
    runs = list(zip(ends[:-1], ends[1:]))
    known: list[dict[bytes, list[int]]] | None = None if any(a == b for a, b in runs) else [{} for _ in runs]
    made = np.full((min(len(rows), 16), size), -1, np.int64)
    n, at = 0, []
    for row in rows:
        keys = () if known is None else [row[a:b].tobytes() for a, b in runs]
        if n <= 32 or known is None:
            some = np.arange(n)
        else:
            some = np.array(sorted({i for k, x in zip(keys, known) for i in x.get(k, ())}), np.int64)
        agree = ((made[some] == row) & (row != -1)).sum(1)
        best = int(agree.argmax()) if len(some) else -1
        if len(some) and agree[best] >= least:
            best = int(some[best])
            made[best][made[best] != row] = -1
        else:
            best = n
            if n == len(made):
                made = np.concatenate((made, np.full_like(made, -1)))
            made[n] = row
            n += 1
            for k, x in zip(keys, known or ()):  # as tokens only ever open up, a template has no runs but these
                x.setdefault(k, []).append(best)
        at.append(best)
    names = list(ids)
    return at, [" ".join(OPEN if t == -1 else ANY if t == -2 else names[t] for t in made[i].tolist()) for i in range(n)]


def _assign(batches: Iterator[pa.RecordBatch], similar: float, lead: int) -> Iterator[pa.RecordBatch]:
    """From rows (leaf, salt, hash, line) that come sorted by leaf, salt and line: (hash, template id, template, leaf)."""
    leaf, hashes, lines = None, [], []

    def flush() -> pa.RecordBatch:
        at, text = templates(lines, similar, lead)
        first: dict[int, int] = {}
        for h, t in zip(hashes, at):
            first.setdefault(t, h)
        return pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array([first[t] for t in at], pa.int64()), pa.array([text[t] for t in at], pa.string()), pa.array([leaf[0]] * len(at), pa.int64())], ["h", "template_id", "template", "leaf"])

    for b in batches:
        for x, salt, h, line in zip(*(c.to_pylist() for c in b.columns)):
            if (x, salt) != leaf and lines:
                yield flush()
                hashes, lines = [], []
            leaf = (x, salt)
            hashes.append(h)
            lines.append(line)
    if lines:
        yield flush()


def recurring(docs: DataFrame, lead: int = LEAD, similar: float = SIMILAR, min_docs: int = MIN_DOCS, leaf: int = LEAF) -> DataFrame:
    """(h, template_id, template, n_docs): every masked line, by its hash, whose template recurs. A table."""
    arrow_batches(docs.sparkSession)
    own = pick(docs, "doc_id", "text").where("text is not null")
    own = own.select(F.xxhash64("text").alias("d"), F.explode(_trimmed(F.col("text"))).alias("line")).where("line != ''")
    own = own.select("d", "line", _leaf(F.col("line"), lead).alias("leaf"), F.xxhash64("line").alias("h"))
    seen = table(own.select("d", "leaf", "h").distinct())
    leaves = table(seen.groupBy("leaf").agg(F.countDistinct("d").alias("n")).where(F.col("n") >= min_docs).select("leaf"))
    lines = own.join(leaves, "leaf", "left_semi").groupBy("leaf", "h").agg(F.min("line").alias("line"))
    sizes = seen.join(leaves, "leaf", "left_semi").select("leaf", "h").distinct().groupBy("leaf").agg(F.count("*").alias("n"))
    most = max(leaf, (seen.count() or 0) // 1_000_000)  # so there are a million hot leaves at most
    hot = table(sizes.where(F.col("n") > most).select(F.col("leaf").alias("_leaf"), F.ceil(F.col("n") / most).alias("salts")))
    shape = "h bigint, template_id bigint, template string, leaf bigint"

    def assigned(rows: DataFrame) -> DataFrame:
        return rows.repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "line").mapInArrow(lambda b: _assign(b, similar, lead), shape)

    salted = lines.join(F.broadcast(hot), F.col("leaf") == F.col("_leaf"), "left").select("leaf", F.coalesce(F.pmod("h", "salts"), F.lit(0)).alias("salt"), "h", "line")
    found = table(assigned(salted))
    parts = found.join(F.broadcast(hot), F.col("leaf") == F.col("_leaf"), "left_semi").groupBy("leaf", "template").agg(F.min("template_id").alias("h"))
    whole = table(assigned(parts.select("leaf", F.lit(0).alias("salt"), "h", F.col("template").alias("line"))).select("leaf", F.col("h").alias("_part"), F.col("template_id").alias("_whole"), F.col("template").alias("_text")))
    by_text = parts.select("leaf", "template", F.col("h").alias("_part")).join(whole, ["leaf", "_part"])  # one template can come from several parts
    found = found.join(by_text.drop("_part"), ["leaf", "template"], "left").select("h", F.coalesce("_whole", "template_id").alias("template_id"), F.regexp_replace(F.coalesce("_text", "template"), r"\x00", ANY).alias("template"))
    found = table(found)
    counts = seen.select("d", "h").join(found, "h").groupBy("template_id").agg(F.countDistinct("d").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    return table(found.join(counts, "template_id"))


def _cleaned(docs: DataFrame, text: str, lead: int, similar: float, min_docs: int, send: int, leaf: int) -> DataFrame:
    """docs with columns n_lines, n_dropped and text in place of ``text``."""
    dropped = recurring(docs, lead, similar, min_docs, leaf).where("h != 0").select("h").distinct()  # 0 stands for blank lines
    own = docs.withColumn("_h", F.transform(_trimmed(F.col(text)), lambda x: F.when(x != "", F.xxhash64(x)).otherwise(F.lit(0).cast("bigint"))))
    if dropped.count() <= send:
        known = np.sort(np.array([r[0] for r in dropped.toLocalIterator()], np.int64))
        sent = docs.sparkSession.sparkContext.broadcast(known)

        @F.pandas_udf("array<boolean>")
        def gone(hashes: pd.Series) -> pd.Series:
            size = [0 if x is None else len(x) for x in hashes]
            if not sum(size):
                return pd.Series([None if x is None else np.zeros(0, bool) for x in hashes], dtype=object)
            flat = np.concatenate([x for x in hashes if x is not None]).astype(np.int64)
            there = np.zeros(len(flat), bool)
            if len(sent.value):
                there = sent.value[np.minimum(np.searchsorted(sent.value, flat), len(sent.value) - 1)] == flat
            parts = iter(np.split(there, np.cumsum([n for n, x in zip(size, hashes) if x is not None])[:-1]))
            return pd.Series([None if x is None else next(parts) for x in hashes], dtype=object)

        own = own.withColumn("_gone", gone("_h"))
    else:
        own = own.withColumn("_row", F.monotonically_increasing_id())
        own = table(own)
        hit = own.select("_row", F.posexplode("_h").alias("_pos", "h")).join(dropped, "h").groupBy("_row").agg(F.collect_set("_pos").alias("_at"))
        own = own.join(hit, "_row", "left").withColumn("_gone", F.transform("_h", lambda _, i: F.coalesce(F.array_contains("_at", i), F.lit(False)))).drop("_row", "_at")
    raw = F.split(F.col(text), "\n", -1)
    own = own.withColumn("_lines", raw)
    left = F.filter("_lines", lambda _, i: ~F.col("_gone")[i])
    own = own.withColumn("n_lines", F.when(F.col(text).isNotNull(), F.size("_lines"))).withColumn("n_dropped", F.when(F.col(text).isNotNull(), F.size("_lines") - F.size(left)))
    return own.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(left, "\n"))).drop("_h", "_gone", "_lines")


def cleaned(docs: DataFrame, lead: int = LEAD, similar: float = SIMILAR, min_docs: int = MIN_DOCS, send: int = SEND, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left."""
    return _cleaned(pick(docs, "doc_id", "text"), "text", lead, similar, min_docs, send, leaf).select("doc_id", "n_lines", "n_dropped", "text")


def clean(docs: DataFrame, lead: int = LEAD, similar: float = SIMILAR, min_docs: int = MIN_DOCS, send: int = SEND, leaf: int = LEAF) -> DataFrame:
    """All rows and columns of ``docs``, its text without recurring lines."""
    at = {c: f"_{index_of(docs, c)}" for c in ("doc_id", "text")}
    p = positional(docs)
    dropped_from = p.withColumnsRenamed({v: k for k, v in at.items()})
    out = _cleaned(dropped_from, "text", lead, similar, min_docs, send, leaf)
    return out.select(*["doc_id" if c == at["doc_id"] else "text" if c == at["text"] else c for c in p.columns]).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
