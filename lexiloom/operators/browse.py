"""A concordance browser without a screen: filter, sort, shuffle and page, as plans."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.validate import check_choice, check_count

SIDES = ("_left_context", "_right_context")


class Browser:
    """Steps return a new browser at page 0. Columns left, match and right hold joined text."""

    def __init__(self, rows: DataFrame, column: str | None = None, page_size: int = 20):
        lists = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType) and not f.name.endswith(SIDES)]
        if column is None and not lists:
            raise ValueError("the table has no list column to show")
        self.column, self.page_size = column or lists[0], check_count(page_size, "page_size", 1)
        self.rows, self.term, self.order, self.seed = rows, None, None, None

    def _copy(self, **changes) -> Browser:
        out = object.__new__(Browser)
        out.__dict__.update(self.__dict__ | changes)
        return out

    def _list(self, side: str) -> Column:
        name = {"left": self.column + SIDES[0], "match": self.column, "right": self.column + SIDES[1]}[side]
        return F.col(f"`{name}`").cast("array<string>") if name in self.rows.columns else F.array().cast("array<string>")

    def text(self, side: str) -> Column:
        return F.array_join(self._list(side), " ")

    def filter(self, term: str | None) -> Browser:
        """Rows that have the term, as it is but for case, in context or match."""
        return self._copy(term=term or None)

    def sort(self, by: str | None, descending: bool = False) -> Browser:
        """By left (outwards from the match), match or right; None restores the order of matches."""
        return self._copy(order=None if by is None else (check_choice(by, ("left", "match", "right"), "by"), descending), seed=None)

    def shuffle(self, seed: int = 0) -> Browser:
        """A random order instead of a sorted one."""
        return self._copy(order=None, seed=seed)

    def table(self) -> DataFrame:
        """All rows with left, match, right and the rank that the order gives."""
        return self._ranked(None)

    def _ranked(self, most: int | None) -> DataFrame:
        """The first ``most`` rows, by a top-k: only they are ranked."""
        out = self.rows
        if self.term:
            found = [F.contains(F.lower(self.text(s)), F.lower(F.lit(self.term))) for s in ("left", "match", "right")]
            out = out.where(found[0] | found[1] | found[2])
        place = [F.col("file_id"), F.col("start")]
        if self.seed is not None:
            keys = [F.xxhash64("file_id", "start", F.lit(self.seed)), *place]
        elif self.order:
            side = self.order[0]
            text = F.lower(F.array_join(F.reverse(self._list("left")), " ") if side == "left" else self.text(side))
            keys = [text, *place]
        else:
            keys = place
        shown = out.select("file_id", "start", self.text("left").alias("left"), self.text("match").alias("match"), self.text("right").alias("right"), *[k.alias(f"_k{i}") for i, k in enumerate(keys[:-2])])
        sort = [F.col(f"_k{i}").desc() if self.order and self.order[1] else F.col(f"_k{i}") for i in range(len(keys) - 2)] + ["file_id", "start"]
        shown = shown if most is None else shown.orderBy(*sort).limit(most)
        return shown.withColumn("rank", F.row_number().over(Window.orderBy(*sort))).drop(*[f"_k{i}" for i in range(len(keys) - 2)])

    def page(self, number: int = 0) -> DataFrame:
        """One page; rows after it are cut off by a top-k before ranking."""
        return self.pages(number, number)

    def pages(self, first: int, last: int) -> DataFrame:
        """Pages from first to last, from one pass."""
        first = check_count(first, "first") * self.page_size
        return self._ranked((check_count(last, "last") + 1) * self.page_size).where(F.col("rank") > first).orderBy("rank")

    def to_html(self, number: int = 0) -> str:
        """A page as a static table."""
        cell = lambda x, side: f'<td class="{side}">{html.escape(x or "")}</td>'
        rows = ["<tr>" + "".join(cell(r[s], s) for s in ("left", "match", "right")) + "</tr>" for r in self.page(number).collect()]  # a page
        return f"<table>{''.join(rows)}</table>"
