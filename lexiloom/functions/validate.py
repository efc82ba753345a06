"""Argument checks; every message names the parameter and what there is to choose from."""

from __future__ import annotations

import difflib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suggestion(value: str, choices: Iterable[str]) -> str:
    near = difflib.get_close_matches(str(value), list(choices), 1)
    return f" Did you mean {near[0]!r}?" if near else ""


def check_columns(df: DataFrame, **params: str | None) -> None:
    """Each parameter's value must be a column of df."""
    for name, value in params.items():
        if value is not None and value not in df.columns:
            raise ValueError(f"no column {value!r} (pass {name}=...); there are {', '.join(df.columns)}.{suggestion(value, df.columns)}")


def check_choice(value: str, choices: Iterable[str], param: str) -> str:
    """The choice in lower case."""
    choices = list(choices)
    if not isinstance(value, str) or value.lower() not in choices:
        raise ValueError(f"{param}={value!r} is none of {', '.join(choices)}.{suggestion(str(value).lower(), choices)}")
    return value.lower()


def check_choices(value: str | Iterable[str], choices: Iterable[str], param: str) -> list[str]:
    """One or more choices, without repeats, in order."""
    if isinstance(value, str):
        value = [value]
    if not isinstance(value, (list, tuple)) or not value:
        raise ValueError(f"{param} must be a name or a list of names that isn't empty")
    return list(dict.fromkeys(check_choice(v, choices, param) for v in value))


def check_count(value: int, param: str, least: int = 0) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{param} must be an integer, not {value!r}")
    if value < least:
        raise ValueError(f"{param} must be at least {least}, not {value}")
    return value


def as_column(expr: str | Column) -> Column:
    if isinstance(expr, str):
        return F.col(f"`{expr}`")
    if isinstance(expr, Column):
        return expr
    raise TypeError(f"expected a column name or a Column, not {expr!r}")


def output_name(df: DataFrame, expr: str | Column, param: str = "expr") -> str:
    """The name of the one column that an expression gives; no data is read."""
    if isinstance(expr, str):
        check_columns(df, **{param: expr})
        return expr
    names = df.select(as_column(expr)).columns
    if len(names) != 1:
        raise ValueError(f"{param} must give one column; it gives {', '.join(names) or 'none'}")
    return names[0]
