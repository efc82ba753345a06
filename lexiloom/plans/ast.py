"""Patterns over tokens, as both query languages give them."""

from __future__ import annotations

from dataclasses import dataclass


class QuerySyntaxError(ValueError):
    """A query that doesn't parse."""


@dataclass(frozen=True)
class Test:
    """A column matches a regular expression as a whole; null matches nothing."""

    column: str
    regex: str
    fold: bool = False
    negate: bool = False


@dataclass(frozen=True)
class Bool:
    """All (and) or any (or) of several conditions."""

    all: bool
    parts: tuple


@dataclass(frozen=True)
class Token:
    """One token; condition None means any."""

    condition: Test | Bool | None


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Rep:
    """least to most times; most None: without end."""

    body: object
    least: int
    most: int | None


@dataclass(frozen=True)
class Bind:
    name: str
    body: object


def children(node) -> tuple:
    if isinstance(node, (Seq, Alt)):
        return node.parts
    return (node.body,) if isinstance(node, (Rep, Bind)) else ()


def variables(node) -> list[str]:
    """Names in the order in which bindings close, inner first."""
    out = [v for c in children(node) for v in variables(c)]
    return [*out, node.name] if isinstance(node, Bind) else out


def conditions(node) -> list:
    """Distinct token conditions in the order of their appearance."""
    out = [node.condition] if isinstance(node, Token) and node.condition is not None else []
    for c in children(node):
        out += conditions(c)
    return list(dict.fromkeys(out))


def tests(condition) -> list[Test]:
    return [condition] if isinstance(condition, Test) else [t for p in condition.parts for t in tests(p)]


def has_any(node) -> bool:
    return isinstance(node, Token) and node.condition is None or any(map(has_any, children(node)))


def fixed(node) -> list | None:
    """The one sequence of conditions that a pattern without choices stands for, and None for all others."""
    if isinstance(node, Token):
        return [node.condition]
    if isinstance(node, Seq):
        parts = [fixed(p) for p in node.parts]
        return None if any(p is None for p in parts) else [c for p in parts for c in p]
    if isinstance(node, Rep) and node.least == node.most:
        body = fixed(node.body)
        return None if body is None else body * node.least
    return None


def fixed_spans(node, at: int = 0) -> tuple[list, dict[str, tuple[int, int]]] | None:
    """As fixed(), with bindings: the conditions and, by variable, the offsets where it begins and ends."""
    if isinstance(node, Bind):
        body = fixed_spans(node.body, at)
        return None if body is None else (body[0], body[1] | {node.name: (at, at + len(body[0]))})
    if isinstance(node, (Seq, Rep)):
        if isinstance(node, Rep) and node.least != node.most:
            return None
        conditions, spans = [], {}
        for part in node.parts if isinstance(node, Seq) else [node.body] * node.least:
            found = fixed_spans(part, at + len(conditions))
            if found is None:
                return None
            conditions, spans = conditions + found[0], spans | found[1]
        return conditions, spans
    return ([node.condition], {}) if isinstance(node, Token) else None
