"""A pattern as a program over bit masks, and its leftmost-longest matcher.

Starts are tried from left to right; at a start the longest match wins, with the captures of the first path (repeat
before leaving, left alternative before right) that reaches its end; empty matches don't count; the search goes on at a
match's end. A state (instruction, position) is visited once a start, so patterns with nested repeats take linear steps.
"""

from __future__ import annotations

from .ast import Alt, Bind, Rep, Seq, Token

TOKEN, ANY, SPLIT, JUMP, OPEN, CLOSE, MATCH = range(7)
ALL = -1


def compile_pattern(node, bits: dict) -> list[tuple]:
    """Instructions; bits: the bit of each token condition."""
    out: list[tuple] = []

    def emit(n) -> None:
        if isinstance(n, Token):
            out.append((ANY,) if n.condition is None else (TOKEN, 1 << bits[n.condition]))
        elif isinstance(n, Seq):
            for p in n.parts:
                emit(p)
        elif isinstance(n, Bind):
            out.append((OPEN, n.name))
            emit(n.body)
            out.append((CLOSE, n.name))
        elif isinstance(n, Alt):
            ends = []
            for i, p in enumerate(n.parts):
                if i + 1 < len(n.parts):
                    at = len(out)
                    out.append(())
                    emit(p)
                    ends.append(len(out))
                    out.append(())
                    out[at] = (SPLIT, at + 1, len(out))
                else:
                    emit(p)
            for e in ends:
                out[e] = (JUMP, len(out))
        elif isinstance(n, Rep):
            for _ in range(n.least - (n.most is None and n.least > 0)):
                emit(n.body)
            if n.most is None:
                at = len(out)
                if n.least:
                    emit(n.body)
                    out.append((SPLIT, at, len(out) + 1))
                else:
                    out.append(())
                    emit(n.body)
                    out.append((JUMP, at))
                    out[at] = (SPLIT, at + 1, len(out))
            else:
                for _ in range(n.most - n.least):
                    at = len(out)
                    out.append(())
                    emit(n.body)
                    out[at] = (SPLIT, at + 1, len(out))

    emit(node)
    out.append((MATCH,))
    return out


def prefix_bits(program: list[tuple], most: int = 8) -> list[int]:
    """For each of the first places of any match (as far as the shortest goes, at most so many): bits of which a token
    there has one; ALL if it can be any token."""
    out: list[int] = []
    states = {0}
    while len(out) < most:
        seen, todo, after, bits = set(), list(states), set(), 0
        while todo:
            pc = todo.pop()
            if pc in seen:
                continue
            seen.add(pc)
            op = program[pc]
            if op[0] == MATCH:
                return out
            if op[0] in (TOKEN, ANY):
                bits = ALL if op[0] == ANY or bits == ALL else bits | op[1]
                after.add(pc + 1)
            elif op[0] == SPLIT:
                todo += op[1:]
            else:
                todo.append(op[1] if op[0] == JUMP else pc + 1)
        out.append(bits)
        states = after
    return out


def first_bits(program: list[tuple]) -> int:
    """Bits of the conditions that a match can begin with; ALL if any token can."""
    seen, todo, bits = set(), [0], 0
    while todo:
        pc = todo.pop()
        if pc in seen:
            continue
        seen.add(pc)
        op = program[pc]
        if op[0] == TOKEN:
            bits |= op[1]
        elif op[0] == ANY:
            return ALL
        elif op[0] == SPLIT:
            todo += op[1:]
        elif op[0] == JUMP:
            todo.append(op[1])
        elif op[0] in (OPEN, CLOSE):
            todo.append(pc + 1)
    return bits


def match_at(program: list[tuple], get, start: int, end: int) -> tuple[int, tuple] | None:
    """(end, captures) of the longest match from ``start``; get(position) gives a token's bits, ``end`` is the file's."""
    best: tuple[int, tuple] | None = None
    seen: set[tuple[int, int]] = set()
    stack: list[tuple] = [(0, start, (), ())]
    while stack:
        pc, at, opened, caught = stack.pop()
        while (pc, at) not in seen:
            seen.add((pc, at))
            op = program[pc]
            kind = op[0]
            if kind == TOKEN:
                if at >= end or not get(at) & op[1]:
                    break
                pc, at = pc + 1, at + 1
            elif kind == ANY:
                if at >= end:
                    break
                pc, at = pc + 1, at + 1
            elif kind == SPLIT:
                stack.append((op[2], at, opened, caught))
                pc = op[1]
            elif kind == JUMP:
                pc = op[1]
            elif kind == OPEN:
                opened, pc = (*opened, at), pc + 1
            elif kind == CLOSE:
                caught, opened, pc = (*((n, s, e) for n, s, e in caught if n != op[1]), (op[1], opened[-1], at)), opened[:-1], pc + 1
            else:
                if at > start and (best is None or at > best[0]):
                    best = (at, caught)
                break
    return best


def match_all(program: list[tuple], get, starts, end: int, overlapping: bool = False) -> list[tuple[int, int, tuple]]:
    """(start, end, captures) of all matches of a file; starts: positions in order at which one can begin."""
    out, free = [], 0
    for s in starts:
        if s >= free and (found := match_at(program, get, s, end)):
            out.append((s, found[0], found[1]))
            free = s + 1 if overlapping else found[0]
    return out
