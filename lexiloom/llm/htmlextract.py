"""HTML extraction by union-free regular expressions, one wrapper a host.

A page is a stream of tags (name and first class) and text. Streams of the same host are aligned one after another with
the host's wrapper: what one side lacks becomes optional, a run of elements that follows itself becomes a repeated group
(the shortest runs first), and text is a slot. The wrapper is a regular expression without unions: sequences of elements
and groups, each once, optional (?), repeated (+) or both (*). A host's distinct page skeletons are aligned in two levels,
dealt by their hashes and in their order, so no task sees all pages of a large host, and the wrapper depends on the pages
alone: not on their order, nor on the split of the input. Alignments are longest common subsequences by bit vectors.

Each page is then read through its host's wrapper, which names the slot of each text. A slot that has the same text in
all pages of a host (of which two at least differ) is part of the template; the text of all other slots is the page's
content.

Inline markup (b, i, span...) doesn't part text. Scripts, styles and comments are left out. Elements nest to any depth.
Null html: null text, no fields. Empty html, or no text: "" and no fields. Null or odd url: host "". Null page_id,
repeated rows: read as any row; copies of one page alone are no template. Very long pages: whole. Empty table: no rows.
Ties of alignment: always the same. Other columns are left out.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, pick, table

SEND_BYTES = 64_000_000  # wrappers that may be sent to every executor
PIECES = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>?|[^<]++|<",
    re.S | re.I,
)
CLASS = re.compile(r"\bclass\s*=\s*[\"']?\s*([^\"'\s>]+)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("b i u s em strong small big sup sub span font mark abbr code tt cite q var kbd samp del ins".split())
CLOSES = {x: names for names in (("p",), ("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)) for x in names}  # what an open tag ends
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HOLDS = frozenset("ul ol dl table select div article section body".split())
TEXT = "#"
CELLS = 1 << 31  # bits of an alignment's table; a larger one is cut in two
sys.setrecursionlimit(10**6)  # of Python functions, which need no C stack: elements nest to any depth


def parse(source: str) -> list:
    """The page as nodes [symbol, children or text]."""
    top: list = []
    stack: list[tuple[str, list]] = [("", top)]
    held: list[str] = []
    open_: Counter = Counter()  # names on the stack

    def close(at: int) -> None:
        open_.subtract(name for name, _ in stack[at:])
        del stack[at:]

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                stack[-1][1].append([TEXT, text])

    for m in PIECES.finditer(source):
        name = m[3]
        if name is None:
            if m[0][0] != "<" or len(m[0]) == 1:
                held.append(m[0])
            continue
        name = name.lower()
        if name in INLINE:
            continue
        flush()
        if m[2]:
            if open_[name] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
            continue
        if name in CLOSES or name in BLOCKS:  # a block ends an open paragraph
            ends = CLOSES.get(name, ("p",))
            for i in range(len(stack) - 1, 0, -1) if any(open_[x] > 0 for x in ends) else ():
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in HOLDS:
                    break
        c = CLASS.search(m[4]) if m[4] else None
        node = [f"{name}.{c[1]}" if c else name, []]
        stack[-1][1].append(node)
        if name not in VOID and not m[4].endswith("/"):
            stack.append((name, node[1]))
            open_[name] += 1
    flush()
    return top


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists: one bit vector a member of b (n m / 64 steps)."""
    n, m = len(a), len(b)
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    out, k = [(x, x) for x in range(i)], 0
    while k < min(n, m) - i and a[n - 1 - k] == b[m - 1 - k]:
        k += 1
    tail = [(n - x, m - x) for x in range(k, 0, -1)]
    a, b, shift = a[i : n - k], b[i : m - k], i
    if not a or not b:
        return out + tail
    if len(a) * len(b) > CELLS:
        half = len(b) // 2
        left, right = _rows(a, b[:half])[-1], _rows(a[::-1], b[half:][::-1])[-1]
        best, cut, gain = -1, 0, 0
        after = [0]
        for x in range(len(a)):
            after.append(after[-1] + (1 - (right >> x & 1)))
        for x in range(len(a) + 1):
            if gain + after[len(a) - x] > best:
                best, cut = gain + after[len(a) - x], x
            gain += 1 - (left >> x & 1)
        mid = common(a[:cut], b[:half]) + [(x + cut, y + half) for x, y in common(a[cut:], b[half:])]
    else:
        rows, mid = _rows(a, b), []
        x, y = len(a), len(b)
        while x and y:
            if rows[y] >> (x - 1) & 1:
                x -= 1
            else:
                y -= 1
                if rows[y] >> (x - 1) & 1:
                    x -= 1
                    mid.append((x, y))
        mid.reverse()
    return out + [(x + shift, y + shift) for x, y in mid] + tail


def _rows(a: list, b: list) -> list[int]:
    """For each prefix of b, a bit for each place of a: 0 where the common subsequence grows by one there."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, out = full, [full]
    keep = len(a) * len(b) <= CELLS
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            out.append(v)
        else:
            out = [v]
    return out


class Wrappers:
    """Wrappers as tuples of node numbers. A node is (optional, repeated, symbol, children), kept once, so equal ones have
    one number. A group of several elements has the symbol "(...)"."""

    def __init__(self):
        self.nodes: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.places: dict[tuple, tuple] = {}

    def node(self, optional: bool, repeated: bool, symbol: str, kids: tuple = ()) -> int:
        x = (optional, repeated, symbol, kids)
        if x not in self.ids:
            self.ids[x] = len(self.nodes)
            self.nodes.append(x)
        return self.ids[x]

    def symbols(self, seq) -> list[str]:
        return [self.nodes[i][2] for i in seq]

    def skeleton(self, page: list) -> tuple:
        """The wrapper of a page alone."""
        out = []
        for symbol, inner in page:
            out.append(self.node(False, False, symbol, () if symbol == TEXT else self.skeleton(inner)))
        return self.folded(out)

    def folded(self, seq: list) -> tuple:
        """Runs that follow themselves become repeated groups, shortest runs first."""
        p = 1
        while 2 * p <= len(seq):
            names, out, i, n = self.symbols(seq), [], 0, len(seq)
            while i < n:
                k = i + p
                if k + p <= n and names[i] == names[k] and names[i:k] == names[k : k + p]:
                    body = list(seq[i:k])
                    while names[i : i + p] == names[k : k + p]:
                        for x in range(p):
                            body[x] = self.unite(body[x], seq[k + x], p == 1)
                        k += p
                    out.append(self.again(body))
                    i = k
                else:
                    out.append(seq[i])
                    i += 1
            p, seq = (p + 1, seq) if len(out) == len(seq) else (1 if p > 1 else 2, out)
        return tuple(seq)

    def again(self, body: list) -> int:
        if len(body) == 1:
            o, _, symbol, kids = self.nodes[body[0]]
            return self.node(o, symbol != TEXT, symbol, kids)
        return self.node(False, True, "(" + " ".join(self.symbols(body)) + ")", tuple(body))

    def unite(self, x: int, y: int, all_: bool = False) -> int:
        """One node for two of a symbol; optional if either is, or with all_ if both are."""
        if x == y:
            return x
        (o, r, symbol, kids), (p, q, _, more) = self.nodes[x], self.nodes[y]
        return self.node(o and p if all_ else o or p, r or q, symbol, self.align(kids, more))

    def grouped(self, seq: tuple, other: tuple) -> tuple:
        """seq with the groups that the other side has, where their elements stand in it without a group."""
        for i in other:
            symbol, kids = self.nodes[i][2:]
            if symbol[0] == "(":
                names, want, out, at = self.symbols(seq), self.symbols(kids), [], 0
                while at < len(seq):
                    if names[at : at + len(want)] == want:
                        out.append(self.node(False, False, symbol, tuple(seq[at : at + len(want)])))
                        at += len(want)
                    else:
                        out.append(seq[at])
                        at += 1
                if len(out) < len(seq):
                    seq = self.folded(out)
        return tuple(seq)

    def align(self, a: tuple, b: tuple) -> tuple:
        """The wrapper of all that either wrapper describes."""
        if a == b:
            return a
        a, b = self.grouped(a, b), self.grouped(b, a)
        out, i, j = [], 0, 0
        for x, y in [*common(self.symbols(a), self.symbols(b)), (len(a), len(b))]:
            for k in [*a[i:x], *b[j:y]]:
                out.append(self.node(True, *self.nodes[k][1:]))
            if x < len(a):
                out.append(self.unite(a[x], b[y]))
            i, j = x + 1, y + 1
        return self.folded(out)

    def covers(self, wrapper: tuple, page: tuple) -> bool:
        """Whether the wrapper describes a skeleton as it is: then there is nothing to align."""
        if wrapper == page:
            return True
        i, nodes = 0, self.nodes
        for k in self.grouped(page, wrapper):
            o, r, symbol, kids = nodes[k]
            while i < len(wrapper) and nodes[wrapper[i]][2] != symbol and nodes[wrapper[i]][0]:
                i += 1
            if i == len(wrapper) or nodes[wrapper[i]][2] != symbol:
                return False
            w = nodes[wrapper[i]]
            if (o and not w[0]) or (r and not w[1]) or not self.covers(w[3], kids):
                return False
            i += 1
        for k in wrapper[i:]:
            if not nodes[k][0]:
                return False
        return True

    def expression(self, wrapper: tuple) -> str:
        """The wrapper as a regular expression over tags."""
        parts = []
        for k in wrapper:
            o, r, symbol, kids = self.nodes[k]
            body = TEXT if symbol == TEXT else self.expression(kids) if symbol[0] == "(" else f"<{symbol}>{self.expression(kids)}</>"
            mark = "*" if o and r else "?" if o else "+" if r else ""
            parts.append(f"({body}){mark}" if mark or symbol[0] == "(" else body)
        return "".join(parts)

    def dump(self, wrapper: tuple) -> str:
        """Flat, so that depth doesn't matter: nodes after their children."""
        out = []

        def walk(seq: tuple) -> None:
            for k in seq:
                o, r, symbol, kids = self.nodes[k]
                walk(kids)
                out.append([2 * o + r, symbol, len(kids)])

        walk(wrapper)
        return json.dumps(out, separators=(",", ":"), ensure_ascii=False)

    def load(self, text: str) -> tuple:
        stack: list[int] = []
        for flags, symbol, n in json.loads(text):
            kids = tuple(stack[len(stack) - n :])
            del stack[len(stack) - n :]
            stack.append(self.node(flags > 1, flags % 2 == 1, symbol, kids))
        return tuple(stack)

    def _places(self, wrapper: tuple) -> tuple:
        """(elements of a sequence without its groups, their places by symbol, the repeated groups around each)."""
        if wrapper not in self.places:
            flat: list[int] = []
            loops: list[list] = []

            def walk(seq: tuple, around: list) -> None:
                for k in seq:
                    _, r, symbol, kids = self.nodes[k]
                    if symbol[0] == "(":
                        span = [len(flat), 0]
                        walk(kids, [span, *around] if r else around)
                        span[1] = len(flat)
                    else:
                        flat.append(k)
                        loops.append(around)

            walk(wrapper, [])
            at: dict[str, list[int]] = {}
            for i, k in enumerate(flat):
                at.setdefault(self.nodes[k][2], []).append(i)
            self.places[wrapper] = (flat, at, loops)
        return self.places[wrapper]

    def read(self, wrapper: tuple, page: list, path: str = "", out: list | None = None) -> list[tuple[str, str]]:
        """(slot, text) of a page; text where the wrapper has no place has the slot of the place before, and a question mark."""
        flat, at, loops = self._places(wrapper)
        out, i, last = [] if out is None else out, 0, -1
        for kind, inner in page:
            held = at.get(kind, ())
            k = bisect_left(held, i)
            j = held[k] if k < len(held) else -1
            for start, end in loops[last] if last >= 0 and held else ():
                if 0 <= j < end:
                    break
                k = bisect_left(held, start)
                if k < len(held) and held[k] < end:
                    j = held[k]
                    break
            if j < 0:
                here, below = f"{path}/{i}?", ()
            else:
                _, r, _, kids = self.nodes[flat[j]]
                here, below, last, i = f"{path}/{j}", kids, j, j if r or kind == TEXT else j + 1
            if kind == TEXT:
                out.append((here, inner))
            else:
                self.read(below, inner, here, out)
        return out


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of all pages (host, html)."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = Wrappers()
            found = {(host, own.dump(own.skeleton(parse(source)))) for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["host", "wrapper"])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        own = Wrappers()
        w, *rest = (own.load(x) for x in sorted(pdf["wrapper"], key=lambda x: (len(x), x)))
        for x in rest:
            if not own.covers(w, x):
                w = own.align(w, x)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [own.dump(w)]})

    part = table(pages.where("html is not null").select("host", "html").mapInArrow(shapes, "host string, wrapper string").distinct())
    salts = part.groupBy("host").agg(F.ceil(F.sqrt(F.count("*"))).alias("salts"))  # of each host by its own number of skeletons
    dealt = part.join(salts, "host").withColumn("salt", F.pmod(F.xxhash64("wrapper"), "salts"))
    level = dealt.groupBy("host", "salt").applyInPandas(together, "host string, wrapper string")
    return table(level.groupBy("host").applyInPandas(together, "host string, wrapper string"))


def _hosts(pages: DataFrame) -> DataFrame:
    own = pick(pages, "page_id", "url", "html")
    return own.select("page_id", F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"), "html")


def _with_host(rows: DataFrame, info: DataFrame, column: str, send: int) -> DataFrame:
    """rows with their host's value: sent to all executors if it is small (its size is checked), else joined."""
    size = info.agg(F.sum(F.length(F.col(column).cast("string")))).first()[0] or 0
    right = info.select(F.col("host").alias("_host"), column)
    return rows.join(F.broadcast(right) if size <= send else right, F.col("host") == F.col("_host"), "left").drop("_host")


def extract(pages: DataFrame, send: int = SEND_BYTES) -> DataFrame:
    """page_id, host, n_fields, fields (slot and text, in page order, without the template's) and text (the fields' lines)."""
    spark = pages.sparkSession
    arrow_batches(spark)
    own = _hosts(pages)
    kind = own.schema["page_id"].dataType
    slots = T.ArrayType(T.StructType([T.StructField("slot", T.StringType()), T.StructField("text", T.StringType())]))

    def fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("slot", pa.string()), ("text", pa.string())]))
        for b in batches:
            out, own, known = [], Wrappers(), {}
            for source, w in zip(b.column("html").to_pylist(), b.column("wrapper").to_pylist()):
                if w is not None and w not in known:
                    known[w] = own.load(w)
                out.append(None if source is None else [{"slot": s, "text": t} for s, t in own.read(known[w], parse(source))])
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("page"), pa.array(out, shape)], ["page_id", "host", "page", "fields"])

    found = _with_host(own, wrappers(own), "wrapper", send).select("page_id", "host", "html", "wrapper", F.xxhash64("html").alias("page"))
    found = table(found.mapInArrow(fields, T.StructType([T.StructField("page_id", kind), T.StructField("host", T.StringType()), T.StructField("page", T.LongType()), T.StructField("fields", slots)])))
    pages_of = found.where("fields is not null").groupBy("host").agg(F.count("*").alias("pages"), F.min("page").alias("p"), F.max("page").alias("q"))
    once = F.array_distinct(F.transform("fields", lambda f: F.struct(f["slot"].alias("slot"), F.xxhash64(f["text"]).alias("h"))))  # a page counts once for a slot's text
    each = found.select("host", F.explode(once).alias("f")).select("host", "f.slot", "f.h")
    same = each.groupBy("host", "slot").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("n")).where("lo = hi")
    constant = table(same.join(pages_of, "host").where("p != q and n = pages").groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("fixed")))
    out = _with_host(found, constant, "fixed", send)
    out = out.withColumn("fields", F.filter("fields", lambda f: ~F.coalesce(F.array_contains("fixed", f["slot"]), F.lit(False))))
    return out.select("page_id", "host", F.coalesce(F.size("fields"), F.lit(0)).cast("bigint").alias("n_fields"), "fields", F.array_join(F.transform("fields", lambda f: f["text"]), "\n").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
