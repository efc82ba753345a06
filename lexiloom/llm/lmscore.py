"""Language-model scores from a causal self-attention model, trained here in numpy on subword ids.

Every document is encoded. Counts of all ids over all documents give CLASSES classes: the commonest ids are a class each,
the others share classes of about equal weight. The model predicts the next id's class by one layer of causal
self-attention over embeddings of the ids before it; an id's probability is its class's times its share of the class.

Training is data-parallel and sees every id of every document once as a target: windows of WINDOW targets tile the
documents, and are dealt in turn to ROUNDS rounds. In a round a task runs Adam over its windows from common parameters,
and the tasks' parameters are averaged, weighted by windows. Parameters (their size doesn't depend on the corpus) are
summed by Spark with partial sums, and only their average reaches the driver. They depend on how rows are split over
tasks, slightly.

Scoring runs windows of WINDOW ids that begin every STRIDE ids; a token is scored once, in the first window that holds
it, with what the window has before it. All windows of a batch go through masked attention at once.

Null or empty text: no tokens, nll 0, mean_nll and perplexity null. Null doc_id and repeated rows: scored as any row.
Very long texts: whole. Empty table: no rows (nothing is trained on). Ties of counts: the lower id is commoner. Other
columns are left out.
"""

from __future__ import annotations

import base64
import ctypes
import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_batches, pick, table
from .textvec import chunks
from .tokencounts import BLANK, PATTERN, VOCABULARY

WINDOW, STRIDE, DIM, SLOTS, CLASSES, SINGLE = 32, 24, 16, 4096, 64, 40
ROUNDS, BATCH, RATE = 2, 128, 0.01
SMALL = 256  # windows worked on at once in scoring
BYTES = 120_000  # of ids
VOCAB, BOS = 50_257, 50_256
WIDE_BLANKS = tuple({x.encode()[:1] for x in BLANK if x > "~"})  # first bytes
AHEAD, LAST_BLANK = r"|\s+(?!\S)", re.compile(f"(?<=[{BLANK}])(?=[{BLANK}][^{BLANK}])")
SHAPES = {"E": (SLOTS, DIM), "P": (WINDOW, DIM), "Q": (DIM, DIM), "K": (DIM, DIM), "V": (DIM, DIM), "O": (DIM, DIM), "U": (DIM, CLASSES), "b": (CLASSES,)}


class Encoder:
    """Ids of texts. PATTERN looks ahead for one thing only: the last of several blanks goes with what follows them. Texts are
    cut there first; then the pattern without looking ahead, which is matched faster, gives the same pieces."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN.replace(AHEAD, ""), mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        """Ids as 16-bit integers."""
        raw = text.encode("utf-8", "surrogatepass")
        blank = np.frombuffer(raw, np.uint8) <= 32
        if (blank[1:] & blank[:-1]).any() or any(x in raw for x in WIDE_BLANKS):
            return b"".join(array("H", self.encode(t)).tobytes() for t in LAST_BLANK.split(text))
        return array("H", self.encode(text)).tobytes()


@functools.cache
def steady_memory() -> None:
    """Has the C library keep freed memory in this worker: it would go back to the system with each large array, and
    getting it again costs as much as some of the arithmetic. Without such a library, nothing changes."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 30)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 29)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass


@functools.cache
def encoder(path: str = VOCABULARY) -> Encoder:
    return Encoder(path)


def slot(ids: np.ndarray) -> np.ndarray:
    """Row of the embedding table: ids share rows."""
    return (ids.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(20)).astype(np.int32)


@functools.cache
def _slots() -> np.ndarray:
    """slot() of every 16-bit id, to be looked up."""
    return slot(np.arange(1 << 16)).astype(np.intp)


def classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, log share of its class) of each id, from the counts of all ids; every id counts once more, so none is impossible."""
    n = counts.astype(np.float64) + 1
    order = np.lexsort((np.arange(len(n)), -n))
    own = np.empty(len(n), np.int32)
    own[order[:SINGLE]] = np.arange(SINGLE)
    rest = order[SINGLE:]
    before = np.cumsum(n[rest]) - n[rest]
    own[rest] = SINGLE + np.minimum(before / n[rest].sum() * (CLASSES - SINGLE), CLASSES - SINGLE - 1).astype(np.int32)
    return own, np.log(n / np.bincount(own, n, CLASSES)[own]).astype(np.float32)


def initial(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: (np.zeros(s) if k == "b" else rng.normal(0, 0.3 if k in "EP" else DIM**-0.5, s)).astype(np.float32) for k, s in SHAPES.items()}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


MASK = np.where(np.tril(np.ones((WINDOW, WINDOW), bool)), 0, -1e9).astype(np.float32)


def forward(p: dict, x: np.ndarray):
    """Log-probabilities of classes at each place of windows x (slots of the ids before), and what backward() needs."""
    e = p["E"][x] + p["P"]
    q, k, v = e @ (p["Q"] * np.float32(DIM**-0.5)), e @ p["K"], e @ p["V"]
    a = q @ k.transpose(0, 2, 1)
    a += MASK
    a -= a.max(-1, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(-1, keepdims=True)
    z = a @ v
    r = e + z @ p["O"]
    logit = r.reshape(-1, DIM) @ p["U"] + p["b"]
    logit -= logit.max(-1, keepdims=True)
    logit -= np.log(np.exp(logit).sum(-1, keepdims=True))
    return logit, (e, q, k, v, a, z, r)


KEEP = np.tril(np.ones((WINDOW, WINDOW), np.float32))


@functools.lru_cache(32)
def _scratch(name: str, shape: tuple, kind: np.dtype) -> np.ndarray:
    """An array to write over: large new ones cost more than what is done in them."""
    return np.empty(shape, kind)


def _in_range(sums: np.ndarray) -> bool:
    """Whether sums of exp are exact without moving what goes into exp by its maximum."""
    return bool(sums.min(initial=1) > 1e-20 and sums.max(initial=1) < 1e20)


def joined(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Products of matrices that always come one after the other: queries times keys, values times output. With them
    embeddings are keys and values themselves."""
    return p["Q"] @ p["K"].T * np.float32(DIM**-0.5), p["V"] @ p["O"]


def _embed(p: dict, x: np.ndarray) -> np.ndarray:
    e = p["E"].take(x.ravel(), 0, out=_scratch("e", (x.size, DIM), p["E"].dtype), mode="clip").reshape(*x.shape, DIM)
    e += p["P"]
    return e


def _attend(q: np.ndarray, e: np.ndarray, begin: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention without its division by its sums, one over these, and the embeddings it adds up (divided)."""
    a, one = _scratch("a", (*q.shape[:2], WINDOW), e.dtype), np.ones((WINDOW, 1), e.dtype)
    for shift in (False, True):
        np.matmul(q, e.transpose(0, 2, 1), out=a)
        if shift:
            a += MASK[begin:]
            a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        a *= KEEP[begin:]
        weight = a.reshape(-1, WINDOW) @ one
        if _in_range(weight):
            break
    np.divide(1, weight, out=weight)
    z = np.matmul(a, e, out=_scratch("z", q.shape, e.dtype)).reshape(-1, DIM)
    z *= weight
    return a, weight, z


def _softmax(p: dict, r: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """exp of logits in two factors, of places and of classes; their sums by place; logits of classes y, and where these are in the first factor."""
    g, b = _scratch("logit", (len(r), CLASSES), r.dtype), p["b"]
    flat, place = g.ravel(), np.arange(0, g.size, CLASSES) + y
    for shift in (False, True):
        np.matmul(r, p["U"], out=g)
        if shift:
            g += b
            g -= g.max(-1, keepdims=True)
            b = np.zeros_like(b)
        own = flat[place] + b[y]
        np.exp(g, out=g)
        top = np.exp(b)
        total = g @ top
        if _in_range(total) and _in_range(top):
            break
    return g, top, total, own, place


@np.errstate(over="ignore", under="ignore", invalid="ignore")
def target_logp(p: dict, x: np.ndarray, y: np.ndarray, begin: int = 0) -> np.ndarray:
    """As forward(), for one class a place, from place ``begin`` of each window on: masks by product, and divides sums and
    not whole matrices."""
    inner, outer = joined(p)
    e = _embed(p, x)
    own = e[:, begin:].reshape(-1, DIM)
    _, _, z = _attend((own @ inner).reshape(len(x), WINDOW - begin, DIM), e, begin)
    r = np.matmul(z, outer, out=_scratch("r", z.shape, z.dtype))
    r += own
    _, _, total, own, _ = _softmax(p, r, y)
    return own - np.log(total)


@np.errstate(over="ignore", under="ignore", invalid="ignore")
def backward(p: dict, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[float, dict]:
    """Mean loss over the places where m is true, and gradients. Matrices of classes and of attention are left undivided;
    the narrow ones made of them are multiplied instead."""
    n, kind, y = x.size, p["E"].dtype, y.ravel()
    inner, outer = joined(p)
    e = _embed(p, x)
    e2 = e.reshape(n, DIM)
    q = np.matmul(e2, inner, out=_scratch("q", e2.shape, kind)).reshape(e.shape)
    a, weight, z = _attend(q, e)
    r = np.matmul(z, outer, out=_scratch("r", e2.shape, kind))
    r += e2
    g, top, total, own, place = _softmax(p, r, y)
    part = m.ravel() / kind.type(max(1, m.sum()))
    loss = float((np.log(total) - own) @ part)
    g.ravel()[place] -= (total / top[y]).astype(kind, copy=False)
    part /= total
    dr = np.matmul(g, (p["U"] * top).T, out=_scratch("dr", e2.shape, kind))
    dr *= part[:, None]
    r *= part[:, None]
    d = {"U": (g.T @ r).T * top, "b": (part @ g) * top}
    mixed = z.T @ dr
    d["V"], d["O"] = mixed @ p["O"].T, p["V"].T @ mixed
    dz = np.matmul(np.multiply(dr, weight, out=r), outer.T, out=_scratch("dz", e2.shape, kind))
    dz3 = dz.reshape(e.shape)
    ds = np.matmul(dz3, e.transpose(0, 2, 1), out=_scratch("ds", a.shape, kind))
    ds -= np.einsum("ij,ij->i", dz, z).reshape(*x.shape, 1)
    ds *= a
    de = np.matmul(ds.transpose(0, 2, 1), q, out=_scratch("de", e.shape, kind)).reshape(n, DIM)
    de += dr
    de += np.matmul(a.transpose(0, 2, 1), dz3, out=q).reshape(n, DIM)
    dq = np.matmul(ds, e, out=dz3).reshape(n, DIM)
    de += np.matmul(dq, inner.T, out=dr)
    mixed = e2.T @ dq * np.float32(DIM**-0.5)
    d["Q"], d["K"] = mixed @ p["K"], mixed.T @ p["Q"]
    d["P"] = (np.ones(len(x), kind) @ de.reshape(len(x), -1)).reshape(WINDOW, DIM)
    at = np.add((x.ravel() * DIM)[:, None], np.arange(DIM), out=_scratch("at", de.shape, np.intp))
    d["E"] = np.zeros_like(p["E"])
    np.add.at(d["E"].ravel(), at.ravel(), de.ravel())
    return loss, d


def train(p: dict, windows: Iterator[np.ndarray], cls: np.ndarray, rate: float = RATE) -> tuple[dict, int]:
    """Adam over windows of WINDOW + 1 ids, in batches as they come; how many windows there were."""
    x = flat(p)
    p, at = {}, 0
    for k, s in SHAPES.items():  # views of x
        p[k] = x[at : at + int(np.prod(s))].reshape(s)
        at += p[k].size
    first, second, d = (np.zeros_like(x) for _ in range(3))  # the first two are 10 and 100 times Adam's means
    slots, cls = _slots(), cls.astype(np.intp)
    seen, step = 0, 0
    for w in windows:
        seen, step = seen + len(w), step + 1
        target = w[:, 1:]
        _, found = backward(p, slots[w[:, :-1]], cls[target], target != BOS)
        np.concatenate([found[k].ravel() for k in SHAPES], out=d, casting="same_kind")
        first *= np.float32(0.9)
        first += d
        d *= d
        second *= np.float32(0.99)
        second += d
        root = 0.1 / (1 - 0.99**step) ** 0.5
        np.sqrt(second, out=d)
        d += np.float32(1e-8 / root)
        np.divide(first, d, out=d)
        d *= np.float32(0.1 / root * rate / (1 + step / 2000) / (1 - 0.9**step))
        x -= d
    return unflat(x), seen


def tiles(docs: list[np.ndarray]) -> np.ndarray:
    """Windows of WINDOW + 1 ids, each the id before and WINDOW targets, that tile every document: each id is a target once."""
    size = np.array([len(d) for d in docs], np.int64)
    n = -(-size // WINDOW)
    begin = np.cumsum(n) - n
    out, held = np.empty((n.sum(), WINDOW + 1), np.uint16), np.full(n.sum() * WINDOW, BOS, np.uint16)
    for at, d in zip((begin * WINDOW).tolist(), docs):
        held[at : at + len(d)] = d
    out[:, 1:] = held.reshape(-1, WINDOW)
    out[1:, 0] = out[:-1, -1]
    out[begin[n > 0], 0] = BOS
    return out


def score(p: dict, cls: np.ndarray, share: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """Negative log-likelihood of each document (ids)."""
    size = np.array([len(d) for d in docs], np.int64)
    total, there = np.zeros(len(docs)), np.flatnonzero(size)
    if not len(there):
        return total
    n = 1 + np.maximum(0, -(-(size[there] - WINDOW) // STRIDE))
    first = np.cumsum(n + 1) - n - 1  # windows begin every STRIDE places of one array, each document's with one more for its end
    begin, end = first * STRIDE, first * STRIDE + size[there]
    ids = np.zeros((first[-1] + n[-1] + 1) * STRIDE + WINDOW - STRIDE, np.uint16)
    for k, at in zip(there.tolist(), begin.tolist()):
        ids[at : at + len(docs[k])] = docs[k]
    before = np.concatenate(([BOS], ids[:-1])).astype(np.uint16)
    before[begin] = BOS
    x, y = (np.lib.stride_tricks.sliding_window_view(v, WINDOW)[::STRIDE] for v in (_slots()[before], cls[ids]))
    later = np.ones(len(x), bool)
    later[first] = later[first + n] = False
    value = np.zeros(len(ids))
    head, new = value[: len(x) * STRIDE].reshape(-1, STRIDE), value[WINDOW - STRIDE :].reshape(-1, STRIDE)
    for own, skip in ((first, 0), (np.flatnonzero(later), WINDOW - STRIDE)):  # a document's first window is scored whole, of the others only what is new
        for u in range(0, len(own), SMALL):
            part = own[u : u + SMALL]
            found = target_logp(p, x[part], y[part, skip:].ravel(), skip).reshape(len(part), -1)
            if not skip:
                head[part, : WINDOW - STRIDE] = found[:, : WINDOW - STRIDE]
            new[part] = found[:, -STRIDE:]
    value += share[ids]
    total[there] = -np.add.reduceat(value, np.stack((begin, end), 1).ravel())[::2]
    return total


def _gather(own: DataFrame, vocabulary: str) -> DataFrame:
    """Of (doc_id, text): rows (id, n), counts of ids by task; rows (doc_id, ids), encoded documents.
    A table: texts are encoded once."""
    kind = own.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    shape = pa.schema([("id", pa.int32()), ("n", pa.int64()), ("doc_id", arrow), ("ids", pa.binary())])

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in shape], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, counts = encoder(vocabulary), np.zeros(VOCAB, np.int64)
        for b in batches:
            whole = [enc.ids(t or "") for t in b.column(1).to_pylist()]
            for _, held in chunks(whole, BYTES):
                counts += np.bincount(np.frombuffer(b"".join(x or b"" for x in held), np.uint16), minlength=VOCAB)
            yield rows(len(whole), doc_id=b.column(0), ids=pa.array(whole, pa.binary()))
        at = np.flatnonzero(counts)
        yield rows(len(at), id=pa.array(at, pa.int32()), n=pa.array(counts[at], pa.int64()))

    out = [("id", T.IntegerType()), ("n", T.LongType()), ("doc_id", kind), ("ids", T.BinaryType())]
    return table(own.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in out])))


def fit(docs: DataFrame, rounds: int = ROUNDS, vocabulary: str = VOCABULARY) -> tuple[dict, np.ndarray, np.ndarray]:
    """Parameters, and class and log share of each id."""
    arrow_batches(docs.sparkSession)
    return _fit(_gather(pick(docs, "doc_id", "text"), vocabulary), rounds)


def _fit(gathered: DataFrame, rounds: int) -> tuple[dict, np.ndarray, np.ndarray]:
    spark = gathered.sparkSession
    counts = np.zeros(VOCAB, np.int64)
    for i, n in gathered.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).collect():  # as many as the vocabulary has
        counts[i] = n
    cls, share = classes(counts)
    p = flat(initial())
    for turn in range(rounds):
        now = spark.sparkContext.broadcast((p, cls))

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def windows() -> Iterator[np.ndarray]:
                left, before = np.empty((0, WINDOW + 1), np.uint16), 0
                for b in batches:
                    for _, held in chunks(b.column(0).to_pylist(), BYTES):
                        found = tiles([np.frombuffer(x or b"", np.uint16) for x in held])
                        own = found[(turn - before) % rounds :: rounds]  # each window in one round
                        before += len(found)
                        left = np.concatenate((left, own))
                        whole = len(left) // BATCH * BATCH
                        yield from (left[u : u + BATCH] for u in range(0, whole, BATCH))
                        left = left[whole:]
                if len(left):
                    yield left

            steady_memory()
            start, known = now.value
            done, seen = train(unflat(start), windows(), known)
            if seen:
                x = flat(done).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x * seen), pa.array(np.full(len(x), float(seen)))], ["i", "s", "w"])

        mean = gathered.where("ids is not null").select("ids").mapInArrow(local, "i int, s double, w double").groupBy("i").agg((F.sum("s") / F.sum("w")).alias("x")).toPandas()  # as many as the model has
        if not len(mean):
            break
        p = np.zeros(len(p))
        p[mean["i"]] = mean["x"]
        now.unpersist()
    return unflat(np.asarray(p)), cls, share


def scores(docs: DataFrame, model: tuple | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, nll, mean_nll, perplexity; the model is fit() of the documents themselves unless given."""
    arrow_batches(docs.sparkSession)
    gathered = _gather(pick(docs, "doc_id", "text"), vocabulary)
    own = gathered.where("ids is not null").select("doc_id", "ids")
    sent = docs.sparkSession.sparkContext.broadcast(model or _fit(gathered, ROUNDS))
    fields = [T.StructField("doc_id", own.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("nll", "mean_nll", "perplexity"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        p, cls, share = sent.value
        for b in batches:
            n, nll = [], []
            for _, held in chunks(b.column(1).to_pylist(), BYTES):
                ids = [np.frombuffer(x, np.uint16) if x else np.empty(0, np.uint16) for x in held]
                n += map(len, ids)
                nll += score(p, cls, share, ids).tolist()
            mean = [x / k if k else None for x, k in zip(nll, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(nll, pa.float64()), pa.array(mean, pa.float64()), pa.array([None if x is None else float(np.exp(x)) for x in mean], pa.float64())], [f.name for f in fields])

    return own.mapInArrow(run, T.StructType(fields))


def query(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
