"""The ten operators against brute-force versions, and on nulls, empty and long texts, ties, repeats and odd columns."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lexiloom.llm import common, decontam, exactdedup, htmlextract, langid, linededup, lmscore, mixing, sharding, simhash, textvec, tokencounts

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EN = "the quick brown fox jumps over the lazy dog and runs through the green forest near the old river every single day of the week"
FR = "le renard brun saute par dessus le chien paresseux et court dans la foret verte pres de la vieille riviere chaque jour de la semaine"


def docs(spark, texts, sources=None, langs=None, start=0):
    rows = [(start + i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{x}" for x in rng.integers(0, words, n))


def odd(spark):
    """Null and empty text, null ids, repeated rows, one long text, and extra columns with clashing names."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (None, EN, "en", None), (3, EN, "en", "a"), (3, EN, "en", "a"), (4, " \n\t", "fr", "b"), (5, (EN + "\n") * 800, "en", "b"), (6, "x", "en", "a"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.withColumn("Text2", F.lit(1)).select("*", F.lit("z").alias("DOC_ID "), F.lit(0).alias("_0"), F.lit(0).alias("k"), F.lit(0).alias("row"), F.lit(0).alias("high"))


def clashing(spark):
    """A column twice, but for case."""
    return docs(spark, [EN, FR]).toDF("doc_id", "text", "lang", "source", "TEXT")


OPERATORS = {
    "simhash": simhash.groups, "lines": linededup.cleaned, "langid": langid.identify, "tokens": tokencounts.counts, "scores": lmscore.scores, "mixing": mixing.schedule,
    "shards": sharding.shard, "exact": lambda d: exactdedup.dedup(d, d.limit(0)), "leaks": lambda d: decontam.leaks(d, d.sparkSession.createDataFrame([(1, "quick brown fox jumps over the lazy")], "item_id int, text string")),
    "dedup": simhash.dedup, "accepted": langid.accepted, "clean": linededup.clean, "mixed": mixing.mixed,
    "decontaminated": lambda d: decontam.clean(d, d.sparkSession.createDataFrame([(1, "quick brown fox jumps over the lazy"), (None, None), (2, "")], "item_id int, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, name):
    df, op = odd(spark), OPERATORS[name]
    got = op(df).collect()
    if name not in ("leaks", "dedup", "accepted", "decontaminated"):
        assert len(got) == 9
    assert op(df.limit(0)).count() == 0
    assert op(clashing(spark)).count() >= 0


# 1 ----------------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    h, _ = textvec.words([text])
    h = np.unique(h >> np.uint64(20))
    h = textvec.mix(h)
    votes = [sum(1 if int(x) >> b & 1 else -1 for x in y) for y in (h, textvec.mix(h)) for b in range(64)]
    return sum(1 << b for b, v in enumerate(votes) if v > 0)


def test_fingerprints_are_votes():
    texts = [EN, "", None, FR, prose(np.random.default_rng(0), 3000, 2500), "one"]
    at, high, low = simhash.fingerprints(texts)
    assert at.tolist() == [0, 3, 4, 5]
    for i, h, lo in zip(at, high, low):
        assert (int(lo) << 64) | int(h) == plain_fingerprint(texts[i])


def some_fingerprints(rng, n=60):
    seeds = [int.from_bytes(rng.bytes(16), "big") for _ in range(n)]
    out = set(seeds)
    for s in seeds:
        for _ in range(6):
            out.add(s ^ sum(1 << int(b) for b in rng.choice(128, rng.integers(1, 34), replace=False)))
    out = sorted(out)
    return out, np.array([w >> 64 for w in out], np.uint64), np.array([w & (2**64 - 1) for w in out], np.uint64)


@pytest.mark.parametrize("level, budget", [(0, 22), (1, 22), (2, 22), (0, 8), (1, 8), (1, 30), (0, 1), (0, 0)])
def test_trie_join_is_exact(level, budget):
    words, high, low = some_fingerprints(np.random.default_rng(level + budget))
    want = {(i, j) for i, j in combinations(range(len(words)), 2) if (words[i] ^ words[j]).bit_count() <= budget}
    found = set()
    assert sum(simhash.blocks(budget)) == 128
    for turn, by in enumerate(simhash.turns(budget)):
        x, y = simhash.rotate(high, low, by)
        depth = simhash.tops(turn, budget)[level]
        own = (x >> np.uint64(64 - depth)).astype(int)
        for p in set(own.tolist()):
            for e in simhash.patterns(depth, turn, budget):
                q = p ^ e
                if q < p or q not in own:
                    continue
                a, b = (np.flatnonzero(own == z) for z in (p, q))
                a, b = a[np.lexsort((y[a], x[a]))], b[np.lexsort((y[b], x[b]))]
                for i, j in simhash.trie_pairs(x[a], y[a], x[b], y[b], p == q, depth, e.bit_count(), turn, budget):
                    found |= {tuple(sorted(t)) for t in zip(a[i].tolist(), b[j].tolist())}
    assert found == want


@pytest.mark.parametrize("most", [10**6, 40, 3])
def test_split_nodes_find_the_same_groups(spark, most):
    """Whole, split by one more block and by two: the first bits of many fingerprints are one, so their nodes are hot."""
    rng = np.random.default_rng(most % 97)
    words, _, _ = some_fingerprints(rng, 40)
    words = sorted({w if i % 3 else w & ~(0x3FF << 118) for i, w in enumerate(words)})
    high, low = (np.array([w >> k & (2**64 - 1) for w in words], np.uint64).view(np.int64) for k in (64, 0))
    table = spark.createDataFrame(list(zip(high.tolist(), low.tolist(), range(len(words)))), "high bigint, low bigint, rep bigint")
    deep = simhash.levels(table, most)
    assert set(np.unique(deep).tolist()) == {10**6: {0}, 40: {0, 1, 2}, 3: {0, 1, 2}}[most]
    found = {tuple(sorted(r)) for r in simhash.edges(table, len(words), most=most).collect()}
    assert all((words[a] ^ words[b]).bit_count() <= 128 for a, b in found)
    want = [(i, j) for i, j in combinations(range(len(words)), 2) if (words[i] ^ words[j]).bit_count() <= simhash.BUDGET]
    root = lambda pairs: simhash.roots(len(words), *(np.array(x, int) for x in zip(*pairs))).tolist()
    assert root(sorted(found)) == root(want)


def test_a_group_of_thousands_is_not_compared_in_full():
    rng = np.random.default_rng(3)
    high = np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 50, 20_000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 50, 20_000).astype(np.uint64))
    low = np.uint64(1) << rng.integers(0, 64, 20_000).astype(np.uint64)
    key = np.unique(np.stack((high, low)), axis=1)
    forest, pairs = simhash.Forest(key.shape[1]), 0
    for i, j in simhash.trie_pairs(key[0], key[1], key[0], key[1], True, 5, 0, forest=forest):
        pairs += len(i)
        forest.take(i, j)
    assert not forest.settle().any() and pairs < key.shape[1] ** 2 / 20


def brute_groups(texts):
    at, high, low = simhash.fingerprints(texts)
    near = np.bitwise_count(high[:, None] ^ high) + np.bitwise_count(low[:, None] ^ low).astype(int) <= simhash.BUDGET
    i, j = np.nonzero(np.triu(near, 1))
    root = simhash.roots(len(at), i, j)
    return {k: k for k in range(len(texts))} | {int(at[k]): int(at[root[k]]) for k in range(len(at))}


def near_copies(rng, n=25):
    texts = []
    for _ in range(n):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for k in rng.integers(0, 120, 5):
                copy[k] = f"v{rng.integers(0, 5000)}"
            texts.append(" ".join(copy))
    return texts


def test_simhash_groups(spark):
    rng = np.random.default_rng(1)
    texts = near_copies(rng) + [EN, EN, FR, None, "", None]
    got = {r.doc_id: r.keep_id for r in simhash.groups(docs(spark, texts)).collect()}
    assert got == brute_groups(texts)
    assert sum(got[4 * b + c] == 4 * b for b in range(25) for c in range(4)) >= 90  # of 100 planted
    kept = simhash.dedup(docs(spark, texts))
    assert kept.columns == DOCS.replace(" bigint", "").replace(" string", "").split(", ")
    assert {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if k == v}


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a int, b int")
    got = {r.node: r.root for r in common.components(e).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


# 2 ----------------------------------------------------------------------------------------------------------------------


def page(items, extra="", ad="Buy now"):
    return f"<html><body><!-- x --><script>var a='<p>';</script><h1>Shop</h1><ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>{extra}<div class='ad x'>{ad}</div></body></html>"


def test_wrappers_and_extraction(spark):
    rows = [(1, "https://A.com/1", page(["one", "two &amp; <b>bold</b>"])), (2, "https://a.com/2", page(["three"], "<p>note<p>more")), (3, "https://b.org", "<p>alone"), (4, None, None), (5, "https://a.com/3", ""), (6, "https://a.com/1", page(["one"]))]
    df = spark.createDataFrame(rows[:4] + rows[5:], "page_id bigint, url string, html string").withColumn("URL2", F.lit(1))
    got = {r.page_id: r for r in htmlextract.extract(df).collect()}
    assert got[1].text == "one\ntwo & bold" and got[2].text == "three\nnote\nmore" and got[6].text == "one"
    assert got[3].text == "alone" and got[4].text is None and got[4].n_fields == 0
    w = htmlextract.wrappers(htmlextract._hosts(df)).where("host = 'a.com'").collect()
    own = htmlextract.Wrappers()
    assert own.expression(own.load(w[0].wrapper)) == "<html><body><h1>#</><ul>(<li>#</>)+</>(<p>#</>)*<div.ad>#</></></>"
    joined = {r.page_id: r.text for r in htmlextract.extract(df, send=0).collect()}
    assert joined == {k: r.text for k, r in got.items()}
    assert {r.page_id: r.text for r in htmlextract.extract(spark.createDataFrame(rows, df.drop("URL2").schema).repartition(5)).collect()}[5] == ""


def test_alignment_covers_both():
    rng = np.random.default_rng(2)
    own = htmlextract.Wrappers()

    def tree(depth):
        return [[str(rng.choice(list("abc"))), tree(depth - 1) if depth else []] for _ in range(rng.integers(0, 7))]

    def plain(page):
        return "".join(f"<{x}>{plain(y)}</>" for x, y in page)

    def pattern(wrapper):
        out = ""
        for k in wrapper:
            o, r, symbol, kids = own.nodes[k]
            body = pattern(kids) if symbol[0] == "(" else f"<{symbol}>{pattern(kids)}</>"
            out += f"(?:{body}){'*' if o and r else '?' if o else '+' if r else ''}"
        return out

    seen = set()
    for _ in range(600):
        pages = [tree(2) for _ in range(3)]
        a, b, c = map(own.skeleton, pages)
        w = own.align(own.align(a, b), c)
        assert own.load(own.dump(w)) == w
        for p in pages:
            assert regex.fullmatch(pattern(w), plain(p))
        seen |= {own.covers(w, x) for x in (a, b, c)}
    assert True in seen


def said(html):
    own = htmlextract.Wrappers()
    return own.expression(own.skeleton(htmlextract.parse(html)))


def test_repeated_groups():
    assert said("<p>a</p><p>b</p>") == "(<p>#</>)+"
    assert said("<dl>" + "<dt>a<dd>b" * 3 + "</dl>") == "<dl>(<dt>#</><dd>#</>)+</>"
    assert said("<h2>a</h2><p>x</p><p>y</p><h2>b</h2><p>z</p>") == "(<h2>#</>(<p>#</>)+)+"
    assert said("<a></a><hr><br>" * 2 + "<a></a>") == "(<a></><hr></><br></>)+<a></>"
    own = htmlextract.Wrappers()
    one, many = (own.skeleton(htmlextract.parse("<dl>" + "<dt>a<dd>b" * n + "</dl>")) for n in (1, 4))
    for x, y in ((one, many), (many, one)):
        assert own.expression(own.align(x, y)) == "<dl>(<dt>#</><dd>#</>)+</>" and own.covers(own.align(x, y), x) and own.covers(own.align(x, y), y)
    page = htmlextract.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl><p>e")
    assert own.read(own.align(own.skeleton(page), one), page) == [("/0/0/0", "a"), ("/0/1/0", "b"), ("/0/0/0", "c"), ("/0/1/0", "d"), ("/1/0", "e")]


def plain_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("cells", [htmlextract.CELLS, 60])
def test_common_subsequences_against_brute_force(monkeypatch, cells):
    monkeypatch.setattr(htmlextract, "CELLS", cells)
    rng = np.random.default_rng(23)
    for _ in range(300):
        a, b = (rng.integers(0, rng.integers(1, 6), rng.integers(0, 25)).tolist() for _ in range(2))
        got = htmlextract.common(a, b)
        assert all(a[i] == b[j] for i, j in got) and len(got) == plain_common(a, b)
        assert all(x < u and y < v for (x, y), (u, v) in zip(got, got[1:]))


def test_long_pages_align_fast():
    import time

    rng = np.random.default_rng(24)
    began, own = time.time(), htmlextract.Wrappers()
    a, b = (own.skeleton(htmlextract.parse("".join(f"<t{x}>w</t{x}>" for x in rng.integers(0, 400, 4000)))) for _ in range(2))
    w = own.align(a, b)
    assert len(w) > 4000 and time.time() - began < 30
    assert said("<dl>" + "<dt>a<dd>b" * 10_000 + "</dl>") == "<dl>(<dt>#</><dd>#</>)+</>"


def test_extraction_does_not_depend_on_the_order(spark):
    rng = np.random.default_rng(25)
    tags = ["h2", "p", "ul", "table", "section"]
    rows = [(i, f"http://h{i % 3}.org/{i}", "".join(f"<{t}>{t if rng.random() < 0.3 else rng.integers(0, 99)}</{t}>" for t in rng.choice(tags, rng.integers(1, 7)))) for i in range(60)]
    kind = "page_id bigint, url string, html string"
    want = htmlextract.extract(spark.createDataFrame(rows, kind).coalesce(1)).orderBy("page_id").collect()
    assert htmlextract.extract(spark.createDataFrame(rows[::-1], kind).repartition(7)).orderBy("page_id").collect() == want
    # brute force: a text is template only if its slot has it in every page of the host
    pages, has, texts = Counter(r.host for r in want), defaultdict(set), defaultdict(set)
    own = htmlextract.Wrappers()
    found = {r.host: own.load(r.wrapper) for r in htmlextract.wrappers(htmlextract._hosts(spark.createDataFrame(rows, kind))).collect()}
    for (i, _, html), r in zip(rows, want):
        for slot, text in own.read(found[r.host], htmlextract.parse(html)):
            has[r.host, slot].add(i)
            texts[r.host, slot].add(text)
    for (i, _, html), r in zip(rows, want):
        left = [t for s, t in own.read(found[r.host], htmlextract.parse(html)) if len(has[r.host, s]) < pages[r.host] or len(texts[r.host, s]) > 1]
        assert r.text == "\n".join(left) and [f.text for f in r.fields] == left


def test_template_slots_are_counted_by_pages(spark):
    rows = [(1, "http://a.org/1", "<ul><li>x<li>x</ul>"), (2, "http://a.org/2", "<p>hello</p>"), (3, "http://b.org/", "<p>one</p>"), (3, "http://b.org/", "<p>one</p>"), (None, None, "<p>y</p>"), (5, "", "<p>y</p><p>z</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert sorted((r.page_id or 0, r.text) for r in htmlextract.extract(df).collect()) == [(0, "y"), (1, "x\nx"), (2, "hello"), (3, "one"), (3, "one"), (5, "y\nz")]


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "x" + "<p>y"
    rows = [(1, "http://a.org", None), (None, "http://a.org", ""), (2, "http://a.org", deep), (2, "http://a.org", deep), (3, None, "a" * 100_000), (4, "http://a.org", "<p>q")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", F.lit(1).alias("HTML "), F.lit(2).alias("_0"), F.lit(3).alias("host"), F.lit(4).alias("wrapper"), F.lit("z").alias("page"))
    got = Counter((r.page_id, r.text) for r in htmlextract.extract(df).collect())
    assert got == Counter({(1, None): 1, (None, ""): 1, (2, "x\ny"): 2, (3, "a" * 100_000): 1, (4, "q"): 1})
    assert htmlextract.extract(df.limit(0)).count() == 0
    twice = df.select("page_id", "url", "html").toDF("page_id", "url", "html").withColumn("extra", F.lit(1)).toDF("page_id", "url", "html", "HTML")
    assert htmlextract.extract(twice).count() == 6


def test_deep_and_broken_html():
    assert len(htmlextract.parse("<div>" * 5000 + "x")) == 1
    own = htmlextract.Wrappers()
    assert own.expression(own.skeleton(htmlextract.parse("<div>" * 50_000 + "x"))).count("<div>") == 50_000
    for s in ("<", "<a", "</", "a<b", "<!--", "<p class='", "<script>x", "&#x;&zzz;", "</p></div>"):
        own.skeleton(htmlextract.parse(s))


# 3 ----------------------------------------------------------------------------------------------------------------------


def test_attention_gradients_and_causality():
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in lmscore.initial().items()}
    x = rng.integers(0, lmscore.SLOTS, (3, lmscore.WINDOW))
    y, m = rng.integers(0, lmscore.CLASSES, x.shape), rng.random(x.shape) < 0.8
    _, d = lmscore.backward(p, x, y, m)
    for k in "EPQKVOUb":
        at = (x[0, 2], 1) if k == "E" else tuple(rng.integers(0, s) for s in p[k].shape)
        old, loss = p[k][at], []
        for e in (1e-5, -1e-5):
            p[k][at] = old + e
            loss.append(lmscore.backward(p, x, y, m)[0])
        p[k][at] = old
        assert d[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-5, rel=1e-3, abs=1e-8)
    z = x.copy()
    z[:, 20:] = 0
    a, b = (lmscore.forward(p, v)[0].reshape(3, lmscore.WINDOW, -1) for v in (x, z))
    assert np.allclose(a[:, :20], b[:, :20]) and not np.allclose(a[:, 20:], b[:, 20:])


def test_each_token_is_scored_once():
    rng = np.random.default_rng(4)
    p, (cls, share) = lmscore.initial(), lmscore.classes(rng.integers(0, 9, lmscore.VOCAB))
    texts = [rng.integers(0, 50_000, n).astype(np.uint16) for n in (0, 1, 31, 32, 33, 56, 57, 200)]
    got = lmscore.score(p, cls, share, texts)
    for ids, total in zip(texts, got):
        nll = 0.0
        for t in range(len(ids)):
            k = 0 if t < lmscore.WINDOW else (t - lmscore.WINDOW) // lmscore.STRIDE + 1
            s = k * lmscore.STRIDE
            before = [lmscore.BOS, *ids.tolist()][s : t + 1]
            x = np.zeros((1, lmscore.WINDOW), int)
            x[0, : len(before)] = lmscore.slot(np.array(before))
            nll -= lmscore.forward(p, x)[0][len(before) - 1, cls[ids[t]]] + share[ids[t]]
        assert total == pytest.approx(nll, rel=1e-4, abs=1e-5)


def test_training_beats_unigrams_on_held_out(spark):
    rng = np.random.default_rng(5)
    song = "one two three four five six seven eight nine ten eleven twelve".split()

    def text():
        at = rng.integers(0, 12)
        return " ".join(song[(at + i) % 12] for i in range(80))

    enc = lmscore.encoder()
    ids = [np.frombuffer(enc.ids(text()), np.uint16) for _ in range(3000)]
    counts = np.bincount(np.concatenate(ids), minlength=lmscore.VOCAB)
    cls, share = lmscore.classes(counts)
    windows = np.stack([np.concatenate(([lmscore.BOS], x))[: lmscore.WINDOW + 1] for x in ids])
    p = lmscore.initial()
    for _ in range(3):
        p, n = lmscore.train(p, (windows[u : u + 64] for u in range(0, 3000, 64)), cls)
    test = [np.frombuffer(enc.ids(text()), np.uint16) for _ in range(20)]
    uniform = -sum(np.log((counts[x] + 1) / (counts + 1).sum()).sum() for x in test)
    assert n == 3000 and lmscore.score(p, cls, share, test).sum() < 0.5 * uniform
    table, held_out = docs(spark, [text() for _ in range(300)]), docs(spark, [text() for _ in range(20)])
    nll = [lmscore.scores(held_out, lmscore.fit(table, rounds=r)).agg(F.sum("nll")).first()[0] for r in (0, 2)]
    assert nll[1] < nll[0]


def test_training_sees_every_id_once(spark):
    rng = np.random.default_rng(15)
    ids = [rng.integers(0, 50_000, n).astype(np.uint16) for n in (0, 1, 31, 32, 33, 64, 0, 500)]
    w = lmscore.tiles(ids)
    want = np.concatenate(ids)
    assert (w[:, 1:][w[:, 1:] != lmscore.BOS] == want).all() and len(w) == 1 + 1 + 1 + 2 + 2 + 16
    assert (w[:, 0] == lmscore.BOS).sum() == 6 and w[-1, 0] == ids[-1][479]
    assert lmscore.tiles([ids[0]]).shape == (0, lmscore.WINDOW + 1)
    # what only comes late in documents is learnt: a song after 40 words of noise
    song = "one two three four five six seven eight nine ten eleven twelve".split()
    noise = lambda: [f"{a}{b}" for a, b in rng.integers(0, 99, (40, 2))]
    late = docs(spark, [" ".join(noise() + song * 6) for _ in range(300)])
    held_out = docs(spark, [" ".join(song * 6)] * 4)
    nll = [lmscore.scores(held_out, lmscore.fit(late, rounds=r)).agg(F.sum("nll")).first()[0] for r in (0, 2)]
    assert nll[1] < 0.93 * nll[0]


def test_cheaper_arithmetic_gives_the_same():
    rng = np.random.default_rng(21)
    x, y = rng.integers(0, lmscore.SLOTS, (5, lmscore.WINDOW)), rng.integers(0, lmscore.CLASSES, 5 * lmscore.WINDOW)
    for big in (1, 30, 1000):  # also where exp overflows
        p = {k: v.astype(np.float64) * (big if k in "QU" else 1) for k, v in lmscore.initial().items()}
        p["b"] = rng.normal(0, big, lmscore.CLASSES)
        inner, outer = lmscore.joined(p)
        assert np.allclose(inner, p["Q"] @ p["K"].T / 4) and np.allclose(outer, p["V"] @ p["O"])
        want = lmscore.forward(p, x)[0][np.arange(y.size), y]
        assert np.allclose(lmscore.target_logp(p, x, y), want, rtol=1e-6, atol=1e-6)
        loss, d = lmscore.backward(p, x, y.reshape(x.shape), np.ones(x.shape, bool))
        assert loss == pytest.approx(-want.mean(), rel=1e-6) and all(np.isfinite(v).all() for v in d.values())
    # parameters after some steps are those of Adam as it is defined
    windows = [rng.integers(0, 50_000, (40, lmscore.WINDOW + 1)).astype(np.uint16) for _ in range(4)]
    cls, _ = lmscore.classes(rng.integers(0, 9, lmscore.VOCAB))
    p = {k: v.astype(np.float64) for k, v in lmscore.initial().items()}
    m, v = ({k: 0 * w for k, w in p.items()} for _ in range(2))
    for t, w in enumerate(windows, 1):
        _, d = lmscore.backward(p, lmscore.slot(w[:, :-1]), cls[w[:, 1:]], w[:, 1:] != lmscore.BOS)
        for k in p:
            m[k], v[k] = 0.9 * m[k] + 0.1 * d[k], 0.99 * v[k] + 0.01 * d[k] ** 2
            p[k] -= lmscore.RATE / (1 + t / 2000) * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    got, n = lmscore.train(lmscore.initial(), iter(windows), cls)
    assert n == 160 and all(np.allclose(got[k], p[k], atol=1e-3) for k in p)


def test_ids_are_those_of_the_whole_pattern():
    import tiktoken

    own = lmscore.encoder()
    whole = tiktoken.Encoding("whole", pat_str=tokencounts.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng, some = np.random.default_rng(22), [*tokencounts.BLANK, *"  \n\nab1'.", "'ll", "é", "中", "\x1c", "\u200b"]
    texts = ["".join(some[i] for i in rng.integers(0, len(some), rng.integers(0, 14))) for _ in range(5000)]
    assert all(own.ids(t) == np.array(whole.encode_ordinary(t), np.uint16).tobytes() for t in texts)


# 4 ----------------------------------------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(6)
    items = [prose(rng, int(n), 3000) for n in rng.integers(10, 60, 40)] + ["too short", None, "", "w7", "w1 w2", " W3, w4 w5 ", "w3 w4 w5 w6", "w7"]
    texts = []
    for i in range(120):
        body = prose(rng, int(rng.choice([5, 60, 800, 6000])), 3000).split()
        if i % 2:
            own = items[i % 40].upper().split() if i % 4 == 1 else items[i % 40].split()[: max(5, int(len(items[i % 40].split()) * 0.85))]
            at = int(rng.integers(0, len(body)))
            body[at:at] = own
        texts.append(", ".join(body))
    texts += [None, "", items[0], "w7", "w1", "w1 w2", "w2 w1", "w3 w4 w5 w6", "w3 w4 w5", "a w3 w4 w5 w6 b", "w3 w4 - w5"]
    want = {}
    sets = [None if t is None else {tuple(w[i : i + 5]) for w in [t.lower().replace(",", "").split()] for i in range(len(w) - 4)} for t in texts]
    for i, t in enumerate(items):
        w = (t or "").lower().split()
        w = [x.strip(",") for x in w]
        q = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        if 0 < len(w) < 5:
            for d, x in enumerate(texts):
                x = (x or "").lower().replace(",", "").replace("-", "").split()
                if any(x[k : k + len(w)] == w for k in range(len(x))):
                    want[d, i] = 1.0
        for d, s in enumerate(sets):
            if q and s and len(q & s) / len(q) >= decontam.CONTAINMENT:
                want[d, i] = round(len(q & s) / len(q), 6)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    for limit in (decontam.KEYS_BROADCAST, 0):
        got = {(r.doc_id, r.item_id): r.containment for r in decontam.leaks(docs(spark, texts), bench, limit=limit).collect()}
        assert set(got) == set(want) and len({i for _, i in got if i > 40}) == 5
        assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)
        kept = {r.doc_id for r in decontam.clean(docs(spark, texts), bench, limit=limit).collect()}
        assert kept == set(range(len(texts))) - {d for d, _ in got}


@pytest.mark.parametrize("n", [5, 6, 7, 8])
def test_items_of_few_shingles_are_all_found(spark, n):
    rng = np.random.default_rng(16 + n)
    items = [prose(rng, n, 3000) for _ in range(60)]
    texts = [f"{prose(rng, int(rng.choice([30, 60, 200, 1000])), 3000)} {t} {prose(rng, 20, 3000)}" for t in items for _ in range(3)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    for limit in (decontam.KEYS_BROADCAST, 0):
        got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs(spark, texts), bench, limit=limit).collect()}
        want = {(i, i // 3) for i in range(180)}
        assert got >= want if n < 8 else len(got & want) >= 178
        assert n > 5 or decontam.clean(docs(spark, texts), bench, limit=limit).count() == 0


def test_both_ways_have_one_threshold(spark):
    words = [f"q{i}" for i in range(14)]  # 10 shingles
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    texts = [" ".join(words[:n]) for n in (10, 11, 12)]
    for limit in (decontam.KEYS_BROADCAST, 0):
        assert {(r.doc_id, r.containment) for r in decontam.leaks(docs(spark, texts), bench, limit=limit).collect()} == {(1, 0.7), (2, 0.8)}


def test_leaks_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    texts = ["a b c d e f g", "c d", "x c d y", "d c", None, "", "a b c d e f"]
    items = ["a b c d e f", "c d", "y", "", None]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    duck.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO benchmark VALUES (?, ?)", list(enumerate(items)))
    got = {tuple(r) for r in decontam.leaks(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()}
    assert got == set(duck.execute(decontam.sql()).fetchall()) == {(0, 0, 1.0), (6, 0, 1.0), (0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (2, 2, 1.0), (6, 1, 1.0)}


# 5 ----------------------------------------------------------------------------------------------------------------------


def brute_lines(texts):
    import re

    mask = lambda line: " ".join("<*>" if re.search("[0-9]", t) else t for t in line.split())
    leaves, where = defaultdict(set), defaultdict(set)
    for d, t in enumerate(dict.fromkeys(texts)):  # copies of one text are one document
        for line in (t or "").split("\n"):
            if m := mask(line):
                leaves[len(m.split()), tuple(m.split()[: linededup.LEAD])].add(m)
                where[m].add(d)
    drop = set()
    for leaf in leaves.values():
        made = []
        for m in sorted(leaf):
            w = m.split()
            agree = [sum(a == b and a is not None for a, b in zip(t[0], w)) for t in made]
            if agree and max(agree) >= linededup.SIMILAR * len(w):
                t = made[agree.index(max(agree))]
                t[0] = [a if a == b else None for a, b in zip(t[0], w)]
                t[1].add(m)
            else:
                made.append([w, {m}])
        for _, lines in made:
            if len(set().union(*(where[m] for m in lines))) >= linededup.MIN_DOCS:
                drop |= lines
    return [None if t is None else "\n".join(x for x in t.split("\n") if not mask(x) or mask(x) not in drop) for t in texts]


def test_line_dedup(spark):
    rng = np.random.default_rng(7)
    texts = []
    for i in range(40):
        lines = [prose(rng, 9).replace("w", "q") for _ in range(3)] + [f"Page {i} of 40", f"  all rights reserved by the author {'abc'[i % 3]} in this land  ", "the a b " + "cdefg"[i % 5], ""]
        texts.append("\n".join(str(x) for x in rng.permutation(lines)))
    texts += [None, "", "\n\n", "Page 7 of 40"]
    for send in (linededup.SEND, 0):
        got = {r.doc_id: r for r in linededup.cleaned(docs(spark, texts), send=send).collect()}
        want = brute_lines(texts)
        assert [got[i].text for i in range(len(texts))] == want
        assert "Page" not in "".join(x or "" for x in want) and got[43].n_dropped == 1 and got[40].n_lines is None


def test_copies_are_no_template(spark):
    texts = ["one text alone\nof two lines here"] * 5 + ["another\nshared by all of them", "third\nshared by all of them", "last\nshared by all of them"]
    got = {r.doc_id: r.text for r in linededup.cleaned(docs(spark, texts)).collect()}
    assert got == dict(enumerate([texts[0]] * 5 + ["another", "third", "last"]))


def plain_templates(lines):
    made, at = [], []
    for line in lines:
        w = line.split(" ")
        agree = [sum(a == b for a, b in zip(t, w)) for t in made]
        if agree and max(agree) >= linededup.SIMILAR * len(w):
            at.append(agree.index(max(agree)))
            made[at[-1]][:] = [a if a == b else None for a, b in zip(made[at[-1]], w)]
        else:
            made.append(w)
            at.append(len(made) - 1)
    return at


@pytest.mark.parametrize("n, kinds", [(4, 3), (5, 3), (9, 4), (12, 6), (23, 30)])
def test_templates_of_a_large_leaf_are_the_plain_ones(n, kinds):
    rng = np.random.default_rng(n)
    base = [["a", "b", "c", *(f"{'xyz'[i % 3]}{t}" for i, t in enumerate(rng.integers(0, kinds, n - 3)))] for _ in range(60)]
    lines = sorted({" ".join(w if i < 3 or rng.random() > 0.12 else f"v{rng.integers(0, 3)}" for i, w in enumerate(base[rng.integers(0, 60)])) for _ in range(900)})
    assert linededup.templates(lines, lead=3)[0] == plain_templates(lines)


def test_one_leaf_of_100_000_lines(spark):
    import time

    rng = np.random.default_rng(22)
    vocabulary = np.array([f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"])
    lines = sorted({"the same start " + " ".join(x) for x in vocabulary[rng.integers(0, len(vocabulary), (100_000, 12))]})
    began = time.time()
    at, _ = linededup.templates(lines, lead=3)
    assert time.time() - began < 60 and len(set(at)) > 0.99 * len(lines)
    # a hot leaf is split and put together again: what recurs is found, what doesn't stays
    shared = [f"the same start of a notice that has the {w} word in it" for w in "red blue green white black".split()]
    texts = ["\n".join([*lines[3 * i : 3 * i + 3], shared[i % 5]]) for i in range(400)]
    got = linededup.cleaned(docs(spark, texts), leaf=150).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.doc_id)] == ["\n".join(t.split("\n")[:3]) for t in texts]


# 6 ----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 500, 20_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    f = exactdedup.build(keys) if n else None
    if n:
        assert exactdedup.contains(f, keys).all()
        other = rng.integers(2**63, 2**64, 20_000, dtype=np.uint64)
        assert exactdedup.contains(f, other).mean() < 0.01


@pytest.mark.parametrize("limit", [exactdedup.FILTER_DIGESTS, 0])
def test_exact_dedup(spark, limit):
    old, new = ["a", "b", "a", None, ""], ["b", "c", "c", None, "", "A", "c"]
    got = {r.doc_id: (r.keep_id, r.kind) for r in exactdedup.dedup(docs(spark, old), docs(spark, new, start=10), filter_digests=limit).collect()}
    snap, batch = "copy_of_snapshot", "copy_in_batch"
    assert got == {0: (0, "kept"), 1: (1, "kept"), 2: (0, batch), 3: (3, "kept"), 4: (4, "kept"), 10: (1, snap), 11: (11, "kept"), 12: (11, batch), 13: (13, "kept"), 14: (4, snap), 15: (15, "kept"), 16: (11, batch)}


def brute_exact(old, new):
    """(keep_id, kind) by doc_id of rows (doc_id, text)."""
    out, first = {}, {}
    for late, rows in enumerate((old, new)):
        for d, t in sorted(rows, key=lambda r: r[0]):
            if t is not None:
                first.setdefault(t, (late, d))
            keep = (late, d) if t is None else first[t]
            out[d] = (keep[1], "kept" if keep == (late, d) else "copy_of_snapshot" if late and not keep[0] else "copy_in_batch")
    return out


def test_a_text_that_most_rows_have(spark):
    rng = np.random.default_rng(21)
    texts = [EN if x < 0.4 else FR if x < 0.41 else f"text {rng.integers(0, 30_000)}" for x in rng.random(100_000)]
    df = docs(spark, texts)
    got = {r.doc_id: (r.keep_id, r.kind) for r in exactdedup.dedup(df.where("doc_id < 30000"), df.where("doc_id >= 30000")).collect()}
    assert got == brute_exact(list(enumerate(texts[:30_000])), list(enumerate(texts[30_000:], 30_000)))


def test_snapshots_are_kept(spark, tmp_path, monkeypatch):
    old, older, new = ["a", "b", "a", None], ["c", "b", ""], ["b", "c", "x", "x", "a", None, ""]
    made = [exactdedup.write_snapshot(docs(spark, t, start=s), str(tmp_path / str(s)), 2) for t, s in ((older, 100), (old, 200))]
    assert made[0].buckets == 2
    monkeypatch.setattr(exactdedup, "snapshot_filters", None)
    loaded = [exactdedup.read_snapshot(spark, str(tmp_path / str(s))) for s in (100, 200)]
    assert [x.buckets for x in loaded] == [x.buckets for x in made] and loaded[0].filters.collect() == made[0].filters.collect()
    got = {r.doc_id: (r.keep_id, r.kind) for r in exactdedup.against(loaded, docs(spark, new)).collect()}
    snap = "copy_of_snapshot"
    assert got == {0: (101, snap), 1: (100, snap), 2: (2, "kept"), 3: (2, "copy_in_batch"), 4: (200, snap), 5: (5, "kept"), 6: (102, snap)}
    monkeypatch.undo()
    empty = exactdedup.write_snapshot(docs(spark, []), str(tmp_path / "empty"))
    assert {r.kind for r in exactdedup.against([empty], docs(spark, ["a", "b"])).collect()} == {"kept"}
    assert exactdedup.read_snapshot(spark, str(tmp_path / "empty")).buckets == 1


# 7 ----------------------------------------------------------------------------------------------------------------------


def test_changed_weights_move_only_their_subtrees(spark):
    df = spark.range(6000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r for r in sharding.shard(df).collect()}
    tree = {r: {k: dict(s) for k, s in racks.items()} for r, racks in sharding.TREE.items()}
    for s in list(tree["r1"]["r1k2"]):
        tree["r1"]["r1k2"][s] *= 2
    after = {r.doc_id: r for r in sharding.shard(df, tree=tree).collect()}
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    assert moved and all(b.region == "r1" and (a.region != "r1" or b.rack == "r1k2") for a, b in moved)
    total = sharding.weight(sharding.TREE)
    for region, n in Counter(r.region for r in before.values()).items():
        assert n / 6000 == pytest.approx(sharding.weight(sharding.TREE[region]) / total, abs=0.03)
    with pytest.raises(ValueError):
        sharding.shard(df, tree={})


# 8 ----------------------------------------------------------------------------------------------------------------------


def test_languages(spark):
    rng = np.random.default_rng(8)
    mixed = lambda s: " ".join(rng.permutation(s.split()))
    texts = [mixed(EN) for _ in range(30)] + [mixed(FR) for _ in range(30)]
    langs = ["en"] * 30 + ["fr"] * 30
    junk = ["7 8 9", "", None, "жшц ъыь щюж " * 30]
    df = docs(spark, texts + junk, langs=langs + [None] * 4)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert sum(got[i].lang == langs[i] for i in range(60)) >= 58
    assert [got[60 + i].accepted for i in range(3)] == [False] * 3 and got[62].lang is None
    kept = {r.doc_id for r in langid.accepted(df).collect()}
    assert kept == {i for i, r in got.items() if r.accepted} and len(kept & set(range(60))) == 60


def test_long_gibberish_is_rejected(spark):
    rng = np.random.default_rng(17)
    texts = [" ".join(rng.choice(s.split(), n)) for s in (EN, FR) for n in (30, 100, 400, 1500) for _ in range(25)]
    junk = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), n)) for n in (100, 300, 1000, 3000, 10_000, 20_000) for _ in range(10)]
    df = docs(spark, texts + junk, langs=["en"] * 100 + ["fr"] * 100 + [None] * 60)
    got = {r.doc_id for r in langid.identify(df).collect() if r.accepted}
    assert got == set(range(200))


def plain_profile(text):
    """Sum of bound letters, code point by code point."""
    import re

    out = np.zeros(langid.DIM, int)
    runs = re.findall(r"[^\W\d_]+", text.lower())
    marks = [0, *(x for run in runs for x in [*map(ord, run), 0])] if runs else []
    for three in zip(marks, marks[1:], marks[2:]):
        a, b, c = (langid.letters(np.array([x]))[0].astype(int) for x in three)
        out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_profiles_are_sums_of_bound_letters():
    texts = ["cab", "", "Cab, dab! x", "каб даб", "漢字 かな", "naïve 12 façade", "αβγ abc"]
    for part in (texts, texts[:3], texts[3:4]):
        v, n = langid.profile(part)
        assert all((v[i] == plain_profile(t)).all() for i, t in enumerate(part))
    assert langid.profile(["cab", ""])[1].tolist() == [3, 0]


def test_languages_against_brute_force(spark):
    rng = np.random.default_rng(18)
    base = {"en": EN, "fr": FR, "ru": "быстрая коричневая лиса прыгает через ленивую собаку и бежит по зелёному лесу у старой реки", "el": "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και τρέχει στο πράσινο δάσος"}
    texts, langs = zip(*[(" ".join(rng.choice(s.split(), int(rng.choice([1, 3, 20, 90])))), name) for name, s in base.items() for _ in range(60)])
    junk = ["".join(rng.choice(list("бвгджзклмнпрстфхцчшщ   "), 600)), "".join(rng.choice(list("βγδζθκλμνξπρστφχψ   "), 600)), "q" * 40, "7"]
    df = docs(spark, [*texts, *junk], langs=[*langs, *[None] * 4])
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    sums = {name: sum(plain_profile(t) for t, x in zip(texts, langs) if x == name) for name in base}
    unit = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    near, size = [], []
    for i, t in enumerate([*texts, *junk[:3]]):
        v = plain_profile(t)
        cos = {k: v @ u / np.linalg.norm(v) for k, u in unit.items()}
        best = max(sorted(cos), key=cos.get)
        assert got[i].lang == best and got[i].cosine == pytest.approx(cos[best], abs=2e-4)
        near.append(cos[best])
        size.append(sum(len(x) for x in t.split()) + len(t.split()) - 1)
    for i in range(len(near)):  # the decision: limits by length from the labelled rows
        own = lambda k: sorted(near[j] for j in range(240) if int(np.log2(size[j])) == k)
        known = [k for k in range(40) if len(own(k)) >= langid.FEW]
        at = int(np.log2(size[i]))
        k = min(known, key=lambda k: (abs(k - at), k))
        low, floor = langid.PART * own(k)[int(langid.LOW * len(own(k)))], langid.NOISE / langid.DIM**0.5 * min(1, (2**at / langid.ENOUGH) ** 0.5)
        limit = min(low, floor) if 2**at < langid.ENOUGH else max(low, floor)
        assert abs(near[i] - limit) < 2e-3 or got[i].accepted == (near[i] >= limit)
    assert sum(got[i].lang == x for i, x in enumerate(langs)) >= 236 and not any(got[240 + i].accepted for i in range(4))


# 9 ----------------------------------------------------------------------------------------------------------------------


def test_every_prefix_against_encoding_again(spark):
    import tiktoken

    c = tokencounts.counter()
    enc = tiktoken.Encoding("own", pat_str=tokencounts.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    texts = ["it's  don't can'\n\n x  'll ''re  we'll", "a\xa0\xa0b  x\x1c y", " \n\n  foo\t\tbar 12345 $$$" + "=" * 70 + " end  ", "naïve façade 漢字かな 🎉🎉  ok'", "O'Reilly's 'tis", EN]
    for t in texts:
        got = np.cumsum(np.frombuffer(c.deltas(t), "<i2"))
        assert got.tolist() == [len(enc.encode_ordinary(t[:i])) for i in range(1, len(t) + 1)], t
    rows = {r.doc_id: r for r in tokencounts.counts(docs(spark, [*texts, None, "", EN * 400]), budgets=(7, 10**6)).collect()}
    for i, t in enumerate(texts):
        n = [len(enc.encode_ordinary(t[:k])) for k in range(len(t) + 1)]
        assert rows[i].n_tokens == n[-1] and rows[i].cut_7 == max(k for k, x in enumerate(n) if x <= 7) and rows[i].cut_1000000 == len(t)
    assert rows[6].n_tokens is None and rows[7].n_tokens == 0 and rows[8].n_tokens == len(enc.encode_ordinary(EN * 400))
    df = spark.createDataFrame([(rows[0].deltas, 5, 3), (None, 1, 1)], "d binary, n int, b int")
    got = df.select(tokencounts.prefix_tokens(F.col("d"), F.col("n")).alias("t"), tokencounts.cut_at(F.col("d"), F.col("b")).alias("c")).collect()
    assert got[0].t == len(enc.encode_ordinary(texts[0][:5])) and got[1].t is None


def test_budgets_of_texts_with_more_tokens_than_characters(spark):
    import tiktoken

    c = tokencounts.counter()
    enc = tiktoken.Encoding("own", pat_str=tokencounts.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    texts = ["𐎀𐎁𐎂𐎃" * 100, "ᚠᚢᚦ" * 40 + " plain words", "ꙮ"]
    budgets = (1, 3, 100, 300, 399, 401, 512, 1000, 5000)
    for r in tokencounts.counts(docs(spark, texts), budgets=budgets).collect():
        t = texts[r.doc_id]
        n = [len(enc.encode_ordinary(t[:k])) for k in range(len(t) + 1)]
        assert r.n_tokens == n[-1]
        assert [r[f"cut_{b}"] for b in budgets] == [max(k for k, x in enumerate(n) if x <= b) for b in budgets]


# 10 ---------------------------------------------------------------------------------------------------------------------


def walked(blocks, weights=None, frame=mixing.FRAME):
    """Slots of the whole mix, by frames."""
    out = []
    for at, *part in mixing.frames(blocks, mixing.target_weights(blocks, weights), frame):
        assert at == len(out)
        out += mixing.frame_slots(*part)
    return out


def plain_slots(blocks, weights):
    """Slot by slot: of the released blocks, the one of the earliest deadline. Blocks whose windows reach beyond the end
    of a phase are in it by earliest release; when a source has run out, a new phase begins."""
    left, out = {s: 0 for s, n in blocks.items() if n and weights[s] > 0}, []
    while left:
        total = sum(weights[s] for s in left)
        w = {s: weights[s] / total for s in left}
        size = min((blocks[s] - left[s]) // w[s] for s in left)
        windows = [((k - 1) // w[s], left[s] + k != blocks[s], (s is not None, str(s)), s, k, -(-k // w[s])) for s in left for k in range(1, int(w[s] * size) + 2)]
        inside = [(a, min(d, size), o, s, k) for a, _, o, s, k, d in windows if d <= size]
        inside += [(a, size, o, s, k) for a, _, o, s, k, d in sorted(x for x in windows if x[0] < size < x[5])][: size - len(inside)]
        for t in range(size):
            d, o, s, k = min((d, o, s, k) for a, d, o, s, k in inside if a <= t)
            assert d > t
            inside = [x for x in inside if x[3:] != (s, k)]
            out.append((s, left[s] + k - 1))
        for s in left:
            left[s] = 1 + max((b for x, b in out if x == s), default=-1)
        left = {s: n for s, n in left.items() if n < blocks[s]}
    return out


def test_schedule_of_weights_that_fill_a_frame_is_the_plain_one():
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, None: 0.05}
    blocks = {"a": 500, "b": 300, "c": 150, None: 50}
    exact = mixing.target_weights(blocks, weights)
    want = plain_slots(blocks, exact)
    assert walked(blocks, weights) == want and len(want) == 1000
    for blocks, weights in (({"a": 40, "b": 9, "c": 7, None: 2}, None), ({"a": 60, "b": 31, "c": 5}, {"a": 0.2, "b": 0.7, "c": 0.1}), ({"a": 12, "b": 12, "c": 12}, {"a": 1, "b": 2})):
        assert walked(blocks, weights) == plain_slots(blocks, mixing.target_weights(blocks, weights))


@pytest.mark.parametrize("frame", [64 * 7, mixing.FRAME])
@pytest.mark.parametrize("blocks, weights", [
    ({"a": 4000, "b": 1000, "c": 130, None: 7}, None),
    ({f"s{i}": 800 + i for i in range(4)}, None),
    ({f"s{i}": 800 + i for i in range(5)}, None),
    ({"hot": 9000, "b": 900, "c": 900, "d": 900, "e": 1, None: 2}, {"hot": 0.25, "b": 0.25, "c": 0.25, "d": 0.25}),
    ({"hot": 5000, "a": 77, "b": 50}, {"hot": 0.1, "a": 0.7, "b": 0.2, "absent": 3}),
])
def test_lags_and_wholeness(blocks, weights, frame):
    mix, exact = walked(blocks, weights, frame), mixing.target_weights(blocks, weights)
    assert sorted(mix, key=str) == sorted(((s, b) for s, n in blocks.items() for b in range(n)), key=str)  # every block once
    at, most = 0, 0
    for now, before, size, _ in mixing.phases(blocks, exact):
        seen = Counter()
        for t, (s, b) in enumerate(mix[at : at + size], 1):
            assert b == before[s] + seen[s]  # a source's blocks in their order
            seen[s] += 1
            if t % 7 == 0 or t == size:
                most = max(most, *(abs(seen[x] - t * w) for x, w in now.items()))
        at += size
    assert at == len(mix) and most < (1 if frame == mixing.FRAME else 2)


def test_a_small_source_costs_nothing():
    for n in (4, 5, 6):
        blocks = {f"s{i}": 5000 for i in range(n)} | {"rare": 1, None: 3}
        for weights in (None, {f"s{i}": 1 / 8 for i in range(n)} | {"rare": 0.5}):
            assert len(walked(blocks, weights)) == 5000 * n + 4


def test_mixing(spark):
    sources = ["hot"] * 900 + ["a"] * 200 + ["b"] * 200 + [None] * 100 + ["off"] * 30
    df = docs(spark, [EN] * 1430, sources)
    weights = {"hot": 0.4, "a": 0.3, "b": 0.2, None: 0.1, "off": 0}
    rows = mixing.schedule(df, weights, block=4).collect()
    assert len(rows) == 1430 and {r.source for r in rows if r.slot is None} == {"off"}
    rows = sorted((r for r in rows if r.slot is not None), key=lambda r: r.position)
    assert len({r.position for r in rows}) == len(rows) == 1400
    blocks = {s: -(-n // 4) for s, n in Counter(sources).items() if s != "off"}
    want = {(s, b): t for t, (s, b) in enumerate(plain_slots(blocks, mixing.target_weights(blocks, weights)))}
    assert {(r.source, r.block): r.slot for r in rows} == want
    import hashlib

    order = {s: sorted((i for i, x in enumerate(sources) if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) for s in blocks}
    assert all(order[r.source].index(r.doc_id) // 4 == r.block for r in rows)
    assert [r.doc_id for r in mixing.mixed(df, weights, block=4).collect()] == [r.doc_id for r in rows]


def test_unnamed_sources_and_repeated_rows(spark):
    sources = [f"s{i % 5}" for i in range(2000)] + [None] * 3
    df = docs(spark, [EN] * 2003, sources).withColumn("doc_id", F.expr("doc_id div 2"))
    for weights in (None, {"s0": 0.5}, {"elsewhere": 1}):
        rows = mixing.schedule(df, weights, block=1).collect()
        assert sorted(r.slot for r in rows) == list(range(2003))
        out = mixing.mixed(df.withColumn("position", F.lit(7)), weights, block=1).collect()
        assert Counter((r.doc_id, r.source) for r in out) == Counter((i // 2, s) for i, s in enumerate(sources)) and {r.position for r in out} == {7}


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 3)
    with pytest.raises(ValueError, match="sources"):
        mixing.schedule(docs(spark, [EN] * 5, list("abcde")))


# pipeline ---------------------------------------------------------------------------------------------------------------


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    words = EN.split()
    texts = [" ".join(rng.choice(words, 40)) + " " + " ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(60)) for _ in range(150)]
    item = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(20))
    texts[3] += " " + item
    texts[10] = texts[9]
    texts[20] = texts[19] + " more"
    texts[30] = "1 2 3"
    sources = [f"s{i % 6}" for i in range(150)]
    docs(spark, texts, sources).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.region, r.rack, r.shard) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    langs = {r.doc_id for r in langid.identify(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect() if r.accepted}
    keep = brute_groups([t if i in langs else None for i, t in enumerate(texts)])
    left = [i for i in sorted(langs) if keep[i] == i and item not in texts[i]]
    want = {r.doc_id: (r.region, r.rack, r.shard) for r in sharding.shard(spark.range(150).withColumnRenamed("id", "doc_id")).collect() if r.doc_id in left}
    assert got == want and not {3, 10, 20, 30} & set(got) and len(got) > 80


def test_names():
    from lexiloom.llm.queries import ORACLE_SQL, QUERIES

    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
