"""Operators on small hand-made corpora, with values worked out by hand or by an independent formula."""

import math

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import assoc, text
from lexiloom.model import Corpus
from lexiloom.operators import lexical, plotdata, tables
from lexiloom.operators.dispersion import dispersion
from lexiloom.operators.embeddings import centroid, encode_terms
from lexiloom.operators.keywords import keywords
from lexiloom.operators.search import search, search_cqp
from lexiloom.sources import tokens as tk


def corpus(spark, files: dict, name="token", **columns):
    rows = [(f, i, t) for f, ts in files.items() for i, t in enumerate(ts.split() if isinstance(ts, str) else ts)]
    return spark.createDataFrame(rows, f"file_id string, idx bigint, {name} string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def two(spark):
    return corpus(spark, {"d1": "the quick brown", "d2": "fox brown fox jumps"}).cache()


def found(r):
    return rows(r.matches, "file_id", "start", "end")


def test_files_arent_crossed(two):
    assert found(search(two, "brown fox")) == [("d2", 1, 3)]
    assert found(search_cqp(two, '[token="brown"] []* [token="jumps"]')) == [("d2", 1, 4)]
    assert len(search(two, "nothing")) == 0


@pytest.mark.parametrize("query", ['[token="a"] [token="a"]', '[token="a"] []', '[token="a"] [token="b"]', '[] []', '[token="a|b"] [] [token="a"]', '[] [token="a"]', '[token="c"]'])
def test_strategies_agree(spark, query):
    c = corpus(spark, {"x": "a a a b a a c a a", "y": "b a c a b a a a a", "z": "a", "w": "b b"})
    fast = search_cqp(c, query)
    assert found(fast) == found(search_cqp(c, query, strategy="automaton"))


def test_results_dont_depend_on_partitions(spark):
    c = corpus(spark, {str(i): "the of the and the the of"[i % 3 :] for i in range(20)})
    q = '$x: [token="the"]+ [token="of|and"]'
    assert rows(search_cqp(c.repartition(7), q).matches, "file_id", "start", "end", "b_x") == rows(search_cqp(c.coalesce(1), q).matches, "file_id", "start", "end", "b_x")


def test_nulls_match_neither_way(spark):
    c = corpus(spark, {"a": ["x", None, "y"]})
    assert found(search_cqp(c, '[token="x"]')) == [("a", 0, 1)]
    assert found(search_cqp(c, '[token!="x"]')) == [("a", 2, 3)]


def test_null_file_is_a_file(spark):
    c = spark.createDataFrame([(None, 0, "a"), (None, 1, "b"), ("f", 0, "a"), ("f", 1, "b")], "file_id string, idx bigint, token string")
    assert search_cqp(c, '[token="a"]+ [token="b"]').matches.count() == 2


def test_errors(two):
    with pytest.raises(ValueError, match="reads column 'word'"):
        search_cqp(two, '[word="a"]')
    with pytest.raises(ValueError, match="file_id_column"):
        search(two, "a", file_id_column="files")
    with pytest.raises(ValueError):
        search(two, "brown").concordance(window=-1)
    with pytest.raises(ValueError, match="no variable"):
        search(two, "brown").concordance(bindings="x")


CAT = "the cat sat on the mat . the dog sat on the log ."


@pytest.fixture(scope="module")
def cat(spark):
    tags = "B I I I I I I B I I I I I I".split()
    data = [("f", i, t, tags[i]) for i, t in enumerate(CAT.split())]
    return spark.createDataFrame(data, "file_id string, idx bigint, token string, chunks string").cache()


def test_concordance_window(cat):
    got = search(cat, "sat").concordance(window=2).orderBy("start").collect()
    assert [(r.token_left_context, r.token, r.token_right_context) for r in got] == [(["the", "cat"], ["sat"], ["on", "the"]), (["the", "dog"], ["sat"], ["on", "the"])]
    assert search(cat, "sat").concordance().columns == ["token", "file_id", "start", "end"]
    edge = search_cqp(cat, '[token="the"] [token="cat"]').concordance(window=3).collect()[0]
    assert edge.token_left_context == [] and edge.token_right_context == ["sat", "on", "the"]


def test_concordance_chunk(cat):
    got = {r.start: (r.token_left_context, r.token_right_context) for r in search_cqp(cat, '[token="sat|the"]').concordance(chunk_column="chunks").collect()}
    assert got[2] == (["the", "cat"], ["on", "the", "mat", "."])
    assert got[9] == (["the", "dog"], ["on", "the", "log", "."])
    assert got[0] == ([], ["cat", "sat", "on", "the", "mat", "."])
    assert got[7][0] == "the cat sat on the mat .".split()
    strict = {r.start: r.token_left_context for r in search(cat, "the").concordance(chunk_column="chunks", strict_chunks=True).collect()}
    assert strict[7] == []


def test_bindings_null_and_empty(cat):
    r = search_cqp(cat, '$x: ([token="cat"]?) [token="sat"]').concordance(metadata="chunks")
    got = {row.start: (row.token_x, row.chunks) for row in r.collect()}
    assert got == {1: (["cat"], "I"), 9: ([], "I")}
    r = search_cqp(cat, '($x: [token="cat"])? [token="sat"]').concordance()
    assert {row.start: row.token_x for row in r.collect()} == {1: ["cat"], 9: None}


def test_collocates(cat):
    got = {r.token: tuple(r.freqs) for r in search(cat, "sat").collocates(window=2, min_freq=2).collect()}
    assert got == {"the": (4, 8, 4, 14), "on": (2, 8, 2, 14)}


def test_slices_and_bio(cat):
    r = search(cat, "the")
    assert [m.start for m in r.head(2).matches.collect()] == [0, 4]
    assert [m.start for m in r.tail(1).matches.collect()] == [11]
    assert sorted(m.start for m in r.shuffle(3).matches.collect()) == [0, 4, 7, 11]
    assert rows(r.sample(2, 5).matches, "start") == rows(r.sample(2, 5).matches, "start")
    with pytest.raises(ValueError):
        r.sample(9)
    tags = [x.spans for x in search(cat, "on the").with_spans_as_chunks().orderBy("idx").collect()]
    assert "".join(tags) == "OOOBIOOOOOBIOO"
    assert repr(r) == "SearchResults<'the'; 4 matches>"


def test_browser(cat):
    b = search(cat, "the").view(window=2)
    assert [r.start for r in b.sort("right", descending=True).page().collect()] == [4, 11, 7, 0]
    assert [r["match"] for r in b.filter("DOG").table().collect()] == ["the"]
    assert b.sort("left").sort(None).page().count() == 4 and "<table>" in b.shuffle(1).to_html()


def values(spark, f12, f1, f2, n, *measures):
    df = spark.createDataFrame([(f12, f1, f2, n)], "f12 bigint, f1 bigint, f2 bigint, n bigint").select(assoc.freqs("f12", "f1", "f2", "n").alias("freqs"))
    return [df.select(m("freqs").alias("x")).collect()[0].x for m in measures]


@pytest.mark.parametrize(
    "cells, expected",
    [
        ((6, 12, 10, 20), (0, 0, 0.208333, 0.5, 0)),
        ((20, 30, 25, 50), (8.630462, 8.333333, 6.75, 0.666667, 0.287682)),
        ((0, 10, 20, 50), (-11.849392, 8.333333, 6.380208, 0, -math.inf)),
    ],
)
def test_measures(spark, cells, expected):
    got = values(spark, *cells, assoc.loglik, assoc.chisq, lambda s: assoc.chisq(s, yates=True), assoc.minsens, assoc.pmi)
    assert got == pytest.approx(expected, abs=1e-6)
    assert values(spark, *cells, lambda s: assoc.smp(s, k=1))[0] == pytest.approx((cells[0] + 1) / (cells[1] - cells[0] + 1))


def test_measures_of_bad_margins(spark):
    assert values(spark, 1, 0, 2, 3, assoc.loglik) == [None]
    assert values(spark, None, 1, 2, 3, assoc.loglik, assoc.pmi, assoc.minsens) == [None] * 3


def test_welch(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 5.0), (3.0, 6.0), (None, None)], "x double, y double")
    for alt, p in (("twosided", 0.02131164), ("less", 0.01065582), ("greater", 0.98934417)):
        w = df.agg(assoc.welchs_t("x", "y", alt).alias("w")).collect()[0].w
        assert (w.t, w.df, w.g) == pytest.approx((-3.6742346, 4, -2.4), abs=1e-6) and w.p == pytest.approx(p, abs=1e-7)
    w = df.limit(1).agg(assoc.welchs_t("x", "y").alias("w")).collect()[0].w
    assert (w.t, w.p, w.df, w.g) == (None,) * 4


def test_crosstab_drops_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 2), (None, 1), ("b", None)], "x string, y int")
    got = {(r.x, r.y): tuple(r.freqs) for r in tables.crosstab(df, "x", "y").collect()}
    assert got == {("a", 1): (2, 3, 2, 4), ("a", 2): (1, 3, 2, 4), ("b", 2): (1, 1, 2, 4)}


@pytest.fixture(scope="module")
def parts(spark):
    return corpus(spark, {"a": "the cat the dog cat", "b": "the cat fish"}, "norm"), corpus(spark, {"c": "the the water dog", "d": "the the water"}, "norm")


def test_keywords(parts):
    target, reference = parts
    got = {r.norm: (tuple(r.freqs), r.target_df) for r in keywords(target, reference, "norm").collect()}
    assert got == {"cat": ((3, 3, 8, 15), 2), "fish": ((1, 1, 8, 15), 1), "dog": ((1, 2, 8, 15), 1), "the": ((3, 7, 8, 15), 2)}
    assert [r.norm for r in keywords(target, reference, "norm", "chisq", min_target_tf=2, min_target_df=2).collect()][0] == "cat"
    t = {r.norm: r for r in keywords(target, reference, "norm", "ttest").collect()}
    assert "the" not in t and t["cat"].t > 0 and 0 < t["cat"].p < 1
    with pytest.raises(ValueError):
        keywords(target, reference, "norm", "smp")
    with pytest.warns(UserWarning):
        keywords(target, reference, "norm", "ll", k=1)


def test_dispersion(spark):
    c = corpus(spark, {"1": "a a b b c", "2": "a b c c c", "3": "a a a d d"})
    got = {r.token: r for r in dispersion(c, "token", ["range", "range%", "sd", "cv", "d", "da", "dp"]).collect()}
    want = {
        "a": (6, 3, 100, 0.163299, 0.408248, 0.711325, 0.666667, 0.166667), "b": (3, 2, 66.666667, 0.163299, 0.816497, 0.422650, 0.333333, 0.333333),
        "c": (4, 2, 66.666667, 0.249444, 0.935414, 0.338562, 0.25, 0.416667), "d": (2, 1, 33.333333, 0.188562, 1.414214, 0, 0, 0.666667),
    }
    for w, x in want.items():
        assert tuple(got[w])[1:] == pytest.approx(x, abs=1e-6), w
    one = dispersion(corpus(spark, {"1": "a a b"}), "token", ["sd", "d", "da", "dp"]).where("token = 'a'").collect()[0]
    assert one.sd == 0 and math.isnan(one.D) and math.isnan(one.DA) and one.DP == 0


def test_lexical(spark):
    c = corpus(spark, {"f": "the cat sat on the mat", "g": ["a", None, "a", None, "b"]})
    assert {r.file_id: r.ttr for r in lexical.ttr(c, "token", "file_id").collect()} == pytest.approx({"f": 5 / 6, "g": 3 / 5})
    assert [r.growth for r in lexical.vocabulary_growth(c, "token").where("file_id = 'g'").orderBy("idx").collect()] == [1, 2, 2, 2, 3]
    assert math.isnan(lexical.ttr(c.limit(0), "token").collect()[0].ttr)
    ten = corpus(spark, {"f": [*"abcdefghij", *["x"] * 10, *"pqrst", *"pqrst", "z"]})
    assert lexical.msttr(ten, "token", 10).collect()[0].msttr == pytest.approx((1 + 0.1 + 0.5) / 3)
    assert lexical.msttr(ten, "token", 100).collect()[0].msttr is None
    assert lexical.msttr(ten, "token", 10, dense=True).collect() == lexical.msttr(ten, "token", 10).collect()
    k = corpus(spark, {"f": ["the"] * 50 + ["cat"] * 30})
    assert lexical.yules_k(k, "token").collect()[0].yules_k == pytest.approx(5187.5)


@pytest.mark.parametrize("tokens, expected", [(["the"] * 100, 2.0), (CAT.split(), 14.0), (list("abcdefghi"), None), (list("abcdefghijkl"), math.inf)])
def test_mtld(spark, tokens, expected):
    assert lexical.mtld(corpus(spark, {"f": tokens}), "token").collect()[0].mtld == expected


def test_text_helpers(spark):
    df = spark.createDataFrame([("don’t", 0), ("x1", 1), ("été", 2), ("-", 3), ("a b", 4), (None, 5), ("éa", 6), ("́a", 7), ("rock-n", 8), ("", 9)], "w string, i int")
    got = [r.x for r in df.orderBy("i").select(text.is_letters("w").alias("x")).collect()]
    assert got == [True, False, True, False, False, None, True, False, True, False]
    assert df.where("i = 4").select(text.is_letters("w", allow_spaces=True).alias("x")).collect()[0].x
    bio = spark.createDataFrame([("f", i, t) for i, t in enumerate("IBIOB")], "file_id string, idx bigint, t string")
    assert [r.chunk_idx for r in text.with_chunk_index(bio, "t").orderBy("idx").collect()] == [0, 1, 1, None, 2]
    c = corpus(spark, {"f": ["a", "b", None, "c"], "g": ["d"]})
    assert [r.g for r in c.withColumn("g", text.ngrams(2, "token")).orderBy("file_id", "idx").collect()] == ["a b", None, None, None, None]
    p = spark.createDataFrame([("a", 1), ("a", 3), ("b", 4)], "k string, x int")
    assert sorted(r.x for r in text.proportion(p, "x").collect()) == [0.125, 0.375, 0.5]
    assert sorted(r.x for r in text.proportion(p, "x", "k").collect()) == [0.25, 0.75, 1.0]
    runs = spark.createDataFrame([("a", 0), ("a", 1), (None, 2), (None, 3), ("a", 4)], "v string, i int")
    assert [r.run for r in text.with_runs(runs, "v", "i").orderBy("i").collect()] == [1, 1, 2, 2, 3]


def test_tables(spark):
    c = corpus(spark, {"f": "a b a c a b"})
    assert [(r.token, r["rank"], r.freq_x_rank) for r in tables.ranked(c, "token").orderBy("rank").collect()] == [("a", 1, 3), ("b", 2, 4), ("c", 3, 3)]
    assert tables.count_hapaxes(c, "token").collect()[0].hapaxes == 1
    assert rows(tables.relative(c, "token", 6), "token", "rate") == [("a", 3.0), ("b", 2.0), ("c", 1.0)]


def lengths():
    class Lengths:  # in a function, so that it goes to the workers by value
        def get_embedding_dimension(self):
            return 2

        def encode(self, texts, normalize_embeddings=True):
            return [[float(len(t)), 0.0] for t in texts]

    return Lengths()


def test_embeddings(spark, cat):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 0.0])], "k string, v array<float>")
    got = {r.k: r.centroid for r in centroid(v, "v", "k").collect()}
    assert got["a"] == pytest.approx([0.5**0.5] * 2) and got["b"] == [0.0, 0.0]
    terms = {r.term: r.vector for r in encode_terms(["sat", "none"], cat, lengths(), window=1).collect()}
    assert terms["sat"] == [1.0, 0.0] and terms["none"] is None
    enc = search(cat, "sat").encode(lengths(), window=1).orderBy("start").collect()
    assert enc[0].token == "cat sat on" and enc[0].vector == [10.0, 0.0]


def test_plot_data(spark, two):
    assert rows(plotdata.barcode_data(two, ["fox", "brown"]), "position", "term", "y") == [(2, "brown", 1), (3, "fox", 0), (4, "brown", 1), (5, "fox", 0)]
    with pytest.warns(UserWarning, match="wolf"):
        plotdata.barcode_data(two, ["wolf"])
    assert rows(plotdata.dispersion_data(two, "fox", relative=True), "file_id", "position") == [("d2", 0.25), ("d2", 0.75)]
    with pytest.raises(ValueError):
        plotdata.dispersion_data(two, "wolf")


def test_documents_to_tokens(spark):
    docs = spark.createDataFrame([(1, "Don't stop. 12 cats!", "en", "s"), (2, None, "en", "s"), (3, "", "en", "s")], "doc_id int, text string, lang string, source string")
    got = tk.from_documents(docs).orderBy("idx").collect()
    assert [(r.token, r.sent, r.pos) for r in got] == [("Don't", "B", "NN1"), ("stop", "I", "NN1"), (".", "I", "PUN"), ("12", "B", "CRD"), ("cats", "I", "NN2"), ("!", "I", "PUN")]


def test_tagged_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("The/DT cat/NN\n\nand/or/CC sat/VBD\n./.\n")
    got = tk.read_text_corpus(spark, str(tmp_path / "a.txt")).orderBy("idx").collect()
    assert [(r.idx, r.token, r.pos, r.sent) for r in got] == [(0, "The", "DT", "B"), (1, "cat", "NN", "I"), (2, "and/or", "CC", "B"), (3, "sat", "VBD", "I"), (4, ".", ".", "B")]
    (tmp_path / "b.txt").write_text("bad\n")
    with pytest.raises(Exception, match="Malformed token"):
        tk.read_text_corpus(spark, str(tmp_path / "b.txt")).collect()


def test_xml_and_readers(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<t><s><w pos="AT0" hw="the">The </w><w pos="NN1" hw="cat">cat</w></s><s>sat\tVVD\tsit\n.\tPUN\t.\n</s></t>')
    got = tk.read_xml_corpus(spark, str(tmp_path / "a.xml")).orderBy("idx").collect()
    assert [(r.token, r.pos, r.lemma, r.sent) for r in got] == [("The", "AT0", "the", "B"), ("cat", "NN1", "cat", "I"), ("sat", "VVD", "sit", "B"), (".", "PUN", ".", "I")]

    class Tagged:
        fileids = staticmethod(lambda: ["x"])
        categories = staticmethod(lambda fileids: ["news"])
        tagged_sents = staticmethod(lambda fileids: [[("a", "A"), ("b", "B")], [("c", "C")]])

    got = tk.from_tagged_reader(spark, Tagged()).orderBy("idx").collect()
    assert [(r.token, r.pos, r.sent, r.category) for r in got] == [("a", "A", "B", "news"), ("b", "B", "I", "news"), ("c", "C", "B", "news")]
    with pytest.raises(AttributeError):
        tk.from_tagged_reader(spark, object())


def test_corpus_object(cat):
    c = Corpus(cat, chunk="chunks")
    assert c.frequencies().where("token = 'the'").collect()[0].freq == 4
    assert len(c.search("the dog")) == 1 and c.duplicate_keys().count() == 0
    assert c.with_chunk_index().agg(F.max("chunk_idx")).collect()[0][0] == 2
    assert c.crosstab("token", "chunks").count() > 0


def test_stream(spark, tmp_path):
    from lexiloom.streaming.incremental import search_stream

    source, out = tmp_path / "in", tmp_path / "out"
    docs = [(i, "the cat sat", "en", "s") for i in range(3)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(str(source))
    stream = spark.readStream.schema("doc_id bigint, text string, lang string, source string").parquet(str(source))
    search_stream(stream, "the cat", lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / "c")).awaitTermination(60)
    assert spark.read.parquet(f"{out}/*").count() == 3


def test_plans_stay_lean(spark, tmp_path):
    """One-token search and tokens need no shuffle and no Python; scans read only what they use."""
    docs = [(1, "the cat", "en", "s", 7)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "d"))
    plan = search(tk.from_documents(spark.read.parquet(str(tmp_path / "d"))), "the").matches._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "n_chars" not in plan and "source" not in plan


# tables in order: what operators do there must agree with what they do on any table --------------------------------------

TEXTS = ["The the of of it. With with walks! the red cats of the end", "", "with the the the the", "the of the of. of of of the dog walks with", "WITH wıth cats. 12 34 56 the", "the", "x. y. with"]
PATTERNS = ["the", "the _{N}", "the + of", "with $x: _{N}", "the the", "of * the", "+ the"]


@pytest.fixture(scope="module")
def ordered(spark):
    docs = spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(TEXTS)], "doc_id bigint, text string, lang string, source string").repartition(3, "doc_id")
    return tk.from_documents(docs)


def plain(df):
    """The same table without the note that it is in order."""
    return df.select("*")


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    assert sorted(map(repr, a.select(*cols).collect())) == sorted(map(repr, b.select(*cols).collect()))


@pytest.mark.parametrize("query", PATTERNS)
@pytest.mark.parametrize("overlapping", [False, True])
def test_in_order_search(ordered, query, overlapping):
    a, b = search(ordered, query, overlapping=overlapping), search(plain(ordered), query, overlapping=overlapping)
    same(a.matches, b.matches)
    if not overlapping:
        same(a.concordance(["token", "pos"], window=2, metadata=["lang", "sent"]), b.concordance(["token", "pos"], window=2, metadata=["lang", "sent"]))


@pytest.mark.parametrize("query", ["the _{N}", "with _{N}", "_NN1 _NN1"])
def test_in_order_results(ordered, query):
    a, b = search(ordered, query), search(plain(ordered), query)
    for strict in (False, True):
        same(a.concordance(["token", "pos"], chunk_column="sent", metadata="lang", strict_chunks=strict), b.concordance(["token", "pos"], chunk_column="sent", metadata="lang", strict_chunks=strict))
    same(a.collocates(F.lower("token").alias("w"), 2, 1), b.collocates(F.lower("token").alias("w"), 2, 1))
    same(a.with_spans_as_chunks(), b.with_spans_as_chunks())


@pytest.mark.parametrize("query", ['[pos!="AJ0"] [token="the"%c] [pos="AJ0"]* [pos="NN.*"]', '$a: ([pos="NN1"]) [pos!="NN1"]* $b: ([token="of|the"%c])', '[pos="NN1"]+', "[]{1,2} [token=\"the\"]"])
def test_in_order_automaton(ordered, query, monkeypatch):
    from lexiloom.operators import search as module

    monkeypatch.setattr(module, "CHUNK", 2)
    same(search_cqp(ordered, query).matches, search_cqp(plain(ordered), query).matches)


def test_gap_counts_every_start(ordered):
    """search_gap_fixed is of every start, as its SQL: 'the the of of' holds two."""
    assert search(ordered, "the + of", overlapping=True).matches.where("file_id = 0").count() == 2
    assert search(ordered, "the + of").matches.where("file_id = 0").count() == 1


def test_in_order_counts(ordered):
    from lexiloom.operators.tables import file_counts

    same(file_counts(ordered, F.lower("token")), file_counts(plain(ordered), F.lower("token")))
    for method in ("sd", "da", "dp", ["range", "d"]):
        a, b = (dispersion(x, F.lower("token").alias("w"), method) for x in (ordered, plain(ordered)))
        measures = [c for c in a.columns if c != "w"]
        a, b = (x.select("w", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in measures]) for x in (a, b))
        same(a, b)


def test_documents_are_cut_once(ordered):
    """A filter on the number of words would cut every text three times; what isn't asked for isn't made."""
    plan = ordered.where("token = 'the'").select("file_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "lower" not in plan


def test_tagged_table(spark, ordered):
    cols = ["file_id", "idx", "token", "pos", "sent"]
    texts = tk.tagged_text(ordered)
    same(texts, tk.tagged_text(plain(ordered)))
    same(tk.from_tagged_text(texts), ordered.select(*cols))
    odd = spark.createDataFrame([(1, "\n \na/b/C  d/ \r\n\t\n  e/F\n")], "file_id int, value string")
    assert [tuple(r)[1:] for r in tk.from_tagged_text(odd).orderBy("idx").collect()] == [(0, "a/b", "C", "B"), (1, "d", " ", "I"), (2, "e", "F", "B")]


def test_written_in_order(spark, ordered, tmp_path):
    tk.write_corpus(ordered, str(tmp_path / "c"), files=2, columns=["file_id", "idx", "token"])
    same(spark.read.parquet(str(tmp_path / "c")), ordered.select("file_id", "idx", "token"))


def test_pos_of(spark):
    words = ["The", "of", "AND", "12a", "Rapidly", "running", "ended", "able", "cats", "x"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", tk.pos_rule(F.col("w")).alias("p")).collect()
    assert [r.p for r in got] == [tk.pos_of(r.w) for r in got]
