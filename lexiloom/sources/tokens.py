"""Token tables: one row a token with file_id and idx (its place in the file), and annotations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*|[0-9]+|[^\s\p{L}\p{M}0-9]"
STOPS = (".", "!", "?")
ARTICLES = ("the", "a", "an", "le", "la", "les", "der", "die", "das", "el", "los", "las", "un", "une", "una")
PREPOSITIONS = ("of", "in", "to", "for", "with", "on", "at", "by", "from", "de", "en", "zu", "mit", "von")
CONJUNCTIONS = ("and", "or", "et", "und", "y", "o")


def pos_of(word: str) -> str:
    """pos_rule() of a word of ASCII letters and digits."""
    low = word.lower()
    for tag, words in (("AT0", ARTICLES), ("PRP", PREPOSITIONS), ("CJC", CONJUNCTIONS)):
        if low in words:
            return tag
    ends = (("ly", "AV0"), ("ing", "VVG"), ("ed", "VVD"), ("ble", "AJ0"), ("s", "NN2"), ("", "NN1"))
    return "CRD" if word[0].isdigit() else next(tag for end, tag in ends if low.endswith(end))


def parts(df: DataFrame, size: int = 8 << 20) -> int:
    """Into how many partitions to spread documents: one by so many bytes that are scanned (compressed texts of some
    three times that), two by core at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    scanned = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    known = scanned if scanned < 1 << 50 else 0  # tables that aren't files have no size
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, known // size)


class Source:
    """What a token table in order was made of: ``files`` has a row a file with file_id, metadata and its words ``w``.
    A token's neighbours are in its own row as long as ``w`` is, so contexts and sequences need no join and no shuffle."""

    def __init__(self, files: DataFrame, metadata: Iterable[str]):
        self.files, self.metadata = files, tuple(metadata)
        self.columns = ["file_id", "idx", "token", "lemma", "pos", "sent", *self.metadata]

    def column(self, name: str, i: Column, token: Column | None = None, low: Column | None = None) -> Column:
        """A column of the token at place i of the row's file; null outside of the file."""
        if name == "file_id" or name in self.metadata:
            return F.col(f"`{name}`")
        if name == "idx":
            return i.cast("bigint")
        inside, token = token is not None, F.get("w", i) if token is None else token
        if name == "token":
            return token
        if name == "lemma":
            return lemma_rule(token, low)
        value = pos_rule(token, low) if name == "pos" else F.when((i == 0) | F.get("w", i - 1).isin(*STOPS), "B").otherwise("I")
        return value if inside else F.when(token.isNotNull(), value)

    def exploded(self, files: DataFrame | None = None) -> DataFrame:
        """A row a token: file_id, metadata, w, idx, token and low. The outer form keeps the optimiser from cutting texts
        into words two more times, to look for files without any."""
        rows = (self.files if files is None else files).select("file_id", *self.metadata, "w", F.posexplode_outer("w").alias("idx", "token"))
        return rows.where("token is not null").withColumn("low", F.lower("token"))

    def here(self, name: str) -> Column:
        """A column of the token of a row of exploded()."""
        return self.column(name, F.col("idx"), F.col("token"), F.col("low"))

    def tokens(self, files: DataFrame | None = None) -> DataFrame:
        df = self.exploded(files).select(*[self.here(c).alias(c) for c in self.columns])
        df.__dict__["_lexiloom_source"] = self
        return df

    def rows_at(self, rows: DataFrame, place: str, keep: Iterable[str] = ()) -> DataFrame:
        """The tokens at places of files (rows with file_id, metadata and w)."""
        return rows.select(*keep, *[self.column(c, F.col(place)).alias(c) for c in self.columns])


def source(df: DataFrame, file_id_column: str = "file_id", index_column: str = "idx") -> Source | None:
    """The source of a table that from_documents gave: every file is in one task, whole and in order. The note is on that
    very object; what Spark's own methods make of it has none, as rows may have been moved or left out."""
    return df.__dict__.get("_lexiloom_source") if (file_id_column, index_column) == ("file_id", "idx") else None


def lemma_rule(token: Column, low: Column | None = None) -> Column:
    low = F.lower(token) if low is None else low
    return F.when(F.char_length(low) > 4, F.regexp_replace(low, "(ing|ed|es|s)$", "")).otherwise(low)


def pos_rule(token: Column, low: Column | None = None) -> Column:
    """``low``: the token in lower case, if it is at hand. Strings compare by bytes, so that a token of an ASCII letter or
    digit first is told without a regular expression."""
    low = F.lower(token) if low is None else low
    letter = ((token >= "a") & (token < "{")) | ((token >= "A") & (token < "["))
    return (
        F.when(~letter & (token >= "0") & (token < ":"), "CRD").when(~letter & token.rlike(r"^[^\p{L}\p{M}0-9]"), "PUN")
        .when(low.isin(*ARTICLES), "AT0").when(low.isin(*PREPOSITIONS), "PRP").when(low.isin(*CONJUNCTIONS), "CJC")
        .when(low.endswith("ly"), "AV0").when(low.endswith("ing"), "VVG").when(low.endswith("ed"), "VVD")
        .when(low.endswith("ble"), "AJ0").when(low.endswith("s"), "NN2").otherwise("NN1")
    )


def from_documents(docs: DataFrame, file_id: str = "doc_id", text: str = "text", metadata: Iterable[str] = ("lang", "source")) -> DataFrame:
    """file_id, idx, token, lemma, pos, sent (B opens a sentence, else I) and metadata. Cut and annotated in one
    projection of each document: no shuffle, no Python."""
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    metadata = list(metadata)
    return Source(docs.select(F.col(file_id).alias("file_id"), *metadata, words.alias("w")), metadata).tokens()


def tagged_text(df: DataFrame) -> DataFrame:
    """Every file of a token table as tagged text, a sentence a line: a row a file with file_id and value."""
    own = source(df)
    if own:
        word = F.transform("w", lambda x, i: F.concat(F.when(i == 0, "").when(F.get("w", i - 1).isin(*STOPS), "\n").otherwise(" "), x, F.lit("/"), own.column("pos", i, x)))
        return own.files.where("size(w) > 0").select("file_id", F.array_join(word, "").alias("value"))
    item = F.struct("idx", F.concat(F.when(F.col("idx") == 0, "").when(F.col("sent") == "B", "\n").otherwise(" "), "token", F.lit("/"), "pos").alias("t"))
    return df.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), "").alias("value"))


def from_tagged_text(texts: DataFrame) -> DataFrame:
    """Tagged text of a table with file_id and value, as read_text_corpus() has it: for corpora of so many files that
    listing and opening each is most of the work."""
    words = F.regexp_extract_all("value", F.lit(r"(?:\n\s*)?\S+"), F.lit(0))  # the first of a line begins with its break
    rows = texts.select("file_id", F.posexplode(words).alias("idx", "_w"))
    opens = (F.col("idx") == 0) | F.col("_w").startswith("\n")
    rows = rows.select("file_id", F.col("idx").cast("bigint").alias("idx"), F.when(opens, F.ltrim("_w", F.lit(" \t\n\x0b\f\r"))).otherwise(F.col("_w")).alias("t"), F.when(opens, "B").otherwise("I").alias("sent"))
    rows = rows.withColumn("_tag", F.substring_index("t", "/", -1))
    wrong = F.raise_error(F.concat(F.lit("Malformed token: "), F.col("t")))
    good = F.col("t").contains("/")
    token = F.substring(F.col("t"), F.lit(1), F.char_length("t") - F.char_length("_tag") - 1)
    return rows.select("file_id", "idx", F.when(good, token).otherwise(wrong).alias("token"), F.when(good, F.col("_tag")).otherwise(wrong).alias("pos"), "sent")


def read_text_corpus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Tagged text: blank-separated token/TAG, a sentence a line. Columns file_id (the path), idx, token, pos, sent.
    The last slash parts token and tag; a token without one is an error when it is read. Files are read whole, as a
    token's place in its file follows from the lines before; files are the unit of parallelism."""
    return from_tagged_text(spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), F.col("value")))


#: The same: a Spark table is lazy already, and the optimiser prunes and limits it.
scan_text_corpus = read_text_corpus


class CorpusReader:
    """A reader for a format of one's own: subclass it, give ``schema`` (of what read_file yields) and read_file."""

    schema = "token string, pos string, sent string"

    def read_file(self, path: str) -> Iterator[dict]:
        raise NotImplementedError

    def read(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        """file_id, idx and the reader's columns; files are read in parallel, wherever the workers can open them."""
        own = T._parse_datatype_string(self.schema)
        names = [f.name for f in own.fields]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for path in b["path"]:
                    rows: list = []
                    for i, r in enumerate(self.read_file(path)):
                        rows.append((path, i, *(r.get(n) for n in names)))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["file_id", "idx", *names])
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=["file_id", "idx", *names])

        listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 10_000)))
        return listed.mapInPandas(run, T.StructType([T.StructField("file_id", T.StringType()), T.StructField("idx", T.LongType()), *own.fields]))


def from_tagged_reader(spark: SparkSession, reader) -> DataFrame:
    """From an object with fileids() and tagged_sents, sents, tagged_words or words (the first that it has), in the style
    of natural-language toolkits; with categories() also each file's category."""
    for kind in ("tagged_sents", "sents", "tagged_words", "words"):
        if hasattr(reader, kind):
            break
    else:
        raise AttributeError("the reader has none of tagged_sents, sents, tagged_words, words")
    tagged, sents = kind.startswith("tagged"), kind.endswith("sents")
    rows = []
    for f in reader.fileids():
        category = None
        if hasattr(reader, "categories"):
            named = list(reader.categories(fileids=[f]))
            category = named[0] if named else None
        i = 0
        for sent in getattr(reader, kind)(fileids=[f]) if sents else [getattr(reader, kind)(fileids=[f])]:
            for k, t in enumerate(sent):
                rows.append((f, i, t[0] if tagged else t, t[1] if tagged else None, ("B" if k == 0 else "I") if sents else None, category))
                i += 1
    df = spark.createDataFrame(rows, "file_id string, idx bigint, token string, pos string, sent string, category string")
    drop = [c for c, there in (("pos", tagged), ("sent", sents), ("category", hasattr(reader, "categories"))) if not there]
    return df.drop(*drop)


def read_xml_corpus(spark: SparkSession, paths: str | list[str], sentence: str = "s", word: str = "w", attributes: dict[str, str] | None = None) -> DataFrame:
    """XML files: elements ``sentence`` hold elements ``word`` or, without any, lines of token, tag and lemma parted by
    tabs. ``attributes``: column by attribute of a word. One file a row of a binary scan, parsed by its worker."""
    attributes = attributes or {"pos": "pos", "hw": "lemma"}
    columns = list(dict.fromkeys([*attributes.values(), "pos", "lemma"]))
    schema = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("token", T.StringType()), *(T.StructField(c, T.StringType()) for c in columns), T.StructField("sent", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as ET

        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows: list = []
                for s in ET.fromstring(content).iter(sentence):
                    found = list(s.iter(word))
                    items = [("".join(w.itertext()).strip(), {c: w.get(a) for a, c in attributes.items()}) for w in found]
                    if not found:
                        cells = [x.split("\t") for x in "".join(s.itertext()).split("\n") if x.strip()]
                        items = [(c[0], {"pos": c[1] if len(c) > 1 else None, "lemma": c[2] if len(c) > 2 else None}) for c in cells]
                    for k, (token, more) in enumerate(items):
                        rows.append((path, len(rows), token, *(more.get(c) for c in columns), "B" if k == 0 else "I"))
                yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, schema)


def write_corpus(df: DataFrame, path: str, file_id: str = "file_id", index: str = "idx", files: int | None = None, columns: list[str] | None = None) -> None:
    """Parquet in which each file's tokens are together and in order: later windows over files then sort less, and
    filters on file_id skip row groups. Of a table in order the documents are sorted, not the tokens.
    ``columns``: those to write, all if None."""
    parts_asked = [files] if files else []
    own = source(df, file_id, index)
    if own:
        spread = own.files.repartitionByRange(*(parts_asked or [parts(own.files)]), file_id).sortWithinPartitions(file_id)
        own.tokens(spread).select(*(columns or df.columns)).write.mode("errorifexists").parquet(path)
        return
    df.repartitionByRange(*parts_asked, file_id).sortWithinPartitions(file_id, index).select(*(columns or df.columns)).write.mode("errorifexists").parquet(path)
