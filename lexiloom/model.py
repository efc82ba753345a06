"""A token table with the roles of its columns; all operators as methods."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text
from .functions.validate import check_columns
from .operators import dispersion as _dispersion
from .operators import embeddings, lexical, plotdata, search, tables
from .operators import keywords as _keywords


@dataclass(frozen=True)
class Corpus:
    """Rows have a unique (file, index); index counts from 0 without gaps in each file."""

    df: DataFrame
    token: str = "token"
    pos: str = "pos"
    lemma: str = "lemma"
    file: str = "file_id"
    index: str = "idx"
    chunk: str | None = "sent"

    def __post_init__(self):
        check_columns(self.df, token=self.token, file=self.file, index=self.index)

    def where(self, condition) -> Corpus:
        """A subcorpus, by metadata (whole files: positions stay as they are)."""
        return replace(self, df=self.df.where(condition))

    def duplicate_keys(self) -> DataFrame:
        """Keys that occur more than once; no rows in a sound corpus."""
        return self.df.groupBy(self.file, self.index).count().where(F.col("count") > 1)

    def broken_files(self) -> DataFrame:
        """Files whose positions aren't 0 to n - 1, each once: file, tokens, first and last position. Positions that lack
        or repeat would shift spans; no rows in a sound corpus. Partial sums, one aggregation."""
        at = F.col(self.index).cast("bigint")
        files = self.df.groupBy(self.file).agg(F.count("*").alias("tokens"), F.min(at).alias("first"), F.max(at).alias("last"), F.sum(at).alias("_sum"), F.sum(at.cast("decimal(38,0)") * at).alias("_squares"))
        n = F.col("tokens").cast("decimal(19,0)")
        sound = (F.col("first") == 0) & (F.col("last") == F.col("tokens") - 1) & (2 * F.col("_sum") == F.col("tokens") * (F.col("tokens") - 1)) & (6 * F.col("_squares") == n * (n - 1) * (2 * n - 1))
        return files.where(~F.coalesce(sound, F.lit(False))).drop("_sum", "_squares")

    def search(self, query: str, **kw) -> search.SearchResults:
        return search.search(self.df, query, self.token, self.pos, self.lemma, self.file, self.index, **kw)

    def search_cqp(self, query: str, **kw) -> search.SearchResults:
        return search.search_cqp(self.df, query, self.file, self.index, **kw)

    def frequencies(self, expr=None) -> DataFrame:
        return tables.frequencies(self.df, self.token if expr is None else expr)

    def crosstab(self, x, y, freqs_name: str = "freqs") -> DataFrame:
        return tables.crosstab(self.df, x, y, freqs_name)

    def keywords(self, reference: Corpus | DataFrame, expr=None, method: str = "ll", **kw) -> DataFrame:
        other = reference.df if isinstance(reference, Corpus) else reference
        return _keywords.keywords(self.df, other, self.token if expr is None else expr, method, file_id_column=self.file, **kw)

    def dispersion(self, expr=None, method="dp", min_freq: int = 0) -> DataFrame:
        return _dispersion.dispersion(self.df, self.token if expr is None else expr, method, min_freq, self.file)

    def ttr(self, expr=None, by=None) -> DataFrame:
        return lexical.ttr(self.df, self.token if expr is None else expr, by)

    def msttr(self, expr=None, n: int = 1000, by=None) -> DataFrame:
        return lexical.msttr(self.df, self.token if expr is None else expr, n, self.index, by or self.file)

    def mtld(self, expr=None, threshold: float = 0.72, by=None) -> DataFrame:
        return lexical.mtld(self.df, self.token if expr is None else expr, threshold, self.index, by or self.file)

    def yules_k(self, expr=None, by=None) -> DataFrame:
        return lexical.yules_k(self.df, self.token if expr is None else expr, by)

    def vocabulary_growth(self, expr=None, by=None) -> DataFrame:
        return lexical.vocabulary_growth(self.df, self.token if expr is None else expr, self.index, by or self.file)

    def ngrams(self, n: int, expr=None, as_str: bool = True, name: str = "ngram") -> DataFrame:
        return self.df.withColumn(name, text.ngrams(n, self.token if expr is None else expr, self.index, self.file, as_str))

    def with_chunk_index(self, name: str = "chunk_idx", by: str | None = None) -> DataFrame:
        return text.with_chunk_index(self.df, self.chunk, name, self.index, by or self.file)

    def encode_terms(self, terms: list[str], model, **kw) -> DataFrame:
        return embeddings.encode_terms(terms, self.df, model, self.token, **kw)

    def barcode_data(self, terms: list[str], **kw) -> DataFrame:
        return plotdata.barcode_data(self.df, terms, self.token, self.file, self.index, **kw)

    def dispersion_data(self, term: str, **kw) -> DataFrame:
        return plotdata.dispersion_data(self.df, term, self.token, file_id_column=self.file, index_column=self.index, **kw)
