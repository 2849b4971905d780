"""The inverted index as DataFrames, and corpus statistics.

``forward``     (doc_id, field, doc_len, terms)    one row per document and field; ``terms`` is the term vector
``postings``    (field, term, doc_id, tf, weight, positions, doc_len)
``term_stats``  (field, term, df, cf, freq, min_len, max_len, max_weight, min_id, max_id)
``field_stats`` (field, n_docs, total_len, min_len, max_len, avg_len, scorable)
and the join keys of the lexicon, see :mod:`.lexkeys`

Postings are made inside each document's row, so building ``forward`` and ``postings`` shuffles nothing. The document
length rides on every posting, so scoring needs no join with a length table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import runs
from ..functions.tokens import Filter, an_id, an_standard, number
from ..session import shuffles_removed, spread
from . import lexkeys


@dataclass(frozen=True)
class Field:
    """How one corpus column is indexed.

    ``level`` is ``existence``, ``frequency``, ``positions`` or ``characters``. An array column skips the analyzer.
    ``boost_column`` / ``doc_boost_column`` name columns holding a per-row weight multiplier.
    """

    column: str
    analyzer: Filter | None = None
    level: str = "positions"
    scorable: bool = True
    boost: float = 1.0
    name: str | None = None
    boost_column: str | None = None
    doc_boost_column: str | None = None

    @property
    def field(self) -> str:
        return self.name or self.column


def text_field(column: str, **kw) -> Field:
    return Field(column, kw.pop("analyzer", None) or an_standard(), **kw)


def id_field(column: str, **kw) -> Field:
    return Field(column, an_id(), level="existence", scorable=False, **kw)


def keyword_field(column: str, analyzer: Filter | None = None, **kw) -> Field:
    return Field(column, analyzer, level="frequency", scorable=kw.pop("scorable", False), **kw)


POSTING = ("array<struct<term:string,tf:int,weight:double,positions:array<int>,"
           "chars:array<struct<startchar:int,endchar:int>>,boosts:array<double>>>")


def postings_of(tokens: Column, level: str = "positions", boost: Column | float = 1.0, boosted: bool = False) -> Column:
    """A token list grouped into one entry per term, inside the row."""
    factor = boost if isinstance(boost, Column) else F.lit(float(boost))

    def entry(g: Column) -> Column:
        tf = F.lit(1) if level == "existence" else F.size(g)
        if boosted and level != "existence":
            weight = F.aggregate(g["boost"], F.lit(0.0), lambda acc, x: acc + x) * factor
        else:
            weight = tf.cast("double") * factor
        no_ints = F.lit(None).cast("array<int>")
        return F.struct(
            g[0]["term"].alias("term"), tf.alias("tf"), weight.alias("weight"),
            (g["pos"] if level in ("positions", "characters") else no_ints).alias("positions"),
            (F.transform(g, lambda t: F.struct(t["startchar"].alias("startchar"), t["endchar"].alias("endchar")))
             if level == "characters" else F.lit(None).cast("array<struct<startchar:int,endchar:int>>")).alias("chars"),
            (g["boost"] if boosted else F.lit(None).cast("array<double>")).alias("boosts"))

    return runs(F.sort_array(tokens), "term", entry).cast(POSTING)


def forward_index(corpus: DataFrame, fields: Sequence[Field], key: str = "doc_id") -> DataFrame:
    """One narrow pass over the corpus: analyze every field and group its tokens in place."""
    types = dict(corpus.dtypes)
    cells = []
    for f in fields:
        tokens = number(F.col(f.column)) if types[f.column].startswith("array") and f.analyzer is None else (f.analyzer or an_id())(F.col(f.column))
        boost: Column = F.lit(float(f.boost))
        if f.boost_column and f.boost_column in types:
            per_doc = F.col(f.doc_boost_column) if f.doc_boost_column else F.lit(1.0)
            boost = boost * F.coalesce(F.col(f.boost_column), per_doc, F.lit(1.0))
        elif f.doc_boost_column:
            boost = boost * F.coalesce(F.col(f.doc_boost_column), F.lit(1.0))
        # The element type tells whether the analyzer gave boosts; a missing value has no tokens.
        kind = corpus.select(tokens.alias("t")).schema["t"].dataType
        boosted = "boost" in kind.elementType.names
        terms = postings_of(F.coalesce(tokens, F.array().cast(kind)), f.level, boost, boosted)
        cells.append(F.struct(F.lit(f.field).alias("field"), F.lit(f.scorable).alias("scorable"), terms.alias("terms")))
    rows = corpus.select(F.col(key).alias("doc_id"), F.explode(F.array(*cells)).alias("c"))
    length = F.aggregate(F.col("c.terms.tf"), F.lit(0), lambda acc, x: acc + x)
    return rows.select("doc_id", "c.field", F.when(F.col("c.scorable"), length).otherwise(F.lit(0)).alias("doc_len"),
                       "c.scorable", "c.terms")


def explode_postings(forward: DataFrame) -> DataFrame:
    return (forward.select("field", "doc_id", "doc_len", F.explode("terms").alias("p"))
            .select("field", "p.term", "doc_id", "p.tf", "p.weight", "p.positions", "p.chars", "p.boosts", "doc_len"))


def term_statistics(postings: DataFrame) -> DataFrame:
    """Partial sums per task first, so a term found in every document costs one row per task."""
    return postings.groupBy("field", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("weight").alias("cf"), F.sum("tf").alias("freq"),
        F.min("doc_len").alias("min_len"), F.max("doc_len").alias("max_len"), F.max("weight").alias("max_weight"),
        F.min("doc_id").alias("min_id"), F.max("doc_id").alias("max_id"))


def field_statistics(forward: DataFrame) -> DataFrame:
    """Every document has a row per field, so the average also counts documents without the field."""
    present = F.when(F.col("doc_len") > 0, F.col("doc_len"))
    return forward.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("doc_len").alias("total_len"), F.min(present).alias("min_len"),
        F.max(present).alias("max_len"), F.max("scorable").alias("scorable")) \
        .withColumn("avg_len", F.when(F.col("total_len") > 0, F.col("total_len") / F.col("n_docs")).otherwise(F.lit(1.0)))


# Partitions that the terms of saved postings are dealt into by hash: a query reads those of its terms only.
TERM_BUCKETS = 32


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    """A corpus and its index. Build it lazily from a corpus, or save it once and load it for every later job."""

    corpus: DataFrame
    forward: DataFrame
    stored_postings: DataFrame | None = None
    stored_terms: DataFrame | None = None
    stored_fields: DataFrame | None = None
    buckets: int = TERM_BUCKETS
    stored_grams: DataFrame | None = None
    stored_gram_stats: DataFrame | None = None
    stored_close_keys: DataFrame | None = None

    @classmethod
    def build(cls, corpus: DataFrame, fields: Sequence[Field], key: str = "doc_id") -> SearchIndex:
        corpus = spread(corpus, key)
        return cls(corpus.withColumnRenamed(key, "doc_id"), forward_index(corpus, fields, key))

    @cached_property
    def postings(self) -> DataFrame:
        return self.stored_postings.drop("bucket") if self.stored_postings is not None else explode_postings(self.forward)

    def postings_of(self, buckets: Sequence[int] | None, fields: Sequence[str] | None = None) -> DataFrame:
        """The postings; of saved ones, only the partitions that hold terms of these buckets and fields (None: all) are listed and read."""
        if self.stored_postings is None or buckets is None or "bucket" not in self.stored_postings.columns:
            return self.postings
        kept = self.stored_postings.filter(F.col("bucket").isin(sorted(buckets)))
        return (kept if fields is None else kept.filter(F.col("field").isin(sorted(fields)))).drop("bucket")

    @cached_property
    def term_stats(self) -> DataFrame:
        return self.stored_terms if self.stored_terms is not None else term_statistics(self.postings)

    @cached_property
    def field_stats(self) -> DataFrame:
        return self.stored_fields if self.stored_fields is not None else field_statistics(self.forward)

    @cached_property
    def grams(self) -> DataFrame:
        return self.stored_grams if self.stored_grams is not None else lexkeys.grams(self.lexicon)

    @cached_property
    def gram_stats(self) -> DataFrame:
        return self.stored_gram_stats if self.stored_gram_stats is not None else lexkeys.gram_stats(self.grams)

    @cached_property
    def close_keys(self) -> DataFrame:
        return self.stored_close_keys if self.stored_close_keys is not None else lexkeys.close_keys(self.lexicon)

    @property
    def term_counts(self) -> DataFrame:
        """(field, n_terms): a row for each field."""
        return self.gram_stats.filter(F.col("gram").startswith(lexkeys.START)).groupBy("field").agg(F.sum("n").alias("n_terms"))

    @property
    def doc_ids(self) -> DataFrame:
        return self.corpus.select("doc_id")

    @property
    def lexicon(self) -> DataFrame:
        return self.term_stats.select("field", "term")

    @property
    def spark(self) -> SparkSession:
        return self.corpus.sparkSession

    def save(self, path: str, corpus_path: str | None = None) -> SearchIndex:
        """Write the tables. Postings are partitioned by field and by a hash of the term, and inside that ranged by (term, doc), so
        a term held by most documents is spread over many files."""
        if corpus_path is None:
            corpus_path = f"{path}/corpus"
            self.corpus.write.mode("overwrite").parquet(corpus_path)
        self.forward.write.mode("overwrite").parquet(f"{path}/forward")
        forward = self.spark.read.parquet(f"{path}/forward")
        write_postings(explode_postings(forward), f"{path}/postings", self.buckets)
        postings = self.spark.read.parquet(f"{path}/postings")
        term_statistics(postings).repartitionByRange("field", "term").sortWithinPartitions("field", "term") \
            .write.mode("overwrite").parquet(f"{path}/term_stats")
        field_statistics(forward).coalesce(1).write.mode("overwrite").parquet(f"{path}/field_stats")
        lexicon = self.spark.read.parquet(f"{path}/term_stats").select("field", "term")
        lexkeys.grams(lexicon).write.mode("overwrite").parquet(f"{path}/grams")
        lexkeys.gram_stats(lexkeys.grams(lexicon)).write.mode("overwrite").parquet(f"{path}/gram_stats")
        lexkeys.close_keys(lexicon).write.mode("overwrite").parquet(f"{path}/close_keys")
        return self.load(self.spark, path, corpus_path, self.buckets)

    @classmethod
    def load(cls, spark: SparkSession, path: str, corpus_path: str | None = None, buckets: int = TERM_BUCKETS) -> SearchIndex:
        read = spark.read.parquet
        return cls(read(corpus_path or f"{path}/corpus"), read(f"{path}/forward"), read(f"{path}/postings"),
                   read(f"{path}/term_stats"), read(f"{path}/field_stats"), buckets,
                   read(f"{path}/grams"), read(f"{path}/gram_stats"), read(f"{path}/close_keys"))


class IndexOnUse(SearchIndex):
    """An index under ``path`` whose tables are each written when a query first reads them, from the one before: the corpus gives
    ``forward``, that the statistics, those the lexicon's keys. A query of the corpus alone writes nothing. Postings are not written a second
    time: they are exploded from ``forward``, where all postings of a document lie in one row."""

    def __init__(self, corpus: DataFrame, fields: Sequence[Field], path: str, key: str = "doc_id"):
        vars(self).update(corpus=corpus.withColumnRenamed(key, "doc_id"), _given=corpus, _fields=tuple(fields), _path=path, _key=key)

    def _table(self, name: str, rows: DataFrame) -> DataFrame:
        with shuffles_removed(self.spark):
            rows.write.mode("overwrite").parquet(f"{self._path}/{name}")
        return self.spark.read.parquet(f"{self._path}/{name}")

    @cached_property
    def forward(self) -> DataFrame:
        return self._table("forward", forward_index(spread(self._given, self._key), self._fields, self._key))

    @cached_property
    def stored_terms(self) -> DataFrame:
        return self._table("term_stats", term_statistics(self.postings))

    @cached_property
    def stored_fields(self) -> DataFrame:
        return self._table("field_stats", field_statistics(self.forward).coalesce(1))

    @cached_property
    def stored_grams(self) -> DataFrame:
        return self._table("grams", lexkeys.grams(self.lexicon))

    @cached_property
    def stored_gram_stats(self) -> DataFrame:
        return self._table("gram_stats", lexkeys.gram_stats(self.grams))

    @cached_property
    def stored_close_keys(self) -> DataFrame:
        return self._table("close_keys", lexkeys.close_keys(self.lexicon))


def write_postings(postings: DataFrame, path: str, buckets: int = TERM_BUCKETS) -> None:
    (postings.withColumn("bucket", term_bucket(F.col("term"), buckets))
     .repartitionByRange("field", "bucket", "term", "doc_id").sortWithinPartitions("field", "bucket", "term", "doc_id")
     .write.mode("overwrite").partitionBy("field", "bucket").parquet(path))


# ---- statistics operators -------------------------------------------------------------------------------------

def term_vector(index: SearchIndex, field: str) -> DataFrame:
    """(doc_id, vector map<term, weight>) straight from the forward index: no shuffle."""
    entries = F.transform("terms", lambda t: F.struct(t["term"], t["weight"]))
    return index.forward.filter(F.col("field") == field).select("doc_id", F.map_from_entries(entries).alias("vector"))


def doc_lengths(index: SearchIndex) -> DataFrame:
    return index.forward.filter("doc_len > 0").select("field", "doc_id", F.col("doc_len").alias("length"))


def doc_counts(index: SearchIndex) -> DataFrame:
    """Deleted rows are really gone, so both counts agree."""
    return index.corpus.agg(F.count(F.lit(1)).alias("doc_count")).withColumn("doc_count_all", F.col("doc_count"))


def terms_from(index: SearchIndex, field: str, start: str) -> DataFrame:
    return index.lexicon.filter((F.col("field") == field) & (F.col("term") >= start))


def prefix_terms(index: SearchIndex, field: str, prefix: str) -> DataFrame:
    return index.lexicon.filter((F.col("field") == field) & F.col("term").startswith(prefix))


def most_frequent_terms(index: SearchIndex, field: str, number: int = 5, prefix: str = "") -> DataFrame:
    """Ties go to the later term."""
    return (index.term_stats.filter((F.col("field") == field) & F.col("term").startswith(prefix))
            .select("term", F.col("cf").alias("weight")).orderBy(F.desc("weight"), F.desc("term")).limit(number))


def distinctiveness(index: SearchIndex, field: str, prefix: str = "") -> DataFrame:
    """``cf * ln(N / df)`` for every term of a field."""
    stats = index.field_stats.filter(F.col("field") == field).select("field", "n_docs")
    return (index.term_stats.filter((F.col("field") == field) & F.col("term").startswith(prefix))
            .join(F.broadcast(stats), "field")
            .select("term", "cf", "df", (F.col("cf") * F.ln(F.col("n_docs") / F.col("df"))).alias("weight")))


def most_distinctive_terms(index: SearchIndex, field: str, number: int = 5, prefix: str = "") -> DataFrame:
    return distinctiveness(index, field, prefix).select("term", "weight") \
        .orderBy(F.desc(F.round("weight", 9)), F.desc("term")).limit(number)


def lookup_documents(corpus: DataFrame, **values) -> DataFrame:
    """Rows where every given column holds the given value."""
    for column, value in values.items():
        corpus = corpus.filter(F.array_contains(column, value) if dict(corpus.dtypes)[column].startswith("array")
                               else F.col(column) == value)
    return corpus


def first_id(index: SearchIndex, field: str, term: str) -> DataFrame:
    return index.term_stats.filter((F.col("field") == field) & (F.col("term") == term)).select(F.col("min_id").alias("doc_id"))


def postings_dump(index: SearchIndex) -> DataFrame:
    return index.postings.orderBy("field", "term", "doc_id")
