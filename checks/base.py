"""Tables, the shared index and the SQL building blocks of the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.tokens import an_simple
from gleanery.operators.index import Field, IndexOnUse, SearchIndex, id_field, keyword_field, text_field
from gleanery.session import scratch_path, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under an operator's name, with the SQL it must agree with."""
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


KEYS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; the text tables are spread over the cores when they come in one small file."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, KEYS[name]) if name in KEYS else df


FIELDS = (text_field("text"), id_field("lang"), id_field("source"))
# All words of a text with their numbers, as the service's job pages are tagged.
TAG_FIELDS = (keyword_field("text", an_simple(), name="tags"),)


_INDEXES: dict[tuple, SearchIndex] = {}


def index(spark: SparkSession, sf: str, fields: tuple[Field, ...] = FIELDS) -> SearchIndex:
    """The index of these fields of ``documents``: each of its tables is written once per session to the shared folder, when a query first reads it."""
    key = (spark.sparkContext.applicationId, sf, *(f.field for f in fields))
    if key not in _INDEXES:
        _INDEXES[key] = IndexOnUse(spark.read.parquet(f"{sf}/documents.parquet"), fields, scratch_path(spark, "index"))
    return _INDEXES[key]


def r6(column: str = "score"):
    return F.round(F.col(column), 6).alias(column)


# ---- SQL building blocks -----------------------------------------------------------------------------------------

W = r"[\p{L}\p{N}_]"
PATTERN = rf"{W}+(?:\.{W}+)*"
STOPS = ("a an and are as at be by can for from have if in is it may not of on or tbd that the this to us we when will with yet you your").split()
STOP_SQL = ", ".join(f"'{w}'" for w in STOPS)


def raw_tokens(name: str, source: str, key: str = "doc_id", text: str = "text", pattern: str = PATTERN, lower: bool = True) -> str:
    """CTE ``name(key, pos, term)``: regex tokens numbered from 0."""
    term = "lower(x)" if lower else "x"
    return (f"{name}_w AS (SELECT {key}, list_transform(regexp_extract_all({text}, '{pattern}'), lambda x: {term}) AS ws FROM {source}), "
            f"{name} AS (SELECT {key}, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM {name}_w)")


def std_tokens(name: str, source: str, key: str = "doc_id", text: str = "text") -> str:
    """CTE ``name(key, pos, term)``: the standard analyzer, positions renumbered from the first survivor."""
    return (raw_tokens(f"{name}_r", source, key, text) + f", {name} AS (SELECT {key}, term, "
            f"min(pos) OVER (PARTITION BY {key}) + row_number() OVER (PARTITION BY {key} ORDER BY pos) - 1 AS pos "
            f"FROM {name}_r WHERE length(term) >= 2 AND term NOT IN ({STOP_SQL}))")


# postings p(doc_id, term, tf, doc_len), term statistics ts(term, df, cf), field statistics fs(n, total, avgl)
POSTINGS = std_tokens("tok", "documents") + (
    ", dl AS (SELECT doc_id, count(*) AS doc_len FROM tok GROUP BY doc_id)"
    ", p AS (SELECT doc_id, term, count(*) AS tf, any_value(doc_len) AS doc_len FROM tok JOIN dl USING (doc_id) GROUP BY doc_id, term)"
    ", ts AS (SELECT term, count(*) AS df, sum(tf)::DOUBLE AS cf, min(doc_len) AS min_len, max(doc_len) AS max_len,"
    " max(tf)::DOUBLE AS max_weight, min(doc_id) AS min_id, max(doc_id) AS max_id FROM p GROUP BY term)"
    ", fs AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT count(*) FROM tok)::DOUBLE AS total,"
    " (SELECT count(*) FROM tok)::DOUBLE / (SELECT count(*) FROM documents) AS avgl)")

IDF = "(ln(n / (df + 1)) + 1)"
BM25_SQL = f"{IDF} * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgl))"


def scored(expr: str = BM25_SQL, name: str = "sc") -> str:
    """CTE ``sc(doc_id, term, s, ...)``: every posting with its score."""
    return f"{POSTINGS}, {name} AS (SELECT p.*, ts.df, ts.cf, {expr} AS s FROM p JOIN ts USING (term), fs)"


# query terms of the benchmark table: qt(query_id, term)
QUERY_TERMS = std_tokens("qtok", "benchmark", "item_id") + ", qt AS (SELECT DISTINCT item_id AS query_id, term FROM qtok)"


def ascii(column: str) -> str:
    """SQL that gives every accented letter of the texts a letter of its own in one byte: the oracle's edit distances
    count bytes. Only for lower-case terms, as capitals are what it maps to."""
    return f"translate({column}, 'áâàçéèêëíîïñóôòöúûùüäßœ', 'ABCDEFGHIJKLMNOPQRSTUVW')"
