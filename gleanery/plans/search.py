"""Ranked search for a table of query texts, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scoring import Model
from ..functions.tokens import Filter, an_standard
from ..operators.clauses import match, query_terms
from ..operators.combine import all_of, any_of, clause_counts
from ..operators.index import SearchIndex
from ..operators.ranking import top_k


def search(index: SearchIndex, queries: DataFrame, field: str = "text", k: int = 10, mode: str = "or",
           model: Model | None = None, analyzer: Filter | None = None, text: str = "text", key: str = "query_id") -> DataFrame:
    """(query_id, rank, doc_id, score): analyze the queries, score their postings, combine, keep the best ``k``."""
    terms = query_terms(queries, analyzer or an_standard(), field, text, key)
    if mode == "and":
        hits = all_of(match(index, clause_counts(terms), model))
    else:
        hits = any_of(match(index, terms, model))
    return top_k(hits, k).select("query_id", "rank", "doc_id", "score")


def with_stored(index: SearchIndex, hits: DataFrame, *columns: str) -> DataFrame:
    """Join the hits (few per query) back to stored corpus columns."""
    return hits.join(index.corpus.select("doc_id", *columns), "doc_id")
