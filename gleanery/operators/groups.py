"""Query words that analyze into several tokens: each word is a group of clauses, put together by its own rule before the words are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import Model
from ..functions.tokens import Filter
from ..session import settle
from .clauses import hit_tasks, match
from .index import SearchIndex
from .phrases import s_phrase

RULES = ("first", "and", "or", "phrase", "default")
WORD = ["query_id", "clause_id"]


def word_tokens(queries: DataFrame, analyzer: Filter, field: str, rule: str = "default", word: str = r"[^ \t\r\n]+", text: str = "text", key: str = "query_id") -> DataFrame:
    """The blank-separated words of query texts and the tokens each gives: (query_id, clause_id: the word's place, field, words: its tokens, rule, boost).
    A word without tokens drops out."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"({word})"), F.lit(1))
    each = queries.select(F.col(key).alias("query_id"), F.posexplode(pieces).alias("clause_id", "_word"))
    return each.select("query_id", "clause_id", F.lit(field).alias("field"), F.transform(analyzer(F.col("_word")), lambda t: t["term"]).alias("words"), F.lit(rule).alias("rule"), F.lit(1.0).alias("boost")) \
        .filter(F.size("words") > 0)


def q_multitoken(index: SearchIndex, words: DataFrame, group: str = "and", model: Model | None = None) -> DataFrame:
    """Hits (query_id, clause_id, doc_id, score) of each query word by its rule.

    ``first`` looks for the word's first token only, ``and`` for all, ``or`` for any, ``phrase`` for all in adjacent places in order, ``default``
    does what the queries do with their words (``group``: and / or). Rules may differ from row to row. A word of one token is that
    term under any rule. A token that a word holds twice counts twice.
    """
    rule = F.when(F.col("rule") == "default", F.lit(group)).otherwise(F.col("rule"))
    told = words.withColumn("rule", F.when(F.size("words") == 1, F.lit("or")).otherwise(rule))
    tokens = told.filter("rule <> 'phrase'").withColumn("words", F.when(F.col("rule") == "first", F.slice("words", 1, 1)).otherwise(F.col("words")))
    need = F.when(F.col("rule") == "and", F.size("words")).otherwise(F.lit(1))
    # Equal tokens of a word are one term with a weight, so that a document brings at most one row for each.
    terms = tokens.select(*WORD, "field", "boost", need.alias("need"), F.explode("words").alias("term")).groupBy(*WORD, "field", "term", "boost", "need").agg(F.count(F.lit(1)).alias("times"))
    terms = settle(terms.withColumn("boost", F.col("boost") * F.col("times")))
    # A document's hits stay in the task that holds its postings, in tasks enough that no task's groups outgrow its memory.
    hits = match(index, terms, model, together=True, tasks=hit_tasks(index, terms))
    loose = hits.groupBy(*WORD, "doc_id").agg(F.sum("score").alias("score"), F.sum("times").alias("_held"), F.max("need").alias("_need")) \
        .filter("_held >= _need").select(*WORD, "doc_id", "score")
    # Without phrases there is nothing to add, and hits that are not put beside others can be grouped on without a shuffle.
    if not told.agg(F.bool_or(F.col("rule") == "phrase")).first()[0]:
        return loose
    strict = told.filter("rule = 'phrase'").select(F.struct(*WORD).alias("query_id"), "field", "words", "boost")
    return loose.unionByName(s_phrase(index, strict, model).select("query_id.*", "doc_id", "score"))
