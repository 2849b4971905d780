"""Query clauses to hits.

A table of clauses has (query_id, clause_id, field, text[, boost]); its expansion is a table of *query terms*
(query_id, clause_id, field, term, boost). Hits are (query_id, clause_id, doc_id, score).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import osa_within
from ..functions.scoring import BM25, Model, Stats, frequency
from ..functions.spans import spans_of
from ..functions.tokens import Filter
from ..joins import lookup_join, measured
from ..session import settle
from . import lexkeys as K
from .index import SearchIndex, term_bucket

CLAUSE = ["query_id", "clause_id"]
# A term found in more than 1/HOT_SHARE of the documents is spread over several tasks. At most (mean distinct terms
# per document * HOT_SHARE) terms can be that frequent, so the list of them stays small.
HOT_SHARE = 50
# Hits that a task groups by query and document, so that its groups fit its memory however large the corpus is.
TASK_HITS = 1 << 20


def query_terms(queries: DataFrame, analyzer: Filter, field: str, text: str = "text", key: str = "query_id") -> DataFrame:
    """Analyze a column of query texts: one clause per distinct term of a query."""
    terms = F.array_distinct(F.transform(analyzer(F.col(text)), lambda t: t["term"]))
    return queries.select(F.col(key).alias("query_id"), F.posexplode(terms).alias("clause_id", "term")) \
        .select("query_id", "clause_id", F.lit(field).alias("field"), "term", F.lit(1.0).alias("boost"))


def _with_boost(clauses: DataFrame) -> DataFrame:
    return clauses if "boost" in clauses.columns else clauses.withColumn("boost", F.lit(1.0))


def hot_terms(index: SearchIndex) -> DataFrame:
    return (index.term_stats.select("field", "term", "df")
            .join(F.broadcast(index.field_stats.select("field", "n_docs")), "field")
            .filter(F.col("df") * HOT_SHARE > F.col("n_docs")).select("field", "term"))


def _asked(index: SearchIndex, terms: DataFrame) -> tuple[bool, DataFrame]:
    """Whether the query terms fit a broadcast, and the postings that can hold them: the job that measures them also returns their
    buckets and fields, which become a literal filter on the partitions to read. Terms too many to send to every task read all."""
    fits, row = measured(terms, F.collect_set(term_bucket(F.col("term"), index.buckets)).alias("buckets"), F.collect_set("field").alias("fields"))
    return fits, index.postings_of(row["buckets"], row["fields"]) if fits else index.postings_of(None)


def hit_tasks(index: SearchIndex, terms: DataFrame) -> int:
    """Tasks that deal the hits of all query terms out at ``TASK_HITS`` each: a term has one for each document and query. At least one for each core."""
    hits = lookup_join(index.term_stats.select("field", "term", "df"), terms.select("field", "term"), ["field", "term"]).agg(F.sum("df")).first()[0] or 0
    return max(index.spark.sparkContext.defaultParallelism, -(-hits // TASK_HITS))


def match(index: SearchIndex, terms: DataFrame, model: Model | None = None, keep: tuple[str, ...] = (), together: bool = False, tasks: int | None = None) -> DataFrame:
    """Score every posting of every query term.

    The statistics are joined to the (small) query terms, which then meet the postings in one join. The field table has
    one row per indexed field, a bound given by the schema.

    ``together`` shuffles the postings that any query asks for by document, before each is scored for all queries that ask for it: grouping
    hits by query and document then shuffles nothing, however many queries share a word. ``tasks`` says into how many tasks; by default
    that follows the size of the postings, not that of the hits.

    ``keep`` names columns of the postings to carry along; ``spans`` are their positions as spans.
    """
    model = model or BM25()
    terms = _with_boost(terms)
    fits, stored = _asked(index, terms)
    stats = index.term_stats.select("field", "term", "df", "cf")
    fields = F.broadcast(index.field_stats.select("field", "n_docs", "avg_len", "total_len", "scorable"))
    extra = [c for c in terms.columns if c not in (*CLAUSE, "field", "term", "boost")]
    postings = stored.select("field", "term", "doc_id", "weight", "doc_len", *(["positions"] if {"positions", "spans"} & {*keep} or _wants_positions(model) else []))
    if fits and together:
        asked = terms.select("field", "term").distinct()
        postings = postings.join(F.broadcast(asked), ["field", "term"], "left_semi")
        postings = postings.repartition(tasks, "doc_id") if tasks else postings.repartition("doc_id")
    if "spans" in keep:
        # Once for each posting, before it is dealt out to the queries.
        postings = postings.withColumn("spans", spans_of(F.col("positions")))
    if fits:
        # The join keeps at most one row per query term, so the measured bound also holds for its result.
        weighed = stats.join(F.broadcast(terms), ["field", "term"]).join(fields, "field")
        joined = postings.join(F.broadcast(weighed), ["field", "term"])
    else:
        weighed = stats.join(terms, ["field", "term"]).join(fields, "field")
        joined = lookup_join(postings, weighed, ["field", "term"], hot=hot_terms(index))
    s = Stats(tf=F.col("weight"), doc_len=F.col("doc_len"), df=F.col("df"), cf=F.col("cf"), n_docs=F.col("n_docs"),
              avg_len=F.col("avg_len"), total_len=F.col("total_len"), field=F.col("field"),
              positions=F.col("positions") if "positions" in postings.columns else F.lit(None))
    score = F.when(F.col("scorable"), model(s)).otherwise(frequency(s)) * F.col("boost")
    return joined.select(*CLAUSE, "doc_id", score.cast("double").alias("score"), *[c for c in keep], *[c for c in extra if c not in keep])


def _wants_positions(model: Model) -> bool:
    return bool(getattr(model, "needs_positions", False))


def constant_hits(index: SearchIndex, terms: DataFrame) -> DataFrame:
    """Documents holding any of a clause's terms, scored by the clause's boost.

    The expansion is settled first: it is measured and then used, and should be computed once.
    """
    return _constant_hits(index, settle(_with_boost(terms)))


def _constant_hits(index: SearchIndex, terms: DataFrame, tasks: int | None = None) -> DataFrame:
    """:func:`constant_hits` of settled terms, all of a document in one place: no grouping by document shuffles them again."""
    def deal(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "doc_id") if tasks else rows.repartition("doc_id")

    fits, stored = _asked(index, terms)
    postings = stored.select("field", "term", "doc_id")
    if fits:
        # By document before the clauses are dealt out.
        asked = terms.select("field", "term").distinct()
        joined = deal(postings.join(F.broadcast(asked), ["field", "term"], "left_semi")).join(F.broadcast(terms), ["field", "term"])
    else:
        joined = deal(lookup_join(postings, terms, ["field", "term"], hot=hot_terms(index)).select(*CLAUSE, "doc_id", "boost"))
    return joined \
        .groupBy(*CLAUSE, "doc_id").agg(F.max("boost").alias("score"))


def _shared_tasks(index: SearchIndex, terms: DataFrame, whose: DataFrame) -> int:
    """Tasks for hits of lookups that several clauses share: each has at most a hit for each document, and for each of its clauses."""
    found = lookup_join(index.term_stats.select("field", "term", "df"), terms.select("field", "term", F.col("query_id").alias("_asked")), ["field", "term"])
    docs = found.groupBy("_asked").agg(F.sum("df").alias("df"))
    shared = whose.groupBy("_asked").agg(F.count(F.lit(1)).alias("n"))
    most = index.field_stats.agg(F.max("n_docs").alias("n_docs"))
    hits = lookup_join(docs, shared, ["_asked"]).join(F.broadcast(most)).agg(F.sum(F.least("df", "n_docs") * F.col("n"))).first()[0] or 0
    return max(index.spark.sparkContext.defaultParallelism, -(-hits // TASK_HITS))


def q_term(index: SearchIndex, clauses: DataFrame, model: Model | None = None) -> DataFrame:
    return match(index, clauses.withColumnRenamed("text", "term"), model)


# ---- clauses that stand for several terms -------------------------------------------------------------------------

def _by_grams(index: SearchIndex, clauses: DataFrame, shape: Column, test: Column, place: Column | None = None) -> DataFrame:
    """Patterns to terms: each distinct pattern meets the terms of the rarest thing it asks for, and ``test`` decides. A pattern that asks for
    what no term has, has no terms; one that asks for nothing meets all of them, one key for each three first letters.
    """
    clauses = _with_boost(clauses)
    asked = settle(clauses.select("field", "text").distinct().withColumn("_keys", K.asked_keys(shape, place)))
    wanted = asked.select("field", "text", F.size("_keys").alias("_need"), F.explode("_keys").alias("key"))
    known = lookup_join(K.gram_keys(index.gram_stats), wanted, ["field", "key"])
    each = known.groupBy("field", "text", "key", "_need").agg(F.sum("n").alias("n"), F.collect_list("gram").alias("grams"))
    rarest = each.groupBy("field", "text", "_need").agg(F.min_by("grams", F.struct("n", "key")).alias("grams"), F.count(F.lit(1)).alias("_n")).filter("_n = _need")
    chosen = settle(rarest.select("field", "text", F.explode("grams").alias("gram")))
    hot = index.gram_stats.join(F.broadcast(index.term_counts), "field").filter(F.col("n") * HOT_SHARE > F.col("n_terms")).select("field", "gram")
    pairs = lookup_join(index.grams, chosen, ["field", "gram"], hot=hot).filter(test).select("field", "text", "term").distinct()
    return lookup_join(pairs, clauses, ["field", "text"]).select(*CLAUSE, "field", "term", "boost")


def expand_prefix(index: SearchIndex, clauses: DataFrame) -> DataFrame:
    return _by_grams(index, clauses, K.prefix_shape(F.col("text")), F.col("term").startswith(F.col("text")))


def glob_regex(glob: Column) -> Column:
    """A glob as an anchored regular expression: ``*``, ``?`` and ``[...]``; everything else is literal."""
    quoted = F.regexp_replace(glob, r"([.\\+(){}|^$])", r"\\$1")
    body = F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", ".")
    return F.concat(F.lit("^(?s:"), F.regexp_replace(body, r"\[!", "[^"), F.lit(")$"))


def expand_wildcard(index: SearchIndex, clauses: DataFrame) -> DataFrame:
    glob = F.col("text")
    return _by_grams(index, clauses, K.glob_shape(glob), F.regexp_like(F.col("term"), glob_regex(glob)), K.glob_place(glob))


def expand_regex(index: SearchIndex, clauses: DataFrame) -> DataFrame:
    """Anchored at the start only."""
    anchored = F.concat(F.lit("^(?:"), F.col("text"), F.lit(")"))
    return _by_grams(index, clauses, K.regex_shape(F.col("text")), F.regexp_like(F.col("term"), anchored))


def expand_range(index: SearchIndex, clauses: DataFrame) -> DataFrame:
    """Lexical ranges: clauses have ``start``, ``end`` (null = open), ``startexcl``, ``endexcl``.

    A range is spread over the first letters it can hold (a list bounded by the alphabet), then joined on the letter.
    """
    letters = F.broadcast(index.lexicon.select(F.substring("term", 1, 1).alias("_key")).distinct())
    first = F.col("start").isNull() | (F.col("_key") >= F.substring("start", 1, 1))
    last = F.col("end").isNull() | (F.col("_key") <= F.substring("end", 1, 1))
    keyed = _with_boost(clauses).join(letters, first & last)
    low = F.col("start").isNull() | F.when(F.col("startexcl"), F.col("term") > F.col("start")).otherwise(F.col("term") >= F.col("start"))
    high = F.col("end").isNull() | F.when(F.col("endexcl"), F.col("term") < F.col("end")).otherwise(F.col("term") <= F.col("end"))
    terms = index.lexicon.withColumn("_key", F.substring("term", 1, 1))
    return lookup_join(terms, keyed, ["field", "_key"]).filter(low & high).select(*CLAUSE, "field", "term", "boost")


def within_distance(words: DataFrame, terms: DataFrame, maxdist: int, prefix: int = 0, keys: DataFrame | None = None) -> DataFrame:
    """(words x terms) pairs within ``maxdist`` (optimal string alignment), found by equality joins only.

    ``words`` has (field, text), ``terms`` has (field, term). Words of any length meet by what deletions leave of their heads, which misses no
    pair (see :mod:`.lexkeys`). ``keys`` are the terms' stored keys (field, key, term); they serve up to CLOSE_EDITS edits, and
    beyond that, or without them, the same keys are made here.
    """
    probe = words.select("field", "text").distinct()
    made = keys if keys is not None and maxdist <= K.CLOSE_EDITS else K.close_keys(terms.select("field", "term"), maxdist)
    # Keys made for more edits than asked: those with more letters gone are of no use.
    gone = F.least(F.length("term"), F.lit(K.HEAD)) - F.length("key")
    asked = probe.withColumn("key", F.explode(K.close_strings(F.col("text"), maxdist)))
    close = (F.abs(F.length("term") - F.length("text")) <= maxdist) & (F.substring("term", 1, prefix) == F.substring("text", 1, prefix))
    met = lookup_join(made.filter(gone <= maxdist), asked, ["field", "key"]).filter(close)
    # A swap counts as two edits of the plain distance, which sorts most pairs out before any leaves the JVM.
    likely = met.filter(F.levenshtein("text", "term", 2 * maxdist) >= 0)
    near = likely.select("field", "text", "term", osa_within(maxdist)("text", "term").alias("distance")).filter(F.col("distance") <= maxdist)
    return near.distinct()


def expand_fuzzy(index: SearchIndex, clauses: DataFrame, maxdist: int = 1, prefixlength: int = 1) -> DataFrame:
    pairs = within_distance(clauses, index.lexicon, maxdist, prefixlength, index.close_keys)
    return lookup_join(pairs, _with_boost(clauses), ["field", "text"]).select(*CLAUSE, "field", "term", "boost")


def _each_once(index: SearchIndex, clauses: DataFrame, expand: Callable[[SearchIndex, DataFrame], DataFrame], on: tuple[str, ...] = ("field", "text")) -> DataFrame:
    """Hits of clauses that stand for several terms: clauses equal in ``on`` are looked up once, whichever queries they belong to."""
    clauses = _with_boost(clauses)
    asked = settle(clauses.select(*on).distinct().withColumn("query_id", F.monotonically_increasing_id()))
    terms = settle(expand(index, asked.withColumn("clause_id", F.lit(0))))
    # An open end of a range is null, and equal to itself.
    same = reduce(and_, [F.col(f"c.{x}").eqNullSafe(F.col(f"a.{x}")) for x in on])
    whose = clauses.alias("c").join(asked.withColumnRenamed("query_id", "_asked").alias("a"), same).select(*[f"c.{x}" for x in CLAUSE], "_asked", F.col("c.boost").alias("score"))
    hits = _constant_hits(index, terms, _shared_tasks(index, terms, whose)).select(F.col("query_id").alias("_asked"), "doc_id")
    return lookup_join(hits, whose, ["_asked"]).select(*CLAUSE, "doc_id", "score")


def q_prefix(index: SearchIndex, clauses: DataFrame) -> DataFrame:
    return _each_once(index, clauses, expand_prefix)


def q_wildcard(index: SearchIndex, clauses: DataFrame) -> DataFrame:
    return _each_once(index, clauses, expand_wildcard)


def q_regex(index: SearchIndex, clauses: DataFrame) -> DataFrame:
    return _each_once(index, clauses, expand_regex)


def q_fuzzy(index: SearchIndex, clauses: DataFrame, maxdist: int = 1, prefixlength: int = 1) -> DataFrame:
    return _each_once(index, clauses, lambda i, c: expand_fuzzy(i, c, maxdist, prefixlength))


def q_term_range(index: SearchIndex, clauses: DataFrame) -> DataFrame:
    return _each_once(index, clauses, expand_range, ("field", "start", "end", "startexcl", "endexcl"))


def q_every(index: SearchIndex, field: str | None = None, boost: float = 1.0) -> DataFrame:
    """All documents, or those with any term in ``field``."""
    docs = index.doc_ids if field is None else index.forward.filter((F.col("field") == field) & (F.size("terms") > 0)).select("doc_id")
    return docs.withColumn("score", F.lit(float(boost)))


def q_null(index: SearchIndex) -> DataFrame:
    return q_every(index).filter(F.lit(False))


def q_constant(hits: DataFrame, score: float) -> DataFrame:
    return hits.withColumn("score", F.lit(float(score)))


# ---- typed columns ------------------------------------------------------------------------------------------------

def in_range(value: Column, lo: Column | None, hi: Column | None, lo_open: bool = False, hi_open: bool = False) -> Column:
    """A range test the scan can push down; a missing end is open."""
    test = value.isNotNull()
    if lo is not None:
        test = test & ((value > lo) if lo_open else (value >= lo))
    if hi is not None:
        test = test & ((value < hi) if hi_open else (value <= hi))
    return test


def q_numeric_range(table: DataFrame, column: str, lo=None, hi=None, lo_open: bool = False, hi_open: bool = False,
                    boost: float = 1.0) -> DataFrame:
    bound = lambda v: None if v is None else F.lit(v)
    return table.filter(in_range(F.col(column), bound(lo), bound(hi), lo_open, hi_open)).withColumn("score", F.lit(float(boost)))


q_date_range = q_numeric_range

# The words that mean true.
TRUE_WORDS = ("t", "true", "yes", "1")


def q_boolean(table: DataFrame, column: str) -> DataFrame:
    return table.filter(F.lower(F.col(column).cast("string")).isin(*TRUE_WORDS))


def q_comparison(table: DataFrame, column: str, op: str, value) -> DataFrame:
    c = F.col(column)
    tests = {">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value, "=": c == value}
    return table.filter(tests[op])


# ---- query terms against the lexicon ------------------------------------------------------------------------------

def existing_terms(index: SearchIndex, terms: DataFrame, reverse: bool = False) -> DataFrame:
    """Query terms that are (or, reversed, are not) in the lexicon.

    The lexicon is cut down to the wanted terms first, so the result of that join is no larger than the query terms.
    """
    wanted = terms.select("field", "term").distinct()
    found = lookup_join(index.lexicon, wanted, ["field", "term"])
    return terms.join(found, ["field", "term"], "left_anti" if reverse else "left_semi")


def estimate_hits(index: SearchIndex, terms: DataFrame) -> DataFrame:
    """Upper bounds per query: a term gives its df, OR the sum (at most the corpus), AND the least."""
    found = terms.join(lookup_join(index.term_stats.select("field", "term", "df"), terms.select("field", "term").distinct(),
                                   ["field", "term"]), ["field", "term"], "left")
    df = F.coalesce(F.col("df"), F.lit(0))
    total = index.field_stats.agg(F.max("n_docs").alias("n_docs"))
    return (found.groupBy("query_id").agg(F.sum(df).alias("sum_df"), F.min(df).alias("and_estimate"))
            .join(F.broadcast(total)).select("query_id", F.least("sum_df", "n_docs").alias("or_estimate"), "and_estimate"))


def q_field_alias(terms: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Clauses on an alias go to the real field."""
    real = F.col("field")
    for alias, name in aliases.items():
        real = F.when(F.col("field") == alias, F.lit(name)).otherwise(real)
    return terms.withColumn("field", real)


def q_copy_field(terms: DataFrame, copies: dict[str, str], mirror: bool = False) -> DataFrame:
    """Clauses on one field are also asked of another; the copies keep the clause id, so they OR inside the clause."""
    pairs = list(copies.items()) + ([(b, a) for a, b in copies.items()] if mirror else [])
    extra = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in pairs])
    targets = F.transform(F.filter(extra, lambda p: p["source"] == F.col("field")), lambda p: p["target"])
    return terms.withColumn("field", F.explode(F.concat(F.array("field"), targets)))
