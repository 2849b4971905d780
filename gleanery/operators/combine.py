"""Boolean algebra over hit tables.

Hits are (query_id, doc_id, score). Several inputs are unioned with an input number and grouped once by
(query_id, doc_id), so n clauses cost one shuffle, and partial sums shrink it before it happens.

A negation stays symbolic (:class:`Negated`) as an operand of :func:`h_and`, :func:`h_or`, :func:`h_and_maybe` and :func:`h_boolean`;
the documents it stands for are listed only by :func:`h_listed`, where it is what the whole query comes to.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import best_per_group, fits_broadcast, lookup_join

KEY = ["query_id", "doc_id"]
# Places of the roles "+" and "-" among strings, see :func:`h_dismax_fields`.
REQUIRED, BANNED = 1, 3


def _stack(inputs: Sequence[DataFrame], base: int = 0) -> DataFrame:
    parts = [d.select(*KEY, "score", F.lit(base + i).alias("_in")) for i, d in enumerate(inputs)]
    return reduce(DataFrame.union, parts)


def clause_counts(terms: DataFrame) -> DataFrame:
    """Query terms with the number of clauses their query has, to carry along to :func:`all_of`."""
    n = terms.groupBy("query_id").agg(F.count_distinct("clause_id").alias("n_clauses"))
    return lookup_join(terms, n, ["query_id"])


def all_of(hits: DataFrame) -> DataFrame:
    """AND inside one hit table that has ``clause_id`` and carries ``n_clauses``."""
    return (_per_clause(hits, "n_clauses").groupBy(*KEY)
            .agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("_n"), F.max("n_clauses").alias("_need"))
            .filter(F.col("_n") == F.col("_need")).drop("_n", "_need"))


def any_of(hits: DataFrame, minmatch: int = 1) -> DataFrame:
    """OR inside one hit table; with ``minmatch`` at least that many clauses must hit."""
    if minmatch <= 1:
        return hits.groupBy(*KEY).agg(F.sum("score").alias("score"))
    return (_per_clause(hits).groupBy(*KEY).agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") >= minmatch).drop("_n"))


def _per_clause(hits: DataFrame, *carry: str) -> DataFrame:
    """One row per clause and document (a clause may stand for several terms). Hits that :func:`.clauses.match` holds ``together`` by document are not shuffled."""
    return hits.groupBy(*KEY, "clause_id").agg(F.sum("score").alias("score"), *[F.max(c).alias(c) for c in carry])


@dataclass(frozen=True)
class Negated:
    """All documents of every query but the ``excluded`` ones, each with ``score``; ``extra`` adds to the score of some that are left
    (a document may have several rows there, and none that is excluded has any)."""

    excluded: DataFrame
    score: float = 1.0
    extra: DataFrame | None = None


Operand = DataFrame | Negated


def negate(operand: Operand, score: float = 1.0) -> Operand:
    """What an operand does not hit; a negation of a negation is plain hits again."""
    if isinstance(operand, Negated):
        return operand.excluded.select(*KEY).distinct().withColumn("score", F.lit(float(score)))
    return Negated(operand.select(*KEY), float(score))


def _split(operands: Sequence[Operand]) -> tuple[list[DataFrame], list[Negated]]:
    return [o for o in operands if not isinstance(o, Negated)], [o for o in operands if isinstance(o, Negated)]


def _changes(operands: Sequence[Operand]) -> DataFrame:
    """What each operand changes against a document that only the negated ones hit: score and number of operands that hit."""
    rows = []
    for o in operands:
        if not isinstance(o, Negated):
            rows.append(o.select(*KEY, F.col("score").cast("double").alias("score"), F.lit(1).alias("_hit")))
            continue
        rows.append(o.excluded.select(*KEY).distinct().select(*KEY, F.lit(-o.score).alias("score"), F.lit(-1).alias("_hit")))
        if o.extra is not None:
            rows.append(o.extra.select(*KEY, "score", F.lit(0).alias("_hit")))
    return reduce(DataFrame.union, rows)


def _and_negated(plain: Sequence[DataFrame], negated: Sequence[Negated]) -> Operand:
    """One anti-join with everything excluded; with no plain operand the result is a negation again."""
    excluded, total = reduce(DataFrame.union, [n.excluded.select(*KEY) for n in negated]), sum(n.score for n in negated)
    extras = [n.extra.select(*KEY, "score") for n in negated if n.extra is not None]
    extra = reduce(DataFrame.union, extras) if extras else None
    if not plain:
        return Negated(excluded, total, None if extra is None else h_mask(extra, excluded))
    hits = h_mask(h_and(*plain), excluded).withColumn("score", F.col("score") + F.lit(total))
    return hits if extra is None else h_and_maybe(hits, extra)


def _or_negated(operands: Sequence[Operand], minmatch: int) -> Operand:
    """At least ``minmatch`` operands; a negation where the negated ones alone are enough."""
    negated = _split(operands)[1]
    total = sum(n.score for n in negated)
    docs = _changes(operands).groupBy(*KEY).agg(F.sum("score").alias("score"), (F.sum("_hit") + len(negated)).alias("_n"))
    enough = F.col("_n") >= minmatch
    if len(negated) < minmatch:
        return docs.filter(enough).select(*KEY, (F.col("score") + F.lit(total)).alias("score"))
    return Negated(docs.filter(~enough).select(*KEY), total, docs.filter(enough).select(*KEY, "score"))


def _maybe_negated(a: Operand, b: Operand) -> Operand:
    """a's documents with b's score added where b hits, for operands that may be negated."""
    added = _changes([b]).select(*KEY, "score")
    plus = b.score if isinstance(b, Negated) else 0.0
    if not isinstance(a, Negated):
        return h_and_maybe(a.withColumn("score", F.col("score") + F.lit(plus)), added)
    extra = added if a.extra is None else added.union(a.extra.select(*KEY, "score"))
    return Negated(a.excluded, a.score + plus, h_mask(extra, a.excluded))


def h_listed(doc_ids: DataFrame, operand: Operand, queries: DataFrame) -> DataFrame:
    """Hits of a whole query: a negation is listed against the corpus, for each of ``queries``; plain hits stay as they are."""
    if not isinstance(operand, Negated):
        return operand
    if len(queries.columns) != 1:
        queries = queries.select("query_id")
    queries = queries.distinct()
    if fits_broadcast(queries):
        # Each document's row takes its own excluded queries off the list of all, so pairs are made where they are written and only what is excluded is shuffled.
        # A query without an id excludes nothing.
        every = queries.agg(F.collect_list("query_id").alias("_every"), F.filter(F.array(F.max(F.when(F.col("query_id").isNull(), True))), lambda x: x).alias("_nameless"))
        gone = operand.excluded.groupBy("doc_id").agg(F.collect_set("query_id").alias("_gone"))
        kind = gone.schema["_gone"].dataType
        nameless = F.transform("_nameless", lambda x: F.lit(None).cast(kind.elementType))
        remaining = F.concat(F.array_except(F.col("_every").cast(kind), F.coalesce("_gone", F.array().cast(kind))), nameless)
        left = doc_ids.join(gone, "doc_id", "left").join(F.broadcast(every)).select(F.explode(remaining).alias("query_id"), "doc_id", F.lit(operand.score).alias("score"))
        return left if operand.extra is None else h_and_maybe(left, operand.extra)
    docs, asked = doc_ids.withColumn("_all", F.lit(1)), queries.withColumn("_all", F.lit(1))
    pairs = lookup_join(docs, asked, ["_all"], hot=doc_ids.sparkSession.range(1, 2).select(F.col("id").cast("int").alias("_all"))).drop("_all")
    left = pairs.join(operand.excluded.select(*KEY), KEY, "left_anti").select(*KEY, F.lit(operand.score).alias("score"))
    return left if operand.extra is None else h_and_maybe(left, operand.extra)


def h_and(*inputs: Operand) -> Operand:
    plain, negated = _split(inputs)
    if negated:
        return _and_negated(plain, negated)
    return (_stack(inputs).groupBy(*KEY).agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") == len(inputs)).drop("_n"))


def h_or(*inputs: Operand, minmatch: int = 1) -> Operand:
    if _split(inputs)[1]:
        return _or_negated(inputs, max(minmatch, 1))
    return (_stack(inputs).groupBy(*KEY).agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") >= max(minmatch, 1)).drop("_n"))


def dismax(score: Column, tiebreak: float) -> Column:
    best = F.max(score)
    return best + F.lit(float(tiebreak)) * (F.sum(score) - best)


def h_dismax(*inputs: DataFrame, tiebreak: float = 0.0) -> DataFrame:
    return _stack(inputs).groupBy(*KEY).agg(dismax(F.col("score"), tiebreak).alias("score"))


def h_not(doc_ids: DataFrame, hits: DataFrame, queries: DataFrame) -> DataFrame:
    """The complement per query, score 1.0. ``queries`` is the list of query ids, each of which needs the whole corpus; inside a larger
    query use :func:`negate`, which lists nothing."""
    return h_listed(doc_ids, negate(hits), queries)


def h_and_not(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY, "score").join(b.select(*KEY), KEY, "left_anti")


def h_and_maybe(a: Operand, b: Operand) -> Operand:
    """a's documents; b's score is added where b hits."""
    if _split([a, b])[1]:
        return _maybe_negated(a, b)
    return (_stack([a, b]).groupBy(*KEY).agg(F.sum("score").alias("score"), F.min("_in").alias("_in"))
            .filter("_in = 0").drop("_in"))


def h_require(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY, "score").join(b.select(*KEY), KEY, "left_semi")


def h_otherwise(a: DataFrame, b: DataFrame) -> DataFrame:
    """b only for the queries where a has no hit at all in the whole corpus."""
    answered = a.select("query_id").distinct()
    return a.select(*KEY, "score").union(lookup_join(b.select(*KEY, "score"), answered, ["query_id"], "left_anti").select(*KEY, "score"))


def h_boolean(required: Sequence[Operand] = (), should: Sequence[Operand] = (), prohibited: Sequence[Operand] = ()) -> Operand:
    """All required, none prohibited, optional ones add score; with nothing required at least one optional must hit."""
    if _split([*required, *should, *prohibited])[1]:
        out = h_and(*required) if required else h_or(*should)
        for o in should if required else ():
            out = h_and_maybe(out, o)
        return h_and(out, *[negate(o, 0.0) for o in prohibited]) if prohibited else out
    base = len(required)
    rows = _stack([*required, *should, *prohibited])
    need, ban = F.col("_in") < base, F.col("_in") >= base + len(should)
    out = rows.groupBy(*KEY).agg(
        F.sum(F.when(~ban, F.col("score"))).alias("score"), F.count(F.when(need, 1)).alias("_need"),
        F.count(F.when(~need & ~ban, 1)).alias("_opt"), F.count(F.when(ban, 1)).alias("_ban"))
    keep = (F.col("_need") == base) & (F.col("_ban") == 0)
    if not required:
        keep = keep & (F.col("_opt") > 0)
    return out.filter(keep).select(*KEY, "score")


def over_fields(words: DataFrame, boosts: dict[str, float]) -> DataFrame:
    """Each query word asked of every field with the field's boost; the word stays one clause."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(b)).alias("boost")) for f, b in boosts.items()])
    return words.drop("field", "boost").withColumn("_f", F.explode(fields)) \
        .select(*[c for c in words.columns if c not in ("field", "boost")], "_f.field", "_f.boost")


def h_multifield(hits: DataFrame) -> DataFrame:
    """Words AND-ed, each OR-ed over its fields (``hits`` has clause_id per word and n_clauses)."""
    return all_of(hits)


def h_dismax_fields(hits: DataFrame, tiebreak: float = 0.0, role: str = "role") -> DataFrame:
    """Best field per word (dis-max), then required ``+``, banned ``-`` and optional words per document.

    ``hits`` carries ``role`` per word and, per query, ``n_required``.
    """
    # A role goes by its place among roles: a group of numbers is hashed, one of strings would be sorted.
    r = F.col(role)
    place = F.when(r < "+", 0).when(r == "+", REQUIRED).when(r < "-", 2).when(r == "-", BANNED).when(r > "-", 4)
    words = hits.groupBy(*KEY, "clause_id").agg(
        dismax(F.col("score"), tiebreak).alias("score"), F.max(place).alias("_role"), F.max("n_required").alias("n_required"))
    r = F.col("_role")
    out = words.groupBy(*KEY).agg(
        F.sum(F.when(r != BANNED, F.col("score"))).alias("score"), F.count(F.when(r == REQUIRED, 1)).alias("_req"),
        F.count(F.when(r == BANNED, 1)).alias("_ban"), F.max("n_required").alias("_need"))
    return out.filter((F.col("_ban") == 0) & (F.col("_req") == F.col("_need")) & F.col("score").isNotNull()).select(*KEY, "score")


# ---- parents and children -----------------------------------------------------------------------------------------

def h_nested_parent(child_hits: DataFrame, children: DataFrame, limit: int | None = None,
                    combine: Column | None = None) -> DataFrame:
    """Child hits roll up to their parent: the first ``limit`` hit children in document order count.

    ``children`` maps doc_id to parent_id. ``combine`` is an aggregate over ``score`` (default: the sum).
    """
    hits = child_hits.join(children.select("doc_id", "parent_id"), "doc_id")
    if limit is not None:
        hits = best_per_group(hits, ["query_id", "parent_id"], [F.col("doc_id")], limit)
    return hits.groupBy("query_id", F.col("parent_id").alias("doc_id")).agg((combine if combine is not None else F.sum("score")).alias("score"))


def h_nested_children(parent_hits: DataFrame, children: DataFrame, boost: float = 1.0) -> DataFrame:
    parents = parent_hits.select("query_id", F.col("doc_id").alias("parent_id"))
    return children.select("doc_id", "parent_id").join(parents, "parent_id").select(*KEY, F.lit(float(boost)).alias("score"))


def h_nested_delete(hits: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """Ids to delete: any hit parent or child takes the parent and all its children along."""
    pairs = children.select("doc_id", "parent_id")
    ids = hits.select("doc_id").distinct()
    touched = (pairs.join(ids, "doc_id", "left_semi").select("parent_id")
               .union(parents.select("parent_id").join(ids.withColumnRenamed("doc_id", "parent_id"), "parent_id", "left_semi"))).distinct()
    kids = pairs.join(touched, "parent_id", "left_semi").select(F.lit("child").alias("kind"), "doc_id")
    return touched.select(F.lit("parent").alias("kind"), F.col("parent_id").alias("doc_id")).union(kids)


# ---- result algebra: hits with a rank -------------------------------------------------------------------------------

def h_filter(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    on = [c for c in KEY if c in allowed.columns]
    return hits.join(allowed.select(*on), on, "left_semi").select(*hits.columns)


def h_mask(hits: DataFrame, banned: DataFrame) -> DataFrame:
    on = [c for c in KEY if c in banned.columns]
    return hits.join(banned.select(*on), on, "left_anti").select(*hits.columns)


def filtered_count(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """How many hits per query a filter drops."""
    return h_mask(hits, allowed).groupBy("query_id").agg(F.count(F.lit(1)).alias("filtered"))
