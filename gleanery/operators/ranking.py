"""Order, top-k, paging and the algebra of ranked results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sortkeys import missing_aware, natural_key
from ..joins import best_per_group, lookup_join, wide_rank

def by_score() -> list[Column]:
    """Best first, ties to the lower doc id. Sums of doubles depend on the order of addition, which a shuffle does not fix,
    so scores equal to nine decimals count as tied; ranks are then the same in every run."""
    return [F.round("score", 9).desc(), F.col("doc_id").asc()]


def top_k(hits: DataFrame, k: int = 10, order: Sequence[Column] | None = None) -> DataFrame:
    """Best ``k`` per query, ties to the lower doc id, with ``rank``. Tasks drop all but their own best ``k`` before
    the shuffle, so a query that hits a third of the corpus still sends ``k`` rows per task."""
    return best_per_group(hits, ["query_id"], order or by_score(), k, "rank")


def rank_all(hits: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """Every hit with its rank, for result sets of any size."""
    return wide_rank(hits, ["query_id"], order or by_score())


def all_hits(hits: DataFrame, reverse: bool = False) -> DataFrame:
    """Every hit with its rank inside its query; ``reverse`` flips both keys."""
    return rank_all(hits, [F.round("score", 9).asc(), F.desc("doc_id")] if reverse else None)


# The sorts add a row's ``place``: a number holds in any later step, the order of a DataFrame's rows does not. Places are counted by
# ranges of the order, inside the groups ``by`` if there are any.

def sort_by_field(rows: DataFrame, column: str, reverse: bool = False, key: str = "doc_id", by: Sequence[str] = ()) -> DataFrame:
    return sort_multi(rows, [(column, reverse)], key, by)


def sort_multi(rows: DataFrame, columns: Sequence[tuple[str, bool]], key: str = "doc_id", by: Sequence[str] = ()) -> DataFrame:
    keys: list[Column] = []
    for column, reverse in columns:
        keys += missing_aware(rows, column, reverse)
    return wide_rank(rows, by, [*keys, F.col(key).asc()], "place")


def sort_by_score_within(rows: DataFrame, column: str, by: Sequence[str] = ("query_id",)) -> DataFrame:
    return wide_rank(rows, by, [F.col(column).asc_nulls_last(), *by_score()], "place")


def sort_by_function(rows: DataFrame, expr: Column, key: str = "doc_id", by: Sequence[str] = ()) -> DataFrame:
    return wide_rank(rows, by, [expr.asc(), F.col(key).asc()], "place")


def sort_natural(rows: DataFrame, column: str, key: str = "doc_id", by: Sequence[str] = ()) -> DataFrame:
    return wide_rank(rows, by, [natural_key(F.col(column)).asc(), F.col(key).asc()], "place")


def total_hits(hits: DataFrame) -> DataFrame:
    """All matches per query regardless of any limit."""
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))


def page(hits: DataFrame, pagenum: int, pagelen: int = 10, order: Sequence[Column] | None = None, strict: bool = True) -> DataFrame:
    """Ranks (p-1)*len+1 .. p*len with ``total`` and ``pagecount``.

    Asking beyond a query's last page is an error; unless ``strict``, such a query has no rows in the result.
    """
    if pagenum < 1:
        raise ValueError("pages count from 1")
    last = pagenum * pagelen
    ranked = top_k(hits, last, order)
    counted = lookup_join(ranked, total_hits(hits), ["query_id"]) \
        .withColumn("pagecount", F.ceil(F.col("total") / pagelen).cast("long"))
    if not strict:
        return counted.withColumn("rank", F.col("rank").cast("long")).filter(F.col("rank") > last - pagelen)
    beyond = F.col("pagecount") < pagenum
    checked = F.when(beyond, F.raise_error(F.concat(F.lit("no such page for query "), F.col("query_id").cast("string"))).cast("long")) \
        .otherwise(F.col("rank").cast("long"))
    return counted.withColumn("rank", checked).filter(F.col("rank") > last - pagelen)


# ---- ranked results: (query_id, doc_id, score, rank) -----------------------------------------------------------------

RANKED = ["query_id", "doc_id", "score", "rank"]


def r_extend(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, then those of b not in a, in b's order."""
    extra = b.join(a.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    rows = a.select(*RANKED, F.lit(0).alias("_from")).union(extra.select(*RANKED, F.lit(1).alias("_from")))
    return _rerank(rows, [F.col("_from"), F.col("rank")])


def r_filter(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's hits that are also in b, in a's order; a query for which b is empty keeps all of a."""
    keys = b.select("query_id", "doc_id").withColumn("_in", F.lit(True))
    asked = b.select("query_id").distinct().withColumn("_asked", F.lit(True))
    rows = lookup_join(a.join(keys, ["query_id", "doc_id"], "left"), asked, ["query_id"], "left")
    return _rerank(rows.filter(F.col("_in") | F.col("_asked").isNull()), [F.col("rank")])


def r_upgrade(a: DataFrame, b: DataFrame, reverse: bool = False) -> DataFrame:
    """a's hits that are also in b move to the front (or, reversed, to the back), otherwise in order."""
    keys = b.select("query_id", "doc_id").withColumn("_in", F.lit(True))
    flag = F.when(F.col("_in").isNotNull() != F.lit(reverse), 0).otherwise(1)
    return _rerank(a.join(keys, ["query_id", "doc_id"], "left").withColumn("_from", flag), [F.col("_from"), F.col("rank")])


def r_upgrade_extend(a: DataFrame, b: DataFrame) -> DataFrame:
    """:func:`r_upgrade` and :func:`r_extend` in one order: a's hits that are in b, a's others, b's others."""
    keys = ["query_id", "doc_id"]
    flag = F.when(F.col("_in").isNotNull(), 0).otherwise(1)
    known = a.join(b.select(*keys, F.lit(True).alias("_in")), keys, "left").select(*RANKED, flag.alias("_from"))
    extra = b.join(a.select(*keys), keys, "left_anti").select(*RANKED, F.lit(2).alias("_from"))
    return _rerank(known.union(extra), [F.col("_from"), F.col("rank")])


def _rerank(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    return wide_rank(rows, ["query_id"], order, "_new").drop("rank").withColumnRenamed("_new", "rank").select(*RANKED)
