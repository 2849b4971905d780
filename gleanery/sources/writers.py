"""Writers and output rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import best_per_group
from ..operators.index import write_postings  # noqa: F401
from ..operators.ranking import by_score, total_hits


def stored_override(corpus: DataFrame, column: str) -> DataFrame:
    """Index one value, store another: ``column`` keeps the indexed value, ``stored_<column>`` what results show."""
    special = f"_stored_{column}"
    value = F.coalesce(F.col(special), F.col(column)) if special in corpus.columns else F.col(column)
    return corpus.withColumn(f"stored_{column}", value).drop(special)


def response_rows(hits: DataFrame, corpus: DataFrame, size: int, fields: dict[str, str], key: str = "doc_id") -> DataFrame:
    """One answer per query: (query_id, total_count, items JSON).

    ``total_count`` is all matches, ``items`` the top ``size`` with the renamed stored ``fields``. At most ``size`` rows per
    query are gathered.
    """
    best = best_per_group(hits, ["query_id"], by_score(), size, "rank")
    stored = best.join(corpus, best["doc_id"] == corpus[key]).select(
        "query_id", "rank", F.struct(*[corpus[c].alias(n) for n, c in fields.items()]).alias("item"))
    items = stored.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item"))).alias("i")) \
        .select("query_id", F.to_json(F.transform("i", lambda x: x["item"])).alias("items"))
    return total_hits(hits).withColumnRenamed("total", "total_count").join(items, "query_id")
