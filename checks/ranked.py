"""Flagship search."""

from pyspark.sql import functions as F

from gleanery.plans.search import search

from .base import *  # noqa: F403
from .base import QUERY_TERMS, check, index, r6, scored, table


@check("top_k", f"""WITH {scored()}, {QUERY_TERMS},
h AS (SELECT query_id, doc_id, sum(s) AS score FROM qt JOIN sc USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM h)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def top_k_query(spark, sf):
    hits = search(index(spark, sf), table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"))
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", r6())
