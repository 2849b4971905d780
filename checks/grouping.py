"""Facets and collapsing."""

from pyspark.sql import functions as F

from gleanery.operators import clauses as C
from gleanery.operators import combine as H
from gleanery.operators import facets as Fa

from .base import check, index, table
from .clauses import benchmark_terms
from .scores import HITS, hits

WITH_DOCS = HITS + ", d AS (SELECT query_id, doc_id, score, lang, source FROM h JOIN documents USING (doc_id))"


def doc_hits(spark, sf):
    return hits(spark, sf).join(index(spark, sf).corpus.select("doc_id", "lang", "source"), "doc_id")


def lines(spark, sf):
    return table(spark, sf, "lineitem").withColumn("query_id", F.lit(0))


def orders(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.lit(0).alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"), *o.columns)


@check("facet_field", WITH_DOCS + " SELECT query_id, lang AS facet, count(*) AS n FROM d GROUP BY ALL")
def facet_field(spark, sf):
    return Fa.facet_count(Fa.facet_field(doc_hits(spark, sf), "lang"))


@check("facet_overlap", WITH_DOCS + " SELECT query_id, unnest([lang, source]) AS facet, doc_id FROM d")
def facet_overlap(spark, sf):
    rows = doc_hits(spark, sf).withColumn("labels", F.array("lang", "source"))
    return Fa.facet_overlap(rows, "labels").select("query_id", "facet", "doc_id")


@check("facet_query", "SELECT 0 AS query_id, CASE WHEN l_quantity > 45 THEN 'bulk' WHEN l_discount >= 0.08 THEN 'cheap' ELSE 'rest' END AS facet, count(*) AS n FROM lineitem GROUP BY ALL")
def facet_query(spark, sf):
    return Fa.facet_count(Fa.facet_query(lines(spark, sf), [("bulk", F.col("l_quantity") > 45), ("cheap", F.col("l_discount") >= 0.08)], "rest"))


@check("facet_query_overlap", "WITH a AS (SELECT 'bulk' AS facet FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT 'cheap' FROM lineitem WHERE l_discount >= 0.08 UNION ALL SELECT 'rest' FROM lineitem WHERE l_quantity <= 45 AND l_discount < 0.08) SELECT 0 AS query_id, facet, count(*) AS n FROM a GROUP BY facet")
def facet_query_overlap(spark, sf):
    return Fa.facet_count(Fa.facet_query(lines(spark, sf), [("bulk", F.col("l_quantity") > 45), ("cheap", F.col("l_discount") >= 0.08)], "rest", allow_overlap=True))


@check("facet_range", """WITH b AS (SELECT * FROM (VALUES (0, 1), (1, 6), (6, 16), (16, 26), (26, 36), (36, 45)) t(lo, hi))
SELECT lo::DOUBLE AS lo, hi::DOUBLE AS hi, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem LEFT JOIN b ON l_quantity >= lo AND l_quantity < hi GROUP BY ALL""")
def facet_range(spark, sf):
    return Fa.facet_range(lines(spark, sf), "l_quantity", 0, 45, [1, 5, 10], hardend=True).groupBy("lo", "hi").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@check("facet_date_range", "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2024-01-01') AS lo, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2024-01-01') + INTERVAL 7 DAY AS hi, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-12-30' GROUP BY ALL")
def facet_date_range(spark, sf):
    return Fa.facet_date_range(table(spark, sf, "events"), "ts", "2024-01-01", "2024-12-30", "7 days").groupBy("lo", "hi").agg(F.count("*").alias("n"))


@check("facet_stored", "SELECT 0 AS query_id, unnest(string_split(p_name, ' ')) AS facet, p_partkey AS doc_id FROM part")
def facet_stored(spark, sf):
    p = table(spark, sf, "part").select(F.lit(0).alias("query_id"), F.col("p_partkey").alias("doc_id"), "p_name")
    return Fa.facet_stored(p, "p_name", allow_overlap=True).select("query_id", "facet", "doc_id")


@check("facets_many", WITH_DOCS + " SELECT query_id, 'lang' AS facet_name, lang AS facet, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT query_id, 'source', source, count(*) FROM d GROUP BY ALL")
def facets_many(spark, sf):
    return Fa.facets_many(doc_hits(spark, sf), ["lang", "source"])


@check("facet_count", WITH_DOCS + " SELECT query_id, source AS facet, count(*) AS n FROM d GROUP BY ALL")
def facet_count(spark, sf):
    return Fa.facet_count(Fa.facet_field(doc_hits(spark, sf), "source"))


@check("facet_best", WITH_DOCS + " SELECT query_id, lang AS facet, arg_min(doc_id, (-round(score, 9), doc_id)) AS doc_id FROM d GROUP BY query_id, lang")
def facet_best(spark, sf):
    return Fa.facet_best(Fa.facet_field(doc_hits(spark, sf), "lang"), -F.round("score", 9))


@check("facet_ordered", WITH_DOCS + " SELECT query_id, lang AS facet, row_number() OVER (PARTITION BY query_id, lang ORDER BY round(score, 9) DESC, doc_id) AS place, doc_id FROM d")
def facet_ordered(spark, sf):
    return Fa.facet_ordered(Fa.facet_field(doc_hits(spark, sf), "lang"))


@check("facet_unordered", WITH_DOCS + " SELECT query_id, lang AS facet, doc_id FROM d")
def facet_unordered(spark, sf):
    return Fa.facet_unordered(Fa.facet_field(doc_hits(spark, sf), "lang"))


@check("facet_aggregate", WITH_DOCS + " SELECT query_id, lang AS facet, round(avg(score), 6) AS mean, max(doc_id) AS last FROM d GROUP BY query_id, lang")
def facet_aggregate(spark, sf):
    return Fa.facet_aggregate(Fa.facet_field(doc_hits(spark, sf), "lang"), F.round(F.avg("score"), 6).alias("mean"), F.max("doc_id").alias("last"))


COLLAPSE_BASE = "WITH o AS (SELECT *, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS org FROM orders)"


def orgs(spark, sf):
    return orders(spark, sf).withColumn("org", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")))


@check("collapse", COLLAPSE_BASE + ", r AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM o) SELECT o_orderkey AS doc_id, org::DOUBLE AS org FROM r WHERE rn <= 2 OR org IS NULL")
def collapse(spark, sf):
    return Fa.collapse(orgs(spark, sf), "org", 2).select("doc_id", F.col("org").cast("double").alias("org"))


@check("collapsed_counts", COLLAPSE_BASE + " SELECT org, count(*) - least(count(*), 2) AS removed FROM o WHERE org IS NOT NULL GROUP BY org HAVING count(*) > 2")
def collapsed_counts(spark, sf):
    return Fa.collapsed_counts(orgs(spark, sf), "org", 2).select("org", "removed")


@check("unique_by_org", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) SELECT o_orderkey, o_custkey FROM r WHERE rn = 1 ORDER BY o_orderkey DESC LIMIT 50")
def unique_by_org(spark, sf):
    return Fa.unique_by_org(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 50)


@check("matched_terms", HITS + " SELECT DISTINCT query_id, doc_id, term FROM qt JOIN sc USING (term)")
def matched_terms(spark, sf):
    t = benchmark_terms(spark, sf)
    # The clause number names the word, so the term need not travel twice.
    found = C.match(index(spark, sf), t.withColumn("word", F.col("term"))).withColumnRenamed("word", "term")
    return Fa.matched_terms(found)
