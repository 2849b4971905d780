"""Boolean algebra, nesting and the algebra of ranked results."""

from pyspark.sql import functions as F

from gleanery.functions import tokens as T
from gleanery.operators import clauses as C
from gleanery.operators import combine as H
from gleanery.operators import ranking as Rk

from .base import POSTINGS, QUERY_TERMS, check, index, r6, scored, table
from .clauses import benchmark_terms

# Queries of n operands: the words of every benchmark text in order, n by n, until all are used.
QUERY_STEP = 100_000


def ordered(n: int = 1) -> str:
    """CTE qo(query_id, term, clause_id): the words dealt out by :func:`operand_terms`."""
    return (QUERY_TERMS + f", q0 AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY min(pos)) - 1 AS i FROM qtok GROUP BY item_id, term), "
            f"qo AS (SELECT item_id * {QUERY_STEP} + i // {n} AS query_id, term, i % {n} AS clause_id FROM q0)")


def operand_terms(spark, sf, n: int):
    t = benchmark_terms(spark, sf)
    return t.withColumn("query_id", F.col("query_id") * QUERY_STEP + F.floor(F.col("clause_id") / n)).withColumn("clause_id", F.col("clause_id") % n)


def cl(*ids):
    return ", ".join(f"h{i} AS (SELECT query_id, doc_id, s AS score FROM qo JOIN sc USING (term) WHERE clause_id = {i})" for i in ids)


def hits(spark, sf, i, n):
    return C.match(index(spark, sf), operand_terms(spark, sf, n).filter(F.col("clause_id") == i), together=True).select("query_id", "doc_id", "score")


def base(n: int) -> str:
    return f"WITH {scored()}, {ordered(n)}, "


def out(df):
    return df.select("query_id", "doc_id", r6())


def reg(name, ids, sql, fn):
    @check(name, base(len(ids)) + cl(*ids) + " " + sql)
    def run(spark, sf):
        return out(fn(spark, sf, *[hits(spark, sf, i, len(ids)) for i in ids]))


UNION3 = "u AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)"
reg("h_and", (0, 1), "SELECT query_id, doc_id, round(h0.score + h1.score, 6) AS score FROM h0 JOIN h1 USING (query_id, doc_id)", lambda s, f, a, b: H.h_and(a, b))
reg("h_or", (0, 1, 2), f", {UNION3} SELECT query_id, doc_id, round(sum(score), 6) AS score FROM u GROUP BY ALL HAVING count(*) >= 2", lambda s, f, a, b, c: H.h_or(a, b, c, minmatch=2))
reg("h_dismax", (0, 1, 2), f", {UNION3} SELECT query_id, doc_id, round(max(score) + 0.3 * (sum(score) - max(score)), 6) AS score FROM u GROUP BY query_id, doc_id", lambda s, f, a, b, c: H.h_dismax(a, b, c, tiebreak=0.3))
reg("h_not", (0,), "SELECT query_id, doc_id, 1.0::DOUBLE AS score FROM (SELECT DISTINCT query_id FROM qo), documents WHERE (query_id, doc_id) NOT IN (SELECT query_id, doc_id FROM h0)",
    lambda s, f, a: H.h_not(index(s, f).doc_ids, a, operand_terms(s, f, 1).select("query_id").distinct()))
# Negations inside a query: one is taken away, one is an alternative that another operand cuts down again.
reg("h_and_negated", (0, 1, 2), ", b AS (SELECT query_id, doc_id FROM h1 UNION SELECT query_id, doc_id FROM h2) SELECT query_id, doc_id, round(score + 1, 6) AS score FROM h0 ANTI JOIN b USING (query_id, doc_id)",
    lambda s, f, a, b, c: H.h_and(a, H.negate(H.h_or(b, c))))
reg("h_or_negated", (0, 1, 2), "SELECT h0.query_id, h0.doc_id, round(h0.score + coalesce(h1.score, 0) + CASE WHEN h2.score IS NULL THEN 1 ELSE 0 END, 6) AS score "
    "FROM h0 LEFT JOIN h1 USING (query_id, doc_id) LEFT JOIN h2 USING (query_id, doc_id) WHERE h1.score IS NOT NULL OR h2.score IS NULL",
    lambda s, f, a, b, c: H.h_and(a, H.h_or(b, H.negate(c))))
reg("h_and_not", (0, 1), "SELECT query_id, doc_id, round(score, 6) AS score FROM h0 ANTI JOIN h1 USING (query_id, doc_id)", lambda s, f, a, b: H.h_and_not(a, b))
reg("h_and_maybe", (0, 1), "SELECT h0.query_id, h0.doc_id, round(h0.score + coalesce(h1.score, 0), 6) AS score FROM h0 LEFT JOIN h1 USING (query_id, doc_id)", lambda s, f, a, b: H.h_and_maybe(a, b))
reg("h_require", (0, 1), "SELECT query_id, doc_id, round(score, 6) AS score FROM h0 SEMI JOIN h1 USING (query_id, doc_id)", lambda s, f, a, b: H.h_require(a, b))
reg("h_otherwise", (0, 1), ", a AS (SELECT * FROM h0 WHERE query_id % 2 = 0) SELECT query_id, doc_id, round(score, 6) AS score FROM a UNION ALL SELECT query_id, doc_id, round(score, 6) FROM h1 WHERE query_id NOT IN (SELECT query_id FROM a)",
    lambda s, f, a, b: H.h_otherwise(a.filter("query_id % 2 = 0"), b))
reg("h_boolean", (0, 1, 2), "SELECT h0.query_id, h0.doc_id, round(h0.score + coalesce(h1.score, 0), 6) AS score FROM h0 LEFT JOIN h1 USING (query_id, doc_id) ANTI JOIN h2 USING (query_id, doc_id)",
    lambda s, f, a, b, c: H.h_boolean([a], [b], [c]))

# Words asked of two fields: every document is searched in its text and in its language code.
MULTI = f"""WITH {scored()}, {ordered(3)}, w AS (SELECT query_id, term, clause_id FROM qo UNION ALL SELECT DISTINCT query_id, 'en', 3 FROM qo),
b AS (SELECT query_id, doc_id, clause_id, s * 2.0 AS score FROM w JOIN sc USING (term) UNION ALL SELECT query_id, doc_id, clause_id, 0.5 FROM w JOIN documents ON lang = term), """


def multi_words(spark, sf):
    t = operand_terms(spark, sf, 3).select("query_id", "clause_id", "term")
    en = t.select("query_id").distinct().select("query_id", F.lit(3).alias("clause_id"), F.lit("en").alias("term"))
    return t.union(en)


FIELD_BOOSTS = {"text": 2.0, "lang": 0.5}


@check("h_multifield", MULTI + "c AS (SELECT query_id, doc_id, clause_id, sum(score) AS s FROM b GROUP BY ALL), n AS (SELECT query_id, count(DISTINCT clause_id) AS need FROM w GROUP BY query_id) "
       "SELECT query_id, doc_id, round(sum(s), 6) AS score FROM c JOIN n USING (query_id) GROUP BY query_id, doc_id, need HAVING count(*) = need")
def h_multifield(spark, sf):
    terms = H.over_fields(H.clause_counts(multi_words(spark, sf)), FIELD_BOOSTS)
    return out(H.h_multifield(C.match(index(spark, sf), terms, together=True, tasks=C.hit_tasks(index(spark, sf), terms))))


@check("h_dismax_fields", MULTI + "c AS (SELECT query_id, doc_id, clause_id, max(score) + 0.1 * (sum(score) - max(score)) AS s FROM b GROUP BY query_id, doc_id, clause_id) "
       "SELECT query_id, doc_id, round(sum(s) FILTER (clause_id <> 2), 6) AS score FROM c GROUP BY query_id, doc_id HAVING count(*) FILTER (clause_id = 3) = 1 AND count(*) FILTER (clause_id = 2) = 0")
def h_dismax_fields(spark, sf):
    role = F.when(F.col("clause_id") == 3, "+").when(F.col("clause_id") == 2, "-").otherwise("")
    words = multi_words(spark, sf).withColumn("role", role).withColumn("n_required", F.lit(1))
    terms = H.over_fields(words, FIELD_BOOSTS)
    return out(H.h_dismax_fields(C.match(index(spark, sf), terms, together=True, tasks=C.hit_tasks(index(spark, sf), terms)), tiebreak=0.1))


# ---- parents and children: orders and their lines
def line_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("doc_id"),
                     F.col("l_orderkey").alias("parent_id"), "l_quantity", "l_returnflag")


LINES = "l AS (SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 100 + l_suppkey % 100 AS doc_id, l_orderkey AS parent_id, l_quantity, l_returnflag FROM lineitem)"


@check("h_nested_parent", f"""WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY doc_id, l_quantity) AS rn FROM l WHERE l_returnflag = 'R')
SELECT 0 AS query_id, parent_id AS doc_id, sum(l_quantity) AS score FROM r WHERE rn <= 2 GROUP BY parent_id""")
def h_nested_parent(spark, sf):
    lines = line_rows(spark, sf)
    # Line ids may repeat in the made data, so the quantity rides along instead of being joined back.
    hit = lines.filter("l_returnflag = 'R'").select(F.lit(0).alias("query_id"), "doc_id", "parent_id", F.col("l_quantity").alias("score"))
    return H.h_nested_parent(hit.drop("parent_id"), lines.select("doc_id", "parent_id").distinct(), limit=2)


@check("h_nested_children", f"WITH {LINES} SELECT 0 AS query_id, l.doc_id, 1.5::DOUBLE AS score FROM l JOIN orders ON parent_id = o_orderkey WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
def h_nested_children(spark, sf):
    parents = table(spark, sf, "orders").filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(F.lit(0).alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.lit(1.0).alias("score"))
    return H.h_nested_children(parents, line_rows(spark, sf), 1.5)


@check("h_nested_delete", f"""WITH {LINES}, t AS (SELECT DISTINCT parent_id FROM l WHERE l_quantity >= 50) SELECT 'parent' AS kind, parent_id AS doc_id FROM t
UNION ALL SELECT 'child', doc_id FROM l SEMI JOIN t USING (parent_id)""")
def h_nested_delete(spark, sf):
    lines = line_rows(spark, sf)
    hit = lines.filter("l_quantity >= 50").select("doc_id").distinct()
    return H.h_nested_delete(hit, table(spark, sf, "orders").select(F.col("o_orderkey").alias("parent_id")), lines.select("doc_id", "parent_id"))


# ---- filters and ranked results
reg("h_filter", (0,), "SELECT query_id, doc_id, round(score, 6) AS score FROM h0 SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') USING (doc_id)",
    lambda s, f, a: H.h_filter(a, table(s, f, "documents").filter("lang = 'en'").select("doc_id")))
reg("h_mask", (0,), "SELECT query_id, doc_id, round(score, 6) AS score FROM h0 ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)",
    lambda s, f, a: H.h_mask(a, table(s, f, "labels").filter("toxic = 1").select("doc_id")))


def ranks(*ids):
    return ", ".join(f"r{i} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM h{i})" for i in ids)


def alg(name, tail, fn):
    @check(name, base(2) + cl(0, 1) + ", " + ranks(0, 1) + ", " + tail)
    def run(spark, sf):
        a, b = Rk.rank_all(hits(spark, sf, 0, 2)), Rk.rank_all(hits(spark, sf, 1, 2))
        return fn(a, b).select("query_id", "doc_id", r6(), "rank")


FINAL = "SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY f, rank) AS rank FROM z"
alg("r_extend", f"z AS (SELECT query_id, doc_id, score, rank, 0 AS f FROM r0 UNION ALL SELECT query_id, doc_id, score, rank, 1 FROM r1 ANTI JOIN r0 USING (query_id, doc_id)) {FINAL}", Rk.r_extend)
alg("r_filter", f"z AS (SELECT r0.*, 0 AS f FROM r0 WHERE (query_id, doc_id) IN (SELECT query_id, doc_id FROM r1) OR query_id NOT IN (SELECT query_id FROM r1)) {FINAL}", Rk.r_filter)
alg("r_upgrade", f"z AS (SELECT r0.*, CASE WHEN (query_id, doc_id) IN (SELECT query_id, doc_id FROM r1) THEN 0 ELSE 1 END AS f FROM r0) {FINAL}", Rk.r_upgrade)
alg("r_upgrade_extend", f"z AS (SELECT r0.*, CASE WHEN (query_id, doc_id) IN (SELECT query_id, doc_id FROM r1) THEN 0 ELSE 1 END AS f FROM r0 UNION ALL SELECT r1.*, 2 FROM r1 ANTI JOIN r0 USING (query_id, doc_id)) {FINAL}", Rk.r_upgrade_extend)
