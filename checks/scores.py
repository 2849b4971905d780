"""Scoring models, order, paging."""

from pyspark.sql import functions as F

from gleanery.functions import scoring as Sc
from gleanery.operators import clauses as C
from gleanery.operators import combine as H
from gleanery.operators import ranking as Rk

from .base import BM25_SQL, POSTINGS, QUERY_TERMS, check, index, r6, scored, table
from .clauses import benchmark_terms


@check("idf", f"WITH {POSTINGS} SELECT term, round(ln(n / (df + 1)) + 1, 6) AS idf FROM ts, fs")
def idf(spark, sf):
    idx = index(spark, sf)
    rows = idx.term_stats.filter("field = 'text'").join(F.broadcast(idx.field_stats.select("field", "n_docs")), "field")
    return rows.select("term", F.round(Sc.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


def model(name, expr, m):
    @check(name, f"WITH {scored(expr)}, {QUERY_TERMS} SELECT query_id, doc_id, round(sum(s), 6) AS score FROM qt JOIN sc USING (term) GROUP BY ALL")
    def run(spark, sf):
        return H.any_of(C.match(index(spark, sf), benchmark_terms(spark, sf), m)).select("query_id", "doc_id", r6())


PRIOR, POST = "(tf / doc_len)", "((tf + 1.0::DOUBLE) / (doc_len + 1.0::DOUBLE))"
DFREE = (f"tf * ln({POST} / {PRIOR}) * (tf * ln({PRIOR} * total / cf) + (tf + 1.0) * ln({POST} * total / cf) + 0.5 * ln({POST} / {PRIOR}))")
TFN = "(tf * ln(1.0 + avgl / doc_len))"
PL2 = f"({TFN} * ln(1.0 / (cf / n)) + (cf / n) * (1.0 / ln(2.0::DOUBLE)) + 0.5 * ln(2 * pi() * {TFN}) + {TFN} * (ln({TFN}) - 1.0 / ln(2.0::DOUBLE))) / ({TFN} + 1.0)"
IDF = "(ln(n / (df + 1)) + 1)"
model("score_bm25", BM25_SQL, Sc.BM25())
model("score_bm25_field_b", f"{IDF} * (tf * 2.5) / (tf + 1.5 * (0.6 + 0.4 * doc_len / avgl))", Sc.BM25(k1=1.5, field_b={"text": 0.4}))
model("score_tfidf", f"tf * {IDF}", Sc.tf_idf)
model("score_frequency", "tf::DOUBLE", Sc.frequency)
model("score_dfree", DFREE, Sc.dfree)
model("score_pl2", PL2, Sc.PL2())
model("score_reverse", f"-({BM25_SQL})", Sc.Reverse(Sc.BM25()))


class FirstPosition:
    """A user's model: the earlier a term first occurs, the better."""

    needs_positions = True

    def __call__(self, s):
        return 1.0 / (s.positions[0] + 1)


@check("score_function", f"WITH {POSTINGS}, {QUERY_TERMS}, f AS (SELECT doc_id, term, min(pos) AS first FROM tok GROUP BY ALL) SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (first + 1)), 6) AS score FROM qt JOIN f USING (term) GROUP BY ALL")
def score_function(spark, sf):
    return H.any_of(C.match(index(spark, sf), benchmark_terms(spark, sf), FirstPosition())).select("query_id", "doc_id", r6())


@check("score_by_field", f"WITH {scored(f'tf * {IDF}')}, {QUERY_TERMS}, q AS (SELECT query_id, doc_id, s FROM qt JOIN sc USING (term) UNION ALL SELECT item_id, doc_id, 1.0 FROM benchmark, documents WHERE lang = 'fr') "
       "SELECT query_id, doc_id, round(sum(s), 6) AS score FROM q GROUP BY ALL")
def score_by_field(spark, sf):
    fr = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(-1).alias("clause_id"), F.lit("lang").alias("field"), F.lit("fr").alias("term"), F.lit(1.0).alias("boost"))
    terms = benchmark_terms(spark, sf).unionByName(fr)
    return H.any_of(C.match(index(spark, sf), terms, Sc.ByField(Sc.BM25(), {"text": Sc.tf_idf}))).select("query_id", "doc_id", r6())


@check("score_final", f"WITH {scored()}, {QUERY_TERMS}, h AS (SELECT query_id, doc_id, sum(s) AS score FROM qt JOIN sc USING (term) GROUP BY ALL) SELECT query_id, doc_id, round(score * (1 + coalesce(quality, 0)), 6) AS score FROM h LEFT JOIN labels USING (doc_id)")
def score_final(spark, sf):
    hits = H.any_of(C.match(index(spark, sf), benchmark_terms(spark, sf)))
    final = hits.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return final.select("query_id", "doc_id", F.round(F.col("score") * (1 + F.coalesce("quality", F.lit(0))), 6).alias("score"))


@check("score_explain", f"WITH {scored()}, {QUERY_TERMS} SELECT query_id, 'text' AS field, term, doc_id, tf::DOUBLE AS weight, doc_len AS length, round(s, 6) AS score FROM qt JOIN sc USING (term)")
def score_explain(spark, sf):
    t = benchmark_terms(spark, sf)
    idx = index(spark, sf)
    hits = C.match(idx, t.withColumn("in_field", F.col("field")).withColumn("in_term", F.col("term")), keep=("weight", "doc_len"))
    return hits.select("query_id", F.col("in_field").alias("field"), F.col("in_term").alias("term"), "doc_id", "weight", F.col("doc_len").cast("long").alias("length"), r6())


# ---- order and paging
HITS = f"WITH {scored()}, {QUERY_TERMS}, h AS (SELECT query_id, doc_id, sum(s) AS score FROM qt JOIN sc USING (term) GROUP BY ALL)"


def hits(spark, sf):
    return H.any_of(C.match(index(spark, sf), benchmark_terms(spark, sf)))


def long_rank(df, name="rank"):
    return df.withColumn(name, F.col(name).cast("long"))


@check("all_hits", HITS + " SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM h")
def all_hits(spark, sf):
    return Rk.all_hits(hits(spark, sf)).select("query_id", "doc_id", r6(), "rank")


@check("sort_by_field", "SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size > 10 THEN p_size END DESC NULLS FIRST, p_partkey) AS place FROM part")
def sort_by_field(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"))
    return Rk.sort_by_field(p, "size", reverse=True, key="p_partkey").select("p_partkey", "place")


@check("sort_multi", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders")
def sort_multi(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return Rk.sort_multi(orders, [("o_orderpriority", False), ("o_totalprice", True)], "o_orderkey").select("o_orderkey", "place")


@check("sort_by_score_within", HITS + " SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY lang, round(score, 9) DESC, doc_id) AS place FROM h JOIN documents USING (doc_id)")
def sort_by_score_within(spark, sf):
    rows = hits(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return Rk.sort_by_score_within(rows, "lang").select("query_id", "doc_id", "place")


@check("sort_by_function", "SELECT doc_id, row_number() OVER (ORDER BY length(text) % 100, doc_id) AS place FROM documents")
def sort_by_function(spark, sf):
    sizes = table(spark, sf, "documents").select("doc_id", F.length("text").alias("size"))
    return Rk.sort_by_function(sizes, F.col("size") % 100).select("doc_id", "place")


@check("sort_natural", "SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment), (c_custkey * 7919) % 1000, c_custkey) AS place FROM customer")
def sort_natural(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat("c_mktsegment", (F.col("c_custkey") * 7919) % 1000).alias("name"))
    return Rk.sort_natural(c, "name", "c_custkey").select("c_custkey", "place")


@check("page", HITS + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM h) "
       "SELECT query_id, doc_id, round(score, 6) AS score, rank, total, ceil(total / 7)::BIGINT AS pagecount FROM r WHERE rank BETWEEN 15 AND 21")
def page(spark, sf):
    return Rk.page(hits(spark, sf), 3, 7, strict=False).select("query_id", "doc_id", r6(), "rank", "total", "pagecount")


@check("total_hits", HITS + " SELECT query_id, count(*) AS total FROM h GROUP BY query_id")
def total_hits(spark, sf):
    return Rk.total_hits(hits(spark, sf))


@check("response_rows", HITS + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total_count FROM h)
SELECT query_id, any_value(total_count) AS total_count, '[' || string_agg('{"jobId":' || doc_id || ',"jobTitle":"' || lang || '"}', ',' ORDER BY rank) || ']' AS items FROM r JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id""")
def response_rows(spark, sf):
    from gleanery.sources.writers import response_rows as answer
    return answer(hits(spark, sf), index(spark, sf).corpus, 5, {"jobId": "doc_id", "jobTitle": "lang"})
