"""Key terms, similar documents, clusters, spelling."""

from pyspark.sql import functions as F

from gleanery.functions import distance as D
from gleanery.functions import scoring as Sc
from gleanery.functions import tokens as T
from gleanery.operators import mining as M

from .base import POSTINGS, QUERY_TERMS, ascii, check, index, r6, scored, std_tokens, table
from .clauses import benchmark_terms
from .scores import HITS, hits

# Sets of documents by source: w(set_id, term, w)
SETS = f"WITH {POSTINGS}, w AS (SELECT source AS set_id, term, sum(tf)::DOUBLE AS w FROM p JOIN documents USING (doc_id) GROUP BY ALL), tt AS (SELECT set_id, sum(w) AS top_total FROM w GROUP BY set_id)"
BO1 = "w * log2((1 + cf / n) / (cf / n)) + log2(1 + cf / n)"
BO2 = "w * log2((1 + w * top_total / total) / (w * top_total / total)) + log2(1 + w * top_total / total)"
KL = "CASE WHEN w / top_total < cf / total THEN 0 ELSE w / top_total * log2((w / top_total) / (w / total)) END"
NORMS = {
    "bo1": "((mx * ln((1 + mx / n) / (mx / n)) + ln(1 + mx / n)) / ln(2.0::DOUBLE))",
    "bo2": "(mx * log2((1 + mx * n / total) / (mx * n / total)) + log2(1 + mx * n / total))",
    "kl": "(mx * ln(total / top_total) / ln(2.0::DOUBLE) * top_total)",
}


def ranked_terms(expr: str, norm: str, number: int = 5) -> str:
    return (f", k AS (SELECT set_id, term, top_total, {expr} AS raw FROM w JOIN ts USING (term) JOIN tt USING (set_id), fs), m AS (SELECT *, max(raw) OVER (PARTITION BY set_id) AS mx FROM k), "
            f"r AS (SELECT m.*, n, total, row_number() OVER (PARTITION BY set_id ORDER BY round(raw, 9) DESC, term) AS rank FROM m, fs) SELECT set_id, term, round(raw / {norm}, 6) AS weight, rank FROM r WHERE rank <= {number}")


def final(df):
    return df.select("set_id", "term", r6("weight"), F.col("rank").cast("long").alias("rank"))


def sources(name, expr, norm, model):
    @check(name, SETS + ranked_terms(expr, norm))
    def run(spark, sf):
        members = table(spark, sf, "documents").select(F.col("source").alias("set_id"), "doc_id")
        idx = index(spark, sf)
        return final(M.key_terms(idx, M.set_weights(idx, members, "text"), "text", model))


sources("key_terms_bo1", BO1, NORMS["bo1"], Sc.Bo1())
sources("key_terms_bo2", BO2, NORMS["bo2"], Sc.Bo2())
sources("key_terms_kl", KL, NORMS["kl"], Sc.KL())


@check("key_terms_text", f"WITH {POSTINGS}, {std_tokens('qtok', 'benchmark', 'item_id')}, w AS (SELECT item_id AS set_id, term, count(*)::DOUBLE AS w FROM qtok GROUP BY ALL), tt AS (SELECT set_id, sum(w) AS top_total FROM w GROUP BY set_id)" + ranked_terms(BO1, NORMS["bo1"]))
def key_terms_text(spark, sf):
    return final(M.key_terms_text(index(spark, sf), table(spark, sf, "benchmark").withColumnRenamed("item_id", "set_id"), T.an_standard(), "text"))


@check("key_terms_results", HITS + """, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rk FROM h),
w AS (SELECT query_id AS set_id, term, sum(tf)::DOUBLE AS w FROM t JOIN p USING (doc_id) WHERE rk <= 10 GROUP BY ALL), tt AS (SELECT set_id, sum(w) AS top_total FROM w GROUP BY set_id)""" + ranked_terms(BO1, NORMS["bo1"]))
def key_terms_results(spark, sf):
    return final(M.key_terms_results(index(spark, sf), hits(spark, sf), "text"))


@check("more_like", f"""WITH {scored()}, w AS (SELECT doc_id AS set_id, term, tf::DOUBLE AS w FROM p), tt AS (SELECT set_id, sum(w) AS top_total FROM w GROUP BY set_id)
, k AS (SELECT set_id, term, {BO1} AS raw FROM w JOIN ts USING (term), fs), m AS (SELECT *, max(raw) OVER (PARTITION BY set_id) AS mx, row_number() OVER (PARTITION BY set_id ORDER BY round(raw, 9) DESC, term) AS rk FROM k),
q AS (SELECT set_id, term, round(raw / {NORMS['bo1']}, 9) AS boost FROM m, fs WHERE rk <= 5),
h AS (SELECT set_id AS doc_id, sc.doc_id AS like_id, round(sum(s * boost), 9) AS score FROM q JOIN sc USING (term) WHERE set_id <> sc.doc_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, like_id) AS rank FROM h) SELECT doc_id, like_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def more_like(spark, sf):
    return M.more_like(index(spark, sf), "text").select("doc_id", "like_id", r6(), "rank")


SHINGLES = "sh AS (SELECT doc_id, substr(t, i, 2) AS shingle, count(*) AS n FROM (SELECT doc_id, t, unnest(generate_series(1, length(t) - 1)) AS i FROM (SELECT doc_id, text AS t FROM documents)) GROUP BY ALL)"
# Characters first, as substr from far inside a long text is slow.
SHINGLES = ("ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents), pr AS (SELECT doc_id, c || lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS shingle FROM ch), "
            "sh AS (SELECT doc_id, shingle, count(*) AS n FROM pr WHERE shingle IS NOT NULL GROUP BY ALL)")
HASHES = SHINGLES + (", fh AS (SELECT shingle, ('0x' || substr(md5(shingle), 1, 8))::BIGINT AS f FROM (SELECT DISTINCT shingle FROM sh)), "
                     "bits AS (SELECT doc_id, b, sum(CASE WHEN (f >> b) & 1 = 1 THEN n ELSE -n END) AS v FROM sh JOIN fh USING (shingle) CROSS JOIN (SELECT unnest(generate_series(0, 31)) AS b) GROUP BY doc_id, b), "
                     "hs AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS simhash FROM bits GROUP BY doc_id)")


@check("char_shingles", f"WITH {SHINGLES} SELECT doc_id, shingle, n FROM sh")
def char_shingles(spark, sf):
    return M.char_shingles(table(spark, sf, "documents"))


def hashes(spark, sf):
    return M.simhash(M.char_shingles(table(spark, sf, "documents")))


@check("simhash", f"WITH {HASHES} SELECT doc_id, simhash FROM hs")
def simhash(spark, sf):
    return hashes(spark, sf)


@check("near_duplicates", f"""WITH {HASHES}, g AS (SELECT simhash AS h, min(doc_id) AS doc FROM hs GROUP BY simhash)
SELECT doc AS doc_a, doc_id AS doc_b, 0::BIGINT AS distance FROM hs JOIN g ON simhash = h WHERE doc <> doc_id
UNION ALL SELECT least(a.doc, b.doc), greatest(a.doc, b.doc), bit_count(xor(a.h, b.h))::BIGINT FROM g a JOIN g b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 2""")
def near_duplicates(spark, sf):
    return M.near_duplicates(M.settle(hashes(spark, sf)), 2).withColumn("distance", F.col("distance").cast("long"))


@check("kmeans_1d")
def kmeans_1d(spark, sf):
    rows, _ = M.kmeans_1d(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", [1000.0, 100000.0, 300000.0])
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("center"))


SWIN = """WITH v AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i FROM orders), d AS (SELECT v, min(i) AS fi FROM v GROUP BY v),
e AS (SELECT l.v, l.i, coalesce(u.fi, (SELECT max(i) FROM v)) AS j FROM v l ASOF LEFT JOIN d u ON u.v >= l.v + 60),
x AS (SELECT e.i, e.j, e.v AS left_v, v.v AS x FROM e JOIN v ON v.i BETWEEN e.i AND e.j)
SELECT left_v AS "left", max(x) AS "right", j - i AS "count", round(CASE WHEN j - i > 1 THEN var_samp(x) ELSE 99999.0::DOUBLE END + 0.00000123, 5) AS variance FROM x GROUP BY i, j, left_v"""


# Prices have two decimals, so variances often end exactly on a rounding boundary; the same small shift on both sides
# moves them off it.
@check("sliding_clusters", SWIN)
def sliding_clusters(spark, sf):
    return M.sliding_clusters(table(spark, sf, "orders"), "o_totalprice", 60.0).withColumn("variance", F.round(F.col("variance") + 0.00000123, 5))


@check("variance_two_pass", "SELECT round(var_samp(l_extendedprice), 3) AS variance FROM lineitem")
def variance_two_pass(spark, sf):
    return M.variance_two_pass(table(spark, sf, "lineitem"), "l_extendedprice").select(F.round("variance", 3).alias("variance"))


@check("variance_weighted", "WITH m AS (SELECT sum(l_discount * l_quantity) / sum(l_quantity) AS m FROM lineitem) SELECT round(sum(l_quantity * (l_discount - m) * (l_discount - m)) / (sum(l_quantity) - 1), 9) AS variance FROM lineitem, m")
def variance_weighted(spark, sf):
    return M.variance_weighted(table(spark, sf, "lineitem"), "l_discount", "l_quantity").select(F.round("variance", 9).alias("variance"))


# ---- strings: every part name against the next one
PAIRS = "n AS (SELECT p_partkey, p_name AS a, lead(p_name, 1, 'none') OVER (ORDER BY p_partkey) AS b FROM part)"


def pairs(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return p.join(nxt, "p_partkey", "left").select("p_partkey", F.col("p_name").alias("a"), F.coalesce("b", F.lit("none")).alias("b"))


@check("edit_distance", f"WITH {PAIRS} SELECT p_partkey, levenshtein(a, b) AS distance FROM n")
def edit_distance(spark, sf):
    return pairs(spark, sf).select("p_partkey", D.edit_distance(F.col("a"), F.col("b")).cast("long").alias("distance"))


@check("edit_distance_osa")
def edit_distance_osa(spark, sf):
    return pairs(spark, sf).select("p_partkey", D.edit_distance_osa(F.col("a"), F.col("b")).alias("distance"))


@check("similarity_relative", f"WITH {PAIRS} SELECT p_partkey, round((greatest(length(a), length(b)) - levenshtein(a, b)) / greatest(length(a), length(b))::DOUBLE * (least(length(a), length(b)) / greatest(length(a), length(b))::DOUBLE), 6) AS relative FROM n")
def similarity_relative(spark, sf):
    return pairs(spark, sf).select("p_partkey", F.round(D.similarity_relative(F.col("a"), F.col("b")), 6).alias("relative"))


# Misspellings: the first word of every benchmark text without its second letter.
WORDS = f"{QUERY_TERMS}, ms AS (SELECT DISTINCT term[1] || substr(term, 3) AS text FROM qt)"
MISSPELT = WORDS
def osa2(a: str, b: str) -> str:
    """SQL for the optimal string alignment distance up to 2, from columns da (unrestricted) and dl (Levenshtein): one
    swap splits both words, and what is left of and right of it may need one more edit."""
    def swap(j: str) -> str:
        return (f"({j} >= 1 AND {a}[i] <> {a}[i + 1] AND {b}[{j}] = {a}[i + 1] AND {b}[{j} + 1] = {a}[i] "
                f"AND damerau_levenshtein(substr({a}, 1, i - 1), substr({b}, 1, {j} - 1)) + damerau_levenshtein(substr({a}, i + 2), substr({b}, {j} + 2)) <= 1)")
    found = f"len(list_filter(generate_series(1, length({a}) - 1), lambda i: {swap('(i - 1)')} OR {swap('i')} OR {swap('(i + 1)')})) > 0"
    return f"CASE WHEN da <= 1 THEN da WHEN dl <= 2 THEN 2 WHEN da = 2 AND {found} THEN 2 ELSE 3 END"


def candidates(source: str, extra: str = "") -> str:
    """CTE c(text, suggestion, distance): words within two edits."""
    return (f"c0 AS (SELECT text, term AS suggestion, {extra}{ascii('text')} AS x, {ascii('term')} AS y FROM ms JOIN {source} ON abs(length(text) - length(term)) <= 2 AND text <> term), "
            "c1 AS (SELECT *, damerau_levenshtein(x, y) AS da, levenshtein(x, y) AS dl FROM c0), "
            f"c AS (SELECT *, {osa2('x', 'y')} AS distance FROM c1 WHERE da <= 2)")


SUGGEST = (", " + candidates("ts", "cf AS freq, ") + ", "
           "k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY distance, freq DESC, suggestion) AS rank FROM c WHERE distance <= 2)")


def misspelt(spark, sf):
    t = benchmark_terms(spark, sf)
    return t.select(F.lit("text").alias("field"), F.concat(F.substring("term", 1, 1), F.substring(F.col("term"), F.lit(3), F.length("term"))).alias("text")).distinct()


@check("suggest", f"WITH {POSTINGS}, {MISSPELT}{SUGGEST} SELECT text, suggestion, distance, freq, rank FROM k WHERE rank <= 5")
def suggest(spark, sf):
    words = index(spark, sf).term_stats.filter("field = 'text'").select("field", "term", F.col("cf").alias("freq"))
    return M.suggest(misspelt(spark, sf), words, keys=index(spark, sf).close_keys).select("text", "suggestion", F.col("distance").cast("long").alias("distance"), "freq", F.col("rank").cast("long").alias("rank"))


@check("suggest_from_list", f"WITH {WORDS}, l AS (SELECT DISTINCT term FROM qt UNION SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part), "
       f"{candidates('l')}, k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY distance, suggestion) AS rank FROM c WHERE distance <= 2) "
       "SELECT text, suggestion, distance, rank FROM k WHERE rank <= 5")
def suggest_from_list(spark, sf):
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    return M.suggest_from_list(misspelt(spark, sf), benchmark_terms(spark, sf), words).select("text", "suggestion", F.col("distance").cast("long").alias("distance"), F.col("rank").cast("long").alias("rank"))


GRAMS = """g{x} AS (SELECT w, 'gram' || s AS kind, substr(w, i, s) AS gram, count(*) AS tf FROM (SELECT w, s, unnest(generate_series(1, length(w) - s + 1)) AS i FROM {src} CROSS JOIN (VALUES (3), (4)) v(s) WHERE length(w) >= s) GROUP BY ALL
UNION ALL SELECT w, 'start' || s, substr(w, 1, s), 1 FROM {src} CROSS JOIN (VALUES (3), (4)) v(s) WHERE length(w) >= s UNION ALL SELECT w, 'end' || s, substr(w, length(w) - s + 1), 1 FROM {src} CROSS JOIN (VALUES (3), (4)) v(s) WHERE length(w) >= s)"""


@check("suggest_ngrams", f"WITH {MISSPELT}, vw AS (SELECT DISTINCT term AS w FROM qt), mw AS (SELECT text AS w FROM ms), " + GRAMS.format(x="v", src="vw") + ", " + GRAMS.format(x="m", src="mw") + f""",
df AS (SELECT kind, gram, count(*) AS df FROM gv GROUP BY ALL), n AS (SELECT count(*)::DOUBLE AS n FROM vw),
a AS (SELECT w AS text, kind, gram, df, CASE WHEN starts_with(kind, 'start') THEN 2.0 ELSE 1.0 END AS boost FROM gm JOIN df USING (kind, gram) WHERE right(kind, 1)::INT < length(w)),
s AS (SELECT text, w, round(sum(boost * tf * (ln(n / (df + 1)) + 1)), 9) AS score FROM a JOIN gv USING (kind, gram), n WHERE text <> w GROUP BY text, w),
k AS (SELECT text, w AS suggestion, levenshtein({ascii('text')}, {ascii('w')}) AS distance, score, row_number() OVER (PARTITION BY text ORDER BY levenshtein({ascii('text')}, {ascii('w')}), score DESC, w) AS rank FROM s)
SELECT text, suggestion, distance, round(score, 6) AS score, rank FROM k WHERE rank <= 3 AND score >= 0.5""")
def suggest_ngrams(spark, sf):
    out = M.suggest_ngrams(misspelt(spark, sf).select("text"), benchmark_terms(spark, sf))
    return out.select("text", "suggestion", F.col("distance").cast("long").alias("distance"), r6(), F.col("rank").cast("long").alias("rank"))


@check("correct_queries", f"WITH {POSTINGS}, {MISSPELT}{SUGGEST}, z AS (SELECT text AS term, coalesce(CASE WHEN text IN (SELECT term FROM ts) THEN text END, (SELECT suggestion FROM k WHERE k.text = ms.text AND rank = 1), text) AS corrected FROM ms) SELECT term, corrected FROM z")
def correct_queries(spark, sf):
    terms = misspelt(spark, sf).select("field", F.col("text").alias("term"))
    return M.correct_queries(index(spark, sf), terms).select("term", "corrected")
