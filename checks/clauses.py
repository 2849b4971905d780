"""Query clauses."""

from pyspark.sql import functions as F

from gleanery.functions import dates as D
from gleanery.functions import tokens as T
from gleanery.functions.scoring import tf_idf
from gleanery.joins import lookup_join, range_join
from gleanery.operators import clauses as C
from gleanery.operators import combine as H
from gleanery.operators.groups import q_multitoken as multitoken_of
from gleanery.operators.groups import word_tokens
from gleanery.operators.index import Field, SearchIndex

from .base import POSTINGS, QUERY_TERMS, ascii, check, index, r6, scored, std_tokens, table

CLAUSE_SCHEMA = "query_id long, clause_id int, field string, text string"


def benchmark_terms(spark, sf):
    return C.query_terms(table(spark, sf, "benchmark"), T.an_standard(), "text", key="item_id")


def words(spark, sf, cut):
    """Clauses derived from every word of every benchmark text."""
    each = benchmark_terms(spark, sf).select("query_id", "clause_id", "field", cut(F.col("term")).alias("text"))
    # What a query asks for twice is one clause.
    return each.groupBy("query_id", "field", "text").agg(F.min("clause_id").alias("clause_id")).select("query_id", "clause_id", "field", "text")


FIRST = QUERY_TERMS + ", f1 AS (SELECT query_id, term FROM qt)"


@check("q_term", f"WITH {scored()}, {QUERY_TERMS} SELECT query_id, term, doc_id, round(s, 6) AS score FROM qt JOIN sc USING (term)")
def q_term(spark, sf):
    t = benchmark_terms(spark, sf)
    hits = C.match(index(spark, sf), t.withColumn("word", F.col("term")))
    return hits.select("query_id", F.col("word").alias("term"), "doc_id", r6())


CONST = "SELECT DISTINCT query_id, doc_id, 1.0::DOUBLE AS score FROM x JOIN p USING (term)"


def const(hits):
    return H.any_of(hits).select("query_id", "doc_id", F.lit(1.0).alias("score"))


@check("q_prefix", f"WITH {POSTINGS}, {FIRST}, x AS (SELECT query_id, ts.term FROM f1 JOIN ts ON starts_with(ts.term, substr(f1.term, 1, 4))) {CONST}")
def q_prefix(spark, sf):
    return const(C.q_prefix(index(spark, sf), words(spark, sf, lambda t: F.substring(t, 1, 4))))


@check("q_wildcard", f"WITH {POSTINGS}, {FIRST}, pre AS MATERIALIZED (SELECT query_id, f1.term AS w, ts.term FROM f1 JOIN ts ON substr(ts.term, 1, 2) = substr(f1.term, 1, 2)), x AS (SELECT query_id, term FROM pre WHERE regexp_full_match(term, substr(w, 1, 2) || '.*' || substr(w, 3, 1) || '.')) {CONST}")
def q_wildcard(spark, sf):
    return const(C.q_wildcard(index(spark, sf), words(spark, sf, lambda t: F.concat(F.substring(t, 1, 2), F.lit("*"), F.substring(t, 3, 1), F.lit("?")))))


@check("q_regex", f"WITH {POSTINGS}, {FIRST}, pre AS MATERIALIZED (SELECT query_id, f1.term AS w, ts.term FROM f1 JOIN ts ON substr(ts.term, 1, 2) = substr(f1.term, 1, 2)), x AS (SELECT query_id, term FROM pre WHERE regexp_matches(term, '^(?:' || substr(w, 1, 2) || '[aeiou]+n)')) {CONST}")
def q_regex(spark, sf):
    return const(C.q_regex(index(spark, sf), words(spark, sf, lambda t: F.concat(F.substring(t, 1, 2), F.lit("[aeiou]+n")))))


# Patterns that start with anything, of all words: their last three letters, their second letter.
OPEN = "x AS (SELECT DISTINCT query_id, ts.term FROM f1 JOIN ts ON {on})"


@check("q_wildcard_end", f"WITH {POSTINGS}, {FIRST}, {OPEN.format(on='ends_with(ts.term, right(f1.term, 3))')} {CONST}")
def q_wildcard_end(spark, sf):
    return const(C.q_wildcard(index(spark, sf), words(spark, sf, lambda t: F.concat(F.lit("*"), F.right(t, F.lit(3))))))


@check("q_wildcard_second", f"WITH {POSTINGS}, {FIRST}, {OPEN.format(on='substr(ts.term, 2, 1) = substr(f1.term, 2, 1)')} {CONST}")
def q_wildcard_second(spark, sf):
    return const(C.q_wildcard(index(spark, sf), words(spark, sf, lambda t: F.concat(F.lit("?"), F.substring(t, 2, 1), F.lit("*")))))


@check("q_regex_end", f"WITH {POSTINGS}, {FIRST}, {OPEN.format(on='contains(ts.term, right(f1.term, 4))')} {CONST}")
def q_regex_end(spark, sf):
    return const(C.q_regex(index(spark, sf), words(spark, sf, lambda t: F.concat(F.lit(".*"), F.right(t, F.lit(4))))))


@check("q_fuzzy", f"""WITH {POSTINGS}, {FIRST}, x AS (SELECT query_id, ts.term FROM f1 JOIN ts ON substr(ts.term, 1, 1) = substr(f1.term, 1, 1)
AND abs(length(ts.term) - length(f1.term)) <= 1 AND damerau_levenshtein({ascii('ts.term')}, {ascii('f1.term')}) <= 1) {CONST}""")
def q_fuzzy(spark, sf):
    return const(C.q_fuzzy(index(spark, sf), words(spark, sf, lambda t: t), maxdist=1, prefixlength=1))


@check("q_variations")
def q_variations(spark, sf):
    from gleanery.operators.lexicon import lex_variations
    t = benchmark_terms(spark, sf)
    idx = index(spark, sf)
    v = lex_variations(t.select(F.col("term").alias("word")), idx.lexicon.filter("field = 'text'"))
    x = t.join(v, t["term"] == v["word"]).select("query_id", "clause_id", "field", F.col("variant").alias("term"), "boost")
    return const(C.constant_hits(idx, x))


@check("q_term_range", f"WITH {POSTINGS}, {FIRST}, x AS (SELECT query_id, ts.term FROM f1 JOIN ts ON ts.term > f1.term AND ts.term <= f1.term || 'zz') {CONST}")
def q_term_range(spark, sf):
    c = words(spark, sf, lambda t: t).withColumnRenamed("text", "start").withColumn("end", F.concat("start", F.lit("zz"))) \
        .withColumn("startexcl", F.lit(True)).withColumn("endexcl", F.lit(False))
    return const(C.q_term_range(index(spark, sf), c))


@check("q_numeric_range", "SELECT l_orderkey, l_linenumber, l_quantity, 1.0::DOUBLE AS score FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20")
def q_numeric_range(spark, sf):
    return C.q_numeric_range(table(spark, sf, "lineitem"), "l_quantity", 10, 20, hi_open=True).select("l_orderkey", "l_linenumber", "l_quantity", "score")


@check("q_date_range", "SELECT event_id, ts, 1.0::DOUBLE AS score FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10'")
def q_date_range(spark, sf):
    from datetime import datetime
    return C.q_date_range(table(spark, sf, "events"), "ts", datetime(2024, 1, 3), datetime(2024, 1, 10), hi_open=True).select("event_id", "ts", "score")


@check("q_date_text", """WITH d AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d %H') AS t, date_trunc('hour', ts) AS lo, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hi FROM events
UNION SELECT DISTINCT strftime(ts, '%Y%m%d'), date_trunc('day', ts), date_trunc('day', ts) + INTERVAL 1 DAY FROM events UNION SELECT DISTINCT strftime(ts, '%Y.%m'), date_trunc('month', ts), date_trunc('month', ts) + INTERVAL 1 MONTH FROM events)
SELECT t AS date, lo, hi - INTERVAL 1 MICROSECOND AS hi, (SELECT count(*) FROM events e WHERE e.ts >= d.lo AND e.ts < d.hi) AS n FROM d""")
def q_date_text(spark, sf):
    e = table(spark, sf, "events")
    texts = e.select(F.explode(F.array(*[F.date_format("ts", f) for f in ("yyyy-MM-dd HH", "yyyyMMdd", "yyyy.MM")])).alias("date")).distinct()
    spans = texts.select("date", D.date_floor(F.col("date")).alias("lo"), D.date_ceil(F.col("date")).alias("hi"))
    secs = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(f"_{c}")
    points = e.select("ts", secs("ts"))
    ranges = spans.select("*", secs("lo"), secs("hi"))
    hit = range_join(points, "_ts", ranges, "_lo", "_hi", (F.col("_ts") >= F.col("_lo")) & (F.col("_ts") <= F.col("_hi")))
    return hit.groupBy("date", "lo", "hi").agg(F.count("*").alias("n"))


@check("q_boolean", "SELECT o_orderkey FROM orders WHERE lower(CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'T' ELSE 'no' END) IN ('t', 'true', 'yes', '1')")
def q_boolean(spark, sf):
    o = table(spark, sf, "orders").withColumn("flag", F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "T").otherwise("no"))
    return C.q_boolean(o, "flag").select("o_orderkey")


@check("q_every", f"WITH {POSTINGS} SELECT 'all' AS kind, doc_id, 1.0::DOUBLE AS score FROM documents UNION ALL SELECT 'text', doc_id, 2.0 FROM dl")
def q_every(spark, sf):
    idx = index(spark, sf)
    return C.q_every(idx).select(F.lit("all").alias("kind"), "doc_id", "score").union(C.q_every(idx, "text", 2.0).select(F.lit("text").alias("kind"), "doc_id", "score"))


@check("q_null", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE false")
def q_null(spark, sf):
    return C.q_null(index(spark, sf)).select("doc_id", "score")


@check("q_constant", f"WITH {POSTINGS}, {QUERY_TERMS} SELECT DISTINCT query_id, doc_id, 2.5::DOUBLE AS score FROM qt JOIN p USING (term)")
def q_constant(spark, sf):
    return C.q_constant(H.any_of(C.match(index(spark, sf), benchmark_terms(spark, sf))), 2.5)


@check("q_reweighted", f"WITH {scored('tf * (ln(n / (df + 1)) + 1)')}, {QUERY_TERMS} SELECT query_id, doc_id, round(sum(s), 6) AS score FROM qt JOIN sc USING (term) GROUP BY ALL")
def q_reweighted(spark, sf):
    return H.any_of(C.match(index(spark, sf), benchmark_terms(spark, sf), tf_idf)).select("query_id", "doc_id", r6())


@check("q_comparison", "SELECT '>' AS op, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem WHERE l_discount > 0.05 UNION ALL SELECT '<=', count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE l_discount <= 0.05")
def q_comparison(spark, sf):
    li = table(spark, sf, "lineitem")
    one = lambda op: C.q_comparison(li, "l_discount", op, 0.05).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys")).select(F.lit(op).alias("op"), "n", "keys")
    return one(">").union(one("<="))


NGRAM_SQL = """WITH g AS (SELECT p_partkey AS doc_id, unnest(generate_series(1, length(p_name) - 2)) AS i, p_name FROM part), p AS (SELECT DISTINCT doc_id, substr(p_name, i, 3) AS term FROM g),
q AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS w FROM part), qg AS (SELECT w, substr(w, unnest(generate_series(1, length(w) - 2)), 3) AS term FROM q WHERE length(w) >= 3),
n AS (SELECT w, count(DISTINCT term) AS need FROM qg GROUP BY w)
SELECT w AS query_id, doc_id, count(DISTINCT term) AS grams FROM qg JOIN p USING (term) JOIN n USING (w) GROUP BY w, doc_id, need HAVING count(DISTINCT term) = need"""


@check("q_ngram", NGRAM_SQL)
def q_ngram(spark, sf):
    p = table(spark, sf, "part")
    idx = SearchIndex.build(p, [Field("p_name", lambda c: T.tok_ngram(c, 3))], "p_partkey")
    q = p.select(F.split("p_name", " ")[0].alias("query_id")).distinct().withColumn("text", F.col("query_id")).filter("length(text) >= 3")
    terms = C.query_terms(q, lambda c: T.tok_ngram(c, 3, query=True), "p_name")
    hits = C.constant_hits(idx, H.clause_counts(terms).drop("n_clauses"))
    n = H.clause_counts(terms).select("query_id", "n_clauses").distinct()
    return H.all_of(hits.join(n, "query_id")).select("query_id", "doc_id", F.col("score").cast("long").alias("grams"))


@check("existing_terms", f"WITH {POSTINGS}, {QUERY_TERMS} SELECT query_id, term, term IN (SELECT term FROM ts) AS known FROM qt")
def existing_terms(spark, sf):
    idx, t = index(spark, sf), benchmark_terms(spark, sf)
    yes = C.existing_terms(idx, t).select("query_id", "term", F.lit(True).alias("known"))
    return yes.union(C.existing_terms(idx, t, reverse=True).select("query_id", "term", F.lit(False).alias("known")))


@check("estimate_hits", f"WITH {POSTINGS}, {QUERY_TERMS} SELECT query_id, least(sum(coalesce(df, 0))::BIGINT, (SELECT n FROM fs)::BIGINT) AS or_estimate, min(coalesce(df, 0)) AS and_estimate FROM qt LEFT JOIN ts USING (term) GROUP BY query_id")
def estimate_hits(spark, sf):
    return C.estimate_hits(index(spark, sf), benchmark_terms(spark, sf))


# Words of several tokens: every second blank of every benchmark text becomes a hyphen, which the analyzer cuts at.
GLUED = r"([^ \t\r\n]+)[ \t\r\n]+([^ \t\r\n]+)"
PAIRS = (f"gw AS (SELECT item_id AS query_id, unnest(regexp_extract_all(regexp_replace(text, '{GLUED}', '\\1-\\2', 'g'), '[^ \\t\\r\\n]+')) AS w, "
         f"generate_subscripts(regexp_extract_all(regexp_replace(text, '{GLUED}', '\\1-\\2', 'g'), '[^ \\t\\r\\n]+'), 1) - 1 AS clause_id FROM benchmark), "
         + std_tokens("gt", "(SELECT query_id * 100000 + clause_id AS wid, w FROM gw)", "wid", "w")
         + ", g1 AS (SELECT wid, term, row_number() OVER (PARTITION BY wid ORDER BY pos) AS i, count(*) OVER (PARTITION BY wid) AS n FROM gt)"
         ", g AS (SELECT wid // 100000 AS query_id, wid % 100000 AS clause_id, term, i, n FROM g1)"
         ", gh AS (SELECT query_id, clause_id, doc_id, sum(s) AS s, count(*) AS got, any_value(n) AS n, bool_or(i = 1) AS has_first, sum(s) FILTER (i = 1) AS s1 FROM g JOIN sc USING (term) GROUP BY ALL)")
NEXT = ("nx AS (SELECT a.query_id, a.clause_id, x.doc_id FROM g a JOIN g b ON a.query_id = b.query_id AND a.clause_id = b.clause_id AND a.i = 1 AND b.i = 2 AND a.n = 2 "
        "JOIN tok x ON x.term = a.term JOIN tok y ON y.doc_id = x.doc_id AND y.term = b.term AND y.pos = x.pos + 1 GROUP BY ALL)")
WORD_HITS = {
    "first": "SELECT query_id, clause_id, doc_id, s1 AS s FROM gh WHERE has_first",
    "and": "SELECT query_id, clause_id, doc_id, s FROM gh WHERE got = n",
    "or": "SELECT query_id, clause_id, doc_id, s FROM gh",
    "phrase": "SELECT query_id, clause_id, doc_id, s FROM gh WHERE n = 1 OR (query_id, clause_id, doc_id) IN (SELECT query_id, clause_id, doc_id FROM nx)",
}


def glued_words(spark, sf, rule):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_replace("text", GLUED, "$1-$2").alias("text"))
    return word_tokens(b, T.an_standard(), "text", rule)


def multitoken(name, rule):
    extra = f", {NEXT}" if rule == "phrase" else ""

    @check(name, f"WITH {scored()}, {PAIRS}{extra}, h AS ({WORD_HITS[rule]}) SELECT query_id, doc_id, count(*) AS words, round(sum(s), 6) AS score FROM h GROUP BY ALL")
    def run(spark, sf):
        hits = multitoken_of(index(spark, sf), glued_words(spark, sf, rule))
        return hits.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("words"), r6_sum())


def r6_sum():
    return F.round(F.sum("score"), 6).alias("score")


multitoken("q_multitoken", "first")
multitoken("q_multitoken_and", "and")
multitoken("q_multitoken_or", "or")
multitoken("q_multitoken_phrase", "phrase")


# The rule of the queries themselves: all tokens of a word, and then all words of a text.
@check("q_multitoken_default", f"WITH {scored()}, {PAIRS}, h AS ({WORD_HITS['and']}), need AS (SELECT query_id, count(DISTINCT clause_id) AS need FROM g GROUP BY query_id) "
       "SELECT query_id, doc_id, round(sum(s), 6) AS score FROM h JOIN need USING (query_id) GROUP BY query_id, doc_id, need HAVING count(*) = need")
def q_multitoken_default(spark, sf):
    words = glued_words(spark, sf, "default")
    hits = multitoken_of(index(spark, sf), words, group="and")
    n = words.groupBy("query_id").agg(F.count_distinct("clause_id").alias("n_clauses"))
    return H.all_of(lookup_join(hits, n, ["query_id"])).select("query_id", "doc_id", r6())


@check("q_field_alias", f"WITH {POSTINGS}, {QUERY_TERMS} SELECT query_id, doc_id, count(*) AS n FROM qt JOIN p USING (term) GROUP BY ALL")
def q_field_alias(spark, sf):
    t = benchmark_terms(spark, sf).withColumn("field", F.lit("body"))
    return C.match(index(spark, sf), C.q_field_alias(t, {"body": "text"})).groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))


@check("q_copy_field", "SELECT 'q' || n_nationkey AS query_id, doc_id, 1.0::DOUBLE AS score FROM nation, documents WHERE lang = 'fr' AND n_nationkey = 0 OR source = 'src' || n_nationkey")
def q_copy_field(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("q"), "n_nationkey").alias("query_id"), F.lit(0).alias("clause_id"), F.lit("lang").alias("field"),
                                          F.explode(F.array(F.when(F.col("n_nationkey") == 0, "fr").otherwise(""), F.concat(F.lit("src"), "n_nationkey"))).alias("term"))
    return H.any_of(C.constant_hits(index(spark, sf), C.q_copy_field(n, {"lang": "source"})))


@check("q_relative_weekday", """SELECT event_id, (ts::DATE + ((8 - isodow(ts) - 1) % 7 + 1)::INTEGER)::VARCHAR AS next_monday, (ts::DATE - ((isodow(ts) + 5) % 7 + 1)::INTEGER)::VARCHAR AS last_monday FROM events""")
def q_relative_weekday(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", D.relative_weekday(F.col("ts"), "Mon", 1).cast("string").alias("next_monday"), D.relative_weekday(F.col("ts"), "Mon", -1).cast("string").alias("last_monday"))
