"""Positional operators. Spans come from all words of every benchmark text, as many to a query as the operator takes; results are span rows."""

from pyspark.sql import functions as F

from gleanery.functions import spans as S
from gleanery.functions import tokens as T
from gleanery.functions.scoring import frequency
from gleanery.operators import positional as P
from gleanery.operators.clauses import hit_tasks
from gleanery.operators.phrases import phrase_words
from gleanery.operators.phrases import s_phrase as s_phrase_of

from .base import POSTINGS, check, index, r6, scored, std_tokens, table
from .combining import operand_terms, ordered

def base(n: int) -> str:
    return f"WITH {POSTINGS}, {ordered(n)}, " + ", ".join(
        f"s{i} AS (SELECT query_id, doc_id, pos AS a, pos AS b FROM qo JOIN tok USING (term) WHERE clause_id = {i})" for i in range(n)) + ", "


ROWS = "SELECT DISTINCT query_id, doc_id, a AS start, b AS \"end\" FROM "


def spans(spark, sf, i, n, tasks=None):
    t = operand_terms(spark, sf, n).filter(F.col("clause_id") == i)
    return P.term_spans(index(spark, sf), t, frequency, tasks).select(*P.COLUMNS)


def rows(df):
    return P.span_rows(df).select("query_id", "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def reg(name, sql, fn, ids=(0, 1)):
    @check(name, base(len(ids)) + sql)
    def run(spark, sf):
        tasks = hit_tasks(index(spark, sf), operand_terms(spark, sf, len(ids)))
        return rows(fn(*[spans(spark, sf, i, len(ids), tasks) for i in ids]))


NEAR = "n AS (SELECT x.query_id, x.doc_id, least(x.a, y.a) AS a, greatest(x.b, y.b) AS b FROM s0 x JOIN s1 y USING (query_id, doc_id) WHERE abs(y.a - x.a) BETWEEN 1 AND {slop} {order})"
reg("s_near", NEAR.format(slop=8, order="AND x.a <= y.a") + f" {ROWS} n", lambda a, b: P.s_near(a, b, slop=8))
reg("s_near_unordered", NEAR.format(slop=5, order="") + f" {ROWS} n", lambda a, b: P.s_near(a, b, slop=5, ordered=False))
reg("s_near_chain", "m AS (SELECT x.query_id, x.doc_id, x.a, y.b FROM s1 x JOIN s2 y USING (query_id, doc_id) WHERE y.a - x.a BETWEEN 1 AND 20), "
    f"n AS (SELECT x.query_id, x.doc_id, x.a, m.b FROM s0 x JOIN m USING (query_id, doc_id) WHERE m.a - x.b BETWEEN 1 AND 20) {ROWS} n", lambda a, b, c: P.s_near_chain([a, b, c], slop=20), (0, 1, 2))
reg("s_first", f"n AS (SELECT * FROM s0 WHERE b <= 20) {ROWS} n", lambda a: P.s_first(a, 20), (0,))
MERGED = ("o AS (SELECT *, max(b) OVER (PARTITION BY query_id, doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u), "
          "g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM o), "
          "n AS (SELECT query_id, doc_id, min(a) AS a, max(b) AS b FROM g GROUP BY query_id, doc_id, grp)")
reg("s_or", f"u AS (SELECT DISTINCT * FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)), {MERGED} {ROWS} n", lambda a, b, c: P.s_or(a, b, c), (0, 1, 2))
WIDE = NEAR.format(slop=30, order="AND x.a <= y.a").replace("n AS", "w AS")
reg("s_not", f"{WIDE}, n AS (SELECT DISTINCT * FROM w WHERE NOT EXISTS (SELECT 1 FROM s2 WHERE s2.query_id = w.query_id AND s2.doc_id = w.doc_id AND s2.a BETWEEN w.a AND w.b)) {ROWS} n",
    lambda a, b, c: P.s_not(P.s_near(a, b, slop=30), c), (0, 1, 2))
reg("s_contains", f"{WIDE}, n AS (SELECT DISTINCT * FROM w WHERE EXISTS (SELECT 1 FROM s2 WHERE s2.query_id = w.query_id AND s2.doc_id = w.doc_id AND s2.a BETWEEN w.a AND w.b)) {ROWS} n",
    lambda a, b, c: P.s_contains(P.s_near(a, b, slop=30), c), (0, 1, 2))
reg("s_before", f"f AS (SELECT query_id, doc_id, min(a) AS first FROM s1 GROUP BY ALL), n AS (SELECT s0.* FROM s0 JOIN f USING (query_id, doc_id) WHERE b < first) {ROWS} n", P.s_before)
reg("s_condition", f"n AS (SELECT * FROM s0 SEMI JOIN s1 USING (query_id, doc_id)) {ROWS} n", P.s_condition)
reg("s_merge", f"u AS (SELECT DISTINCT * FROM (SELECT * FROM s0 UNION ALL (SELECT x.query_id, x.doc_id, x.a, y.a FROM s0 x JOIN s1 y USING (query_id, doc_id) WHERE y.a - x.a BETWEEN 1 AND 8))), v AS (SELECT * FROM u WHERE b > a), "
    + MERGED.replace("FROM u", "FROM v") + f" {ROWS} n", lambda a, b: P.s_merge(P.s_near(a, b, slop=8)))

DIST = """m AS (SELECT x.query_id, x.doc_id, x.a AS xa, y.a AS ya FROM (SELECT query_id, doc_id, min(a) AS a FROM s0 GROUP BY ALL) x JOIN (SELECT query_id, doc_id, min(a) AS a FROM s1 GROUP BY ALL) y USING (query_id, doc_id))
SELECT query_id, doc_id, abs(xa - ya)::BIGINT AS distance, xa < ya AS before, xa > ya AS after, abs(xa - ya) = 1 AS touches, least(xa, ya)::BIGINT AS start, greatest(xa, ya)::BIGINT AS "end" FROM m"""


@check("s_distance", base(2) + DIST)
def s_distance(spark, sf):
    a, b = (spans(spark, sf, i, 2).select("query_id", "doc_id", F.col("spans")[0].alias(n)) for i, n in ((0, "x"), (1, "y")))
    x, y = F.col("x"), F.col("y")
    both = S.to(x, y)
    return a.join(b, ["query_id", "doc_id"]).select("query_id", "doc_id", S.distance_to(x, y).cast("long").alias("distance"), S.is_before(x, y).alias("before"), S.is_after(x, y).alias("after"),
                                                    S.touches(x, y).alias("touches"), both["start"].cast("long").alias("start"), both["end"].cast("long").alias("end"))


# Phrases: every run of two to five neighbouring words in the benchmark texts, each run once.
SIZES = (2, 3, 4, 5)
RUNS = std_tokens("bt", "benchmark", "item_id") + ", ph AS (" + " UNION ".join(
    f"SELECT ws FROM (SELECT list(term) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS ws FROM bt) WHERE len(ws) = {n}" for n in SIZES) + ")"
# Word by word: the places that each word can take after the one before it.
CHAIN = (f"WITH {scored()}, {RUNS}, r1 AS (SELECT ws, doc_id, pos AS start, pos AS stop FROM ph JOIN tok ON term = ws[1]), "
         + ", ".join(f"r{n} AS (SELECT DISTINCT ws, doc_id, start, tok.pos AS stop FROM r{n - 1} JOIN tok USING (doc_id) WHERE tok.term = ws[{n}] AND tok.pos BETWEEN stop + 1 AND stop + {{slop}})" for n in SIZES)
         + ", m AS (" + " UNION ALL ".join(f"SELECT * FROM r{n} WHERE len(ws) = {n}" for n in SIZES) + "), "
         "w AS (SELECT ws, term, count(*) AS times FROM (SELECT ws, unnest(ws) AS term FROM ph) GROUP BY ALL), "
         "s AS (SELECT ws, doc_id, sum(s * times) AS s FROM (SELECT DISTINCT ws, doc_id FROM m) JOIN w USING (ws) JOIN sc USING (term, doc_id) GROUP BY ALL) "
         "SELECT array_to_string(ws, ' ') AS query_id, doc_id, start, stop AS \"end\", round(s, 6) AS score FROM m JOIN s USING (ws, doc_id)")


def phrase_rows(spark, sf, slop):
    runs = F.flatten(F.array(*[T.chain(T.an_standard(), T.f_shingle(n, " "))(F.col("text"))["term"] for n in SIZES]))
    texts = table(spark, sf, "benchmark").select(F.explode(runs).alias("query_id")).distinct().withColumn("text", F.col("query_id"))
    out = P.span_rows(s_phrase_of(index(spark, sf), phrase_words(texts, T.tok_space, "text", slop=slop)))
    return out.select("query_id", "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), r6())


@check("s_phrase", CHAIN.replace("{slop}", "1"))
def s_phrase(spark, sf):
    return phrase_rows(spark, sf, 1)


@check("s_phrase_slop", CHAIN.replace("{slop}", "3"))
def s_phrase_slop(spark, sf):
    return phrase_rows(spark, sf, 3)
