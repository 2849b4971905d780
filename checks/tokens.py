"""Tokenizers, token filters and analyzers.

Token lists are compared as one row per text: number of tokens, sum of positions, and the md5 of all terms in order.
"""

from pyspark.sql import functions as F

from gleanery.functions import tokens as T
from gleanery.operators import lexicon as L
from gleanery.sources import readers as R

from .base import PATTERN, POSTINGS, STOP_SQL, STOPS, W, check, index, raw_tokens, std_tokens, table

DELIM_SQL = r"""[-_\x27"()!@#$%^&*\[\]{}<>|;:,./?`~=+\\]"""


def digest(df, key, tokens):
    t = df.select(F.col(key).alias("id"), tokens.alias("t")).filter(F.size("t") > 0)
    total = F.aggregate(F.col("t.pos"), F.lit(0).cast("long"), lambda a, x: a + x)
    return t.select("id", F.size("t").cast("long").alias("n"), total.alias("positions"), F.md5(F.array_join("t.term", " ")).alias("terms"))


def digest_sql(cte: str, name: str = "tok", key: str = "doc_id", order: str = "pos") -> str:
    return (f"WITH {cte} SELECT {key} AS id, count(*) AS n, sum(pos)::BIGINT AS positions, "
            f"md5(string_agg(term, ' ' ORDER BY {order})) AS terms FROM {name} GROUP BY {key}")


def listed(expr: str, source: str = "documents", key: str = "doc_id") -> str:
    """CTE tok(key, pos, term) from a SQL list expression."""
    return f"tok_w AS (SELECT {key}, {expr} AS ws FROM {source}), tok AS (SELECT {key}, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM tok_w)"


def docs(name, sql, fn):
    @check(name, sql)
    def run(spark, sf):
        return digest(table(spark, sf, "documents"), "doc_id", fn(F.col("text")))


def parts(name, sql, fn, column="p_name"):
    @check(name, sql)
    def run(spark, sf):
        return digest(table(spark, sf, "part"), "p_partkey", fn(F.col(column)))


# ---- tokenizers
parts("tok_id", "SELECT p_partkey AS id, 1::BIGINT AS n, 1::BIGINT AS positions, md5(p_name) AS terms FROM part", T.tok_id)
docs("tok_regex", digest_sql(raw_tokens("tok", "documents", lower=False)), T.tok_regex)
docs("tok_regex_gaps", digest_sql(listed(r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')")), T.tok_regex_gaps)
docs("tok_charset", digest_sql(listed("list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZéèê', 'abcdefghijklmnopqrstuvwxyzeee'), '[^a-z]+'), lambda x: x <> '')")),
     lambda c: T.tok_charset(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZéèê", "abcdefghijklmnopqrstuvwxyzeee"))
docs("tok_space", digest_sql(listed(r"regexp_extract_all(text, '[^ \t\r\n]+')")), T.tok_space)
docs("tok_comma", digest_sql(listed(r"list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '')")), T.tok_comma)
GRAMS = ("tok AS (SELECT {key}, i - 1 AS pos, s AS size, substr({col}, i, s) AS term FROM (SELECT {key}, {col}, unnest(generate_series(1, length({col}))) AS i FROM {src}) "
         "CROSS JOIN (SELECT unnest(generate_series({lo}, {hi})) AS s) WHERE i + s - 1 <= length({col}))")
parts("tok_ngram", digest_sql(GRAMS.format(key="p_partkey", col="p_name", src="part", lo=2, hi=4), key="p_partkey", order="pos, size"), lambda c: T.tok_ngram(c, 2, 4))


@check("tok_path", """WITH s AS (SELECT page_id, string_split(url, '/') AS ps FROM pages),
u AS (SELECT page_id, ps, unnest(generate_series(1, len(list_filter(ps, lambda x: x <> '')))) AS k FROM s)
SELECT page_id AS id, count(*) AS n, sum(k - 1)::BIGINT AS positions,
  md5(string_agg(array_to_string(list_slice(ps, 1, CASE WHEN k = 1 THEN 1 ELSE k + 1 END), '/'), ' ' ORDER BY k)) AS terms FROM u GROUP BY page_id""")
def tok_path(spark, sf):
    return digest(table(spark, sf, "pages"), "page_id", T.tok_path(F.col("url")))


# ---- filters
docs("f_lower", digest_sql(raw_tokens("tok", "documents")), T.chain(T.tok_regex, T.f_lower))
docs("f_strip", digest_sql(listed(r"list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', ''))")),
     T.chain(lambda c: T.tok_regex_gaps(c, "\n"), T.f_strip))
parts("f_reverse", digest_sql(listed("list_transform(string_split(p_name, ' '), lambda x: reverse(x))", "part", "p_partkey"), key="p_partkey"), T.chain(T.tok_space, T.f_reverse))
docs("f_stop", digest_sql(std_tokens("tok", "documents")), T.chain(T.tok_regex, T.f_lower, T.f_stop()))
docs("f_substitute", digest_sql(listed(rf"list_transform(regexp_extract_all(text, '{PATTERN}'), lambda x: regexp_replace(x, '[aeiou]+', '_', 'g'))")),
     T.chain(T.tok_regex, T.f_substitute("[aeiou]+", "_")))
LIGATURE_SQL = "replace(replace(replace(replace(strip_accents(lower(x)), 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss'), 'ø', 'o')"
docs("f_fold_accents", digest_sql(listed("list_transform(regexp_extract_all(text, '" + PATTERN + "'), lambda x: " + LIGATURE_SQL + ")")),
     T.chain(T.tok_regex, T.f_fold_accents))
docs("f_ngram", digest_sql(raw_tokens("r", "documents") + ", tok AS (SELECT doc_id, pos, s, substr(term, 1, s) AS term FROM r CROSS JOIN (SELECT unnest([2, 3, 4]) AS s) WHERE length(r.term) >= s)", order="pos, s"),
     T.chain(T.tok_regex, T.f_lower, T.f_ngram(2, 4, at="start")))


@check("f_intraword", r"""WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_brand || ' ' || p_type || ' Wi-Fi' || p_size || 'x O''Neil''s PowerShot', ' ') AS ws FROM part),
s AS (SELECT p_partkey, flatten(list_transform(ws, lambda x: list_filter(string_split(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(\pL)''[sS]($|DELIM)', '\1 \2', 'g'), 'DELIM+', ' ', 'g'),
  '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '([\p{Ll}\p{Lu}])(\p{Nd})', '\1 \2', 'g'), '(\p{Nd})([\p{Ll}\p{Lu}])', '\1 \2', 'g'), ' '), lambda y: y <> ''))) AS ws FROM w),
tok AS (SELECT p_partkey, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM s)
SELECT p_partkey AS id, count(*) AS n, sum(pos)::BIGINT AS positions, md5(string_agg(term, ' ' ORDER BY pos)) AS terms FROM tok GROUP BY p_partkey""".replace("DELIM", DELIM_SQL))
def f_intraword(spark, sf):
    p = table(spark, sf, "part").withColumn("t", F.concat("p_name", F.lit(" "), "p_brand", F.lit(" "), "p_type", F.lit(" Wi-Fi"), "p_size", F.lit("x O'Neil's PowerShot")))
    return digest(p, "p_partkey", T.chain(T.tok_space, T.f_intraword())(F.col("t")))


def shingles_sql(k: int, sep: str) -> str:
    parts_ = " || ".join(f"'{sep}' || t{i}" if i else "t0" for i in range(k))
    leads = ", ".join(f"lead(term, {i}) OVER w AS t{i}" for i in range(1, k))
    return (std_tokens("s", "documents") + f", l AS (SELECT doc_id, pos, term AS t0, {leads}, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), "
            f"tok AS (SELECT doc_id, pos, {parts_} AS term FROM l WHERE n >= {k} AND t{k - 1} IS NOT NULL "
            f"UNION ALL SELECT doc_id, min(pos), string_agg(term, '{sep}' ORDER BY pos) FROM s GROUP BY doc_id HAVING count(*) < {k})")


docs("f_biword", digest_sql(shingles_sql(2, "-")), T.chain(T.an_standard(), T.f_biword()))
docs("f_shingle", digest_sql(shingles_sql(3, " ")), T.chain(T.an_standard(), T.f_shingle(3, " ")))
docs("f_tee", digest_sql(raw_tokens("r", "documents", lower=False) + ", tok AS (SELECT doc_id, pos, 0 AS k, lower(term) AS term FROM r UNION ALL SELECT doc_id, pos, 1, reverse(term) FROM r)", order="pos, k"),
     T.chain(T.tok_regex, T.f_tee(T.f_lower, T.f_reverse)))
parts("f_by_mode", digest_sql("tok AS (SELECT p_partkey, i - 1 AS pos, substr(p_name, i, least(5, length(p_name))) AS term FROM (SELECT p_partkey, p_name, unnest(generate_series(1, length(p_name) - least(5, length(p_name)) + 1)) AS i FROM part))", key="p_partkey"),
      T.f_by_mode(lambda c: T.tok_ngram(c, 3, 5), lambda c: T.tok_ngram(c, 3, 5, query=True))("query"))


@check("f_term_boost", """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ') || [p_type || '^' || p_size]) AS t FROM part)
SELECT p_partkey AS id, string_split(t, '^')[1] AS term, coalesce(try_cast(string_split(t, '^')[2] AS DOUBLE), 1.0) AS boost FROM w""")
def f_term_boost(spark, sf):
    p = table(spark, sf, "part").withColumn("t", F.concat("p_name", F.lit(" "), "p_type", F.lit("^"), "p_size"))
    return p.select(F.col("p_partkey").alias("id"), F.explode(T.chain(T.tok_space, T.f_term_boost())(F.col("t"))).alias("x")).select("id", "x.term", "x.boost")


@check("f_boost_pattern", """SELECT p_partkey AS id, p_type AS term, p_size::DOUBLE AS boost FROM part""")
def f_boost_pattern(spark, sf):
    p = table(spark, sf, "part").withColumn("t", F.concat("p_size", F.lit("*"), "p_type"))
    return p.select(F.col("p_partkey").alias("id"), F.explode(T.chain(T.tok_space, T.f_boost_pattern(r"(\d+)\*"))(F.col("t"))).alias("x")).select("id", "x.term", "x.boost")


# ---- analyzers
docs("an_keyword", digest_sql(listed(r"list_transform(regexp_extract_all(text, '[^ \t\r\n]+'), lambda x: lower(x))")), T.an_keyword(lowercase=True))
docs("an_simple", digest_sql(raw_tokens("tok", "documents")), T.an_simple())
docs("an_standard", digest_sql(std_tokens("tok", "documents")), T.an_standard())
parts("an_ngram", digest_sql(GRAMS.format(key="p_partkey", col="lower(p_name)", src="part", lo=3, hi=5).replace("SELECT p_partkey, lower(p_name), ", "SELECT p_partkey, p_name, "), key="p_partkey", order="pos, size"), T.an_ngram(3, 5))
parts("an_ngram_words", digest_sql("w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS ws FROM part), r AS (SELECT p_partkey, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM w), "
      "tok AS (SELECT p_partkey, pos, i, s, substr(w, i, s) AS term FROM (SELECT *, unnest(generate_series(1, length(w))) AS i FROM r) CROSS JOIN (SELECT unnest([3, 4]) AS s) WHERE i + s - 1 <= length(w))", key="p_partkey", order="pos, i, s"),
      T.an_ngram_words(3, 4))
parts("an_id", "SELECT p_partkey AS id, 1::BIGINT AS n, 1::BIGINT AS positions, md5(lower(p_type)) AS terms FROM part", T.an_id(lowercase=True), "p_type")
parts("an_regex", digest_sql(listed("list_filter(regexp_split_to_array(p_name, '[aeiou]+'), lambda x: x <> '')", "part", "p_partkey"), key="p_partkey"), T.an_regex("[aeiou]+", gaps=True))

FANCY = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, flatten(list_transform(ws, lambda x: list_filter(string_split(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(\pL)''[sS]($|DELIM)', '\1 \2', 'g'), 'DELIM+', ' ', 'g'),
  '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '([\p{Ll}\p{Lu}])(\p{Nd})', '\1 \2', 'g'), '(\p{Nd})([\p{Ll}\p{Lu}])', '\1 \2', 'g'), ' '), lambda y: y <> ''))) AS ws FROM w),
r AS (SELECT doc_id, lower(unnest(ws)) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM s),
tok AS (SELECT doc_id, term, min(pos) OVER (PARTITION BY doc_id) + row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos FROM r WHERE length(term) >= 2 AND term NOT IN (STOPS))
SELECT doc_id AS id, count(*) AS n, sum(pos)::BIGINT AS positions, md5(string_agg(term, ' ' ORDER BY pos)) AS terms FROM tok GROUP BY doc_id""".replace("DELIM", DELIM_SQL).replace("STOPS", STOP_SQL)
docs("an_fancy", FANCY, T.an_fancy())


# ---- lexicon jobs
@check("lex_stem")
def lex_stem_query(spark, sf):
    return L.lex_stem(index(spark, sf).lexicon.filter("field = 'text'"), ignore=STOPS)


@check("an_stemming")
def an_stemming(spark, sf):
    tok = table(spark, sf, "documents").select("doc_id", F.explode(T.an_standard()(F.col("text"))).alias("t")).select("doc_id", "t.pos", "t.term")
    return L.an_stemming(tok).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@check("lex_variations")
def lex_variations(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(T.an_standard()(F.col("text"))).alias("t")).select(F.col("t.term").alias("word"))
    return L.lex_variations(words, index(spark, sf).lexicon.filter("field = 'text'"))


@check("lex_soundex", f"""WITH {std_tokens("tok", "documents")}, t AS (SELECT DISTINCT term, regexp_replace(lower(term), '[^a-z]', '', 'g') AS l FROM tok),
c AS (SELECT term, l, list_transform(string_split(translate(l, 'abcdefghijklmnopqrstuvwxyz', '01230120022455012623010202'), ''), lambda x: x) AS ds FROM t)
SELECT term, CASE WHEN l = '' THEN '' ELSE l[1] || substr(array_to_string(list_filter(ds, lambda d, i: i = 1 OR ds[i] <> ds[i - 1]), ''), 2) END AS code FROM c""")
def lex_soundex_query(spark, sf):
    return L.lex_soundex(index(spark, sf).lexicon.filter("field = 'text'"))


@check("lex_metaphone")
def lex_metaphone(spark, sf):
    return L.lex_metaphone(index(spark, sf).lexicon.filter("field = 'text'"))


SYNSETS_SQL = "syn AS (SELECT DISTINCT p_size AS synset, unnest(string_split(p_name, ' ')) AS word FROM part)"


@check("expand_synonyms", f"""WITH {SYNSETS_SQL} SELECT DISTINCT a.word, b.word AS synonym FROM syn a JOIN syn b USING (synset) WHERE a.word <> b.word""")
def expand_synonyms(spark, sf):
    p = table(spark, sf, "part")
    syn = p.select(F.col("p_size").alias("synset"), F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return L.expand_synonyms(syn, syn.select("word").distinct())


# A term is cut by what is left of it after each word, shortest word first; what cannot be used up is given up.
@check("f_compound", f"""WITH {POSTINGS}, {std_tokens("bt", "benchmark", "item_id")}, dict AS (SELECT DISTINCT term AS w FROM bt), dl2 AS (SELECT DISTINCT length(w) AS n FROM dict),
lex AS (SELECT DISTINCT term FROM p),
spots AS (SELECT term, i AS k, n FROM lex, dl2, unnest(range(length(term))) u(i) WHERE i + n <= length(term) AND substr(term, i + 1, n) IN (SELECT w FROM dict)),
good AS (WITH RECURSIVE g(term, k) AS (SELECT term, length(term)::BIGINT FROM lex UNION SELECT s.term, s.k FROM spots s JOIN g ON g.term = s.term AND s.k + s.n = g.k) SELECT * FROM g),
nxt AS (SELECT s.term, s.k, min(s.n) AS n FROM spots s JOIN good g ON g.term = s.term AND g.k = s.k + s.n GROUP BY ALL),
walk AS (WITH RECURSIVE w(term, k, n, no) AS (SELECT term, k, n, 1 FROM nxt WHERE k = 0 UNION ALL SELECT x.term, x.k, x.n, w.no + 1 FROM w JOIN nxt x ON x.term = w.term AND x.k = w.k + w.n) SELECT * FROM w),
many AS (SELECT term FROM walk GROUP BY term HAVING count(*) > 1)
SELECT term, no AS part_no, substr(term, k + 1, n) AS part FROM walk WHERE term IN (SELECT term FROM many) UNION ALL SELECT term, 0, term FROM many""")
def f_compound(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(T.an_standard()(F.col("text"))).alias("t")).select("t.term").distinct()
    return L.f_compound(index(spark, sf).lexicon.filter("field = 'text'"), words)


# Blocks that the texts' languages use, apart from the operator's own table.
@check("block_profile", "WITH c AS (SELECT unicode(ch) AS u FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '') SELECT CASE WHEN u < 128 THEN 'Basic Latin' "
       "WHEN u < 256 THEN 'Latin-1 Supplement' WHEN u < 384 THEN 'Latin Extended-A' WHEN u BETWEEN 8192 AND 8303 THEN 'General Punctuation' END AS block, count(*) AS n FROM c GROUP BY 1")
def block_profile(spark, sf):
    return L.block_profile(table(spark, sf, "documents"))


# ---- sources
@check("scan_corpus", "SELECT doc_id, lang, source, n_chars FROM documents")
def scan_corpus(spark, sf):
    return R.scan_corpus(spark, f"{sf}/documents.parquet", ["doc_id", "lang", "source", "n_chars"])


@check("load_dictionary", r"WITH l AS (SELECT unnest(string_split(text, chr(10))) AS v FROM documents), t AS (SELECT lower(regexp_replace(regexp_replace(v, '^\s+', ''), '\s+$', '')) AS term FROM l) SELECT DISTINCT term FROM t WHERE length(term) > 1")
def load_dictionary(spark, sf):
    return R.dictionary_terms(table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value")))


@check("load_synonyms", r"""WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ') || [p_brand, p_name]) AS word FROM part) SELECT DISTINCT p_partkey AS synset, lower(word) AS word FROM w WHERE regexp_matches(word, '^\pL+$')""")
def load_synonyms(spark, sf):
    p = table(spark, sf, "part")
    words = p.select("p_partkey", F.explode(F.concat(F.split("p_name", " "), F.array("p_brand", "p_name"))).alias("w"))
    lines = words.select(F.concat(F.lit("s("), "p_partkey", F.lit(",1,'"), "w", F.lit("',n,1,1).")).alias("value")) \
        .union(p.select(F.concat(F.lit("g("), "p_partkey", F.lit(",'x').")).alias("value")))
    return R.synonym_rows(lines)


@check("read_change_feed", """SELECT 'updateDoc' AS action, 'job' AS name, o_orderkey AS "keyID", 0::BIGINT AS item, o_orderkey::VARCHAR AS jobid, o_custkey::VARCHAR AS orgid, o_orderpriority AS jobname, o_orderstatus AS description, '0' AS ishunterjob FROM orders
UNION ALL SELECT 'removeDoc', 'job', o_orderkey, 0, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderstatus = 'F'""")
def read_change_feed(spark, sf):
    o = table(spark, sf, "orders")
    up = F.format_string("""{"action":"updateDoc","name":"job","keyID":%d,"fields":[{"jobid":%d,"orgid":%d,"jobname":"%s","description":"%s","ishunterjob":''}]}""",
                         "o_orderkey", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    rm = F.format_string("""{"action":"removeDoc","name":"job","keyID":"%d"}""", "o_orderkey")
    rows = R.read_change_feed(o.select(up.alias("value")).union(o.filter("o_orderstatus = 'F'").select(rm.alias("value"))))
    text = [F.col(c).cast("string").alias(c) for c in ("jobid", "orgid", "ishunterjob")]
    return rows.select("action", "name", "keyID", F.col("item").cast("long").alias("item"), "jobname", "description", *text)


# Messages with every attribute of a job, a list, and one attribute that no schema names; with several elements in ``fields``.
FULL = {"jobid": "l_orderkey * 10 + l_linenumber", "jobsnapid": "l_partkey", "jobname": "'job ' || l_linestatus", "degreecode": "l_linenumber", "jobtypecode": "1", "orgid": "l_suppkey", "orgname": "'org ' || l_suppkey",
        "orgflag": "0", "workexperience": "l_linenumber % 5", "description": "l_returnflag || ' \u4e2d\u6587'", "salaryrangecode": "1300", "PublishTime": "'2013-05-31T17:29:39'", "refreshtime": "'2013-06-14T11:09:06'",
        "orderdate": "'2013-06-14T11:09:06'", "companytype": "0", "companymemsize": "0", "jobaddress": "'110000#110100'", "businesstags": "'4003#games'", "jobcategorys": "'1004'", "ishunterjob": "l_linenumber % 4",
        "score": "100", "ownersys": "0"}
NUMBERS = [c for c, kind in R.JOB_ATTRIBUTES.items() if kind != "string"]


@check("read_change_feed_full", "SELECT 'updateDoc' AS action, l_orderkey AS \"keyID\", " + ", ".join(f"CAST({v} AS {'VARCHAR' if c not in NUMBERS else 'DOUBLE'}) AS \"{c}\"" for c, v in FULL.items())
       + ", '[\"a\",' || l_linenumber || ']' AS skillsmap, 'x' || l_linenumber AS other, 24::BIGINT AS n FROM lineitem")
def read_change_feed_full(spark, sf):
    li = table(spark, sf, "lineitem")
    job = F.struct(*[F.expr(v).alias(c) for c, v in FULL.items()], F.array(F.lit("a")).alias("skillsmap"), F.concat(F.lit("x"), "l_linenumber").alias("other"))
    # The list holds a text and a number, which no array type does.
    told = F.replace(F.to_json(job), F.lit('["a"]'), F.concat(F.lit('["a",'), "l_linenumber", F.lit("]")))
    orders = li.select("l_orderkey", told.alias("j")).groupBy("l_orderkey").agg(F.array_join(F.collect_list("j"), ",").alias("js"))
    messages = orders.select(F.concat(F.lit('{"action":"updateDoc","name":"job","keyID":'), "l_orderkey", F.lit(',"fields":['), "js", F.lit("]}")).alias("value"))
    rows = R.read_change_feed(messages)
    cols = [F.col(c).cast("double" if c in NUMBERS else "string").alias(c) for c in FULL]
    return rows.select("action", "keyID", *cols, "skillsmap", F.col("attributes")["other"].alias("other"), F.size("attributes").cast("long").alias("n"))


@check("html_to_text", "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS body FROM pages")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(R.html_to_text(F.col("html"))).alias("body"))
