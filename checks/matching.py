"""Dictionary matching, snippets, and the service's queries."""

from pyspark.sql import functions as F

from gleanery.functions import tokens as T
from gleanery.operators import dictionary as Di
from gleanery.operators import snippets as Sn
from gleanery.plans import service as Sv
from gleanery.sources.readers import html_to_text

from .base import TAG_FIELDS, check, index, raw_tokens, table
from .clauses import benchmark_terms
from .scores import HITS, hits

# The dictionary: all words of the benchmark texts, and all pairs of neighbours in them.
DICT = raw_tokens("bt", "benchmark", "item_id") + (", bl AS (SELECT item_id, term, pos, lead(term) OVER (PARTITION BY item_id ORDER BY pos) AS nxt FROM bt), "
       "dict AS (SELECT DISTINCT term FROM bt WHERE length(term) > 1 UNION SELECT DISTINCT term || ' ' || nxt FROM bl WHERE nxt IS NOT NULL)")


def dictionary(spark, sf):
    tok = table(spark, sf, "benchmark").select(T.an_simple()(F.col("text")).alias("t"))
    both = F.concat(F.transform("t", lambda x: x["term"]), F.transform(T.f_shingle(2, " ")(F.col("t")), lambda x: x["term"]))
    return tok.select(F.explode(both).alias("term")).filter("length(term) > 1").distinct()


def occurrences(source: str, key: str, text: str) -> str:
    """CTE m(id, pos, term): every dictionary term at every place where it does not touch a letter or digit of ASCII.

    Texts are cut into runs of characters a term can hold, so that places are looked at in short strings.
    """
    return (f"src AS (SELECT {key} AS id, regexp_extract_all({text}, '[\\pL\\pN_. ]+|[^\\pL\\pN_. ]+') AS ps FROM {source}), "
            "pcs AS (SELECT id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM src), "
            "lo AS (SELECT id, piece, sum(length(piece)) OVER (PARTITION BY id ORDER BY k) - length(piece) AS off FROM pcs), "
            "st AS (SELECT id, off, piece, unnest(generate_series(1, length(piece))) AS i FROM lo WHERE regexp_matches(piece, '[\\pL\\pN_. ]')), "
            "ok AS (SELECT id, (off + i - 1)::BIGINT AS pos, substr(piece, i, 60) AS win FROM st WHERE NOT (i > 1 AND regexp_matches(substr(piece, i - 1, 2), '^[A-Za-z0-9]{2}'))), "
            "ln AS (SELECT DISTINCT length(term) AS n FROM dict), "
            "cut AS (SELECT id, pos, n, substr(win, 1, n) AS term, substr(win, n + 1, 1) AS nxt FROM ok CROSS JOIN ln WHERE length(win) >= n), "
            "m AS (SELECT id, pos, term FROM cut SEMI JOIN dict USING (term) WHERE NOT (regexp_matches(term, '^[A-Za-z0-9]') AND regexp_matches(nxt, '[A-Za-z0-9]')))")


PREPARED = "replace(lower(text), '&nbsp', '')"
MATCHES = f"WITH {DICT}, {occurrences('documents', 'doc_id', 'lower(text)')}"
TAGS = f"WITH {DICT}, {occurrences('documents', 'doc_id', PREPARED)}, tg AS (SELECT id, pos, arg_max(term, length(term)) AS term FROM m GROUP BY id, pos)"


@check("dict_match", MATCHES + " SELECT id AS doc_id, count(*) AS n, sum(pos)::BIGINT AS places, md5(string_agg(term, '|' ORDER BY pos, term)) AS terms FROM m GROUP BY id")
def dict_match(spark, sf):
    docs = table(spark, sf, "documents").withColumn("text", F.lower("text"))
    found = Di.dict_match(docs, dictionary(spark, sf))
    rows = F.sort_array(F.collect_list(F.struct("pos", "term")))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("pos").alias("places"), rows.alias("r")).select("doc_id", "n", "places", F.md5(F.array_join("r.term", "|")).alias("terms"))


@check("tag_documents", TAGS + " SELECT doc_id, coalesce(md5(string_agg(term, '|' ORDER BY pos)), md5('')) AS tags, count(pos) AS n FROM documents LEFT JOIN tg ON id = doc_id GROUP BY doc_id")
def tag_documents(spark, sf):
    out = Di.tag_documents(table(spark, sf, "documents"), dictionary(spark, sf))
    return out.select("doc_id", F.md5(F.array_join("tags", "|")).alias("tags"), F.size("tags").cast("long").alias("n"))


HTML = "replace(lower(regexp_replace(html, '<[^>]+>', '', 'g')), '&nbsp', '')"
PAGE_TAGS = f"WITH {DICT}, {occurrences('pages', 'page_id', HTML)}, tg AS (SELECT id, pos, arg_max(term, length(term)) AS term FROM m GROUP BY id, pos), " \
            "tc AS (SELECT id, term, count(*) AS n FROM tg GROUP BY ALL), tk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, term) AS rank FROM tc)"


@check("top_tags", PAGE_TAGS + " SELECT id AS doc_id, term, n, rank FROM tk WHERE rank <= 5")
def top_tags(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))
    return Di.top_tags(pages, dictionary(spark, sf), 5, key="page_id").withColumn("rank", F.col("rank").cast("long"))


PART_DICT = "pd AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part)"


def part_dict(spark, sf):
    return table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct()


# The words of some parts as the dictionary, those of all parts to be looked up: many are missing.
@check("dict_contains", "WITH d AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) || p_size AS term FROM part WHERE p_size > 25), w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) || p_size AS term FROM part) SELECT p_partkey, term FROM w WHERE term IN (SELECT term FROM d)")
def dict_contains(spark, sf):
    words = table(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.split("p_name", " ")).alias("w")).select("p_partkey", "p_size", F.concat("w", "p_size").alias("term")).distinct()
    return Di.dict_contains(words.drop("p_size"), words.filter("p_size > 25").select("term").distinct()).select("p_partkey", "term")


@check("dict_find", "WITH d AS (SELECT p_name AS term, min(p_partkey) AS value FROM part WHERE p_size > 25 GROUP BY p_name) SELECT p_partkey, p_name AS term, coalesce(value, -1) AS value FROM part LEFT JOIN d ON p_name = term")
def dict_find(spark, sf):
    p = table(spark, sf, "part")
    values = p.filter("p_size > 25").groupBy(F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("value"))
    return Di.dict_find(p.select("p_partkey", F.col("p_name").alias("term")), values).select("p_partkey", "term", F.coalesce("value", F.lit(-1)).alias("value"))


PREFIXES = "d AS (SELECT DISTINCT p_name AS term FROM part), pf AS (SELECT DISTINCT substr(p_name, 1, 3) AS prefix FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] FROM part)"


def prefix_tables(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_name").alias("term")), p.select(F.explode(F.array(F.substring("p_name", 1, 3), F.split("p_name", " ")[0])).alias("prefix")).distinct()


@check("prefix_search", f"WITH {PREFIXES}, r AS (SELECT prefix, term, row_number() OVER (PARTITION BY prefix ORDER BY term) AS rank FROM pf JOIN d ON starts_with(term, prefix)) SELECT * FROM r WHERE rank <= 5")
def prefix_search(spark, sf):
    return Di.prefix_search(*prefix_tables(spark, sf), 5).select("prefix", "term", F.col("rank").cast("long").alias("rank"))


@check("prefix_complete", f"""WITH {PREFIXES}, e AS (SELECT prefix, min(term) AS a, max(term) AS b FROM pf JOIN d ON starts_with(term, prefix) GROUP BY prefix)
SELECT prefix, substr(a, 1, list_max(list_filter(generate_series(0, least(length(a), length(b))), lambda k: substr(a, 1, k) = substr(b, 1, k)))) AS completion FROM e""")
def prefix_complete(spark, sf):
    return Di.prefix_complete(*prefix_tables(spark, sf))


@check("highlight_terms", f"""WITH {PART_DICT}, l AS (SELECT list(term) AS ts FROM pd)
SELECT p_partkey, array_to_string(list_transform(string_split(upper(p_name) || ' unpart', ' '), lambda w: CASE WHEN list_contains(ts, lower(w)) THEN '<b>' || w || '</b>' ELSE w END), ' ') AS marked FROM part, l""")
def highlight_terms(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.upper("p_name"), F.lit(" unpart")).alias("text"))
    return Di.highlight_terms(p, part_dict(spark, sf), key="p_partkey").select("p_partkey", "marked")


# ---- snippets: every document against the words of the benchmark item with its number modulo the number of items
def hit_rows(spark, sf):
    """(query_id, doc_id, text, terms) for the ten best documents of every benchmark text."""
    from gleanery.operators.ranking import top_k
    best = top_k(hits(spark, sf), 10).select("query_id", "doc_id")
    terms = benchmark_terms(spark, sf).groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    return best.join(terms, "query_id").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


BEST = HITS + ", best AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rk FROM h) WHERE rk <= 10)"
# Sentences of a text: tokens with ranges, a sentence number, the wanted ones marked.
PIECES = (r"pc AS (SELECT query_id, doc_id, text, unnest(regexp_extract_all(text, '[^\pL\pN_]*[\pL\pN_]+(?:\.[\pL\pN_]+)*')) AS piece, generate_subscripts(regexp_extract_all(text, '[^\pL\pN_]*[\pL\pN_]+(?:\.[\pL\pN_]+)*'), 1) AS i FROM best JOIN documents USING (doc_id)), "
          r"tk AS (SELECT query_id, doc_id, text, i, lower(regexp_replace(piece, '^[^\pL\pN_]+', '')) AS term, sum(length(piece)) OVER w AS e, length(regexp_replace(piece, '^[^\pL\pN_]+', '')) AS w, lead(regexp_extract(piece, '^[^\pL\pN_]*')) OVER w AS gap, count(*) OVER (PARTITION BY query_id, doc_id) AS cnt FROM pc WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY i)), "
          r"tl AS (SELECT *, regexp_extract(text, '[^\pL\pN_]*$') AS tail FROM (SELECT * FROM tk)), "
          r"tf AS (SELECT *, regexp_matches(coalesce(gap, tail), '^[.!?]($|[^.!?])') AS fin FROM tl), "
          r"tn AS (SELECT *, coalesce(sum(fin::INT) OVER (PARTITION BY query_id, doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid, (query_id, term) IN (SELECT query_id, term FROM qt) AS hit FROM tf), "
          r"se AS (SELECT query_id, doc_id, sid, min(e - w)::BIGINT AS start, max(e)::BIGINT AS stop, sum(w) AS width, bool_or(fin) AS closed, count(*) FILTER (hit) AS matches, count(DISTINCT term) FILTER (hit) AS kinds FROM tn GROUP BY ALL), "
          r"fr AS (SELECT *, matches * 100.0::DOUBLE * kinds AS score FROM se WHERE matches > 0 AND (NOT closed OR width <= 200))")


@check("snippet_sentence", BEST + ", " + PIECES + ' SELECT query_id, doc_id, start, stop AS "end", matches FROM fr')
def snippet_sentence(spark, sf):
    out = hit_rows(spark, sf).select("query_id", "doc_id", F.explode(Sn.snippet_sentence(F.col("text"), F.col("terms"))).alias("f"))
    return out.select("query_id", "doc_id", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end"), F.size("f.matches").cast("long").alias("matches"))


@check("snippet_rank", BEST + ", " + PIECES + ', rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, start) AS n FROM fr) SELECT query_id, doc_id, start, stop AS "end", score FROM rk WHERE n <= 3 AND score > 1')
def snippet_rank(spark, sf):
    out = Sn.snippets(hit_rows(spark, sf)).select("query_id", "doc_id", F.explode("fragments").alias("f"))
    return out.select("query_id", "doc_id", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end"), F.col("f.score").alias("score"))


@check("snippet_whole", BEST + ", " + PIECES + " SELECT query_id, doc_id, any_value(length(text)) AS \"end\", count(*) AS matches FROM tn WHERE hit GROUP BY ALL")
def snippet_whole(spark, sf):
    out = hit_rows(spark, sf).select("query_id", "doc_id", Sn.snippet_whole(F.col("text"), F.col("terms"))[0].alias("f"))
    return out.select("query_id", "doc_id", F.col("f.end").cast("long").alias("end"), F.size("f.matches").cast("long").alias("matches")).filter("matches > 0")


# Tokens of a text with the widths of those before them, and for each match how far given numbers of characters reach.
SPOTS = (PIECES + ", tok2 AS (SELECT query_id, doc_id, i - 1 AS k, e - w AS a, e AS b, w, hit, length(text) AS size, cnt AS n, sum(w) OVER (PARTITION BY query_id, doc_id ORDER BY i) - w AS before FROM tn), "
         "ms AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY k) AS m FROM tok2 WHERE hit), ")
BOUNDS = ("rc AS (SELECT h.query_id, h.doc_id, h.m, coalesce(min(t.k) FILTER (t.before + t.w - h.before >= 20), any_value(h.n)) AS plain, coalesce(min(t.k) FILTER (t.before + t.w - h.before >= 40), any_value(h.n)) AS wide, "
          "coalesce(min(t.k) FILTER (t.before + t.w - h.before > 200), any_value(h.n)) AS cut, bool_or(t.before + t.w - h.before = 20) AS plain_skip, bool_or(t.before + t.w - h.before = 40) AS wide_skip "
          "FROM ms h JOIN tok2 t ON t.query_id = h.query_id AND t.doc_id = h.doc_id AND t.k BETWEEN h.k AND h.k + 201 GROUP BY h.query_id, h.doc_id, h.m), "
          "lf AS (SELECT h.query_id, h.doc_id, h.m, h.k, h.k - count(t.k) FILTER (p.b - t.a <= 20) AS far FROM ms h LEFT JOIN tok2 p ON p.query_id = h.query_id AND p.doc_id = h.doc_id AND p.k = h.k - 1 "
          "LEFT JOIN tok2 t ON t.query_id = h.query_id AND t.doc_id = h.doc_id AND t.k BETWEEN h.k - 20 AND h.k - 1 GROUP BY h.query_id, h.doc_id, h.m, h.k), "
          "bd AS (SELECT * FROM lf JOIN rc USING (query_id, doc_id, m)), "
          "st AS (WITH RECURSIVE s(query_id, doc_id, m, frag, first, reach, skip, cut, counted) AS ("
          "SELECT query_id, doc_id, m, 1, far, CASE WHEN far < k THEN plain ELSE wide END, CASE WHEN far < k THEN plain_skip ELSE wide_skip END, cut, cut > k FROM bd WHERE m = 1 UNION ALL "
          "SELECT query_id, doc_id, m, CASE WHEN fresh THEN frag + 1 ELSE frag END, CASE WHEN fresh THEN lft ELSE first END, "
          "CASE WHEN NOT fresh AND k >= cut THEN reach WHEN fresh AND lft = k THEN wide ELSE plain END, CASE WHEN NOT fresh AND k >= cut THEN skip WHEN fresh AND lft = k THEN wide_skip ELSE plain_skip END, "
          "CASE WHEN fresh THEN own_cut ELSE cut END, CASE WHEN fresh THEN own_cut > k ELSE k < cut END FROM ("
          "SELECT b.query_id, b.doc_id, b.m, b.k, frag, first, reach, skip, s.cut, b.cut AS own_cut, plain, wide, plain_skip, wide_skip, b.k > least(reach, s.cut) AS fresh, "
          "least(greatest(far, least(reach, s.cut) + 1 + CASE WHEN reach < s.cut AND skip THEN 1 ELSE 0 END), b.k) AS lft FROM s JOIN bd b ON b.query_id = s.query_id AND b.doc_id = s.doc_id AND b.m = s.m + 1)) SELECT * FROM s), "
          "fg AS (SELECT query_id, doc_id, frag, min(first) AS first, least(arg_max(reach, m), min(cut)) AS last, count(*) FILTER (counted) AS matches FROM st GROUP BY ALL) ")


def fragment_rows(name, fragmenter, sql):
    @check(name, BEST + ", " + SPOTS + sql)
    def run(spark, sf):
        out = hit_rows(spark, sf).select("query_id", "doc_id", F.posexplode(fragmenter(F.col("text"), F.col("terms"))).alias("n", "f"))
        return out.select("query_id", "doc_id", *[c.cast("long").alias(n) for n, c in (("n", F.col("n")), ("start", F.col("f.start")), ("end", F.col("f.end")), ("matches", F.size("f.matches")))])


fragment_rows("snippet_context", Sn.snippet_context, BOUNDS + 'SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY frag) - 1 AS n, x.a::BIGINT AS start, y.b::BIGINT AS "end", matches FROM fg '
              "JOIN tok2 x USING (query_id, doc_id) JOIN tok2 y USING (query_id, doc_id) WHERE matches > 0 AND x.k = first AND y.k = least(last, x.n - 1)")
fragment_rows("snippet_pinpoint", Sn.snippet_pinpoint, "mw AS (SELECT *, sum(w) OVER v - w AS wide, lag(b) OVER v AS prev, count(*) OVER (PARTITION BY query_id, doc_id) AS total FROM ms WINDOW v AS (PARTITION BY query_id, doc_id ORDER BY m)), "
              "bad AS (SELECT x.query_id, x.doc_id, x.m, min(y.m) AS stop FROM mw x JOIN mw y ON x.query_id = y.query_id AND x.doc_id = y.doc_id AND y.m > x.m WHERE y.b - y.prev > 20 OR y.b - x.a > 200 OR y.wide - x.wide >= 200 GROUP BY ALL), "
              "fi AS (SELECT x.*, coalesce(stop, total + 1) - x.m AS matches FROM mw x LEFT JOIN bad USING (query_id, doc_id, m)) "
              'SELECT f.query_id, f.doc_id, f.m - 1 AS n, greatest(0, f.a - 20)::BIGINT AS start, least(f.size, l.b + 20)::BIGINT AS "end", f.matches::BIGINT AS matches FROM fi f JOIN mw l ON l.query_id = f.query_id AND l.doc_id = f.doc_id AND l.m = f.m + f.matches - 1')


@check("snippet_format")
def snippet_format(spark, sf):
    rows = Sn.snippets(hit_rows(spark, sf))
    return rows.select("query_id", "doc_id", Sn.snippet_format(F.col("text"), F.col("fragments")).alias("html"), Sn.snippet_format(F.col("text"), F.col("fragments"), "upper").alias("upper"))


# ---- service. Jobs are the orders: id, org, a flag and tags.
JOBS = "jobs AS (SELECT o_orderkey AS id, o_custkey AS orgid, (o_orderstatus = 'F')::INT AS ishunterjob, string_split(lower(o_orderpriority), ' ') || [lower(o_orderstatus)] AS tags FROM orders)"


def jobs(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("orgid"), (F.col("o_orderstatus") == "F").cast("int").alias("ishunterjob"), F.col("o_orderpriority").alias("title"),
                    F.concat(F.split(F.lower("o_orderpriority"), " "), F.array(F.lower("o_orderstatus"))).alias("tags"))


# Requests come from the events: the type chooses the route, the page of an action the keyword.
def requests(spark, sf):
    e = table(spark, sf, "events")
    word = F.when(F.col("event_id") % 3 == 0, "1-urgent f").when(F.col("event_id") % 3 == 1, "p").otherwise("")
    return e.select(F.col("event_id").alias("query_id"), word.alias("keyword"), (F.col("event_type") == "error").alias("hunterjob"), F.col("event_type").isin("error", "purchase").alias("uniqueorgid"))


REQUESTS = "rq AS (SELECT event_id AS query_id, CASE event_id % 3 WHEN 0 THEN '1-urgent f' WHEN 1 THEN 'p' ELSE '' END AS keyword, event_type = 'error' AS hunterjob, event_type IN ('error', 'purchase') AS uniqueorgid FROM events)"
FOUND = ("fd AS (SELECT k, doc_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank, score FROM (SELECT '1-urgent f' AS k, id AS doc_id, 2.0::DOUBLE AS score FROM jobs WHERE list_contains(tags, '1-urgent') AND list_contains(tags, 'f') "
         "UNION ALL SELECT 'p', id, 1.0 FROM jobs WHERE list_contains(tags, 'p') UNION ALL SELECT '', id, 1.0 FROM jobs))")


@check("job_search", f"WITH {JOBS}, {REQUESTS}, {FOUND} SELECT query_id, rank, doc_id, score FROM rq JOIN fd ON k = keyword WHERE rank <= 5")
def job_search(spark, sf):
    return Sv.job_search(Sv.job_index(jobs(spark, sf)), requests(spark, sf), 5)


@check("all_jobs", f"WITH {JOBS} SELECT id, orgid, 1.0::DOUBLE AS score FROM jobs ORDER BY id LIMIT 100")
def all_jobs(spark, sf):
    return Sv.all_jobs(jobs(spark, sf), 100).select("id", "orgid", "score")


NEWEST = "SELECT id, orgid FROM (SELECT *, row_number() OVER (PARTITION BY orgid ORDER BY id DESC) AS rn FROM jobs {where}) WHERE rn = 1 ORDER BY id DESC LIMIT {n}"


@check("hunter_jobs", f"WITH {JOBS} " + NEWEST.format(where="WHERE ishunterjob = 1", n=100))
def hunter_jobs(spark, sf):
    return Sv.hunter_jobs(jobs(spark, sf), 100).select("id", "orgid")


@check("search_route", f"WITH {JOBS}, {REQUESTS}, {FOUND}, hu AS ({NEWEST.format(where='WHERE ishunterjob = 1', n=5)}), un AS ({NEWEST.format(where='', n=5)}), "
       "ls AS (SELECT 'hunter' AS route, id AS doc_id, row_number() OVER (ORDER BY id DESC) AS rank FROM hu UNION ALL SELECT 'unique', id, row_number() OVER (ORDER BY id DESC) FROM un), "
       "ro AS (SELECT *, CASE WHEN hunterjob THEN 'hunter' WHEN uniqueorgid THEN 'unique' ELSE 'keyword' END AS route FROM rq) "
       "SELECT query_id, route, rank, doc_id FROM ro JOIN ls USING (route) UNION ALL SELECT query_id, route, rank, doc_id FROM ro JOIN fd ON k = keyword WHERE route = 'keyword' AND rank <= 5")
def search_route(spark, sf):
    j = jobs(spark, sf)
    return Sv.search_route(j, Sv.job_index(j), requests(spark, sf), 5)


PAGE_URL = r"(https?://[^/]+/[a-z]+/\d+)"


def page_texts(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", html_to_text(F.col("html")).alias("text"))


CANON = f"ca AS (SELECT page_id, nullif(regexp_extract(url, '{PAGE_URL}', 1), '') AS curl, html FROM pages)"


@check("page_tag_match", f"WITH {DICT}, {CANON}, pu AS (SELECT curl, min(page_id) AS pid FROM ca WHERE curl IS NOT NULL GROUP BY curl), up AS (SELECT page_id, html FROM pages WHERE page_id IN (SELECT pid FROM pu)), "
       + occurrences("up", "page_id", HTML) + ", tg AS (SELECT id, pos, arg_max(term, length(term)) AS term FROM m GROUP BY id, pos), tc AS (SELECT id, term, count(*) AS n FROM tg GROUP BY ALL), "
       "tk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, term) AS rank FROM tc), pt AS (SELECT curl, term FROM pu JOIN tk ON pid = id WHERE rank <= 5), "
       + raw_tokens("dt", "documents") + ", df AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM dt GROUP BY ALL), "
       "hh AS (SELECT page_id, doc_id, sum(tf) AS score FROM ca JOIN pt USING (curl) JOIN df USING (term) GROUP BY ALL), "
       "rr AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, doc_id) AS rank FROM hh) SELECT page_id AS query_id, rank, doc_id, score FROM rr WHERE rank <= 10")
def page_tag_match(spark, sf):
    pages = page_texts(spark, sf)
    # Of several pages with one address the first counts.
    first = pages.groupBy(Sv.canonical_url(pattern=PAGE_URL).alias("url")).agg(F.min_by("text", "page_id").alias("text")).filter("url IS NOT NULL")
    tags = Sv.tag_pages(first, dictionary(spark, sf), "text", 5, pattern=PAGE_URL)
    return Sv.page_tag_match(index(spark, sf, TAG_FIELDS), pages, tags, 10, pattern=PAGE_URL, key="page_id")


@check("unseen_urls", f"WITH {CANON} SELECT DISTINCT curl AS url FROM ca WHERE curl IS NOT NULL AND curl NOT IN (SELECT curl FROM ca WHERE page_id % 2 = 0 AND curl IS NOT NULL)")
def unseen_urls(spark, sf):
    pages = table(spark, sf, "pages")
    known = pages.filter("page_id % 2 = 0").select(Sv.canonical_url(pattern=PAGE_URL).alias("url")).filter("url IS NOT NULL").distinct()
    return Sv.unseen_urls(pages, known, pattern=PAGE_URL)
