"""Index tables and corpus statistics."""

from pyspark.sql import functions as F

from gleanery.functions import tokens as T
from gleanery.operators import index as I
from gleanery.operators.index import Field, SearchIndex, explode_postings, forward_index
from gleanery.session import scratch_path
from gleanery.sources import writers as Wr

from .base import POSTINGS, check, index, r6, table


def text_postings(spark, sf, level):
    docs = table(spark, sf, "documents")
    return explode_postings(forward_index(docs, [Field("text", T.an_standard(), level=level)]))


SUMS = "count(*) AS terms, sum(tf)::BIGINT AS tf, md5(string_agg(term, ' ' ORDER BY term COLLATE C)) AS digest"


def per_doc(postings, *more):
    """One row per document: number of terms, summed tf, md5 of the sorted terms."""
    agg = postings.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").cast("long").alias("tf"),
                                         F.md5(F.array_join(F.sort_array(F.collect_list("term")), " ")).alias("digest"), *more)
    return agg


PER_DOC = "count(*) AS terms, sum({tf})::BIGINT AS tf, md5(string_agg(term, ' ' ORDER BY term)) AS digest"


@check("postings_existence", f"WITH {POSTINGS} SELECT doc_id, {PER_DOC.format(tf='1')} FROM p GROUP BY doc_id")
def postings_existence(spark, sf):
    return per_doc(text_postings(spark, sf, "existence"))


@check("postings_frequency", f"WITH {POSTINGS} SELECT doc_id, {PER_DOC.format(tf='tf')}, sum(tf * length(term))::DOUBLE AS mass FROM p GROUP BY doc_id")
def postings_frequency(spark, sf):
    return per_doc(text_postings(spark, sf, "frequency"), F.sum(F.col("weight") * F.length("term")).alias("mass"))


@check("postings_positions", f"""WITH {POSTINGS}, l AS (SELECT doc_id, term, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS ps FROM tok GROUP BY doc_id, term)
SELECT doc_id, count(*) AS terms, md5(string_agg(term || ':' || ps, ' ' ORDER BY term)) AS digest FROM l GROUP BY doc_id""")
def postings_positions(spark, sf):
    p = text_postings(spark, sf, "positions")
    entry = F.concat("term", F.lit(":"), F.array_join(F.transform("positions", lambda x: x.cast("string")), ","))
    rows = F.sort_array(F.collect_list(F.struct("term", entry.alias("e"))))
    return p.groupBy("doc_id").agg(F.count("*").alias("terms"), rows.alias("l")).select("doc_id", "terms", F.md5(F.array_join("l.e", " ")).alias("digest"))


@check("postings_characters", f"""WITH r AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[^\\pL\\pN_]*[\\pL\\pN_]+(?:\\.[\\pL\\pN_]+)*')) AS piece, generate_subscripts(regexp_extract_all(text, '[^\\pL\\pN_]*[\\pL\\pN_]+(?:\\.[\\pL\\pN_]+)*'), 1) AS i FROM documents),
e AS (SELECT doc_id, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS endchar, length(regexp_replace(piece, '^[^\\pL\\pN_]+', '')) AS w FROM r)
SELECT doc_id, count(*) AS n, sum(endchar - w)::BIGINT AS starts, sum(endchar)::BIGINT AS ends, sum((endchar - w) * w)::BIGINT AS mix FROM e GROUP BY doc_id""")
def postings_characters(spark, sf):
    docs = table(spark, sf, "documents")
    p = explode_postings(forward_index(docs, [Field("text", T.an_simple(chars=True), level="characters")]))
    c = p.select("doc_id", F.explode("chars").alias("c")).select("doc_id", F.col("c.startchar").cast("long").alias("s"), F.col("c.endchar").cast("long").alias("e"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("s").alias("starts"), F.sum("e").alias("ends"), F.sum(F.col("s") * (F.col("e") - F.col("s"))).alias("mix"))


@check("postings_position_boosts", """WITH w AS (SELECT p_partkey AS doc_id, unnest(string_split(p_name, ' ') || [p_type || '^' || p_size]) AS t FROM part),
b AS (SELECT doc_id, string_split(t, '^')[1] AS term, coalesce(try_cast(string_split(t, '^')[2] AS DOUBLE), 1.0) AS boost FROM w)
SELECT doc_id, term, count(*) AS tf, sum(boost) AS weight FROM b GROUP BY ALL""")
def postings_position_boosts(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_type", F.lit("^"), "p_size").alias("t"))
    rows = explode_postings(forward_index(p, [Field("t", T.chain(T.tok_space, T.f_term_boost()))], "p_partkey"))
    return rows.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), "weight")


@check("field_boost", """WITH w AS (SELECT p_partkey AS doc_id, 'name' AS field, unnest(string_split(p_name, ' ')) AS term, coalesce(CASE WHEN p_size % 2 = 0 THEN 3.0 END, p_size::DOUBLE) AS b FROM part
UNION ALL SELECT p_partkey, 'type', p_type, p_size::DOUBLE FROM part) SELECT doc_id, field, term, sum(b) AS weight FROM w GROUP BY ALL""")
def field_boost(spark, sf):
    p = table(spark, sf, "part").withColumn("_boost", F.col("p_size").cast("double")).withColumn("_name_boost", F.when(F.col("p_size") % 2 == 0, 3.0))
    fields = [Field("p_name", T.tok_space, name="name", boost_column="_name_boost", doc_boost_column="_boost"), Field("p_type", T.tok_space, name="type", doc_boost_column="_boost")]
    return explode_postings(forward_index(p, fields, "p_partkey")).select("doc_id", "field", "term", "weight")


@check("write_postings", f"WITH {POSTINGS} SELECT term, count(*) AS docs, sum(tf)::BIGINT AS tf, sum(doc_id)::BIGINT AS ids FROM p GROUP BY term")
def write_postings(spark, sf):
    path = scratch_path(spark, "postings")
    Wr.write_postings(text_postings(spark, sf, "positions"), path)
    return spark.read.parquet(path).filter("field = 'text'").groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").cast("long").alias("tf"), F.sum("doc_id").alias("ids"))


@check("stored_override", "WITH w AS (SELECT p_partkey AS doc_id, p_type AS stored, unnest(string_split(p_name, ' ')) AS term FROM part) SELECT DISTINCT doc_id, term, stored FROM w")
def stored_override(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.col("p_type").alias("_stored_title"))
    idx = SearchIndex.build(Wr.stored_override(p, "title"), [Field("title", T.an_simple())])
    return idx.postings.select("doc_id", "term").join(idx.corpus.select("doc_id", F.col("stored_title").alias("stored")), "doc_id")


@check("term_vector", f"WITH {POSTINGS} SELECT doc_id, term, tf::DOUBLE AS weight FROM p")
def term_vector(spark, sf):
    return I.term_vector(index(spark, sf), "text").select("doc_id", F.explode("vector").alias("term", "weight"))


@check("doc_lengths", f"WITH {POSTINGS} SELECT 'text' AS field, doc_id, doc_len AS length FROM dl")
def doc_lengths(spark, sf):
    return I.doc_lengths(index(spark, sf)).filter("field = 'text'").select("field", "doc_id", F.col("length").cast("long").alias("length"))


@check("field_stats", f"""WITH {POSTINGS} SELECT 'text' AS field, (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM tok) AS total_len, min(doc_len) AS min_len, max(doc_len) AS max_len,
round((SELECT avgl FROM fs), 6) AS avg_len FROM dl""")
def field_stats(spark, sf):
    return index(spark, sf).field_stats.filter("field = 'text'").select(
        "field", "n_docs", "total_len", F.col("min_len").cast("long").alias("min_len"), F.col("max_len").cast("long").alias("max_len"), r6("avg_len"))


@check("doc_counts", "SELECT count(*) AS doc_count, count(*) AS doc_count_all FROM documents")
def doc_counts(spark, sf):
    return I.doc_counts(index(spark, sf))


@check("term_stats", f"WITH {POSTINGS} SELECT term, df, cf, min_len, max_len, max_weight, min_id, max_id FROM ts")
def term_stats(spark, sf):
    t = index(spark, sf).term_stats.filter("field = 'text'")
    return t.select("term", "df", "cf", F.col("min_len").cast("long").alias("min_len"), F.col("max_len").cast("long").alias("max_len"), "max_weight", "min_id", "max_id")


@check("term_frequency", f"WITH {POSTINGS} SELECT term, cf AS frequency FROM ts")
def term_frequency(spark, sf):
    return index(spark, sf).term_stats.filter("field = 'text'").select("term", F.col("cf").alias("frequency"))


@check("doc_frequency", f"WITH {POSTINGS} SELECT term, df AS doc_frequency FROM ts")
def doc_frequency(spark, sf):
    return index(spark, sf).term_stats.filter("field = 'text'").select("term", F.col("df").alias("doc_frequency"))


@check("lexicon", f"WITH {POSTINGS} SELECT 'text' AS field, term FROM ts UNION ALL SELECT DISTINCT 'lang', lang FROM documents UNION ALL SELECT DISTINCT 'source', source FROM documents")
def lexicon(spark, sf):
    return index(spark, sf).lexicon


@check("terms_from", f"WITH {POSTINGS} SELECT 'text' AS field, term FROM ts WHERE term >= 'the'")
def terms_from(spark, sf):
    return I.terms_from(index(spark, sf), "text", "the")


@check("prefix_terms", f"WITH {POSTINGS} SELECT 'text' AS field, term FROM ts WHERE starts_with(term, 'th')")
def prefix_terms(spark, sf):
    return I.prefix_terms(index(spark, sf), "text", "th")


@check("most_frequent_terms", f"WITH {POSTINGS} SELECT term, cf AS weight FROM ts ORDER BY cf DESC, term DESC LIMIT 20")
def most_frequent_terms(spark, sf):
    return I.most_frequent_terms(index(spark, sf), "text", 20)


@check("most_distinctive_terms", f"WITH {POSTINGS} SELECT term, round(cf * ln(n / df), 6) AS weight FROM ts, fs ORDER BY round(cf * ln(n / df), 9) DESC, term DESC LIMIT 20")
def most_distinctive_terms(spark, sf):
    return I.most_distinctive_terms(index(spark, sf), "text", 20).select("term", r6("weight"))


@check("corpus_tfidf", f"WITH {POSTINGS} SELECT term, cf, df, round(cf * ln(n / df), 6) AS weight FROM ts, fs")
def corpus_tfidf(spark, sf):
    return I.distinctiveness(index(spark, sf), "text").select("term", "cf", "df", r6("weight")).orderBy(F.desc("weight"))


@check("lookup_documents", "SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#2'")
def lookup_documents(spark, sf):
    return I.lookup_documents(table(spark, sf, "part"), p_type="ECONOMY", p_brand="Brand#2").select("p_partkey", "p_name")


@check("first_id", "SELECT min(doc_id) AS doc_id FROM documents WHERE lang = 'fr'")
def first_id(spark, sf):
    return I.first_id(index(spark, sf), "lang", "fr")


@check("postings_dump", f"WITH {POSTINGS} SELECT 'text' AS field, term, doc_id, tf FROM p UNION ALL SELECT 'lang', lang, doc_id, 1 FROM documents UNION ALL SELECT 'source', source, doc_id, 1 FROM documents")
def postings_dump(spark, sf):
    return I.postings_dump(index(spark, sf)).select("field", "term", "doc_id", F.col("tf").cast("long").alias("tf"))
