"""Golden values worked out by hand from the formulas."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import dates as D
from gleanery.functions import distance as Ds
from gleanery.functions import scoring as Sc
from gleanery.functions import spans as S
from gleanery.functions import tokens as T
from gleanery.functions.phonetic import double_metaphone, lex_soundex
from gleanery.functions.sortkeys import natural_key
from gleanery.functions.stem import stem
from gleanery.operators import clauses as C
from gleanery.operators import combine as H
from gleanery.operators import dictionary as Di
from gleanery.operators import facets as Fa
from gleanery.operators import index as I
from gleanery.operators import lexicon as L
from gleanery.operators import maintain as Mt
from gleanery.operators import mining as M
from gleanery.operators import positional as P
from gleanery.operators import snippets as Sn
from gleanery.operators.index import Field, SearchIndex, keyword_field
from gleanery.sources import readers as R
from gleanery.streaming import ChangeTable, stream_tail, stream_upsert_delete


def toks(spark, fn, text):
    return [tuple(t) for t in spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]]


def terms(spark, fn, text):
    return [t[0] for t in toks(spark, fn, text)]


ANALYZERS = [
    (T.tok_regex, "hi there 3.141 big-time under_score", "hi|there|3.141|big|time|under_score"),
    (T.tok_space, "hi there big-time, what's up", "hi|there|big-time,|what's|up"),
    (T.tok_comma, "hi there, what's , up", "hi there|what's|up"),
    (lambda c: T.tok_ngram(c, 4), "hi there", "hi t|i th| the|ther|here"),
    (T.tok_path, "/a/b/c", "/a|/a/b|/a/b/c"),
    (T.chain(T.tok_space, T.f_ngram(4)), "hello there", "hell|ello|ther|here"),
    (T.an_standard(), "Testing is testing and testing", "testing|testing|testing"),
    (T.chain(T.tok_space, T.f_intraword()), "Wi-Fi PowerShot SD500 O'Neil's", "Wi|Fi|Power|Shot|SD|500|O|Neil"),
    (T.chain(T.tok_space, T.f_biword()), "the sign of four", "the-sign|sign-of|of-four"),
    (T.chain(T.tok_space, T.f_shingle(3, " ")), "better a witty fool", "better a witty|a witty fool"),
    (T.chain(T.tok_space, T.f_tee(T.f_lower, T.f_reverse)), "ALFA BRAVO CHARLIE", "alfa|AFLA|bravo|OVARB|charlie|EILRAHC"),
    (T.chain(T.tok_space, T.f_fold_accents), "café", "cafe"),
    (T.an_fancy(), "Should I call getInt or get_real?", "should|call|get|int|get|real"),
    (lambda c: T.tok_ngram(c, 2, 4), "abc", "ab|abc|bc"),
    (lambda c: T.tok_ngram(c, 2, 4, query=True), "abc", "abc"),
]


@pytest.mark.parametrize("fn,text,expected", ANALYZERS)
def test_analyzers(spark, fn, text, expected):
    assert terms(spark, fn, text) == expected.split("|")


def test_positions_and_boosts(spark):
    assert toks(spark, T.an_standard(), "the quick brown") == [("quick", 1), ("brown", 2)]
    assert toks(spark, T.chain(T.tok_space, T.f_intraword(mergewords=True)), "PowerShot") == [("Power", 0), ("Shot", 1), ("PowerShot", 1)]
    assert toks(spark, T.chain(T.tok_space, T.f_term_boost()), "image render^2 file^0.5") == [("image", 0, 1.0), ("render", 1, 2.0), ("file", 2, 0.5)]
    assert toks(spark, T.chain(T.tok_space, T.f_boost_pattern(r"(\d+)\*")), "2*java") == [("java", 0, 2.0)]
    assert toks(spark, T.an_simple(chars=True), "hi there hi") == [("hi", 0, 0, 2), ("there", 1, 3, 8), ("hi", 2, 9, 11)]


def test_long_text_offsets(spark):
    text = "ab  c " * 700
    got = toks(spark, T.an_simple(chars=True), text)
    assert len(got) == 1400 and all(text[s:e] == t for t, _, s, e in got)


def test_words(spark):
    assert [stem(w) for w in ("fundamentally", "willows", "testing", "ponies", "hopping")] == ["fundament", "willow", "test", "poni", "hop"]
    codes = {"maurice": ("MRS", None), "katherine": ("K0RN", "KTRN"), "richard": ("RXRT", "RKRT"), "geoff": ("JF", "KF"), "zhang": ("JNK", None),
             "Schwein": ("XN", "XFN"), "cambrillo": ("KMPRL", "KMPR"), "Thumbail": ("0MPL", "TMPL"), "Through": ("0R", "TR"), "Jose": ("HS", None),
             "Arnow": ("ARN", "ARNF"), "Parachute": ("PRKT", None), "Rapelje": ("RPL", None), "Dallas": ("TLS", None), "Tux": ("TKS", None)}
    assert {w: double_metaphone(w) for w in codes} == codes
    rows = spark.createDataFrame([(w,) for w in ("robert", "rupert", "tymczak", "lee")], "w string").select(lex_soundex(F.col("w")))
    assert [r[0] for r in rows.collect()] == ["r01063", "r01063", "t05202", "l0"]


def words(spark, *ws, name="term"):
    return spark.createDataFrame([(w,) for w in ws], f"{name} string")


def test_lexicon(spark):
    v = L.lex_variations(words(spark, "pull", name="word"), words(spark, "pull", "puller", "pullout"))
    assert {r.variant for r in v.collect()} == {"pull", "puller"}
    c = L.f_compound(words(spark, "greeneggs", "green"), words(spark, "green", "eggs", "gre"))
    assert [r.part for r in c.orderBy("part_no").collect()] == ["greeneggs", "green", "eggs"]
    syn = spark.createDataFrame([(1, "hail"), (1, "acclaim"), (1, "herald"), (2, "hail"), (2, "come"), (3, "other")], "synset long, word string")
    assert sorted(r.synonym for r in L.expand_synonyms(syn, words(spark, "hail", name="word")).collect()) == ["acclaim", "come", "herald"]
    codes = L.lex_metaphone(words(spark, "richard")).collect()
    assert sorted((r.code, r.boost) for r in codes) == [("RKRT", 0.5), ("RXRT", 1.0)]


def test_readers(spark):
    lines = words(spark, " Java ", "C", "", "C++", name="value")
    assert sorted(r.term for r in R.dictionary_terms(lines).collect()) == ["c++", "java"]
    facts = words(spark, "s(100,1,'hail',n,1,1).", "s(101,1,'ice storm',n,1,1).", "g(100,'x').", name="value")
    assert [tuple(r) for r in R.synonym_rows(facts).collect()] == [(100, "hail")]
    msg = """{"action":"updateDoc","name":"job","keyID":65072,"fields":[{"jobid":65072,"orgid":358813,"jobname":"PHP","description":"a\r\nb","ishunterjob":3}]}"""
    row = R.read_change_feed(words(spark, msg, name="value")).first()
    assert (row.action, row.jobid, row.orgid, row.ishunterjob) == ("updateDoc", 65072, 358813, 3)
    assert set(R.JOB_ATTRIBUTES) < set(row.asDict()) and row.attributes["jobname"] == "PHP" and row.salaryrangecode is None
    own = R.read_change_feed(words(spark, '{"action":"updateDoc","name":"org","keyID":"7","fields":[{"size":"12","tags":[1,{"a":2}]},{"size":"x"}]}', name="value"), attributes={"size": "int"}).collect()
    assert [(r.keyID, r.item, r["size"]) for r in own] == [(7, 0, 12), (7, 1, None)] and own[0].attributes["tags"] == '[1,{"a":2}]' and own[1].attributes["size"] == "x"


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [(1, "java搜索", "java linux lucene".split()), (2, "ruby开发", "java linux linux ruby".split()), (3, "python开发", "java linux linux python".split())]
    return spark.createDataFrame(rows, "doc_id long, title string, tags array<string>")


def asked(spark, *ws):
    return spark.createDataFrame([(1, i, "tags", w, 1.0) for i, w in enumerate(ws)], "query_id int, clause_id int, field string, term string, boost double")


def scores(df):
    return {r.doc_id: round(r.score, 6) for r in df.collect()}


def test_three_jobs(spark, jobs):
    idx = SearchIndex.build(jobs, [keyword_field("tags", scorable=True)])
    both = H.clause_counts(asked(spark, "java", "linux"))
    assert scores(H.all_of(C.match(idx, both, Sc.frequency))) == {1: 2.0, 2: 3.0, 3: 3.0}
    assert scores(H.all_of(C.match(idx, both))) == {1: 1.539116, 2: 1.641796, 3: 1.641796}
    assert scores(H.any_of(C.match(idx, asked(spark, "ruby", "lucene")))) == {1: 1.518404, 2: 1.35507}
    top = {r.term: round(r.weight, 6) for r in I.most_distinctive_terms(idx, "tags", 5).collect()}
    assert top == {"ruby": 1.098612, "python": 1.098612, "lucene": 1.098612, "linux": 0.0, "java": 0.0}
    members = spark.createDataFrame([(0, 2)], "set_id int, doc_id long")
    keys = M.key_terms(idx, M.set_weights(idx, members, "tags"), "tags", normalize=False)
    assert {r.term: round(r.weight, 6) for r in keys.collect()} == {"linux": 1.0, "ruby": 0.871483, "java": 0.721714}
    left = Mt.delete_by_term(jobs, "doc_id", 2)
    after = H.all_of(C.match(SearchIndex.build(left, [keyword_field("tags")]), both, Sc.frequency))
    assert set(scores(after)) == {1, 3}


def test_posting_boosts(spark):
    df = spark.createDataFrame([(1, "image render^2 render")], "doc_id long, t string")
    p = I.explode_postings(I.forward_index(df, [Field("t", T.chain(T.tok_space, T.f_term_boost()))])).filter("term = 'render'").first()
    assert (p.tf, p.weight, p.positions, p.boosts) == (2, 3.0, [1, 2], [2.0, 1.0])


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_spans(spark):
    def sp(*pairs):
        return F.array(*[S.span(F.lit(a), F.lit(b)) for a, b in pairs])
    got = lambda e: [tuple(x) for x in one(spark, e)]
    assert got(S.merge(sp((1, 2), (3, 3), (7, 8)))) == [(1, 3), (7, 8)]
    assert one(spark, S.distance_to(S.span(F.lit(1), F.lit(2)), S.span(F.lit(5), F.lit(6)))) == 3
    assert one(spark, S.distance_to(S.span(F.lit(1), F.lit(4)), S.span(F.lit(3), F.lit(6)))) == 0
    assert got(S.near(sp((0, 0)), sp((2, 2)), 1)) == [] and got(S.near(sp((0, 0)), sp((2, 2)), 2)) == [(0, 2)]


def test_near_chain(spark):
    df = spark.createDataFrame([(1, "a x b c x d")], "doc_id long, t string")
    idx = SearchIndex.build(df, [Field("t", T.tok_space)])
    chain = P.s_near_chain([P.one_term(idx, "t", w) for w in "abcd"], slop=2)
    assert [(r.start, r.end) for r in P.span_rows(chain).collect()] == [(0, 5)]


def test_distances(spark):
    pairs = spark.createDataFrame([("abcd", "acbd"), ("ca", "abc"), ("kitten", "sitting"), ("", "ab"), ("abcdef", "badcfe")], "a string, b string")
    assert [r[0] for r in pairs.select(Ds.edit_distance_osa(F.col("a"), F.col("b"))).collect()] == [1, 3, 3, 2, 3]


def test_dates_and_natural_order(spark):
    row = words(spark, "200905", name="t").select(D.date_floor(F.col("t")).alias("a"), D.date_ceil(F.col("t")).alias("b")).first()
    assert str(row.a) == "2009-05-01 00:00:00" and str(row.b) == "2009-05-31 23:59:59.999999"
    names = words(spark, "name10", "name5", "A", "1", name="t").orderBy(natural_key(F.col("t")))
    assert [r.t for r in names.collect()] == ["1", "A", "name5", "name10"]


def test_dictionary(spark):
    docs = spark.createDataFrame([(1, "aa@gmail.com中文java"), (2, "javascript"), (3, "中文java")], "doc_id long, text string")
    found = {(r.doc_id, r.pos, r.term) for r in Di.dict_match(docs, words(spark, "java", "abcd", "中文", "文java")).collect()}
    assert found == {(1, 12, "中文"), (1, 13, "文java"), (1, 14, "java"), (3, 0, "中文"), (3, 1, "文java"), (3, 2, "java")}
    assert Di.prefix_complete(words(spark, "blah1", "blah2"), words(spark, "b", name="prefix")).first().completion == "blah"
    text = spark.createDataFrame([(1, "apple ape applepie hhj")], "doc_id long, text string")
    marked = Di.highlight_terms(text, words(spark, "apple", "appleshack", "appleshackcream", "applepie", "ape")).first().marked
    assert marked == "<b>apple</b> <b>ape</b> <b>applepie</b> hhj"


def test_dictionary_large_path(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"c++ and java, {'x' * (i * 97)} javac .net java") for i in range(1, 8)], "doc_id long, text string")
    d = words(spark, "java", "c++", ".net", "and java")
    small = {tuple(r) for r in Di.dict_match(docs, d).collect()}
    monkeypatch.setattr(Di, "fits_broadcast", lambda df: False)
    assert small and {tuple(r) for r in Di.dict_match(docs, d).collect()} == small
    for i, text in ((r.doc_id, r.text) for r in docs.collect()):
        for j, n, t in small:
            assert j != i or text[n:n + len(t)] == t


def test_snippets(spark):
    def frag(fn, text, term):
        row = spark.createDataFrame([(text, [term])], "t string, w array<string>").select(fn(F.col("t"), F.col("w")).alias("f")).first()
        return [text[f.start:f.end] for f in row.f]
    assert frag(Sn.snippet_sentence, "One two. Three four! Five", "four") == ["Three four"]
    assert frag(lambda t, w: Sn.snippet_context(t, w, surround=5), "aaaa bbbb cccc dddd eeee", "cccc") == ["bbbb cccc dddd"]
    assert frag(lambda t, w: Sn.snippet_pinpoint(t, w, surround=3), "aaaa bbbb cccc dddd", "bbbb") == ["aa bbbb cc"]
    df = spark.createDataFrame([("alpha beta gamma", ["beta"])], "t string, w array<string>")
    html = df.select(Sn.snippet_format(F.col("t"), Sn.snippet_whole(F.col("t"), F.col("w")), tag="b").alias("h")).first().h
    assert html == 'alpha <b class="match term0">beta</b> gamma'


def test_mining(spark):
    data = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (11.0,)], "x double")
    rows, centers = M.kmeans_1d(data, "x", [1.0, 10.0])
    assert [(r.x, r.label) for r in rows.orderBy("x").collect()] == [(1.0, 0), (2.0, 0), (10.0, 1), (11.0, 1)] and centers == [1.5, 10.5]
    runs = M.sliding_clusters(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10, 11)], "x double"), "x", 3)
    assert sorted((r.left, r.right, r["count"], round(r.variance, 3)) for r in runs.collect()) == [
        (1, 10, 3, 16.667), (2, 10, 2, 19), (3, 10, 1, 99999), (10, 11, 1, 99999), (11, 11, 0, 99999)]
    best = M.suggest_from_list(words(spark, "specail", name="text"), words(spark, "special", "spatial")).orderBy("rank").first()
    assert (best.suggestion, best.distance) == ("special", 1)


def test_range_buckets():
    assert Fa.range_buckets(0, 30, [1, 5, 10])[:4] == [(0, 1), (1, 6), (6, 16), (16, 26)]
    assert len(Fa.range_buckets(0, 1000, [100])) == 10 and Fa.range_buckets(0, 45, [10], hardend=True)[-1] == (40, 45)


@pytest.mark.parametrize("files", [1, 3])
def test_stream_replay(spark, tmp_path, files):
    feed = [(1, "java", "upsert", 1), (2, "ruby", "upsert", 2), (3, "python", "upsert", 3), (2, None, "delete", 4), (3, "java", "upsert", 5), (4, "old", "upsert", 6), (4, "new", "upsert", 7)]
    schema = "id long, tags string, op string, seq long"
    spark.createDataFrame(feed, schema).repartitionByRange(files, "seq").write.parquet(str(tmp_path / "feed"))
    table = ChangeTable(spark, str(tmp_path / "table"), "id", "id long, tags string")
    q = stream_upsert_delete(stream_tail(spark, str(tmp_path / "feed"), schema, files_per_batch=1), table, str(tmp_path / "cp"))
    q.awaitTermination()
    expected = [(1, "java"), (3, "java"), (4, "new")]
    assert sorted(map(tuple, table.current().collect())) == expected
    table.compact()
    table.apply(spark.createDataFrame([(5, "five", "upsert", 8), (1, None, "delete", 9)], schema), 1000)
    assert sorted(map(tuple, table.current().collect())) == [(3, "java"), (4, "new"), (5, "five")]


# Names with their codes as the published algorithm gives them.
NAMES = {
    "maurice": ("MRS", None), "aubrey": ("APR", None), "cambrillo": ("KMPRL", "KMPR"), "heidi": ("HT", None), "katherine": ("K0RN", "KTRN"),
    "catherine": ("K0RN", "KTRN"), "richard": ("RXRT", "RKRT"), "bob": ("PP", None), "eric": ("ARK", None), "geoff": ("JF", "KF"),
    "Through": ("0R", "TR"), "Schwein": ("XN", "XFN"), "dave": ("TF", None), "ray": ("R", None), "steven": ("STFN", None), "bryce": ("PRS", None),
    "randy": ("RNT", None), "bryan": ("PRN", None), "Rapelje": ("RPL", None), "brian": ("PRN", None), "otto": ("AT", None), "auto": ("AT", None),
    "Dallas": ("TLS", None), "maisey": ("MS", None), "zhang": ("JNK", None), "Chile": ("XL", None), "Jose": ("HS", None), "Arnow": ("ARN", "ARNF"),
    "solilijs": ("SLLS", None), "Parachute": ("PRKT", None), "Nowhere": ("NR", None), "Tux": ("TKS", None), "zone": ("SN", None), "hochmeier": ("HKMR", None),
}


@pytest.mark.parametrize("name", NAMES)
def test_double_metaphone(name):
    assert double_metaphone(name) == NAMES[name]


def test_highlight_keeps_places_of_letters_that_grow(spark):
    docs = spark.createDataFrame([(1, "İİ apple pie, Apple")], "doc_id long, text string")
    words = spark.createDataFrame([("apple",)], "term string")
    assert Di.highlight_terms(docs, words).first()["marked"] == "İİ <b>apple</b> pie, <b>Apple</b>"


def test_fold_accents_of_whole_alphabets(spark):
    assert terms(spark, T.chain(T.tok_space, T.f_fold_accents), "Tiếng Việt Łódź Ærø ñandú groß") == ["tieng", "viet", "lodz", "aero", "nandu", "gross"]


def test_block_profile_names_every_block(spark):
    docs = spark.createDataFrame([("aé ქ ế ア — 漢",)], "text string")
    got = {r["block"]: r["n"] for r in L.block_profile(docs).collect()}
    assert got == {"Basic Latin": 6, "Latin-1 Supplement": 1, "Georgian": 1, "Latin Extended Additional": 1, "Katakana": 1, "General Punctuation": 1, "CJK Unified Ideographs": 1}


def test_terms_prune_the_partitions_that_are_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common word{i} other{i}") for i in range(200)], "doc_id long, text string")
    saved = SearchIndex.build(docs, [I.text_field("text")]).save(str(tmp_path / "index"))
    asked = spark.createDataFrame([(0, 0, "text", "word7")], "query_id long, clause_id int, field string, term string")
    hits = C.match(saved, asked)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = C._asked(saved, asked)[1]
    assert read.select(F.input_file_name()).distinct().count() == 1 < saved.postings.select(F.input_file_name()).distinct().count()
    assert [r["doc_id"] for r in hits.collect()] == [7]


def test_late_change_does_not_undo_a_newer_one(spark, tmp_path):
    schema = "id long, tags string, op string, seq long"
    table = ChangeTable(spark, str(tmp_path / "table"), "id", "id long, tags string")
    table.apply(spark.createDataFrame([(1, "new", "upsert", 9), (2, "gone", "delete", 9)], schema), 0)
    table.apply(spark.createDataFrame([(1, "stale", "upsert", 2)], schema), 1)
    assert [tuple(r) for r in table.current().collect()] == [(1, "new")]
    table.compact()
    table.apply(spark.createDataFrame([(1, "older", "upsert", 5), (2, "older", "upsert", 5), (3, "three", "upsert", 1)], schema), 2)
    assert sorted(tuple(r) for r in table.current().collect()) == [(1, "new"), (3, "three")]
