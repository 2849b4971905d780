"""Key terms, similar and near-duplicate documents, one-dimensional clustering, spelling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import indices, let
from ..functions.distance import edit_distance
from ..functions.scoring import BM25, Bo1, Model
from ..joins import best_per_group, lookup_join, next_value, wide_running
from ..session import settle
from .clauses import existing_terms, match, within_distance
from .combine import any_of
from .index import SearchIndex
from .ranking import top_k

# ---- key terms --------------------------------------------------------------------------------------------------


def key_terms(index: SearchIndex, weights: DataFrame, field: str, model=None, number: int = 5, normalize: bool = True) -> DataFrame:
    """Most telling terms of each document set: (set_id, term, weight, rank).

    ``weights`` is (set_id, term, w): the summed term weights of a set. Terms missing from the collection drop out.
    """
    model = model or Bo1()
    totals = weights.groupBy("set_id").agg(F.sum("w").alias("top_total"))
    stats = index.term_stats.filter(F.col("field") == field).select("term", "cf")
    fields = F.broadcast(index.field_stats.filter(F.col("field") == field).select(
        F.col("n_docs").cast("double").alias("n_docs"), F.col("total_len").cast("double").alias("total_len")))
    rows = weights.join(stats, "term").join(totals, "set_id").join(fields)
    cols = (F.col("top_total"), F.col("n_docs"), F.col("total_len"))
    scored = rows.withColumn("raw", model.score(F.col("w"), F.col("cf"), *cols))
    # Ranked on the rounded score, so that equal scores tie whatever the order of the additions.
    best = best_per_group(scored, ["set_id"], [F.round("raw", 9).desc(), F.col("term").asc()], number, "rank")
    # The best score of a set is that of its first row: no second pass over the set.
    top = F.max("raw").over(Window.partitionBy("set_id"))
    norm = model.norm(top, *cols) if normalize else top
    return best.withColumn("weight", F.col("raw") / norm).select("set_id", "term", "weight", "rank")


def set_weights(index: SearchIndex, members: DataFrame, field: str) -> DataFrame:
    """(set_id, term, w) for sets of documents given as (set_id, doc_id)."""
    terms = index.forward.filter(F.col("field") == field).select("doc_id", "terms")
    return members.join(terms, "doc_id").select("set_id", F.explode("terms").alias("t")) \
        .groupBy("set_id", "t.term").agg(F.sum("t.weight").alias("w"))


def key_terms_docs(index: SearchIndex, field: str, model=None, number: int = 5, normalize: bool = True) -> DataFrame:
    """Key terms of every single document: (set_id = doc_id, term, weight, rank).

    Each document's total is in its row; the only large join is postings with term statistics, and partial top-k per
    task keeps the ranking shuffle at ``number`` rows per document.
    """
    model = model or Bo1()
    fields = F.broadcast(index.field_stats.filter(F.col("field") == field).select(
        F.col("n_docs").cast("double").alias("n_docs"), F.col("total_len").cast("double").alias("total_len")))
    total = F.aggregate(F.col("terms.weight"), F.lit(0.0), lambda acc, x: acc + x)
    rows = index.forward.filter(F.col("field") == field).select(F.col("doc_id").alias("set_id"), total.alias("top_total"), F.explode("terms").alias("t")) \
        .select("set_id", "top_total", "t.term", F.col("t.weight").alias("w"))
    stats = index.term_stats.filter(F.col("field") == field).select("term", "cf")
    cols = (F.col("top_total"), F.col("n_docs"), F.col("total_len"))
    scored = rows.join(stats, "term").join(fields).withColumn("raw", model.score(F.col("w"), F.col("cf"), *cols))
    best = best_per_group(scored, ["set_id"], [F.round("raw", 9).desc(), F.col("term").asc()], number, "rank")
    top = F.max("raw").over(Window.partitionBy("set_id"))
    norm = model.norm(top, *cols) if normalize else top
    return best.withColumn("weight", F.col("raw") / norm).select("set_id", "term", "weight", "rank")


def key_terms_text(index: SearchIndex, texts: DataFrame, analyzer, field: str, model=None, number: int = 5,
                   text: str = "text", key: str = "set_id") -> DataFrame:
    """Key terms of texts from outside the corpus."""
    weights = texts.select(F.col(key).alias("set_id"), F.explode(analyzer(F.col(text))).alias("t")) \
        .groupBy("set_id", "t.term").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return key_terms(index, weights, field, model, number)


def key_terms_results(index: SearchIndex, hits: DataFrame, field: str, docs: int = 10, number: int = 5, model=None) -> DataFrame:
    """Key terms of the top documents of each query."""
    best = top_k(hits, docs).select(F.col("query_id").alias("set_id"), "doc_id")
    return key_terms(index, set_weights(index, best, field), field, model, number)


def more_like(index: SearchIndex, field: str, top: int = 10, number: int = 5, model: Model | None = None,
              allowed: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Similar documents for every document: (doc_id, like_id, score, rank).

    A document's query is the OR of its key terms, boosted by their weight. Copies have the same query, so queries are
    first reduced to distinct ones: a group of copies, however large, is searched once and its answer is handed out.
    One spare hit per query makes room for leaving the document itself out.
    """
    keys = key_terms_docs(index, field, number=number)
    if docs is not None:
        keys = keys.join(docs.select(F.col("doc_id").alias("set_id")), "set_id", "left_semi")
    # At most ``number`` rows per document are gathered.
    signed = keys.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("term", F.round("weight", 9).alias("weight")))).alias("terms"))
    signed = settle(signed.withColumn("query_id", F.sha2(F.to_json("terms"), 256)))
    queries = signed.groupBy("query_id").agg(F.first("terms").alias("terms"))
    clauses = queries.select("query_id", F.posexplode("terms").alias("clause_id", "t")) \
        .select("query_id", "clause_id", F.lit(field).alias("field"), "t.term", F.col("t.weight").alias("boost"))
    hits = any_of(match(index, clauses, model or BM25(), together=True)).withColumn("score", F.round("score", 9))
    if allowed is not None:
        hits = hits.join(allowed.select("doc_id"), "doc_id", "left_semi")
    best = top_k(hits, top + 1).select("query_id", F.col("doc_id").alias("like_id"), "score", "rank")
    # Per query at most top + 1 rows are gathered, then handed to each of its documents.
    lists = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "like_id", "score"))).alias("best"))
    given = signed.select("query_id", F.col("set_id").alias("doc_id")).join(lists, "query_id")
    others = F.slice(F.filter("best", lambda b: b["like_id"] != F.col("doc_id")), 1, top)
    return given.select("doc_id", F.posexplode(others).alias("_i", "b")) \
        .select("doc_id", "b.like_id", "b.score", (F.col("_i") + 1).cast("long").alias("rank"))


# ---- simhash ------------------------------------------------------------------------------------------------------

def char_shingles(corpus: DataFrame, text: str = "text", size: int = 2, key: str = "doc_id") -> DataFrame:
    """Counts of character k-grams: (doc_id, shingle, n)."""
    chars = F.filter(F.split(F.col(text), ""), lambda c: c != "")
    cut = let(chars, lambda cs: F.transform(indices(F.size(cs) - (size - 1)), lambda i: F.array_join(F.slice(cs, i + 1, F.lit(size)), "")))
    return corpus.select(F.col(key).alias("doc_id"), F.explode(cut).alias("shingle")) \
        .groupBy("doc_id", "shingle").agg(F.count(F.lit(1)).alias("n"))


def feature_hash(feature: Column, bits: int = 32) -> Column:
    """The first bits of the md5 of a feature, as a number (a hash that other engines can repeat)."""
    return F.conv(F.substring(F.md5(feature), 1, bits // 4), 16, 10).cast("long")


def simhash(features: DataFrame, bits: int = 32, key: str = "doc_id", feature: str = "shingle", weight: str = "n") -> DataFrame:
    """Sign of the weighted bit sums of the feature hashes: one conditional sum per bit, combined map-side."""
    h = features.select(key, F.col(weight).alias("_w"), feature_hash(F.col(feature), bits).alias("_h"))
    sums = [F.sum(F.when(F.getbit("_h", F.lit(i)) == 1, F.col("_w")).otherwise(-F.col("_w"))).alias(f"_b{i}") for i in range(bits)]
    value = sum((F.when(F.col(f"_b{i}") > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(bits)), F.lit(0).cast("long"))
    return h.groupBy(key).agg(*sums).select(key, value.alias("simhash"))


def hamming_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _flips(value: Column, flips: int, bits: int) -> Column:
    """The value with every choice of up to ``flips`` bits turned over; choices are literals made once."""
    masks = [0]
    frontier = [(0, -1)]
    for _ in range(flips):
        frontier = [(m | (1 << j), j) for m, last in frontier for j in range(last + 1, bits)]
        masks += [m for m, _ in frontier]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def near_duplicates(hashes: DataFrame, k: int = 2, bits: int = 32, key: str = "doc_id", value: str = "simhash") -> DataFrame:
    """All near-duplicate relations in a form linear in the documents: (doc_a, doc_b, distance).

    Documents with one hash form a group, linked to the group's lowest id at distance 0 (a star, not all pairs). Groups
    whose hashes differ in at most ``k`` bits are linked through their lowest ids. Any pair of documents within k bits is
    exactly a pair of linked (or equal) groups, so nothing is lost however many copies a document has.

    Group pairs meet by equality: one side offers its hash with up to k - k//2 bits flipped, the other with up to k//2.
    A join key is a full hash, so its group is bounded by the number of flips, even when hashes cluster.
    """
    groups = settle(hashes.groupBy(F.col(value).alias("h")).agg(F.min(key).alias("doc")))
    stars = lookup_join(hashes.select(F.col(value).alias("h"), F.col(key).alias("doc_b")), groups, ["h"]) \
        .filter(F.col("doc") != F.col("doc_b")).select(F.col("doc").alias("doc_a"), "doc_b", F.lit(0).alias("distance"))
    left = groups.select(F.col("h").alias("ha"), F.col("doc").alias("da"), F.explode(_flips(F.col("h"), k - k // 2, bits)).alias("probe"))
    right = groups.select(F.col("h").alias("hb"), F.col("doc").alias("db"), F.explode(_flips(F.col("h"), k // 2, bits)).alias("probe"))
    # ha < hb keeps one direction; a pair found through several probes is made distinct.
    pairs = left.join(right, "probe").filter(F.col("ha") < F.col("hb")).select("ha", "hb", "da", "db").distinct()
    linked = pairs.select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b"),
                          hamming_distance(F.col("ha"), F.col("hb")).cast("int").alias("distance"))
    return stars.union(linked)


# ---- one-dimensional statistics and clusters --------------------------------------------------------------------

def variance_two_pass(table: DataFrame, column: str) -> DataFrame:
    return table.agg(F.var_samp(column).alias("variance"))


def variance_weighted(table: DataFrame, column: str, weight: str) -> DataFrame:
    """Frequency-weighted sample variance from three sums in one pass, centred on a first value to keep precision."""
    x, w = F.col(column), F.col(weight)
    mean = table.agg((F.sum(x * w) / F.sum(w)).alias("m"))
    centred = table.join(F.broadcast(mean))
    return centred.agg((F.sum(w * (x - F.col("m")) * (x - F.col("m"))) / (F.sum(w) - 1)).alias("variance"))


def kmeans_1d(data: DataFrame, column: str, centers: Sequence[float], tolerance: float = 0.0001, maxiter: int = 50) -> tuple[DataFrame, list[float]]:
    """Lloyd's iteration on one column: (rows with ``label``, centres).

    Each round is one aggregate of k rows; the k centres are literals. An emptied cluster's centre becomes 0.
    """
    x = F.col(column)

    def nearest(cs: Sequence[float]) -> Column:
        ranked = F.array(*[F.struct(((x - F.lit(float(c))) * (x - F.lit(float(c)))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(cs)])
        return F.array_min(ranked)

    cs = [float(c) for c in centers]
    previous = float("inf")
    labelled = data.withColumn("_n", nearest(cs))
    for _ in range(maxiter + 1):
        rows = labelled.groupBy("_n.i").agg(F.avg(x).alias("m"), F.sum("_n.d").alias("e")).collect()  # k rows
        error = sum(r["e"] for r in rows)
        means = {r["i"]: r["m"] for r in rows}
        labels_from = list(cs)
        cs = [means.get(i, 0.0) for i in range(len(cs))]
        labelled = data.withColumn("_n", nearest(labels_from))
        if abs(error - previous) < tolerance:
            break
        previous = error
        labelled = data.withColumn("_n", nearest(cs))
    return labelled.withColumn("label", F.col("_n.i")).drop("_n"), cs


def sliding_clusters(data: DataFrame, column: str, size: float) -> DataFrame:
    """For each value, the run to its right until the span reaches ``size``: (left, right, count, variance).

    Values are cut into cells of width ``size``, so a run lies in its own cell, the next one and one value beyond. Running
    sums inside each cell (spread over tasks by :func:`wide_running`) then give a run's sums by subtraction; they are kept
    relative to the cell's start, so precision does not depend on the size of the values.
    """
    size = float(size)
    v = F.col(column).cast("double")
    cell = lambda c: F.floor(c / size).cast("long")
    base = lambda c: c.cast("double") * size
    values = data.filter(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n")).withColumn("cell", cell(F.col("v")))
    x = F.col("v") - base(F.col("cell"))
    run = wide_running(values, ["cell"], [F.col("v")], {"rn": F.col("n"), "r1": F.col("n") * x, "r2": F.col("n") * x * x})
    run = settle(run)
    sums = run.groupBy("cell").agg(F.sum("n").cast("double").alias("tn"), F.max_by("r1", "v").alias("t1"), F.max_by("r2", "v").alias("t2"))
    stop = next_value(run.select("v"), run.select("v", (F.col("v") + size).alias("probe")))
    at = run.select(F.col("v").alias("u"), F.col("cell").alias("ucell"), F.col("n").alias("un"), F.col("rn").alias("urn"),
                    F.col("r1").alias("ur1"), F.col("r2").alias("ur2"))
    after = sums.select((F.col("cell") - 1).alias("cell"), F.col("tn").alias("an"), F.col("t1").alias("a1"), F.col("t2").alias("a2"))
    rows = (run.join(stop, "v", "left").join(at, "u", "left").join(sums, "cell").join(after, "cell", "left"))
    b = base(F.col("cell"))
    xu = F.col("u") - base(F.col("ucell"))
    # The next cell: all of it, or what lies before the stopping value when that value is in it.
    stops_next = F.coalesce(F.col("ucell") == F.col("cell") + 1, F.lit(False))
    stops_here = F.coalesce(F.col("ucell") == F.col("cell"), F.lit(False))
    zero = F.lit(0.0)
    nn = F.when(stops_here, zero).when(stops_next, F.col("urn") - F.col("un")).otherwise(F.coalesce("an", zero))
    n1 = F.when(stops_here, zero).when(stops_next, F.col("ur1") - F.col("un") * xu).otherwise(F.coalesce("a1", zero))
    n2 = F.when(stops_here, zero).when(stops_next, F.col("ur2") - F.col("un") * xu * xu).otherwise(F.coalesce("a2", zero))
    here_n = F.when(stops_here, F.col("urn") - F.col("un")).otherwise(F.col("tn"))
    here_1 = F.when(stops_here, F.col("ur1") - F.col("un") * xu).otherwise(F.col("t1"))
    here_2 = F.when(stops_here, F.col("ur2") - F.col("un") * xu * xu).otherwise(F.col("t2"))
    last = F.when(F.col("u").isNotNull(), 1.0).otherwise(0.0)
    xl = F.coalesce(F.col("u") - b, zero)
    top = data.agg(F.max(v).alias("top"))
    xs = F.col("v") - b
    # Everything relative to the left value itself: shift each cell's sums by d.
    def shifted(m, s1, s2, d):
        return s1 + m * d, s2 + 2 * d * s1 + m * d * d
    m_here = here_n - (F.col("rn") - F.col("n"))
    s1h, s2h = shifted(m_here, here_1 - (F.col("r1") - F.col("n") * xs), here_2 - (F.col("r2") - F.col("n") * xs * xs), -xs)
    s1n, s2n = shifted(nn, n1, n2, F.lit(size) - xs)
    du = xl - xs
    each = (rows.join(F.broadcast(top))
            .withColumn("_m", m_here + nn + last).withColumn("_1", s1h + s1n + last * du).withColumn("_2", s2h + s2n + last * du * du)
            .withColumn("right", F.coalesce("u", "top"))
            .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))))
    m = F.col("_m") - F.col("_copy")  # earlier copies of the left value are 0 relative to it
    var = (F.col("_2") - F.col("_1") * F.col("_1") / m) / (m - 1)
    return each.select(F.col("v").alias("left"), "right", (m - 1).cast("long").alias("count"),
                       F.when(m - 1 > 1, var).otherwise(F.lit(99999.0)).alias("variance")) \
        .orderBy(F.desc("count"), "variance", "left")


# ---- similar strings and corrections ------------------------------------------------------------------------------

def suggest(words: DataFrame, dictionary: DataFrame, limit: int = 5, maxdist: int = 2, prefix: int = 0, keys: DataFrame | None = None) -> DataFrame:
    """Corrections for a table of words: (field, text, suggestion, distance, freq, rank).

    ``words`` is (field, text); ``dictionary`` is (field, term, freq). Nearer first, then more frequent, then by word; the
    word itself is left out. ``keys`` are the dictionary's stored keys (:attr:`SearchIndex.close_keys`).
    """
    pairs = settle(within_distance(words, dictionary, maxdist, prefix, keys).filter(F.col("text") != F.col("term")))
    found = lookup_join(dictionary.select("field", "term", "freq"), pairs, ["field", "term"])
    best = best_per_group(found, ["field", "text"], [F.asc("distance"), F.desc("freq"), F.asc("term")], limit, "rank")
    return best.select("field", "text", F.col("term").alias("suggestion"), "distance", "freq", "rank")


def suggest_from_list(words: DataFrame, *sources: DataFrame, limit: int = 5, maxdist: int = 2, prefix: int = 0) -> DataFrame:
    """Corrections from word lists (term) or from several sources at once; only the distance counts."""
    terms = sources[0].select("term")
    for s in sources[1:]:
        terms = terms.union(s.select("term"))
    listed = terms.distinct().select(F.lit("").alias("field"), "term", F.lit(0.0).alias("freq"))
    return suggest(words.select(F.lit("").alias("field"), "text"), listed, limit, maxdist, prefix).drop("field", "freq")


def gram_rows(words: DataFrame, word: str, mingram: int = 3, maxgram: int = 4) -> DataFrame:
    """(word, kind, gram, tf): all grams of each size, and the first and last gram of each size as kinds of their own."""
    w = F.lower(F.col(word))

    def of_size(size: int) -> list[Column]:
        n = F.length(w) - (size - 1)
        entry = lambda kind, gram: F.struct(F.lit(f"{kind}{size}").alias("kind"), gram.alias("gram"))
        grams = F.transform(indices(n), lambda i: entry("gram", F.substring(w, i + 1, F.lit(size))))
        ends = F.filter(F.array(F.when(n > 0, entry("start", F.substring(w, F.lit(1), F.lit(size)))),
                                F.when(n > 0, entry("end", F.substring(w, n, F.lit(size))))), lambda x: x.isNotNull())
        return [grams, ends]

    cells = [c for size in range(mingram, maxgram + 1) for c in of_size(size)]
    return words.select(F.col(word).alias("word"), F.explode(F.concat(*cells)).alias("g")).groupBy("word", "g.kind", "g.gram").agg(F.count(F.lit(1)).alias("tf"))


def suggest_ngrams(texts: DataFrame, words: DataFrame, number: int = 3, booststart: float = 2.0, boostend: float = 1.0,
                   mingram: int = 3, maxgram: int = 4, minscore: float = 0.5) -> DataFrame:
    """Candidates by shared grams (tf-idf), re-ranked by edit distance: (text, suggestion, distance, score, rank)."""
    vocabulary = words.select("term").distinct()
    grams = gram_rows(vocabulary, "term", mingram, maxgram)
    df = grams.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("df"))
    asked = gram_rows(texts.select("text").distinct(), "text", mingram, maxgram).select(F.col("word").alias("text"), "kind", "gram")
    # Sizes as long as the text are not asked.
    asked = asked.filter(F.regexp_extract("kind", r"(\d+)$", 1).cast("int") < F.length("text"))
    total = vocabulary.agg(F.count(F.lit(1)).alias("n"))
    weighed = lookup_join(df, asked, ["kind", "gram"]).join(F.broadcast(total))
    boost = F.when(F.col("kind").startswith("start"), booststart).when(F.col("kind").startswith("end"), boostend).otherwise(1.0)
    scored = lookup_join(grams, weighed, ["kind", "gram"]).filter(F.col("word") != F.col("text")) \
        .withColumn("s", boost * F.col("tf") * (F.ln(F.col("n") / (F.col("df") + 1)) + 1)) \
        .groupBy("text", "word").agg(F.sum("s").alias("score")).withColumn("score", F.round("score", 9)) \
        .withColumn("distance", edit_distance(F.col("text"), F.col("word")))
    best = best_per_group(scored, ["text"], [F.asc("distance"), F.desc("score"), F.asc("word")], number, "rank")
    return best.filter(F.col("score") >= minscore).select("text", F.col("word").alias("suggestion"), "distance", "score", "rank")


def correct_queries(index: SearchIndex, terms: DataFrame, maxdist: int = 2, prefix: int = 0) -> DataFrame:
    """Query terms with ``corrected``: a term missing from the lexicon becomes its best suggestion, if there is one."""
    missing = settle(existing_terms(index, terms, reverse=True).select("field", F.col("term").alias("text")).distinct())
    words = index.term_stats.select("field", "term", F.col("cf").alias("freq"))
    best = settle(suggest(missing, words, 1, maxdist, prefix, index.close_keys).select("field", F.col("text").alias("term"), "suggestion"))
    return lookup_join(terms, best, ["field", "term"], "left").withColumn("corrected", F.coalesce("suggestion", "term")).drop("suggestion")
