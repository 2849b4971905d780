"""Jobs over the distinct terms: stems, sound codes, variants, synonyms, compounds.

Python runs here only, once per distinct term, in Arrow batches; results are joined back by term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phonetic
from ..functions.arrays import indices, let, let_all
from ..functions.stem import stem
from ..joins import lookup_join
from ..session import settle


def lex_map(lexicon: DataFrame, fn: Callable[[str], str], term: str = "term", out: str = "mapped") -> DataFrame:
    """Map each distinct term with a plain function: (term, mapped)."""
    @F.pandas_udf("string")
    def apply(words: pd.Series) -> pd.Series:
        return words.map(fn)

    return lexicon.select(term).distinct().withColumn(out, apply(F.col(term)))


def lex_stem(lexicon: DataFrame, ignore: Iterable[str] = (), fn: Callable[[str], str] = stem) -> DataFrame:
    """(term, stem); words in ``ignore`` are their own stem."""
    kept = frozenset(ignore)
    return lex_map(lexicon, lambda w: w if w in kept else fn(w), out="stem")


def stem_postings(postings: DataFrame, stems: DataFrame) -> DataFrame:
    """Postings by stem: the term is replaced through the lexicon map and equal (document, stem) entries merge.

    A (field, stem, document) group holds at most the document's own words.
    """
    joined = postings.join(stems, "term")
    return joined.groupBy("field", F.col("stem").alias("term"), "doc_id").agg(
        F.sum("tf").alias("tf"), F.sum("weight").alias("weight"),
        F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.max("doc_len").alias("doc_len"))


def an_stemming(tokens: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    """Token rows (doc_id, pos, term) with each term stemmed through the lexicon."""
    return tokens.join(lex_stem(tokens, ignore), "term").withColumn("term", F.col("stem")).drop("stem")


def lex_soundex(lexicon: DataFrame) -> DataFrame:
    return lexicon.select("term").distinct().withColumn("code", phonetic.lex_soundex(F.col("term")))


def lex_metaphone(lexicon: DataFrame, primary_boost: float = 1.0, secondary_boost: float = 0.5, combine: bool = False) -> DataFrame:
    """(term, code, boost), one or two codes per term; ``combine`` keeps the word itself as well."""
    @F.pandas_udf("primary string, secondary string")
    def codes(words: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([phonetic.double_metaphone(w) for w in words], columns=["primary", "secondary"])

    out = [F.struct(F.col("c.primary").alias("code"), F.lit(float(primary_boost)).alias("boost")),
           F.struct(F.col("c.secondary").alias("code"), F.lit(float(secondary_boost)).alias("boost"))]
    if combine:
        out.insert(0, F.struct(F.col("term").alias("code"), F.lit(1.0).alias("boost")))
    return (lexicon.select("term").distinct().withColumn("c", codes(F.col("term")))
            .select("term", F.explode(F.filter(F.array(*out), lambda x: x["code"].isNotNull() & (x["code"] != ""))).alias("x"))
            .select("term", "x.code", "x.boost"))


# English endings; a word is a variant of another when both are the same root with one of them.
ENDINGS = (
    "", "s", "es", "er", "ers", "est", "ed", "ing", "ings", "ly", "ness", "nesses", "ment", "ments", "less", "ful",
    "ize", "izes", "ized", "izing", "izer", "izers", "ization", "izations",
)
# Endings before which a final e is dropped, a consonant doubled or y turned into i.
_VOWEL_START = ("es", "er", "ers", "est", "ed", "ing", "ings")


def roots(word: str) -> list[str]:
    """Every root the word can be built from by one ending: plain, with e dropped, doubled consonant, or y as i."""
    out = set()
    for e in ENDINGS:
        base = word[: len(word) - len(e)]
        if not word.endswith(e) or len(base) < 2 or not set(base) & set("aeiouy"):
            continue
        out.add(base)
        closed = base[-1] not in "aeiou"
        if e in _VOWEL_START and closed:
            out.add(base + "e")
            if base[-1] == base[-2] and base[-1] in "bdgklmnprst":
                out.add(base[:-1])
        if e not in ("", "s", "ing", "ings") and base[-1] == "i" and base[-2] not in "aeiou":
            out.add(base[:-1] + "y")
    return sorted(out)


def with_roots(words: DataFrame, word: str) -> DataFrame:
    @F.pandas_udf("array<string>")
    def apply(ws: pd.Series) -> pd.Series:
        return ws.map(roots)

    return words.withColumn("root", F.explode(apply(F.col(word))))


def lex_variations(words: DataFrame, lexicon: DataFrame, word: str = "word", irregular: DataFrame | None = None) -> DataFrame:
    """(word, variant): lexicon words that are another ending on one of the word's roots.

    Roots are joined by equality; a root's group is bounded by the number of endings. ``irregular`` is an optional table
    (family, form): words of one family are variants of each other.
    """
    own = words.select(F.col(word).alias("word")).distinct()
    asked = settle(with_roots(own, "word"))
    # The root itself must be a word, as variants are kept only if they are in the lexicon.
    terms = lexicon.select("term").distinct()
    real = terms.withColumnRenamed("term", "root").join(asked.select("root").distinct(), "root", "left_semi")
    known = settle(asked.join(real.select("root"), "root", "left_semi"))
    found = lookup_join(with_roots(terms, "term"), known, ["root"]).select("word", F.col("term").alias("variant"))
    if irregular is not None:
        family = irregular.select("family", F.col("form").alias("word")).join(own, "word", "left_semi")
        found = found.union(irregular.join(family, "family").select("word", F.col("form").alias("variant"))
                            .join(terms.withColumnRenamed("term", "variant"), "variant", "left_semi").select("word", "variant"))
    itself = own.join(terms.withColumnRenamed("term", "word"), "word", "left_semi").select("word", F.col("word").alias("variant"))
    return found.union(itself).distinct()


def expand_synonyms(synsets: DataFrame, words: DataFrame, word: str = "word") -> DataFrame:
    """(word, synonym): all other words sharing any synset."""
    asked = lookup_join(synsets.withColumnRenamed("word", "_w"), words.select(F.col(word).alias("_w")).distinct(), ["_w"])
    other = synsets.select("synset", F.col("word").alias("synonym"))
    return lookup_join(other, asked.select("synset", F.col("_w").alias("word")), ["synset"]) \
        .filter(F.col("word") != F.col("synonym")).select("word", "synonym").distinct()


# Pieces of terms that a task looks up.
TASK_PIECES = 1 << 22


def f_compound(lexicon: DataFrame, dictionary: DataFrame, keep_compound: bool = True) -> DataFrame:
    """(term, part, part_no): terms fully covered by dictionary words, cut with the shortest first word that works out.

    Per term, the dictionary words found at each start come from an equality join on substrings; the cut is then
    chosen from the end backwards inside the row: a start is good if one of its words ends at the end or at a good start.
    """
    words = dictionary.select(F.col("term").alias("piece")).distinct()
    # No piece longer than the longest word: the pieces of a term are its length times that bound.
    longest = words.agg(F.max(F.length("piece"))).first()[0] or 1
    terms = lexicon.select("term").filter("term <> ''")
    # All pieces of a term stay in the term's task; there are tasks enough that the pieces, not the terms, fit its memory.
    most = terms.agg(F.sum((F.length("term") * F.least(F.length("term"), F.lit(longest))).cast("long"))).first()[0] or 0
    tasks = max(lexicon.sparkSession.sparkContext.defaultParallelism, -(-most // TASK_PIECES))
    pieces = terms.repartition(tasks, "term").distinct().withColumn("at", F.explode(F.sequence(F.lit(0), F.length("term") - 1))) \
        .withColumn("len", F.explode(F.sequence(F.lit(1), F.least(F.length("term") - F.col("at"), F.lit(longest))))) \
        .withColumn("piece", F.substring("term", F.col("at") + 1, F.col("len")))
    found = lookup_join(pieces, words, ["piece"])

    def cut(v: Column) -> Column:
        n = F.length(v["term"])
        # next[i] = length of the shortest word at i from which the rest can be covered, 0 if none.
        def step(acc: Column, k: Column) -> Column:
            i = n - 1 - k
            good = F.filter(v["spots"], lambda s: (s["at"] == i) & ((i + s["len"] == n) | (F.coalesce(F.get(acc, n - 1 - i - s["len"]), F.lit(0)) > 0)))
            best = F.coalesce(F.array_min(F.transform(good, lambda s: s["len"])), F.lit(0))
            return F.concat(acc, F.array(best.cast("int")))

        lens = F.aggregate(indices(n), F.array().cast("array<int>"), step)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

        def walk(ls: Column) -> Column:
            def move(acc: Column, _: Column) -> Column:
                width = F.coalesce(F.get(ls, n - 1 - acc["at"]), F.lit(0))
                go = (acc["at"] < n) & (width > 0)
                return F.struct(F.when(go, acc["at"] + width).otherwise(acc["at"]).alias("at"),
                                F.when(go, F.concat(acc["parts"], F.array(F.substring(v["term"], acc["at"] + 1, width)))).otherwise(acc["parts"]).alias("parts"))
            return F.aggregate(indices(n), start, move, lambda acc: F.when(acc["at"] == n, acc["parts"]).otherwise(F.array().cast("array<string>")))

        return let(lens, walk)

    def parted(v: Column) -> Column:
        n = F.length(v["term"])
        # Two parts or more need a word that starts the term and another that ends it.
        starts = F.exists(v["spots"], lambda s: (s["at"] == 0) & (s["len"] < n))
        ends = F.exists(v["spots"], lambda s: (s["at"] > 0) & (s["at"] + s["len"] == n))
        return F.when(starts & ends, cut(v))

    # The list per term is bounded by the term's own length. Cut where it is made, so that the filter does not cut a second time.
    spots = F.collect_list(F.struct("at", "len"))
    parts = found.groupBy("term").agg(let_all({"term": F.col("term"), "spots": spots}, parted).alias("parts")).filter(F.size("parts") > 1)
    out = F.concat(F.array("term"), F.col("parts")) if keep_compound else F.col("parts")
    return parts.select("term", F.posexplode(out).alias("part_no", "part"))


def compound_tokens(tokens: DataFrame, splits: DataFrame, keep: str = "term") -> DataFrame:
    """Token rows with compound terms replaced by their parts at the same position; other terms stay."""
    joined = tokens.join(splits, "term", "left")
    return joined.withColumn("term", F.coalesce("part", "term")).withColumn("part_no", F.coalesce("part_no", F.lit(0))).drop("part")


# ---- block profile ----------------------------------------------------------------------------------------------

def block_of(code: Column) -> Column:
    """The Unicode block of a code point, by the virtual machine's own table of all blocks, in the standard's spelling; null outside
    of any block."""
    name = F.java_method(F.lit("java.lang.Character$UnicodeBlock"), F.lit("of"), code.cast("int"))
    words = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    for pattern, spelled in ((r"^Latin 1 ", "Latin-1 "), (r" (Extended|Forms) ([A-J])\b", " $1-$2"), (r"\bAnd\b", "and"), (r"\bCjk\b", "CJK"), (r"\bIpa\b", "IPA")):
        words = F.regexp_replace(words, pattern, spelled)
    return F.when(name != "null", words)


def block_profile(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Characters per block. Counts per distinct character come first, so blocks are looked up for a few hundred
    characters instead of for every one."""
    chars = corpus.select(F.explode(F.split(F.col(text), "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    code = F.conv(F.hex(F.encode("ch", "UTF-32")), 16, 10).cast("long")
    return chars.withColumn("block", block_of(code)).groupBy("block").agg(F.sum("n").alias("n"))
