"""Join keys of the lexicon, stored with the index: grams that patterns meet terms by, and what is left of terms' heads after deletions, that close words meet by.

``grams`` (field, gram, term), ``gram_stats`` (field, gram, n), ``close_keys`` (field, key, term)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import indices
from ..functions.distance import deletions

# Marks that no term holds: anything may stand here, where a term starts, where it ends, a letter after one that is open.
GAP, START, END, PLACE = "\x01", "\x02", "\x03", "\x04"
# Two words within k edits keep, in what is left of their first HEAD letters after at most k deletions each, a string in common: letters that the
# alignment takes past the head on one side are made up for by as many edits before them. So heads do for words of any length.
HEAD = 7
# Edits that the stored keys serve.
CLOSE_EDITS = 2


def _trigrams(text: Column) -> Column:
    return F.transform(indices(F.length(text) - 2), lambda i: F.substring(text, i + 1, F.lit(3)))


def grams(lexicon: DataFrame) -> DataFrame:
    """Each term's trigrams, a mark before it and two after it: whatever one or two letters it holds, some trigram begins with them."""
    padded = F.concat(F.lit(START), F.col("term"), F.lit(END + END))
    return lexicon.select("field", F.explode(F.array_distinct(_trigrams(padded))).alias("gram"), "term")


def gram_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"))


def gram_keys(stats: DataFrame) -> DataFrame:
    """(field, key, gram, n): what a pattern can ask for, and the trigrams that answer: itself, those that begin with one or two letters, and those of a
    term's first letters of which only the second is known. START asks for all terms, each by one trigram."""
    g = F.col("gram")
    second = F.when(F.substring(g, 1, 1) == START, F.concat(F.lit(PLACE), F.substring(g, 3, 1)))
    keys = F.filter(F.array(g, F.substring(g, 1, 2), F.substring(g, 1, 1), second), lambda k: k.isNotNull())
    return stats.select("field", F.explode(keys).alias("key"), "gram", "n")


def close_keys(lexicon: DataFrame, edits: int = CLOSE_EDITS) -> DataFrame:
    return lexicon.select("field", F.explode(close_strings(F.col("term"), edits)).alias("key"), "term")


def close_strings(word: Column, edits: int) -> Column:
    return deletions(F.substring(word, 1, HEAD), edits)


# ---- what a pattern asks for ----------------------------------------------------------------------------------------

def prefix_shape(prefix: Column) -> Column:
    return F.concat(F.lit(START), prefix, F.lit(GAP))


def glob_shape(glob: Column) -> Column:
    """A glob with a gap for whatever is not a letter of its own."""
    return F.concat(F.lit(START), F.regexp_replace(glob, r"\[[^\]]*\]|[*?]", GAP), F.lit(END))


def glob_place(glob: Column) -> Column:
    """The key of a second letter after one open place; null if there is none."""
    letter = F.regexp_extract(glob, r"^\?([^*?\[])", 1)
    return F.when(letter != "", F.concat(F.lit(PLACE), letter))


def regex_shape(pattern: Column) -> Column:
    """An expression, anchored at its start, with a gap for whatever need not occur as it is written: escapes, classes, groups, dots, anchors and
    letters that a quantifier makes optional. What can't be read this way (alternatives, flags, references) asks for nothing."""
    s = F.regexp_replace(pattern, r"^\^", "")
    for found, put in ((r"\\.", GAP), (r"\[\^?\]?[^\[\]]*\]", GAP), (r"\([^()]*\)", GAP), (r"\([^()]*\)", GAP), (r"\([^()]*\)", GAP),
                       (r"(?s).(?:[*?]|\{[^{}]*\})[+?]?", GAP), (r"(?s)(.)\+[+?]?", f"$1{GAP}"), (r"[.$^]", GAP)):
        s = F.regexp_replace(s, found, put)
    unread = pattern.rlike(r"\\[a-zA-Z0-9&&[^dDwWsSbB]]|\(\?|\|") | s.rlike(r"[\[\](){}|+*?]")
    return F.when(unread, F.lit(GAP)).otherwise(F.concat(F.lit(START), s, F.lit(GAP)))


def asked_keys(shape: Column, place: Column | None = None) -> Column:
    """What a pattern asks for: the trigrams of its runs of letters and marks, of shorter runs the run itself; START if that is nothing."""
    def of(run: Column) -> Column:
        n = F.length(run)
        return F.when(n >= 3, _trigrams(run)).when((n > 0) & ~run.isin(START, END), F.array(run)).otherwise(F.array().cast("array<string>"))

    found = F.flatten(F.transform(F.split(shape, GAP), of))
    if place is not None:
        found = F.concat(found, F.filter(F.array(place), lambda x: x.isNotNull()))
    return F.when(F.size(found) > 0, F.array_distinct(found)).otherwise(F.array(F.lit(START)))
