"""Phrases of any length and slop for a whole table of queries, matched in the document's own row.

Every distinct word of all phrases is read from the postings once. A word brings along the phrases it is the rarest word of, so a document meets a
phrase only if it holds that word; its position lists are then merged word by word, carrying the ends reached so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import Model
from ..functions.tokens import Filter
from ..joins import lookup_join, wide_rank
from ..session import settle
from .clauses import HOT_SHARE, match
from .index import SearchIndex

# Phrases that one document's row meets at once. A larger batch is cut into blocks of so many, which share no row.
BLOCK_BITS = 14
# Documents whose position lists are merged in one step of a task.
STEP_ROWS = 512
SPANS = "array<struct<start:int,end:int>>"


def phrase_words(queries: DataFrame, analyzer: Filter, field: str, text: str = "text", key: str = "query_id", slop: int = 1) -> DataFrame:
    """Analyze a column of phrase texts: (query_id, field, words, slop)."""
    return queries.select(F.col(key).alias("query_id"), F.lit(field).alias("field"), F.transform(analyzer(F.col(text)), lambda t: t["term"]).alias("words"), F.lit(slop).alias("slop"))


def s_phrase(index: SearchIndex, phrases: DataFrame, model: Model | None = None) -> DataFrame:
    """(query_id, doc_id, score, spans): the documents that hold the words of a phrase in order, each at most ``slop`` positions after the one
    before it (1: adjacent), with the distinct (first, last) positions. The score is the sum over the phrase's words, repeated ones each time.

    ``phrases`` has (query_id, field, words[, slop, boost]). Equal phrases are matched once, however many queries ask for them. An empty phrase, and
    one with a word that no document holds, has no hits.
    """
    for name, value in (("slop", F.lit(1)), ("boost", F.lit(1.0))):
        if name not in phrases.columns:
            phrases = phrases.withColumn(name, value)
    asked = phrases.select("query_id", "field", "words", F.col("slop").cast("long").alias("slop"), "boost").filter(F.size("words") > 0)
    distinct = asked.select("field", "words", "slop").distinct()
    # Numbered in the order of their words, so that phrases which share words tend to share a block.
    numbered = settle(wide_rank(distinct.withColumn("_all", F.lit(0)), ["_all"], [F.col("field"), F.col("words"), F.col("slop")], "phrase").drop("_all"))
    terms = settle(_phrase_terms(index, numbered))
    hits = match(index, terms, model, keep=("positions",)).select(F.col("query_id").alias("block"), "doc_id", F.struct(F.col("clause_id").alias("word"), "positions", "score").alias("held"), "asked")
    # At most a document's own words and the phrases of one block meet in a row.
    rows = hits.groupBy("block", "doc_id").agg(F.collect_list("held").alias("held"), F.flatten(F.collect_list("asked")).alias("asked")).filter(F.size("asked") > 0).drop("block")
    key = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_merge, f"phrase bigint, doc_id {key}, score double, spans {SPANS}")
    by_query = asked.join(numbered, ["field", "words", "slop"]).select("query_id", "phrase", "boost")
    return lookup_join(found, by_query, ["phrase"]).select("query_id", "doc_id", (F.col("score") * F.col("boost")).alias("score"), "spans")


def _phrase_terms(index: SearchIndex, numbered: DataFrame) -> DataFrame:
    """Query terms (query_id: the block, clause_id: the word's number, field, term, asked) of all phrases whose words are all indexed. ``asked``
    lists the phrases that the word is the rarest of, as [phrase, slop, words...]."""
    spelled = numbered.select("phrase", "field", "slop", F.size("words").alias("n"), F.posexplode("words").alias("place", "term"))
    uses = settle(spelled.groupBy("field", "term").agg(F.count(F.lit(1)).alias("uses")).withColumn("word", F.monotonically_increasing_id()))
    total = uses.agg(F.sum("uses")).first()[0] or 0
    known = lookup_join(index.term_stats.select("field", "term", "df"), uses, ["field", "term"])
    placed = lookup_join(spelled, settle(known), ["field", "term"], hot=uses.filter(F.col("uses") * HOT_SHARE > total))
    block = F.shiftright(F.col("phrase") - 1, BLOCK_BITS)
    whole = placed.groupBy("phrase", "slop", "n").agg(
        F.sort_array(F.collect_list(F.struct("place", "word", "field", "term"))).alias("spelling"), F.min(F.struct("df", "word")).getField("word").alias("rarest")).filter(F.size("spelling") == F.col("n"))
    entry = F.concat(F.array(F.col("phrase").cast("long"), "slop"), F.col("spelling.word"))
    no_entry = F.array().cast("array<bigint>")
    each = whole.select(block.alias("query_id"), "rarest", entry.alias("entry"), F.explode(F.array_distinct(F.transform("spelling", lambda s: F.struct(s["word"], s["field"], s["term"])))).alias("s"))
    mine = F.when(F.col("s.word") == F.col("rarest"), F.col("entry"))
    return each.groupBy("query_id", F.col("s.word").alias("clause_id"), F.col("s.field").alias("field"), F.col("s.term").alias("term")) \
        .agg(F.collect_list(mine).alias("asked")).withColumn("asked", F.coalesce("asked", F.array(no_entry))).withColumn("boost", F.lit(1.0))


# ---- inside a task ------------------------------------------------------------------------------------------------------

def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The flat values of a list column, and each list's start and length."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), np.cumsum(length) - length, length


def _spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. for ``length[0]`` numbers, and so on."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - length), length)


def reach(start: np.ndarray, end: np.ndarray, who: np.ndarray, slop: np.ndarray, next_who: np.ndarray, next_at: np.ndarray):
    """Spans (who, start, end) carried on to the next word's places, (next_who, next_at) in order: an end reaches the places 1 to ``slop``
    after it. Each end finds its places by two binary searches, so the work is that of the spans that come out."""
    place = (next_who << 32) + next_at
    low = np.searchsorted(place, (who << 32) + end + 1, side="left")
    high = np.searchsorted(place, (who << 32) + end + slop[who], side="right")
    to = _spread(low, high - low)
    who, start, end = np.repeat(who, high - low), np.repeat(start, high - low), next_at[to]
    # Several ends of one start may reach the same place.
    order = np.lexsort((end, start, who))
    who, start, end = who[order], start[order], end[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return who[new], start[new], end[new]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            yield from _merge_rows(batch.slice(at, STEP_ROWS))


def _merge_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    docs, rows = batch.column(0), np.arange(batch.num_rows)
    held, _, n_held = _lists(batch.column(1))
    positions, first, times = _lists(pc.struct_field(held, "positions"))
    positions = positions.to_numpy(zero_copy_only=False).astype(np.int64)
    scores = pc.struct_field(held, "score").to_numpy(zero_copy_only=False)
    asked, _, n_asked = _lists(batch.column(2))
    entries, entry_at, entry_size = _lists(asked)
    entries = entries.to_numpy(zero_copy_only=False).astype(np.int64)
    doc_of = np.repeat(rows, n_asked)
    # Words get small numbers, so that (document, word) is one key.
    spelling = _spread(entry_at + 2, entry_size - 2)
    words = pc.struct_field(held, "word").to_numpy(zero_copy_only=False).astype(np.int64)
    _, number = np.unique(np.concatenate([words, entries[spelling]]), return_inverse=True)
    size = int(number.max()) + 1 if len(number) else 1
    own = np.repeat(rows, n_held) * size + number[: len(words)]
    order = np.argsort(own, kind="stable")
    wanted = np.repeat(doc_of, entry_size - 2) * size + number[len(words):]
    slot = order[np.minimum(np.searchsorted(own, wanted, sorter=order), len(own) - 1)]
    there = own[slot] == wanted
    spelled = np.cumsum(entry_size - 2) - (entry_size - 2)
    complete = np.logical_and.reduceat(there, spelled)
    for n in np.unique(entry_size[complete] - 2):
        chosen = np.flatnonzero(complete & (entry_size - 2 == n))
        word = slot[spelled[chosen][:, None] + np.arange(n)]
        slop = np.minimum(entries[entry_at[chosen] + 1], 1 << 30)
        who = np.repeat(np.arange(len(chosen)), times[word[:, 0]])
        start = positions[_spread(first[word[:, 0]], times[word[:, 0]])]
        end = start
        for j in range(1, n):
            alive = np.unique(who)
            count = times[word[alive, j]]
            who, start, end = reach(start, end, who, slop, np.repeat(alive, count), positions[_spread(first[word[alive, j]], count)])
        if not len(who):
            continue
        hit, spans = np.unique(who, return_counts=True)
        made = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["start", "end"])
        offsets = pa.array(np.concatenate([[0], np.cumsum(spans)]), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(entries[entry_at[chosen[hit]]]), docs.take(pa.array(doc_of[chosen[hit]])), pa.array(scores[word[hit]].sum(axis=1)),
                                          pa.ListArray.from_arrays(offsets, made)], names=["phrase", "doc_id", "score", "spans"])
