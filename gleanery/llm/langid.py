"""Language identification by rank-order profiles: out-of-place distance between a document's and each language's most frequent n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.joins import best_per_group

from .common import only, quoted, steps, strings

# Grams of 1 to 3 characters of a word, a space on either side; three code points of 21 bits fit one long.
SIZES = (1, 2, 3)
BITS = 21
# Length of a profile, of languages and of documents. A gram that a profile lacks is out of place by as much.
PROFILE = 400
# Languages a model may have at most; more are refused, as the model is sent to every task.
MAX_LANGUAGES = 5_000
# Bytes of text, and characters of a longer text, that are counted at once.
STEP = 1 << 20
# Counted grams a task holds before it hands them on.
HELD = 1 << 20
UNKNOWN = "und"


def spaced(texts: pa.Array) -> pa.Array:
    """Lower-cased, with each run of anything but letters as one space, and a space at either end."""
    words = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), pattern=r"[^\p{L}]+", replacement=" "), characters=" ")
    return pc.binary_join_element_wise(pa.scalar(" "), words, pa.scalar(" "), "")


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and each one's text."""
    data = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    return data, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def tally(keys: tuple[np.ndarray, ...], weight: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of ``keys`` in order, and the number (or sum of weights) of each."""
    order = np.lexsort(keys[::-1])
    sorted_keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(order))) if weight is None else np.add.reduceat(weight[order], first) if len(first) else np.empty(0, np.int64)
    return [k[first] for k in sorted_keys], counts.astype(np.int64)


def _counted(data: np.ndarray, row: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) of the grams that start at one of the first ``starts`` characters."""
    used = np.zeros(int(data.max()) + 1, bool)
    used[data] = True
    letters = np.flatnonzero(used)
    code = (np.cumsum(used) - 1)[data]
    size = len(letters)
    space = int(np.searchsorted(letters, 32))
    out = []
    for n in SIZES:
        m = max(min(starts, len(data) - n + 1), 0)
        inside = row[:m] == row[n - 1: n - 1 + m]
        # A gram may begin or end with a space; one inside would span two words, one alone says nothing.
        if n != 2:
            inside &= code[n // 2: n // 2 + m] != space
        # Characters are numbered within the slice, so that (row, gram) is one small number and one sort counts all.
        key = row[:m].copy()
        for k in range(n):
            key *= size
            key += code[k: k + m]
        key = key[inside]
        found, count = np.unique(key, return_counts=True)
        gram = np.zeros(len(found), np.int64)
        for k in range(n):
            gram |= letters[found // size ** (n - 1 - k) % size] << (BITS * (n - 1 - k))
        out.append((found // size ** n, gram, count.astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) of all grams of ``spaced`` texts. A long text is counted in pieces of STEP characters, each with the two
    characters that follow, and what was counted is merged as it grows; what is held depends on its distinct grams only."""
    if len(texts) != 1 or len(texts[0]) <= STEP:
        data, row = points(texts)
        return _counted(data, row, len(data)) if len(data) else (np.empty(0, np.int64),) * 3
    held = (np.empty(0, np.int64), np.empty(0, np.int64))
    for a in range(0, len(texts[0]), STEP):
        data, row = points([texts[0][a: a + STEP + max(SIZES) - 1]])
        _, gram, count = _counted(data, row, STEP)
        (gram,), count = tally((np.concatenate([held[0], gram]),), np.concatenate([held[1], count]))
        held = (gram, count)
    return np.zeros(len(held[0]), np.int64), *held


def ranked(row: np.ndarray, gram: np.ndarray, count: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, rank from 0) of each row's ``longest`` most frequent grams; equal counts rank by gram."""
    order = np.lexsort((gram, -count, row))
    row, gram = row[order], gram[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < longest
    return row[keep], gram[keep], place[keep]


@dataclass
class Profiles:
    names: list[str]           # languages, in order
    grams: np.ndarray          # all grams of any profile, ascending
    rank: np.ndarray           # [language, gram]: the gram's rank, or ``longest``
    longest: int

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Out-of-place distance of each text to each language, and the number of grams it is a sum over."""
        row, gram, place = ranked(*gram_counts(texts), self.longest)
        at = np.minimum(np.searchsorted(self.grams, gram), max(len(self.grams) - 1, 0))
        known = self.grams[at] == gram if len(self.grams) else np.zeros(len(gram), bool)
        total = np.empty((len(texts), len(self.names)), np.int64)
        for k in range(len(self.names)):
            off = np.where(known, np.abs(place - self.rank[k][at]), self.longest) if len(self.grams) else np.full(len(gram), self.longest)
            off = np.where(known & (self.rank[k][at] == self.longest), self.longest, off) if len(self.grams) else off
            total[:, k] = np.bincount(row, off, len(texts)).astype(np.int64)
        return total, np.bincount(row, minlength=len(texts))


def trained_on(key: str = "doc_id", folds: int = 4, left_out: int = 2) -> F.Column:
    return F.crc32(F.col(quoted(key)).cast("string").cast("binary")) % folds != left_out


def language_grams(df: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``df`` (_x, lang). Tasks hand on counts by language, never grams of single documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        held = [np.empty(0, np.int64)] * 3

        def flush():
            names = pa.array(list(numbers), pa.string())
            return pa.RecordBatch.from_arrays([names.take(pa.array(held[0])), pa.array(held[1]), pa.array(held[2])], names=["lang", "gram", "n"])

        for batch in steps(batches, "_x", STEP):
            number = np.array([numbers.setdefault(v, len(numbers)) for v in batch.column("lang").to_pylist()], np.int64)
            row, gram, count = gram_counts(spaced(strings(batch.column("_x"))).to_pylist())
            (lang, gram), count = tally((np.concatenate([held[0], number[row]]), np.concatenate([held[1], gram])), np.concatenate([held[2], count]))
            held = [lang, gram, count]
            if len(count) > HELD:
                yield flush()
                held = [np.empty(0, np.int64)] * 3
        yield flush()

    return df.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, longest: int = PROFILE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """The profile of each language that a row outside the held-out fold names: its ``longest`` most frequent grams over whole texts.

    At most ``longest`` rows for each of at most MAX_LANGUAGES languages come to the driver; more languages raise an error.
    """
    known = only(df, _key=key, _x=text, lang=lang).filter(trained_on("_key") & F.col("lang").isNotNull())
    named = [r["lang"] for r in known.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(named) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    best = best_per_group(language_grams(known.select(F.col("lang").cast("string").alias("lang"), "_x")), ["lang"], [F.desc("n"), F.col("gram")], longest, "rank").select("lang", "gram", "rank").toPandas()
    names = sorted(named, key=lambda v: v.encode())
    grams = np.unique(best["gram"].to_numpy(np.int64))
    rank = np.full((len(names), len(grams)), longest, np.int64)
    at = {v: i for i, v in enumerate(names)}
    rank[[at[v] for v in best["lang"]], np.searchsorted(grams, best["gram"].to_numpy(np.int64))] = best["rank"].to_numpy(np.int64) - 1
    return Profiles(names, grams, rank, longest)


def identify(df: DataFrame, profiles: Profiles | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", longest: int = PROFILE) -> DataFrame:
    """(key, held_out, lang_pred, score) for each row, by profiles learned from the rows of ``df`` outside the held-out fold.

    The nearest profile names the language, of equally near ones the first by name. The score is by how much of the second distance the
    first is smaller (with one language: by how much of the farthest possible). Only the text is an input of it, and equal texts
    get equal answers. Null texts and texts without a letter are ``und`` with a score of 0, as is every text where no row names a
    language. Nothing is learned from rows with a null language or a null key; a null key is not held out. An empty table gives no
    rows; other columns are not read. A very long text is counted whole, piece by piece.
    """
    model = profiles or learn(df, longest, key, text, lang)
    picked = only(df, _key=key, _x=text).select(F.col("_key"), F.coalesce(~trained_on("_key"), F.lit(False)).alias("_held"), "_x")
    kind = picked.schema["_key"].dataType.simpleString()

    def run(batches):
        for batch in steps(batches, "_x", STEP):
            texts = spaced(strings(batch.column("_x")))
            rows = len(texts)
            some = pc.greater(pc.utf8_length(texts), 2).to_numpy(zero_copy_only=False)
            names = np.full(rows, UNKNOWN, object)
            score = np.zeros(rows)
            if model.names and some.any():
                total, grams = model.distances(texts.to_pylist())
                best = total.argmin(axis=1)
                first = total[np.arange(rows), best]
                second = np.partition(total, 1, axis=1)[:, 1] if len(model.names) > 1 else grams * model.longest
                names[some] = np.array(model.names, object)[best[some]]
                score[some] = (second[some] - first[some]) / np.maximum(second[some], 1)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_held"), pa.array(names, pa.string()), pa.array(score)], names=["_key", "held_out", "lang_pred", "score"])

    return picked.mapInArrow(run, f"_key {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("_key", key)
