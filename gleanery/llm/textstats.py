"""Counts of a whole text, made for slices of an Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Words, compact, only, quoted, steps, strings

# Byte classes that are counted. All are ASCII, so that bytes and characters agree.
CLASSES = {"n_symbols": b"#*$%&|<>", "n_upper": bytes(range(65, 91)), "n_lower": bytes(range(97, 123)), "n_digits": bytes(range(48, 58)),
           "n_bangs": b"!?", "n_stops": b".,;:", "n_bars": b"|"}
COUNTS = ["n_words", "word_chars", "n_chars", "n_lines", "n_ended_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_short_words", *CLASSES]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the places where each starts (with the end)."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset: raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def _per_row(row: np.ndarray, weight: np.ndarray | None, rows: int) -> np.ndarray:
    return np.bincount(row, weights=weight, minlength=rows).astype(np.int64)


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """All of COUNTS for each text. ``n_repeat_words``: words in 3-word windows found twice or more in the text, first included.
    ``n_dup_lines``: lines with a word that equal an earlier line."""
    rows = len(texts)
    words = Words(texts)
    lengths = pc.utf8_length(words.flat).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {"n_words": words.count.astype(np.int64), "word_chars": _per_row(words.row, lengths, rows),
           "n_chars": pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)}

    lists = pc.split_pattern(texts, "\n")
    flat = lists.flatten()
    line_row = np.repeat(np.arange(rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    trimmed = pc.ascii_trim(flat, characters=" \t\n\v\f\r")
    some = pc.greater(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    seen = line_row * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = np.unique(seen[some])
    out["n_lines"] = _per_row(line_row[some], None, rows)
    out["n_dup_lines"] = out["n_lines"] - _per_row(distinct // (len(coded.dictionary) + 1), None, rows)
    ended = pc.match_substring_regex(trimmed, r'[.!?:"”»]$').to_numpy(zero_copy_only=False) & some
    out["n_ended_lines"] = _per_row(line_row[ended], None, rows)

    start, ids = words.windows(3)
    marked = np.zeros(len(words.code), bool)
    if len(start):
        own = compact(ids) * rows + words.row[start]
        _, inverse, times = np.unique(own, return_inverse=True, return_counts=True)
        again = start[times[inverse] > 1]
        for k in range(3):
            marked[again + k] = True
    out["n_repeat_words"] = _per_row(words.row[marked], None, rows)
    out["n_distinct_words"] = _per_row(np.unique(words.row * (len(words.names) + 1) + words.code) // (len(words.names) + 1), None, rows)
    out["n_short_words"] = _per_row(words.row[lengths <= 3], None, rows)

    data, offsets = bytes_of(texts)
    for name, members in CLASSES.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        place = np.flatnonzero(table[data])
        out[name] = np.diff(np.searchsorted(place, offsets)).astype(np.int64)
    return {name: out[name] for name in COUNTS}


def with_counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, COUNTS...) for each row; null texts count as empty. One pass over the text, no shuffle."""
    picked = only(df, _key=key, _x=text)

    def run(batches):
        for batch in steps(batches, "_x"):
            made = counts(strings(batch.column("_x")))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), *[pa.array(v) for v in made.values()]], names=[key, *made])

    kind = picked.schema["_key"].dataType.simpleString()
    return picked.mapInArrow(run, f"{quoted(key)} {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))
