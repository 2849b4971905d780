"""Helpers of the operators: slices of Arrow batches with bounded text, words as codes, safe column names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import shared_dir

# Bytes of text that one step of a task works on at once; a single longer text is a step of its own.
STEP_BYTES = 4 << 20

# The contract's words: runs of anything but space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder; every later read sees the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def only(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` cut to the named columns (new name = old name); other columns can't clash with an operator's own."""
    return df.select(*[F.col(quoted(old)).alias(new) for new, old in columns.items()])


def steps(batches: Iterator[pa.RecordBatch], text: str | int = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``limit`` bytes of text (or one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def strings(column: pa.Array) -> pa.Array:
    """The texts as one flat array with an offset of 0; null is the empty text."""
    return pc.fill_null(pa.array(column.to_pylist(), pa.string()) if pa.types.is_dictionary(column.type) else column, "")


class Words:
    """The words of a slice of texts: ``code`` numbers equal words equally, ``row`` is the text's place, in order."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        flat, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), lengths)
        some = pc.greater(pc.binary_length(flat), 0)
        self.flat = flat.filter(some)
        self.row = row[some.to_numpy(zero_copy_only=False)]
        coded = self.flat.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.names = coded.dictionary
        self.rows = len(texts)
        self.count = np.bincount(self.row, minlength=self.rows)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, id) of each run of ``size`` words inside one text; equal runs, and only those, have equal ids."""
        n = len(self.code)
        if n < size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        start = np.flatnonzero(self.row[: n - size + 1] == self.row[size - 1:])
        ids = self.code[start]
        for k in range(1, size):
            ids = compact(ids * (len(self.names) + 1) + self.code[start + k]) if k < size - 1 else ids * (len(self.names) + 1) + self.code[start + k]
        return start, ids


def compact(ids: np.ndarray) -> np.ndarray:
    """Equal numbers for equal ids, below the number of ids."""
    return np.unique(ids, return_inverse=True)[1].astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scramble of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
