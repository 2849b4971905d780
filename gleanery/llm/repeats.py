"""Removal of every byte inside a 200-byte string that also starts elsewhere.

A column-wise suffix array needs as many sequential passes as the longest document has bytes (over 100,000 here), each over
everything inserted so far; that cannot be a Spark job. This finds the same strings by anchors instead. Each window of 200
bytes picks an anchor gram by content alone, so equal windows meet under the same anchor. A run of neighbouring windows
with one anchor is a *block*: it has a core (bytes that all its windows hold) and a hull (bytes that any of them holds).
Blocks with equal hulls repeat as a whole; a block whose core is alone holds no repeat; the rest are cut into smaller blocks, and in
the end into single windows, whose core is their hull. So nearly all of the text is settled by one row in 60 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, quoted, settle, steps
from .textstats import bytes_of

LENGTH, GRAM = 200, 50
BLOCK = 15          # windows of a block of the second level
# Odd, so that it has an inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_PART = 1 << 20     # bytes handled at once (some 100 MB of arrays); below 2 ** 24, so that a place fits beside its hash


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Hashes:
    """Hashes of any stretch of a byte array, by differences of one running sum."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(len(data))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of window starts that share an anchor: row, first and last start and the anchor's place (in the text), the anchor's hash
    (the core) and the hash of all bytes that the run's windows cover (the hull).

    A window's anchor is the gram inside it with the least hash, the last one on ties: windows of equal bytes have the same anchor at
    the same place.
    """
    n = len(data)
    if n < length:
        return {k: np.empty(0, np.int64) for k in ("row", "first", "last", "at", "core", "hull")}
    h = Hashes(data)
    place = np.arange(n - gram + 1)
    key = h.of(place, place + gram)
    packed = (key & ~np.uint64((1 << 24) - 1)) | (np.uint64((1 << 24) - 1) - place.astype(np.uint64))
    least = _sliding_min(packed, length - gram + 1)
    where = ((1 << 24) - 1) - (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[: n - length + 1] == row[length - 1:]
    start = np.flatnonzero(inside)
    if not len(start):
        return {k: np.empty(0, np.int64) for k in ("row", "first", "last", "at", "core", "hull")}
    where, owner = where[start], row[start]
    new = np.concatenate([[True], (where[1:] != where[:-1]) | (owner[1:] != owner[:-1])])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:] - 1, [len(start) - 1]])
    first, last, at = start[head], start[tail], where[head]
    span = mix(h.of(first, last + length) + (at - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (last - first).astype(np.uint64))
    base = offsets[owner[head]]
    return {"row": owner[head], "first": first - base, "last": last - base, "at": at - base, "core": key[at].view(np.int64), "hull": span.view(np.int64)}


def _parts(data: np.ndarray, offsets: np.ndarray):
    """The array whole, or a single long text in overlapping parts that hold each window once: (data, offsets, bytes before)."""
    if len(data) <= 2 * _PART:
        yield data, offsets, 0
        return
    for row in range(len(offsets) - 1):
        for start in range(int(offsets[row]), max(int(offsets[row + 1]) - LENGTH + 1, int(offsets[row]) + 1), _PART):
            part = data[start: min(start + _PART + LENGTH - 1, int(offsets[row + 1]))]
            ends = np.zeros(len(offsets), np.int64)
            ends[row + 1:] = len(part)
            yield part, ends, start - int(offsets[row])


_FIELDS = "core bigint, hull bigint, doc {kind}, mark int, place bigint"


def _pack(first, last, at):
    """A block's place in one number: its first start, how many more, and how far its anchor is."""
    return (first << 16) | ((last - first) << 8) | (at - first)


def _rows(batch: pa.RecordBatch, row, core, hull, place) -> pa.RecordBatch:
    take = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(core), pa.array(hull), batch.column("doc").take(take), batch.column("mark").take(take), pa.array(place, pa.int64())],
                                      names=["core", "hull", "doc", "mark", "place"])


def _blocks(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in steps(batches, "x", _PART):
            data, offsets = bytes_of(batch.column("x"))
            for part, ends, before in _parts(data, offsets):
                a = anchors(part, ends)
                yield _rows(batch, a["row"], a["core"], a["hull"], _pack(a["first"] + before, a["last"] + before, a["at"] + before))

    return docs.mapInArrow(run, _FIELDS.format(kind=docs.schema["doc"].dataType.simpleString()))


def _cut(docs: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """The blocks at ``places`` (doc, mark, place) cut into blocks of ``size`` windows at most, aligned on the anchor."""
    wanted = places.groupBy("doc", "mark").agg(F.array_distinct(F.collect_list("place")).alias("places"))
    rows = docs.join(wanted.withColumnsRenamed({"doc": "_d", "mark": "_m"}), docs["doc"].eqNullSafe(F.col("_d")) & (docs["mark"] == F.col("_m"))).select("doc", "mark", "x", "places").dropDuplicates(["doc", "mark"])

    def run(batches):
        for batch in steps(batches, "x", _PART):
            data, offsets = bytes_of(batch.column("x"))
            h = Hashes(data)
            lists = batch.column("places")
            place = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            first, count, ahead = place >> 16, (place >> 8) & 255, place & 255
            at = first + ahead
            # Places before the anchor run from ``ahead - count`` to ``ahead``; cut where their quotient by ``size`` changes.
            low, high = (ahead - count) // size, ahead // size
            number = high - low + 1
            item = np.repeat(np.arange(len(place)), number)
            block = low[item] + (np.arange(len(item)) - np.repeat(np.cumsum(number) - number, number))
            near, far = np.maximum(block * size, (ahead - count)[item]), np.minimum(block * size + size - 1, ahead[item])
            base, anchor = offsets[row[item]], at[item]
            place_of = base + anchor
            core = h.of(place_of - block * size, place_of + LENGTH - block * size - (size - 1)) + block.astype(np.uint64)
            hull = h.of(place_of - far, place_of + LENGTH - near) + mix((far * 1024 + near).astype(np.uint64))
            yield _rows(batch, row[item], mix(core).view(np.int64), mix(hull).view(np.int64), _pack(anchor - far, anchor - near, anchor))

    return rows.mapInArrow(run, _FIELDS.format(kind=docs.schema["doc"].dataType.simpleString()))


def _sorted_out(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks that repeat as a whole, and one block of each class that shares its core but not its hull with others.

    The core's counts are combined before they are moved; the join on the core is one that adaptive execution can split, as a core
    may hold a third of all rows.
    """
    cores = blocks.groupBy("core").agg(F.count("*").alias("_n"), F.min("hull").alias("_lo"), F.max("hull").alias("_hi")).filter("_n > 1")
    met = settle(blocks.join(cores.select("core", (F.col("_lo") == F.col("_hi")).alias("_same")), "core"))
    mixed = met.filter("NOT _same")
    kinds = settle(mixed.groupBy("core", "hull").agg(F.count("*").alias("_n"), F.min(F.struct("doc", "mark", "place")).alias("one")))
    again = mixed.join(kinds.filter("_n > 1").select("core", "hull"), ["core", "hull"])
    spot = ["doc", "mark", "place"]
    return met.filter("_same").select(*spot).unionByName(again.select(*spot)), kinds.select("one.*")


def remove(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary) for each row: ``kept`` is the text's bytes without every byte that lies in a 200-byte
    string which also starts anywhere else in the table, the same row included.

    Null texts are empty; texts under 200 bytes lose nothing; rows that repeat a text lose all of it from 200 bytes on; matches
    never cross rows; strings are compared by 64-bit hashes. An empty table gives an empty result.
    """
    docs = df.select(F.col(quoted(key)).alias("doc"), F.coalesce(F.col(quoted(text)), F.lit("")).cast("binary").alias("x")).withColumn("mark", F.hash("x"))
    long = docs.filter(F.length("x") >= LENGTH)
    whole, open_ = _sorted_out(_blocks(long))
    parts, single = _sorted_out(_cut(long, open_, BLOCK))
    windows = _cut(long, single, 1)
    twice = windows.groupBy("core").agg(F.count("*").alias("_n")).filter("_n > 1").select("core")
    last = windows.join(twice, "core").select("doc", "mark", "place")
    found = settle(whole.unionByName(parts).unionByName(last).groupBy("doc", "mark").agg(F.array_distinct(F.collect_list("place")).alias("places")))
    rows = docs.join(found.withColumnsRenamed({"doc": "_d", "mark": "_m"}), docs["doc"].eqNullSafe(F.col("_d")) & (docs["mark"] == F.col("_m")), "left").select("doc", "x", "places")
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in steps(batches, "x", _PART):
            made: list[tuple] = []
            for x, places in zip(batch.column("x"), batch.column("places"), strict=True):
                data = x.as_py()
                if not places.is_valid:
                    made.append((len(data), 0, 0, data))
                    continue
                p = np.sort(places.values.to_numpy())
                change = np.zeros(len(data) + 1, np.int32)
                np.add.at(change, p >> 16, 1)
                np.add.at(change, (p >> 16) + ((p >> 8) & 255) + LENGTH, -1)
                gone = np.cumsum(change[:-1]) > 0
                starts = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                made.append((len(data), int(gone.sum()), starts, np.frombuffer(data, np.uint8)[~gone].tobytes()))
            columns = list(zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]],
                                             names=[key, "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, f"{quoted(key)} {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    return removed.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
