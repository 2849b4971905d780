"""Byte-level BPE with the tiktoken library: encoding of whole texts in pieces, raw-byte decoding."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, quoted, steps, strings

# A rank file's size is fixed with the vocabulary; larger ones are refused before they are sent to the executors.
MAX_RANK_BYTES = 16 << 20
PIECE_CHARS = 1 << 16
# A match never spans from a letter, digit or closing mark (the apostrophe of a contraction apart) into blank space.
_SAFE = re.compile(r"(?<=[A-Za-z0-9.,;:!?)\]À-ɏ])(?=[ \n])")


def pieces(text: str, size: int = PIECE_CHARS):
    """``text`` cut where no match of a GPT-2 style pattern can span; each piece but the last has ``size`` characters or more."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


@lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str):
    """The tiktoken encoding of a rank file's bytes; built once in each worker process."""
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding(hashlib.sha256(ranks).hexdigest()[:16], pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode_text(enc, text: str) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text) for i in enc.encode_ordinary(piece)]


def _shared(df: DataFrame, rank_file: str):
    with open(rank_file, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{rank_file} is larger than {MAX_RANK_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(data)


def _mapped(df: DataFrame, keep: list[str], source: str, fn, schema: str) -> DataFrame:
    picked = only(df, **{f"_k{i}": k for i, k in enumerate(keep)}, _x=source)
    types = [picked.schema[f"_k{i}"].dataType.simpleString() for i in range(len(keep))]

    def run(batches):
        for batch in steps(batches, "_x"):
            made = fn(batch.column("_x"))
            yield pa.RecordBatch.from_arrays([*[batch.column(f"_k{i}") for i in range(len(keep))], *made.values()], names=[*keep, *made])

    return picked.mapInArrow(run, ", ".join([*[f"{quoted(k)} {t}" for k, t in zip(keep, types, strict=True)], schema]))


def encode(df: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long, ids binary): the token ids of each whole text as little-endian unsigned 32-bit integers.

    Each row stays where it is (no shuffle). Null and empty texts have no ids; a text of any length is encoded in pieces
    that join to the same ids; repeated rows are encoded each; other columns are left out, whatever their names.
    """
    ranks = _shared(df, rank_file)

    def fn(column):
        enc = encoding(ranks.value, pattern)
        ids = [np.array(encode_text(enc, t), "<u4") for t in strings(column).to_pylist()]
        return {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array([x.tobytes() for x in ids], pa.binary())}

    return _mapped(df, [key], text, fn, "n_tokens bigint, ids binary")


def decode(df: DataFrame, rank_file: str, pattern: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """(keep..., bytes binary): the raw bytes of each row's ids. Bytes, not text: a cut may split a character. Null ids: empty.

    An id that the rank file lacks is an error.
    """
    ranks = _shared(df, rank_file)

    def fn(column):
        enc = encoding(ranks.value, pattern)
        out = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in column.to_pylist()]
        return {"bytes": pa.array(out, pa.binary())}

    return _mapped(df, keep, ids, fn, "bytes binary")
