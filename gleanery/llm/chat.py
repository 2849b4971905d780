"""Chat formatting as a prefix tree: conversations that start with the same turns share them.

A node of the tree is a distinct run of turns from the start. It is emitted once, in depth-first order, with the place of its first
character in that stream, its position id (characters from the tree's root) and, for each conversation, the stretches of the
stream that it may attend to: the nodes above it, neighbours merged.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.joins import wide_rank, wide_running

from .common import only, settle

# The template's marks, and marks of other common templates, which a text must not be able to forge either.
TURN, HEAD, END = "<|turn|>", "\n", "<|end|>\n"
_CONTROL = re.compile(r"([<\[])(\\*)(\||/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])(\\*)\\(\||/?s>|/?INST\])")


def escape(text: str) -> str:
    """One more backslash after the opening character of anything that reads as a control string, escaped or not."""
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


_ROLE = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}


def format_turn(role: str, text: str) -> str:
    return f"{TURN}{''.join(_ROLE.get(c, c) for c in role)}{HEAD}{escape(text)}{END}"


def parse_turn(segment: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    role, text = segment[len(TURN): -len(END)].split(HEAD, 1)
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "l": "<"}.get(m[1], m[1]), role), unescape(text)


def loss_span(role: str, segment: str, learn: str = "assistant") -> tuple[int, int]:
    """Where the loss mask is on in a turn's characters: the whole text of a turn to learn, nothing else."""
    return (segment.index(HEAD, len(TURN)) + len(HEAD), len(segment) - len(END)) if role == learn else (0, 0)


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, node, parent, role, segment, loss_start, loss_end, n, position): every turn with the 128-bit name of its run
    of turns, its characters and the characters before it in the conversation.

    A conversation is one training sequence, so its rows come together in one place; they are ordered by turn, role and text,
    null turns first. Null roles and texts are empty, rows with a null conversation form one without a number.
    """
    rows = only(df, conv_id=conv, _turn=turn, _role=role, _text=text)
    rows = rows.select("conv_id", F.struct("_turn", F.coalesce("_role", F.lit("")).alias("role"), F.coalesce("_text", F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    fields = {"conv_id": whole.schema["conv_id"].dataType.simpleString(), "depth": "int", "node": "string", "parent": "string", "role": "string", "segment": "string",
              "loss_start": "int", "loss_end": "int", "n": "bigint", "position": "bigint"}
    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            held = 0

            def made():
                own = [batch.schema.field(0).type, *[types[t] for t in list(fields.values())[1:]]]
                ready = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, own, strict=True)], names=list(fields))
                for x in out:
                    x.clear()
                return ready

            for conv_id, ts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                above, position = "", 0
                for depth, t in enumerate(ts.as_py()):
                    segment = format_turn(t["role"], t["text"])
                    node = hashlib.blake2b(f"{above}\n{segment}".encode(), digest_size=16).hexdigest()
                    for x, v in zip(out, (conv_id, depth, node, above, t["role"], segment, *loss_span(t["role"], segment), len(segment), position), strict=True):
                        x.append(v)
                    above, position, held = node, position + len(segment), held + len(segment)
                if held > 4 << 20:
                    yield made()
                    held = 0
            yield made()

    return whole.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in fields.items()))


def tree(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and the conversations of ``turns_of`` rows, which should be settled.

    Nodes: (node, parent, depth, role, segment, loss_start, loss_end, position, offset), one row each: ``offset`` counts the characters
    emitted before it in depth-first order, ``position`` (its first position id) those above it in its tree. Conversations:
    (conv_id, n_turns, nodes, attends): ``nodes`` from the root to the leaf, ``attends`` the (start, end) stretches of the
    stream that make it up, in order: what its last node may attend to.

    The depth-first order is that of the conversations' node names; a node stands where the first conversation that holds it
    stands. Ranks and offsets are running totals over ranges, so no tree, however large, is one task's work.
    """
    path = F.array_sort(F.collect_list(F.struct("depth", "node")))
    paths = turns.groupBy("conv_id").agg(F.transform(path, lambda x: x["node"]).alias("nodes"))
    paths = settle(paths.withColumn("path", F.array_join("nodes", "")))
    ranked = wide_rank(paths.select("path").distinct(), [], [F.col("path")], "rank")
    placed = paths.join(ranked, "path").select("rank", F.posexplode("nodes").alias("depth", "node"))
    places = placed.groupBy("node").agg(F.min("rank").alias("rank"))
    nodes = turns.groupBy("node").agg(*[F.min(c).alias(c) for c in ("parent", "depth", "role", "segment", "loss_start", "loss_end", "position", "n")])
    nodes = settle(nodes.join(places, "node"))
    offsets = wide_running(nodes.select("node", "rank", "depth", "n"), [], [F.col("rank"), F.col("depth")], {"_to": F.col("n")})
    offsets = settle(offsets.select("node", (F.col("_to") - F.col("n")).alias("offset"), F.col("_to").alias("end")))
    steps = turns.select("conv_id", "depth", "node").join(offsets, "node").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "offset", "end", "node"))).alias("s"))
    # A stretch starts where a node does not follow the one above it, and ends where the next one starts.
    begins = F.filter(F.transform("s", lambda x, i: F.when((i == 0) | (F.get(F.col("s"), i - 1)["end"] != x["offset"]), i)), lambda i: i.isNotNull())
    steps = steps.withColumn("b", begins)
    attends = F.transform("b", lambda i, k: F.struct(F.get(F.col("s"), i)["offset"].alias("start"), F.get(F.col("s"), F.coalesce(F.get(F.col("b"), k + 1), F.size("s")) - 1)["end"].alias("end")))
    convs = steps.select("conv_id", F.size("s").cast("long").alias("n_turns"), F.transform("s", lambda x: x["node"]).alias("nodes"), attends.alias("attends"))
    return nodes.join(offsets, "node").select("node", "parent", "depth", "role", "segment", "loss_start", "loss_end", "position", "offset"), convs


def read_back(nodes: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, parsed from the nodes' text."""
    parts = convs.select("conv_id", F.posexplode("nodes").alias("i", "node")).join(nodes.select("node", "segment", "loss_start", "loss_end"), "node")
    parts = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "segment", "loss_start", "loss_end"))).alias("s"))
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for s in batch.column(1):
                turns, loss, n_loss, chars, count = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for x in s.as_py():
                    role, text = parse_turn(x["segment"])
                    turns.update(f"{role}\n{text}\n".encode())
                    masked = unescape(x["segment"][x["loss_start"]: x["loss_end"]])
                    loss.update(masked.encode())
                    n_loss, chars, count = n_loss + len(masked), chars + len(x["segment"]), count + 1
                rows.append((count, turns.hexdigest(), n_loss, loss.hexdigest(), chars))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            made = [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return parts.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
