"""Every operator and every pipeline stage on odd inputs: nothing crashes, and each case has its stated result."""

import sys
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from gleanery.llm import bpe, chat, gam, licenses, mixing, neardup, pii, repeats, rules, topk  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1), (4, 1), (5, 0), (2, None)], "doc_id long, quality int")


RUNS = {
    "pii": lambda d, _: pii.find(d),
    "redact": lambda d, _: pii.redact(d),
    "neardup": lambda d, _: neardup.classes(d),
    "rules": lambda d, _: rules.judge(d),
    "gam": lambda d, y: gam.classify(d, y),
    "gam_keep": lambda d, y: gam.keep_good(d, y),
    "repeats": lambda d, _: repeats.remove(d),
    "licenses": lambda d, _: licenses.scan(d),
    "mixing": lambda d, _: mixing.select(d),
    "bpe": lambda d, _: bpe.encode(d, RANKS, public_tokenizers.PATTERN),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_and_clashing_names(make, odd, labels, name):
    plain = RUNS[name](make(odd), labels)
    clash = RUNS[name](make(odd, clash=True), labels)
    common = [c for c in plain.columns if c != "n_chars"]
    text = lambda df: sorted(str([str(r[c]) for c in common]) for r in df.collect())
    assert text(plain) == text(clash)
    if name not in ("licenses", "mixing", "gam_keep"):
        assert plain.count() == len(odd)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(make, labels, name):
    assert RUNS[name](make([]), labels).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages(spark, make, odd, labels, tmp_path, name, stage, rows):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = make(odd if rows == "odd" else [], clash=True)
    out = stage(spark, docs, str(tmp_path))
    n = out.count()
    assert n == 0 if rows == "none" else n > 0
    if name != "byte_bpe":
        assert out.columns == docs.columns


def test_pipeline_is_its_stages(spark, make, odd, prose, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    make([*odd[:6], (8, prose.replace("river", "brook") + "Write to a.b@mail.example.com today."), (9, "*** $$$ " * 60)]).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in df.collect())
    assert key(docs) == key(corpus_pipeline.run(spark, str(tmp_path)))


def test_near_dedup_stage_keeps_one_of_each(spark, make, odd):
    out = corpus_pipeline.near_dedup(spark, make(odd), "")
    ids = sorted((r["doc_id"] for r in out.collect()), key=lambda i: (i is None, i or 0))
    assert ids == [0, 1, 2, 3, 5, 7, None]


def test_redaction_takes_effect(spark, make):
    out = corpus_pipeline.personal_data(spark, make(["mail a@b.org now, or +49 30 1234567!", None, "clean"]), "").orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["mail <EMAIL> now, or <PHONE>!", None, "clean"]
    assert out[0]["n_chars"] == len(out[0]["text"])


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.5]), (7, [-1.0, 2.0]), (None, [1.0, 1.0]), (40, [1e300, 0.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("other")).withColumn("v", F.lit("other"))
    out = [tuple(r) for r in topk.search(df, lambda i: i % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    top = (1 << 63) - 1
    assert [r for r in out if r[0] == 0] == [(0, 1, 40, top), (0, 2, 1, 4096), (0, 3, 20, 4096)]
    assert [r for r in out if r[0] == 20] == [(20, 1, 40, top), (20, 2, 0, 4096), (20, 3, 1, 4096)]
    assert [r[2] for r in out if r[0] == 40] == [0, 1, 20]
    assert topk.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_chat_edges(spark):
    mean = "<|turn|> <\\|end|> </s>[INST] \\\\<|x"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", mean), (2, 0, "user", "hi"), (2, 1, "assistant", None), (3, None, None, ""), (None, 0, "user", "hi"), (4, 0, "a\nb<|", "x"), (1, 1, "assistant", mean)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("node", F.lit(1)).withColumn("path", F.lit(1))
    turns = chat.settle(chat.turns_of(df))
    nodes, convs = chat.tree(turns)
    found = {r["segment"]: r for r in nodes.collect()}
    assert sum(r["segment"] == chat.format_turn("user", "hi") for r in nodes.collect()) == 1
    assert all(chat.parse_turn(s)[0] == r["role"] for s, r in found.items())
    stream = "".join(r["segment"] for r in sorted(nodes.collect(), key=lambda r: r["offset"]))
    back = {r["conv_id"]: r for r in chat.read_back(nodes, convs).collect()}
    for c in convs.collect():
        text = "".join(stream[a:b] for a, b in c["attends"])
        assert len(text) == back[c["conv_id"]]["formatted_chars"] and all(a["end"] < b["start"] for a, b in zip(c["attends"], c["attends"][1:], strict=False))
    assert back[1]["n_turns"] == 3 and back[1]["loss_chars"] == 2 * len(mean)
    assert back[3]["loss_chars"] == 0 and back[4]["n_turns"] == 1
    assert chat.tree(chat.turns_of(df.limit(0)))[1].count() == 0
